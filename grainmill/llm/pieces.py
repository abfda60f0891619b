"""SentencePiece encoding with seeded merge-dropout, and decoding.

Merges run as in a BPE piece model: an agenda of adjacent pairs, best score first, leftmost first among equals. With
dropout, a candidate merge taken from the agenda is skipped if a keyed hash of (key, merged piece, place in the word)
falls below the rate. The key is a hash of (seed, document id, ordinal of the word), so each occurrence draws freely,
every run the same. A rate of 0 gives the model's own segmentation.

Words are merged as arrays: a column per word, and in each round every word's agenda gives its best candidate, which is
merged or skipped. What is remembered of a word is its segmentation without skips and the candidates on the way; an
occurrence that skips none of them takes it, and only the others are merged anew. Words of over SHORT symbols are merged
alone, by a heap, in time that hardly grows beyond their length.

No piece reaches over a space mark that follows other text, nor over a line feed, so words are cut there and encoded
alone. Characters without a piece fall back to their UTF-8 bytes, and so does the space mark itself where a text holds
it, so decoding gives every text back. Null texts give null ids and decode to null; empty texts give no ids. Repeated
rows get equal ids. An empty table gives an empty result. Only the named columns are read."""

from __future__ import annotations

import hashlib
import heapq
import re
import zlib
from collections.abc import Iterator
from functools import cached_property, lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from grainmill.llm.words import Numbering, Ragged, slices, sums_by

SPACE = "▁"
#: Words remembered by a Python worker, a bound on its memory only.
REMEMBERED = 400_000
#: Cuts that no piece reaches over: line feeds, before spaces, and between a letter and one of these marks.
MARKS = ".,!?;:|"
LETTER = "[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f]"
WORD = re.compile(rf"\n| *{LETTER}+(?=[ \n{MARKS}]|\Z)| +[^ \n]*|[^ \n]+")
LETTER_MARK = re.compile(rf"{LETTER}[{MARKS}]")
#: Symbols up to which a word is merged with others as arrays, widths of such arrays, and their cells at once.
SHORT = 48
WIDTHS = (4, 6, 8, 12, 16, 24, SHORT)
CELLS = 1 << 18
#: No rank; bits of a symbol and of a place in one number with a rank.
NONE, SYMBOL, PLACE = 1 << 24, 24, 6
MASK = (1 << 32) - 1


def merge_hash(rank: int, place: int, key: int) -> int:
    """32-bit keyed hash of a candidate merge: the merged piece's rank and its place in the word."""
    h = ((rank * 0x9E3779B1) ^ (place * 0x85EBCA77) ^ key) & MASK
    h = ((h ^ (h >> 15)) * 0x2C1B3C6D) & MASK
    return h ^ (h >> 13)


def _unkeyed(ranks: np.ndarray, places: np.ndarray) -> np.ndarray:
    """What the hash takes of candidates, without the key."""
    return (ranks.astype(np.uint32) * np.uint32(0x9E3779B1)) ^ (places.astype(np.uint32) * np.uint32(0x85EBCA77))


def _keyed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
    return h ^ (h >> np.uint32(13))


class Pairs:
    """Ranks of mergeable pairs of symbols, in an open-addressed table that is read for whole arrays."""

    def __init__(self, pairs: dict[tuple[int, int], tuple[int, int]], base: int):
        """From pairs to the rank and symbol of what they merge into."""
        self.base = base
        codes = np.array([a * base + b for a, b in pairs], np.int64)
        self.bits = max(4, 2 + int(len(codes)).bit_length())
        self.codes = np.full(1 << self.bits, -1, np.int64)
        #: Rank and symbol in one number; the last stands for pairs that aren't there.
        self.values = np.full((1 << self.bits) + 1, NONE << SYMBOL, np.int64)
        values, slots, left = np.array([(rank << SYMBOL) | into for rank, into in pairs.values()], np.int64), self._slots(codes), np.arange(len(codes))
        while len(left):
            free = left[self.codes[slots[left]] < 0]
            self.codes[slots[free]] = codes[free]
            done = self.codes[slots[left]] == codes[left]
            self.values[slots[left[done]]] = values[left[done]]
            left = left[~done]
            slots[left] = (slots[left] + 1) & ((1 << self.bits) - 1)

    def _slots(self, codes: np.ndarray) -> np.ndarray:
        return ((codes.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def __call__(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        codes = a * self.base + b
        slots = self._slots(codes)
        found = self.codes[slots]
        at = np.where(found == codes, slots, 1 << self.bits)
        left = np.nonzero((found != codes) & (found >= 0))[0]
        while len(left):
            slots[left] = (slots[left] + 1) & ((1 << self.bits) - 1)
            found = self.codes[slots[left]]
            hit = found == codes[left]
            at[left[hit]] = slots[left[hit]]
            left = left[~hit & (found >= 0)]
        return self.values[at]


class PieceModel:
    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        names = [model.id_to_piece(i) for i in range(n)]
        plain = [not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i)) for i in range(n)]
        self.ids = {names[i]: i for i in range(n) if plain[i]}
        self.bytes = {int(names[i][3:5], 16): i for i in range(n) if model.is_byte(i)}
        if len(self.bytes) != 256 or SPACE not in self.ids:
            raise ValueError("lossless coding needs a model with byte fallback and a space mark")
        if any(SPACE in p.lstrip(SPACE) or "\n" in p or LETTER_MARK.search(p) for p in self.ids):
            raise ValueError("a piece of this model reaches over a word's border")
        scores = {p: -model.get_score(i) for p, i in self.ids.items() if len(p) > 1}
        order = {x: k for k, x in enumerate(sorted(set(scores.values())))}
        self.rank = {p: order[x] for p, x in scores.items()}  # best first; pieces of equal scores share a rank
        values = [bytes([b]) for b in range(256)]
        self.values = [values[int(names[i][3:5], 16)] if model.is_byte(i) else names[i].replace(SPACE, " ").encode() if plain[i] else b"" for i in range(n)]
        self._arrays()

    def _arrays(self) -> None:
        """Symbols are numbered: pieces, then characters that are in pieces but none themselves, then a mark of dead and
        outer places, then all other characters by code point."""
        names = [*self.ids, *sorted({c for p in self.ids for c in p} - self.ids.keys())]
        number = {s: k for k, s in enumerate(names)}
        self.n_symbols = self.dead = len(names)
        self.symbol_ids = np.array([self.ids.get(s, -1) for s in names], np.int64)
        self.points = np.array([ord(s) if len(s) == 1 else 0 for s in names], np.int64)
        self.of_char = np.arange(0x110000, dtype=np.int64) + self.dead + 1
        for c, k in number.items():
            if len(c) == 1:
                self.of_char[ord(c)] = k
        self.of_char[ord(" ")] = number[SPACE]
        self.of_char[ord(SPACE)] = self.dead + 1 + ord(SPACE)  # a mark in a text stands for itself
        pairs = {}
        for piece, rank in self.rank.items():
            for k in range(1, len(piece)):
                if (a := number.get(piece[:k])) is not None and (b := number.get(piece[k:])) is not None:
                    pairs[a, b] = rank, number[piece]
        self.pairs = Pairs(pairs, self.dead + 1 + 0x110000)

    def symbols(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Symbols of words end to end, and how many each has."""
        flat = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32)
        return self.of_char[flat], np.fromiter(map(len, words), np.int64, len(words))

    def flat_ids(self, symbols: np.ndarray, lens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of runs of merged symbols; those without one give their bytes."""
        inside = symbols < self.dead
        ids = np.where(inside, self.symbol_ids[np.where(inside, symbols, 0)], -1)
        if (ids >= 0).all():
            return ids, lens
        at = np.nonzero(ids < 0)[0]
        points = np.where(symbols[at] < self.dead, self.points[np.minimum(symbols[at], self.dead - 1)], symbols[at] - self.dead - 1)
        runs = [[self.bytes[b] for b in chr(p).encode("utf-8", "surrogatepass")] for p in points.tolist()]
        size = np.ones(len(ids), np.int64)
        size[at] = [len(r) for r in runs]
        out = np.repeat(ids, size)
        out[out < 0] = [i for r in runs for i in r]
        return out, sums_by(size, lens)

    def merged(self, symbols: np.ndarray, lens: np.ndarray, keys: np.ndarray | None = None, limit: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Ids of words given as runs of symbols, end to end, and their counts; then the candidate merges, without their
        key, and their counts. With keys, candidates whose hash is below `limit` are skipped."""
        starts = np.cumsum(lens) - lens
        groups, owners, found, at = [], [], [], []
        for low, width in zip((0, *WIDTHS), WIDTHS, strict=False):
            some = np.nonzero((lens > low) & (lens <= width))[0]
            step = max(1, CELLS // (width + 1))
            for k in range(0, len(some), step):
                rows = some[k : k + step]
                held = np.full((width + 1, len(rows)), self.dead, np.int64)
                for place in range(width):
                    on = lens[rows] > place
                    held[place, on] = symbols[starts[rows[on]] + place]
                out, which, hashes = self._merge(held, None if keys is None else keys[rows], limit, keys is None)
                alive = out.T != self.dead
                groups.append(out.T[alive])
                owners.append(np.repeat(rows, alive.sum(1)))
                found.append(hashes)
                at.append(rows[which])
        for row in np.nonzero(lens > SHORT)[0].tolist():
            run, path = self._merge_long(symbols[starts[row] : starts[row] + lens[row]].tolist(), 0 if keys is None else int(keys[row]), limit if keys is not None else 0)
            groups.append(np.array(run, np.int64))
            owners.append(np.full(len(run), row))
            if keys is None:
                found.append(_unkeyed(*np.array(path, np.int64).reshape(-1, 2).T))
                at.append(np.full(len(path), row))

        def runs(values: list[np.ndarray], owner: list[np.ndarray], kind) -> tuple[np.ndarray, np.ndarray]:
            whole, rows = np.concatenate([np.zeros(0, kind), *values]), np.concatenate([np.zeros(0, np.int64), *owner])
            return whole[np.argsort(rows, kind="stable")], np.bincount(rows, minlength=len(lens))

        return *self.flat_ids(*runs(groups, owners, np.int64)), *runs(found, at, np.uint32)

    def _merge(self, symbols: np.ndarray, keys: np.ndarray | None, limit: int, record: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Merged columns of symbols (dead in the last row); and, if recorded, the column and unkeyed hash of candidates in
        the order of the agenda. Agendas hold rank, place and what the pair merges into in one number, so a column's
        least is its best and leftmost candidate."""
        width, n = symbols.shape
        final, columns = symbols, np.arange(n)
        none = NONE << (SYMBOL + PLACE)

        def agenda_of(a: np.ndarray, b: np.ndarray, place: np.ndarray) -> np.ndarray:
            value = self.pairs(a, b)
            return ((value >> SYMBOL) << (SYMBOL + PLACE)) | (place << SYMBOL) | (value & ((1 << SYMBOL) - 1))

        agenda = np.full((width, n), none, np.int64)
        agenda[:-1] = agenda_of(symbols[:-1].reshape(-1), symbols[1:].reshape(-1), np.repeat(np.arange(width - 1), n)).reshape(width - 1, n)
        after = np.repeat(np.arange(1, width + 1), n).reshape(width, n)
        before = after - 2
        which, hashes = [np.zeros(0, np.int64)], [np.zeros(0, np.uint32)]
        while n:
            best = agenda.min(0)
            live = np.nonzero(best < none)[0]
            if len(live) < 0.6 * n:
                if symbols is not final:
                    final[:, columns] = symbols
                columns, best, n = columns[live], best[live], len(live)
                symbols, agenda, after, before = (np.ascontiguousarray(x[:, live]) for x in (symbols, agenda, after, before))
                keys = None if keys is None else keys[live]
                live = np.arange(n)
                if not n:
                    break
            best = best[live]
            place, rank, both = (best >> SYMBOL) & ((1 << PLACE) - 1), best >> (SYMBOL + PLACE), best & ((1 << SYMBOL) - 1)
            if record:
                which.append(columns[live])
                hashes.append(_unkeyed(rank, place))
            flat, left, right, todo = symbols.reshape(-1), before.reshape(-1), after.reshape(-1), agenda.reshape(-1)
            if keys is not None:
                skip = _keyed(_unkeyed(rank, place) ^ keys[live]) < np.uint64(limit)
                todo[place[skip] * n + live[skip]] = none
                live, place, both = live[~skip], place[~skip], both[~skip]
            at = place * n + live
            gone = right[at] * n + live
            last = right[gone]
            next_at = last * n + live
            flat[at], flat[gone], todo[gone] = both, self.dead, none
            right[at], left[next_at] = last, place
            todo[at] = agenda_of(both, flat[next_at], place)
            prior = left[at]
            has = prior >= 0
            prior, live, both = prior[has], live[has], both[has]
            todo[prior * n + live] = agenda_of(flat[prior * n + live], both, prior)
        if symbols is not final:
            final[:, columns] = symbols
        return final, np.concatenate(which), np.concatenate(hashes)

    def _merge_long(self, text: list[int], key: int, limit: int) -> tuple[list[int], list[tuple[int, int]]]:
        """Merged symbols of one word, and its candidates as rank and place. The agenda is a heap; merged-away symbols are
        left dead."""
        n, base, mask = len(text), self.pairs.base, (1 << SYMBOL) - 1
        values = self._values
        end = list(range(1, n + 1))  # where the symbol that starts at i ends
        before = list(range(-1, n - 1))  # where the symbol before it starts
        agenda = [(v >> SYMBOL, i, i + 1, i + 2, v & mask) for i in range(n - 1) if (v := values.get(text[i] * base + text[i + 1])) is not None]
        heapq.heapify(agenda)
        path = []
        while agenda:
            rank, i, mid, last, both = heapq.heappop(agenda)
            if text[i] == self.dead or end[i] != mid or text[mid] == self.dead or end[mid] != last:
                continue
            path.append((rank, i))
            if limit and merge_hash(rank, i, key) < limit:
                continue
            text[i], text[mid], end[i] = both, self.dead, last
            if last < n:
                before[last] = i
                if (v := values.get(both * base + text[last])) is not None:
                    heapq.heappush(agenda, (v >> SYMBOL, i, last, end[last], v & mask))
            if (left := before[i]) >= 0 and (v := values.get(text[left] * base + both)) is not None:
                heapq.heappush(agenda, (v >> SYMBOL, left, i, last, v & mask))
        return [x for x in text if x != self.dead], path

    @cached_property
    def _values(self) -> dict[int, int]:
        there = self.pairs.codes >= 0
        return dict(zip(self.pairs.codes[there].tolist(), self.pairs.values[:-1][there].tolist(), strict=True))

    def segment(self, word: str, key: int = 0, limit: int = 0) -> list[int]:
        """Ids of one word whose spaces are real spaces; a candidate merge is skipped if its keyed hash is below `limit`."""
        symbols, _ = self._merge_long(self.symbols([word])[0].tolist(), key, limit)
        return self.flat_ids(np.array(symbols, np.int64), np.array([len(symbols)]))[0].tolist()


@lru_cache(1)
def piece_model(path: str) -> PieceModel:
    """One per Python worker: its tables take a moment to build."""
    return PieceModel(path)


class PieceEncoder:
    def __init__(self, path: str, rate: float, seed: int):
        self.model, self.rate, self.seed = piece_model(path), rate, seed
        self._reset()

    def _reset(self) -> None:
        self.known = Numbering()
        #: By word: symbols, ids without skips, and the candidates on the way.
        self.symbols, self.ids, self.candidates = Ragged(np.int32), Ragged(np.uint32), Ragged(np.uint32)

    def _learn(self, words: list[str]) -> None:
        symbols, lens = self.model.symbols(words)
        ids, counts, candidates, n = self.model.merged(symbols, lens)
        self.symbols.add(symbols.astype(np.int32), lens)
        self.ids.add(ids.astype(np.uint32), counts)
        self.candidates.add(candidates, n)

    def _skipping(self, words: np.ndarray, keys: np.ndarray, limit: int) -> np.ndarray:
        """Occurrences whose key skips a candidate of their word."""
        h, lens = self.candidates.gather(words)
        hit = _keyed(h ^ np.repeat(keys, lens)) < np.uint64(limit)
        return np.nonzero(sums_by(hit, lens))[0]

    def __call__(self, doc_ids: list[int | None], texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts end to end, and their counts."""
        if len(self.known) > REMEMBERED:
            self._reset()
        words, sizes, keys = [], [], [np.zeros(0, np.uint32)]
        for doc_id, text in zip(doc_ids, texts, strict=True):
            mine = WORD.findall(" " + text) if text else []
            words += mine
            sizes.append(len(mine))
            draw = np.arange(len(mine), dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(xxhash.xxh64_intdigest(f"{self.seed}:{doc_id}"))
            draw = (draw ^ (draw >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
            draw = (draw ^ (draw >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
            keys.append((draw >> np.uint64(32)).astype(np.uint32))
        numbers, keys = self.known.numbers(words), np.concatenate(keys)
        if fresh := self.known.take_fresh():
            self._learn(fresh)
        starts, lens = self.ids.ends[numbers], self.ids.ends[numbers + 1] - self.ids.ends[numbers]
        flat, limit = self.ids.data, int(self.rate * (MASK + 1))
        if limit and len(numbers):
            cut = self._skipping(numbers, keys, limit)
            own, own_lens, *_ = self.model.merged(*self.symbols.gather(numbers[cut]), keys[cut], limit)
            flat = np.concatenate([flat[: self.ids.ends[self.ids.n]], own.astype(np.uint32)])
            lens[cut] = own_lens
            starts[cut] = self.ids.ends[self.ids.n] + np.cumsum(own_lens) - own_lens
        ends = np.concatenate([[0], np.cumsum(lens)])
        ids = flat[np.repeat(starts - ends[:-1], lens) + np.arange(ends[-1])]
        return ids, np.diff(ends[np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)])


_encoders: dict[tuple, PieceEncoder] = {}


def _encoder(*key) -> PieceEncoder:
    if key not in _encoders:
        _encoders.clear()
        _encoders[key] = PieceEncoder(*key)
    return _encoders[key]


def encode(docs: DataFrame, model: str, rate: float = 0.1, seed: int = 42, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids) per row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(model, rate, seed)
        for batch in slices(batches):
            texts = batch.column(1).to_pylist()
            ids, counts = encoder(batch.column(0).to_pylist(), texts)
            offsets = pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32), mask=np.array([*(t is None for t in texts), False]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(offsets, pa.array(ids.astype(np.int32)))], names=["doc_id", "ids"])

    return docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id bigint, ids array<int>")


def _decoded(batches: Iterator[pa.RecordBatch], model: str) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray | None], list[str | None]]]:
    values = piece_model(model).values
    for batch in batches:
        runs = [v.values.to_numpy() if v.is_valid else None for v in batch.column(1)]
        raw = [None if r is None else b"".join([values[i] for i in r.tolist()]) for r in runs]
        yield batch, runs, [None if b is None else b[1:].decode("utf-8", "surrogatepass") for b in raw]


def decode(encoded: DataFrame, model: str) -> DataFrame:
    """(doc_id, text) of (doc_id, ids)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, _, texts in _decoded(batches, model):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id bigint, text string")


def digests(encoded: DataFrame, model: str) -> DataFrame:
    """(doc_id, n_tokens, ids_crc32, text_sha256) of (doc_id, ids): the hash is that of the decoded text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, runs, texts in _decoded(batches, model):
            runs = [np.zeros(0, np.int32) if r is None else r for r in runs]
            cols = [[len(r) for r in runs], [zlib.crc32(r.astype("<u4").tobytes()) for r in runs], [None if t is None else hashlib.sha256(t.encode("utf-8", "surrogatepass")).hexdigest() for t in texts]]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.string()), strict=True))], names=["doc_id", "n_tokens", "ids_crc32", "text_sha256"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id bigint, n_tokens bigint, ids_crc32 bigint, text_sha256 string")


def op8_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from grainmill.llm.tables import documents

    model = public_tokenizers.path("piece_bpe_32k.model")
    return digests(encode(documents(spark, sf_dir), model), model)
