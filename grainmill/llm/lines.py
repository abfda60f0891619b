"""Fuzzy line dedup.

Lines are normalised (lower case, digits to 0, ASCII punctuation to spaces, single spaces); lines equal in that form, by a
hash of 128 bits, are one node. In the index a node goes by the hash's first half, so of 150,000,000 distinct lines two are
taken for one there with a probability of 0.0006; it matters if one of them is linked. Nodes are candidates by any of three
indexes:

- A SimHash of 128 bits in four blocks. A word votes in one block only, the one that its hash names, so a word that is
  changed, added or lost moves one or two blocks and no others, and (pigeonhole) two blocks at least stay. Nodes meet
  under each two blocks that hold three words and LEAST bytes or more. A plain SimHash doesn't do: one changed word of
  ten moves 8 of its 64 bits, and at 3 bits only a quarter of the pairs below were met.
- MinHashes of word pairs, in BANDS bands of three, for edits that touch more words: a pair of lines whose word pairs have
  a Jaccard similarity of 0.69 (one changed word in ten) meets with probability 0.96, of 0.83 with 0.999. Lines of few
  words for their length, such as text without spaces, take runs of 8 bytes as well. Edits spread over most words of a
  line can be missed here.
- Lines of which one has under SHORT code points: one of the even parts of the shorter is in the longer, close to its
  place, as there is one part more than edits (pigeonhole). This loses nothing, nor does leaving out keys that all their
  lines only ask for: the shorter line of a pair posts its own parts.

Of lines under one key, pairs stay whose counts of characters in KINDS kinds differ by no more than that many edits can
(an edit moves two counts by one), which loses nothing either.

Texts of candidates are taken in one pass over the documents, by a filter of fixed size. Pairs that one alignment shows to be
close stay; of the rest those go whose blocks are too far from all passages near their place or, in very long lines, whose
counts of grams are too far apart, before any distance is taken. None of this changes a result.

Candidates are verified by edit similarity alone, 1 - distance / longer length, on the normalised lines; of each
connected group the first occurrence by (doc_id, document, line) stays and the others go. Lines too short for an edit
to leave them similar match by equality only, which loses nothing.

A group of copies is one node, links are stars first and then only across components, and the occurrence to keep is a
minimum with map-side combine, so neither a line that is everywhere nor a large group of near copies is gathered.

Lines blank after normalisation always stay. Null texts stay null, empty ones empty; documents stay even if all their
lines go. Rows equal in doc_id and text are one document, returned as often. Null ids sort first. An empty table gives
an empty result. All columns of the input are carried; only doc_id and text are read."""

from __future__ import annotations

import string
from collections.abc import Callable, Iterator
from functools import cache
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from grainmill.llm.simhash import DEALT, MARK, _match, links, marks_of, shares
from grainmill.llm.words import pack, release, slices, steps_of, unpack
from grainmill.session import Written

SIMILARITY = 0.9
#: Bands of three MinHashes. Lines shorter than SHORT are indexed by their parts; longer words than WIDE code points in
#: the mean are cut into runs of RUN bytes. Blocks that nodes meet under hold LEAST bytes of words.
BANDS, SHORT, WIDE, RUN, LEAST = 20, 72, 16, 8, 16
#: Kinds of characters that are counted in a line, eight in a 64-bit number, up to MOST.
KINDS, MOST = 16, 127
#: Blocks of a fingerprint, and the pairs of blocks that stay if a word is changed.
BLOCKS = 4
VIEWS = list(combinations(range(BLOCKS), 2))
TABLE = bytes(ord("0") if 48 <= b <= 57 else 32 if b < 128 and chr(b) in string.punctuation else b for b in range(256))
#: Texts worked on at once: the arrays then stay in the processor's caches.
SLICE = 256 << 10
#: The bits of a byte, each in a byte of its own.
SPREAD = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").reshape(-1, 8).copy().view(np.uint64)[:, 0]
BASE = 0x9E3779B97F4A7C15 | 1
INVERSE = pow(BASE, -1, 1 << 64)


def normalise(text: str) -> bytes:
    """Lower case, digits to 0, ASCII punctuation to spaces; lines as they were."""
    return text.lower().encode("utf-8", "surrogatepass").translate(TABLE)


_POWERS: dict[int, np.ndarray] = {}


def _powers(base: int, n: int) -> np.ndarray:
    """base ** 0, 1, .. modulo 2 ** 64."""
    held = _POWERS.get(base)
    if held is None or len(held) < n:
        held = np.full(max(n, 1 << 20), base, np.uint64)
        held[0] = 1
        held = _POWERS[base] = np.cumprod(held, dtype=np.uint64)
    return held[:n]


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _run_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of runs of values: polynomials modulo 2 ** 64, shifted to a common start, then mixed with the run's
    length."""
    total = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * _powers(BASE, len(values)), dtype=np.uint64, out=total[1:])
    shifted = (total[ends] - total[starts]) * _powers(INVERSE, len(values) + 1)[starts]
    return _mix(shifted + (ends - starts).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def said_lines(text: str) -> Iterator[tuple[int, bytes]]:
    """Places of the lines that aren't blank after normalisation, and what they say."""
    for pos, line in enumerate(normalise(text).split(b"\n")):
        if words := line.split():
            yield pos, b" ".join(words)


def line_keys(lines: list[bytes]) -> np.ndarray:
    """Two columns of 64 bits each: a line's identity."""
    return np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, lines)), np.int64).reshape(-1, 2)


def line_facts(texts: list[str | None], similarity: float) -> tuple[list[int], list[int], np.ndarray, np.ndarray, list[bytes], np.ndarray]:
    """(text, pos, keys, n, marks, kinds) of the lines that aren't blank after normalisation, in order; n is their code points."""
    text, pos, lines = _said(texts)
    n = _points(lines)
    return text, pos, line_keys(lines), n, _marks(lines, n, similarity), _kinds(lines, n)


def _said(texts: list[str | None]) -> tuple[list[int], list[int], list[bytes]]:
    text, pos, lines = [], [], []
    for t, x in enumerate(texts):
        for p, line in said_lines(x) if x else ():
            text.append(t)
            pos.append(p)
            lines.append(line)
    return text, pos, lines


def _points(lines: list[bytes]) -> np.ndarray:
    """Code points of each line."""
    sizes = np.fromiter(map(len, lines), np.int64, len(lines))
    begun = np.concatenate([[0], np.cumsum((np.frombuffer(b"".join(lines), np.uint8) & 0xC0) != 0x80)])
    ends = np.cumsum(sizes)
    return begun[ends] - begun[ends - sizes]


def _marks(lines: list[bytes], n: np.ndarray, similarity: float) -> list[bytes]:
    """Posting keys of each line."""
    keys, at, _ = _keys(lines, n, similarity)
    order = np.lexsort((keys, at))
    held, cuts = marks_of(keys[order]), np.searchsorted(at[order], np.arange(len(lines) + 1)) * MARK
    return [held[i:j] for i, j in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]


def _keys(lines: list[bytes], n: np.ndarray, similarity: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Posting keys of all lines, the line of each, and whether it only asks: two lines that ask for a part that neither has
    cut needn't meet. Words of all lines are worked on as one array."""
    if not lines:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, bool)
    buffer = np.frombuffer(b"\n".join(lines) + b"\n", np.uint8)
    ends = np.nonzero((buffer == 32) | (buffer == 10))[0]
    starts = np.concatenate([[0], ends[:-1] + 1])
    last = np.nonzero(buffer[ends] == 10)[0] + 1
    first = np.concatenate([[0], last[:-1]])
    words = _run_hashes(buffer.astype(np.uint64) + np.uint64(1), starts, ends)
    rank = np.repeat(np.arange(len(lines)), last - first)
    views, there = _views(words, rank, ends - starts, len(lines))
    keys = np.concatenate([views, _bands(words, rank, first)], axis=1)
    there = np.concatenate([there, np.ones((len(lines), BANDS), bool)], axis=1) & (n >= SHORT)[:, None]
    out, at = [keys[there]], [np.nonzero(there)[0]]
    for i in np.nonzero(n > WIDE * (last - first))[0].tolist():
        runs = np.lib.stride_tricks.sliding_window_view(np.frombuffer(lines[i].ljust(RUN), np.uint8), RUN)
        runs = _mix(np.ascontiguousarray(runs).view(np.uint64)[:, 0])
        out.append(_min_hashes(runs, np.zeros(1, np.int64))[0])
        at.append(np.full(BANDS, i))
    asks = [np.zeros(len(k), bool) for k in out]
    some = np.nonzero(n <= (SHORT - 1) / similarity + 1e-9)[0]
    for size in np.unique(n[some]).tolist():
        of = some[n[some] == size]
        parts, only = _parts([lines[i] for i in of.tolist()], size, similarity)
        out.append(parts.reshape(-1))
        at.append(np.repeat(of, parts.shape[1]))
        asks.append(np.tile(only, len(of)))
    return np.concatenate(out), np.concatenate(at), np.concatenate(asks)


def _kinds(lines: list[bytes], n: np.ndarray) -> np.ndarray:
    """How many characters of each kind the lines hold."""
    if not lines:
        return np.zeros((0, KINDS // 8), np.int64)
    points = np.frombuffer(b"".join(lines).decode("utf-8", "surrogatepass").encode("utf-32-le", "surrogatepass"), np.uint32)
    kind = ((points * np.uint32(0x9E3779B1)) >> np.uint32(28)).astype(np.int64)
    counts = np.bincount(np.repeat(np.arange(len(lines)) * KINDS, n) + kind, minlength=len(lines) * KINDS)
    return np.minimum(counts, MOST).astype(np.uint8).reshape(len(lines), KINDS).view(np.int64)


def _views(words: np.ndarray, rank: np.ndarray, sizes: np.ndarray, n_lines: int) -> tuple[np.ndarray, np.ndarray]:
    """For each line a key per two blocks of its SimHash, and whether these hold enough words. Distinct words vote."""
    width = max(1, int(n_lines - 1).bit_length())
    order = np.argsort((rank.astype(np.uint64) << np.uint64(64 - width)) | (words >> np.uint64(width)))
    held, owner = words[order], rank[order]
    fresh = np.ones(len(order), bool)
    fresh[1:] = (held[1:] != held[:-1]) | (owner[1:] != owner[:-1])
    held, owner, size = held[fresh], owner[fresh], sizes[order][fresh]
    run = owner * BLOCKS + (held >> np.uint64(62)).astype(np.int64)  # words of a block are next to each other in this order
    begin = np.nonzero(np.diff(run, prepend=-1))[0]
    blocks, counts, lens = np.zeros(n_lines * BLOCKS, np.uint64), np.zeros(n_lines * BLOCKS, np.int64), np.zeros(n_lines * BLOCKS, np.int64)
    blocks[run[begin]] = _majorities((held & np.uint64(0xFFFFFFFF)).astype(np.uint32), begin) + np.uint64(1)
    counts[run[begin]], lens[run[begin]] = np.diff(np.append(begin, len(held))), np.add.reduceat(size, begin)
    blocks, counts, lens = (x.reshape(-1, BLOCKS) for x in (blocks, counts, lens))
    keys = [_mix(_mix(blocks[:, a] * np.uint64(BASE) + np.uint64(v + 1)) + blocks[:, b]) for v, (a, b) in enumerate(VIEWS)]
    enough = [(counts[:, a] + counts[:, b] >= 3) & (lens[:, a] + lens[:, b] >= LEAST) for a, b in VIEWS]
    return np.stack(keys, 1), np.stack(enough, 1)


_SPREADS = _mix(np.arange(1, 6 * BANDS + 1, dtype=np.uint64) * np.uint64(BASE)).reshape(BANDS, 3, 2)


def _bands(words: np.ndarray, rank: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Hashes of lines by their pairs of adjacent words, the line's ends counting as words."""
    left, right = np.zeros(len(words) + len(first), np.uint64), np.zeros(len(words) + len(first), np.uint64)
    at = np.arange(len(words)) + rank
    right[at] = left[at + 1] = words
    return _min_hashes(_mix(left * np.uint64(BASE) + right), first + np.arange(len(first)))


def _min_hashes(features: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """A row of BANDS keys for each run of features: hashes of three MinHashes each."""
    keys = np.empty((len(begin), BANDS), np.uint64)
    for band, spreads in enumerate(_SPREADS):
        key = np.full(len(begin), band + 1, np.uint64)
        for times, plus in spreads:
            key = _mix(key * np.uint64(BASE) + np.minimum.reduceat(features * (times | np.uint64(1)) + plus, begin))
        keys[:, band] = key
    return keys


@cache
def _places(size: int, similarity: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(begin, end, salt, only asks) of the parts that a line of `size` code points posts."""

    def most(longer: int) -> int:
        return int((1 - similarity) * longer + 1e-9)

    places = []
    for shorter in range(1, min(size, SHORT - 1) + 1):
        if size - shorter > most(size):
            continue
        # Parts depend on the shorter line only: as many as the longest line that it can be similar to allows.
        edits = most(int(shorter / similarity + 1e-9))
        cuts = [shorter * k // (edits + 1) for k in range(edits + 2)]
        for k, (lo, hi) in enumerate(zip(cuts, cuts[1:], strict=False)):
            more = size - shorter  # edits before a part and after it bound how far the first equal part has moved
            for by in range(max(-k, more - edits + k), min(k, more + edits - k) + 1):
                if 0 <= lo + by and hi + by <= size:
                    places.append((lo + by, hi + by, shorter * SHORT + k, more > 0 or by != 0))
    begin, end, salt, asks = np.array(places, np.int64).reshape(-1, 4).T
    return begin, end, _mix(salt.astype(np.uint64) + np.uint64(1)), asks.astype(bool)


def _parts(lines: list[bytes], size: int, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """Keys by which lines meet if the shorter has under SHORT code points, a row for each of `lines`, which have `size`: for
    each length that the shorter may have, its even parts, one more than edits can be in the pair's longer line; the shorter
    posts its own, the longer what it holds at those places, moved by as much as edits can. And which columns only ask,
    being no parts of a line of that size."""
    begin, end, salt, asks = _places(size, similarity)
    points = np.frombuffer(b"".join(lines).decode("utf-8", "surrogatepass").encode("utf-32-le", "surrogatepass"), np.uint32)
    total = np.zeros((len(lines), size + 1), np.uint64)
    np.cumsum((points.reshape(-1, size).astype(np.uint64) + np.uint64(1)) * _powers(BASE, size), axis=1, dtype=np.uint64, out=total[:, 1:])
    return _mix((total[:, end] - total[:, begin]) * _powers(INVERSE, size + 1)[begin] + salt), asks


def _majorities(hashes: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """SimHash, 32 bits, of each run of hashes. Bits are counted eight at a time, each in a byte of a 64-bit number, over
    pieces of at most 255 hashes; the pieces of a run are then added up."""
    sizes = np.diff(np.append(begin, len(hashes)))
    pieces = -(-sizes // 255)
    run = np.repeat(np.arange(len(begin)), pieces)
    nth = np.arange(len(run)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    starts = begin[run] + 255 * nth
    parts = hashes.view(np.uint8).reshape(-1, 4)
    ones = np.empty((len(starts), 32), np.uint8)
    for k in range(4):
        ones[:, 8 * k : 8 * k + 8] = np.add.reduceat(SPREAD[parts[:, k]], starts).view(np.uint8).reshape(-1, 8)
    if len(starts) > len(begin):
        ones = np.add.reduceat(ones, np.nonzero(nth == 0)[0], axis=0, dtype=np.int64)
    return np.packbits(ones.astype(np.int64) * 2 > sizes[:, None], axis=1, bitorder="little").view(np.uint32)[:, 0].astype(np.uint64)


def lines_of(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """(doc, doc_id, pos, key, check, n, k0, k1) of each line that isn't blank: doc is a hash of (doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, limit=SLICE):
            text, pos, lines = _said(batch.column(2).to_pylist())
            n, keys, at = _points(lines), line_keys(lines), pa.array(text, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), pa.array(pos, pa.int64()), pa.array(keys[:, 0]), pa.array(keys[:, 1]), pa.array(n), *(pa.array(k) for k in _kinds(lines, n).T)], names=["doc", "doc_id", "pos", "key", "check", "n", "k0", "k1"])

    return _named(docs, id_col, text_col).mapInArrow(run, "doc bigint, doc_id bigint, pos bigint, key bigint, check bigint, n bigint, k0 bigint, k1 bigint")


def _fuzzy(n, similarity: float):
    """Whether a line of n code points may be similar to another one: an edit fits into (1 - similarity) of the longer one."""
    return n * (1 - similarity) / similarity >= 1 - 1e-9


def postings(spark: SparkSession, docs: DataFrame, id_col: str, text_col: str, similarity: float) -> DataFrame:
    """Blobs of the marks of lines that may be similar to others, by the first half of their keys. They are made from the
    texts and dealt in one go, as 100 bytes of marks a line are dear to write. A task posts a line once or a few times,
    however many copies it has."""
    parts = shares(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, nodes, done, n_held = [], [], set(), 0

        def out() -> pa.RecordBatch:
            key, node = np.concatenate(keys), np.concatenate(nodes)
            order = np.argsort(key)
            key, node = key[order], node[order]
            part = ((key >> np.uint64(1)) * np.uint64(parts) >> np.uint64(8 * MARK)).astype(np.int64)  # ranges of keys, which are hashes
            cuts = np.searchsorted(part, np.arange(parts + 1))
            some = [p for p in range(parts) if cuts[p] < cuts[p + 1]]
            data = [pack(steps_of(key[cuts[p] : cuts[p + 1]]), node[cuts[p] : cuts[p + 1]]) for p in some]
            return pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(data, pa.binary())], names=["part", "data"])

        for batch in slices(batches, limit=SLICE):
            lines = list(set(_said(batch.column(0).to_pylist())[2]))
            ids = line_keys(lines)[:, 0].tolist()
            fresh = [i for i, k in enumerate(ids) if k not in done and _fuzzy(len(lines[i]), similarity)]
            if len(done) > 4 * DEALT:
                done.clear()
            done.update(ids[i] for i in fresh)
            lines, ids = [lines[i] for i in fresh], np.array([ids[i] for i in fresh], np.int64)
            n = _points(lines)
            some = np.nonzero(_fuzzy(n, similarity))[0]
            key, at, asks = _keys([lines[i] for i in some], n[some], similarity)
            keys.append(key >> np.uint64(64 - 8 * MARK) << np.uint64(1) | asks)  # the lowest bit: only asks
            nodes.append(ids[some][at])
            n_held += len(some)
            if n_held >= DEALT:
                yield out()
                keys, nodes, n_held = [], [], 0
        if keys:
            yield out()
        release()

    return docs.select(F.col(text_col).alias("text")).mapInArrow(run, "part int, data binary")


#: Postings that a task holds to drop keys that are only asked for; further ones are matched unfiltered.
HELD = 1 << 22


def _match_owned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """As simhash's match, without the keys that all their lines only ask for."""

    def owned() -> Iterator[pa.RecordBatch]:
        held, n, whole = [], 0, True

        def out() -> pa.RecordBatch:
            key, node = np.concatenate([np.cumsum(k, dtype=np.uint64) for k, _ in held]), np.concatenate([v for _, v in held])
            held.clear()
            asks, key = (key & np.uint64(1)).astype(bool), key >> np.uint64(1)
            if whole:
                order = np.argsort(key, kind="stable")
                key, node, asks = key[order], node[order], asks[order]
                begin = np.nonzero(np.diff(key, prepend=~key[:1]))[0]
                goes = np.repeat(~np.logical_and.reduceat(asks, begin), np.diff(np.append(begin, len(key)))) if len(key) else asks
                key, node = key[goes], node[goes]
            else:
                order = np.argsort(key, kind="stable")
                key, node = key[order], node[order]
            return pa.RecordBatch.from_arrays([pa.array([0], pa.int32()), pa.array([pack(steps_of(key), node)], pa.binary())], names=["part", "data"])

        for batch in batches:
            for blob in batch.column(1):
                held.append(unpack(blob.as_py()))
                n += len(held[-1][1])
                if n >= HELD:
                    whole, n = False, 0
                    yield out()
        if held:
            yield out()

    yield from _match(owned())


def _doc(id_col: str, text_col: str) -> Column:
    return F.xxhash64(F.col(id_col), F.col(text_col))


def _named(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(_doc(id_col, text_col).alias("doc"), F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))


def distance_within(a: str, b: str, most: int) -> bool:
    """Whether the edit distance is at most `most`: common ends cut off, then Myers' bit vectors, which stop once the
    distance can't come down to `most`."""
    if abs(len(a) - len(b)) > most:
        return False
    if a == b:
        return True
    lo, n = 0, min(len(a), len(b))
    while lo < n and a[lo] == b[lo]:
        lo += 1
    hi = 0
    while hi < n - lo and a[-1 - hi] == b[-1 - hi]:
        hi += 1
    a, b = a[lo : len(a) - hi], b[lo : len(b) - hi]
    if not a or not b:
        return len(a) + len(b) <= most
    masks: dict[str, int] = {}
    for i, c in enumerate(a):
        masks[c] = masks.get(c, 0) | 1 << i
    full, top = (1 << len(a)) - 1, 1 << (len(a) - 1)
    plus, minus, score = full, 0, len(a)
    for left, c in enumerate(b):
        eq = masks.get(c, 0)
        x = eq | minus
        diag = (((x & plus) + plus) ^ plus) | x
        up, down = minus | (full & ~(diag | plus)), plus & diag
        if up & top:
            score += 1
        elif down & top:
            score -= 1
        if score - (len(b) - 1 - left) > most:
            return False
        up = (up << 1) | 1
        plus = ((down << 1) & full) | (full & ~(diag | up))
        minus = up & diag & full
    return score <= most


#: Grams that pairs of lines are told apart by before their distance is taken, and the cells that they are counted in.
GRAM, CELLS = 3, 512


#: Code points that must agree for an alignment to go on, and how far ahead such a place is looked for.
ANCHOR, AHEAD = 8, 24


def edits_at_most(a: str, b: str, most: int) -> int:
    """Edits of one alignment of two lines, so no fewer than their distance: it goes on where the next code points agree
    again. Where none do, or over `most`, some number over `most`."""
    i = j = spent = 0
    while True:
        step = 64
        while step:
            while a[i : i + step] == b[j : j + step] and i + step <= len(a) and j + step <= len(b):
                i, j = i + step, j + step
            step //= 4
        if i >= len(a) or j >= len(b):
            return spent + max(0, len(a) - i) + max(0, len(b) - j)
        for ahead in range(1, AHEAD):
            p, q = a[i + ahead : i + ahead + ANCHOR], b[j + ahead : j + ahead + ANCHOR]
            if p == q:
                i, j = i + ahead, j + ahead
            elif p == b[j : j + ANCHOR]:
                i += ahead
            elif q == a[i : i + ANCHOR]:
                j += ahead
            else:
                continue
            spent += ahead
            break
        else:  # a passage that was put in, lost or replaced
            for ahead in range(0, min(most - spent + 1, len(a) - i), ANCHOR):
                at = b.find(a[i + ahead : i + ahead + 2 * ANCHOR], j, j + most - spent + 2 * ANCHOR)
                if at >= 0:
                    spent += max(ahead, at - j)
                    i, j = i + ahead, at
                    break
            else:
                return most + 1
        if spent > most:
            return spent


def _far(p: list[str], q: list[str], most: np.ndarray) -> np.ndarray:
    """Pairs that can't be within `most` edits: an edit takes and adds GRAM grams at most, each a difference of one."""
    sums = []
    for lines in (p, q):
        points = np.frombuffer("".join(lines).encode("utf-32-le"), np.uint32)
        sizes = np.fromiter(map(len, lines), np.int64, len(lines))
        grams = points[: max(0, len(points) - GRAM + 1)].copy()
        for k in range(1, GRAM):
            grams = grams * np.uint32(0x01000193) + points[k : k + len(grams)]
        cell = (grams * np.uint32(0x9E3779B1) >> np.uint32(23)).astype(np.int64)
        owner = np.repeat(np.arange(len(lines)), sizes)[: len(grams)]
        within = np.arange(len(grams)) + GRAM <= np.repeat(np.cumsum(sizes), sizes)[: len(grams)]
        sums.append(np.bincount((owner * CELLS + cell)[within], minlength=len(lines) * CELLS))
    return np.abs(sums[0] - sums[1]).reshape(-1, CELLS).sum(1) > 2 * GRAM * most


#: Code points of a block, bits of a number, and blocks worked on at once.
BLOCK, LANES = 64, 8192
#: Bytes of lines that are told apart at once.
TOLD = 2 << 20
#: Edits beyond which grams are counted instead, as blocks take time with the square of a line's length.
LONG = 300


def _ends(steps: np.ndarray) -> tuple[list[int], list[int]]:
    """From sorted numbers of steps: the first that goes on, and for how many steps more until another one ends."""
    until, first = np.unique(steps, return_index=True)
    return first.tolist(), np.diff(until, prepend=0).tolist()


def _apart(p: list[str], q: list[str], most: np.ndarray) -> np.ndarray:
    """Pairs that can't be within `most` edits by blocks of p's lines: of each, the least distance to any passage of q's line
    within `most` code points of its place (Myers' bit vectors, a block to a number, all blocks side by side). Blocks don't
    overlap, so the sum is no more than the distance; nor do code points that go by the same five bits add to it."""
    x, y = (np.frombuffer("".join(lines).encode("utf-32-le"), np.uint32) & np.uint32(31) for lines in (p, q))
    n, m = (np.fromiter(map(len, lines), np.int64, len(lines)) for lines in (p, q))
    blocks = -(-n // BLOCK)
    pair = np.repeat(np.arange(len(p)), blocks)
    at = (np.arange(len(pair)) - np.repeat(np.cumsum(blocks) - blocks, blocks)) * BLOCK
    begin, size = (np.cumsum(n) - n)[pair] + at, np.minimum(n[pair] - at, BLOCK)
    lo, hi = np.maximum(at - most[pair], 0), np.minimum(at + size + most[pair], m[pair])
    reach, lo = np.maximum(hi - lo, 0), np.minimum(lo, m[pair]) + (np.cumsum(m) - m)[pair]
    least = np.zeros(len(pair), np.int64)
    one, order = np.uint64(1), np.argsort(reach, kind="stable")
    for cut in range(0, len(order), LANES):
        lanes = order[cut : cut + LANES]
        row, spare = np.arange(len(lanes)) * 32, BLOCK - size[lanes]
        # Bits below a block that is shorter match anything at no cost, so the last code point is the highest bit of each.
        plus = ~np.uint64(0) << np.minimum(spare, BLOCK - 1).astype(np.uint64)
        masks = np.repeat(~plus, 32)
        for i in range(BLOCK):
            some = np.nonzero(size[lanes] > i)[0]
            masks[row[some] + x[begin[lanes[some]] + i]] |= one << (spare[some] + i).astype(np.uint64)
        minus, score, best = np.zeros(len(lanes), np.uint64), size[lanes].copy(), size[lanes].copy()
        place, steps = lo[lanes].copy(), reach[lanes]
        for live, times in zip(*_ends(steps), strict=True):  # lanes before `live` are at their end
            a, b, rows, places, now, low = plus[live:], minus[live:], row[live:], place[live:], score[live:], best[live:]
            for _ in range(times):
                eq = masks.take(rows + y.take(places))
                places += 1
                diag = (((eq & a) + a) ^ a) | eq
                down, up = a & diag, b | ~(diag | a)
                now += (down.view(np.int64) >> 63) - (up.view(np.int64) >> 63)
                np.minimum(low, now, out=low)
                up <<= one
                down <<= one
                eq |= b
                np.bitwise_and(up, eq, out=b)
                np.bitwise_or(down, ~(eq | up), out=a)
        least[lanes] = best
    return np.bincount(pair, least, minlength=len(p)) > most


#: Bits of the filter that says which lines' texts may be wanted, and the shares it is put together in.
FILTER, FILTER_SHARES = 1 << 26, 64


def _wanted(ids: DataFrame) -> np.ndarray:
    """Bits by the high bits of ids. Their number is fixed, so the driver takes 8 MB for any table; where they fill up, more
    lines go out than are wanted, which joins drop."""
    width = FILTER // FILTER_SHARES

    def bits(group: pa.Table) -> pa.Table:
        cells = np.zeros(width, bool)
        cells[group.column("cell").to_numpy()] = True
        return pa.table({"share": group.column("share")[:1], "bits": pa.array([np.packbits(cells, bitorder="little").tobytes()], pa.binary())})

    high = F.shiftrightunsigned("id", 64 - (FILTER - 1).bit_length())
    cells = ids.select((high / width).cast("int").alias("share"), (high % width).cast("int").alias("cell")).distinct()
    out = np.zeros((FILTER_SHARES, width // 8), np.uint8)
    for r in cells.groupBy("share").applyInArrow(bits, "share int, bits binary").collect():
        out[r.share] = np.frombuffer(r.bits, np.uint8)
    return out.reshape(-1)


def _similar(p: list[str], q: list[str], most: np.ndarray) -> np.ndarray:
    """Which pairs are within `most` edits. The distance is taken of those alone that no bound decides."""
    ok, long = np.zeros(len(p), bool), most > LONG
    for bound, some in ((_far, np.nonzero(long)[0]), (_apart, np.nonzero(~long)[0])):
        sure = np.array([edits_at_most(p[i], q[i], int(most[i])) <= most[i] for i in some.tolist()], bool)
        ok[some[sure]] = True
        some = some[~sure]
        if len(some):
            some = some[~bound([p[i] for i in some.tolist()], [q[i] for i in some.tolist()], most[some])]
        ok[some] = [distance_within(p[i], q[i], int(most[i])) for i in some.tolist()]
    return ok


def _maybe(spark: SparkSession, ids: DataFrame) -> Callable[[Column], Column]:
    """Whether an id may be among `ids`, by the filter of fixed size."""
    wanted = spark.sparkContext.broadcast(_wanted(ids))

    @F.arrow_udf("boolean")
    def test(ids: pa.Array) -> pa.Array:
        high = ids.to_numpy(zero_copy_only=False).view(np.uint64) >> np.uint64(64 - (FILTER - 1).bit_length())
        return pa.array((wanted.value[high >> np.uint64(3)] >> (high & np.uint64(7)).astype(np.uint8) & 1).astype(bool))

    return test


def _verify(spark: SparkSession, docs: DataFrame, text_col: str, similarity: float, keep: Written) -> tuple[Callable[[DataFrame], None], Callable[[DataFrame, Written], DataFrame]]:
    """What takes the texts of candidates, once, and what filters pairs of nodes by the edit similarity of their lines."""
    held: list[DataFrame] = []

    def take(members: DataFrame) -> None:
        wanted = spark.sparkContext.broadcast(_wanted(members))

        def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            bits, done = wanted.value, set()
            for batch in slices(batches, limit=SLICE):
                lines = list(set(_said(batch.column(0).to_pylist())[2]))
                ids = line_keys(lines)[:, 0]
                high = ids.view(np.uint64) >> np.uint64(64 - (FILTER - 1).bit_length())
                some = np.nonzero(bits[high >> np.uint64(3)] >> (high & np.uint64(7)).astype(np.uint8) & 1)[0]
                some = [i for i, k in zip(some.tolist(), ids[some].tolist(), strict=True) if k not in done]
                if len(done) > 4 * DEALT:
                    done.clear()
                done.update(ids[some].tolist())
                yield pa.RecordBatch.from_arrays([pa.array(ids[some]), pa.array([lines[i].decode("utf-8", "replace") for i in some], pa.string())], names=["id", "line"])

        held.append(keep(docs.select(F.col(text_col).alias("text")).mapInArrow(texts, "id bigint, line string").dropDuplicates(["id"]), "texts"))

    def test(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "p", TOLD):
            p, q = batch.column(2).to_pylist(), batch.column(3).to_pylist()
            most = np.array([int((1 - similarity) * max(len(x), len(y)) + 1e-9) for x, y in zip(p, q, strict=True)], np.int64)
            yield batch.select([0, 1]).filter(pa.array(_similar(p, q, most), pa.bool_()))

    def verify(pairs: DataFrame, keep: Written) -> DataFrame:
        p, q = (held[0].select(F.col("id").alias(end), F.col("line").alias(line)) for end, line in (("a", "p"), ("b", "q")))
        return pairs.join(p, "a").join(q, "b").select("a", "b", "p", "q").mapInArrow(test, "a bigint, b bigint")

    return take, verify


def duplicates(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY, keep: Written | None = None) -> DataFrame:
    """(doc, gone) of documents that lose lines: gone is their places, from 0. It is a table; those it came from are removed."""
    keep = keep or Written(spark)
    lines = keep(lines_of(docs, id_col, text_col, similarity), "lines")
    first = F.min(F.struct(F.coalesce("doc_id", F.lit(-(1 << 63))).alias("i"), "doc", "pos"))
    nodes = keep(lines.groupBy("key", "check").agg(*(F.min(c).alias(c) for c in ("n", "k0", "k1")), F.count("*").alias("copies"), first.alias("first")), "line-nodes")
    fuzzy = nodes.where(_fuzzy(F.col("n"), similarity)).select(F.col("key").alias("id"), "n", "k0", "k1")

    def near(x: str, y: str) -> Column:
        lo, hi = F.least(F.col(f"{x}n"), F.col(f"{y}n")), F.greatest(F.col(f"{x}n"), F.col(f"{y}n"))
        moved = F.lit(0).cast("bigint")
        for name in ("k0", "k1"):
            for at in range(0, 64, 8):
                a, b = (F.shiftrightunsigned(F.col(side + name), at).bitwiseAND(F.lit(255)) for side in (x, y))
                moved = moved + F.abs(a - b)
        return (lo >= hi * similarity) & (moved <= 2 * F.floor(hi * (1 - similarity) + 1e-9))

    take, verify = _verify(spark, docs, text_col, similarity, keep)
    found = links(spark, fuzzy.select("id", "n", "k0", "k1"), postings(spark, docs, id_col, text_col, similarity), near, verify, keep, take=take, match=_match_owned)
    linked = found.unionByName(found.select(F.col("component").alias("node"), "component").distinct())
    group = F.when(F.col("component").isNull(), F.struct("key", "check")).otherwise(F.struct(F.col("component").alias("key"), F.lit(0).cast("bigint").alias("check")))
    grouped = nodes.join(linked, (nodes.key == linked.node) & _fuzzy(nodes.n, similarity), "left").select("key", "check", "copies", "first", group.alias("group"))
    kept = grouped.groupBy("group").agg(F.min("first").alias("kept"), F.sum("copies").alias("n")).where("n > 1")
    repeated = grouped.join(kept, "group").select("key", "check", "kept")
    gone = lines.select("doc", "pos", "key", "check").join(repeated, ["key", "check"]).where((F.col("doc") != F.col("kept.doc")) | (F.col("pos") != F.col("kept.pos")))
    out = keep(gone.groupBy("doc").agg(F.collect_set("pos").alias("gone")), "gone")
    keep.only(out)
    return out


def dedup(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY, count: bool = False) -> DataFrame:
    """The documents without repeated lines, columns as they were; with `count`, also n_lines and n_gone."""
    gone = duplicates(spark, docs, id_col, text_col, similarity)
    wide = docs.select(*(F.col(c).alias(f"c{i}") for i, c in enumerate(docs.columns)), _doc(id_col, text_col).alias("doc"))
    text = F.col(f"c{docs.columns.index(text_col)}")

    def kept(parts: Column) -> Column:
        stay = F.array_except(F.sequence(F.lit(0).cast("bigint"), (F.size(parts) - 1).cast("bigint")), F.col("gone"))
        return F.array_join(F.transform(stay, lambda i: F.element_at(parts, (i + 1).cast("int"))), "\n")

    # The split stands in an array of one, so that the lambda sees its value and not the expression.
    without = F.transform(F.array(F.split(text, "\n", -1)), kept)[0]
    may_lose = _maybe(spark, gone.select(F.col("doc").alias("id")))(F.col("doc"))
    # Texts of documents that lose nothing aren't shuffled.
    out = wide.where(may_lose).join(gone, "doc", "left").unionByName(wide.where(~may_lose).withColumn("gone", F.lit(None).cast("array<bigint>")))
    cols = [F.when(F.col("gone").isNull(), text).otherwise(without).alias(c) if c == text_col else F.col(f"c{i}").alias(c) for i, c in enumerate(docs.columns)]
    n_lines = F.when(F.coalesce(text, F.lit("")) == "", F.lit(0)).otherwise(F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit(""))) + 1)
    more = [n_lines.cast("bigint").alias("n_lines"), F.when(F.col("gone").isNull(), F.lit(0)).otherwise(F.size("gone")).cast("bigint").alias("n_gone")] if count else []
    return out.select(*cols, *more)


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from grainmill.llm.tables import documents

    out = dedup(spark, documents(spark, sf_dir), count=True)
    return out.select("doc_id", "n_lines", "n_gone", F.length("text").cast("bigint").alias("n_chars"), F.sha2("text", 256).alias("text_sha256"))
