"""LM scoring by a weighted backoff automaton.

Model of order 3 over word tokens and one end token per text. A state is a context: the empty context, the start of a
text (the end token), a known word, or a seen pair of tokens that doesn't end a text. A state's arcs are its seen
n-grams with log10 P; its failure arc goes to the state of the context without its first token, with the backoff weight.
Smoothing: P1(w) = (c - D) / N for known words, the discounted mass D V / N for an unknown word (D = n1 / (n1 + 2 n2));
P(w | h) = (c(hw) + M P(w | h')) / (c(h) + M) for seen n-grams, h' being h without its first token, and the failure arc
weighs M / (c(h) + M). Each context sums to one over the known words, the end and one unknown word.

A traversal carries the state from token to token: while the state has no arc for the token it takes the failure arc, then
the arc, whose target is the next state. A chunk's tokens are traversed in many lanes at once; as a state is at most two
tokens, a lane that starts two tokens early, in the empty context, is in the right state when its own tokens begin.

Counts come from all training rows and no model is broadcast. Texts are packed once into chunks, written to the shared
folder. Each chunk asks for the n-grams it holds: sorted hashes with its own training counts, in one row per hash
range. A range adds up all chunks' counts and answers each chunk in the order of its question. So a chunk gets the part
of the automaton that its texts can reach, and builds and traverses it from left to right. Frequent words are one entry
per chunk, so no key is hot; the number of ranges follows the number of chunks, so a range's size is bounded. Words and
pairs have hashes of 64 bits. Those of triples have SPARE bits more than all chunks' triples need to be numbered, which
grows with the input: a triple then takes another's counts with a probability of at most 2 ** -SPARE, whatever the size.

Null and empty texts are one end token. Repeated rows count and are scored each. A row with a null id is not held
out, hence trained on. An empty table gives an empty result; without
training rows every word is unknown, with probability one. Only the named columns are read."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from grainmill.llm.words import Numbering, pack, steps_of, unpack, words_of
from grainmill.session import Written

#: Bytes of text in a chunk (more only for one longer text), which bounds a task's memory.
CHUNK_BYTES = 12 << 20
#: Weight of the lower order against a context's own counts.
PRIOR = 30.0
END = np.uint64(0x9E3779B97F4A7C15)
#: Bits of a triple's hash beyond those that number the triples of all chunks; a chunk holds at most 2 ** TRIPLES.
SPARE, TRIPLES = 16, 23
#: Tokens of a lane, and those before that bring it to its state.
STEPS, EARLY = 512, 2


def held_out(doc_id: int | None, folds: int = 5, fold: int = 1) -> bool:
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % folds == fold


def pair_hashes(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    x = first * np.uint64(0xBF58476D1CE4E5B9) + (second ^ (second >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    x *= np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


class Tokens:
    """A chunk's texts as numbers into its distinct words (0 is the end), and their hashes."""

    def __init__(self, texts: list[str | None]):
        known = Numbering()
        known[b""] = 0  # no word is empty
        runs = []
        for text in texts:
            runs += [known.numbers(words_of(text)), np.zeros(1, np.int64)]
        self.tokens = np.concatenate(runs) if runs else np.zeros(0, np.int64)
        self.lens = np.array([len(r) + 1 for r in runs[::2]], np.int64)
        digest = xxhash.xxh64_intdigest
        self.hashes = np.array([int(END), *(digest(w, 42) for w in known.fresh)], np.uint64)
        size, n = len(self.hashes), len(self.tokens)
        before = np.concatenate([self.tokens[-1:], self.tokens[:-1]])  # the last token is an end
        self.pair_codes, pairs = np.unique(before * size + self.tokens, return_inverse=True)
        inner = np.nonzero(before != 0)[0]  # a text's first token follows the start alone
        self.triple_codes, at = np.unique(pairs[inner - 1] * size + self.tokens[inner], return_inverse=True)
        triples = np.full(n, -1, np.int64)
        triples[inner] = at
        self.suffixes = np.zeros(len(self.triple_codes), np.int64)  # the pair that ends a triple
        self.suffixes[at] = pairs[inner]
        #: The n-gram that ends at each token, by order.
        self.grams = [self.tokens, pairs, triples]
        self.sizes = [size, len(self.pair_codes), len(self.triple_codes)]

    def counted(self, rows: np.ndarray) -> list[np.ndarray]:
        """Counts of words, pairs and triples in the texts marked by `rows`."""
        inside = np.repeat(rows, self.lens)
        return [np.bincount(g[inside & (g >= 0)], minlength=size) for g, size in zip(self.grams, self.sizes, strict=True)]

    def gram_hashes(self, bits: int) -> list[np.ndarray]:
        """Hashes of the distinct words, pairs and triples; a triple's has its high `bits` only."""
        size = self.sizes[0]
        pairs = pair_hashes(self.hashes[self.pair_codes // size], self.hashes[self.pair_codes % size])
        triples = pair_hashes(pairs[self.triple_codes // size], self.hashes[self.triple_codes % size])
        low = np.uint64(64 - bits)
        return [self.hashes, pairs, triples >> low << low]


class Automaton:
    """The states and arcs that a chunk can reach. A state is an n-gram's number and order, 0 being the empty context; the
    arc of a state of order k with a token is the n-gram of order k + 1 that they make."""

    def __init__(self, tokens: Tokens, counts: list[np.ndarray], stats: dict[str, float], prior: float):
        n, v, n1, n2 = (stats[k] for k in ("n", "v", "n1", "n2"))
        discount = min(0.95, max(0.05, n1 / (n1 + 2 * n2))) if n1 + n2 else 0.5
        words, pairs, triples = counts
        size = tokens.sizes[0]
        last = [np.arange(size), tokens.pair_codes % size, tokens.triple_codes % size]
        p1 = np.where(words > 0, (words - discount) / max(n, 1), discount * v / n if n else 1.0)
        p2 = (pairs + prior * p1[last[1]]) / (words[tokens.pair_codes // size] + prior)
        p3 = (triples + prior * p2[tokens.suffixes]) / (pairs[tokens.triple_codes // size] + prior)
        self.seen = [c > 0 for c in counts]
        self.weights = [np.log10(p) for p in (p1, p2, p3)]
        self.fails = [np.log10(prior / (c + prior)) for c in (words, pairs)]
        #: Orders of the states that arcs lead to: the longest seen context, and the start after an end.
        self.targets = [np.where(seen, np.where(w == 0, 1, min(k, 2)), 0).astype(np.int8) for k, seen, w in zip((1, 2, 3), self.seen, last, strict=True)]

    def traverse(self, tokens: Tokens) -> np.ndarray:
        """log10 probability of each token."""
        grams, n = tokens.grams, len(tokens.tokens)
        out = np.zeros(n)
        begin = np.arange(0, n, STEPS)
        states = np.zeros(len(begin), np.int8)  # orders; the n-gram is the one that ends at the last token
        states[begin < EARLY] = self.targets[0][0]
        for step in range(-EARLY, STEPS):
            at = begin + step
            live = np.nonzero((at >= 0) & (at < n))[0]
            at, state = at[live], states[live]
            total = np.zeros(len(at))
            for k in (2, 1):
                here = np.nonzero(state == k)[0]
                here = here[~self.seen[k][grams[k][at[here]]]]
                total[here] += self.fails[k - 1][grams[k - 1][at[here] - 1]]
                state[here] = k - 1
            after = np.zeros(len(at), np.int8)
            for k in range(3):
                here = np.nonzero(state == k)[0]
                arc = grams[k][at[here]]
                total[here] += self.weights[k][arc]
                after[here] = self.targets[k][arc]
            states[live] = after
            if step >= 0:
                out[at] = total
        return out


def _chunks(docs: DataFrame) -> DataFrame:
    """(chunk, data): documents packed in the order of their scan."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, n, held, size = TaskContext.get().partitionId(), 0, [], 0

        def done() -> pa.RecordBatch:
            data = pa.Table.from_batches(held).combine_chunks()
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, data.schema) as out:
                out.write_table(data)
            blob = zstandard.ZstdCompressor(level=3).compress(sink.getvalue())
            return pa.RecordBatch.from_arrays([pa.array([(part << 32) | n], pa.int64()), pa.array([blob], pa.large_binary())], names=["chunk", "data"])

        for batch in batches:
            at = 0
            for i, b in enumerate(pc.fill_null(pc.binary_length(batch.column(1)), 0).to_pylist()):
                if size and size + b > CHUNK_BYTES:
                    held.append(batch.slice(at, i - at))
                    yield done()
                    held, size, at, n = [], 0, i, n + 1
                size += b + 16
            held.append(batch.slice(at))
        if size:
            yield done()

    return docs.mapInArrow(run, "chunk bigint, data binary")


def _open(blob: bytes) -> tuple[list, list]:
    data = pa.ipc.open_stream(zstandard.ZstdDecompressor().decompress(blob)).read_all()
    return data.column(0).to_pylist(), data.column(1).to_pylist()


def score(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", folds: int = 5, fold: int = 1, prior: float = PRIOR) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) per row; training rows are those whose
    crc32(id as text) mod folds is not `fold`."""
    keep = Written(spark)
    chunks = keep(_chunks(docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))), "chunks", "none")
    n_chunks = chunks.count()
    bits = max(5, int(np.ceil(np.log2(max(n_chunks, 1)))))
    wide = min(64, bits + TRIPLES + SPARE)

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk, blob in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids, texts = _open(blob.as_py())
                tokens = Tokens(texts)
                train = np.array([not held_out(i, folds, fold) for i in ids], bool)
                sides = []
                for h, c in zip(tokens.gram_hashes(wide), tokens.counted(train), strict=True):
                    order = np.argsort(h, kind="stable")
                    h, c = h[order], c[order].astype(np.uint32)
                    sides.append((h, c, np.searchsorted(h >> np.uint64(64 - bits), np.arange((1 << bits) + 1))))
                for p in range(1 << bits):
                    blobs = []
                    for h, c, cuts in sides:
                        blobs += [steps_of(h[cuts[p] : cuts[p + 1]]), c[cuts[p] : cuts[p + 1]]]
                    yield pa.RecordBatch.from_arrays([pa.array([p], pa.int32()), pa.array([chunk], pa.int64()), pa.array([pack(*blobs)], pa.binary())], names=["p", "chunk", "asked"])

    def answer(group: pa.Table) -> pa.Table:
        p = group.column("p")[0].as_py()
        chunk_ids = group.column("chunk").to_pylist()
        asked = [unpack(b.as_py()) for b in group.column("asked")]
        out: list[list[np.ndarray]] = [[] for _ in chunk_ids]
        stats = {}
        for side in (0, 2, 4):
            h = np.concatenate([np.cumsum(a[side], dtype=np.uint64) for a in asked])
            c = np.concatenate([a[side + 1] for a in asked])
            distinct, where = np.unique(h, return_inverse=True)
            total = np.bincount(where, weights=c, minlength=len(distinct)).astype(np.int64)
            if not side:
                stats = {"n": int(total.sum()), "v": int((total > 0).sum()), "n1": int((total == 1).sum()), "n2": int((total == 2).sum())}
            answers = total[where].astype(np.uint32) if total.max(initial=0) < 1 << 32 else total[where].astype(np.uint64)
            at = 0
            for i, a in enumerate(asked):
                out[i].append(answers[at : at + len(a[side])])
                at += len(a[side])
        rows = {"p": [p] * len(out), "chunk": chunk_ids, "counts": [pack(*o) for o in out]}
        first = [True] + [False] * (len(out) - 1)  # the range's share of the totals, once
        rows |= {k: [v if f else 0 for f in first] for k, v in stats.items()}
        return pa.table({k: pa.array(v, pa.binary() if k == "counts" else pa.int32() if k == "p" else pa.int64()) for k, v in rows.items()})

    asked = chunks.mapInArrow(ask, "p int, chunk bigint, asked binary")
    answers = keep(asked.groupBy("p").applyInArrow(answer, "p int, chunk bigint, counts binary, n bigint, v bigint, n1 bigint, n2 bigint"), "counts", "none")
    stats = {k: float(x or 0) for k, x in answers.agg(*(F.sum(k).alias(k) for k in ("n", "v", "n1", "n2"))).first().asDict().items()}

    def run(chunk: pa.Table, found: pa.Table) -> pa.Table:
        rows = []
        for blob in chunk.column("data"):
            ids, texts = _open(blob.as_py())
            tokens = Tokens(texts)
            order = np.argsort(np.array(found.column("p").to_pylist(), np.int64))
            parts = [unpack(found.column("counts")[i].as_py()) for i in order.tolist()]
            counts = []
            for side, h in enumerate(tokens.gram_hashes(wide)):
                back = np.zeros(len(h), np.int64)
                back[np.argsort(h, kind="stable")] = np.concatenate([p[side] for p in parts])
                counts.append(back)
            steps = Automaton(tokens, counts, stats, prior).traverse(tokens)
            c = counts[0][tokens.tokens]
            base = np.log10((c + 0.5) / (stats["n"] + 0.5 * (stats["v"] + 1)))
            at = np.cumsum(tokens.lens) - tokens.lens
            sums = [np.add.reduceat(x, at) if len(at) else x for x in (base, steps, (c > 0).astype(np.int64))]
            rows += zip(ids, [held_out(i, folds, fold) for i in ids], tokens.lens.tolist(), sums[2].tolist(), [int(stats["n"])] * len(ids), sums[0].tolist(), sums[1].tolist(), strict=True)
        kinds = {"doc_id": pa.int64(), "held_out": pa.bool_(), "n_tokens": pa.int64(), "n_known": pa.int64(), "train_tokens": pa.int64(), "base_score": pa.float64(), "score": pa.float64()}
        cols = list(zip(*rows, strict=True)) or [[]] * len(kinds)
        return pa.table({k: pa.array(c, t) for (k, t), c in zip(kinds.items(), cols, strict=True)})

    schema = "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double"
    return chunks.groupBy("chunk").cogroup(answers.select("chunk", "p", "counts").groupBy("chunk")).applyInArrow(run, schema)


def op3_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    from grainmill.llm.tables import documents

    return score(spark, documents(spark, sf_dir))
