"""Toxicity by multiple-instance learning: a document is a bag of sentences, toxic if any sentence is.

A sentence's probability is a logistic function of its words' weights (a word, and its heads of 4 to 6 code points, hashed to
FEATURES slots); a document's is their noisy-or, 1 - prod(1 - p). Weights are learned from document labels alone,
through the noisy-or, on a bounded sample of labelled rows (SAMPLE documents of each label, in order of a hash of
doc_id), by gradient descent with an L1 proximal step. The model is FEATURES floats, whatever the data. Scoring then
also tells which sentences offend.

Null, empty and white-space texts have no sentences: their probability is the model's for a sentence without words.
Labels other than 0 and 1, null labels and null ids teach nothing; a doc_id with several labels counts as toxic if one
label says so; repeated documents are scored each. Without toxic labels (or without labels) every score is 0. An empty
table gives an empty result. Only the named columns are read."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from grainmill.llm.words import Numbering, Ragged, slices, sums_by

FEATURES = 1 << 18
SAMPLE = 3000
HEADS = (4, 5, 6)
EDGES = b".,;:!?\"'()[]{}*#$%&|-_<>"
STOPS = (b".", b"!", b"?")
REMEMBERED = 150_000


def features(word: bytes) -> list[int]:
    """Slots of a word: itself and its heads; a word of punctuation alone has none."""
    core = word.strip(EDGES)
    if not core:
        return []
    text = core.decode("utf-8", "ignore")
    names = [core, *(text[:k].encode() + b"*" for k in HEADS if len(text) >= k)]
    return [xxhash.xxh32_intdigest(x) % FEATURES for x in names]


class Bags:
    """Texts as sentences of word numbers. A sentence ends at a line end or after a word that ends in . ! or ?"""

    def __init__(self):
        self._reset()

    def _reset(self) -> None:
        self.known, self.slots = Numbering(), Ragged(np.int64)
        self.stop = np.zeros(0, bool)

    def __call__(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Word numbers of all texts, words per sentence, sentences per text (at least one, which may be empty)."""
        words, sizes, counts = [], [], []
        for text in texts:
            lines = [self.known.numbers(line.split()) for line in text.lower().encode("utf-8", "surrogatepass").split(b"\n")] if text else []
            fresh = self.known.take_fresh()
            self.slots.extend([features(w) for w in fresh])
            if fresh:
                self.stop = np.concatenate([self.stop, np.array([w.endswith(STOPS) for w in fresh], bool)])
            flat = np.concatenate(lines) if lines else np.zeros(0, np.int64)
            border = self.stop[flat]
            ends = np.cumsum([len(x) for x in lines]) if lines else np.zeros(0, np.int64)
            border[ends[ends > 0] - 1] = True
            at = np.nonzero(border)[0] + 1
            size = np.diff(at, prepend=0) if len(at) else np.zeros(1, np.int64)
            words.append(flat)
            sizes.append(size)
            counts.append(len(size))
        return (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (words, sizes, [np.array(counts, np.int64)]))

    def tidy(self) -> None:
        if len(self.known) > REMEMBERED:
            self._reset()


@dataclass
class Model:
    weights: np.ndarray
    bias: float

    def sentence_scores(self, bags: Bags, words: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        flat, lens = bags.slots.gather(words)
        per_word = sums_by(self.weights[flat].astype(np.float64), lens)
        z = self.bias + sums_by(per_word, sizes)
        return 1.0 / (1.0 + np.exp(-np.clip(z, -60, 60)))


def noisy_or(p: np.ndarray, counts: np.ndarray) -> np.ndarray:
    return 1.0 - np.exp(sums_by(np.log1p(-np.minimum(p, 1 - 1e-12)), counts))


def fit(texts: list[str | None], labels: np.ndarray, rounds: int = 200, rate: float = 0.5, l1: float = 2e-4) -> Model:
    """Minimises the mean log loss of the noisy-or over documents, clean ones weighing 0.7 in all."""
    labels = np.asarray(labels, float)
    if not labels.any():
        return Model(np.zeros(FEATURES, np.float32), -60.0)
    bags = Bags()
    words, sizes, counts = bags(texts)
    words = words.astype(np.int32)
    doc = np.repeat(np.arange(len(counts), dtype=np.int32), counts)
    sentence = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)
    n_words = len(bags.known)
    slots, lens = bags.slots.gather(np.arange(n_words))
    word_of_slot = np.repeat(np.arange(n_words, dtype=np.int32), lens)
    # A slot of a single document can only teach that document's label by heart.
    first, last = np.full(n_words, len(counts)), np.full(n_words, -1)
    np.minimum.at(first, words, doc[sentence])
    np.maximum.at(last, words, doc[sentence])
    low, high = np.full(FEATURES, len(counts)), np.full(FEATURES, -1)
    np.minimum.at(low, slots, first[word_of_slot])
    np.maximum.at(high, slots, last[word_of_slot])
    common = (low < high)[slots]
    slots, word_of_slot = slots[common], word_of_slot[common]
    used, slots = np.unique(slots, return_inverse=True)
    w, bias = np.zeros(len(used)), -8.0
    share = max(1, int(labels.sum())), max(1, int((1 - labels).sum()))
    weigh = np.where(labels > 0, 0.3 / share[0], 0.7 / share[1])
    step, step_bias = np.full(len(used), 1e-8), 1e-8
    for _ in range(rounds):
        per_word = np.bincount(word_of_slot, weights=w[slots], minlength=n_words)
        z = np.clip(bias + np.bincount(sentence, weights=per_word[words], minlength=len(sizes)), -30, 30)
        p = 1.0 / (1.0 + np.exp(-z))
        clean = np.exp(sums_by(-np.logaddexp(0, z), counts))
        pull = np.where(labels > 0, -clean / np.maximum(1 - clean, 1e-6), 1.0) * weigh
        grad_z = p * pull[doc]
        grad = np.bincount(slots, weights=np.bincount(words, weights=grad_z[sentence], minlength=n_words)[word_of_slot], minlength=len(used))
        step += grad**2
        step_bias += grad_z.sum() ** 2
        scale = rate / np.sqrt(step)
        w -= scale * grad
        w = np.sign(w) * np.maximum(np.abs(w) - scale * l1, 0)
        bias -= rate / np.sqrt(step_bias) * grad_z.sum()
    weights = np.zeros(FEATURES, np.float32)
    weights[used] = w
    return Model(weights, bias)


def held_out(doc_id: Column, folds: int = 5, fold: int = 0) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds == fold, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", folds: int = 5, fold: int = 0, sample: int = SAMPLE) -> Model:
    """Learns from labelled rows outside the held-out fold, at most `sample` documents of each label."""
    told = labels.select(F.col(id_col).cast("bigint").alias("id"), F.col(label_col).cast("int").alias("y")).where("id is not null and y in (0, 1)").groupBy("id").agg(F.max("y").alias("y"))
    told = told.where(~held_out(F.col("id"), folds, fold)).withColumn("o", F.md5(F.col("id").cast("string")))
    picked = None
    for y in (0, 1):
        side = told.where(F.col("y") == y).orderBy("o", "id").limit(sample)
        picked = side if picked is None else picked.unionByName(side)
    rows = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text")).join(F.broadcast(picked), "id").select("id", "y", "text").orderBy("id", "text").toArrow()
    return fit(rows.column("text").to_pylist(), np.array(rows.column("y").to_pylist(), float))


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score, worst_sentence, n_offending) per row: worst_sentence counts from 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bags, fitted = Bags(), held.value
        for batch in slices(batches):
            bags.tidy()
            words, sizes, counts = bags(batch.column(1).to_pylist())
            p = fitted.sentence_scores(bags, words, sizes)
            ends = np.cumsum(counts)
            worst = [int(np.argmax(p[b - n : b])) for b, n in zip(ends.tolist(), counts.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(noisy_or(p, counts)), pa.array(worst, pa.int64()), pa.array(sums_by((p >= 0.5).astype(np.int64), counts))], names=["id", "score", "worst_sentence", "n_offending"]
            )

    held = docs.sparkSession.sparkContext.broadcast(model)
    return docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text")).mapInArrow(run, "id bigint, score double, worst_sentence bigint, n_offending bigint")


def clean(docs: DataFrame, model: Model, threshold: float = 0.5, text_col: str = "text") -> DataFrame:
    """The rows of `docs` whose text scores below the threshold, columns as they are."""
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bags, fitted = Bags(), held.value
        for batch in slices(batches, f"c{at}"):
            bags.tidy()
            words, sizes, counts = bags(batch.column(at).to_pylist())
            yield batch.filter(pa.array(noisy_or(fitted.sentence_scores(bags, words, sizes), counts) < threshold))

    held = docs.sparkSession.sparkContext.broadcast(model)
    kinds = ", ".join(f"c{i} {f.dataType.simpleString()}" for i, f in enumerate(docs.schema))
    out = docs.toDF(*(f"c{i}" for i in range(len(docs.columns)))).mapInArrow(run, kinds)
    return out.toDF(*docs.columns)


def locate(docs: DataFrame, model: Model, threshold: float = 0.5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, sentence, score, words) of each offending sentence, its words joined by a space."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bags, fitted = Bags(), held.value
        for batch in slices(batches):
            bags.tidy()
            rows = []
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                words, sizes, _ = bags([text])
                raw, ends = (text or "").encode("utf-8", "surrogatepass").split(), np.cumsum(sizes)
                p = fitted.sentence_scores(bags, words, sizes)
                rows += [(i, s, float(p[s]), b" ".join(raw[ends[s] - sizes[s] : ends[s]]).decode("utf-8", "replace")) for s in np.nonzero(p >= threshold)[0].tolist()]
            cols = list(zip(*rows, strict=True)) or [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.float64(), pa.string()), strict=True)], names=["id", "sentence", "score", "words"])

    held = docs.sparkSession.sparkContext.broadcast(model)
    return docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text")).mapInArrow(run, "id bigint, sentence bigint, score double, words string")


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from grainmill.llm.tables import documents
    from grainmill.session import table

    docs = documents(spark, sf_dir)
    model = train(docs, table(spark, sf_dir, "labels"))
    return score(docs, model).select(F.col("id").alias("doc_id"), held_out(F.col("id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "worst_sentence", "n_offending")


