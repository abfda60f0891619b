"""Wavelet trees and exact top-k search against brute force."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from grainmill.llm import retrieval, wavelet

UP = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(UP))


def brute(rows, items, k, k1=20, b=50):
    held = [(i, Counter(terms(t))) for i, t in rows if terms(t)]
    n_docs, tokens = len(held), sum(sum(c.values()) for _, c in held)
    df = Counter(w for _, c in held for w in c)
    weight = {w: math.floor(1000 * math.log((2 * n_docs + 2) / (2 * d + 1))) for w, d in df.items()}
    out = []
    for item, text in items:
        scored = []
        for i, c in held:
            m = 100 - b + (b * sum(c.values()) * n_docs) // tokens
            score = sum(weight[w] * ((1_000_000_000 * c[w]) // (1000 * c[w] + k1 * m)) for w in set(terms(text)) if w in c)
            if score > 0:
                scored.append((-score, i is None, i or 0))
        out += [(item, rank, None if none else i, -s) for rank, (s, none, i) in enumerate(sorted(scored)[:k], 1)]
    return sorted(out, key=str)


def found(frame):
    return sorted(((r["item"], r["rank"], r["id"], r["score"]) for r in frame.collect()), key=str)


@settings(max_examples=40, deadline=None)
@given(st.integers(1, 70), st.integers(1, 12), st.integers(1, 6), st.integers(0, 10**6))
def test_tree_search_equals_scoring_all(n_docs, n_terms, k, seed):
    r = np.random.default_rng(seed)
    lists, lo, at = [], [], 0
    table = np.zeros((n_terms, n_docs), np.int64)
    for t in range(n_terms):
        docs = np.nonzero(r.random(n_docs) < r.random())[0]
        table[t, docs] = r.integers(1, 5, len(docs))  # many ties
        order = docs[np.lexsort((docs, -table[t, docs]))]
        lists.append(order)
        lo.append(at)
        at += len(order)
    lo, hi = np.array(lo), np.array([*lo[1:], at])
    docs = np.concatenate(lists).astype(np.int64)
    impacts = np.concatenate([table[t, x] for t, x in enumerate(lists)])
    tree = wavelet.Tree(wavelet.build(docs, impacts, n_docs))
    key = r.permutation(n_docs)
    query, weight = np.repeat(np.arange(40), n_terms), r.integers(0, 4, 40 * n_terms)
    old, wavelet.OPENED = wavelet.OPENED, 2
    try:
        got = wavelet.search(tree, query, weight, np.tile(lo, 40), np.tile(hi, 40), key, k)
    finally:
        wavelet.OPENED = old
    have = sorted(zip(*(x.tolist() for x in got), strict=True))
    want = []
    for q in range(40):
        score = weight[query == q] @ table
        best = sorted((-s, key[d], d) for d, s in enumerate(score) if s > 0)[:k]
        want += [(q, -s, d) for s, _, d in best]
    assert have == sorted(want)


@pytest.mark.parametrize("options", [{}, {"postings": 400}])
@pytest.mark.parametrize("k", [3, 50])
def test_search_equals_brute_force(spark, docs, options, k):
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    r = random.Random(1)
    items = [(i, " ".join(r.choices((t or "x").split(), k=12))) for i, (_, t) in enumerate(rows) if (t or "").strip()]
    items += [(900, None), (901, ""), (902, "qqqq zzzz"), (3, "Changed! CHANGED"), (None, "tail one two"), (903, rows[3][1])]
    queries = spark.createDataFrame([(*x, "clash") for x in items], "item_id bigint, text string, query string")
    index = retrieval.build(spark, docs, **options)
    assert (index.shards > 2) == bool(options)
    assert found(retrieval.search(spark, index, queries, k=k, block=7)) == brute(rows, items, k)


def test_ties_repeats_and_other_parameters(spark):
    rows = [(i, "same words here") for i in range(300)] + [(5, "same words here"), (None, "same words here"), (7, "odd other text")]
    items = [(1, "words"), (2, "odd words")]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5)
    index = retrieval.build(spark, frame, postings=100, k1=12, b=75)
    assert found(retrieval.search(spark, index, spark.createDataFrame(items, "item_id bigint, text string"), k=290)) == brute(rows, items, 290, 12, 75)


def test_index_is_kept_and_holds_every_posting(spark, docs, tmp_path):
    index = retrieval.build(spark, docs, path=f"file://{tmp_path}/index", postings=1000)
    again = retrieval.Index.open(spark, index.path)
    assert (again.documents, again.tokens, again.shards) == (index.documents, index.tokens, index.shards)
    df = {r["term"]: r["n"] for r in again.lexicon().groupBy("term").agg(F.sum(F.col("hi") - F.col("lo")).alias("n")).collect()}
    assert df == Counter(w for r in docs.select("text").collect() for w in set(terms(r.text)))
    assert 1 < again.trees().count() <= again.shards  # a shard may get no document


def test_empty_tables(spark, docs, empty):
    some = spark.createDataFrame([(1, "one two")], "item_id bigint, text string")
    assert retrieval.search(spark, retrieval.build(spark, empty), some).count() == 0
    assert retrieval.search(spark, retrieval.build(spark, docs), some.limit(0)).count() == 0
