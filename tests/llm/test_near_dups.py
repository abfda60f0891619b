"""SimHash near-dedup, line dedup and components against brute force."""

from collections import Counter
from itertools import combinations

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from grainmill.llm import components, lines, simhash


def union(ids, pairs):
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def brute_fingerprint(text):
    words = (text or "").encode().lower().split()
    grams = [b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    h = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0


@pytest.mark.parametrize("single", [components.SINGLE, 0])
def test_components_match_union_find(spark, monkeypatch, single):
    monkeypatch.setattr(components, "SINGLE", single)
    r = np.random.default_rng(0)
    pairs = [tuple(map(int, p)) for p in r.integers(0, 300, (220, 2))] + [(i, i + 1) for i in range(1000, 1060)] + [(5, 5)]
    got = {x.node: x.component for x in components.components(spark, spark.createDataFrame(pairs, "a bigint, b bigint").repartition(5)).collect()}
    want = union({x for p in pairs for x in p}, pairs)
    linked = {x for a, b in pairs if a != b for x in (a, b)}
    assert {x: got.get(x, x) for x in linked} == {x: want[x] for x in linked}
    assert components.components(spark, spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def test_fingerprints_and_components(spark, docs):
    rows = [r for r in docs.select("doc_id", "text").collect()]
    got = sorted(((r.id, r.fp & (2**64 - 1), r.component) for r in simhash.near_duplicates(spark, docs).collect()), key=str)
    prints = [(r.doc_id, brute_fingerprint(r.text)) for r in rows]
    distinct = sorted({p for _, p in prints})
    groups = union(distinct, [(a, b) for a, b in combinations(distinct, 2) if bin(a ^ b).count("1") <= 4])
    least = {}
    for i, p in prints:
        if i is not None:
            least[groups[p]] = min(i, least.get(groups[p], i))
    assert got == sorted(((i, p, least.get(groups[p])) for i, p in prints), key=str)


def test_close_fingerprints_all_link(spark):
    r = np.random.default_rng(1)
    centres = r.integers(0, 2**63, 30)
    prints = [int(c) for c in centres]
    for c in centres:
        for _ in range(12):
            flips = r.choice(64, r.integers(0, 6), replace=False)
            x = int(c)
            for f in flips:
                x ^= 1 << int(f)
            prints.append(x - 2**64 if x >= 2**63 else x)
    prints = sorted(set(prints))
    frame = spark.createDataFrame(list(enumerate(prints)), "id bigint, fp bigint")
    got = {x.fp: x.component for x in simhash.hamming_components(spark, frame).collect()}
    mask = 2**64 - 1
    want = union(range(len(prints)), [(i, j) for i, j in combinations(range(len(prints)), 2) if bin((prints[i] ^ prints[j]) & mask).count("1") <= 4])
    assert got == {p: want[i] for i, p in enumerate(prints)}


def test_near_texts_by_shingle_similarity(spark, plain, empty):
    got = {r.id: r.component for r in simhash.near_texts(spark, plain).collect()}
    rows = {r.doc_id: (r.text or "").encode().lower().split() for r in plain.collect()}

    def grams(w):
        return {b" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()

    sets = {i: grams(w) for i, w in rows.items()}
    linked = [(a, b) for a, b in combinations(rows, 2) if rows[a] == rows[b] or (sets[a] or sets[b]) and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    assert got == union(rows, linked)
    assert len(set(got.values())) < len(got)
    assert simhash.near_texts(spark, empty).count() == simhash.near_duplicates(spark, empty).count() == 0


@settings(max_examples=200, deadline=None)
@given(st.text("abc", max_size=12), st.text("abc", max_size=12), st.integers(0, 8))
def test_edit_distance(a, b, most):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        last, row[0] = row[:], i + 1
        for j, y in enumerate(b):
            row[j + 1] = min(last[j] + (x != y), last[j + 1] + 1, row[j] + 1)
    assert lines.distance_within(a, b, most) == (row[-1] <= most)


def said(line: str) -> str:
    """A line in normal form, character by character."""
    return " ".join("".join("0" if c in "0123456789" else " " if c in "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~\t\x0b\x0c\r" else c for c in line.lower()).replace(" ", "\n").split("\n")).strip(" ")


def similar(a: str, b: str) -> bool:
    """Edit similarity >= 0.9 by a full table; pairs that differ in too many letter pairs are told apart first."""
    most = int(0.1 * max(len(a), len(b)) + 1e-9)
    p, q = (Counter(zip(x, x[1:], strict=False)) for x in (a, b))
    if abs(len(a) - len(b)) > most or sum((p - q).values()) > 2 * most or sum((q - p).values()) > 2 * most:
        return False
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        diag, row[0] = row[0], i + 1
        for k, y in enumerate(b, 1):
            diag, row[k] = row[k], min(row[k] + 1, row[k - 1] + 1, diag + (x != y))
    return row[-1] <= most


def brute_lines(rows):
    """Kept texts by doc order, from pairs of all lines by edit similarity alone."""
    occ = []
    for k, (i, text) in enumerate(rows):
        for pos, line in enumerate(text.split("\n") if text else []):
            if words := said(line).split(" "):
                if name := " ".join(w for w in words if w):
                    occ.append((k, i, pos, name))
    names = sorted({o[3] for o in occ})
    pairs = [(a, b) for a, b in combinations(names, 2) if similar(a, b)]
    group = union(names, pairs)
    first = {}
    for k, i, pos, n in sorted(occ, key=lambda o: (o[1], o[0], o[2])):
        first.setdefault(group[n], (k, pos))
    gone = {(k, pos) for k, _, pos, n in occ if first[group[n]] != (k, pos)}
    return [(i, None if t is None else "\n".join(x for pos, x in enumerate(t.split("\n")) if (k, pos) not in gone)) for k, (i, t) in enumerate(rows)], pairs


@settings(max_examples=200, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text("ab1,. \n\x0b\x1cé日²", max_size=60)), max_size=6))
def test_line_facts_match_a_plain_reading(texts):
    text, pos, keys, n, marks, _ = lines.line_facts(texts, 0.9)
    want = [(t, p, b" ".join(line.split())) for t, x in enumerate(texts) for p, line in enumerate(lines.normalise(x).split(b"\n") if x else []) if line.split()]
    assert list(zip(text, pos, strict=True)) == [w[:2] for w in want]
    assert n.tolist() == [len(w[2].decode()) for w in want]
    names, keys = [w[2] for w in want], keys.tolist()
    assert all((keys[i] == keys[j]) == (names[i] == names[j]) for i in range(len(names)) for j in range(i))
    alone = [lines.line_facts([x.decode()], 0.9) for x in names]
    assert [a[2][0].tolist() for a in alone] == keys and [a[4][0] for a in alone] == marks


def test_lines_that_differ_in_letters_of_other_scripts_stay_apart(spark):
    rows = [(1, "вода"), (2, "года"), (3, "habló"), (4, "hablò"), (5, "x²"), (6, "x³"), (7, "Вода!"), (8, "год1"), (9, "год2")]
    got = {r.doc_id: r.text for r in lines.dedup(spark, spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert {k for k, t in got.items() if t} == {1, 2, 3, 4, 5, 6, 8}


def test_a_changed_letter_in_lines_of_any_length_is_a_candidate():
    """Of invented lines of 5 to 50 words and a copy with one edit, 95 of 100 at least share a mark."""
    import random

    from tests.llm.conftest import invented

    r = random.Random(3)
    for n_words in (5, 10, 20, 50):
        met = 0
        for k in range(200):
            line = said(invented(7000 + k, n_words))
            at = r.randrange(len(line))
            other = line[:at] + r.choice(["", "q", line[at] + "q"]) + line[at + 1 :]
            a, b = lines.line_facts([line, other], 0.9)[4]
            met += bool({a[i : i + 5] for i in range(0, len(a), 5)} & {b[i : i + 5] for i in range(0, len(b), 5)})
        assert met >= 190, (n_words, met)


def test_line_dedup_matches_all_pairs(spark):
    from tests.llm.conftest import invented

    long = invented(7, 60)
    near = long.replace(long.split()[20], long.split()[20] + "s", 1)
    rows = [(1, "same line here\n" + long), (2, "Same line, here!\nother\n\nother"), (3, near + "\nonly this"), (4, None), (5, ""), (6, "same  LINE here"), (7, long.upper()), (8, "12 34 apples\n\n"), (9, "56 78 apples"), (30, "вода течёт\nгода текут\nВода, течёт")]
    rows += [(10 + k, invented(200 + k % 5, 30) + "\n" + invented(k, 12)) for k in range(10)]
    for k in range(6):
        words = invented(300 + k, 80).split()
        rows += [(40 + 2 * k, " ".join(words)), (41 + 2 * k, " ".join([*words[:50], words[50] + "s", *words[51:]]))]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)
    frame = frame.withColumn("key", F.lit(1)).withColumn("gone", F.lit("x"))
    want, pairs = brute_lines(rows)
    got = lines.dedup(spark, frame)
    assert got.columns == frame.columns
    assert sorted((r.doc_id, r.text) for r in got.collect()) == sorted(want)
    assert pairs, "the fixture holds a near line"


def test_line_dedup_edge_cases(spark, docs, empty):
    out = lines.dedup(spark, docs, count=True)
    assert out.count() == docs.count()
    assert lines.dedup(spark, empty).count() == 0


def test_posting_lists_stream_in_runs_of_any_size(monkeypatch):
    import pyarrow as pa

    from grainmill.llm.words import pack, steps_of

    r = np.random.default_rng(0)
    keys, nodes = r.integers(-20, 200, 900), np.arange(900)
    keys[r.integers(0, 900, 200)] = 7  # one long list
    blobs = []
    for part in np.array_split(np.arange(900), 23):
        order = part[np.argsort(keys[part].view(np.uint64), kind="stable")]
        blobs.append(pack(steps_of(keys[order].view(np.uint64)), nodes[order]))
    batches = [pa.RecordBatch.from_arrays([pa.array([0] * len(b), pa.int32()), pa.array(b, pa.binary())], names=["part", "data"]) for b in (blobs[:9], blobs[9:])]
    counts = {k: int((keys == k).sum()) for k in set(keys.tolist())}
    want = sorted((k, n) for k, n in zip(keys.tolist(), nodes.tolist(), strict=True) if counts[k] > 1)
    for run in (1, 50, 10_000):
        monkeypatch.setattr(simhash, "MATCHED", run)
        got = [x for b in simhash._match(iter(batches)) for x in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)]
        assert sorted(got) == want


def test_line_dedup_finds_all_pairs_by_edit_similarity(spark):
    """Brute force by edit similarity alone, on lines of all lengths with a changed word, spread letters or a lost end."""
    import random

    from tests.llm.conftest import invented

    r, rows = random.Random(5), []
    for k in range(150):
        line = lines.normalise(invented(1000 + k, r.choice([1, 2, 3, 5, 8, 12, 20, 40, 80]))).decode().replace(" ", "" if k % 10 == 9 else " ")
        words = line.split()
        some = list(line)
        for at in r.sample(range(len(line)), max(1, len(line) // 60 if len(line) > 60 else len(line) // 12)):
            some[at] = "x"
        changed = [*words[: len(words) // 2], "zu" + words[len(words) // 2][2:] + "q", *words[len(words) // 2 + 1 :]]
        rows += [(3 * k, line), (3 * k + 1, "".join(some)), (3 * k + 2, " ".join(changed) if k % 2 else line[: len(line) - len(line) // 12])]
    names = sorted({" ".join(t.split()) for _, t in rows})
    pairs = [(a, b) for a, b in combinations(names, 2) if lines.distance_within(a, b, int(0.1 * max(len(a), len(b)) + 1e-9))]
    group, first = union(names, pairs), {}
    for i, t in rows:
        first.setdefault(group[" ".join(t.split())], i)
    got = {x.doc_id for x in lines.dedup(spark, spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)).where("text != ''").collect()}
    assert len(pairs) > 250 and got == set(first.values())


def test_near_texts_finds_contiguous_edits(spark):
    """Cut and replaced passages at a similarity of 0.8 or little more, all of them."""
    from tests.llm.conftest import invented

    rows, linked = [], []
    for k in range(60):
        words = invented(2000 + k, 60 + 7 * k).split()
        n = len(words)
        other = [words[: n - n // 6], words[: n - n // 12] + invented(5000 + k, n // 12).split(), words[n // 6 :]][k % 3]
        rows += [(2 * k, " ".join(words)), (2 * k + 1, " ".join(other))]
        p, q = ({tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in ([x.lower() for x in words], [x.lower() for x in other]))
        linked += [2 * k] if len(p & q) >= 0.8 * len(p | q) else []
    got = {r.id: r.component for r in simhash.near_texts(spark, spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)).collect()}
    assert len(linked) >= 50
    assert [i for i in linked if got[i] != got[i + 1]] == [] and len(set(got.values())) == 120 - len(linked)


def left_over(spark) -> set[str]:
    import os

    from grainmill.session import shared_dir

    top = shared_dir(spark).removeprefix("file://") + "/grainmill"
    return set(os.listdir(top)) if os.path.isdir(top) else set()


def test_stages_remove_what_they_have_read(spark):
    """Of line dedup and the near-dedup stage only the tables stay that their results read, and no shuffle files of others."""
    import corpus_pipeline

    from tests.llm.conftest import invented

    rows = [(k, invented(k % 40, 60) + (f" zu{k}" if k % 3 else "") + "\n" + invented(100 + k, 30)) for k in range(120)]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)
    for stage, most in ((corpus_pipeline.without_repeated_lines, {"gone"}), (corpus_pipeline.without_near_copies, {"rows", "gone", "groups"})):
        before = left_over(spark)
        out = stage(spark, frame, "")
        assert {name.split("-", 1)[1] for name in left_over(spark) - before} <= most, stage
        assert 0 < out.where("text != ''").count() <= 120


def test_near_dedup_stage_links_by_simhash_first(spark, monkeypatch):
    """The byte-position index over fingerprints finds texts within 4 bits, pairs that fail the shingle test are dropped, and
    the prefix index gets its groups."""
    import corpus_pipeline

    from tests.llm.conftest import invented

    rows = []
    for k in range(20):
        words = invented(3000 + k, 400).split()
        rows += [(2 * k, " ".join(words)), (2 * k + 1, " ".join([*words[:200], "zu" + words[200], *words[201:]]))]
    chant = "one two three four five " * 200  # its repeats, of an odd number, settle the fingerprint, whatever comes after it
    rows += [(100, chant + invented(1, 20)), (101, chant + invented(2, 20))]
    calls, real = [], simhash.links

    def spied(spark, nodes, *more, known=None, **named):
        out = real(spark, nodes, *more, known=known, **named)
        calls.append((nodes.columns, known is not None, {(r.node, r.component) for r in out.collect()}))
        return out

    monkeypatch.setattr(simhash, "links", spied)
    got = {r.doc_id for r in corpus_pipeline.without_near_copies(spark, spark.createDataFrame(rows, "doc_id bigint, text string").coalesce(1), "").collect()}
    fps = {r.id: r.fp & (2**64 - 1) for r in simhash.fingerprints(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    close = [k for k in range(20) if (fps[2 * k] ^ fps[2 * k + 1]).bit_count() <= 4]
    assert (fps[100] ^ fps[101]).bit_count() <= 4 and len(close) > 10
    assert [c[:2] for c in calls] == [(["id", "n", "fp"], False), (["id", "n"], True)]
    assert len(calls[0][2]) == len(close) and calls[0][2] <= calls[1][2]
    assert got == {2 * k for k in range(20)} | {100, 101}


def test_line_pairs_are_told_apart_by_bounds_first():
    """One alignment never takes fewer edits than the distance, and pairs whose grams are too far apart aren't similar. Both
    decide some pairs, so that the distance is taken of the others alone."""
    import random

    from tests.llm.conftest import invented

    r, pairs = random.Random(2), []
    for k in range(600):
        a = invented(k % 90, r.choice([1, 3, 10, 40, 120])).lower()
        b = list(a if k % 4 else invented(k + 1000, 40).lower())
        for _ in range(r.randrange(len(b) // (6 if k % 2 else 30) + 2)):
            at = r.randrange(len(b) + 1)
            b[at : at + r.choice([0, 1, 1, 9])] = r.choice(["", "é水", "𝄞", "a"])
        pairs.append((a, "".join(b)))
    pairs += [("", ""), ("", "a"), ("a" * 100, "a" * 91), ("long passage " * 40, "long passage " * 20 + "put in, of no use " + "long passage " * 20)]
    most = np.array([int(0.1 * max(len(a), len(b)) + 1e-9) for a, b in pairs])
    within = [lines.distance_within(a, b, m) for (a, b), m in zip(pairs, most.tolist(), strict=True)]
    sure = [lines.edits_at_most(a, b, m) <= m for (a, b), m in zip(pairs, most.tolist(), strict=True)]
    far = lines._far([a for a, _ in pairs], [b for _, b in pairs], most).tolist()
    assert not any(s and not w for s, w in zip(sure, within, strict=True))
    assert not any(f and w for f, w in zip(far, within, strict=True))
    assert sum(sure) > 0.5 * sum(within) > 50 and sum(far) > 50


def test_parts_that_are_only_asked_for_make_no_lists(monkeypatch):
    """Two lines of 60 code points that hold a part of a shorter line at its place don't meet under it unless a line has it;
    with one, they do. The same holds however few postings are held at once, but for lists that need not be there."""
    import pyarrow as pa

    from grainmill.llm.words import pack, steps_of

    def met(key, asks, node):
        key = np.array(key, np.uint64) << np.uint64(1) | np.array(asks, np.uint64)
        order = np.argsort(key, kind="stable")
        blob = pack(steps_of(key[order]), np.array(node)[order])
        out = lines._match_owned(iter([pa.RecordBatch.from_arrays([pa.array([0], pa.int32()), pa.array([blob], pa.binary())], names=["part", "data"])]))
        return sorted(x for b in out for x in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True))

    key, asks, node = [5, 5, 6, 6, 6, 7, 8, 8], [1, 1, 1, 0, 1, 0, 0, 0], [1, 2, 1, 3, 2, 1, 1, 4]
    assert met(key, asks, node) == [(6, 1), (6, 2), (6, 3), (8, 1), (8, 4)]
    assert met([], [], []) == []
    monkeypatch.setattr(lines, "HELD", 1)
    assert met(key, asks, node) == [(5, 1), (5, 2), (6, 1), (6, 2), (6, 3), (8, 1), (8, 4)]


def test_line_texts_are_taken_by_a_filter_of_fixed_size(spark):
    """All ids that are asked for are in, negative ones too, and others hardly."""
    ids = [-1, 0, 1 << 62, -(1 << 63), 12345678901234567]
    bits = lines._wanted(spark.createDataFrame([(i,) for i in ids * 2], "id bigint"))
    high = np.array(ids).view(np.uint64) >> np.uint64(38)
    assert len(bits) == lines.FILTER // 8 and int(np.unpackbits(bits).sum()) == len(set(high.tolist()))
    assert all(int(bits[h >> 3]) >> (h & 7) & 1 for h in high.tolist())


def test_texts_are_told_apart_by_tallies_of_shingles_first(spark, monkeypatch):
    """No link fails the test by tallies, most other pairs of a size do, and texts that share a rare passage alone, so that the
    prefix index makes them candidates, are never read for their shingle sets."""
    import pyarrow as pa

    from tests.llm.conftest import invented

    texts = [invented(k, 300).split() for k in range(40)]
    pairs = [(a, a[:at] + invented(500 + at, 12).split() + a[at + 12 :]) for a in texts for at in (5, 100)] + [(a, b) for a, b in combinations(texts[:20], 2)]
    pairs += [(["a"], ["a"]), ([], []), (["b"] * 3, ["a"]), (texts[0], texts[0][:245])]
    sets = [[simhash._shingle_hashes(" ".join(x), 5) for x in p] for p in pairs]
    cols = [[i for i in range(len(sets))], [-i for i in range(len(sets))], [simhash.tally(p) for p, _ in sets], [len(p) for p, _ in sets], [simhash.tally(q) for _, q in sets], [len(q) for _, q in sets]]
    batch = pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=list("abpmqn"))
    stay = {i for b in simhash._may_link(0.8)(iter([batch])) for i in b.column(0).to_pylist()}
    linked = {i for i, (p, q) in enumerate(sets) if len(np.intersect1d(p, q)) >= 0.8 * len(np.union1d(p, q))}
    assert len(linked) > 80 and linked <= stay and len(stay - linked) < 0.1 * (len(sets) - len(linked))

    passage = invented(9000, 30)
    rows = [(k, invented(9100 + k, 150) + " " + passage + " " + invented(9200 + k, 150)) for k in range(12)] + [(20, invented(9100, 150) + " " + passage + " " + invented(9200, 150) + " more")]
    asked, real = [], simhash.Written.__call__

    def spied(self, df, name, codec="zstd"):
        out = real(self, df, name, codec)
        asked.extend(out.collect() if name == "likely" else [])
        return out

    monkeypatch.setattr(simhash.Written, "__call__", spied)
    got = {r.id: r.component for r in simhash.near_texts(spark, spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)).collect()}
    assert got == {k: k for k in range(12)} | {20: 0}
    assert {(r.a, r.b) for r in asked} == {(20, 0)}


def test_line_pairs_are_told_apart_by_their_blocks():
    """Blocks never add up to more than the distance, whatever the lengths and scripts, and decide most pairs of near lines that
    are just too far apart; the verdict is that of the distance."""
    import random

    from tests.llm.conftest import invented

    r, pairs = random.Random(4), []
    for k in range(400):
        words = invented(4000 + k, r.choice([1, 4, 12, 40, 90])).lower().split()
        other = [w if r.random() > (0.07 if k % 3 else 0.2) else r.choice(["é水", "zuqo", "gehtu ka", "", "𝄞"]) for w in words]
        if k % 5 == 0:
            other = [*words[len(words) // 4 :], *other[: len(words) // 4]]
        pairs.append((" ".join(words), " ".join(other)))
    pairs += [("", ""), ("", "a"), ("a", ""), ("a" * 64, "a" * 64), ("a" * 65, "b" * 65), ("ab" * 64, "ba" * 64), ("x" * 4000, "x" * 3600), ("x" * 4000, "x" * 3599)]
    p, q = ([x[k] for x in pairs] for k in (0, 1))
    most = np.array([int(0.1 * max(len(a), len(b)) + 1e-9) for a, b in pairs])
    within = np.array([lines.distance_within(a, b, m) for a, b, m in zip(p, q, most.tolist(), strict=True)])
    apart = lines._apart(p, q, most)
    assert not (apart & within).any() and apart.sum() > 0.7 * (~within).sum() > 50
    assert (lines._similar(p, q, most) == within).all()
    assert len(lines._similar([], [], np.zeros(0, np.int64))) == 0


def test_a_pair_under_many_keys_is_looked_at_once(spark, monkeypatch):
    """Twelve nodes that meet under twelve keys, of which the even ones are linked first: the 51 pairs across groups come out of
    the join once each, not twelve times, and none is missing."""
    from grainmill.llm.words import pack, steps_of
    from grainmill.session import Written

    nodes = Written(spark)(spark.createDataFrame([(i, 1) for i in range(12)], "id bigint, n bigint"), "nodes")
    blob = pack(steps_of(np.repeat(np.arange(12), 12).astype(np.uint64)), np.tile(np.arange(12), 12))
    dealt = spark.createDataFrame([(0, bytearray(blob))], "part int, data binary")
    kind, made, asked = type(nodes), [], []
    real = kind.distinct

    def spied(self):
        if self.columns == ["a", "b"]:
            made.append(self.count())
        return real(self)

    def verify(pairs, keep):
        asked.append({(r.a, r.b) for r in pairs.collect()})
        return pairs.where("b = 0 and a % 2 = 0") if len(asked) == 1 else pairs

    monkeypatch.setattr(kind, "distinct", spied)
    found = {r.node: r.component for r in simhash.links(spark, nodes, dealt, lambda x, y: F.lit(True), verify).collect()}
    assert asked[1] == {(a, b) for a in range(12) for b in range(a) if a % 2 or b % 2}
    assert 51 in made and 51 * 12 not in made
    assert {found.get(i, i) for i in range(12)} == {0}
