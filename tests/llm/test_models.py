"""LM scores, toxicity, embeddings, mixing, fingerprints, html and the pipeline."""

import hashlib
import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from grainmill.llm import embeddings, html, lm, merkle, mixing, simhash, toxicity
from grainmill.session import Written
from tests.llm.conftest import invented


# -- LM scoring ------------------------------------------------------------------------------------------------------


def brute_lm(rows):
    texts = [[*(t or "").encode().lower().split(), None] for _, t in rows]
    held = [i is not None and zlib.crc32(str(i).encode()) % 5 == 1 for i, _ in rows]
    c, c2, c3 = Counter(), Counter(), Counter()
    for t, h in zip(texts, held, strict=True):
        if not h:
            c.update(t)
            c2.update(zip([None, *t], t, strict=False))
            c3.update(zip([None, *t], t, t[1:], strict=False))
    n, v, n1, n2 = sum(c.values()), len(c), sum(x == 1 for x in c.values()), sum(x == 2 for x in c.values())
    d = min(0.95, max(0.05, n1 / (n1 + 2 * n2))) if n1 + n2 else 0.5

    def p1(w):
        return (c[w] - d) / n if c[w] else d * v / n if n else 1.0

    def p2(w, h):
        return (c2[h, w] + lm.PRIOR * p1(w)) / (c[h] + lm.PRIOR) if c[h] else p1(w)

    def p(w, g, h):
        """After h, and g before it; a text's first word follows its start alone."""
        return (c3[g, h, w] + lm.PRIOR * p2(w, h)) / (c2[g, h] + lm.PRIOR) if h is not None and c2[g, h] else p2(w, h)

    out = []
    for (i, _), t, h in zip(rows, texts, held, strict=True):
        base = sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in t)
        out.append((i, h, len(t), sum(c[w] > 0 for w in t), n, base, sum(math.log10(p(w, g, h)) for w, g, h in zip(t, [None, None, *t], [None, *t], strict=False))))
    if n:
        for context in next(iter(c2)), next(g[:2] for g in c3):
            assert abs(sum(p(w, *context) for w in c) + p("unseen", *context) - 1) < 1e-9
    return out


def same(got, want):
    got, want = (sorted(map(tuple, x), key=str) for x in (got, want))
    assert [g[:5] for g in got] == [w[:5] for w in want]
    assert np.allclose([g[5:] for g in got], [w[5:] for w in want], rtol=1e-9)


def test_lm_scores(spark, docs, empty, monkeypatch):
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    same(lm.score(spark, docs).collect(), brute_lm(rows))
    monkeypatch.setattr(lm, "CHUNK_BYTES", 3000)  # many chunks give the same scores
    same(lm.score(spark, docs).collect(), brute_lm(rows))
    assert lm.score(spark, empty).count() == 0
    lone = next(i for i in range(99) if zlib.crc32(str(i).encode()) % 5 == 1)
    only_held = spark.createDataFrame([(lone, "no training")], "doc_id bigint, text string")
    assert [r.score for r in lm.score(spark, only_held).collect()] == [0.0]


def test_lanes_are_in_their_states(monkeypatch):
    texts = [invented(i % 7, 50) + " once" * (i % 3) for i in range(30)] + [None, "", "lone", "unseen words"]
    tokens = lm.Tokens(texts)
    counts = tokens.counted(np.arange(len(texts)) % 4 > 0)
    stats = {"n": int(counts[0].sum()), "v": int((counts[0] > 0).sum()), "n1": 5, "n2": 3}
    model = lm.Automaton(tokens, counts, stats, lm.PRIOR)
    steps = []
    for lane in (1, 2, 5, 512, 10**6):
        monkeypatch.setattr(lm, "STEPS", lane)
        steps.append(model.traverse(tokens))
    assert all(np.array_equal(x, steps[-1]) for x in steps)
    assert len(lm.Automaton(lm.Tokens([]), [np.zeros(1, np.int64), *[np.zeros(0, np.int64)] * 2], stats, lm.PRIOR).traverse(lm.Tokens([]))) == 0


def test_lm_beats_its_base_on_held_out_text(spark):
    rows = [(i, invented(i % 40, 60) + " " + invented(i, 5)) for i in range(200)]
    got = lm.score(spark, spark.createDataFrame(rows, "doc_id bigint, text string")).where("held_out").agg(F.sum("score"), F.sum("base_score")).first()
    assert got[0] > 0.7 * got[1]


# -- toxicity --------------------------------------------------------------------------------------------------------


def test_toxicity_learns_and_locates(spark, empty):
    rows, labels = [], []
    for i in range(300):
        text, bad = invented(i, 60), i % 4 == 0
        if bad:
            words = text.split()
            words.insert(30, ["vilefoo", "grossbar", "nastyqux"][i // 4 % 3])
            text = " ".join(words)
        rows.append((i, text))
        labels.append((i, int(bad)))
    rows += [(900, None), (901, ""), (902, " "), (903, "vilefoo")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("score", F.lit("x"))
    told = spark.createDataFrame([*labels, (None, 1), (900, None), (5, 7)], "doc_id bigint, toxic int")
    model = toxicity.train(docs, told)
    got = {r.id: r for r in toxicity.score(docs, model).collect()}
    unseen = [i for i in range(300) if zlib.crc32(str(i).encode()) % 5 == 0]
    assert np.mean([(got[i].score >= 0.5) == (i % 4 == 0) for i in unseen]) > 0.95
    assert got[903].score > 0.5 and got[900].score == got[901].score == got[902].score < 0.5
    found = toxicity.locate(docs, model).where("id < 300").collect()
    assert found and np.mean([any(w in r.words for w in ("vilefoo", "grossbar", "nastyqux")) for r in found]) > 0.95
    assert toxicity.clean(docs, model).count() == sum(r.score < 0.5 for r in got.values())
    assert toxicity.score(empty, model).count() == 0
    silent = toxicity.train(docs, told.where("toxic = 0"))
    assert toxicity.score(docs, silent).where("score > 0.01").count() == 0
    folds = {r.doc_id: r.h for r in docs.select("doc_id", toxicity.held_out(F.col("doc_id")).alias("h")).collect()}
    assert all(h == (zlib.crc32(str(i).encode()) % 5 == 0) for i, h in folds.items())


def test_noisy_or():
    p = np.array([0.5, 0.5, 0.2])
    assert np.allclose(toxicity.noisy_or(p, np.array([2, 1])), [0.75, 0.2])


# -- embeddings ------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("block", [4096, 40])
def test_embedding_links(spark, block):
    r = np.random.default_rng(0)
    base = r.normal(size=(40, 16))
    rows = [v.tolist() for v in base] + [(v + 0.12 * r.normal(size=16)).tolist() for v in base for _ in range(3)] + [base[0].tolist()] * 5
    rows += [None, [], [0.0] * 16, [float("nan")] * 16, [None] * 16, [float("inf"), *[1.0] * 15], [1.0, 2.0], [2.0, 4.0], (base[1] * 1e-30).tolist(), (base[1] * 1e30).tolist()]
    frame = spark.createDataFrame(list(enumerate(rows)), "vec_id bigint, embedding array<double>").withColumn("key", F.lit(0)).withColumn("links", F.lit(1))
    frame = frame.unionByName(frame.where("vec_id = 1").withColumn("vec_id", F.lit(None).cast("bigint")))
    got = {x.id: (x.n_links, x.component) for x in embeddings.near_duplicates(spark, frame, block=block).collect()}
    vectors = [(i, np.array(v, float)) for i, v in enumerate(rows) if v and None not in v and np.isfinite(v).all() and any(v)] + [(None, base[1])]
    links, root = defaultdict(int), {i: i for i in range(len(rows))}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for k, (i, x) in enumerate(vectors):
        for j, y in vectors[:k]:
            if len(x) == len(y) and x @ y / (np.linalg.norm(x) * np.linalg.norm(y)) >= 0.9:
                links[i] += 1
                links[j] += 1
                if i is not None and j is not None:
                    a, b = find(i), find(j)
                    root[max(a, b)] = min(a, b)
    assert {i: n for i, (n, _) in got.items()} == {i: links[i] for i in [*range(len(rows)), None]}
    assert all(c == find(i) for i, (_, c) in got.items() if i is not None)
    assert embeddings.near_duplicates(spark, frame.limit(0)).count() == 0


def test_quantisation_bounds_hold():
    r = np.random.default_rng(3)
    x = r.normal(size=(300, 24)) * r.choice([1e-6, 1.0, 1e5], (300, 1))
    unit, q, s, e = embeddings.quantise(x)
    error = np.abs(unit @ unit.T - (s[:, None] * q) @ (s[:, None] * q).T)
    assert (error <= e[:, None] + e + e[:, None] * e).all() and np.abs(q).max() <= 127


# -- mixing ----------------------------------------------------------------------------------------------------------


def brute_targets(sizes, weights, total):
    cap = {s: 2.0 * n for s, n in sizes.items()}
    target, free, left = {}, dict(weights), total
    while free:
        level = left / sum(free.values())
        over = [s for s in free if level * free[s] > cap[s]]
        if not over:
            return target | {s: level * w for s, w in free.items()}
        for s in over:
            target[s] = cap[s]
            left -= cap[s]
            del free[s]
    return target


@pytest.mark.parametrize("slots", [1 << 17, 50])
def test_mix_reaches_its_targets(spark, docs, empty, slots):
    mixed = mixing.mix(spark, docs, slots=slots)
    sources = {r.src: r for r in mixed.sources.collect()}
    order = sorted(sources, key=lambda s: (s == "n", s))
    weights = {s: (5.0, 2.0, 1.0)[i % 3] for i, s in enumerate(order)}
    sizes = {s: r.source_size for s, r in sources.items()}
    want = brute_targets(sizes, weights, 1.5 * sum(sizes.values()))
    assert all(abs(sources[s].target - want[s]) < 1e-6 for s in order)
    rows = {r.rid: r for r in mixed.rows.collect()}
    took = {r.rid: r.taken for r in mixing.taken(mixed).collect()}
    assert all(took.get(i, 0) <= 2 * r["size"] for i, r in rows.items())
    by = Counter()
    for i, n in took.items():
        by[rows[i].src] += n
    assert all(abs(by[s] - want[s]) <= 0.5 + 1e-6 for s in order)
    slots = [r.slot for r in mixed.schedule.collect()]
    assert len(set(slots)) == len(slots)
    pieces = mixed.pieces.collect()
    seen = Counter((p.rid, p["pass"], k) for p in pieces for k in range(p.from_word, p.to_word))
    assert max(seen.values()) == 1 and max(p.to_word - p.from_word for p in pieces) <= mixed.block
    assert mixing.mix(spark, empty).rows.count() == 0


def test_mixed_documents(spark, plain):
    out = mixing.mixed_documents(spark, plain)
    assert out.columns == plain.columns
    texts = {r.doc_id: (r.text or "").split() for r in plain.collect()}
    for r in out.collect():
        words = (r.text or "").split()
        assert words == texts[r.doc_id][: len(words)] and r.n_chars == (None if r.text is None else len(r.text))
    again = sorted(map(tuple, mixing.mixed_documents(spark, plain.repartition(5)).collect()), key=str)
    assert again == sorted(map(tuple, out.collect()), key=str)


def prefix_gaps(order, shares):
    """Largest difference between slots and share of each source, over all prefixes, by counting."""
    counts, worst = Counter(), dict.fromkeys(shares, 0.0)
    for t, src in enumerate(order):
        counts[src] += 1
        worst = {s: max(w, abs(counts[s] - (t + 1) * shares[s])) for s, w in worst.items()}
    return worst


def test_every_prefix_of_the_schedule_is_near_its_targets(spark, docs, monkeypatch):
    def facts(mixed):
        sources = {r.src: r.target for r in mixed.sources.collect() if r.target}
        shares = {s: t / sum(sources.values()) for s, t in sources.items()}
        order = [r.src for r in mixed.schedule.orderBy("slot").collect()]
        return {r.src: r.gap for r in mixing.gaps(mixed).collect()}, prefix_gaps(order, shares), 2 + np.log2(len(order))

    got, want, bound = facts(mixing.mix(spark, docs, slots=4000))
    assert got.keys() == want.keys() and all(abs(got[s] - w) < 1e-6 or got[s] <= 1 for s, w in want.items())
    assert max(got.values()) <= bound
    for constant in (0.0, 0.123456):
        monkeypatch.setattr(mixing, "GOLDEN", constant)
        got, _, bound = facts(mixing.mix(spark, docs, slots=4000))
        assert max(got.values()) > bound


def test_the_mix_is_read_in_slot_order(spark, plain, monkeypatch):
    def order():
        return [r.doc_id for r in mixing.mixed_documents(spark, plain).collect()]

    mixed = mixing.mix(spark, plain)
    of = {r.rid: r.doc_id for r in mixed.rows.collect()}
    first = {}
    for p in mixed.pieces.collect():
        key = (of[p.rid], p["pass"])
        first[key] = min(first.get(key, p.slot), p.slot)
    got = order()
    assert got[: len(first)] == [i for (i, _), _ in sorted(first.items(), key=lambda kv: (kv[1], kv[0][1]))]
    monkeypatch.setattr(mixing, "GOLDEN", 0.0)
    assert order() != got


def test_mixed_documents_with_clashing_names_and_ties(spark, plain):
    names = ["size", "lo", "hi", "slot", "rid", "pass", "_row", "c0", "src", "key", "tie"]
    wide = plain.select("*", *(F.lit(k).alias(n) for k, n in enumerate(names)))
    out = mixing.mixed_documents(spark, wide)
    assert out.columns == wide.columns and {tuple(r[n] for n in names) for r in out.collect()} == {tuple(range(len(names)))}
    rows = [(1, f"w{k % 7} a b c d", "s") for k in range(40)] + [(k, "x y z", "t") for k in range(2, 30)]
    ties = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    a, b = (sorted(map(tuple, mixing.mixed_documents(spark, t).collect())) for t in (ties.coalesce(1), ties.orderBy(F.desc("text")).repartition(7)))
    assert a == b


# -- fingerprints ----------------------------------------------------------------------------------------------------


def brute_tree(text):
    """(root, distinct leaf digests), by a walk over the characters."""
    sections = []
    for k, c in enumerate(text):
        if not k or (text[k - 1] == "\n" and c != "\n"):
            sections.append([])
        said = sections[-1]
        ends = c in ".!?\n"
        if not said or (not ends and (said[-1][-1] in ".!?\n" or len(said[-1]) == 40)):
            said.append("")
        said[-1] += c
    leaves = [[f"{xxhash.xxh64_intdigest(p.encode(), 42):X}" for p in s] for s in sections]
    digests = [hashlib.sha256(",".join(s).encode()).hexdigest() for s in leaves]
    return hashlib.sha256(",".join(digests).encode()).hexdigest(), {d for s in leaves for d in s}


def dice(a, b):
    return 2 * len(a & b) / (len(a) + len(b)) if a or b else 1.0


def test_fingerprints_equal_brute_force(spark, plain):
    made = ["", "\n\n", "...Is it? Yes!! No\n\nB." + "é" * 39 + "𝒳y" + "z" * 85, "One. Two.\r\nThree\n", "a" * 40 + ".b", "a" * 41 + ".b", "x", "x"]
    rows = sorted((r.doc_id, r.text or "") for r in plain.collect())
    last = rows[-1][0]
    rows += [(last + 1 + k, t) for k, t in enumerate(made)]
    got = {r.id: r for r in merkle.edits(spark, spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert len(got) == len(rows)
    for k, (i, text) in enumerate(rows):
        after = rows[(k + 1) % len(rows)][1]
        cut = len(text) // 4
        (root, mine), (changed, edited), (_, others) = map(brute_tree, (text, text[: len(text) - cut] + after[:cut], after))
        r = got[i]
        assert (r.fingerprint, r.edited_fingerprint) == (root, changed)
        assert r.near_edited == pytest.approx(dice(mine, edited)) and r.near_next == pytest.approx(dice(mine, others))


def test_edits(spark, plain, docs, empty):
    rows = sorted(((r.doc_id, r.text or "") for r in plain.collect()))
    got = {r.id: r for r in merkle.edits(spark, plain).collect()}
    print_of = {}
    for k, (i, text) in enumerate(rows):
        after = rows[(k + 1) % len(rows)]
        cut = len(text) // 4
        edited = text[: len(text) - cut] + after[1][:cut]
        r = got[i]
        assert (r.n_chars, r.edited_sha256) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        assert (r.fingerprint == r.edited_fingerprint) == (text == edited)
        assert r.next_fingerprint == got[after[0]].fingerprint
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
        assert len(text) < 300 or " " not in text or r.near_edited > 0.5
        print_of.setdefault(text, set()).add(r.fingerprint)
    assert all(len(v) == 1 for v in print_of.values()) and len({min(v) for v in print_of.values()}) == len(print_of)
    assert merkle.edits(spark, docs).count() == docs.count()
    assert merkle.edits(spark, empty).count() == 0


def test_tree_covers_the_text_and_diff_locates_edits(spark):
    text = "First line. Second sentence!\n\nThird line without end\nFourth."
    frame = spark.createDataFrame([(text, text.replace("Third", "3rd"))], "a string, b string")
    row = frame.select(
        F.transform(merkle._pieces(F.col("a"), merkle.SECTION), lambda s: merkle._pieces(s, merkle.PARAGRAPH)).alias("parts"),
        merkle.diff(merkle.tree(F.col("a")), merkle.tree(F.col("b"))).alias("d"),
        merkle.diff(merkle.tree(F.col("a")), merkle.tree(F.col("a"))).alias("none"),
    ).first()
    assert "".join(p for s in row.parts for p in s) == text
    assert row.none == [] and {d.section for d in row.d} == {1}


# -- html ------------------------------------------------------------------------------------------------------------

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var x="<p>no</p>";</script></head><body>
<header><h2>Site</h2></header><nav><ul><li><a href=/a>Menu</a></ul></nav><div class="cookie-notice">We use cookies</div><!-- c -->
<article><header><h1>Title %d &amp; more</h1><span>by x</span></header><p>Para  one&nbsp;%d <b>bold</b> &lt;tag&gt;<p>Second<br>half %d
<div class=ad-box>Buy</div><form><input value=q><button>Go</button></form><ul><li>item %d<li>other</ul>
<div class="share">Share this</div><div class="tagline">Same on all</div><section id="comments"><p>Reader says</p></section></article><aside>Side</aside><footer>&copy; f</footer></body></html>"""


def test_main_text(spark):
    pages = [(i, f"https://h.example.org/{i}", PAGE % (i, i, i, i)) for i in range(8)]
    pages += [(50, None, PAGE % (1, 1, 1, 1)), (51, "u", None), (52, "u", ""), (53, "u", "<p>cut of <b>text &am"), (54, "u", "plain &amp; text"), (55, "u", "<<<>< <p x='"), (56, "http://one.org", "<body><div>Body only</div></body>")]
    frame = spark.createDataFrame(pages, "page_id bigint, url string, html string").withColumn("host", F.lit(1)).withColumn("text", F.lit(2)).repartition(3)
    got = {r.page_id: r.text for r in html.extract(spark, frame).collect()}
    for i in range(8):
        assert got[i] == f"Title {i} & more Para one {i} bold <tag> Second half {i} item {i} other"  # the box that is the same on all pages of the host goes
    assert got[50] == "Title 1 & more Para one 1 bold <tag> Second half 1 item 1 other Same on all"
    assert got[51] == got[52] == "" and got[53] == "cut of text &am" and got[54] == "plain & text" and got[56] == "Body only"
    assert html.extract(spark, frame.limit(0)).count() == 0


def test_joined_wrappers_give_the_same(spark, monkeypatch):
    pages = [(i, f"https://h{i % 2}.example.org/{i}", PAGE % (i, i, i, i)) for i in range(8)]
    frame = spark.createDataFrame(pages, "page_id bigint, url string, html string")
    first = sorted(map(tuple, html.extract(spark, frame).collect()))
    monkeypatch.setattr(html, "BROADCAST_BYTES", 0)
    assert sorted(map(tuple, html.extract(spark, frame).collect())) == first


def test_pages_nested_without_end():
    for tag in ("div", "b"):
        page = f"<article><p>First.</p>{f'<{tag}>' * 100_000}Deep <p>inside</p><nav>Menu</nav> here{f'</{tag}>' * 100_000}<p>Last.</p></article><div>Out</div>"
        own = html.expression(html.parse(page))
        assert html.main_text(page, html._open(html._pack(html._merge(own, html.expression(html.parse(page)))))) == "First. Deep inside here Last."
    assert html.main_text("<article>" + "<div>" * 300 + "a<div>b</div>c") == "a b c"
    for deep in (1, 190, 250, 1000):  # regions and furniture at any depth
        page = f"<nav>menu</nav>{'<div>' * deep}junk before<article><header>by line<h1>Head</h1></header><p>Body</p></article>after{'</div>' * deep}"
        own = html.expression(html.parse(page))
        assert html.main_text(page, html._merge(own, own)) == html.main_text(page) == "Head Body", deep


def test_the_wrapper_decides_inside_articles(spark):
    """An unnamed notice that a host repeats goes; a paragraph or heading that it repeats stays, and so do copies of a page."""

    def page(i, box):
        return f"<body><article><div class='box'>{box}</div><h2>Same head</h2><p>Story {i} {invented(i, 20)}</p><p>Same end</p><section>Part {i}</section></article></body>"

    rows = [(i, "http://a.org/x", page(i, "We use tracking here")) for i in range(6)]
    rows += [(10 + i, "http://b.org/x", page(1, "Said once")) for i in range(5)]  # one page, crawled five times
    rows += [(20 + i, "http://c.org/x", page(i, f"Box {i}")) for i in range(6)]
    rows += [(30, "http://d.org/x", page(0, "One page only"))]
    got = {r.page_id: r.text for r in html.extract(spark, spark.createDataFrame(rows, "page_id bigint, url string, html string").repartition(4)).collect()}
    for i, url, _ in rows:
        k = {"a": i, "b": 1, "c": i - 20, "d": 0}[url[7]]
        box = {"a": "", "b": "Said once ", "c": f"Box {k} ", "d": "One page only "}[url[7]]
        assert got[i] == f"{box}Same head Story {k} {' '.join(invented(k, 20).split())} Same end Part {k}"


def test_repeated_rows_long_pages_and_extra_columns(spark):
    long = "<article><p>" + "word " * 300_000 + "</p></article>"
    rows = [(1, "http://a.x/1", "<article>A</article>"), (1, "http://a.x/1", "<article>A</article>"), (2, None, long), (None, "http://a.x/2", None), (3, "", "")]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string").selectExpr("*", "'x' AS host", "'y' AS text", "'z' AS wrapper")
    got = sorted(map(tuple, html.extract(spark, pages).collect()), key=str)
    assert got == sorted([(1, "http://a.x/1", "A"), (1, "http://a.x/1", "A"), (2, None, ("word " * 300_000).strip()), (None, "http://a.x/2", ""), (3, "", "")], key=str)


def test_regions_without_article():
    rows = [f"<body><div class=top><a href=1>Home</a><a href=2>News</a></div><div class=body><p>Story {i} {invented(i, 30)}</p></div><div class=end>All rights</div></body>" for i in range(5)]
    wrapper = html.expression(html.parse(rows[0]))
    for r in rows[1:]:
        wrapper = html._merge(wrapper, html.expression(html.parse(r)))
    for i, r in enumerate(rows):
        assert html.main_text(r, wrapper).startswith(f"Story {i} ") and "Home" not in html.main_text(r, wrapper) and "rights" not in html.main_text(r, wrapper)


def test_alignment_finds_groups_options_and_slots():
    a, b = (html.expression(html.parse(x)) for x in ("<ul><li>a<li>b</ul><h1>t</h1>", "<ul><li>c</ul><hr><h1>t</h1>"))
    whole = html._merge(a, b)
    ul, hr, h1 = whole[2]
    assert ul[2][0][1] & html.REPEATED and ul[2][0][2][0][2] is None
    assert hr[0] == "hr" and hr[1] & html.OPTIONAL and h1[2][0][2] is not None


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["<p>", "</p>", "<div class='a b'>", "</div>", "<b>", "text ", "&amp;", "<!--", "-->", "<script>", "</script>", "<", ">", "'", '"', "<br/>", "<article>", "</article>", "<table><tr><td>", "<li>", "é"]), max_size=30).map("".join))
def test_any_markup_is_read(text):
    wrapper = html._merge(html.expression(html.parse(text)), html.expression(html.parse("<p>x</p>")))
    assert isinstance(html.main_text(text, wrapper), str)


# -- pipeline --------------------------------------------------------------------------------------------------------


def test_pipeline(spark, tmp_path):
    import corpus_pipeline
    import public_tokenizers

    from grainmill.llm import pieces

    rows = [(i, invented(i, 50), "en", f"s{i % 4}", 0) for i in range(60)]
    rows += [(100 + i, rows[i][1], "en", "s1", 0) for i in range(5)] + [(200 + i, rows[i + 30][1] + " vilefoo.", "en", "s2", 0) for i in range(20)]
    docs = spark.createDataFrame([(i, t, a, s, len(t)) for i, t, a, s, _ in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    labels = spark.createDataFrame([(r[0], 1, int(r[0] >= 200)) for r in rows], "doc_id bigint, quality int, toxic int")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    kept = [docs]
    for _, stage in corpus_pipeline.STAGES:
        kept.append(stage(spark, kept[-1], str(tmp_path)).cache())
    assert {r.doc_id for r in kept[1].collect()} == {r[0] for r in rows if r[0] < 200}
    assert all(k.columns == docs.columns for k in kept[:-1])
    assert kept[2].count() == kept[1].count() and kept[2].where("text = ''").count() == 5
    groups = {r.id: r.component for r in simhash.near_texts(spark, kept[2]).collect()}
    assert {r.doc_id for r in kept[3].collect()} == {i for i, c in groups.items() if i == c}
    back = pieces.decode(kept[5], public_tokenizers.path("piece_bpe_32k.model"))
    assert sorted(map(tuple, back.collect())) == sorted((r.doc_id, r.text) for r in kept[4].collect())
    assert sorted(map(tuple, corpus_pipeline.run(spark, str(tmp_path)).collect())) == sorted(map(tuple, kept[5].collect()))


def test_stages_take_nulls_repeats_clashes_and_empty_tables(spark, tmp_path):
    """Each stage before the last, in turn: rows with nulls in any column, repeated ids, and columns named like those inside."""
    import corpus_pipeline

    rows = [(i, invented(i, 40), "en", f"s{i % 3}") for i in range(40)]
    rows += [(None, None, None, None), (None, invented(900, 30), None, None), (7, "", "en", "s1"), (7, "another text here", "en", None), (8, "  \n\t ", None, "s2"), rows[3], rows[3], (50, "long word " * 30_000, "en", "s0")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string")
    names = ["_row", "size", "lo", "hi", "slot", "id", "component", "score", "toxic", "gone", "doc", "key"]
    wide = docs.select("*", *(F.lit(n).alias(n) for n in names))
    labels = spark.createDataFrame([(i, 1, i % 2) for i in range(40)] + [(None, None, None)], "doc_id bigint, quality int, toxic int")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    keep = Written(spark)
    for frame in (wide, wide.limit(0), wide.withColumn("n_chars", F.length("text"))):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = keep(stage(spark, frame, str(tmp_path)), "out")
            assert out.columns == frame.columns, name
            got = out.collect()
            assert all(r[n] == n for r in got for n in names) and bool(got) == bool(frame.limit(1).count()), name
