"""Simple-8b, token files, pieces: round trips and the libraries' own ids."""

import io
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from grainmill.llm import pieces, simple8b, token_files

WORD_BPE, PIECES = (public_tokenizers.path(n) for n in ("word_bpe_49k.json", "piece_bpe_32k.model"))


@settings(max_examples=150, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 3), st.integers(0, 50_000), st.integers(0, 2**64 - 1), st.sampled_from([int(simple8b.ESCAPED), 2**60 - 1, 2**60 - 2])), max_size=400), st.sampled_from([1, 7, 240, 4096]))
def test_simple8b_round_trip(ids, block):
    ids = np.array(ids, np.uint64)
    words, sizes = simple8b.encode(ids, block)
    assert (simple8b.decode(words) == ids).all() and sizes.sum() == len(words)
    at = 0
    for k, n in enumerate(sizes.tolist()):  # each block decodes alone
        assert (simple8b.decode(words[at : at + n]) == ids[k * block : (k + 1) * block]).all()
        at += n


def test_zero_runs_are_short():
    assert len(simple8b.encode(np.zeros(480, np.uint64))[0]) == 2


def test_file_round_trip_and_bad_file():
    r = np.random.default_rng(0)
    docs = [(None if i % 5 == 0 else i, r.integers(0, 49408, r.integers(0, 900)).astype(np.uint64)) for i in range(700)]
    file = io.BytesIO()
    writer = simple8b.Writer(file)
    for i, ids in docs:
        writer.add([i], np.array([len(ids)]), ids)
    assert writer.close() == sum(len(x) for _, x in docs)
    got = list(simple8b.Reader(file, file.getbuffer().nbytes).documents(2))
    assert [i for i, _ in got] == [i for i, _ in docs] and all((a == b).all() for (_, a), (_, b) in zip(got, docs, strict=True))
    with pytest.raises(ValueError):
        simple8b.Reader(io.BytesIO(b"0" * 100), 100)


def test_token_files_match_the_library(spark, docs, empty):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(WORD_BPE)
    rows = sorted(docs.select("doc_id", "text").collect(), key=lambda r: (r.doc_id is not None, r.doc_id or 0, r.text is not None, r.text or ""))
    want, start = [], 0
    for r in rows:
        ids = np.array(library.encode(r.text or "", add_special_tokens=False).ids + [1], "<u4")
        want.append((r.doc_id, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    manifest = token_files.write_tokens(spark, docs, WORD_BPE)
    got = token_files.read_tokens(spark, manifest, digest=True).collect()
    assert sorted(map(tuple, got), key=lambda r: r[1]) == want
    whole = token_files.read_tokens(spark, manifest).orderBy("start").collect()
    assert [len(r.ids) for r in whole] == [w[2] for w in want] and whole[0].ids[-1] == 1
    assert token_files.read_tokens(spark, token_files.write_tokens(spark, empty, WORD_BPE)).count() == 0


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from([*"aZéÉßİΣς ıﬁ.,'!?\n\t\r\x0b\x1c 12٣<|>-_", "'s", "<|endoftext|>", "<|ENDOFTEXT|>", "the. ", "a, ", "日本", "\U0001f600", "é", "‍"]), max_size=30).map("".join))
def test_chunk_encoder(text):
    encoder = token_files.encoder_of(WORD_BPE)
    ids, counts = encoder([text, None])
    assert ids.tolist() == [*encoder.tokenizer.encode(text, add_special_tokens=False).ids, 1, 1] and counts.tolist() == [len(ids) - 1, 1]


def test_a_capital_and_a_combining_mark_encode_as_the_library_does():
    encoder = token_files.encoder_of(WORD_BPE)
    for text in ["Y\u030a", "J\u030c x", "aH\u0331B.", "T\u0308, W\u030a.", "E\u0301A plain. Où", "\u0130 I\u0307.", "A\u0327\u030a"]:
        ids, _ = encoder([text])
        assert ids.tolist() == [*encoder.tokenizer.encode(text, add_special_tokens=False).ids, 1], text


ALPHABET = [*"aAbZéß .,'!?\n\t 12日<>-_▁", "<s>", "the ", " and", "ation", "  ", "\U0001f600", "[UNK]"]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(ALPHABET), max_size=40).map("".join), st.sampled_from([0.0, 0.3, 1.0]))
def test_pieces_decode_losslessly(text, rate):
    import sentencepiece

    encoder = pieces._encoder(PIECES, rate, 7)
    ids, _ = encoder([3], [text])
    assert b"".join(encoder.model.values[i] for i in ids.tolist())[1:].decode() == text
    if not rate and "▁" not in text:
        assert ids.tolist() == sentencepiece.SentencePieceProcessor(model_file=PIECES).encode(text)
    again, _ = pieces.PieceEncoder(PIECES, rate, 7)([3], [text])
    assert again.tolist() == ids.tolist()


def by_hand(encoder, word: str, key: int, limit: int) -> list[int]:
    """Merge-dropout of one word in plain strings, pair by pair."""
    model = encoder.model
    parts = [("own" if c == "▁" else c.replace(" ", "▁"), i) for i, c in enumerate(word)]
    skipped = set()
    while True:
        best = None
        for (a, i), (b, _) in zip(parts, parts[1:], strict=False):
            rank = None if "own" in (a, b) else model.rank.get(a + b)
            if rank is not None and (i, a + b) not in skipped and (best is None or rank < best[0]):
                best = rank, i, a + b
        if not best:
            break
        rank, i, both = best
        h = ((rank * 0x9E3779B1) ^ (i * 0x85EBCA77) ^ key) % 2**32
        h = (h ^ h >> 15) * 0x2C1B3C6D % 2**32
        if h ^ h >> 13 < limit:
            skipped.add((i, both))
            continue
        k = next(k for k, (_, at) in enumerate(parts) if at == i)
        parts[k : k + 2] = [(both, i)]
    out = []
    for p, i in parts:
        out += [model.ids[p]] if p in model.ids and p != "own" else [model.bytes[b] for b in word[i].encode()]
    return out


def test_merged_arrays_equal_merges_by_hand():
    import random

    encoder, r = pieces.PieceEncoder(PIECES, 0.3, 1), random.Random(0)
    words = ["".join(r.choices(ALPHABET, k=r.choice([1, 3, 7, 20, 47, 48, 49, 90]))).replace("\n", "") or "x" for _ in range(300)]
    words += [" international", " thereafter", "a", "▁▁", " ", "中文字", "😀😀", "aaaaaaaaaaaa"] * 20
    symbols, lens = encoder.model.symbols(words)
    keys = np.array([r.getrandbits(32) for _ in words], np.uint32)
    for limit in (0, 1 << 30, 1 << 32):
        ids, counts, *_ = encoder.model.merged(symbols, lens, keys, limit)
        got = [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])]
        assert got == [by_hand(encoder, w, k, limit) for w, k in zip(words, keys.tolist(), strict=True)]


def test_dropout_varies_and_everything_merges_without(spark, docs, empty):
    plain = pieces.encode(docs, PIECES, rate=0.0).collect()
    cut = pieces.encode(docs, PIECES, rate=0.2).collect()
    assert sum(len(r.ids or ()) for r in cut) > sum(len(r.ids or ()) for r in plain)
    encoder = pieces.PieceEncoder(PIECES, 0.3, 1)
    ids, counts = encoder([1], ["international " * 200])
    assert len({tuple(x) for x in np.split(ids, np.nonzero(ids == ids[0])[0])}) > 2
    back = pieces.decode(pieces.encode(docs, PIECES), PIECES)
    want = sorted(((r.doc_id, r.text) for r in docs.collect()), key=str)
    assert sorted(map(tuple, back.collect()), key=str) == want
    got = pieces.digests(pieces.encode(docs, PIECES), PIECES)
    assert got.where("text_sha256 is null").count() == docs.where("text is null").count()
    assert pieces.encode(empty, PIECES).count() == 0


def test_each_occurrence_draws_its_own_segmentation():
    import xxhash

    text = "the international thereafter the " * 400 + "international" * 30
    encoder = pieces.PieceEncoder(PIECES, 0.1, 42)
    ids, _ = encoder([5], [text])
    words, at, seen = pieces.WORD.findall(" " + text), 0, set()
    for k, word in enumerate(words):  # as merged alone, under the key of the occurrence
        draw = (k * 0x9E3779B97F4A7C15 + xxhash.xxh64_intdigest("42:5")) % 2**64
        draw = (draw ^ draw >> 30) * 0xBF58476D1CE4E5B9 % 2**64
        draw = (draw ^ draw >> 27) * 0x94D049BB133111EB % 2**64
        want = encoder.model.segment(word, draw >> 32, int(0.1 * 2**32))
        assert ids[at : at + len(want)].tolist() == want
        at += len(want)
        seen.add((word, tuple(want)))
    assert at == len(ids) and len({s for w, s in seen if w == " the"}) > 2 and len({s for w, s in seen if w == " international"}) > 4


def test_marks_after_letters_are_cut_off_as_by_a_plain_reading():
    """A stop or comma after a-z and before white space or the end; the pattern looks for the mark first."""
    import random

    from grainmill.llm.token_files import STOP

    r = random.Random(1)
    for _ in range(3000):
        raw = "".join(r.choice("ab.,. \n\té1A") for _ in range(r.randrange(30))).encode()
        want = b""
        for i in range(len(raw)):
            cut = raw[i] in b".," and i > 0 and 97 <= raw[i - 1] <= 122 and (i + 1 == len(raw) or raw[i + 1] in b" \t\n\x0b\x0c\r")
            want += (b" " if cut else b"") + raw[i : i + 1]
        assert STOP.sub(rb" \1", raw) == want
    assert STOP.pattern.startswith(b"([.,])")
