"""Simple-8b word-aligned coding of id sequences, all steps vectorised.

A 64-bit word holds a 4-bit selector (top) and 60 bits of payload: as many ids as fit, each in the same number of bits.
Selectors 0 and 1 stand for 240 and 120 zeros. An id of 60 bits or more is an escape: a word of selector 15 (whose
payload counts 1) is followed by the id in a word of its own. Ids are packed greedily in blocks of BLOCK ids; no word
spans two blocks, and a block table gives each block's first word, so any block decodes alone.

File: magic | words (uint64 LE) of all blocks | tables (block word offsets u64, block id counts u32, doc ids i64, doc id
nulls u8, doc token counts u64) | lengths (u64: words, blocks, docs, ids) | magic."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np

BLOCK = 4096
MAGIC = b"S8BTOKS1"
TAIL = struct.Struct("<4Q8s")
# Fixed values of the format: ids per word and bits per id, by selector.
COUNTS = np.array([240, 120, 60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1], np.int64)
BITS = np.array([0, 0, 1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60], np.int64)
ESCAPE = 15
ESCAPED = np.uint64((15 << 60) | ((1 << 60) - 1))
LIMIT = 1 << 60


def _widths(ids: np.ndarray) -> np.ndarray:
    """Bits that each id needs, 61 for an escape (its value in the payload would read as the escape mark)."""
    edges = np.array([1 << b for b in (0, 1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30)], np.uint64)
    width = np.array([0, 1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60], np.uint8)[np.searchsorted(edges, ids, side="right")]
    width[ids >= np.uint64(LIMIT - 1)] = 61
    return width


def _window_max(x: np.ndarray, size: int, known: dict[int, np.ndarray]) -> np.ndarray:
    """Largest of x[i:i+size], by doubling; x is padded so that windows past a block's end never fit."""
    half = 1
    while half * 2 <= size:
        if half * 2 not in known:
            known[half * 2] = np.maximum(known[half][: len(known[half]) - half], known[half][half:])
        half *= 2
    top = known[half]
    n = len(x) - size + 1
    return np.maximum(top[:n], top[size - half : size - half + n]) if size > half else top[:n]


def encode(ids: np.ndarray, block: int = BLOCK) -> tuple[np.ndarray, np.ndarray]:
    """Words, and the words of each block of `block` ids."""
    ids = np.ascontiguousarray(ids, np.uint64)
    if not len(ids):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    blocks = -(-len(ids) // block)
    width = _widths(ids)
    # Each block is followed by a border that no window may cover.
    pad = int(COUNTS[0])
    grid = np.full((blocks, block + pad), 99, np.uint8)
    flat = np.full(blocks * block, 99, np.uint8)
    flat[: len(ids)] = width
    grid[:, :block] = flat.reshape(blocks, block)
    line = grid.ravel()
    best = np.full(len(line), ESCAPE, np.uint8)
    known = {1: line}
    for s in range(ESCAPE - 1, -1, -1):
        top = _window_max(line, int(COUNTS[s]), known)
        best[: len(top)][top <= BITS[s]] = s
    # All blocks are walked in step, a word at a time; the walk only follows jumps worked out above.
    at = np.arange(blocks) * (block + pad)
    lens = np.full(blocks, block)
    lens[-1] = len(ids) - (blocks - 1) * block
    ends = at + lens
    live = np.arange(blocks)
    spots, owners = [], []
    while len(live):
        spots.append(at[live])
        owners.append(live)
        at[live] += COUNTS[best[at[live]]]
        live = live[at[live] < ends[live]]
    spot, owner = np.concatenate(spots), np.concatenate(owners)
    order = np.argsort(spot, kind="stable")
    spot, owner = spot[order], owner[order]
    selector = best[spot]
    source = spot - owner * pad  # place in ids
    escaped = width[source] == 61
    size = 1 + escaped.astype(np.int64)
    place = np.cumsum(size) - size
    words = np.zeros(int(size.sum()), np.uint64)
    for s in np.unique(selector):
        mine = np.nonzero(selector == s)[0]
        word = np.full(len(mine), int(s) << 60, np.uint64)
        if BITS[s]:
            for k in range(int(COUNTS[s])):
                word |= ids[source[mine] + k] << np.uint64(k * int(BITS[s])) if s != ESCAPE else np.where(escaped[mine], np.uint64(0), ids[source[mine]])
        words[place[mine]] = word
    words[place[escaped]] = ESCAPED
    words[place[escaped] + 1] = ids[source[escaped]]
    return words, np.bincount(owner, weights=size, minlength=blocks).astype(np.int64)


def decode(words: np.ndarray) -> np.ndarray:
    """All ids of whole blocks."""
    words = np.asarray(words, np.uint64)
    if not len(words):
        return np.zeros(0, np.uint64)
    raw = np.zeros(len(words), bool)
    marks = np.nonzero(words == ESCAPED)[0]
    if len(marks):  # a word after a mark is an id, even if it looks like a mark
        last = -2
        for m in marks.tolist():
            if m != last + 1 or not raw[m]:
                raw[m + 1] = True
            last = m
        marks = marks[~raw[marks]]
    selector = (words >> np.uint64(60)).astype(np.int64)
    count = COUNTS[selector]
    count[raw] = 0
    place = np.cumsum(count) - count
    out = np.zeros(int(count.sum()), np.uint64)
    for s in np.unique(selector[~raw]):
        bits = int(BITS[s])
        if not bits:
            continue
        mine = np.nonzero((selector == s) & ~raw)[0]
        mask = np.uint64((1 << bits) - 1)
        for k in range(int(COUNTS[s])):
            out[place[mine] + k] = (words[mine] >> np.uint64(k * bits)) & mask
    if len(marks):
        out[place[marks]] = words[marks + 1]
    return out


class Writer:
    """Appends documents in order; ids are held until a run of blocks is full, the tables until `close`."""

    RUN = BLOCK * 64

    def __init__(self, out):
        self.out, self.ids, self.held = out, [], 0
        self.words, self.block_words, self.block_ids = 0, [], []
        self.doc_ids: list[int | None] = []
        self.doc_tokens: list[int] = []
        out.write(MAGIC)

    def add(self, doc_ids: list[int | None], counts: np.ndarray, ids: np.ndarray) -> None:
        self.doc_ids += doc_ids
        self.doc_tokens += counts.tolist()
        self.ids.append(ids)
        self.held += len(ids)
        if self.held >= self.RUN:
            self._flush(False)

    def _flush(self, rest: bool) -> None:
        ids = np.concatenate(self.ids) if self.ids else np.zeros(0, np.uint64)
        cut = len(ids) if rest else len(ids) // BLOCK * BLOCK
        words, sizes = encode(ids[:cut])
        self.out.write(words.astype("<u8").tobytes())
        starts = self.words + np.cumsum(sizes) - sizes
        self.block_words += starts.tolist()
        self.block_ids += [min(BLOCK, cut - i) for i in range(0, cut, BLOCK)]
        self.words += len(words)
        self.ids, self.held = [ids[cut:]], len(ids) - cut

    def close(self) -> int:
        self._flush(True)
        total = int(sum(self.block_ids))
        self.out.write(np.array(self.block_words, "<u8").tobytes())
        self.out.write(np.array(self.block_ids, "<u4").tobytes())
        self.out.write(np.array([x or 0 for x in self.doc_ids], "<i8").tobytes())
        self.out.write(np.array([x is None for x in self.doc_ids], "u1").tobytes())
        self.out.write(np.array(self.doc_tokens, "<u8").tobytes())
        self.out.write(TAIL.pack(self.words, len(self.block_ids), len(self.doc_ids), total, MAGIC))
        return total


class Reader:
    """Reads an open, seekable file; blocks are read and decoded in runs."""

    def __init__(self, file, size: int):
        self.file = file
        file.seek(size - TAIL.size)
        self.n_words, blocks, docs, self.n_ids, magic = TAIL.unpack(file.read(TAIL.size))
        if magic != MAGIC:
            raise ValueError("not a token file")
        file.seek(8 + 8 * self.n_words)
        self.block_words = np.frombuffer(file.read(8 * blocks), "<u8").astype(np.int64)
        self.block_ids = np.frombuffer(file.read(4 * blocks), "<u4").astype(np.int64)
        ids = np.frombuffer(file.read(8 * docs), "<i8")
        nulls = np.frombuffer(file.read(docs), "u1")
        self.doc_ids = [None if gone else x for x, gone in zip(ids.tolist(), nulls.tolist(), strict=True)]
        self.doc_tokens = np.frombuffer(file.read(8 * docs), "<u8").astype(np.int64)

    def blocks(self, first: int, last: int) -> np.ndarray:
        """Ids of blocks first..last-1."""
        if first >= last:
            return np.zeros(0, np.uint64)
        begin = int(self.block_words[first])
        end = int(self.block_words[last]) if last < len(self.block_words) else self.n_words
        self.file.seek(8 + 8 * begin)
        return decode(np.frombuffer(self.file.read(8 * (end - begin)), "<u8"))

    def documents(self, run: int = 256) -> Iterator[tuple[int | None, np.ndarray]]:
        held, block = np.zeros(0, np.uint64), 0
        at = 0
        for doc_id, n in zip(self.doc_ids, self.doc_tokens.tolist(), strict=True):
            while len(held) - at < n:
                more = self.blocks(block, min(block + run, len(self.block_words)))
                block += run
                held, at = np.concatenate([held[at:], more]), 0
            yield doc_id, held[at : at + n]
            at += n
