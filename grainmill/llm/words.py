"""Words of a text and tables of distinct words, shared by the text operators.

A word is a run of bytes other than space and 0x09-0x0D, which is what bytes.split() yields."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard

#: Texts handed to numpy at once: bounds a Python worker's memory whatever the Arrow batch holds.
SLICE_BYTES = 4 << 20


def words_of(text: str | None) -> list[bytes]:
    """A-Z in lower case, all else as it is; a null text has no words."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


class Numbering(dict):
    """Numbers words in order of first sight; `fresh` holds those not yet looked after by the owner."""

    def __init__(self):
        super().__init__()
        self.fresh: list[bytes] = []

    def __missing__(self, word: bytes) -> int:
        n = self[word] = len(self)
        self.fresh.append(word)
        return n

    def numbers(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.int64, len(words))

    def take_fresh(self) -> list[bytes]:
        out, self.fresh = self.fresh, []
        return out


class Ragged:
    """Growing list of integer runs; `gather` concatenates the runs of many numbers at once."""

    def __init__(self, dtype):
        self.data = np.zeros(1024, dtype)
        self.ends = np.zeros(257, np.int64)
        self.n = 0

    def extend(self, runs: list) -> None:
        lens = np.fromiter(map(len, runs), np.int64, len(runs))
        self._append(np.fromiter((x for r in runs for x in r), self.data.dtype, int(lens.sum())), lens)

    def add(self, flat: np.ndarray, lens: np.ndarray) -> None:
        """Runs end to end, and their lengths."""
        self._append(flat, np.asarray(lens, np.int64))

    def extend_arrays(self, runs: list[np.ndarray]) -> None:
        if runs:
            self._append(np.concatenate(runs), np.fromiter(map(len, runs), np.int64, len(runs)))

    def _append(self, flat: np.ndarray, lens: np.ndarray) -> None:
        end, start = self.n + len(lens), int(self.ends[self.n])
        if end + 1 > len(self.ends):
            self.ends = np.concatenate([self.ends, np.zeros(max(len(self.ends), len(lens) + 1), np.int64)])
        if start + len(flat) > len(self.data):
            self.data = np.concatenate([self.data, np.zeros(max(len(self.data), len(flat)), self.data.dtype)])
        self.data[start : start + len(flat)] = flat
        self.ends[self.n + 1 : end + 1] = start + np.cumsum(lens)
        self.n = end

    def gather(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The runs of these numbers end to end, and their lengths."""
        starts = self.ends[numbers]
        lens = self.ends[numbers + 1] - starts
        total = int(lens.sum())
        before = np.cumsum(lens) - lens
        return self.data[np.repeat(starts - before, lens) + np.arange(total)], lens


def release() -> None:
    """Hands freed memory back to the system, as a Python worker lives on and would hold it while other work runs."""
    gc.collect()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def slices(batches: Iterator[pa.RecordBatch], text: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cuts batches so that each slice holds about `limit` bytes of text, or one row if that is longer."""
    for batch in batches:
        column = batch.column(batch.schema.get_field_index(text))
        lens = pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)
        start, held = 0, 0
        for i, n in enumerate(lens.tolist()):
            if held and held + n > limit:
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += n + 64
        if start < len(lens):
            yield batch.slice(start)
    release()


def sums_by(values: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """Sums of consecutive runs of these lengths; an empty run sums to 0."""
    total = np.concatenate([[0], np.cumsum(values)])
    ends = np.cumsum(lens)
    return total[ends] - total[ends - lens]


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays in one compressed blob, byte by byte of their values, so that high bytes that hardly vary cost nothing."""
    body = b"".join(np.int64(len(a)).tobytes() + a.dtype.str.encode().ljust(4) + a.view(np.uint8).reshape(len(a), a.itemsize).T.tobytes() for a in arrays)
    return zstandard.ZstdCompressor(level=1).compress(body)


def unpack(blob: bytes) -> list[np.ndarray]:
    body, at, out = zstandard.ZstdDecompressor().decompress(blob), 0, []
    while at < len(body):
        n = int(np.frombuffer(body, np.int64, 1, at)[0])
        kind = np.dtype(body[at + 8 : at + 12].decode().strip())
        size = n * kind.itemsize
        out.append(np.frombuffer(body, np.uint8, size, at + 12).reshape(kind.itemsize, n).T.copy().reshape(-1).view(kind))
        at += 12 + size
    return out


def steps_of(sorted_hashes: np.ndarray) -> np.ndarray:
    """Sorted values as differences, whose high bytes compress to nothing."""
    return np.diff(sorted_hashes, prepend=np.uint64(0))
