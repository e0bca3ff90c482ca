"""Words of whole texts, inside tasks."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash

#: Bytes other than 0-9, a-z and those of non-ASCII characters become spaces.
PLAIN = bytes(b if chr(b).isdigit() or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))


def plain_words(text: bytes) -> list[bytes]:
    """Words `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+` after lower-casing A-Z."""
    return text.lower().translate(PLAIN).split()


def spaced_words(text: bytes) -> list[bytes]:
    """Words `[^\\x20\\x09-\\x0D]+` after lower-casing A-Z: bytes.lower and bytes.split know ASCII only."""
    return text.lower().split()


class Memo(dict):
    """What `make` gives for a word, remembered for up to `most` words."""

    def __init__(self, make: Callable[[bytes], object], most: int = 200_000):
        super().__init__()
        self.make, self.most = make, most

    def __missing__(self, word: bytes) -> object:
        if len(self) >= self.most:
            self.clear()
        value = self[word] = self.make(word)
        return value


def as_bytes(column: pa.Array) -> list[bytes]:
    """A string column's texts in UTF-8, null as empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


_MIX = np.uint64(0xD6E8FEB86659FD93)
_MUL = [np.uint64(m) for m in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB)]
_draw = np.random.default_rng(20).integers
#: A random number for each byte, 0 for white space; A-Z have those of a-z.
_BYTE = _draw(1, 1 << 64, 256, dtype=np.uint64)
_BYTE[0x41:0x5B] = _BYTE[0x61:0x7B]
_BYTE[[0x20, *range(0x09, 0x0E)]] = 0
_IN_WORD = _BYTE != 0
#: A random odd number for each place in a word; places repeat, with a step, after so many.
_PLACES = 1 << 16
_PLACE = _draw(0, 1 << 64, _PLACES, dtype=np.uint64) | np.uint64(1)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * _MIX
    h = (h ^ (h >> np.uint64(29))) * _MIX
    return h ^ (h >> np.uint64(32))


def binary(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a column of texts one after the other, and where each text begins and the last one ends; null as empty."""
    column = column.cast(pa.large_binary()).fill_null(b"")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(column.buffers()[2] or b"", np.uint8), offsets


def _hashes(data: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of texts that begin at `begins` in data, and where the words begin."""
    inside = _IN_WORD[data]
    new = inside.copy()
    new[1:] &= ~inside[:-1]
    here = begins[begins < len(data)]
    new[here] = inside[here]
    starts = np.flatnonzero(new)
    if not len(starts):
        return np.empty(0, np.uint64), starts
    long = np.diff(np.append(starts, len(data)))
    place = np.arange(starts[0], len(data)) - np.repeat(starts, long)
    by_place = _PLACE[place] if long.max() <= _PLACES else _PLACE[place % _PLACES] + (place // _PLACES).astype(np.uint64) * _MUL[0]
    return _mixed(np.add.reduceat(_BYTE[data[starts[0] :]] * by_place, starts - starts[0])), starts


def _pieces(data: np.ndarray, lo: int, hi: int, slab: int) -> Iterator[tuple[int, int]]:
    """Runs of about `slab` bytes of the text from lo to hi, cut between words."""
    while lo < hi:
        end = min(hi, lo + slab)
        while end < hi and _IN_WORD[data[end]]:
            gap = np.flatnonzero(~_IN_WORD[data[end : min(hi, end + slab)]])
            end = end + int(gap[0]) if len(gap) else min(hi, end + slab)
        yield lo, end
        lo = end


def word_hashes(column: pa.Array, slab: int = 1 << 17) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Hashes of the words `[^\\x20\\x09-\\x0D]+`, A-Z as a-z, of a run of texts, and where each text's begin and the last one's end.

    Whole texts of about `slab` bytes together are hashed at a time; longer ones, piece by piece.
    """
    data, offsets = binary(column)
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + slab, side="right")) - 1)
        if j == i + 1:
            parts = [_hashes(data[lo:hi], np.zeros(1, np.int64))[0] for lo, hi in _pieces(data, int(offsets[i]), int(offsets[j]), slab)]
            found = np.concatenate(parts) if parts else np.empty(0, np.uint64)
            yield found, np.array([0, len(found)])
        else:
            begins = offsets[i : j + 1] - offsets[i]
            found, starts = _hashes(data[offsets[i] : offsets[j]], begins[:-1])
            yield found, np.searchsorted(starts, begins)
        i = j


def shingle_sets(column: pa.Array, width: int = 5, slab: int = 1 << 17) -> Iterator[np.ndarray]:
    """Of each text the sorted distinct 64-bit hashes of all runs of `width` words; of fewer words, of the whole sequence; none without words."""
    for words, bounds in word_hashes(column, slab):
        n = max(0, len(words) - width + 1)
        runs = np.zeros(n, np.uint64)
        for k in range(width):
            runs = _mixed(runs + words[k : n + k] * _MUL[k % len(_MUL)])
        for lo, hi in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            if hi - lo >= width:
                own = np.sort(runs[lo : hi - width + 1])
                yield own[np.append(True, own[1:] != own[:-1])]
            elif hi > lo:
                own = np.full(1, hi - lo, np.uint64)
                for w in words[lo:hi]:
                    own = _mixed(own * _MUL[0] + w)
                yield own
            else:
                yield np.empty(0, np.uint64)


def batches(of: Callable[[pa.RecordBatch], pa.RecordBatch | None]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A function for mapInArrow from one for a batch."""

    def run(them: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in them:
            if batch.num_rows and (out := of(batch)) is not None:
                yield out

    return run
