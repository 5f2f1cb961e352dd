"""Vectorised hashing of words and character n-grams over many texts at once."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 20
_CUTS = [bytes([c]) for c in (0x20, *range(0x09, 0x0E))]
_SPACES = np.zeros(256, dtype=bool)
_SPACES[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_POWERS = np.ones(1, dtype=np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finalizer of 64-bit integers (xor-shift-multiply)."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def _powers(n: int) -> np.ndarray:
    global _POWERS
    if len(_POWERS) < n:
        size = max(n, 2 * len(_POWERS), 1024)
        _POWERS = np.concatenate([[np.uint64(1)], np.cumprod(np.full(size - 1, _BASE, dtype=np.uint64))])
    return _POWERS[:n]


def spans_hash(values: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of values[b:e] for each span; spans are not empty and do not overlap."""
    if not len(begins):
        return np.zeros(0, dtype=np.uint64)
    sizes = ends - begins
    inner = np.concatenate([[0], np.cumsum(sizes)])[:-1]
    within = np.arange(int(sizes.sum())) - np.repeat(inner, sizes)
    taken = values[np.repeat(begins, sizes) + within].astype(np.uint64) + np.uint64(1)
    sums = np.add.reduceat(taken * _powers(int(sizes.max()))[within], inner)
    return mix(sums ^ (sizes.astype(np.uint64) << np.uint64(48)))


def parts_of(text: bytes, size: int = SLICE_BYTES) -> list[bytes]:
    """The text cut at spaces into parts of about size bytes; a longer word stays whole."""
    out, at = [], 0
    while len(text) - at > size:
        end = max(text.rfind(c, at, at + size) for c in _CUTS)
        if end <= at:
            ends = [k for c in _CUTS if (k := text.find(c, at + size)) >= 0]
            if not ends:
                break
            end = min(ends)
        out.append(text[at:end])
        at = end
    return [*out, text[at:]]


def word_hashes(texts: list[bytes], lower: bool = False, marks: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of all words in order, where each text's words begin and the last end).

    Words are maximal runs of bytes other than the six ASCII spaces; with
    marks, runs of ASCII letters, digits and bytes above 127 are apart from
    runs of other characters. Working memory is some 40 bytes for each byte
    of text, so long texts are done in parts.
    """
    if not any(len(t) > SLICE_BYTES for t in texts):
        return _word_hashes(texts, lower, marks)
    found, counts = [], []
    for text in texts:
        done = [_word_hashes([part], lower, marks)[0] for part in parts_of(text)]
        found += done
        counts.append(sum(map(len, done)))
    return np.concatenate(found), np.cumsum([0, *counts])


def _word_hashes(texts: list[bytes], lower: bool, marks: bool) -> tuple[np.ndarray, np.ndarray]:
    sizes = np.fromiter((len(t) for t in texts), dtype=np.int64, count=len(texts))
    data = np.frombuffer(b"\n".join(texts) + b"\n", dtype=np.uint8)  # the added byte parts the texts
    if lower:
        data = _LOWER[data]
    kind = (~_SPACES[data]).astype(np.int8)
    if marks:
        plain = (data >= 128) | ((data | 32) - 97 < 26) | (data - 48 < 10)
        kind[(kind == 1) & ~plain] = 2
    change = np.flatnonzero(np.diff(kind, prepend=np.int8(0)))
    begins = change[kind[change] > 0]
    nexts = np.append(change, len(data))
    ends = nexts[np.searchsorted(nexts, begins, side="right")] if len(begins) else begins
    first = np.cumsum(np.concatenate([[0], sizes + 1]))
    return spans_hash(data, begins, ends), np.searchsorted(begins, first)


def slices(batches: Iterable[pa.RecordBatch], text_at: int = 1, size: int = SLICE_BYTES) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Parts of the batches with about size bytes of text each, and their texts as UTF-8 (null: empty)."""
    for batch in batches:
        column = batch.column(text_at).cast(pa.large_binary())
        sizes = np.diff(np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]) if len(column) else np.zeros(0, dtype=np.int64)
        total = np.cumsum(sizes)
        at = 0
        while at < batch.num_rows:
            begin = total[at - 1] if at else 0
            end = max(at + 1, int(np.searchsorted(total, begin + size, side="right")))
            yield batch.slice(at, end - at), [x or b"" for x in column.slice(at, end - at).to_pylist()]
            at = end
