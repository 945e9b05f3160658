"""Whole texts of an Arrow batch as one array of bytes: words, sentences and their hashes by numpy.

Texts are taken in slices of a few megabytes, so that memory follows the slice or the longest single
text and not the batch.
"""

from __future__ import annotations

import sys
import types

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 19

# Bytes that end a word in the contracts of the operators.
BLANKS = b"\x09\x0a\x0b\x0c\x0d\x20"


def in_worker(name: str, make):
    """A value kept by this Python process between tasks (tables read from a file, word memories)."""
    held = sys.modules.setdefault("_recollect_llm_held", types.ModuleType("_recollect_llm_held")).__dict__
    if name not in held:
        held[name] = make()
    return held[name]


def slices(batch: pa.RecordBatch, column: str = "text", size: int = SLICE_BYTES):
    """The batch in pieces whose texts have about `size` bytes together (one text at least)."""
    ends = np.cumsum(np.maximum(lengths(batch.column(column)), 1))
    start = 0
    while start < batch.num_rows:
        base = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, base + size, side="right")))
        yield batch.slice(start, stop - start)
        start = stop


def with_text(batch: pa.RecordBatch) -> pa.RecordBatch:
    """The batch with the text inside its column `_whole` as a column of its own, without a copy."""
    whole = batch.column("_whole")
    text = whole.flatten()[whole.type.get_field_index("text")]
    return batch.append_column("text", text)


def lengths(texts: pa.Array) -> np.ndarray:
    import pyarrow.compute as pc

    return pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64)


def flatten(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts (null: empty) and where each begins; the last offset is the end."""
    texts = texts.cast(pa.large_binary())
    if texts.null_count:
        texts = texts.fill_null(b"")
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, np.int64)[texts.offset:texts.offset + len(texts) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[at[0]:at[-1]], at - at[0]


def member(chars: bytes) -> np.ndarray:
    table = np.zeros(256, bool)
    table[list(chars)] = True
    return table


def word_bytes() -> np.ndarray:
    """Bytes of the class [^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F] with A-Z counted in: letters, digits, non-ASCII."""
    table = np.zeros(256, bool)
    table[48:58] = table[65:91] = table[97:123] = table[128:] = True
    return table


def tokens(data: np.ndarray, at: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and text number of every run of bytes for which `inside` holds; none crosses texts."""
    if not len(data):
        none = np.zeros(0, np.int64)
        return none, none, none
    first = np.zeros(len(data), bool)
    first[at[:-1][at[:-1] < len(data)]] = True
    before = np.empty(len(data), bool)
    before[0] = False
    before[1:] = inside[:-1]
    starts = np.flatnonzero(inside & (first | ~before))
    after = np.empty(len(data), bool)
    after[-1] = False
    after[:-1] = inside[1:] & ~first[1:]
    ends = np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(at, starts, side="right") - 1


def blank_words(data: np.ndarray, at: np.ndarray):
    """Words [^\\x20\\x09-\\x0D]+."""
    return tokens(data, at, ~member(BLANKS)[data])


def letter_words(data: np.ndarray, at: np.ndarray):
    """Words of letters, digits and non-ASCII signs."""
    return tokens(data, at, word_bytes()[data])


def lower_ascii(data: np.ndarray) -> np.ndarray:
    return data + (((data >= 65) & (data <= 90)) * np.uint8(32)).astype(np.uint8)


BASE = 0x9E3779B97F4A7C15 | 5


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xA0761D6478BD642F)
    return x ^ (x >> np.uint64(32))


def powers(base: int, n: int) -> np.ndarray:
    """base ** 0, base ** 1, ... of 64 bits; kept by the worker as far as any text needed them."""
    def grow(have):
        out = np.empty(max(n, 1 << 16), np.uint64)
        out[0] = 1
        filled = 1
        while filled < len(out):
            step = min(filled, len(out) - filled)
            out[filled:filled + step] = out[:step] * np.uint64(pow(base, filled, 1 << 64))
            filled += step
        return out

    key = f"powers{base}"
    have = in_worker(key, lambda: grow(None))
    if len(have) < n:
        have = sys.modules["_recollect_llm_held"].__dict__[key] = grow(have)
    return have[:n]


def run_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit hash of data[start:end] for each pair: the same bytes give the same hash anywhere."""
    base = (BASE + 8 * seed) | 1
    n = len(data)
    values = in_worker(f"bytes{seed}", lambda: mix(np.arange(1 + 256 * seed, 257 + 256 * seed).astype(np.uint64)))
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(values[data] * powers(base, n), out=sums[1:])
    back = powers(pow(base, -1, 1 << 64), n + 1)
    size = (ends - starts).astype(np.uint64)
    return mix((sums[ends] - sums[starts]) * back[starts] + size * np.uint64(0x632BE59BD9B4E019))


def window_hashes(ids: np.ndarray, width: int, seed: int = 1) -> np.ndarray:
    """Hash of ids[i:i+width] for every i that has so many after it (texts are not looked at)."""
    n = len(ids) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.full(n, seed, np.uint64)
    for k in range(width):
        out = mix(out * np.uint64(BASE) + ids[k:k + n])
    return out


def shingles(ids: np.ndarray, of: np.ndarray, n_texts: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the windows of `width` words and the text of each. A text with fewer words has one
    window that holds all of them; one without words has none."""
    if not len(ids):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    hashes = window_hashes(ids, width)
    whole = of[:len(hashes)] == of[width - 1:] if len(hashes) else np.zeros(0, bool)
    counts = np.bincount(of, minlength=n_texts)
    short = np.flatnonzero((counts > 0) & (counts < width))
    begins = np.cumsum(counts) - counts
    extra = np.zeros(len(short), np.uint64)
    for i, t in enumerate(short):
        own = ids[begins[t]:begins[t] + counts[t]]
        extra[i] = window_hashes(own, len(own), seed=7 + len(own))[0]
    got = np.concatenate([hashes[whole], extra])
    who = np.concatenate([of[:len(hashes)][whole], short])
    order = np.argsort(who, kind="stable")
    return got[order], who[order]


def spread(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Positions start, start+1, ... of each run, one run after the other."""
    total = int(counts.sum())
    if not total:
        return np.zeros(0, np.int64)
    ends = np.cumsum(counts)
    return np.arange(total) + np.repeat(starts - (ends - counts), counts)
