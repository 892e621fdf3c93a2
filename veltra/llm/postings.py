"""Terms of texts and posting lists as bytes: numpy and Arrow over whole batches, nothing word by word."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: What each byte of a text becomes: 0 for what parts terms, lower case for A-Z, itself for digits, a-z and all of a
#: character beyond ASCII (whose bytes are 0x80 and more). Terms so are the maximal runs of bytes that aren't 0.
FOLDED = np.arange(256, dtype=np.uint8)
FOLDED[:0x30] = FOLDED[0x3A:0x41] = FOLDED[0x5B:0x61] = FOLDED[0x7B:0x80] = 0
FOLDED[0x41:0x5B] += 0x20

#: Bytes of text that are looked at in one go.
PIECE = 1 << 22


def _cuts(data: np.ndarray, lo: int, hi: int) -> Iterator[tuple[int, int]]:
    """lo to hi in pieces of PIECE bytes or a little more, which end where no term is open."""
    while lo < hi:
        end = min(lo + PIECE, hi)
        while end < hi and FOLDED[data[end - 1]] and FOLDED[data[end]]:
            ahead = data[end : end + PIECE]
            stop = np.flatnonzero(FOLDED[ahead[: hi - end]] == 0)
            end += int(stop[0]) if len(stop) else min(len(ahead), hi - end)
        yield lo, end
        lo = end


def pieces(texts: pa.Array) -> Iterator[tuple[int, int, pa.Array, np.ndarray]]:
    """(first text, last text + 1, terms, text of each term counted from the first), in order. Texts go together up to
    PIECE bytes; a longer one comes in several pieces. A null text has no terms."""
    texts = texts.cast(pa.large_binary())
    texts = texts.fill_null(b"") if texts.null_count else texts
    if not len(texts):
        return
    starts = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    at = 0
    while at < len(texts):
        to = max(at + 1, int(np.searchsorted(starts, starts[at] + PIECE, "right")) - 1)
        for lo, hi in _cuts(data, int(starts[at]), int(starts[to])) if to == at + 1 else [(int(starts[at]), int(starts[to]))]:
            yield at, to, *_terms(data[lo:hi], starts[at:to] - lo)
        at = to


def _terms(data: np.ndarray, starts: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    folded = FOLDED[data]
    inside = folded != 0
    opens = inside.copy()
    opens[1:] &= ~inside[:-1]
    edges = starts[(starts >= 0) & (starts < len(data))]
    opens[edges] = inside[edges]  # texts lie one behind the other, without anything between
    at = np.flatnonzero(opens)
    before = np.cumsum(inside) - inside
    offsets = np.append(before[at], inside.sum()).astype(np.int64)
    own = folded[inside]
    terms = pa.Array.from_buffers(pa.large_binary(), len(at), [None, pa.py_buffer(offsets), pa.py_buffer(own)])
    return terms, np.searchsorted(starts, at, "right") - 1


def packed(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers from 0 as bytes of seven bits, the last of each below 128; and where each starts (one more: the end)."""
    values = values.astype(np.uint64)
    size = np.ones(len(values), np.int64)
    for k in range(1, 10):
        size += values >= np.uint64(1 << 7 * k)
    ends = np.concatenate(([0], np.cumsum(size)))
    out = np.zeros(int(ends[-1]), np.uint8)
    for k in range(int(size.max(initial=0))):
        here = np.flatnonzero(size > k)
        more = np.where(size[here] > k + 1, 0x80, 0).astype(np.uint8)
        out[ends[here] + k] = ((values[here] >> np.uint64(7 * k)) & np.uint64(0x7F)).astype(np.uint8) | more
    return out, ends


def unpacked(data: bytes) -> np.ndarray:
    """What packed() wrote, as 64-bit integers."""
    raw = np.frombuffer(data, np.uint8)
    if raw.max(initial=0) < 0x80:
        return raw.astype(np.int64)
    last = np.flatnonzero(raw < 0x80)
    first = np.concatenate(([0], last[:-1] + 1))
    out = np.zeros(len(last), np.int64)
    for k in range(int((last - first).max()) + 1):
        here = np.flatnonzero(first + k <= last)
        out[here] |= (raw[first[here] + k].astype(np.int64) & 0x7F) << (7 * k)
    return out
