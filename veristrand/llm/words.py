"""Words and word windows of whole batches of texts as 64-bit codes, in numpy.

A word is a run of characters other than the six white-space characters of ASCII, with A-Z
lower-cased. Codes depend on the words alone, never on the process, so tasks agree.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

#: Bytes of text that are held as arrays at a time (a longer text alone makes one block).
BLOCK_BYTES = 1 << 20
BASE = np.uint64(0x9E3779B97F4A7C15)
_powers = np.ones(1, np.uint64)


def blocks(texts: list, size: int = BLOCK_BYTES) -> Iterator[list[bytes]]:
    """Encoded texts in runs of about ``size`` bytes; a null text is empty."""
    block, held = [], 0
    for text in texts:
        data = text.encode("utf-8", "surrogatepass") if text else b""
        if block and held + len(data) > size:
            yield block
            block, held = [], 0
        block.append(data)
        held += len(data)
    if block:
        yield block


def mixed(codes: np.ndarray) -> np.ndarray:
    """Every bit of the input moves every bit of the output."""
    codes = codes ^ (codes >> np.uint64(30))
    codes = codes * np.uint64(0xBF58476D1CE4E5B9)
    codes ^= codes >> np.uint64(27)
    codes *= np.uint64(0x94D049BB133111EB)
    return codes ^ (codes >> np.uint64(31))


def _power_table(size: int) -> np.ndarray:
    global _powers
    if len(_powers) < size:
        table = np.full(max(size, 2 * len(_powers)), BASE, np.uint64)
        table[0] = 1
        _powers = np.cumprod(table, dtype=np.uint64)
    return _powers


def word_codes(block: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The code of every word of the block in order, and the number of words of each text."""
    data = np.frombuffer(b"\n".join(block) + b"\n", np.uint8)
    space = (data == 32) | ((data >= 9) & (data <= 13))
    edge = np.flatnonzero(space[1:] != space[:-1]) + 1
    if not space[0]:
        edge = np.concatenate(([0], edge))
    starts, ends = edge[0::2], edge[1::2]
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(len(block), np.int64)
    letters = data.astype(np.uint64) + np.uint64(1)
    letters[(data >= 65) & (data <= 90)] += np.uint64(32)
    letters[space] = 0
    sizes = ends - starts
    # A letter's place counts from the start of its word; what precedes the first word is space.
    begun = np.concatenate(([0], starts))
    place = np.arange(len(data)) - np.repeat(begun, np.diff(np.append(begun, len(data))))
    terms = letters * _power_table(int(place.max()) + 1)[place]
    codes = mixed(np.add.reduceat(terms, starts) + sizes.astype(np.uint64))
    limits = np.cumsum([len(b) + 1 for b in block])
    return codes, np.diff(np.searchsorted(starts, limits, side="left"), prepend=0)


def windows(codes: np.ndarray, counts: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Codes of all runs of ``size`` words within each text, and their number per text.

    A text with fewer words, but at least one, has its whole sequence as its only window.
    """
    total = len(codes)
    combined = codes.copy()
    for k in range(1, size):
        combined = mixed(combined * BASE + np.uint64(k))
        if total > k:
            combined[: total - k] += codes[k:]
    ends = np.cumsum(counts)
    starts = ends - counts
    number = np.maximum(counts - size + 1, 0)
    keep = np.ones(total, bool)
    # The last size - 1 places of each text begin no whole window.
    for k in range(1, size):
        keep[np.maximum(ends - k, starts)[counts > 0]] = False
    full = counts >= size
    keep[starts[full]] = True
    short = np.flatnonzero((counts > 0) & ~full)
    for i in short:
        code = np.full(1, counts[i], np.uint64)
        for word in codes[starts[i] : ends[i]]:
            code = mixed(code * BASE + word)
        combined[starts[i]] = code[0]
        keep[starts[i]] = True
        number[i] = 1
    return combined[keep], number
