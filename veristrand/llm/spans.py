"""Words of whole batches of texts as arrays, for operators that look at runs of words.

Texts come as bytes in which white space is a blank and whatever no run may cross is a line
feed. Codes depend on the words alone, never on the process, so tasks agree.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

from .words import BASE, _power_table, mixed

BLANK, BREAK = 32, 10
#: Bytes that are held as arrays at a time; a run without a break that is longer makes one block alone.
BLOCK_BYTES = 1 << 20
#: Bits of a filter of codes: so many bytes times eight are sent to a task, whatever the input.
FILTER_BITS = 1 << 27


def table(blanks: bytes, breaks: bytes = b"", *, lower: bool = False) -> bytes:
    """A table for ``bytes.translate`` that turns those characters into the two kinds of separators."""
    out = bytearray(range(256))
    for characters, to in ((blanks, BLANK), (breaks, BREAK)):
        for c in characters:
            out[c] = to
    for c in range(65, 91) if lower else ():
        out[c] = c + 32
    return bytes(out)


def blocks(texts: Iterator[bytes], size: int = BLOCK_BYTES) -> Iterator[tuple[bytes, np.ndarray, np.ndarray]]:
    """Joined texts of about ``size`` bytes, the numbers of the texts in them and where each of these begins.

    A text beyond that size is dealt over blocks at its breaks, so it never lies in memory as arrays at once.
    """
    held, numbers, starts, at = [], [], [], 0
    for number, text in enumerate(texts):
        begin = 0
        while begin < len(text) or not begin:
            end = len(text)
            if end - begin > size:
                cut = text.rfind(b"\n", begin, begin + size)
                if cut < 0:
                    cut = text.find(b"\n", begin + size)
                end = len(text) if cut < 0 else cut + 1
            if held and at + end - begin > size:
                yield b"\n".join(held) + b"\n", np.array(numbers), np.array(starts)
                held, numbers, starts, at = [], [], [], 0
            held.append(text[begin:end])
            numbers.append(number)
            starts.append(at)
            at += end - begin + 1
            begin = end
            if not text:
                break
    if held:
        yield b"\n".join(held) + b"\n", np.array(numbers), np.array(starts)


class Words:
    """The words of a block: where each starts and ends, the run it belongs to, its code."""

    def __init__(self, block: bytes):
        data = np.frombuffer(block, np.uint8)
        breaks = data == BREAK
        gap = breaks | (data == BLANK)
        edge = np.flatnonzero(gap[1:] != gap[:-1]) + 1
        if not gap[0]:
            edge = np.concatenate(([0], edge))
        self.block, self.starts, self.ends = block, edge[0::2], edge[1::2]
        self.runs = np.cumsum(breaks, dtype=np.int32)[self.starts]
        if not len(self.starts):
            self.codes = np.zeros(0, np.uint64)
            return
        begun = np.concatenate(([0], self.starts))
        place = np.arange(len(data), dtype=np.int64) - np.repeat(begun, np.diff(np.append(begun, len(data))))
        letters = data.astype(np.uint64) + np.uint64(1)
        letters[gap] = 0
        letters *= _power_table(int(place.max()) + 1)[place]
        self.codes = mixed(np.add.reduceat(letters, self.starts) + (self.ends - self.starts).astype(np.uint64))

    def __len__(self) -> int:
        return len(self.starts)

    def together(self, size: int) -> np.ndarray:
        """Whether the ``size`` words from each word on stand in one run."""
        whole = np.zeros(len(self), bool)
        if len(self) >= size:
            whole[: len(self) - size + 1] = self.runs[size - 1 :] == self.runs[: len(self) - size + 1]
        return whole


def followed(codes: np.ndarray, more: np.ndarray) -> np.ndarray:
    """The codes of sequences, each followed by one more word."""
    return mixed(codes * BASE + more)


class Filter:
    """A fixed number of bits that says of a code whether it may be among those put in; never no for one that is."""

    def __init__(self, rows: Iterator[tuple[int, int]] = (), bits: int = FILTER_BITS):
        self.mask = np.uint64(bits - 1)
        self.words = np.zeros(bits >> 6, np.uint64)
        for place, held in rows:
            self.words[place] = np.uint64(held & 0xFFFFFFFFFFFFFFFF)

    @classmethod
    def of(cls, codes, bits: int = FILTER_BITS) -> Filter:
        """Of a table with the column ``code``: bits are set in Spark, at most ``bits / 64`` rows come back."""
        from pyspark.sql import functions as F

        at = F.col("code").bitwiseAND(F.lit(bits - 1))
        bit = F.call_function("shiftleft", F.lit(1).cast("long"), at.bitwiseAND(F.lit(63)).cast("int"))
        words = codes.groupBy(F.shiftright(at, 6).alias("place")).agg(F.bit_or(bit).alias("held")).toPandas()
        return cls(zip(words["place"].tolist(), words["held"].tolist()), bits)

    def __bool__(self) -> bool:
        return bool(self.words.any())

    def has(self, codes: np.ndarray) -> np.ndarray:
        at = codes & self.mask
        return (self.words[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63)) & np.uint64(1)).astype(bool)
