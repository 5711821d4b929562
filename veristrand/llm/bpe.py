"""Byte-level BPE over a published vocabulary file: speculate, verify, and merge only what fails.

A greedy longest match proposes the tokens of a word. The proposal is the BPE encoding
exactly when every token encodes to itself and every adjacent pair is compatible, that is,
merging the two tokens' texts would never join symbols across their border. All borders of
a batch are tested at once in numpy; only words with a failing border are merged exactly.
"""

from __future__ import annotations

import heapq
import json
import re
import unicodedata
from dataclasses import dataclass, field

import numpy as np
import regex

SPACES = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: Letters of usual texts, for which explicit classes of the standard library are exact and much faster.
USUAL = "A-Za-zÀ-ÖØ-öø-ſ"
UNUSUAL = re.compile(rf"[^\t\n\r -~{USUAL}]")
# The pre-token patterns the vocabulary files name, each for all texts and for usual characters.
LOWER_WORDS = (
    regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|\p{{L}}+|\p{{N}}|[^{SPACES}\p{{L}}\p{{N}}]+"),
    re.compile(rf"[{USUAL}]+|[0-9]|'(?:s|t|re|ve|m|ll|d)|[^\s0-9{USUAL}]+"),
)
SPACED_WORDS = (
    regex.compile(
        rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{SPACES}\p{{L}}\p{{N}}]+"
        rf"|[{SPACES}]+(?![^{SPACES}])|[{SPACES}]+"
    ),
    re.compile(rf" ?[{USUAL}]+| ?[0-9]+|'(?:s|t|re|ve|m|ll|d)| ?[^\s0-9{USUAL}]+|\s+(?!\S)|\s+"),
)
NO_RANK = np.iinfo(np.int64).max


def byte_letters() -> dict[int, str]:
    """The printable letter that stands for each byte in vocabulary files of this kind."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


LETTERS = byte_letters()


def lettered(word: str) -> str:
    return word.encode("utf-8", "surrogatepass").decode("latin-1").translate(LETTERS)


def split_words(text: str, patterns: tuple) -> list[str]:
    exact, usual = patterns
    return (exact if UNUSUAL.search(text) else usual).findall(text)


@dataclass
class Vocabulary:
    """Ids, merge ranks and special strings of one vocabulary file; a few megabytes, whatever the corpus."""

    ids: dict[str, int]
    merges: list[tuple[str, str]]
    suffix: str = ""
    lowercase: bool = False
    special: dict[str, int] = field(default_factory=dict)

    @classmethod
    def load(cls, path: str) -> Vocabulary:
        with open(path, encoding="utf-8") as file:
            content = json.load(file)
        model = content["model"]
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        return cls(
            dict(model["vocab"]), merges, model.get("end_of_word_suffix") or "", content.get("normalizer") is not None,
            {t["content"]: t["id"] for t in content.get("added_tokens", ())},
        )


class Encoder:
    """Encodes words of one vocabulary; built once in each Python worker."""

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary = vocabulary
        self.ids, self.suffix = vocabulary.ids, vocabulary.suffix
        self.ranks = {pair: rank for rank, pair in enumerate(vocabulary.merges)}
        self.names = {i: t for t, i in self.ids.items()} | {i: t for t, i in vocabulary.special.items()}
        self.longest = max(map(len, self.ids), default=1)
        strings = sorted(vocabulary.special, key=len, reverse=True)
        self.special = re.compile("|".join(map(re.escape, strings))) if strings else None
        self._tables()

    def _tables(self) -> None:
        """Arrays by token id: its merge rank (-1: a single symbol), its two parts, and the ranks of pairs."""
        size = max(self.ids.values(), default=0) + 1
        self.rank = np.full(size, -1, np.int64)
        self.left = np.zeros(size, np.int64)
        self.right = np.zeros(size, np.int64)
        codes, values = [], []
        for rank, (a, b) in enumerate(self.vocabulary.merges):
            joined = self.ids[a + b]
            self.rank[joined], self.left[joined], self.right[joined] = rank, self.ids[a], self.ids[b]
            codes.append(self.ids[a] << 32 | self.ids[b])
            values.append(rank)
        order = np.argsort(np.array(codes, np.int64), kind="stable")
        self.pair_codes = np.array(codes, np.int64)[order]
        self.pair_ranks = np.array(values, np.int64)[order]
        # A token is safe when its two parts' border holds no earlier merge, all the way down.
        merged = np.flatnonzero(self.rank >= 0)
        self.safe = np.ones(size, bool)
        self.safe[merged] = self.compatible(self.left[merged], self.right[merged], self.rank[merged])
        for token in merged[np.argsort(self.rank[merged], kind="stable")]:
            self.safe[token] &= self.safe[self.left[token]] and self.safe[self.right[token]]

    def _pair_rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        if not len(self.pair_codes):
            return np.full(len(left), NO_RANK)
        codes = left << 32 | right
        at = np.minimum(np.searchsorted(self.pair_codes, codes), len(self.pair_codes) - 1)
        return np.where(self.pair_codes[at] == codes, self.pair_ranks[at], NO_RANK)

    def compatible(self, left: np.ndarray, right: np.ndarray, own: np.ndarray | None = None) -> np.ndarray:
        """For each border, whether merging keeps it.

        Both sides are undone from the last merge to the first; at each state the two symbols
        that meet at the border must have no merge that would have come before the next one of
        either side. Of equal merges the one further left comes first. With ``own``, the border
        of a token's two parts, which its own merge may join at the end.
        """
        kept = np.ones(len(left), bool)
        at = np.arange(len(left))
        left, right = left.copy(), right.copy()
        end = np.full(len(left), NO_RANK) if own is None else own.copy()
        left_end, right_end = end.copy(), end - 1 if own is not None else end.copy()
        while len(at):
            meets = self._pair_rank(left, right)
            broken = (meets < left_end) & (meets <= right_end)
            kept[at[broken]] = False
            by_left, by_right = self.rank[left], self.rank[right]
            go = ~broken & ((by_left >= 0) | (by_right >= 0))
            at, left, right, left_end, right_end = at[go], left[go], right[go], left_end[go], right_end[go]
            undo_left = by_left[go] > by_right[go]
            left_end = np.where(undo_left, by_left[go], left_end)
            right_end = np.where(undo_left, right_end, by_right[go])
            left, right = np.where(undo_left, self.right[left], left), np.where(undo_left, right, self.left[right])
        return kept

    def symbols(self, word: str) -> list[str]:
        letters = list(lettered(word))
        letters[-1] += self.suffix
        return letters

    def propose(self, word: str) -> list[int]:
        """Greedy longest match; the suffix belongs to the last letter."""
        letters, ids, found, at = lettered(word), self.ids, [], 0
        while at < len(letters):
            rest = len(letters) - at
            whole = ids.get(letters[at:] + self.suffix) if rest <= self.longest else None
            if whole is not None:
                found.append(whole)
                break
            for size in range(min(self.longest, rest - 1), 0, -1):
                token = ids.get(letters[at : at + size])
                if token is not None:
                    found.append(token)
                    at += size
                    break
            else:
                return []
        return found

    def merge(self, word: str) -> list[int]:
        """The exact merges, lowest rank first and leftmost among equals, in n log n."""
        parts = self.symbols(word)
        after = list(range(1, len(parts) + 1))
        before = list(range(-1, len(parts) - 1))
        queue = [(r, i, p) for i, p in enumerate(zip(parts, parts[1:])) if (r := self.ranks.get(p)) is not None]
        heapq.heapify(queue)
        while queue:
            _, i, pair = heapq.heappop(queue)
            j = after[i]
            if parts[i] != pair[0] or j >= len(parts) or parts[j] != pair[1]:
                continue
            parts[i], parts[j] = pair[0] + pair[1], ""
            after[i] = after[j]
            if after[i] < len(parts):
                before[after[i]] = i
            for a, b in ((before[i], i), (i, after[i])):
                if a >= 0 and b < len(parts) and (r := self.ranks.get((parts[a], parts[b]))) is not None:
                    heapq.heappush(queue, (r, a, (parts[a], parts[b])))
        return [self.ids[p] for p in parts if p]

    def encode_words(self, words: list[str]) -> tuple[list[list[int]], int]:
        """Token ids of each word, and how many words needed exact merging."""
        found = [self.propose(w) for w in words]
        sizes = np.fromiter(map(len, found), np.int64, len(found))
        flat = np.fromiter((t for f in found for t in f), np.int64, int(sizes.sum()))
        owner = np.repeat(np.arange(len(found)), sizes)
        good = sizes > 0
        good[owner[~self.safe[flat]]] = False
        inner = np.flatnonzero(owner[:-1] == owner[1:]) if len(owner) else owner
        # Batches repeat the same borders, so each is tested once.
        borders, place = np.unique(flat[inner] << 32 | flat[inner + 1], return_inverse=True)
        kept = self.compatible(borders >> 32, borders & 0xFFFFFFFF)[place]
        good[owner[inner[~kept]]] = False
        failed = np.flatnonzero(~good)
        for i in failed:
            found[i] = self.merge(words[i])
        return found, len(failed)

    def pieces(self, text: str) -> list[str]:
        """The text between special strings, and those strings, in order."""
        if self.special is None or not self.special.search(text):
            return [text]
        found, at = [], 0
        for match in self.special.finditer(text):
            found += [text[at : match.start()], match[0]]
            at = match.end()
        return [*found, text[at:]]

    def normal(self, text: str) -> str:
        if not self.vocabulary.lowercase:
            return text
        if not text.isascii():
            # Letters are lowered one at a time, so a sigma never becomes a final one.
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")
        return text.lower()

    def runs(self, text: str) -> list[str]:
        """What stands between spaces in a normalised text, where white space is dropped."""
        return [r for r in self.normal(text).replace("\n", " ").split(" ") if r]

    def words(self, text: str) -> list[str]:
        """The pre-tokens of a text without special strings."""
        return split_words(self.normal(text), LOWER_WORDS if self.vocabulary.lowercase else SPACED_WORDS)

    def decode(self, ids: list[int]) -> str:
        """The tokens joined by spaces: the vocabulary with word ends names no decoder."""
        return " ".join(self.names[i] for i in ids if i in self.names)
