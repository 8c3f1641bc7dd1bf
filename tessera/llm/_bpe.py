"""Byte-pair encoding of many words at once, in rounds over one flat array of symbols."""

from __future__ import annotations

import heapq
import json
import re
import unicodedata
from functools import lru_cache

import numpy as np

from tessera.llm._words import equal_ranges

#: Endings that the split pattern takes as one token after an apostrophe (fixed values).
CONTRACTIONS = ("s", "t", "re", "ve", "m", "ll", "d")
#: Code points that regular expressions call white space, Unicode's White_Space (fixed values).
WHITE_SPACE = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
_LETTER, _NUMBER, _SPACE, _OTHER = 1, 2, 3, 4
#: Bytes of a word from which it is merged by itself.
LONG = 2000


@lru_cache(maxsize=1)
def _kinds() -> np.ndarray:
    table = np.full(0x110000, _OTHER, np.uint8)
    for code in range(0x110000):
        kind = unicodedata.category(chr(code))[0]
        if kind == "L":
            table[code] = _LETTER
        elif kind == "N":
            table[code] = _NUMBER
    table[WHITE_SPACE] = _SPACE
    return table


@lru_cache(maxsize=1)
def _byte_names() -> list[str]:
    """The character that stands for each byte: itself where it is printable, else the next free one from 256 on."""
    printable = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    names, free = [], 256
    for byte in range(256):
        if byte in printable:
            names.append(chr(byte))
        else:
            names.append(chr(free))
            free += 1
    return names


class WordModel:
    """A vocabulary whose words end in a suffix: lower case, no white space, byte symbols."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            stored = json.load(f)
        model = stored["model"]
        vocab, suffix = model["vocab"], model["end_of_word_suffix"] or ""
        self.specials = {t["content"]: t["id"] for t in stored["added_tokens"]}
        self.special_pattern = re.compile("(" + "|".join(re.escape(t) for t in sorted(self.specials, key=len, reverse=True)) + ")")
        names = _byte_names()
        self.inner = np.array([vocab[c] for c in names], np.int64)
        self.last = np.array([vocab[c + suffix] for c in names], np.int64)
        pairs = np.array([(vocab[a], vocab[b], vocab[a + b]) for a, b in (m if isinstance(m, list) else m.split(" ") for m in model["merges"])], np.int64)
        keys = pairs[:, 0] << 32 | pairs[:, 1]
        order = np.argsort(keys, kind="stable")
        self.pair_keys, self.pair_ranks, self.pair_merged = keys[order], order, pairs[order, 2]
        tokens = [""] * (1 + max([*vocab.values(), *self.specials.values()]))
        for token, i in [*vocab.items(), *self.specials.items()]:
            tokens[i] = token
        raw = [f"{t} ".encode() for t in tokens]
        self.token_at = np.r_[0, np.cumsum([len(b) for b in raw])]
        self.token_bytes = np.frombuffer(b"".join(raw), np.uint8)
        self.pair_of: dict[int, tuple[int, int]] = {}  # for long words

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """The token ids of all texts in one array, and where each text starts in it."""
        joined, owner, fixed = self._parts(texts)
        codes = np.frombuffer("\n".join(joined).encode("utf-32-le", "surrogatepass"), np.uint32)
        part_at = np.r_[0, np.cumsum([len(p) + 1 for p in joined])]
        start, end = _split(codes)
        part = np.searchsorted(part_at, start, "right") - 1
        which, distinct = equal_ranges(codes.view(np.uint8), 4 * start, 4 * end)
        ids, at = self.merge([w.decode("utf-32-le", "surrogatepass").encode("utf-8", "replace") for w in distinct.to_pylist()])
        length = np.diff(at)[which]
        out_part = np.repeat(part, length)
        ends = np.cumsum(length)
        out = ids[np.repeat(at[which] - (ends - length), length) + np.arange(ends[-1] if len(ends) else 0)]
        if fixed:  # special tokens stand between the parts of their text
            at_part, value = np.array([p for p, _ in fixed]), np.array([v for _, v in fixed])
            place = np.searchsorted(out_part, at_part)
            out, out_part = np.insert(out, place, value), np.insert(out_part, place, at_part)
        counts = np.bincount(np.array(owner)[out_part], minlength=len(texts)) if len(out) else np.zeros(len(texts), np.int64)
        return out, np.r_[0, np.cumsum(counts)]

    def _parts(self, texts: list[str | None]) -> tuple[list[str], list[int], list[tuple[int, int]]]:
        """Normalised texts, cut at special tokens; the text of each part; and for each special token its part (an empty one) and its id."""
        parts: list[str] = []
        owner: list[int] = []
        fixed: list[tuple[int, int]] = []
        for i, text in enumerate(texts):
            for k, piece in enumerate(self.special_pattern.split(text or "") if self.specials else [text or ""]):
                if k % 2:
                    fixed.append((len(parts), self.specials[piece]))
                parts.append("" if k % 2 else _normal(piece))
                owner.append(i)
        return parts, owner, fixed

    def merge(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Token ids of the words in one flat array, and where each word starts; words of more than ``LONG`` bytes go one by one."""
        many = [len(w) > LONG for w in words]
        if not any(many):
            return self._rounds(words)
        ids, at = self._rounds([w for w, long in zip(words, many, strict=True) if not long])
        short = iter(np.split(ids, at[1:-1]) if len(at) > 1 else [])
        found = [self._alone(w) if long else next(short) for w, long in zip(words, many, strict=True)]
        return np.concatenate(found), np.r_[0, np.cumsum([len(f) for f in found])]

    def _alone(self, word: bytes) -> np.ndarray:
        """One long word: a round would touch all of it for a few merges, so a heap gives the lowest-ranked pair, the leftmost first."""
        symbols = [*self.inner[np.frombuffer(word[:-1], np.uint8)].tolist(), int(self.last[word[-1]])]
        if not self.pair_of:
            self.pair_of = dict(zip(self.pair_keys.tolist(), zip(self.pair_ranks.tolist(), self.pair_merged.tolist(), strict=True), strict=True))
        after, before = [*range(1, len(symbols)), -1], [*range(-1, len(symbols) - 1)]
        open_: list[tuple[int, int, int, int]] = []

        def offered(at: int) -> None:
            if at >= 0 and after[at] >= 0:
                key = symbols[at] << 32 | symbols[after[at]]
                if key in self.pair_of:
                    rank, merged = self.pair_of[key]
                    heapq.heappush(open_, (rank, at, key, merged))

        for at in range(len(symbols)):
            offered(at)
        while open_:
            _, at, key, merged = heapq.heappop(open_)
            then = after[at]
            if then < 0 or symbols[at] < 0 or symbols[at] << 32 | symbols[then] != key:
                continue  # one of both has gone into another pair
            symbols[at], symbols[then] = merged, -1
            after[at] = after[then]
            if after[at] >= 0:
                before[after[at]] = at
            offered(at)
            offered(before[at])
        return np.array([x for x in symbols if x >= 0], np.int64)

    def _rounds(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """In each round every word that still has a known pair merges its lowest-ranked one,
        everywhere in the word from left to right.  Words that are done leave the array.
        """
        flat = np.frombuffer(b"".join(words), np.uint8)
        length = np.fromiter(map(len, words), np.int64, len(words))
        at = np.r_[0, np.cumsum(length)]
        symbols = self.inner[flat]
        symbols[at[1:] - 1] = self.last[flat[at[1:] - 1]]
        word = np.repeat(np.arange(len(words)), length)
        found_symbols, found_word = [], []
        pair = self._pairs(symbols, word)
        while len(symbols):
            best = np.minimum.reduceat(self._rank(pair), np.flatnonzero(np.r_[True, word[1:] != word[:-1]]))
            run = np.cumsum(np.r_[0, word[1:] != word[:-1]])
            lowest = best[run]
            open_ = lowest < len(self.pair_keys)
            if not open_.all():
                found_symbols.append(symbols[~open_])
                found_word.append(word[~open_])
                symbols, word, pair, lowest = symbols[open_], word[open_], pair[open_], lowest[open_]
                if not len(symbols):
                    break
            hit = np.flatnonzero(self._rank(pair) == lowest)
            # Of hits that touch, as in "aaa", take every second one of the run.
            new_run = np.r_[True, hit[1:] != hit[:-1] + 1]
            run_start = np.maximum.accumulate(np.where(new_run, np.arange(len(hit)), 0))
            hit = hit[(np.arange(len(hit)) - run_start) % 2 == 0]
            symbols[hit] = self.pair_merged[pair[hit]]
            stay = np.ones(len(symbols), bool)
            stay[hit + 1] = False
            kept = np.cumsum(stay) - 1
            symbols, word, pair = symbols[stay], word[stay], pair[stay]
            changed = kept[hit]
            changed = np.union1d(changed, changed[changed > 0] - 1)
            pair[changed] = self._pairs_at(symbols, word, changed)
        found_symbols = np.concatenate(found_symbols) if found_symbols else symbols
        found_word = np.concatenate(found_word) if found_word else word
        order = np.argsort(found_word, kind="stable")
        return found_symbols[order], np.r_[0, np.cumsum(np.bincount(found_word, minlength=len(words)))]

    def _rank(self, pair: np.ndarray) -> np.ndarray:
        return np.where(pair >= 0, self.pair_ranks[pair], len(self.pair_keys))

    def _pairs(self, symbols: np.ndarray, word: np.ndarray) -> np.ndarray:
        return self._pairs_at(symbols, word, np.arange(len(symbols)))

    def _pairs_at(self, symbols: np.ndarray, word: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Where the pairs that start at these places stand among the sorted pair keys; -1: no such pair."""
        found = np.full(len(at), -1, np.int64)
        inner = np.flatnonzero(at + 1 < len(symbols))
        inner = inner[word[at[inner]] == word[at[inner] + 1]]
        key = symbols[at[inner]] << 32 | symbols[at[inner] + 1]
        place = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
        found[inner] = np.where(self.pair_keys[place] == key, place, -1)
        return found

    def decode(self, ids: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The texts of the ids, tokens joined by a space: bytes (with a space after the last token too), and where each text starts."""
        length = self.token_at[ids + 1] - self.token_at[ids]
        ends = np.r_[0, np.cumsum(length)]
        out = self.token_bytes[np.repeat(self.token_at[ids] - ends[:-1], length) + np.arange(ends[-1])]
        return out, ends[at]


def _normal(text: str) -> str:
    """Normal form C in lower case, each character on its own (no final sigma)."""
    if not unicodedata.is_normalized("NFC", text):
        text = unicodedata.normalize("NFC", text)
    return text.replace("Σ", "σ").lower()


def _split(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words of ``'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+``: where each starts and ends."""
    if not len(codes):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    kind = _kinds()[codes]
    begins = np.r_[True, (kind[1:] != kind[:-1]) | (kind[1:] == _NUMBER)]
    start = np.flatnonzero(begins)
    padded = np.r_[codes, np.zeros(3, np.uint32)]
    quote = start[codes[start] == 0x27]
    quote = quote[np.r_[begins, np.ones(1, bool)][quote + 1]]  # an apostrophe with other marks after it is no contraction
    added, removed = [], []
    for ending in CONTRACTIONS:
        hit = quote
        for k, c in enumerate(ending, 1):
            hit = hit[padded[hit + k] == ord(c)]
        removed.append(hit + 1)
        after = hit + 1 + len(ending)
        added.append(after[after < len(codes)])
        quote = np.setdiff1d(quote, hit)
    begins[np.concatenate(removed)] = False
    begins[np.concatenate(added)] = True
    start = np.flatnonzero(begins)
    end = np.r_[start[1:], len(codes)]
    word = kind[start] != _SPACE
    return start[word], end[word]


@lru_cache(maxsize=2)
def word_model(path: str) -> WordModel:
    return WordModel(path)
