"""Character n-grams over a small alphabet, for language identification.

Every character maps to one of 32 symbols, so there are at most 32**4 four-grams: counts
and models of a language have a bound that no corpus exceeds.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa

from tessera.llm._words import slices

ORDER, BITS = 4, 5
SYMBOLS, GRAMS = 1 << BITS, 1 << (ORDER * BITS)
_SPACE, _DIGIT, _MARK, _OTHER = 0, 27, 30, 31
#: Languages whose counts a task holds at a time, 8 MB each.
_HELD = 8


@lru_cache(maxsize=1)
def symbol_table() -> np.ndarray:
    """The symbol of each code point: white space 0, a-z and A-Z 1-26, digits 27, other letters 28 or 29, punctuation 30, the rest 31."""
    table = np.full(0x110000, _OTHER, np.uint8)
    for code in range(0x30000):
        kind = unicodedata.category(chr(code))
        if kind[0] == "L":
            table[code] = 28 + code % 2
        elif kind[0] == "N":
            table[code] = _DIGIT
        elif kind[0] == "P":
            table[code] = _MARK
        elif kind[0] == "Z" or kind == "Cc":
            table[code] = _SPACE
    for i in range(26):
        table[ord("a") + i] = table[ord("A") + i] = 1 + i
    return table


def text_grams(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """The four-gram that ends at each character of the texts, and where each text starts in that array.

    Before its first character a text has white space.
    """
    at = np.zeros(len(texts) + 1, np.int64)
    np.cumsum(np.fromiter((len(t or "") for t in texts), np.int64, len(texts)), out=at[1:])
    codes = np.frombuffer("".join(t or "" for t in texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    return symbol_grams(symbol_table()[codes], at), at


def symbol_grams(symbols: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The four-gram that ends at each symbol of texts that start at these places."""
    lengths = np.diff(at)
    # White space, the symbol 0, stands before each text; the gram at position p ends at symbol p + 3, so text i owns grams from its own start on.
    shift = (ORDER - 1) * np.arange(1, len(lengths) + 1)
    padded = np.zeros(len(symbols) + (ORDER - 1) * len(lengths), np.int32)
    own = np.arange(len(symbols)) + np.repeat(shift, lengths)
    padded[own] = symbols
    grams = np.zeros(len(symbols), np.int32)
    for k in range(ORDER - 1, -1, -1):
        grams = (grams << BITS) | padded[own - k]
    return grams


def count_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts the four-grams of ``text`` by ``language``: rows ``language, gram int, n long``, summed within a task."""
    held: dict[str, np.ndarray] = {}

    def given() -> Iterator[pa.RecordBatch]:
        for name, counts in held.items():
            grams = np.flatnonzero(counts)
            yield pa.RecordBatch.from_pydict({"language": pa.array([name] * len(grams), pa.string()), "gram": grams.astype(np.int32), "n": counts[grams]})
        held.clear()

    for batch in batches:
        for part in slices(batch):
            grams, at = text_grams(part.column("text").to_pylist())
            language = part.column("language").dictionary_encode()
            of_gram = np.repeat(language.indices.to_numpy(), np.diff(at))
            for code, name in enumerate(language.dictionary.to_pylist()):
                if name not in held and len(held) == _HELD:
                    yield from given()
                counts = np.bincount(grams[of_gram == code], minlength=GRAMS)
                held[name] = held[name] + counts if name in held else counts
    yield from given()
