"""Whole batches of texts split into the words of a byte-level tokenizer, with numpy and Arrow."""

from __future__ import annotations

from functools import cache

import numpy as np
import pyarrow as pa
import regex

# The pattern that ``split`` stands for, and its endings after an apostrophe.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
ENDINGS = ("s", "t", "re", "ve", "m", "ll", "d")
OTHER, LETTER, NUMBER, SPACE = 0, 1, 2, 3


@cache
def kinds() -> np.ndarray:
    """The kind of each code point."""
    every = "".join(map(chr, (*range(0xD800), *range(0xE000, 0x110000))))
    out = np.zeros(0x110000, np.uint8)
    for kind, of in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (SPACE, r"\s+")):
        for m in regex.finditer(of, every):
            a, b = ord(every[m.start()]), ord(every[m.end() - 1])
            out[a : b + 1] = kind
    out[0xD800:0xE000] = OTHER
    return out


def split(texts: list[str]) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """Distinct words (matches of PATTERN) as UTF-8, their numbers over all texts, and where each text's numbers end.

    The matches cover a text without gaps, so they are found as cuts: where the kind changes, save that a run of white space gives its last
    blank to what follows, or else its last character stands alone; and after an apostrophe that begins a word, around the endings.
    """
    raw = "".join(texts).encode("utf-8", "replace")
    whole = raw.decode("utf-8")  # what can't be encoded has become a question mark, one for one
    code = np.frombuffer(whole.encode("utf-32-le"), "<u4")
    del whole
    n = len(code)
    stops = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)))
    if not n:
        return [], np.empty(0, np.int32), np.zeros(len(texts), np.int64)
    kind = kinds()[code]
    first = np.zeros(n + 1, bool)  # positions at which a text begins, or the last one ends
    first[np.concatenate([[0], stops])] = True
    cut = first.copy()
    cut[1:n] |= kind[1:] != kind[:-1]
    space = kind == SPACE
    # white space before something else in the same text
    before = np.nonzero(space[:-1] & ~space[1:] & ~first[1:n])[0]
    cut[before] = True
    cut[before[code[before] == 32] + 1] = False
    # apostrophes that begin a word: cuts, not after a blank (which would have joined)
    quote = np.nonzero((code == 39) & cut[:n])[0]
    if len(quote):
        at, after = np.searchsorted(stops, quote, side="right"), None
        room = stops[at] - quote  # characters to the end of the text, with the apostrophe
        for ending in ENDINGS:
            after = np.ones(len(quote), bool)
            for i, c in enumerate(ending, 1):
                after &= code[np.minimum(quote + i, n - 1)] == ord(c)  # what lies past the end has no room
            hit = quote[after & (room > len(ending))]
            cut[hit + 1] = False
            cut[hit + 1 + len(ending)] = True
    starts = np.nonzero(cut)[0]
    wide = np.nonzero(code > 0x7F)[0]  # UTF-8 takes a byte more for each, and more still from two bounds on
    extra = np.cumsum(1 + (code[wide] > 0x7FF) + (code[wide] > 0xFFFF))
    offsets = (starts + np.concatenate([[0], extra])[np.searchsorted(wide, starts)]).astype(np.int32)
    words = pa.Array.from_buffers(pa.binary(), len(starts) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(raw)])
    coded = words.dictionary_encode()
    _, at, data = coded.dictionary.buffers()
    bounds, data = np.frombuffer(at, np.int32, len(coded.dictionary) + 1).tolist(), data.to_pybytes()
    distinct = [data[a:b] for a, b in zip(bounds[:-1], bounds[1:])]
    return distinct, coded.indices.to_numpy(), np.searchsorted(starts, stops)
