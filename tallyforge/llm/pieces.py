"""Texts taken by their distinct words, so that what is done to a word is done once."""

from __future__ import annotations

import gc
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from tallyforge.llm.common import slices

#: A blank before white space or the end: the cuts before blanks might then fall into a run of white space.
LOOSE = (
    " (?:[\\s\\x{0b}\\x{1c}-\\x{1f}\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]|$)"
)
CUT = re.compile(r"(?<=\S)(?= )")
#: Pieces that are joined at a time.
GATHER = 1 << 18


def split_pieces(text: str) -> list[str]:
    """Consecutive pieces of ``text``, cut before each blank that follows a character that isn't white space.

    A pattern match holds a blank in its first place or within a run of white space only, so none
    crosses a cut, and encoding piece by piece gives the ids of the whole text.
    """
    return CUT.split(text) if text else []


class Strings:
    """Many short strings of numbers, to be joined by number: string i is ``flat[start[i] : start[i] + size[i]]``."""

    def __init__(self, flat: np.ndarray, size: np.ndarray) -> None:
        self.flat, self.size = flat, size
        self.start = np.cumsum(size) - size

    @classmethod
    def of_bytes(cls, blobs: list[bytes], kind: str = "u1") -> Strings:
        flat = np.frombuffer(b"".join(blobs), kind)
        return cls(flat, np.fromiter(map(len, blobs), np.int64, len(blobs)) // flat.itemsize)

    def join(self, index: np.ndarray, ends: np.ndarray) -> Iterator[np.ndarray]:
        """For each run of ``index`` that stops at one of ``ends``: its strings, one after another."""
        begins = np.concatenate([[0], ends[:-1]]) if len(ends) else ends
        for a, b in slices((ends - begins).tolist(), GATHER):
            part, from_ = index[begins[a] : ends[b - 1]], begins[a]
            n = self.size[part]
            upto = np.concatenate([[0], np.cumsum(n)])
            at = np.arange(upto[-1]) + np.repeat(self.start[part] - upto[:-1], n)
            joined, cuts = self.flat[at], upto[np.concatenate([[0], ends[a:b] - from_])].tolist()
            for lo, hi in zip(cuts[:-1], cuts[1:]):
                yield joined[lo:hi]


def piece_table(texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Distinct pieces (a few may repeat), their numbers over all texts, and where each text's numbers end."""
    whole = pa.array(texts, pa.large_string())
    loose = pc.match_substring_regex(whole, LOOSE).to_numpy(zero_copy_only=False)
    runs = pc.split_pattern(pc.if_else(pa.array(loose), "", whole), " ")
    offsets = runs.offsets.to_numpy().astype(np.int64)
    coded = runs.values.dictionary_encode()
    index = coded.indices.to_numpy().astype(np.int64)
    rest = coded.dictionary.to_pylist()
    heads = runs.values.take(pa.array(offsets[:-1])).to_pylist()
    index[offsets[:-1]] = np.arange(len(heads)) + len(rest)
    used = np.zeros(len(rest), bool)
    used[index[index < len(rest)]] = True
    pieces = [" " + w if u else "" for w, u in zip(rest, used.tolist())] + heads
    if not loose.any():
        return pieces, index, offsets[1:]
    known: dict[str, int] = {}
    parts, ends, at = [], [], 0
    for i, slow in enumerate(loose.tolist()):
        if slow:
            own = np.array([known.setdefault(p, len(pieces) + len(known)) for p in split_pieces(texts[i])], np.int64)
        else:
            own = index[offsets[i] : offsets[i + 1]]
        parts.append(own)
        ends.append(at := at + len(own))
    return pieces + list(known), np.concatenate(parts), np.array(ends, np.int64)


class no_collection:  # noqa: N801
    """Holds the garbage collector: what is made inside is not cyclic, and there is very much of it."""

    def __enter__(self) -> None:
        self.was = gc.isenabled()
        gc.disable()

    def __exit__(self, *_: object) -> None:
        if self.was:
            gc.enable()


def number_words(texts: list[str], split: Callable[[str], list[str]]) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Distinct words by first appearance among the pieces, their numbers over all texts, and where each text ends."""
    with no_collection():
        pieces, index, ends = piece_table(texts)
        known: dict[str, int] = {}
        flat, size = [], []
        for words in map(split, pieces):
            size.append(len(words))
            for w in words:
                flat.append(known.setdefault(w, len(known)))
        strings = Strings(np.array(flat, np.int32), np.array(size, np.int64))
        numbers = list(strings.join(index, ends))
        count = np.array([len(x) for x in numbers], np.int64)
        return list(known), np.concatenate(numbers) if numbers else np.empty(0, np.int32), np.cumsum(count)


class WordMemo:
    """Turns texts to bytes, word by word, and remembers words up to a bound.

    ``split`` gives distinct words, their numbers over all texts, and each text's end; ``encode``
    the bytes of each of some distinct words, as numbers of type ``kind``. What is forgotten is
    encoded anew; the bound changes no result.
    """

    def __init__(self, split: Callable, encode: Callable[[list[bytes]], list[bytes]], kind: str, most: int = 450_000) -> None:
        self.split, self.encode, self.kind, self.most = split, encode, kind, most
        self.words: dict[bytes, bytes] = {}

    def texts(self, texts: list[str]) -> list[bytes]:
        """The bytes of each text."""
        with no_collection():
            known = self.words
            if len(known) > self.most:
                for key in list(known)[: len(known) - self.most // 2]:
                    del known[key]
            words, numbers, ends = self.split(texts)
            unknown = [w for w in words if w not in known]
            known.update(zip(unknown, self.encode(unknown)))
            strings = Strings.of_bytes(list(map(known.__getitem__, words)), self.kind)
            return [x.tobytes() for x in strings.join(numbers, ends)]
