"""Parts of a text that a byte-level pre-tokeniser never joins.

Its pattern matches from left to right without looking back, and no
alternative holds a white-space character after the first place of a match
unless the match is all white space.  A run of white space before a non-space
gives up its last character: a blank goes to what follows, any other is a
match of its own.  So a white-space character that is followed by a non-space
always begins a pre-token, whatever stands before it, and merges never cross
pre-tokens.  Special strings hold no white space, so none spans such a place
either; but as they end what stands before them, a run of white space keeps its
last character there.  All begin with ``<``, before which nothing is cut.

Cut there, texts fall into parts whose token ids follow one another.  Parts
repeat far more than texts do, so a worker keeps what recent parts gave.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Parts that a worker keeps; the memory is given back when full.
CACHE_PARTS = 700_000
#: Longer parts are not kept, so that the store's bytes are bounded too.
CACHE_PART_CHARS = 64
#: Characters of a text that are cut at a time, about.
SLICE_CHARS = 1 << 20

# Only characters that every engine takes for white space are cut at; what
# Python alone takes for one only keeps a place from being cut.
_CUT = re.compile(r"(?=[ \n\t\r\v\f][^\s<])")


def slices(text: str, size: int = SLICE_CHARS) -> Iterator[tuple[str, bool]]:
    """Consecutive runs of whole parts, of about ``size`` characters each, and
    whether it is the last one."""
    lo = 0
    while len(text) - lo > size and (at := _CUT.search(text, lo + size)):
        yield text[lo : at.start()], False
        lo = at.start()
    yield text[lo:], True


def groups(texts: list[str | None], most: int = 4 * SLICE_CHARS) -> Iterator[tuple[list[int], list[str], list[bool]]]:
    """Slices of the texts, in order, about ``most`` characters at a time; the
    number of each one's text, and whether it ends it.  Null texts have none."""
    found, size = [], 0
    for k, text in enumerate(texts):
        for part, last in slices(text) if text is not None else ():
            found.append((k, part, last))
            size += len(part)
            if size >= most:
                yield tuple(map(list, zip(*found)))
                found, size = [], 0
    if found:
        yield tuple(map(list, zip(*found)))


def _codes(text: str) -> list:
    """A name for each part: what follows its blank, or its text if it begins
    with a line end; in a tuple the text of any other."""
    head, *rest = _CUT.split(text)
    return [(head,), *(p[1:] if p[0] == " " else p if p[0] == "\n" else (p,) for p in rest)]


def _is_part(code) -> bool:  # noqa: ANN001
    if isinstance(code, tuple):
        return True
    c = code[1:2] if code[:1] == "\n" else code[:1]
    return bool(c) and c != "<" and not c.isspace()


def _text(code) -> str:  # noqa: ANN001
    if isinstance(code, tuple):
        return code[0]
    return code if code[0] == "\n" else " " + code


@dataclass
class Parts:
    """Parts of some texts: ``values`` of the distinct ones, ``index`` of every
    part into them, and the place in it where each text ``begins``."""

    values: list
    index: np.ndarray
    begins: np.ndarray

    def sums(self, sizes: np.ndarray) -> np.ndarray:
        """The sum of ``sizes`` of the values over each text's parts."""
        return np.add.reduceat(sizes[self.index], self.begins) if len(self.begins) else np.zeros(0, np.int64)


class PartStore:
    """What ``learn`` gives for parts, with a bounded store of recent ones."""

    def __init__(self, learn: Callable[[list[str]], list], cache_parts: int = CACHE_PARTS):
        self.learn, self.cache_parts = learn, cache_parts
        self.known: dict = {}

    def of(self, texts: list[str]) -> Parts:
        """Cut at single blanks and line ends; texts with other white space
        are cut by the pattern."""
        if not texts:
            return Parts([], np.zeros(0, np.int64), np.zeros(0, np.int64))
        pieces = pc.split_pattern(pc.replace_substring(pa.array(texts, pa.large_string()), pattern="\n", replacement=" \n"), pattern=" ")
        every, begins = pieces.flatten(), pieces.offsets.to_numpy().astype(np.int64)[:-1]
        first = np.zeros(len(every), bool)
        first[begins] = True
        rest = every.filter(pa.array(~first)).dictionary_encode()
        codes: list = rest.dictionary.to_numpy(zero_copy_only=False).tolist()
        heads: dict = {}
        index = np.empty(len(every), np.int64)
        index[~first] = rest.indices.to_numpy()
        index[begins] = [heads.setdefault((x,), len(codes) + len(heads)) for x in every.take(pa.array(begins)).to_pylist()]
        codes += heads
        values = [*map(self.known.get, codes)]
        new = [k for k, v in enumerate(values) if v is None]
        bad = {k for k in new if not _is_part(codes[k])}
        if bad:
            new = [k for k in new if k not in bad]
            index, begins, more = _recut(texts, codes, bad, index, begins)
            codes += more
            values += map(self.known.get, more)
            new += [k for k in range(len(codes) - len(more), len(codes)) if values[k] is None]
        learnt = self.learn([_text(codes[k]) for k in new])
        if len(self.known) + len(new) > self.cache_parts:
            self.known.clear()
        for k, v in zip(new, learnt):
            values[k] = v
            if sum(map(len, codes[k])) <= CACHE_PART_CHARS:
                self.known[codes[k]] = v
        empty = self.learn([""])[0] if bad else None
        return Parts([empty if k in bad else v for k, v in enumerate(values)] if bad else values, index, begins)


def _recut(texts: list[str], codes: list, bad: set[int], index: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray, list]:
    """Parts by the pattern for the texts that hold a bad code."""
    marks = np.zeros(len(codes), bool)
    marks[list(bad)] = True
    rows = np.unique(np.searchsorted(begins, np.flatnonzero(marks[index]), side="right") - 1).tolist()
    number, more = {c: k for k, c in enumerate(codes)}, []
    runs = np.split(index, begins[1:])
    for r in rows:
        own = _codes(texts[r])
        for c in own:
            if c not in number:
                number[c] = len(codes) + len(more)
                more.append(c)
        runs[r] = np.array([number[c] for c in own], np.int64)
    return np.concatenate(runs), np.cumsum([0, *map(len, runs[:-1])]), more
