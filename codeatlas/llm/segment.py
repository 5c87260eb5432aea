"""Pre-tokens of many texts at once, cut with numpy from code point classes instead of a regular expression's scan.

Two patterns are covered. SPACED, byte-level: contractions, runs of letters, numbers or other signs with one blank before them,
and runs of white space. BARE, for lower-cased words: contractions, runs of letters, single numbers, runs of other signs; white
space is dropped. Tests compare both with the regular expressions.
"""

import functools
import sys
import unicodedata

import numpy as np

from .words import Spans, mix

LETTER, NUMBER, SPACE, OTHER = 1, 2, 3, 4
BLANKS = (*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)


@functools.cache
def tables() -> tuple[np.ndarray, np.ndarray]:
    """The class of each code point, and whether Python's tables don't know it."""
    kinds = {"L": LETTER, "N": NUMBER}
    found = list(map(unicodedata.category, map(chr, range(sys.maxunicode + 1))))
    out = np.array([kinds.get(c[0], OTHER) for c in found], np.uint8)
    out[list(BLANKS)] = SPACE
    return out, np.array([c == "Cn" for c in found])


def classes() -> np.ndarray:
    return tables()[0]


def unknown(texts: list[str]) -> set[int]:
    """The numbers of texts with a code point that Python's tables call unassigned: a library with later tables may take it for a letter or fold its case."""
    wide = [k for k, t in enumerate(texts) if not t.isascii()]
    points, offsets = code_points([texts[k] for k in wide])
    at = np.flatnonzero(tables()[1][points])
    return {wide[k] for k in np.unique(np.searchsorted(offsets, at, "right") - 1).tolist()}


def code_points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """All code points, and n + 1 offsets."""
    data = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    return data, np.append(0, np.cumsum([len(t) for t in texts], dtype=np.int64))


def byte_classes(data: np.ndarray) -> np.ndarray:
    """For each byte of valid UTF-8 the class of the code point that it belongs to."""
    kind = classes()[:256][data]
    lead = np.flatnonzero(data >= 0xC0)
    while len(lead):  # once for each length of code points
        size = 2 + (data[lead[0]] >= 0xE0) + int(data[lead[0]] >= 0xF0)
        own = (data[lead] >= 0xE0).astype(np.int64) + (data[lead] >= 0xF0) == size - 2
        at, lead = lead[own], lead[~own]
        point = data[at].astype(np.int64) & (0x7F >> size)
        for k in range(1, size):
            point = point << 6 | (data[at + k] & 0x3F)
        found = classes()[point]
        for k in range(size):
            kind[at + k] = found
    return kind


def cut(points: np.ndarray, offsets: np.ndarray, spaced: bool, kind: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the pre-tokens of all texts, in order. Given the class of each, points may be UTF-8 bytes, if not spaced."""
    n = len(points)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    narrow = kind is not None
    kind = kind if narrow else classes()[points]
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    new = edge[:n].copy()
    new[1:] |= kind[1:] != kind[:-1]
    if not spaced:
        new |= kind == NUMBER
    if narrow:
        new &= (points & 0xC0) != 0x80  # a further byte of a number starts none
    starts = np.flatnonzero(new)
    ends = np.append(starts[1:], n)
    kinds = kind[starts]
    last = edge[ends]  # the run ends its text
    if spaced:
        # white space before another run: its last character is left over, and joins that run if it is a plain blank
        loose = (kinds == SPACE) & ~last
        blank = loose & (points[ends - 1] == 32)
        long = np.flatnonzero(loose & ~blank & (ends - starts > 1))
        takes = np.append(False, blank[:-1])
        ends = ends - blank
        starts = starts - takes
        starts, ends = np.append(starts, ends[long] - 1), np.append(ends, ends[long])
        ends[long] -= 1
        kinds, takes, last = np.append(kinds, np.full(len(long), SPACE)), np.append(takes, np.zeros(len(long), bool)), np.append(last, np.zeros(len(long), bool))
        order = np.argsort(starts, kind="stable")
        starts, ends, kinds, takes, last = starts[order], ends[order], kinds[order], takes[order], last[order]
        full = ends > starts
        starts, ends, kinds, takes, last = starts[full], ends[full], kinds[full], takes[full], last[full]
    else:
        takes = np.zeros(len(starts), bool)
    # an apostrophe alone before letters: 's 't 'm 'd 're 've 'll
    lone = np.flatnonzero((kinds == OTHER) & (ends - starts == 1) & ~takes & ~last & (points[starts] == 39) & np.append(kinds[1:] == LETTER, False) & np.append(starts[1:] == ends[:-1], False))
    if len(lone):
        s = starts[lone]
        a = points[s + 1]
        b = np.where(ends[lone + 1] - s > 2, points[np.minimum(s + 2, n - 1)], 0)
        is_ = lambda x, c: x == ord(c)
        one = is_(a, "s") | is_(a, "t") | is_(a, "m") | is_(a, "d")
        two = (is_(a, "r") & is_(b, "e")) | (is_(a, "v") & is_(b, "e")) | (is_(a, "l") & is_(b, "l"))
        more = one * 1 + two * 2
        ends = ends.copy()
        starts = starts.copy()
        ends[lone] += more
        starts[lone + 1] += more
        full = ends > starts
        starts, ends, kinds = starts[full], ends[full], kinds[full]
    if not spaced:
        full = kinds != SPACE
        starts, ends = starts[full], ends[full]
    return starts, ends


class Distinct:
    """The distinct pre-tokens of some texts. at: each pre-token's place among them; first: n + 1 offsets into at.

    They are found by 64-bit hashes, and all code points are then compared; should two different ones share a hash, they are told apart one by one.
    """

    def __init__(self, texts: list[str], spaced: bool):
        points, offsets = code_points(texts)
        starts, ends = cut(points, offsets, spaced)
        self.first = np.searchsorted(starts, offsets)
        self.whole = "".join(texts)
        hashes = Spans(spread(points)).hash(starts, ends)
        order = np.argsort(hashes)
        new = np.append(True, hashes[order[1:]] != hashes[order[:-1]])[: len(order)]
        self.at, one = np.empty(len(order), np.int64), order[new]
        self.at[order] = np.cumsum(new) - 1
        self.start, self.size = starts[one], (ends - starts)[one]
        if not same(points, starts, ends, self.start[self.at], self.size[self.at]):
            place: dict[str, int] = {}
            self.at = np.array([place.setdefault(self.whole[a:b], len(place)) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)], np.int64)
            one = np.unique(self.at, return_index=True)[1]
            self.start, self.size = starts[one], (ends - starts)[one]

    def __len__(self) -> int:
        return len(self.start)

    def words(self) -> list[str]:
        return [self.whole[a:b] for a, b in zip(self.start.tolist(), (self.start + self.size).tolist(), strict=True)]


def same(points: np.ndarray, starts: np.ndarray, ends: np.ndarray, others: np.ndarray, sizes: np.ndarray) -> bool:
    """Whether each span starts..ends holds the same code points as the span of that size from others on."""
    if (ends - starts != sizes).any():
        return False
    step = 1 << 13  # small enough for a cache
    for i in range(0, len(starts), step):
        n, a, b = sizes[i : i + step], starts[i : i + step], others[i : i + step]
        k = np.arange(n.sum()) + np.repeat(a - (np.cumsum(n) - n), n)
        if (points[k] != points[k + np.repeat(b - a, n)]).any():
            return False
    return True


def spread(points: np.ndarray) -> np.ndarray:
    """A random-looking value of each code point; those of the first planes come from a table."""
    if not _codes:
        _codes.append(mix(np.arange(1 << 16, dtype=np.uint64) + np.uint64(1)))
    return _codes[0][points] if points.max(initial=0) < 1 << 16 else mix(points.astype(np.uint64) + np.uint64(1))


_codes: list[np.ndarray] = []


def ragged(sizes: np.ndarray, at: np.ndarray, flat: np.ndarray, begin: np.ndarray | None = None) -> np.ndarray:
    """The concatenation of the groups at[...] of flat, whose groups have these sizes; begin: where they begin, if known."""
    begin = np.cumsum(sizes) - sizes if begin is None else begin
    n = sizes[at]
    return flat[np.repeat(begin[at] - (np.cumsum(n) - n), n) + np.arange(n.sum())]
