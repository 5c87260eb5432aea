"""Words of whole texts, found and hashed with numpy for many texts at once.

A word is a longest run of bytes other than space, tab, line feed, vertical tab, form feed and carriage return. Hashes are
64-bit polynomials over random byte values, so that any run of bytes is hashed by a difference of prefix sums.
"""

import numpy as np

U = np.uint64
_rng = np.random.RandomState(20240607)
BYTE = _rng.randint(0, 1 << 62, 256, dtype=np.int64).view(U) * U(4) + _rng.randint(0, 4, 256).astype(U)
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SPACE = np.zeros(256, bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True
BASE = U(0x9E3779B97F4A7C15)
INVERSE = U(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_powers = [np.ones(1, U), np.ones(1, U)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE ** i and BASE ** -i modulo 2 ** 64 for i < n."""
    if len(_powers[0]) < n:
        n2 = (n + n // 8 + (1 << 18)) >> 18 << 18  # texts come in slices of about 1 MiB, longer ones alone
        for k, base in enumerate((BASE, INVERSE)):
            x = np.full(n2, base, U)
            x[0] = 1
            _powers[k] = np.multiply.accumulate(x)
    return _powers[0][:n], _powers[1][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values without visible structure."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


class Spans:
    """Hashes of any spans of values: prefix sums are made once."""

    def __init__(self, values: np.ndarray):
        up, self.down = powers(len(values) + 1)
        self.sums = np.zeros(len(values) + 1, U)
        np.cumsum(values * up[:-1], out=self.sums[1:])

    def hash(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mix((self.sums[ends] - self.sums[starts]) * self.down[starts] + (ends - starts).astype(U) * U(0xD6E8FEB86659FD93))


class Words:
    """starts, ends: byte positions of the words of all texts in order; first: n + 1 numbers of each text's first word."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, lower: bool = False):
        self.raw, self.offsets = data, offsets
        self.data = LOWER[data] if lower else data
        inside = ~SPACE[data]
        edge = offsets[:-1][offsets[:-1] < len(data)]
        s, e = inside.copy(), inside.copy()
        s[1:] &= ~inside[:-1]
        e[:-1] &= ~inside[1:]
        s[edge] = inside[edge]
        back = edge[edge > 0] - 1
        e[back] = inside[back]
        self.inside = inside
        self.starts, self.ends = np.flatnonzero(s), np.flatnonzero(e) + 1
        self.first = np.searchsorted(self.starts, offsets)
        self.counts = np.diff(self.first)
        self.spans = Spans(BYTE[self.data])

    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.counts)), self.counts)

    def hashes(self) -> np.ndarray:
        return self.spans.hash(self.starts, self.ends)

    def per_doc(self, mask: np.ndarray) -> np.ndarray:
        """Sums of a mask over bytes, for each text."""
        sums = np.zeros(len(mask) + 1, np.int64)
        np.cumsum(mask, out=sums[1:])
        return sums[self.offsets[1:]] - sums[self.offsets[:-1]]

    def windows(self, hashes: np.ndarray, size: int = 3) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of runs of that many words inside one text, and the number of each run's first word."""
        n = len(hashes) - size + 1
        if n <= 0:
            return np.zeros(0, U), np.zeros(0, np.int64)
        doc = self.doc()
        at = np.flatnonzero(doc[:n] == doc[size - 1 :])
        h = np.zeros(len(at), U)
        for k in range(size):
            h = mix(h * U(0x2545F4914F6CDD1D) + hashes[at + k] + U(k + 1))
        return h, at


def shape_counts(w: Words) -> dict[str, np.ndarray]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_lines (with a word) and n_repeat_words of each text."""
    n = len(w.counts)
    symbol = np.zeros(256, bool)
    symbol[list(b"#*$%&|<>")] = True
    out = {"n_words": w.counts.astype(np.int64), "word_chars": w.per_doc(w.inside & ((w.raw & 0xC0) != 0x80)), "n_symbols": w.per_doc(symbol[w.raw])}
    filled = w.offsets[:-1] < w.offsets[1:]
    breaks = np.flatnonzero(w.raw == 10)
    starts = np.union1d(w.offsets[:-1][filled], breaks + 1)
    starts = starts[starts < len(w.raw)]
    ends = np.append(starts[1:], len(w.raw))[: len(starts)]
    ends = ends - (w.raw[ends - 1] == 10)
    doc = np.searchsorted(w.offsets, starts, "right") - 1
    full = np.searchsorted(w.starts, ends) > np.searchsorted(w.starts, starts)
    starts, ends, doc = starts[full], ends[full], doc[full]
    key = mix(w.spans.hash(starts, ends) + doc.astype(U) * BASE)
    _, one = np.unique(key, return_index=True)
    again = np.ones(len(key), np.int64)
    again[one] = 0
    out["n_dup_lines"] = np.bincount(doc, again, n).astype(np.int64)
    out["n_lines"] = np.bincount(doc, minlength=n).astype(np.int64)
    h, at = w.windows(w.hashes())
    word_doc = w.doc()
    _, back, times = np.unique(mix(h + word_doc[at].astype(U) * BASE), return_inverse=True, return_counts=True)
    found = at[times[back] > 1]
    covered = np.zeros(len(word_doc), bool)
    for k in range(3):
        covered[found + k] = True
    out["n_repeat_words"] = np.bincount(word_doc, covered, n).astype(np.int64)
    return out


def equal_slices(a: np.ndarray, a_starts: np.ndarray, b: np.ndarray, b_starts: np.ndarray, lengths: np.ndarray, most: int = 1 << 22) -> np.ndarray:
    """Whether a[x : x + n] and b[y : y + n] hold the same bytes, for each start and length; about that many bytes are compared at once."""
    out = np.ones(len(lengths), bool)
    ends = np.cumsum(lengths)
    i = 0
    while i < len(lengths):
        before = ends[i] - lengths[i]
        j = max(i + 1, int(np.searchsorted(ends, before + most, "right")))
        n = lengths[i:j]
        first = ends[i:j] - n - before
        for at in range(0, int(n.sum()) if j == i + 1 else 1, most):  # a slice of more bytes than that is compared in parts
            if j == i + 1:
                size = min(most, int(n[0]) - at)
                out[i] &= bool((a[a_starts[i] + at : a_starts[i] + at + size] == b[b_starts[i] + at : b_starts[i] + at + size]).all())
            else:
                k = np.arange(int(n.sum()))
                bad = a[k + np.repeat(a_starts[i:j] - first, n)] != b[k + np.repeat(b_starts[i:j] - first, n)]
                out[i:j][np.unique(np.searchsorted(ends[i:j] - before, k[bad], "right"))] = False
        i = j
    return out
