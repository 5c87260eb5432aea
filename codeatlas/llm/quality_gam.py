"""Quality classifier (operator 1): a generalised additive model with pairwise interactions.

Cyclic boosting of shallow trees learns one lookup table for each binned feature and one for each chosen pair of features;
a text's score is the logistic function of the sum of its table entries. Labels come from at most FIT_ROWS labelled rows
(a hash order of doc_id picks them) outside the held-out fold.

Defined results: null and empty texts have the features of no words and are scored like any other. Very long texts are
counted whole. Repeated rows get equal scores, one row each. Without any usable labels, every score is 0.5. Null doc_id
counts as held out. An empty table gives an empty result. A labelled doc_id with several texts counts by the one of the least features.
Other columns are ignored by quality() and kept by keep_good().
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .labelled import fold, sample, texts_of
from .shared import pieces, released, slices, text_bytes
from .words import BASE, U, Words, mix, shape_counts

FIT_ROWS, THRESHOLD = 20_000, 0.3
FEATURES = ("log_words", "word_length", "symbols", "dup_lines", "repeats", "upper", "exclaims", "bars", "digits", "stops", "commas", "non_ascii", "distinct", "line_words", "short_words")


def class_mask(chars: bytes) -> np.ndarray:
    m = np.zeros(256, bool)
    m[list(chars)] = True
    return m


UPPER, DIGIT, LETTER = class_mask(bytes(range(65, 91))), class_mask(b"0123456789"), class_mask(bytes(range(65, 91)) + bytes(range(97, 123)))


def features(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A row of FEATURES for each text."""
    w = Words(data, offsets)
    c = {k: v.astype(float) for k, v in shape_counts(w).items()}
    n = np.maximum(c["n_words"], 1)
    of = lambda mask: w.per_doc(mask[data]).astype(float)
    letters, size = np.maximum(of(LETTER), 1), np.maximum(np.diff(offsets), 1)
    lines = of(class_mask(b"\n")) + 1
    doc = w.doc()
    _, one = np.unique(mix(w.hashes() + doc.astype(U) * BASE), return_index=True)
    short = np.bincount(doc, (w.ends - w.starts) <= 2, len(n))
    columns = [np.log1p(c["n_words"]), c["word_chars"] / n, c["n_symbols"] / n, c["n_dup_lines"] / lines, c["n_repeat_words"] / n, of(UPPER) / letters, of(class_mask(b"!")) / n, of(class_mask(b"|")) / n, of(DIGIT) / size, of(class_mask(b".")) / n, of(class_mask(b",")) / n, w.per_doc(data >= 0xC0) / size, np.bincount(doc[one], minlength=len(n)) / n, np.log1p(c["n_words"] / lines), short / n]
    return np.stack(columns, 1)


class AdditiveModel:
    """bins: edges of each feature; tables: one value a bin; pairs: (i, j, table) over coarser bins."""

    def __init__(self, bins: int = 32, coarse: int = 8, rounds: int = 120, pair_rounds: int = 60, n_pairs: int = 8, rate: float = 0.1):
        self.n_bins, self.coarse, self.rounds, self.pair_rounds, self.n_pairs, self.rate = bins, coarse, rounds, pair_rounds, n_pairs, rate
        self.base, self.edges, self.rough, self.tables, self.pairs = 0.0, [], [], [], []

    @staticmethod
    def cut(x: np.ndarray, n: int) -> np.ndarray:
        return np.unique(np.quantile(x, np.linspace(0, 1, n + 1)[1:-1]))

    def fit(self, x: np.ndarray, y: np.ndarray) -> "AdditiveModel":
        if len(y) == 0 or y.min() == y.max():
            p = (y.sum() + 1) / (len(y) + 2)
            self.base = float(np.log(p / (1 - p)))
            return self
        self.edges, self.rough = [self.cut(c, self.n_bins) for c in x.T], [self.cut(c, self.coarse) for c in x.T]
        fine = [np.searchsorted(e, c, "right") for e, c in zip(self.edges, x.T, strict=True)]
        rough = [np.searchsorted(e, c, "right") for e, c in zip(self.rough, x.T, strict=True)]
        self.tables = [np.zeros(len(e) + 1) for e in self.edges]
        self.base = float(np.log(y.mean() / (1 - y.mean())))
        f = np.full(len(y), self.base)
        for _ in range(self.rounds):
            for k, b in enumerate(fine):
                p = 1 / (1 + np.exp(-f))
                m = len(self.tables[k])
                step = self.rate * shallow(np.bincount(b, y - p, m), np.bincount(b, p * (1 - p), m))
                self.tables[k] += step
                f += step[b]
        p = 1 / (1 + np.exp(-f))
        g, h = y - p, p * (1 - p)
        gains = []
        for i in range(len(fine)):
            for j in range(i):
                grid = (len(self.rough[i]) + 1, len(self.rough[j]) + 1)
                at = rough[i] * grid[1] + rough[j]
                gains.append((quadrants(np.bincount(at, g, grid[0] * grid[1]).reshape(grid), np.bincount(at, h, grid[0] * grid[1]).reshape(grid))[0], i, j, at, grid))
        gains = sorted(gains, key=lambda t: (-t[0], t[1], t[2]))[: self.n_pairs]
        self.pairs = [(i, j, np.zeros(grid)) for _, i, j, _, grid in gains]
        for _ in range(self.pair_rounds):
            for (_, _, table), (_, _, _, at, grid) in zip(self.pairs, gains, strict=True):
                p = 1 / (1 + np.exp(-f))
                step = self.rate * quadrants(np.bincount(at, y - p, table.size).reshape(grid), np.bincount(at, p * (1 - p), table.size).reshape(grid))[1]
                table += step
                f += step.ravel()[at]
        return self

    def score(self, x: np.ndarray) -> np.ndarray:
        f = np.full(len(x), self.base)
        for e, t, c in zip(self.edges, self.tables, x.T, strict=False):
            f += t[np.searchsorted(e, c, "right")]
        for i, j, t in self.pairs:
            f += t[np.searchsorted(self.rough[i], x[:, i], "right"), np.searchsorted(self.rough[j], x[:, j], "right")]
        return 1 / (1 + np.exp(-np.clip(f, -40, 40)))


RIDGE = 5.0


def best_cut(g: np.ndarray, h: np.ndarray) -> int:
    """The number of bins left of the best single split; 0 for none."""
    left, lh = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
    right, rh = g.sum() - left, h.sum() - lh
    gain = left**2 / (lh + RIDGE) + right**2 / (rh + RIDGE) - g.sum() ** 2 / (h.sum() + RIDGE)
    return int(np.argmax(gain)) + 1 if len(gain) and gain.max() > 1e-9 else 0


def shallow(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    """A tree of depth two over ordered bins, as a value for each bin."""
    out, mid = np.zeros(len(g)), best_cut(g, h)
    for a, b in ((0, mid), (mid, len(g))):
        inner = a + best_cut(g[a:b], h[a:b])
        for p, q in ((a, inner), (inner, b)):
            if q > p:
                out[p:q] = g[p:q].sum() / (h[p:q].sum() + RIDGE)
    return out


def quadrants(g: np.ndarray, h: np.ndarray) -> tuple[float, np.ndarray]:
    """The best split of a grid into four by one cut on each side: its gain, and the values on the grid."""
    if min(g.shape) < 2:
        return 0.0, np.zeros(g.shape)

    def four(a):
        c = np.cumsum(np.cumsum(a, 0), 1)
        tl = c[:-1, :-1]
        tr, bl = c[:-1, -1:] - tl, c[-1:, :-1] - tl
        return np.stack([tl, tr, bl, c[-1, -1] - tl - tr - bl])

    gs, hs = four(g), four(h)
    gain = (gs**2 / (hs + RIDGE)).sum(0)
    i, j = np.unravel_index(int(np.argmax(gain)), gain.shape)
    v = gs[:, i, j] / (hs[:, i, j] + RIDGE)
    out = np.empty(g.shape)
    out[: i + 1, : j + 1], out[: i + 1, j + 1 :], out[i + 1 :, : j + 1], out[i + 1 :, j + 1 :] = v
    return float(gain[i, j] - g.sum() ** 2 / (h.sum() + RIDGE)), out


def fit(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS) -> AdditiveModel:
    """A model of labels.quality from at most `rows` labelled documents of the training fold."""

    def measured(batches):
        for batch in batches:
            for part, data, offsets in pieces(batch):
                x = features(data, offsets)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array(list(x), pa.list_(pa.float64()))], ["doc_id", "y", "x"])

    chosen = sample(labels, "quality", fold(5) != 0, rows)
    found = texts_of(docs, chosen).mapInArrow(released(measured), "doc_id long, y int, x array<double>").groupBy("doc_id").agg(F.min(F.struct("y", "x")).alias("r")).select("doc_id", "r.*").toPandas().sort_values("doc_id")
    x = np.stack(found["x"].to_numpy()) if len(found) else np.zeros((0, len(FEATURES)))
    return AdditiveModel().fit(x, found["y"].to_numpy().astype(float))


def quality(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, rows: int = FIT_ROWS) -> DataFrame:
    """doc_id, held_out, score and predicted for each row of docs; see the module's docstring."""
    model = fit(docs, labels, rows)

    def scored(batches):
        for batch in batches:
            for part, data, offsets in pieces(batch):
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(model.score(features(data, offsets)))], ["doc_id", "score"])

    out = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(released(scored), "doc_id long, score double")
    return out.select("doc_id", (fold(5) == 0).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, rows: int = FIT_ROWS) -> DataFrame:
    """The rows of docs, whole, that quality() would predict as good: each row by its own text. Only texts go through Python, and no text is shuffled."""
    model = fit(docs, labels, rows)

    def good(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in texts:
            data, offsets = text_bytes(column)
            score = [model.score(features(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])) for i, j in slices(offsets)]
            yield pa.array(np.concatenate(score or [np.zeros(0)]) >= threshold)

    return docs.filter(F.arrow_udf(released(good), "boolean")(F.col("text").cast("string")))
