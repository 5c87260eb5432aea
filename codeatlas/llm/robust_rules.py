"""Quality rules (operator 9): robust multivariate outliers by minimum covariance determinant.

Each text becomes a vector of transformed statistics. For each language and source, for each language and for all rows, the central
three quarters of the rows whose scatter has the least determinant are sought: concentration steps (rank rows by their distance, take
the moments of the nearest share CORE) start from several robust scatters, the start of least determinant goes on until the determinant
falls no more. A group's estimate is then drawn towards that of its language, and this one's towards that of all rows, by the weight
of LEAST rows, so that groups of every size are judged by one rule. Rows at a large Mahalanobis distance are rejected, beside two fixed
base rules. Nothing is sampled: every step is a grouped aggregation over all rows.

Defined results: a null or empty text has no words, so it fails the base rules and is rejected. Null lang or source is a group of its own.
Repeated rows are judged alike, one result row each. An empty table gives an empty result. Other columns are ignored by
robust_rules() and kept by keep_regular(). FLOOR keeps repeated words from rejecting a text alone: the base rule does that.
"""

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import fresh, pieces, released, slices, small, text_bytes, written
from .words import Words, shape_counts

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
USED = (*COUNTS, "n_lines")
#: Least standard deviation of each transformed statistic: below it, differences are not worth a rejection.
FLOOR = (0.5, 0.6, 0.08, 0.15, 0.18)
D = len(FLOOR)
UP = [(i, j) for i in range(D) for j in range(i, D)]
#: Share of rows in the core, rows that a parent's estimate counts for, quantile of distances, bins of a squared distance's octave, steps of every start.
CORE, LEAST, CUT, BINS, FIRST = 0.75, 100, 0.9999, 32, 2


def count_statistics(batches):
    """Arrow batches of (doc_id, lang, source, text) to one row of statistics for each."""
    for batch in batches:
        for rows, data, offsets in pieces(batch):
            counts = shape_counts(Words(data, offsets))
            yield pa.RecordBatch.from_arrays([rows.column(k) for k in range(3)] + [pa.array(counts[c]) for c in USED], ["doc_id", "lang", "source", *USED])


def statistics(docs: DataFrame) -> DataFrame:
    d = docs.select(F.col("doc_id").cast("long"), F.col("lang").cast("string"), F.col("source").cast("string"), F.col("text").cast("string"))
    return d.mapInArrow(released(count_statistics), "doc_id long, lang string, source string, " + ", ".join(f"{c} long" for c in USED))


def vector(of=F.col) -> list:
    """Logarithm of the words; mean word length; roots of the shares of symbols (of words), repeated lines (of lines) and repeated words."""
    n = F.greatest(of("n_words"), F.lit(1)).cast("double")
    share = lambda c, n: F.round(F.sqrt(F.least(of(c) / n, F.lit(4.0))), 6)
    return [F.round(F.log1p(of("n_words").cast("double")), 6), F.round(F.least(of("word_chars") / n, F.lit(60.0)), 6), share("n_symbols", n), share("n_dup_lines", F.greatest(of("n_lines"), F.lit(1)).cast("double")), share("n_repeat_words", n)]


def failing(of=F.col):
    return (of("n_words") < 50) | (100 * of("n_repeat_words") > 50 * of("n_words"))


def levels() -> list:
    """The groups of a row: by language and source, by language, and of all rows, as texts."""
    key = lambda *c: F.to_json(F.array(*[F.coalesce(F.col(x), F.lit("\x00")) for x in c]))
    return [key("lang", "source").alias("g2"), key("lang").alias("g1"), F.lit("[]").alias("g0")]


def chi2_cut(p: float, d: int) -> float:
    """Quantile of the chi-squared distribution by Wilson and Hilferty's approximation."""
    from statistics import NormalDist

    return d * (1 - 2 / (9 * d) + NormalDist().inv_cdf(p) * (2 / (9 * d)) ** 0.5) ** 3


def _chi2_cdf(x: float, d: int) -> float:
    from statistics import NormalDist

    return NormalDist().cdf(((x / d) ** (1 / 3) - (1 - 2 / (9 * d))) / (2 / (9 * d)) ** 0.5)


def full(upper: np.ndarray) -> np.ndarray:
    """Symmetric matrices from their upper parts, row by row."""
    out = np.zeros((len(upper), D, D))
    for k, (i, j) in enumerate(UP):
        out[:, i, j] = out[:, j, i] = upper[:, k]
    return out


def floored(cov: np.ndarray) -> np.ndarray:
    """Scatter of cores, raised by the chi-squared consistency factor, with FLOOR's variances added."""
    return cov * (CORE / _chi2_cdf(chi2_cut(CORE, D), D + 2)) + np.diag(np.square(FLOOR))


def whitening(cov: np.ndarray) -> np.ndarray:
    return np.round(np.linalg.inv(np.linalg.cholesky(cov)).reshape(len(cov), -1), 9) if len(cov) else np.zeros((0, D * D))


def stacked(column, width: int) -> np.ndarray:
    return np.stack(column.to_numpy()).astype(float) if len(column) else np.zeros((0, width))


def starts(groups):
    """Batches of (g, m, s, n, sums) to a start a row (g, start, mu, w): the axes alone, correlations of bounded values and of directions, and all rows' moments.

    m and s are medians and deviations; sums holds the products of bounded values, of directions, and of plain values, then the plain values.
    """
    for f in groups:
        m, s, n = stacked(f["m"], D), stacked(f["s"], D), np.maximum(f["n"].to_numpy(float), 1)[:, None]
        sums = stacked(f["sums"], 3 * len(UP) + D) / n
        tanh, sign, plain, mean = full(sums[:, : len(UP)]), full(sums[:, len(UP) : 2 * len(UP)]), full(sums[:, 2 * len(UP) : 3 * len(UP)]), sums[:, 3 * len(UP) :]
        eye = np.broadcast_to(np.eye(D), tanh.shape)
        scale = np.sqrt(np.maximum(np.einsum("gii->gi", tanh), 1e-9))
        every = plain - mean[:, :, None] * mean[:, None, :]
        for k, shape in enumerate((eye, tanh / (scale[:, :, None] * scale[:, None, :]), sign * D, every)):
            cov = np.einsum("gi,gij,gj->gij", s, (shape + 0.1 * eye) / 1.1 if k else shape, s)
            mu = m + s * mean if k == 3 else m
            yield pd.DataFrame({"g": f["g"], "start": k, "mu": list(np.round(mu, 9)), "w": list(whitening(cov))})


def moments(groups):
    """Batches of (g, start, n, sums, products) of cores to (g, start, n, mu, cov, w, det): det is the logarithm of the floored scatter's determinant."""
    for f in groups:
        n = f["n"].to_numpy(float)[:, None]
        mu = stacked(f["sums"], D) / n
        cov = full(stacked(f["products"], len(UP)) / n) - mu[:, :, None] * mu[:, None, :]
        up = np.stack([cov[:, i, j] for i, j in UP], 1) if len(f) else np.zeros((0, len(UP)))
        wide = floored(cov)
        yield pd.DataFrame({"g": f["g"], "start": f["start"], "n": f["n"], "mu": list(np.round(mu, 9)), "cov": list(np.round(up, 12)), "w": list(whitening(wide)), "det": np.linalg.slogdet(wide)[1] if len(f) else np.zeros(0)})


def distance(x, mu, w):
    """Squared Mahalanobis distance of x under mu and w."""
    rows = [sum((w[i * D + j] * (x[j] - mu[j]) for j in range(i + 1)), F.lit(0.0)) for i in range(D)]
    return sum((r * r for r in rows), F.lit(0.0))


def concentrated(points: DataFrame, state: DataFrame) -> DataFrame:
    """One concentration step: of each (g, start) of state the moments of the share CORE of points (g, x) that is nearest.

    The cut is a bin of a fine logarithmic histogram, so no group is ever sorted or gathered.
    """
    far = points.join(small(state.select("g", "start", "mu", "w")), "g").select("g", "start", "x", F.floor(F.log2(distance(F.col("x"), F.col("mu"), F.col("w")) + 1e-9) * BINS).cast("int").alias("bin"))
    bins = far.groupBy("g", "start", "bin").count()
    bins = bins.withColumn("upto", F.expr("sum(count) over (partition by g, start order by bin)")).withColumn("all", F.expr("sum(count) over (partition by g, start)"))
    cut = written(bins.filter(F.col("upto") >= CORE * F.col("all")).groupBy("g", "start").agg(F.min("bin").alias("cut")), "mcd-cut")
    core = far.join(small(cut), ["g", "start"]).filter("bin <= cut")
    sums = core.groupBy("g", "start").agg(F.count("*").alias("n"), F.array(*[F.sum(F.col("x")[i]) for i in range(D)]).alias("sums"), F.array(*[F.sum(F.col("x")[i] * F.col("x")[j]) for i, j in UP]).alias("products"))
    return written(sums.mapInPandas(moments, "g string, start int, n long, mu array<double>, cov array<double>, w array<double>, det double"), "mcd-step")


def estimate(points: DataFrame) -> DataFrame:
    """(g, n, mu, cov): rows, and centre and scatter (upper part) of the core of least determinant, of each group of points (g, x)."""
    grid = points.select("g", *[F.round(F.col("x")[i], 3).alias(f"x{i}") for i in range(D)])
    mid = small(written(grid.groupBy("g").agg(F.count("*").alias("n"), *[F.percentile(f"x{i}", F.lit(0.5)).alias(f"m{i}") for i in range(D)]), "mcd-median"))
    spread = grid.join(mid, "g").groupBy("g").agg(F.first("n").alias("n"), F.array(*[F.first(f"m{i}") for i in range(D)]).alias("m"), F.array(*[F.sqrt((F.percentile(F.round(F.abs(F.col(f"x{i}") - F.col(f"m{i}")), 3), F.lit(0.5)) * 1.4826) ** 2 + FLOOR[i] ** 2) for i in range(D)]).alias("s"))
    spread = written(spread, "mcd-spread")
    z = points.join(small(spread), "g").select("g", "m", "s", "n", *[((F.col("x")[i] - F.col("m")[i]) / F.col("s")[i]).alias(f"z{i}") for i in range(D)]).withColumn("norm", sum((F.col(f"z{i}") ** 2 for i in range(D)), F.lit(1e-9)))
    products = [F.sum(F.tanh(f"z{i}") * F.tanh(f"z{j}")) for i, j in UP] + [F.sum(F.col(f"z{i}") * F.col(f"z{j}") / F.col("norm")) for i, j in UP] + [F.sum(F.col(f"z{i}") * F.col(f"z{j}")) for i, j in UP] + [F.sum(f"z{i}") for i in range(D)]
    state = written(z.groupBy("g").agg(F.first("m").alias("m"), F.first("s").alias("s"), F.first("n").alias("n"), F.array(*products).alias("sums")).mapInPandas(starts, "g string, start int, mu array<double>, w array<double>"), "mcd-starts")
    for _ in range(FIRST):
        state = concentrated(points, state)
    columns = ("start", "n", "mu", "cov", "w", "det")
    best = lambda df: df.groupBy("g").agg(F.min_by(F.struct(*columns), F.struct("det", "start")).alias("b")).select("g", "b.*")
    done, live = None, best(state)
    while True:
        live = written(live, "mcd-live")
        after = concentrated(points, live).select("g", *[F.col(c).alias(f"new_{c}") for c in columns])
        both = written(live.join(after, "g").withColumn("fell", F.col("new_det") < F.col("det") - 1e-9), "mcd-both")  # a determinant that falls each time comes to an end
        ended = both.filter("not fell").select("g", *columns)
        done = ended if done is None else done.unionByName(ended)
        live = both.filter("fell").select("g", *[F.col(f"new_{c}").alias(c) for c in columns])
        if live.isEmpty():
            return written(done.join(small(spread.select("g", F.col("n").alias("rows"))), "g").select("g", F.col("rows").alias("n"), "mu", "cov"), "mcd")


def shrunk(groups):
    """Batches of a group's own estimate and those of its language and of all rows to centre and whitening matrix, each drawn towards the next."""
    for f in groups:
        mu, cov = stacked(f["mu0"], D), full(stacked(f["cov0"], len(UP)))
        for k in (1, 2):
            share = (f[f"n{k}"].to_numpy(float) / (f[f"n{k}"].to_numpy(float) + LEAST))[:, None]
            mu, cov = share * stacked(f[f"mu{k}"], D) + (1 - share) * mu, share[:, :, None] * full(stacked(f[f"cov{k}"], len(UP))) + (1 - share[:, :, None]) * cov
        yield pd.DataFrame({"g": f["g2"], "mu": list(np.round(mu, 9)), "w": list(whitening(floored(cov)))})


def fitted(counted: DataFrame) -> DataFrame:
    """(g, mu, w) of each language and source, g as in levels(), from all rows of statistics that pass the base rules."""
    rows = counted.filter(~failing()).select(*levels(), F.array(*vector()).alias("x"))
    found = estimate(rows.select(F.explode(F.array("g2", "g1", "g0")).alias("g"), "x"))
    groups = written(rows.select("g2", "g1", "g0").distinct(), "rules-groups")
    for k in range(3):
        groups = groups.join(small(found).select(F.col("g").alias(f"g{k}"), F.col("n").alias(f"n{k}"), F.col("mu").alias(f"mu{k}"), F.col("cov").alias(f"cov{k}")), f"g{k}")
    return written(groups.mapInPandas(shrunk, "g string, mu array<double>, w array<double>"), "rules-estimates")


def robust_rules(docs: DataFrame, cut: float = CUT) -> DataFrame:
    """Statistics, base_failed and kept for each row of docs (doc_id, lang, source, text); see the module's docstring."""
    counted = written(statistics(docs), "rules-statistics")
    state = fitted(counted)
    rows = counted.select("doc_id", *COUNTS, failing().alias("base_failed"), levels()[0].alias("g"), F.array(*vector()).alias("x"))
    far = F.when(~F.col("base_failed"), distance(F.col("x"), F.col("mu"), F.col("w")))
    out = rows.join(small(state), "g", "left").withColumn("distance", far)
    return out.select("doc_id", *COUNTS, "base_failed", (~F.col("base_failed") & ~F.coalesce(F.col("distance") > chi2_cut(cut, D), F.lit(False))).alias("kept"), "distance")


def keep_regular(docs: DataFrame, cut: float = CUT) -> DataFrame:
    """The rows of docs, whole, that robust_rules() keeps: each row by its own text. Only texts go through Python, twice, and no text is shuffled."""
    state = fitted(written(statistics(docs), "rules-statistics"))

    def counts(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in texts:
            data, offsets = text_bytes(column)
            found = [shape_counts(Words(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])) for i, j in slices(offsets)]
            yield pa.StructArray.from_arrays([pa.array(np.concatenate([f[c] for f in found] or [np.zeros(0, np.int64)])) for c in USED], list(USED))

    row, c = fresh(docs, "row"), fresh(docs, "counts")
    names = {k: F.col(row)[k].cast("string") for k in ("lang", "source")}
    of = lambda k: F.col(c)[k]
    counted = docs.select(F.struct("*").alias(row), F.arrow_udf(released(counts), ", ".join(f"{k} long" for k in USED))(F.col("text").cast("string")).alias(c)).filter(~failing(of))
    judged = counted.select(row, F.array(*vector(of)).alias("x"), *[v.alias(k) for k, v in names.items()]).select(row, "x", levels()[0].alias("g"))
    near = judged.join(small(state), "g", "left").filter(~F.coalesce(distance(F.col("x"), F.col("mu"), F.col("w")) > chi2_cut(cut, D), F.lit(False)))
    return near.select(f"{row}.*")
