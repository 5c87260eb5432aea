"""Bounded, reproducible samples of labelled rows for the classifiers."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def fold(modulus: int):
    """crc32 of doc_id as text, modulo modulus; a null doc_id counts as 0."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % modulus, F.lit(0))


def under(n: int, most: int):
    """A condition on doc_id's hash that leaves somewhat more than the `most` smallest of n hashes, so that few rows are ever sorted."""
    share = min(1.0, (most + 8 * most**0.5 + 50) / max(n, 1))
    return F.xxhash64("doc_id") <= F.lit(min((1 << 63) - 1, int(share * (1 << 64)) - (1 << 63)))


def sample(labels: DataFrame, label: str, train, most: int, balanced: bool = False) -> DataFrame:
    """(doc_id, y) of at most `most` labelled documents that satisfy train, those of the smallest hashes of doc_id.

    balanced: a third of the rows at most from class 1, the rest from class 0. A document labelled several times counts by its mean label; null
    labels are ignored.
    """
    given = labels.select(F.col("doc_id").cast("long"), F.col(label).cast("double").alias("y")).dropna().filter(train)
    once = lambda x: x.groupBy("doc_id").agg((F.avg("y") >= 0.5).cast("int").alias("y"))
    order = F.xxhash64("doc_id"), F.col("doc_id")
    counted = once(given).groupBy("y").count().collect()  # of two classes
    n = {r["y"]: r["count"] for r in counted}
    if not balanced:
        return once(given.filter(under(sum(n.values()), most))).orderBy(*order).limit(most)
    part = lambda y, k: once(given.filter(under(n.get(y, 0), k))).filter(F.col("y") == y).orderBy(*order).limit(k)
    return part(1, most // 3).unionByName(part(0, most - most // 3))


def texts_of(docs: DataFrame, chosen: DataFrame) -> DataFrame:
    """(doc_id, text, y) of the chosen documents. chosen is bounded by sample(), so it is broadcast."""
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).join(F.broadcast(chosen), "doc_id")
