"""Writing nodes and edges: last writer wins by key, edges need both ends, at most one edge of a type between two nodes."""

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..graph import NODE_KEYS, Graph, watched


def last_writer(rows: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """One row a key, the greatest in order (ties by the other columns that have an order). It combines before the shuffle, and no key is sorted."""
    rest = [c for c in rows.columns if c not in keys]
    plain = [c for c in rest if c not in order and "map<" not in rows.schema[c].dataType.simpleString()]
    picked = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order, *plain)).alias("r"))
    return picked.select(*keys, *[F.col(f"r.{c}").alias(c) for c in rest])


def upsert(existing: DataFrame, new: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The snapshot after writing new rows: theirs where they have a key, the old ones elsewhere."""
    latest = last_writer(new, keys, order).select(*existing.columns)
    return existing.join(latest, list(keys), "left_anti").select(*existing.columns).unionByName(latest)


def linked(edges: DataFrame, sources: DataFrame, targets: DataFrame, source_key: str = "name", target_key: str = "name", tasks: int | None = None) -> DataFrame:
    """Distinct edges (src, dst, ...) whose two ends exist; the others are dropped silently. tasks: partitions to work in, for edges that are too many for the session's."""
    ends = lambda df, key, name: df.select(F.col(key).alias(name)).distinct()
    dealt = lambda df, key: df.repartition(tasks, key) if tasks else df
    once = dealt(edges, "src").distinct().join(ends(sources, source_key, "src"), "src", "left_semi")
    return dealt(once, "dst").join(ends(targets, target_key, "dst"), "dst", "left_semi").select(*edges.columns)


def dangling(edges: DataFrame, sources: DataFrame, targets: DataFrame, source_key: str = "name", target_key: str = "name") -> DataFrame:
    """The edges that linked() drops, with which end is missing."""
    s = sources.select(F.col(source_key).alias("src")).distinct().withColumn("has_src", F.lit(True))
    t = targets.select(F.col(target_key).alias("dst")).distinct().withColumn("has_dst", F.lit(True))
    both = edges.distinct().join(s, "src", "left").join(t, "dst", "left")
    return both.filter("has_src is null or has_dst is null").select("src", "dst", F.col("has_src").isNull().alias("src_missing"), F.col("has_dst").isNull().alias("dst_missing"))


def inherits_by_name(defs: DataFrame) -> DataFrame:
    """Edges between all definitions of a child's name and all of a parent's name: (src, src_module, dst, dst_module)."""
    child = defs.select(F.col("name").alias("src"), F.col("module").alias("src_module"), F.explode("inherits").alias("dst"))
    parent = defs.select(F.col("name").alias("dst"), F.col("module").alias("dst_module")).distinct()
    return child.join(parent, "dst").select("src", "src_module", "dst", "dst_module").distinct()


def violations(graph: Graph) -> DataFrame:
    """Keys that occur more than once, or are null: table, key, n. Empty if all uniqueness constraints hold."""
    out = None
    for name, keys in NODE_KEYS.items():
        df = getattr(graph, name)
        part = df.groupBy(*keys).agg(F.count("*").alias("n")).filter((F.col("n") > 1) | F.greatest(*[F.col(k).isNull() for k in keys], F.lit(False)))
        part = part.select(F.lit(name).alias("table"), F.to_json(F.array(*[F.col(k).cast("string") for k in keys])).alias("key"), "n")
        out = part if out is None else out.unionByName(part)
    return out


#: The columns that nodes are sorted by.
ORDER: Mapping[str, Sequence[str]] = {"modules": ("category", "name"), "models": ("module", "name"), "fields": ("model_name", "field_type", "name"), "views": ("module", "xml_id")}
EDGES = "src string, dst string, field string, rel_type string"


def save_nodes(name: str, nodes: DataFrame, path: str, mode: str = "overwrite") -> int:
    """Writes one of a graph's node tables; how many rows it has."""
    laid, seen = watched(nodes.sortWithinPartitions(*[c for c in ORDER[name] if c in nodes.columns]), n=F.count(F.lit(1)))
    laid.write.mode(mode).parquet(f"{path}/{name}")
    return seen.get["n"]


def save_edges(rel_type: str, edges: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Writes the edges of one type, as a partition of the edge table."""
    only = Graph(edges, edges, edges, edges, {rel_type: edges}).typed_edges(rel_type).drop("rel_type")
    only.sortWithinPartitions("src", "dst").write.mode(mode).parquet(f"{path}/edges/rel_type={rel_type}")


def load_edges(spark: SparkSession, path: str, *types: str) -> DataFrame:
    """(src, dst, rel_type, field) of the saved edges of some types, or of all."""
    places = [f"{path}/edges/rel_type={t}" for t in types] or [f"{path}/edges"]
    return spark.read.schema(EDGES).option("basePath", f"{path}/edges").parquet(*places).select("src", "dst", "rel_type", "field")


def save(graph: Graph, path: str, mode: str = "overwrite") -> dict[str, int]:
    """Writes the graph as Parquet tables under a path, the rows of each file sorted by what queries look up, which stands in for indexes. Rows of each table, counted on the way.

    Rows stay in the partitions that they are in: to find ranges for them, Spark would make every table twice.
    """
    counts = {name: save_nodes(name, getattr(graph, name), path, mode) for name in ORDER}
    laid, seen = watched(graph.typed_edges().sortWithinPartitions("rel_type", "src", "dst"), n=F.count(F.lit(1)))
    laid.write.mode(mode).partitionBy("rel_type").parquet(f"{path}/edges")
    return counts | {"edges": seen.get["n"]}


def load(spark, path: str, types: Sequence[str]) -> Graph:
    """A saved graph. Edges of a type are a partition of one table, so a query reads only the types that it names."""
    table = load_edges(spark, path)
    return Graph(*[spark.read.parquet(f"{path}/{n}") for n in ("modules", "models", "fields", "views")], {t: table.filter(F.col("rel_type") == t).select("src", "dst", "field") for t in types}, table)


def verify_schema(graph: Graph) -> DataFrame:
    """constraint, table, key, holds: of each uniqueness constraint whether its table has the columns, and every key once and without nulls."""
    out = None
    for name, keys in NODE_KEYS.items():
        df = getattr(graph, name)
        if set(keys) <= set(df.columns):
            bad = df.groupBy(*keys).agg(F.count("*").alias("n")).agg(F.coalesce(F.max((F.col("n") > 1) | F.greatest(*[F.col(k).isNull() for k in keys], F.lit(False))), F.lit(False)).alias("bad"))
        else:
            bad = graph.spark.range(1).select(F.lit(True).alias("bad"))
        part = bad.select(F.lit(f"{name}_unique").alias("constraint"), F.lit(name).alias("table"), F.lit(",".join(keys)).alias("key"), (~F.col("bad")).alias("holds"))
        out = part if out is None else out.unionByName(part)
    return out


def dump_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)
