"""Counts over the graph and over extracted records."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..graph import EDGE_TYPES, Graph

LABELS = (("Module", "modules"), ("Model", "models"), ("Field", "fields"), ("View", "views"))


def node_counts(graph: Graph) -> DataFrame:
    """label, n for every label, zero if there are none."""
    out = None
    for label, name in LABELS:
        part = getattr(graph, name).agg(F.count("*").alias("n")).select(F.lit(label).alias("label"), "n")
        out = part if out is None else out.unionByName(part)
    return out


def edge_counts(graph: Graph, types: tuple[str, ...] = EDGE_TYPES) -> DataFrame:
    """rel_type, n for every type, zero if there are none."""
    if graph.edge_table is not None:
        names = graph.spark.createDataFrame([(t,) for t in types], "rel_type string")
        found = graph.typed_edges(*types).groupBy("rel_type").agg(F.count("*").alias("n"))
        return names.join(F.broadcast(found), "rel_type", "left").select("rel_type", F.coalesce("n", F.lit(0).cast("long")).alias("n"))  # a row a type
    out = None
    for t in types:
        part = (graph.edges[t].agg(F.count("*").alias("n")) if t in graph.edges else graph.spark.range(1).select(F.lit(0).cast("long").alias("n"))).select(F.lit(t).alias("rel_type"), "n")
        out = part if out is None else out.unionByName(part)
    return out


def statistics(graph: Graph) -> DataFrame:
    """Counts of labels and edge types, and the totals of both: kind, name, n."""
    nodes = node_counts(graph).select(F.lit("node").alias("kind"), F.col("label").alias("name"), "n")
    edges = edge_counts(graph, tuple(graph.edges)).select(F.lit("edge").alias("kind"), F.col("rel_type").alias("name"), "n")
    both = nodes.unionByName(edges)
    return both.rollup("kind", "name").agg(F.sum("n").alias("n")).filter("kind is not null").select("kind", F.coalesce("name", F.lit("total")).alias("name"), "n")


def overview(graph: Graph) -> DataFrame:
    """One row of five counts, or none if models, fields, dependencies or inheritances are missing."""
    counts = {"modules": graph.modules, "models": graph.models, "fields": graph.fields, "dependencies": graph.edges["DEPENDS_ON"], "inheritances": graph.edges["INHERITS_FROM"]}
    out = None
    for name, df in counts.items():
        part = df.agg(F.count("*").alias(name))
        out = part if out is None else out.crossJoin(part)  # of single rows
    return out.filter(" and ".join(f"{name} > 0" for name in list(counts)[1:]))


def models_by_type(defs: DataFrame) -> DataFrame:
    return defs.groupBy("model_type").agg(F.count("*").alias("n"))


def top_modules(records: DataFrame, n: int = 10) -> DataFrame:
    """module, n of the modules with most records; ties by descending name."""
    return records.groupBy("module").agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("module")).limit(n)


def module_complexity(defs: DataFrame, n: int = 10) -> DataFrame:
    """module, models, total_fields of the modules with most models. defs: (module, n_fields), one row a model."""
    return defs.groupBy("module").agg(F.count("*").alias("models"), F.sum("n_fields").alias("total_fields")).orderBy(F.desc("models"), F.desc("module")).limit(n)


def inheriting_from(defs: DataFrame, parent: str) -> DataFrame:
    """A row for each time that a definition names the parent."""
    return defs.withColumn("p", F.explode("inherits")).filter(F.col("p") == parent).drop("p")


def with_several_parents(defs: DataFrame, more_than: int = 1) -> DataFrame:
    return defs.filter(F.size("inherits") > more_than)


def without_description(defs: DataFrame) -> DataFrame:
    return defs.filter(F.col("description") == "")


def large_models(defs: DataFrame, more_than: int = 20) -> DataFrame:
    return defs.filter(F.col("n_fields") > more_than)


def orphan_views(views: DataFrame) -> DataFrame:
    return views.filter(F.col("model") == "")


def label_counts(graph: Graph) -> DataFrame:
    return node_counts(graph).select(F.array("label").alias("labels"), "n")
