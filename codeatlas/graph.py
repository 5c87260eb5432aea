"""The property graph as DataFrames: one for each node label, one for each edge type."""

import tempfile
import uuid
from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

EDGE_TYPES = ("DEPENDS_ON", "INHERITS_FROM", "DELEGATES_TO", "DEFINED_IN", "BELONGS_TO", "REFERENCES", "CONTAINS", "INHERITS", "DISPLAYS", "EXTENDS")
NODE_KEYS = {"modules": ("name",), "models": ("name",), "fields": ("name", "model_name"), "views": ("xml_id",)}


@dataclass(frozen=True)
class Graph:
    """Node tables with the columns of sources.schemas, and edges (src, dst, and field for delegation) by type."""

    modules: DataFrame
    models: DataFrame
    fields: DataFrame
    views: DataFrame
    edges: Mapping[str, DataFrame] = field(default_factory=dict)
    #: All edges in one table (src, dst, rel_type, field), where they are stored so: counts over types then take one scan.
    edge_table: DataFrame | None = None

    @property
    def spark(self) -> SparkSession:
        return self.modules.sparkSession

    def typed_edges(self, *types: str) -> DataFrame:
        """(src, dst, rel_type, field) over several edge types."""
        if self.edge_table is not None:
            return self.edge_table.filter(F.col("rel_type").isin(*types)) if types else self.edge_table
        out = None
        for t in types or tuple(self.edges):
            e = self.edges[t]
            part = e.select(F.col("src").cast("string"), F.col("dst").cast("string"), F.lit(t).alias("rel_type"), (F.col("field") if "field" in e.columns else F.lit(None)).cast("string").alias("field"))
            out = part if out is None else out.unionByName(part)
        return out

    def sql(self, text: str, args: Mapping[str, object] | None = None) -> DataFrame:
        """Ad-hoc SQL over the views modules, models, fields, views and edges, with named arguments."""
        for name in ("modules", "models", "fields", "views"):
            getattr(self, name).createOrReplaceTempView(name)
        self.typed_edges().createOrReplaceTempView("edges")
        return self.spark.sql(text, args=dict(args or {}))


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; only where that is unset in local mode (tests), a new one of our own."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise RuntimeError("on a cluster spark.checkpoint.dir must name a folder that all executors share")
        found = tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def settled(df: DataFrame, name: str = "step") -> DataFrame:
    """df written once to the shared folder and read back, so that later steps don't repeat it and lost executors don't matter."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def watched(df: DataFrame, **metrics: Column) -> tuple[DataFrame, Observation]:
    """df, and aggregates of its rows that are there, as .get, once an action has gone over them."""
    seen = Observation()
    return df.observe(seen, *[m.alias(k) for k, m in metrics.items()]), seen


def observed(df: DataFrame, name: str = "step", **metrics: Column) -> tuple[DataFrame, dict]:
    """df settled, and aggregates of its rows taken while they were written."""
    df, seen = watched(df, **metrics)
    out = settled(df, name)
    return out, seen.get
