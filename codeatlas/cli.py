"""Command line: index a tree, then ask the store."""

import argparse
import os
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.scalars import base_name, shortened
from .graph import watched
from .operators import lookups, paths, summaries, upserts
from .sources import index


VERSION = "1.0.0"


def session(name: str = "codeatlas") -> SparkSession:
    return SparkSession.builder.appName(name).getOrCreate()


def settings() -> dict[str, str]:
    """What the environment sets; a password is never shown."""
    found = {k: v for k, v in sorted(os.environ.items()) if k.startswith("CODEATLAS_")}
    return {k: "********" if "PASSWORD" in k else v for k, v in found.items()}


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="codeatlas")
    p.add_argument("--version", action="version", version=f"codeatlas {VERSION}")
    p.add_argument("--log-level", default="ERROR", choices=("DEBUG", "INFO", "WARN", "ERROR"))
    p.add_argument("--store", default=os.environ.get("CODEATLAS_STORE", "codeatlas-store"))
    sub = p.add_subparsers(dest="command", required=True)
    sub.add_parser("config")
    sub.add_parser("stats")
    c = sub.add_parser("index")
    c.add_argument("path")
    c.add_argument("--incremental", action="store_true")
    c.add_argument("--strict", action="store_true")
    c.add_argument("--clear", action="store_true", help="empty the store first, so that an incremental run parses everything")
    c.add_argument("--yes", "-y", action="store_true", help="don't ask before clearing")
    c = sub.add_parser("dependencies")
    c.add_argument("module")
    c.add_argument("--reverse", action="store_true")
    c = sub.add_parser("find-model")
    c.add_argument("model")
    c.add_argument("--fields", action="store_true")
    c.add_argument("--limit", type=int, default=20)
    c = sub.add_parser("list-models")
    c.add_argument("module")
    c = sub.add_parser("inheritance")
    c.add_argument("model")
    c.add_argument("--depth", type=int, default=5)
    c = sub.add_parser("find-field")
    c.add_argument("field")
    c.add_argument("--model")
    c.add_argument("--limit", type=int, default=20)
    c = sub.add_parser("dump", help="write a table of the store as JSON lines")
    c.add_argument("path")
    c.add_argument("--table", default="modules", choices=("modules", "models", "fields", "views", "edges"))
    c = sub.add_parser("sql")
    c.add_argument("text")
    return p


def answer(spark: SparkSession, a: argparse.Namespace) -> list[DataFrame]:
    """The tables that a command shows."""
    if a.command == "config":
        return [spark.createDataFrame(list(settings().items()) or [("CODEATLAS_STORE", a.store)], "name string, value string")]
    if a.command == "index":
        if a.clear and index.versions(spark, a.store) and (a.yes or input(f"Clear {a.store}? [y/N] ").lower() == "y"):
            index.clear(spark, a.store)
        if a.incremental:
            return [index.refresh(spark, a.path, a.store, a.strict)]
        begun = time.time()
        counts = index.save(index.extract(spark, a.path, a.strict), a.store)
        g = index.model_graph(index.load(spark, a.store))
        return [index.run_report(spark, counts, g.typed_edges().count(), time.time() - begun)]
    g = index.model_graph(index.load(spark, a.store))
    if a.command == "dump":
        df = g.typed_edges() if a.table == "edges" else getattr(g, a.table)
        df, seen = watched(df, n=F.count(F.lit(1)))
        upserts.dump_json(df, a.path)
        return [spark.createDataFrame([(a.table, seen.get["n"])], "table string, n long")]
    if a.command == "stats":
        return [summaries.statistics(g)]
    if a.command == "dependencies":
        return [(lookups.module_dependents if a.reverse else lookups.module_dependencies)(g, a.module)]
    if a.command == "find-model":
        return [lookups.ranked_definitions(g, a.model)] + (limited(lookups.model_fields(g, a.model), a.limit) if a.fields else [])
    if a.command == "list-models":
        m = lookups.models_in_module(g, a.module)
        return [m.select("name", shortened(F.col("description"), 50).alias("description"), base_name(F.col("file_path")).alias("file"))]
    if a.command == "inheritance":
        return [paths.ancestors(g, a.model, a.depth).filter(F.col("parent") != a.model), lookups.model_children(g, a.model)]
    if a.command == "find-field":
        return limited(lookups.find_field(g, a.field, a.model), a.limit)
    return [g.sql(a.text)]


def show(df: DataFrame) -> None:
    """Prints all rows, a partition at a time."""
    print(" | ".join(df.columns))
    n = 0
    for n, row in enumerate(df.toLocalIterator(), 1):
        print(" | ".join("" if x is None else str(x) for x in row))
    print(f"({n} rows)")


def limited(df: DataFrame, limit: int) -> list[DataFrame]:
    """The first rows, and how many there are of how many."""
    n = df.count()
    return [df.limit(limit), df.sparkSession.createDataFrame([(min(n, limit), n)], "showing long, of long")]


def main(argv: list[str] | None = None) -> int:
    a = parser().parse_args(argv)
    spark = session()
    spark.sparkContext.setLogLevel(a.log_level)
    for df in answer(spark, a):
        show(df)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
