"""From a tree of source files to a graph, in full or only for the files that changed."""

import json
import time
from collections.abc import Collection
from dataclasses import dataclass, fields as columns_of

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..graph import Graph, settled, watched
from ..operators import changes, upserts
from . import files, records, syntax, tree


@dataclass(frozen=True)
class Extracted:
    """Records with the file that each comes from (file_path), and the state of all files seen."""

    modules: DataFrame
    defs: DataFrame
    fields: DataFrame
    views: DataFrame
    broken: DataFrame
    state: DataFrame


def extract(spark: SparkSession, root: str, strict: bool = False, intended: bool = True, max_depth: int | None = 3, known: DataFrame | None = None) -> Extracted:
    """Records of a tree. known: a former state; files with an unchanged hash are then not parsed again.

    Module rows and the owners of files always cover the whole tree, as they decide what every other file belongs to. Only the strict reading
    leaves out files that are too large.
    """
    listed = settled(files.listing(spark, root, hidden=strict), "tree")
    found = settled(files.module_directories(listed, max_depth, inclusive=not strict, hidden=strict), "modules")
    under = lambda c, most: F.col(c) <= most if strict else F.lit(True)
    manifests = syntax.parse_manifests(files.contents(found.filter(under("manifest_bytes", files.MANIFEST_BYTES)).select(F.col("manifest").alias("path")), root))
    modules = settled(records.modules(found, manifests, strict), "module-records")
    inside = settled(files.module_files(listed, found).filter(files.is_watched_file()), "module-files")
    state = settled(files.states(inside, root, time.time()), "state")
    if known is not None:
        inside = inside.join(changes.changed(known, state).select("path"), "path", "left_semi")
    python = inside.filter(files.is_model_file(strict) & under("length", files.PYTHON_BYTES))
    xml = inside.filter(files.is_view_file() & under("length", files.XML_BYTES))
    own = ("module",)
    classes = settled(syntax.parse_classes(files.contents(python, root, own), strict, own), "classes")
    found_views = settled(syntax.parse_records(files.contents(xml, root, own), own), "records")
    defs = records.model_definitions(classes, strict=strict)
    owners = defs if strict else _field_owners(defs, intended)
    return Extracted(modules, defs.withColumn("n_fields", F.size("raw_fields")).drop("raw_fields"), records.fields(owners, strict, intended), records.views(found_views, intended=intended), records.broken(classes).unionByName(records.broken(found_views)), state)


def _field_owners(defs: DataFrame, intended: bool) -> DataFrame:
    """The classes whose fields count, named by the model that gets them: with intended=True extensions add to what they extend."""
    if not intended:
        return records.defining(defs)
    own = F.coalesce(F.when(F.col("own_name") != "", F.col("own_name")), F.get("inherits", F.lit(0)))
    return defs.withColumn("name", own).filter("name is not null")


def model_graph(x: Extracted) -> Graph:
    """Models by name alone: the last definition by path and line wins, and edges need both ends."""
    place = ("file_path", "line_number")
    modules = settled(upserts.last_writer(x.modules, ["name"], ["file_path"]), "modules")
    defined = records.defining(x.defs)
    models = settled(upserts.last_writer(defined.select("name", "description", "module", "file_path", "line_number", "class_name"), ["name"], place), "models")
    fields = upserts.last_writer(x.fields, ["name", "model_name"], place)
    fields = settled(fields.join(models.select(F.col("name").alias("model_name")), "model_name", "left_semi"), "fields")  # each edge type reads them
    views = settled(upserts.last_writer(x.views, ["xml_id"], ("file_path", "position")), "views")
    link = upserts.linked
    edges = {
        "DEPENDS_ON": link(modules.select(F.col("name").alias("src"), F.explode("depends").alias("dst")), modules, modules),
        "DEFINED_IN": link(defined.select(F.col("name").alias("src"), F.col("module").alias("dst")), models, modules),
        "INHERITS_FROM": link(defined.select(F.col("name").alias("src"), F.explode("inherits").alias("dst")), models, models),
        "DELEGATES_TO": link(defined.select(F.col("name").alias("src"), F.explode("inherits_delegation").alias("dst", "field")), models, models),
        "BELONGS_TO": fields.select(F.col("model_name").alias("src"), F.col("model_name").alias("dst"), F.col("name").alias("field")),
        "REFERENCES": link(fields.filter("comodel_name is not null").select(F.col("model_name").alias("src"), F.col("comodel_name").alias("dst"), F.col("name").alias("field")), models, models),
        "DISPLAYS": link(views.filter("model <> ''").select(F.col("xml_id").alias("src"), F.col("model").alias("dst")), views, models, "xml_id"),
        "EXTENDS": link(views.filter("inherit_id is not null").select(F.col("xml_id").alias("src"), F.col("inherit_id").alias("dst")), views, views, "xml_id", "xml_id"),
    }
    return Graph(modules, models, fields, views, edges)


def class_graph(x: Extracted, by_display_name: bool = False) -> Graph:
    """Models by name and module, extensions included: nodes are named module:name, INHERITS joins all definitions of equal names.

    by_display_name: modules are keyed by the name in their manifest, as that reading's loader has them, and not by their directory; what names a
    directory that is no such name then finds no module.
    """
    place = ("file_path", "line_number")
    named = x.modules.withColumn("name", F.col("display_name")) if by_display_name else x.modules
    modules = upserts.last_writer(named, ["name"], ["file_path"])
    node = F.concat_ws(":", "module", "name")
    models = upserts.last_writer(x.defs.drop("own_name"), ["name", "module"], place).withColumn("label", F.col("name")).withColumn("name", node)
    views = upserts.last_writer(x.views, ["xml_id"], ("file_path", "position"))
    fields = upserts.last_writer(x.fields, ["name", "model_name"], place)
    pairs = upserts.inherits_by_name(x.defs).select(F.concat_ws(":", "src_module", "src").alias("src"), F.concat_ws(":", "dst_module", "dst").alias("dst"))
    shown = views.filter("model <> ''").select(F.col("xml_id").alias("src"), "model").join(models.select(F.col("label").alias("model"), F.col("name").alias("dst")), "model").select("src", "dst").distinct()
    held = models.select(F.col("module").alias("src"), F.col("name").alias("dst")).unionByName(views.select(F.col("module").alias("src"), F.col("xml_id").alias("dst")))
    edges = {
        "CONTAINS": held.join(modules.select(F.col("name").alias("src")), "src", "left_semi").distinct(),
        "INHERITS": pairs,
        "INHERITS_FROM": pairs,
        "DEFINED_IN": models.select(F.col("name").alias("src"), F.col("module").alias("dst")),
        "DEPENDS_ON": upserts.linked(modules.select(F.col("name").alias("src"), F.explode("depends").alias("dst")), modules, modules),
        "DISPLAYS": shown,
        "EXTENDS": upserts.linked(views.filter("inherit_id is not null").select(F.col("xml_id").alias("src"), F.col("inherit_id").alias("dst")), views, views, "xml_id", "xml_id"),
    }
    return Graph(modules, models, fields, views, edges)


# ---- a store of extracted records: tables in buckets by a hash of the file's path, in versions, so that a reader never meets a half-written one

#: Buckets of a new store. A refresh writes the buckets that a changed file falls into; all others stay with the version that wrote them.
BUCKETS = 32
#: The column with the file that a row comes from.
PATH_OF = {"modules": "file_path", "defs": "file_path", "fields": "file_path", "views": "file_path", "broken": "path", "state": "path"}
MAP, RUN = "version long, bucket int, at long", "version long, name string, n long"


def bucket_of(path: str, buckets: int) -> Column:
    """The bucket of a file; records without one are in bucket 0."""
    return F.coalesce(F.pmod(F.xxhash64(path), F.lit(buckets)), F.lit(0)).cast("int")


def _map(spark: SparkSession, store: str) -> DataFrame:
    """Which version wrote each bucket, as each version sees it."""
    return spark.read.schema(MAP).parquet(f"{store}/versions")


def _there(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def _children(spark: SparkSession, path: str) -> set[str]:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    return {x.getPath().getName() for x in fs.listStatus(at)} if fs.exists(at) else set()


def versions(spark: SparkSession, store: str) -> list[int]:
    return sorted(r[0] for r in _map(spark, store).select("version").distinct().collect()) if _there(spark, f"{store}/versions") else []


def _write(x: Extracted, store: str, version: int, buckets: int) -> dict[str, int]:
    """Writes all rows of x under a version, by bucket; counts of rows, and of errors, taken while they are written."""
    counts, tasks = {}, min(buckets, int(x.modules.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    for c in columns_of(Extracted):
        df = getattr(x, c.name)
        metrics = {"n": F.count(F.lit(1)), "errors": F.coalesce(F.sum(F.size("errors")), F.lit(0)) if c.name == "modules" else F.lit(0)}
        placed, seen = watched(df.withColumn("bucket", bucket_of(PATH_OF[c.name], buckets)).repartition(tasks, "bucket"), **metrics)
        placed.write.mode("overwrite").partitionBy("bucket").parquet(f"{store}/version={version}/{c.name}")
        counts[c.name] = seen.get["n"]
        counts["errors"] = counts.get("errors", 0) + seen.get["errors"] + (counts["broken"] if c.name == "broken" else 0)
    return counts


def save(x: Extracted, store: str, buckets: int = BUCKETS) -> dict[str, int]:
    """Writes a new version of everything and only then lists it. The run's counts, which are stored too."""
    spark = x.modules.sparkSession
    version = max(versions(spark, store), default=0) + 1
    counts = _write(x, store, version, buckets)
    kinds = [(version, c.name, getattr(x, c.name).schema.json()) for c in columns_of(Extracted)]
    spark.createDataFrame(kinds, "version long, name string, schema string").coalesce(1).write.mode("append").parquet(f"{store}/schemas")
    _list(spark, store, version, dict.fromkeys(range(buckets), version), counts)
    return counts


def _list(spark: SparkSession, store: str, version: int, at: dict[int, int], counts: dict[str, int]) -> None:
    spark.createDataFrame([(version, k, n) for k, n in counts.items()], RUN).coalesce(1).write.mode("append").parquet(f"{store}/runs")
    spark.createDataFrame([(version, b, v) for b, v in at.items()], MAP).coalesce(1).write.mode("append").parquet(f"{store}/versions")


def runs(spark: SparkSession, store: str) -> DataFrame:
    """version, name, n: what each run has written, and its errors."""
    return spark.read.schema(RUN).parquet(f"{store}/runs")


def _at(spark: SparkSession, store: str, version: int | None) -> dict[int, int]:
    have = versions(spark, store)
    if not have:
        raise FileNotFoundError(f"no index in {store}")
    return {r["bucket"]: r["at"] for r in _map(spark, store).filter(F.col("version") == (version or have[-1])).collect()}


def load(spark: SparkSession, store: str, version: int | None = None, buckets: Collection[int] | None = None) -> Extracted:
    """The newest version, or another one; all of it, or some buckets alone."""
    from pyspark.sql.types import StructType

    at = _at(spark, store, version)
    kinds = {r["name"]: r["schema"] for r in spark.read.parquet(f"{store}/schemas").orderBy("version").collect()}
    out = []
    for c in columns_of(Extracted):
        written = {v: _children(spark, f"{store}/version={v}/{c.name}") for v in set(at.values())}
        places = [f"{store}/version={v}/{c.name}/bucket={b}" for b, v in sorted(at.items()) if (buckets is None or b in buckets) and f"bucket={b}" in written[v]]
        schema = StructType.fromJson(json.loads(kinds[c.name]))
        out.append(spark.read.schema(schema).parquet(*places) if places else spark.createDataFrame([], schema))
    return Extracted(*out)


def clear(spark: SparkSession, store: str) -> dict[str, int]:
    """A new version without records; earlier versions stay readable by number."""
    at = _at(spark, store, None)
    x = load(spark, store)
    return save(Extracted(*[getattr(x, c.name).limit(0) for c in columns_of(Extracted)]), store, len(at))


def refresh(spark: SparkSession, root: str, store: str, strict: bool = False, intended: bool = True, max_depth: int | None = 3) -> DataFrame:
    """Brings a store up to date: only new and modified files are parsed, records of deleted ones go. Returns change, n.

    Only the buckets of changed files are read and written again. A file that fails to parse loses its former records and is listed as broken; it
    is parsed again when it changes. Without changes no version is made.
    """
    if not versions(spark, store):
        counts = save(extract(spark, root, strict, intended, max_depth), store)
        return spark.createDataFrame([("new", counts["state"])], "change string, n long")
    at = _at(spark, store, None)
    old = load(spark, store)
    new = extract(spark, root, strict, intended, max_depth, old.state)
    told = settled(changes.changes(old.state, new.state), "changes")
    # a module's record also changes when the preferred one of its manifests does
    kinds = old.modules.columns
    differ = lambda a, b: a.select(*kinds).exceptAll(b.select(*kinds)).select(F.col("file_path").alias("path"))
    stale = told.filter("change <> 'unchanged'").select("path").unionByName(differ(old.modules, new.modules)).unionByName(differ(new.modules, old.modules))
    touched = {r[0] for r in stale.select(bucket_of("path", len(at)).alias("b")).distinct().collect()}
    out = told.groupBy("change").agg(F.count("*").alias("n"))
    if not touched:
        return out
    moved = settled(told.filter("change <> 'unchanged'").select("path"), "moved")
    part = load(spark, store, None, touched)

    def merged(name: str) -> DataFrame:
        a, b, key = getattr(part, name), getattr(new, name), PATH_OF[name]
        within = b.filter(bucket_of(key, len(at)).isin(*touched))
        if name == "modules":
            return within
        within = within.join(moved.select(F.col("path").alias(key)), key, "left_semi") if name == "state" else within
        return a.join(moved.select(F.col("path").alias(key)), key, "left_anti").select(*a.columns).unionByName(within.select(*a.columns))

    version = max(at.values()) + 1
    version = max(version, versions(spark, store)[-1] + 1)
    counts = _write(Extracted(*[merged(c.name) for c in columns_of(Extracted)]), store, version, len(at))
    _list(spark, store, version, at | dict.fromkeys(touched, version), counts)
    return out


def find_module(spark: SparkSession, root: str, name: str, strict: bool = True, max_depth: int | None = 3) -> DataFrame:
    """The record of one module of a tree, by the name of its directory. The walk stays out of modules, and only manifests of that name are opened."""
    most = {"contentBytes": files.MANIFEST_BYTES} if strict else {}
    rows = tree.read(spark, root, hidden=strict, prune=",".join(files.MANIFESTS), content=True, partitions=spark.sparkContext.defaultParallelism, **most).filter(F.col("name").isin(*files.MANIFESTS) & ~F.col("is_dir") & (F.col("directory") == name))
    if max_depth is not None:
        rows = rows.filter(F.col("depth") < max_depth if strict else F.col("depth") <= max_depth)
    rows = rows.groupBy("parent").agg(F.min(F.struct(F.array_position(F.array(*map(F.lit, files.MANIFESTS)), F.col("name")).alias("k"), "path", "directory", "name", "length", "content")).alias("m")).select("m.*")
    found = settled(rows.select(F.col("directory").alias("module"), F.col("path").alias("manifest"), F.col("name").alias("manifest_file"), F.col("length").alias("manifest_bytes"), "content"), "found")
    return records.modules(found.drop("content"), syntax.parse_manifests(found.filter("content is not null").select(F.col("manifest").alias("path"), "content")), strict)


def run_report(spark: SparkSession, counts: dict[str, int], relationships: int, seconds: float) -> DataFrame:
    """name, n of a run, from what was counted while its records and edges were written: no table is read again."""
    rows = [(k, float(n)) for k, n in counts.items()] + [("relationships", float(relationships)), ("seconds", float(seconds))]
    return spark.createDataFrame(rows, "name string, n double")


def run_counts(x: Extracted) -> DataFrame:
    """name, n: what a run has found."""
    out = None
    for name in ("modules", "defs", "fields", "views", "broken", "state"):
        part = getattr(x, name).agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n")
        out = part if out is None else out.unionByName(part)
    return out
