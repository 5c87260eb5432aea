"""Trees of files as DataFrames, listed by the data source of tree.py; contents are read only for the files that a predicate leaves over."""

from collections.abc import Sequence

import pyarrow as pa
from pyarrow import fs as arrow_fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import tree
from .tree import ModuleRootError
from .tree import file_system as _file_system

#: Fixed names of manifest files, the preferred one first.
MANIFESTS = ("__manifest__.py", "__openerp__.py")
#: Largest sizes in bytes: of a manifest, a Python file and an XML file.
MANIFEST_BYTES, PYTHON_BYTES, XML_BYTES = 1 << 20, 1 << 20, 10 << 20


def listing(spark: SparkSession, root: str, hidden: bool = False) -> DataFrame:
    """All entries below a root (path, parent, name, is_dir, length, modified, depth), paths relative to it; dot-directories only if hidden.

    depth is the number of directories above an entry, so files of the root have depth 0.
    """
    fs, base = _file_system(root)
    if fs.get_file_info(base).type != arrow_fs.FileType.Directory:
        raise ModuleRootError(f"no such directory: {root}")
    return tree.read(spark, root, hidden=hidden).drop("directory", "content")


def contents(files: DataFrame, root: str, keep: Sequence[str] = ()) -> DataFrame:
    """path, the columns to keep and content of listed files, many files a batch; those that can't be read are left out."""

    def read(batches):
        system, top = _file_system(root)
        for batch in batches:
            at, found, size = [], [], 0

            def rows():
                return pa.RecordBatch.from_arrays([*(c.take(pa.array(at, pa.int64())) for c in batch.columns), pa.array(found, pa.binary())], [*batch.schema.names, "content"])

            for k, path in enumerate(batch.column(0).to_pylist()):
                try:
                    with system.open_input_stream(f"{top.rstrip('/')}/{path}") as f:
                        found.append(f.read())
                except OSError:
                    continue
                at.append(k)
                size += len(found[-1])
                if size >= tree.BYTES:
                    yield rows()
                    at, found, size = [], [], 0
            if at:
                yield rows()

    files = files.select("path", *keep)
    return files.mapInArrow(read, T.StructType([*files.schema.fields, T.StructField("content", T.BinaryType())]))


def ancestors(path: Column) -> Column:
    """The directories above a relative path, the root as an empty string first."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda i: F.array_join(F.slice(parts, 1, i), "/"))


def module_directories(listed: DataFrame, max_depth: int | None = 3, inclusive: bool = True, hidden: bool = False) -> DataFrame:
    """module, directory, manifest, manifest_file and manifest_bytes of each directory with a manifest, but none inside another module.

    max_depth bounds the depth of the directory under the root; inclusive tells whether that depth itself still counts. Unless hidden,
    directories below a dot-directory don't count.
    """
    m = listed.filter(~F.col("is_dir") & F.col("name").isin(*MANIFESTS))
    if max_depth is not None:
        m = m.filter((F.col("depth") <= max_depth) if inclusive else (F.col("depth") < max_depth))
    if not hidden:
        m = m.filter(~F.exists(F.split("parent", "/"), lambda x: x.startswith(".")))
    preferred = F.struct(F.array_position(F.array(*map(F.lit, MANIFESTS)), F.col("name")), "path", "name", "length")
    found = m.groupBy(F.col("parent").alias("directory")).agg(F.min(preferred).alias("m"))
    found = found.select("directory", F.col("m.path").alias("manifest"), F.col("m.name").alias("manifest_file"), F.col("m.length").alias("manifest_bytes"))
    above = found.filter("directory <> ''").select("directory", F.explode(ancestors(F.col("directory"))).alias("above"))
    nested = above.join(found.select(F.col("directory").alias("above")), "above", "left_semi").select("directory").distinct()
    return found.join(nested, "directory", "left_anti").select(F.element_at(F.split("directory", "/"), -1).alias("module"), "directory", "manifest", "manifest_file", "manifest_bytes")


def module_files(listed: DataFrame, modules: DataFrame) -> DataFrame:
    """The files below each module: the listing's columns, module, and inside (the path below the module's directory)."""
    owners, listed = modules.select("module", "directory"), listed.filter(~F.col("is_dir"))
    # the root is above every file: as a key of the join it would bring all files to one task
    above = listed.withColumn("directory", F.explode(F.filter(ancestors(F.col("path")), lambda x: x != "")))
    found = above.join(owners, "directory")
    found = found.unionByName(listed.crossJoin(F.broadcast(owners.filter("directory = ''"))))  # one module at most
    return found.withColumn("inside", F.when(F.col("directory") == "", F.col("path")).otherwise(F.expr("substring(path, length(directory) + 2)"))).drop("directory")


def is_model_file(strict: bool = False) -> Column:
    """Python files that may define models. Loose: directly in models/ or the module, no dunder names. Strict: models/ at any depth, no tests."""
    if strict:
        deep = F.col("inside").rlike(r"^models/(.*/)?[^/]+\.py$")
        top = F.col("inside").rlike(r"^[^/]+\.py$") & ~F.col("name").isin("__init__.py", *MANIFESTS)
        return (deep | top) & ~F.col("name").startswith("test_")
    return F.col("inside").rlike(r"^(models/)?[^/]+\.py$") & ~F.col("name").startswith("__")


def is_view_file() -> Column:
    return F.col("inside").rlike(r"^(views|data)/(.*/)?[^/]+\.xml$")


def is_watched_file() -> Column:
    """What change detection looks at: all Python and XML files of a module."""
    return F.col("name").rlike(r"\.(py|xml)$")


def states(files: DataFrame, root: str, now: float) -> DataFrame:
    """path, hash, timestamp, size, last_processed of listed files."""
    read = contents(files, root, ("modified", "length"))
    return read.select("path", F.sha2("content", 256).alias("hash"), F.col("modified").alias("timestamp"), F.col("length").alias("size"), F.lit(float(now)).alias("last_processed"))
