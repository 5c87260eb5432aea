"""Trees of files as a Spark data source: spark.read.format("sourcetree").load(root), after register(spark).

Spark's own file sources skip names with a leading underscore, which manifests have. Directories are planned breadth first until there are enough
of them for the partitions, and each partition then walks its own. Filters on the columns of an entry are pushed down: the walk ends at the depth
they allow, and only files that pass them are opened. Any file system of pyarrow.fs will do, if the driver and all executors can read it.

Options: hidden (dot-directories too), prune (names with commas between: a directory that holds one of them isn't descended below), partitions, content
(whether files are read), contentBytes (files above it have a null content). Files that can't be read have no row if content is asked for;
directories that can't be read have no entries, and links to directories aren't followed.
"""

import operator
import os
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyarrow import fs as arrow_fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import datasource as ds

ENTRY = "path string, parent string, name string, directory string, is_dir boolean, length long, modified double, depth int, content binary"
NAMES = [c.split()[0] for c in ENTRY.split(", ")]
PUSHED = "spark.sql.python.filterPushdown.enabled"
#: Entries, and bytes of contents, that are handed on at once.
ROWS, BYTES = 4096, 4 << 20


class ModuleRootError(ValueError):
    """The root of a scan is missing or no directory."""


def file_system(root: str):
    return arrow_fs.FileSystem.from_uri(root) if "://" in root else (arrow_fs.LocalFileSystem(), root)


def entry_test(f: ds.Filter) -> Callable[[dict], bool] | None:
    """What a pushed filter says of an entry; None if it can't be told before a file is read. Comparisons with null are false."""
    if isinstance(f, ds.Not):
        inner = entry_test(f.child)
        # of a null both a comparison and its negation are false
        column = getattr(f.child, "attribute", ("",))[0]
        return inner and (lambda e: (isinstance(f.child, (ds.IsNull, ds.IsNotNull, ds.EqualNullSafe)) or e[column] is not None) and not inner(e))
    column = f.attribute[0]
    if len(f.attribute) > 1 or column not in NAMES[:-1]:
        return None
    compare = {ds.EqualTo: operator.eq, ds.GreaterThan: operator.gt, ds.GreaterThanOrEqual: operator.ge, ds.LessThan: operator.lt, ds.LessThanOrEqual: operator.le, ds.StringStartsWith: str.startswith, ds.StringEndsWith: str.endswith, ds.StringContains: operator.contains}
    if type(f) in compare:
        return lambda e: e[column] is not None and compare[type(f)](e[column], f.value)
    if isinstance(f, ds.In):
        return lambda e: e[column] is not None and e[column] in f.value
    if isinstance(f, ds.EqualNullSafe):
        return lambda e: e[column] == f.value
    return {ds.IsNull: lambda e: e[column] is None, ds.IsNotNull: lambda e: e[column] is not None}.get(type(f))


def depth_bound(f: ds.Filter) -> int | None:
    """The greatest depth that a filter lets through, if it bounds it."""
    if getattr(f, "attribute", None) != ("depth",):
        return None
    if isinstance(f, (ds.EqualTo, ds.LessThanOrEqual)):
        return f.value
    return f.value - 1 if isinstance(f, ds.LessThan) else max(f.value) if isinstance(f, ds.In) else None


class Part(ds.InputPartition):
    """Directories (path, depth of their entries, whether those below are walked too)."""

    def __init__(self, directories: list[tuple[str, int, bool]]):
        super().__init__(directories)
        self.directories = directories


class TreeReader(ds.DataSourceReader):
    def __init__(self, options):
        flag = lambda k: str(options.get(k, "false")).lower() == "true"
        self.root, self.hidden, self.content = options.get("path", ""), flag("hidden"), flag("content")
        self.prune = frozenset(x for x in options.get("prune", "").split(",") if x)
        self.wanted, self.most = int(options.get("partitions", 32)), int(options.get("contentBytes", -1))
        self.filters, self.deepest = [], None

    def pushFilters(self, filters):
        for f in filters:
            if entry_test(f) is None:
                yield f
                continue
            self.filters.append(f)
            bound = depth_bound(f)
            if bound is not None:
                self.deepest = bound if self.deepest is None else min(self.deepest, bound)

    def entries(self, system, top: str, parent: str, depth: int) -> list[dict]:
        try:
            found = system.get_file_info(arrow_fs.FileSelector(f"{top.rstrip('/')}/{parent}".rstrip("/") or "/", recursive=False))
        except OSError:
            return []
        out, local = [], isinstance(system, arrow_fs.LocalFileSystem)
        for x in found:
            is_dir = x.type == arrow_fs.FileType.Directory
            if is_dir and ((not self.hidden and x.base_name.startswith(".")) or (local and os.path.islink(x.path))):
                continue
            path = f"{parent}/{x.base_name}".lstrip("/")
            out.append({"path": path, "parent": parent, "name": x.base_name, "directory": parent.rpartition("/")[2], "is_dir": is_dir, "length": None if is_dir else x.size, "modified": x.mtime.timestamp() if x.mtime else None, "depth": depth, "at": x.path})
        return out

    def below(self, entries: list[dict], depth: int) -> list[tuple[str, int]]:
        """The directories to go on with."""
        if self.deepest is not None and depth >= self.deepest or any(not e["is_dir"] and e["name"] in self.prune for e in entries):
            return []
        return [(e["path"], depth + 1) for e in entries if e["is_dir"]]

    def partitions(self):
        system, top = file_system(self.root)
        if system.get_file_info(top).type != arrow_fs.FileType.Directory:
            raise ModuleRootError(f"no such directory: {self.root}")
        if self.deepest is not None and self.deepest < 0:
            return [Part([])]
        listed, front = [], [("", 0)]
        while front and len(front) < self.wanted and len(listed) < 4 * self.wanted:
            path, depth = front.pop(0)
            listed.append((path, depth, False))
            front += self.below(self.entries(system, top, path, depth), depth)
        dealt = listed + [(path, depth, True) for path, depth in front]
        return [Part(dealt[k :: self.wanted]) for k in range(min(self.wanted, len(dealt)))]

    def read(self, partition: Part) -> Iterator[pa.RecordBatch]:
        system, top = file_system(self.root)
        tests = [entry_test(f) for f in self.filters]
        rows, size, stack = [], 0, list(partition.directories)
        while stack:
            parent, depth, deep = stack.pop()
            entries = self.entries(system, top, parent, depth)
            if deep:
                stack += [(path, d, True) for path, d in self.below(entries, depth)]
            for e in entries:
                if not all(test(e) for test in tests):
                    continue
                e["content"] = None
                if self.content and not e["is_dir"] and (self.most < 0 or e["length"] <= self.most):
                    try:
                        with system.open_input_stream(e["at"]) as f:
                            e["content"] = f.read()
                    except OSError:
                        continue
                    size += len(e["content"])
                rows.append(e)
                if len(rows) >= ROWS or size >= BYTES:
                    yield batch(rows)
                    rows, size = [], 0
        if rows:
            yield batch(rows)


def batch(rows: list[dict]) -> pa.RecordBatch:
    kinds = (*(pa.string(),) * 4, pa.bool_(), pa.int64(), pa.float64(), pa.int32(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], k) for c, k in zip(NAMES, kinds, strict=True)], NAMES)


class SourceTree(ds.DataSource):
    @classmethod
    def name(cls) -> str:
        return "sourcetree"

    def schema(self) -> str:
        return ENTRY

    def reader(self, schema) -> TreeReader:
        return TreeReader(self.options)


def register(spark: SparkSession) -> None:
    spark.conf.set(PUSHED, "true")
    spark.dataSource.register(SourceTree)


def read(spark: SparkSession, root: str, **options) -> DataFrame:
    """The entries below a root. depth is the number of directories above an entry; paths are relative to the root."""
    register(spark)
    text = {k: str(v).lower() if isinstance(v, bool) else str(v) for k, v in options.items()}
    return spark.read.format("sourcetree").options(**{"partitions": str(2 * spark.sparkContext.defaultParallelism), **text}).load(root)
