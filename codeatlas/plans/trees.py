"""Source trees written from the relational tables by Spark tasks, and queries that index them.

A supplier is a module that depends on the module numbered like its nation. A part with lines is a file of the module of its least supplier:
it defines a model that inherits from the model of the part before it (and delegates to it, if its size is even), with a number and a reference to
itself. Each module has one view, which extends that of the module it depends on.
"""

import time
import uuid
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..graph import Graph, shared_dir
from ..operators import upserts
from ..sources import files, index
from .derive import read, stamp, text

_trees: dict[tuple, str] = {}
_made: dict[tuple, "Indexed"] = {}


def sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """path, content and part (null for other files) of all files of the tree."""
    s = read(spark, sf_dir, "supplier")
    home = F.concat(F.lit("m"), text("s_suppkey"))
    manifests = s.select(F.concat(home, F.lit("/__manifest__.py")).alias("path"), F.concat(F.lit("{'name': '"), "s_name", F.lit("', 'version': '1."), text("s_nationkey"), F.lit("', 'depends': ['m"), text("s_nationkey"), F.lit("'], 'installable': "), F.when(F.col("s_acctbal") > 0, "True").otherwise("False"), F.lit("}")).alias("content"), F.lit(None).cast("long").alias("part"))
    views = s.select(F.concat(home, F.lit("/views/v.xml")).alias("path"), F.concat(F.lit('<data><record id="v" model="ir.ui.view"><field name="name">'), "s_name", F.lit('</field><field name="model">part.'), text("s_suppkey"), F.lit("</field>"), F.when(F.col("s_suppkey") != F.col("s_nationkey"), F.concat(F.lit('<field name="inherit_id" ref="m'), text("s_nationkey"), F.lit('.v"/>'))).otherwise(""), F.lit('<field name="arch" type="xml"><kanban/></field></record></data>')).alias("content"), F.lit(None).cast("long").alias("part"))
    owners = read(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.min("l_suppkey").alias("s_suppkey"))
    p = read(spark, sf_dir, "part").join(owners, "p_partkey")
    body = F.concat(F.lit("from x import fields, models\n\nclass Part(models.Model):\n    _name = 'part."), text("p_partkey"), F.lit("'\n    _inherit = ['part."), (F.col("p_partkey") - 1).cast("string"), F.lit("']\n    _description = '"), "p_type", F.lit("'\n    size = fields.Integer('Size', default="), text("p_size"), F.lit(")\n    same = fields.Many2one('part."), text("p_partkey"), F.lit("')\n"), F.when(F.col("p_size") % 2 == 0, F.concat(F.lit("    _inherits = {'part."), (F.col("p_partkey") - 1).cast("string"), F.lit("': 'base_id'}\n"))).otherwise(""))
    models = p.select(F.concat(home, F.lit("/models/p"), text("p_partkey"), F.lit(".py")).alias("path"), body.alias("content"), F.col("p_partkey").alias("part"))
    return manifests.unionByName(views).unionByName(models)


def put(rows: DataFrame, root: str) -> None:
    """Writes the files (path, content) below a root that all executors can reach; a null content deletes the file."""

    def run(batches):
        import posixpath

        made = set()
        for batch in batches:
            system, top = files._file_system(root)
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                at = f"{top.rstrip('/')}/{path}"
                if content is None:
                    system.delete_file(at)
                    continue
                if posixpath.dirname(at) not in made:
                    system.create_dir(posixpath.dirname(at), recursive=True)
                    made.add(posixpath.dirname(at))
                with system.open_output_stream(at) as f:
                    f.write(content.encode())
            yield pa.RecordBatch.from_arrays([batch.column(0)], ["path"])

    tasks = 4 * rows.sparkSession.sparkContext.defaultParallelism  # rows are few bytes, but each is a file to write
    rows.select("path", "content").repartition(tasks, "path").mapInArrow(run, "path string").write.format("noop").mode("overwrite").save()


@dataclass(frozen=True)
class Indexed:
    """A tree, the store of a full run over it, and the run's graph as stored tables."""

    root: str
    store: str
    records: index.Extracted
    graph: Graph
    report: DataFrame


def tree_of(spark: SparkSession, sf_dir: str) -> str:
    """The root of a tree written from the tables, once for a folder's files and an application."""
    key = (spark.sparkContext.applicationId, sf_dir, stamp(spark, sf_dir))
    if key not in _trees:
        root = f"{shared_dir(spark)}/tree-{uuid.uuid4().hex}"
        put(sources(spark, sf_dir), root)
        _trees[key] = root
    return _trees[key]


def indexed(spark: SparkSession, sf_dir: str) -> Indexed:
    """The tree of tree_of() indexed in full, once for a folder's files and an application."""
    key = (spark.sparkContext.applicationId, sf_dir, stamp(spark, sf_dir))
    if key not in _made:
        root = tree_of(spark, sf_dir)
        store, place = (f"{shared_dir(spark)}/{kind}-{uuid.uuid4().hex}" for kind in ("store", "graph"))
        begun = time.time()
        counts = index.save(index.extract(spark, root), store)
        records = index.load(spark, store)
        g = index.model_graph(records)
        edges = upserts.save(g, place)["edges"]
        _made[key] = Indexed(root, store, records, upserts.load(spark, place, tuple(g.edges)), index.run_report(spark, counts, edges, time.time() - begun))
    return _made[key]


def model_graph(spark: SparkSession, sf_dir: str) -> Graph:
    return indexed(spark, sf_dir).graph


def class_graph(spark: SparkSession, sf_dir: str) -> Graph:
    return index.class_graph(indexed(spark, sf_dir).records)


def strict(spark: SparkSession, sf_dir: str) -> index.Extracted:
    """What the strict reading makes of the same tree, at any depth; stored once beside it."""
    root = tree_of(spark, sf_dir)
    store = f"{root}-strict"
    if not index.versions(spark, store):
        index.save(index.extract(spark, root, strict=True, max_depth=None), store)
    return index.load(spark, store)


def unchanged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """change, n of a refresh of a tree that hasn't changed."""
    x = indexed(spark, sf_dir)
    return index.refresh(spark, x.root, x.store)


def refreshed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """change, n of a second run over a tree of its own: files of parts of size 1 to 5 are edited, of 6 to 9 deleted, and each module gets a new file."""
    root, store = f"{shared_dir(spark)}/tree-{uuid.uuid4().hex}", f"{shared_dir(spark)}/store-{uuid.uuid4().hex}"
    first = sources(spark, sf_dir)
    put(first, root)
    index.refresh(spark, root, store).count()
    sized = first.join(read(spark, sf_dir, "part").select(F.col("p_partkey").alias("part"), "p_size"), "part")
    put(sized.filter("p_size between 1 and 5").select("path", F.concat("content", F.lit("    more = fields.Char()\n")).alias("content")), root)
    put(sized.filter("p_size between 6 and 9").select("path", F.lit(None).cast("string").alias("content")), root)
    put(first.filter("path like '%/__manifest__.py'").select(F.regexp_replace("path", "__manifest__", "models/extra").alias("path"), F.lit("x = 1\n").alias("content")), root)
    return index.refresh(spark, root, store)


TREES = """WITH owners AS (SELECT l_partkey AS p_partkey, min(l_suppkey) AS s_suppkey FROM lineitem GROUP BY 1),
files AS (SELECT p.*, s_suppkey, concat('part.', p_partkey) AS name, concat('m', s_suppkey) AS module FROM part p JOIN owners USING (p_partkey)),
mods AS (SELECT concat('m', s_suppkey) AS name, * EXCLUDE s_name, s_name AS display_name FROM supplier)
"""
