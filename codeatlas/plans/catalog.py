"""Registered queries, one for each operator family, and their SQL twins for DuckDB over the same tables."""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars
from ..graph import Graph
from ..operators import changes, lookups, paths, summaries, upserts
from ..sources import files, index, records, syntax, table_functions, tree
from . import derive, trees
from .derive import TWINS, read
from .trees import TREES

MODULE, TARGET, MODEL, VIEW = "Supplier#000000001", "Supplier#000000007", "100", "0.0"
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def register(name: str, query: Callable[[SparkSession, str], DataFrame], sql: str | None, twins: bool = True) -> None:
    QUERIES[name] = query
    if sql:
        ORACLES[name] = f"WITH RECURSIVE {TWINS}{sql}" if twins else sql


def on_graph(f: Callable[..., DataFrame], *args, **named) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: f(derive.graph(spark, sf_dir), *args, **named)


# ---- the stored graph, all of it; run first, it has the making in its time, and otherwise each query stores the tables that it reads
_MADE = " UNION ALL ".join(f"SELECT '{label}' AS label, count(*) AS n FROM {table}" for label, table in (("Module", "modules"), ("Model", "models"), ("Field", "fields"), ("View", "views")))
register("stored_graph", lambda s, d: summaries.node_counts(derive.graph(s, d).store()), _MADE)

# ---- lookups
register("module_by_name", lambda s, d: lookups.find_module(derive.graph(s, d), MODULE).drop("id"), f"SELECT * FROM modules WHERE name = '{MODULE}'")
register("module_dependencies", on_graph(lookups.module_dependencies, MODULE), f"SELECT name AS dependency, version, category FROM depends JOIN modules ON dst = name WHERE src = '{MODULE}'")
register("module_dependents", on_graph(lookups.module_dependents, MODULE), f"SELECT name AS dependent, version, category FROM depends JOIN modules ON src = name WHERE dst = '{MODULE}'")
register("list_modules", on_graph(lookups.list_modules, "NATION_9", True), "SELECT name, version, category, summary, installable FROM modules WHERE category = 'NATION_9' AND installable")
register("list_all_modules", on_graph(lookups.list_modules, ""), "SELECT name, version, category, summary, installable FROM modules")
_RANKED = f"SELECT DISTINCT m.name AS model, file_path, description, class_name, line_number, d.dst AS module_name, CAST(CASE WHEN contains(file_path, '/base/') THEN 0 WHEN contains(file_path, '/core/') THEN 1 WHEN contains(file_path, '/addons/') THEN 2 ELSE 3 END AS INTEGER) AS priority FROM models m LEFT JOIN defined d ON d.src = m.name WHERE m.name = '{MODEL}' ORDER BY priority, file_path, module_name LIMIT 5"
register("model_definitions", on_graph(lookups.model_definitions, MODEL), _RANKED)
register("ranked_definitions", on_graph(lookups.ranked_definitions, MODEL), f"SELECT *, CASE WHEN row_number() OVER (ORDER BY priority, file_path, module_name) = 1 THEN 'base' ELSE 'extension' END AS kind FROM ({_RANKED}) t")
register("model_children", on_graph(lookups.model_children, MODEL), f"SELECT name AS child, description FROM inherits JOIN models ON src = name WHERE dst = '{MODEL}'")
register("model_delegation", on_graph(lookups.model_delegation, "1000"), "SELECT dst AS delegated_model, field AS field_name FROM delegates JOIN models ON dst = name WHERE src = '1000'")
register("models_in_module", on_graph(lookups.models_in_module, MODULE), f"SELECT name, description, file_path FROM defined JOIN models ON src = name WHERE dst = '{MODULE}'")
register("list_models", on_graph(lookups.list_models, "Brand#23"), "SELECT name, description, module FROM models WHERE module = 'Brand#23'")
register("model_fields", on_graph(lookups.model_fields, MODEL), f"SELECT name, field_type AS type, string, required, readonly, help, comodel_name FROM fields WHERE model_name = '{MODEL}'")
register("find_field", on_graph(lookups.find_field, "RF"), "SELECT name, model_name AS model, field_type AS type, string, required FROM fields WHERE name = 'RF'")
register("find_field_of_model", on_graph(lookups.find_field, "AF", MODEL), f"SELECT name, model_name AS model, field_type AS type, string, required FROM fields WHERE name = 'AF' AND model_name = '{MODEL}'")
register("relational_fields", on_graph(lookups.relational_fields), "SELECT name AS field_name, model_name AS source_model, field_type, comodel_name AS target_model FROM fields WHERE comodel_name IS NOT NULL")
register("computed_fields", on_graph(lookups.computed_fields), "SELECT name AS field_name, model_name AS model, field_type AS type, compute AS compute_method, store AS stored FROM fields WHERE compute IS NOT NULL")
register("views_of_model", on_graph(lookups.views_of_model, "1"), "SELECT xml_id, name, view_type FROM views WHERE model = '1'")
register("implied_module_dependencies", on_graph(lookups.implied_dependencies, MODULE), f"SELECT DISTINCT d2.dst AS dependency FROM defined d1 JOIN inherits i ON i.src = d1.src JOIN defined d2 ON d2.src = i.dst WHERE d1.dst = '{MODULE}' AND d2.dst <> '{MODULE}'")
register("inheritance_pairs", on_graph(lookups.inheritance_pairs), "SELECT src AS child, dst AS parent FROM inherits ORDER BY child, parent LIMIT 25")
register("module_contents", on_graph(lookups.module_contents, MODULE, 1000), f"SELECT * FROM (SELECT dst AS module, 'Model' AS label, src AS contained FROM defined WHERE dst = '{MODULE}' UNION ALL SELECT module, 'View', xml_id FROM views WHERE module = '{MODULE}') t ORDER BY label, contained LIMIT 1000")

# ---- paths
_UP = "r AS (SELECT name AS start, name AS node, 0 AS depth FROM models WHERE name = '{m}' UNION ALL SELECT r.start, i.{to}, r.depth + 1 FROM r JOIN inherits i ON i.{at} = r.node WHERE r.depth < 10)"
register("inheritance_tree", on_graph(paths.ancestors, "1000"), ", " + _UP.format(m="1000", to="dst", at="src") + " SELECT start AS model, node AS parent, depth FROM r")
register("transitive_children", on_graph(paths.descendants, "5"), ", " + _UP.format(m="5", to="src", at="dst") + " SELECT m.name, m.module, m.description, depth FROM r JOIN models m ON m.name = r.node WHERE depth > 0")
register("view_extensions", on_graph(paths.view_extensions, VIEW), f", r AS (SELECT xml_id AS node, 0 AS depth FROM views WHERE xml_id = '{VIEW}' UNION ALL SELECT e.src, r.depth + 1 FROM r JOIN extends e ON e.dst = r.node WHERE r.depth < 10) SELECT xml_id, name, view_type, depth FROM r JOIN views ON xml_id = node WHERE depth > 0")
register("dependency_cycles", lambda s, d: paths.dependency_cycles(derive.graph(s, d)).withColumn("cycle_path", F.array_join("cycle_path", ">")), """, r AS (
  SELECT src AS st, dst, 1 AS d, [concat(src, '|', dst)] AS tr, concat(src, '>', dst) AS p FROM depends UNION ALL
  SELECT r.st, e.dst, r.d + 1, list_append(r.tr, concat(e.src, '|', e.dst)), concat(r.p, '>', e.dst) FROM r JOIN depends e ON r.dst = e.src
  WHERE r.d < 10 AND NOT list_contains(r.tr, concat(e.src, '|', e.dst)))
SELECT st AS module, d AS cycle_length, p AS cycle_path FROM r WHERE st = dst""")
_CHAINS = f""", r AS (
  SELECT dst, 1 AS d, [src, dst] AS nd FROM depends WHERE src = '{MODULE}' AND dst <> src UNION ALL
  SELECT e.dst, r.d + 1, list_append(r.nd, e.dst) FROM r JOIN depends e ON r.dst = e.src WHERE r.d < 10 AND NOT list_contains(r.nd, e.dst))
SELECT dst AS target, array_to_string(nd, '>') AS path, d AS depth FROM (SELECT *, row_number() OVER (PARTITION BY dst ORDER BY d, nd) AS rn FROM r) z WHERE rn = 1"""
register("shortest_dependency_path", lambda s, d: paths.dependency_chains(derive.graph(s, d), MODULE).withColumn("path", F.array_join("path", ">")), _CHAINS)
register("shortest_path_between", lambda s, d: paths.dependency_chain(derive.graph(s, d), MODULE, TARGET).withColumn("path", F.array_join("path", ">")), f"{_CHAINS} AND dst = '{TARGET}'".replace("dst AS target, ", "", 1))
register("dependency_components", on_graph(paths.dependency_components), """, r AS (SELECT DISTINCT src, dst FROM depends UNION SELECT r.src, e.dst FROM r JOIN depends e ON r.dst = e.src),
m AS (SELECT a.src AS module, least(a.src, min(a.dst)) AS component FROM r a JOIN r b ON a.src = b.dst AND a.dst = b.src WHERE a.src <> a.dst GROUP BY a.src)
SELECT module, component, count(*) OVER (PARTITION BY component) AS size FROM m""")
register("model_neighbourhood", on_graph(paths.neighbourhood, "1000"), """, e0 AS (
  SELECT src, dst, 'INHERITS_FROM' AS ty, concat('I', src, '|', dst) AS id FROM inherits UNION ALL SELECT src, dst, 'DELEGATES_TO', concat('D', src, '|', dst, field) FROM delegates),
e AS (SELECT src AS a, dst AS b, ty, id FROM e0 UNION ALL SELECT dst, src, ty, id FROM e0),
r AS (SELECT name AS node, 0 AS d, CAST(NULL AS VARCHAR) AS ft, [''] AS tr FROM models WHERE name = '1000' UNION ALL
  SELECT e.b, r.d + 1, coalesce(r.ft, e.ty), list_append(r.tr, e.id) FROM r JOIN e ON r.node = e.a WHERE r.d < 2 AND NOT list_contains(r.tr, e.id))
SELECT DISTINCT '1000' AS center, node AS related, ft AS relation, d AS distance FROM r""")

# ---- summaries
_NODES = "SELECT 'Module' AS label, count(*) AS n FROM modules UNION ALL SELECT 'Model', count(*) FROM models UNION ALL SELECT 'Field', count(*) FROM fields UNION ALL SELECT 'View', count(*) FROM views"
_EDGES = "SELECT 'DEPENDS_ON' AS rel_type, count(*) AS n FROM depends UNION ALL SELECT 'INHERITS_FROM', count(*) FROM inherits UNION ALL SELECT 'DELEGATES_TO', count(*) FROM delegates UNION ALL SELECT 'DEFINED_IN', count(*) FROM defined UNION ALL SELECT 'BELONGS_TO', count(*) FROM fields UNION ALL SELECT 'REFERENCES', count(*) FROM fields WHERE comodel_name IS NOT NULL"
_VIEW_EDGES = " UNION ALL SELECT 'DISPLAYS', count(*) FROM views UNION ALL SELECT 'EXTENDS', count(*) FROM extends"
register("node_counts", on_graph(summaries.node_counts), _NODES)
register("label_counts", lambda s, d: summaries.label_counts(derive.graph(s, d)).select(F.array_join("labels", "|").alias("labels"), "n"), f"SELECT label AS labels, n FROM ({_NODES}) t")
register("edge_counts", on_graph(summaries.edge_counts), _EDGES + _VIEW_EDGES + " UNION ALL SELECT 'CONTAINS', 0 UNION ALL SELECT 'INHERITS', 0")
register("graph_statistics", on_graph(summaries.statistics), f", n AS ({_NODES}), e AS ({_EDGES}{_VIEW_EDGES}) SELECT 'node' AS kind, label AS name, CAST(n AS BIGINT) AS n FROM n UNION ALL SELECT 'node', 'total', CAST(sum(n) AS BIGINT) FROM n UNION ALL SELECT 'edge', rel_type, n FROM e UNION ALL SELECT 'edge', 'total', CAST(sum(n) AS BIGINT) FROM e")
register("graph_overview", on_graph(summaries.overview), "SELECT (SELECT count(*) FROM modules) AS modules, (SELECT count(*) FROM models) AS models, (SELECT count(*) FROM fields) AS fields, (SELECT count(*) FROM depends) AS dependencies, (SELECT count(*) FROM inherits) AS inheritances")


def definitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a class: parts with the parts of the same brand and type before them as parents, and their fields' number."""
    g = derive.graph(spark, sf_dir)
    n = g.fields.groupBy(F.col("model_name").alias("name")).agg(F.count("*").alias("n_fields"))
    e = g.typed_edges("INHERITS_FROM", "DELEGATES_TO").groupBy(F.col("src").alias("name")).agg(F.sort_array(F.collect_set("dst")).alias("inherits"))
    rows = g.models.join(n, "name", "left").join(e, "name", "left")
    return rows.select("name", "module", F.when(F.col("description").startswith("PROMO"), "").otherwise(F.col("description")).alias("description"), F.coalesce("n_fields", F.lit(0)).alias("n_fields"), F.coalesce("inherits", F.array().cast("array<string>")).alias("inherits"))


_DEFS = """, both_ AS (SELECT src, dst FROM inherits UNION SELECT src, dst FROM delegates), parents AS (SELECT src, count(*) AS k FROM both_ GROUP BY src),
counted AS (SELECT model_name, count(*) AS n FROM fields GROUP BY model_name),
defs AS (SELECT name, module, CASE WHEN description LIKE 'PROMO%' THEN '' ELSE description END AS description, coalesce(n, 0) AS n_fields, coalesce(k, 0) AS k
  FROM models LEFT JOIN counted ON model_name = name LEFT JOIN parents ON src = name)
"""
register("classify_models", lambda s, d: definitions(s, d).select("name", scalars.model_kind(F.when(F.col("n_fields") > 2, F.col("name")), F.col("inherits")).alias("model_type")), _DEFS + "SELECT name, CASE WHEN n_fields > 2 AND k = 0 THEN 'parent' WHEN n_fields <= 2 AND k > 0 THEN 'child' WHEN n_fields > 2 THEN 'redefined' ELSE 'mixin' END AS model_type FROM defs")
register("models_by_type", lambda s, d: summaries.models_by_type(QUERIES["classify_models"](s, d)), _DEFS + "SELECT CASE WHEN n_fields > 2 AND k = 0 THEN 'parent' WHEN n_fields <= 2 AND k > 0 THEN 'child' WHEN n_fields > 2 THEN 'redefined' ELSE 'mixin' END AS model_type, count(*) AS n FROM defs GROUP BY 1")
register("top_modules_by_models", on_graph(lambda g: summaries.top_modules(g.models)), "SELECT module, count(*) AS n FROM models GROUP BY module ORDER BY n DESC, module DESC LIMIT 10")
register("top_modules_by_views", on_graph(lambda g: summaries.top_modules(g.views)), "SELECT module, count(*) AS n FROM views GROUP BY module ORDER BY n DESC, module DESC LIMIT 10")
register("module_complexity", lambda s, d: summaries.module_complexity(definitions(s, d)), _DEFS + "SELECT module, count(*) AS models, CAST(sum(n_fields) AS BIGINT) AS total_fields FROM defs GROUP BY module ORDER BY models DESC, module DESC LIMIT 10")
register("multi_parent_models", lambda s, d: summaries.with_several_parents(definitions(s, d)).select("name", "module"), _DEFS + "SELECT name, module FROM defs WHERE k > 1")
register("models_without_description", lambda s, d: summaries.without_description(definitions(s, d)).select("name", "module"), _DEFS + "SELECT name, module FROM defs WHERE description = ''")
register("models_inheriting_from", lambda s, d: summaries.inheriting_from(definitions(s, d), "7").select("name", "module"), _DEFS + "SELECT name, module FROM defs JOIN both_ ON src = name WHERE dst = '7'")
register("large_models", lambda s, d: summaries.large_models(definitions(s, d), 3).select("name", "n_fields"), _DEFS + "SELECT name, n_fields FROM defs WHERE n_fields > 3")
register("orphan_views", on_graph(lambda g: summaries.orphan_views(g.views.withColumn("model", F.when(F.col("view_type") == "form", "").otherwise(F.col("model")))).select("xml_id")), "SELECT xml_id FROM views WHERE view_type = 'form'")

# ---- writing
register("upsert_last_writer", derive.fields, "SELECT * FROM fields")
register("upsert_into_snapshot", lambda s, d: upserts.upsert(read(s, d, "nation").select("n_nationkey", "n_name"), read(s, d, "supplier").filter("s_acctbal < 0").select(F.col("s_nationkey").alias("n_nationkey"), F.col("s_name").alias("n_name"), "s_suppkey"), ["n_nationkey"], ["s_suppkey"]), "SELECT n_nationkey, coalesce(max_by(s_name, s_suppkey), any_value(n_name)) AS n_name FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey AND s_acctbal < 0 GROUP BY n_nationkey", twins=False)
_KEPT, _KNOWN = "not startswith(file_path, '/base/')", "not startswith(file_path, '/other/')"
register("edge_endpoint_check", on_graph(lambda g: upserts.linked(g.edges["INHERITS_FROM"].select("src", "dst"), g.models.filter(_KEPT), g.models.filter(_KNOWN))), "SELECT DISTINCT src, dst FROM inherits JOIN models a ON a.name = src JOIN models b ON b.name = dst WHERE a.file_path NOT LIKE '/base/%' AND b.file_path NOT LIKE '/other/%'")
register("dangling_edges", on_graph(lambda g: upserts.dangling(g.edges["REFERENCES"].select("src", "dst"), g.models, g.models.filter(_KNOWN))), "SELECT DISTINCT model_name AS src, comodel_name AS dst, false AS src_missing, true AS dst_missing FROM fields JOIN models m ON m.name = comodel_name WHERE m.file_path LIKE '/other/%'")
register("edge_dedupe", lambda s, d: upserts.linked(read(s, d, "lineitem").select(F.col("l_partkey").alias("src"), F.col("l_suppkey").alias("dst")), read(s, d, "part"), read(s, d, "supplier"), "p_partkey", "s_suppkey", derive.tasks_for(s, read(s, d, "lineitem").count())), "SELECT DISTINCT l_partkey AS src, l_suppkey AS dst FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey", twins=False)
register("inherits_by_name", lambda s, d: upserts.inherits_by_name(read(s, d, "nation").select(F.col("n_name").alias("name"), F.col("n_regionkey").cast("string").alias("module"), F.array(F.concat(F.substring("n_name", 1, 1), F.lit("")), "n_name").alias("inherits"))), "SELECT DISTINCT a.n_name AS src, CAST(a.n_regionkey AS VARCHAR) AS src_module, b.n_name AS dst, CAST(b.n_regionkey AS VARCHAR) AS dst_module FROM nation a JOIN nation b ON b.n_name = a.n_name OR b.n_name = substr(a.n_name, 1, 1)", twins=False)
register("constraint_violations", lambda s, d: upserts.violations(doubled(s, d)), "SELECT 'models' AS \"table\", concat('[\"', description, '\"]') AS key, count(*) AS n FROM models GROUP BY description HAVING count(*) > 1")
register("verify_schema", lambda s, d: upserts.verify_schema(doubled(s, d)), "SELECT 'modules_unique' AS \"constraint\", 'modules' AS \"table\", 'name' AS key, true AS holds UNION ALL SELECT 'models_unique', 'models', 'name', false UNION ALL SELECT 'fields_unique', 'fields', 'name,model_name', true UNION ALL SELECT 'views_unique', 'views', 'xml_id', true", twins=False)

# ---- changes
_STATE = """WITH prev AS (SELECT concat('d', doc_id) AS path, sha256(text) AS h FROM documents),
cur AS (SELECT concat('d', d.doc_id) AS path, CASE WHEN quality = 1 THEN sha256(text) ELSE sha256(concat(text, 'x')) END AS h FROM documents d JOIN labels l ON l.doc_id = d.doc_id
  UNION ALL SELECT concat('b', item_id), sha256(text) FROM benchmark) """


def doubled(spark: SparkSession, sf_dir: str) -> Graph:
    """The graph with models named by their descriptions, which several share."""
    g = derive.graph(spark, sf_dir)
    return Graph(g.modules, g.models.withColumn("name", F.col("description")), g.fields, g.views, g.edges)


def states(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """An earlier and a current state of files: all documents, and then the labelled ones, those of low quality edited, with the benchmark's items."""
    docs, items = read(spark, sf_dir, "documents").select("doc_id", "text"), read(spark, sf_dir, "benchmark")
    sha = lambda c: F.sha2(c.cast("binary"), 256).alias("hash")
    marked = docs.join(read(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id")
    edited = F.when(F.col("quality") == 1, F.col("text")).otherwise(F.concat("text", F.lit("x")))
    named = lambda kind, c: F.concat(F.lit(kind), F.col(c).cast("string")).alias("path")
    now = marked.select(named("d", "doc_id"), sha(edited)).unionByName(items.select(named("b", "item_id"), sha(F.col("text"))))
    return docs.select(named("d", "doc_id"), sha(F.col("text"))), now


register("change_detection", lambda s, d: changes.changes(*states(s, d)), _STATE + "SELECT coalesce(p.path, c.path) AS path, CASE WHEN p.path IS NULL THEN 'new' WHEN c.path IS NULL THEN 'deleted' WHEN p.h <> c.h THEN 'modified' ELSE 'unchanged' END AS change FROM prev p FULL OUTER JOIN cur c ON p.path = c.path", twins=False)
register("deleted_paths", lambda s, d: changes.deleted(*states(s, d)), _STATE + "SELECT path FROM prev ANTI JOIN cur USING (path)", twins=False)
register("changed_files", lambda s, d: changes.changed(*states(s, d)), _STATE + "SELECT c.path, c.h AS hash FROM cur c LEFT JOIN prev p ON p.path = c.path WHERE p.h IS NULL OR p.h <> c.h", twins=False)
register("directory_hash", lambda s, d: changes.directory_hash(read(s, d, "documents"), "source", "doc_id", "text"), "SELECT source, sha256(string_agg(concat(doc_id, ':', sha256(text)), '' ORDER BY doc_id)) AS hash FROM documents GROUP BY source", twins=False)

# ---- scalar functions
_KINDS = " ".join(f"WHEN contains(lower(html), '<{k}') THEN '{k}'" for k in ("nav", "article", "form"))
register("view_type_detect", lambda s, d: read(s, d, "pages").select("page_id", scalars.view_kind(F.col("html"), ("nav", "article", "form")).alias("kind")), f"SELECT page_id, CASE {_KINDS} ELSE 'unknown' END AS kind FROM pages", twins=False)
register("extract_links", lambda s, d: read(s, d, "pages").select("page_id", F.explode(scalars.links(F.col("html"))).alias("link")), "SELECT page_id, unnest(regexp_extract_all(html, 'href=\"([^\"]*)\"', 1)) AS link FROM pages", twins=False)
register("qualify_ids", lambda s, d: read(s, d, "part").select("p_partkey", scalars.qualified(F.col("p_brand"), F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit("x."), "p_name")).otherwise(F.col("p_name"))).alias("xml_id")), "SELECT p_partkey, CASE WHEN contains(CASE WHEN p_partkey % 2 = 0 THEN 'x.' || p_name ELSE p_name END, '.') THEN CASE WHEN p_partkey % 2 = 0 THEN 'x.' || p_name ELSE p_name END ELSE concat(p_brand, '.', p_name) END AS xml_id FROM part", twins=False)
register("serialise_values", lambda s, d: read(s, d, "part").select("p_partkey", scalars.serialised(F.split("p_name", " "), True).alias("value"), scalars.serialised(F.col("p_size"), False).alias("plain")), "SELECT p_partkey, concat('[\"', replace(p_name, ' ', '\",\"'), '\"]') AS value, p_size AS plain FROM part", twins=False)
register("first_items", lambda s, d: read(s, d, "part").select("p_partkey", F.array_join(scalars.first_items(F.split("p_name", " "), 1), "|").alias("first"), F.array_join(scalars.first_items(F.split("p_type", " ")), "|").alias("three")), "SELECT p_partkey, string_split(p_name, ' ')[1] AS first, array_to_string(string_split(p_type, ' ')[1:3], '|') AS three FROM part", twins=False)
register("split_lists", lambda s, d: read(s, d, "part").select("p_partkey", F.array_join(scalars.csv_list(F.concat(F.lit(" "), F.regexp_replace("p_name", " ", " ,, "))), "|").alias("parts")), "SELECT p_partkey, array_to_string(list_filter(list_transform(string_split(concat(' ', replace(p_name, ' ', ' ,, ')), ','), lambda x: trim(x)), lambda x: x <> ''), '|') AS parts FROM part", twins=False)
register("base_names", lambda s, d: derive.models(s, d).select("name", scalars.base_name(F.col("file_path")).alias("file"), scalars.shortened(F.col("description"), 10).alias("short")), "SELECT name, string_split(file_path, '/')[-1] AS file, substr(coalesce(description, ''), 1, 10) AS short FROM models")

# ---- parsers, over source text written from tables


def manifest_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    joined = read(spark, sf_dir, "supplier").join(read(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    text = F.concat(F.lit("# a module\n{'name': '"), "s_name", F.lit("', 'version': '1."), F.col("s_nationkey").cast("string"), F.lit("', 'depends': ['base', '"), "n_name", F.lit("'], 'installable': "), F.when(F.col("s_acctbal") > 0, "True").otherwise("False"), F.lit(", 'price': -1}"))
    return joined.select(F.col("s_suppkey").cast("string").alias("path"), text.cast("binary").alias("content"))


def parsed_modules(spark: SparkSession, sf_dir: str, strict: bool) -> DataFrame:
    texts = manifest_texts(spark, sf_dir)
    found = texts.select(F.col("path").alias("module"), F.col("path").alias("manifest"), F.lit("__manifest__.py").alias("manifest_file"), F.length("content").alias("manifest_bytes"))
    m = records.modules(found, syntax.parse_manifests(texts), strict)
    return m.select("name", "display_name", "version", "category", "installable", F.array_join("depends", "|").alias("depends"), F.size("errors").alias("n_errors"))


def spread(df: DataFrame, key: str) -> DataFrame:
    """Rows of a table that may be one small file, dealt to all tasks by a key, without sorting, before costly work on them."""
    return df.repartition(df.sparkSession.sparkContext.defaultParallelism, key)


def model_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.concat(F.lit("from x import fields, models\n\nclass Part(models.Model):\n    _name = '"), text_of("p_partkey"), F.lit("'\n    _inherit = ['"), "p_brand", F.lit("']\n    _description = \"\"\""), "p_type", F.lit("\"\"\"\n    size = fields.Integer('Size', required=True, default="), text_of("p_size"), F.lit(")\n    maker = fields.Many2one('"), "p_brand", F.lit("')\n\nclass Plain:\n    _name = 'none'\n"))
    return spread(read(spark, sf_dir, "part"), "p_partkey").select(text_of("p_partkey").alias("path"), text.cast("binary").alias("content"))


def text_of(column: str):
    return F.col(column).cast("string")


def parsed_defs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.model_definitions(syntax.parse_classes(model_texts(spark, sf_dir).withColumn("module", F.lit("m")), keep=("module",)))


def view_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = spread(derive.views(spark, sf_dir), "xml_id")
    inherit = F.coalesce(F.concat(F.lit('<field name="inherit_id" ref="'), "inherit_id", F.lit('"/>')), F.lit(""))
    text = F.concat(F.lit('<data><record id="'), "xml_id", F.lit('" model="ir.ui.view"><field name="name">'), "name", F.lit('</field><field name="model">'), "model", F.lit("</field>"), inherit, F.lit('<field name="arch" type="xml"><'), "view_type", F.lit("/></field></record></data>"))
    return v.select(F.col("xml_id").alias("path"), "module", text.cast("binary").alias("content"))


register("parse_manifests_loose", lambda s, d: parsed_modules(s, d, False), "SELECT CAST(s_suppkey AS VARCHAR) AS name, s_name AS display_name, concat('1.', s_nationkey) AS version, '' AS category, s_acctbal > 0 AS installable, concat('base|', n_name) AS depends, 0 AS n_errors FROM supplier JOIN nation ON s_nationkey = n_nationkey", twins=False)
register("parse_manifests_strict", lambda s, d: parsed_modules(s, d, True), "SELECT CAST(s_suppkey AS VARCHAR) AS name, s_name AS display_name, concat('1.', s_nationkey) AS version, 'Uncategorized' AS category, s_acctbal > 0 AS installable, concat('base|', n_name) AS depends, 1 AS n_errors FROM supplier JOIN nation ON s_nationkey = n_nationkey", twins=False)
register("parse_models", lambda s, d: parsed_defs(s, d).select("name", "class_name", "model_type", F.array_join("inherits", "|").alias("inherits"), "description", "line_number"), "SELECT CAST(p_partkey AS VARCHAR) AS name, 'Part' AS class_name, 'redefined' AS model_type, p_brand AS inherits, p_type AS description, 3 AS line_number FROM part", twins=False)
register("parse_fields", lambda s, d: records.fields(parsed_defs(s, d)).select("name", "model_name", "field_type", "string", "required", "comodel_name", "default", "default_type"), "SELECT 'size' AS name, CAST(p_partkey AS VARCHAR) AS model_name, 'Integer' AS field_type, 'Size' AS string, true AS required, CAST(NULL AS VARCHAR) AS comodel_name, CAST(p_size AS VARCHAR) AS \"default\", 'int' AS default_type FROM part UNION ALL SELECT 'maker', CAST(p_partkey AS VARCHAR), 'Many2one', NULL, NULL, p_brand, NULL, NULL FROM part", twins=False)
register("parse_views", lambda s, d: records.views(syntax.parse_records(view_texts(s, d), ("module",))).select("xml_id", "name", "model", "view_type", "module", "inherit_id", "priority", "mode"), "SELECT xml_id, name, model, view_type, module, inherit_id, 16 AS priority, CASE WHEN inherit_id IS NULL THEN 'primary' ELSE 'extension' END AS mode FROM views")

# ---- whole runs, over source trees written from tables
_DEPENDS = "SELECT a.name AS src, b.name AS dst FROM mods a JOIN mods b ON b.name = concat('m', a.s_nationkey)"
_PARENTS = "SELECT a.name AS src, b.name AS dst FROM files a JOIN files b ON b.p_partkey = a.p_partkey - 1"
_DELEGATED = "SELECT a.name AS src, b.name AS dst, 'base_id' AS field FROM files a JOIN files b ON b.p_partkey = a.p_partkey - 1 WHERE a.p_size % 2 = 0"
_EXTENDED = "SELECT concat(a.name, '.v') AS src, concat(b.name, '.v') AS dst FROM mods a JOIN mods b ON b.name = concat('m', a.s_nationkey) WHERE a.name <> b.name"
_SHOWN = "SELECT concat(m.name, '.v') AS src, f.name AS dst FROM mods m JOIN files f ON f.p_partkey = m.s_suppkey"


def tree_query(name: str, query: Callable[[SparkSession, str], DataFrame], sql: str) -> None:
    register(name, query, TREES + sql, twins=False)


tree_query("index_modules", lambda s, d: trees.model_graph(s, d).modules.select("name", "display_name", "version", "installable", F.array_join("depends", "|").alias("depends")), "SELECT name, display_name, concat('1.', s_nationkey) AS version, s_acctbal > 0 AS installable, concat('m', s_nationkey) AS depends FROM mods")
tree_query("index_models", lambda s, d: trees.model_graph(s, d).models.select("name", "module", "description", "class_name", "line_number"), "SELECT name, module, p_type AS description, 'Part' AS class_name, 3 AS line_number FROM files")
tree_query("index_fields", lambda s, d: trees.model_graph(s, d).fields.select("name", "model_name", "field_type", "default", "comodel_name"), "SELECT 'size' AS name, name AS model_name, 'Integer' AS field_type, CAST(p_size AS VARCHAR) AS \"default\", CAST(NULL AS VARCHAR) AS comodel_name FROM files UNION ALL SELECT 'same', name, 'Many2one', NULL, name FROM files")
tree_query("index_views", lambda s, d: trees.model_graph(s, d).views.select("xml_id", "name", "model", "view_type", "module", "line_number"), "SELECT concat(name, '.v') AS xml_id, display_name AS name, concat('part.', s_suppkey) AS model, 'kanban' AS view_type, name AS module, 0 AS line_number FROM mods")
tree_query("index_edges", lambda s, d: trees.model_graph(s, d).typed_edges("DEPENDS_ON", "INHERITS_FROM", "DEFINED_IN", "REFERENCES", "DISPLAYS", "BELONGS_TO", "DELEGATES_TO", "EXTENDS"), f"SELECT *, 'DEPENDS_ON' AS rel_type, CAST(NULL AS VARCHAR) AS field FROM ({_DEPENDS}) UNION ALL SELECT *, 'INHERITS_FROM', NULL FROM ({_PARENTS}) UNION ALL SELECT name, module, 'DEFINED_IN', NULL FROM files UNION ALL SELECT name, name, 'REFERENCES', 'same' FROM files UNION ALL SELECT *, 'DISPLAYS', NULL FROM ({_SHOWN}) UNION ALL SELECT name, name, 'BELONGS_TO', unnest(['same', 'size']) FROM files UNION ALL SELECT src, dst, 'DELEGATES_TO', field FROM ({_DELEGATED}) UNION ALL SELECT *, 'EXTENDS', NULL FROM ({_EXTENDED})")
tree_query("index_class_edges", lambda s, d: trees.class_graph(s, d).typed_edges("CONTAINS", "INHERITS", "DISPLAYS"), f"SELECT module AS src, concat(module, ':', name) AS dst, 'CONTAINS' AS rel_type, CAST(NULL AS VARCHAR) AS field FROM files UNION ALL SELECT name, concat(name, '.v'), 'CONTAINS', NULL FROM mods UNION ALL SELECT concat(a.module, ':', a.name), concat(b.module, ':', b.name), 'INHERITS', NULL FROM ({_PARENTS}) e JOIN files a ON a.name = src JOIN files b ON b.name = dst UNION ALL SELECT src, concat(module, ':', dst), 'DISPLAYS', NULL FROM ({_SHOWN}) e JOIN files f ON f.name = dst")
tree_query("index_counts", lambda s, d: trees.indexed(s, d).report.filter("name <> 'seconds'"), f"SELECT 'modules' AS name, CAST(count(*) AS DOUBLE) AS n FROM mods UNION ALL SELECT 'defs', count(*) FROM files UNION ALL SELECT 'fields', 2 * count(*) FROM files UNION ALL SELECT 'views', count(*) FROM mods UNION ALL SELECT 'broken', 0 UNION ALL SELECT 'errors', 0 UNION ALL SELECT 'state', (SELECT count(*) FROM files) + 2 * count(*) FROM mods UNION ALL SELECT 'relationships', (SELECT count(*) FROM ({_DEPENDS})) + (SELECT count(*) FROM ({_PARENTS})) + (SELECT count(*) FROM ({_SHOWN})) + (SELECT count(*) FROM ({_DELEGATED})) + (SELECT count(*) FROM ({_EXTENDED})) + 4 * (SELECT count(*) FROM files)")
tree_query("index_refresh", trees.refreshed, "SELECT CASE WHEN p_size BETWEEN 1 AND 5 THEN 'modified' WHEN p_size BETWEEN 6 AND 9 THEN 'deleted' ELSE 'unchanged' END AS change, count(*) + CASE WHEN any_value(p_size) > 9 THEN 2 * (SELECT count(*) FROM mods) ELSE 0 END AS n FROM files GROUP BY 1 UNION ALL SELECT 'new', count(*) FROM mods")
tree_query("find_module_in_tree", lambda s, d: index.find_module(s, trees.tree_of(s, d), "m7").select("name", "display_name", "version", F.array_join("depends", "|").alias("depends")), "SELECT name, display_name, concat('1.', s_nationkey) AS version, concat('m', s_nationkey) AS depends FROM mods WHERE name = 'm7'")
tree_query("scan_tree", lambda s, d: tree.read(s, trees.tree_of(s, d)).filter((F.col("depth") == 2) & F.col("name").endswith(".xml") & (F.col("length") <= files.XML_BYTES)).select("path", "directory", "is_dir", "depth"), "SELECT concat(name, '/views/v.xml') AS path, 'views' AS directory, false AS is_dir, 2 AS depth FROM mods")
tree_query("index_refresh_unchanged", trees.unchanged, "SELECT 'unchanged' AS change, (SELECT count(*) FROM files) + 2 * count(*) AS n FROM mods")

# ---- the parsers as table functions of SQL


def with_functions(text: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        table_functions.register(spark)
        model_texts(spark, sf_dir).createOrReplaceTempView("model_files")
        view_texts(spark, sf_dir).createOrReplaceTempView("view_files")
        return spark.sql(text)

    return run


register("sql_parse_classes", with_functions("SELECT path, class_name, line_number, array_join(bases, '|') AS bases, attributes['_inherit'].items[0].text AS inherit, cast(size(fields) as bigint) AS n_fields FROM parse_classes(TABLE(SELECT path, content FROM model_files))"), "SELECT CAST(p_partkey AS VARCHAR) AS path, 'Part' AS class_name, 3 AS line_number, 'models.Model' AS bases, p_brand AS inherit, CAST(2 AS BIGINT) AS n_fields FROM part UNION ALL SELECT CAST(p_partkey AS VARCHAR), 'Plain', 10, '', NULL, 0 FROM part", twins=False)
register("sql_records_of", with_functions("SELECT f.path, f.module, r.id, r.fields['model'].text AS model, r.fields['arch'].child AS kind, r.fields['inherit_id'].ref AS inherit_id FROM view_files f, LATERAL records_of(f.content) r"), "SELECT xml_id AS path, module, xml_id AS id, model, view_type AS kind, inherit_id FROM views")

# ---- the strict reading of the same tree
tree_query("index_strict_modules", lambda s, d: trees.strict(s, d).modules.select("name", "display_name", "version", "category", "installable", F.array_join("depends", "|").alias("depends"), F.array_join("errors", "|").alias("errors")), "SELECT name, display_name, concat('1.', s_nationkey) AS version, 'Uncategorized' AS category, s_acctbal > 0 AS installable, concat('m', s_nationkey) AS depends, concat('name ', display_name, ' differs from directory ', name) AS errors FROM mods")
tree_query("index_strict_models", lambda s, d: trees.strict(s, d).defs.select("own_name", "name", "module", "class_name", "model_type", F.array_join("inherits", "|").alias("inherits"), F.to_json("inherits_delegation").alias("delegates"), "description", "line_number", F.col("n_fields").cast("long").alias("n_fields")), "SELECT name AS own_name, name, module, 'Part' AS class_name, 'redefined' AS model_type, concat('part.', p_partkey - 1) AS inherits, CASE WHEN p_size % 2 = 0 THEN concat('{\"part.', p_partkey - 1, '\":\"base_id\"}') ELSE '{}' END AS delegates, p_type AS description, 3 AS line_number, CAST(2 AS BIGINT) AS n_fields FROM files")
tree_query("index_strict_fields", lambda s, d: trees.strict(s, d).fields.select("name", "model_name", "module", "field_type", "string", "required", "readonly", "comodel_name", "line_number"), "SELECT 'size' AS name, name AS model_name, module, 'Integer' AS field_type, '' AS string, false AS required, false AS readonly, CAST(NULL AS VARCHAR) AS comodel_name, 3 AS line_number FROM files UNION ALL SELECT 'same', name, module, 'Many2one', '', false, false, NULL, 3 FROM files")
tree_query("index_strict_views", lambda s, d: trees.strict(s, d).views.select("xml_id", "name", "model", "view_type", "module", "inherit_id", "priority", "mode"), "SELECT concat(name, '.v') AS xml_id, display_name AS name, concat('part.', s_suppkey) AS model, 'kanban' AS view_type, name AS module, CASE WHEN s_suppkey <> s_nationkey THEN concat('m', s_nationkey, '.v') END AS inherit_id, 16 AS priority, CASE WHEN s_suppkey <> s_nationkey THEN 'extension' ELSE 'primary' END AS mode FROM mods")
tree_query("index_modules_by_display_name", lambda s, d: index.class_graph(trees.strict(s, d), by_display_name=True).modules.select("name", "version", "file_path"), "SELECT display_name AS name, concat('1.', s_nationkey) AS version, concat(name, '/__manifest__.py') AS file_path FROM mods")
