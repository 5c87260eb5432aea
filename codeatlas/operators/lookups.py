"""Pattern queries of fixed length: equi-joins of node and edge tables."""

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..graph import Graph

#: Where a model's file lies decides how early its definition is listed; anything else comes last.
BASE_PATHS = (("/base/", 0), ("/core/", 1), ("/addons/", 2))


def _all(conditions: list[Column]) -> Column:
    return reduce(and_, conditions, F.lit(True))


def _ends(graph: Graph, edge: str, start: str, end: str, nodes: DataFrame, key: str, name: str) -> DataFrame:
    """The nodes at one end of the edges whose other end has the given name."""
    return graph.edges[edge].filter(F.col(start) == name).select(F.col(end).alias(key)).join(nodes, key)


def find_module(graph: Graph, name: str) -> DataFrame:
    return graph.modules.filter(F.col("name") == name)


def module_dependencies(graph: Graph, name: str) -> DataFrame:
    """dependency, version, category of the modules that a module needs."""
    return _ends(graph, "DEPENDS_ON", "src", "dst", graph.modules, "name", name).select(F.col("name").alias("dependency"), "version", "category").orderBy(F.asc_nulls_last("dependency"))


def module_dependents(graph: Graph, name: str) -> DataFrame:
    """dependent, version, category of the modules that need a module."""
    return _ends(graph, "DEPENDS_ON", "dst", "src", graph.modules, "name", name).select(F.col("name").alias("dependent"), "version", "category").orderBy(F.asc_nulls_last("dependent"))


def list_modules(graph: Graph, category: str | None = None, installable: bool | None = None) -> DataFrame:
    """All modules, or those of a category (an empty one is no filter) or of one installable state."""
    wanted = ([F.col("category") == category] if category else []) + ([F.col("installable") == installable] if installable is not None else [])
    return graph.modules.filter(_all(wanted)).select("name", "version", "category", "summary", "installable").orderBy(F.asc_nulls_last("name"))


def path_priority(path: Column) -> Column:
    """0 for a file in the base module, then core, then add-ons, then any other or none."""
    out = F.when(path.contains(BASE_PATHS[0][0]), BASE_PATHS[0][1])
    for part, rank in BASE_PATHS[1:]:
        out = out.when(path.contains(part), rank)
    return out.otherwise(3)


def model_definitions(graph: Graph, name: str, limit: int = 5) -> DataFrame:
    """model, file_path, module_name, priority, class and line of a model's definitions; the first rows are the likeliest origin."""
    m = graph.models.filter(F.col("name") == name).select(F.col("name").alias("model"), "file_path", "description", "class_name", "line_number")
    defined = graph.edges["DEFINED_IN"].select(F.col("src").alias("model"), F.col("dst").alias("module_name"))
    found = m.join(defined, "model", "left").withColumn("priority", path_priority(F.col("file_path"))).distinct()
    return found.orderBy("priority", F.asc_nulls_last("file_path"), F.asc_nulls_last("module_name")).limit(limit)


def ranked_definitions(graph: Graph, name: str) -> DataFrame:
    """model_definitions with `kind`: the first is the base definition, the others extend it."""
    ranked = model_definitions(graph, name).withColumn("n", F.expr("row_number() over (partition by model order by priority, file_path, module_name)"))
    return ranked.withColumn("kind", F.when(F.col("n") == 1, "base").otherwise("extension")).drop("n")


def model_children(graph: Graph, name: str) -> DataFrame:
    return _ends(graph, "INHERITS_FROM", "dst", "src", graph.models, "name", name).select(F.col("name").alias("child"), "description").orderBy(F.asc_nulls_last("child"))


def model_delegation(graph: Graph, name: str) -> DataFrame:
    e = graph.edges["DELEGATES_TO"].filter(F.col("src") == name)
    return e.join(graph.models.select(F.col("name").alias("dst")), "dst").select(F.col("dst").alias("delegated_model"), F.col("field").alias("field_name")).orderBy("delegated_model", "field_name")


def models_in_module(graph: Graph, name: str) -> DataFrame:
    return _ends(graph, "DEFINED_IN", "dst", "src", graph.models, "name", name).select("name", "description", "file_path").orderBy(F.asc_nulls_last("name"))


def list_models(graph: Graph, module: str | None = None) -> DataFrame:
    """All models, or those whose last writer was a module."""
    return graph.models.filter(_all([F.col("module") == module] if module else [])).select("name", "description", "module").orderBy(F.asc_nulls_last("name"))


def _owned(graph: Graph) -> DataFrame:
    """Fields with the model that they belong to."""
    e = graph.edges["BELONGS_TO"].select(F.col("field").alias("name"), F.col("dst").alias("model_name"))
    return graph.fields.join(e, ["name", "model_name"], "left_semi")


def model_fields(graph: Graph, name: str) -> DataFrame:
    f = _owned(graph).filter(F.col("model_name") == name)
    return f.select("name", F.col("field_type").alias("type"), "string", "required", "readonly", "help", "comodel_name").orderBy(F.asc_nulls_last("name"))


def find_field(graph: Graph, name: str, model: str | None = None) -> DataFrame:
    f = _owned(graph).filter(_all([F.col("name") == name] + ([F.col("model_name") == model] if model else [])))
    return f.select("name", F.col("model_name").alias("model"), F.col("field_type").alias("type"), "string", "required").orderBy(F.asc_nulls_last("model"))


def relational_fields(graph: Graph, model: str | None = None) -> DataFrame:
    """Fields with a REFERENCES edge, whatever their type."""
    e = graph.edges["REFERENCES"].filter(_all([F.col("src") == model] if model else [])).select(F.col("field").alias("name"), F.col("src").alias("model_name"), F.col("dst").alias("target_model"))
    f = _owned(graph).join(e, ["name", "model_name"])
    return f.select(F.col("name").alias("field_name"), F.col("model_name").alias("source_model"), "field_type", "target_model").orderBy("source_model", "field_name")


def computed_fields(graph: Graph, model: str | None = None) -> DataFrame:
    f = _owned(graph).filter(_all([F.col("compute").isNotNull()] + ([F.col("model_name") == model] if model else [])))
    return f.select(F.col("name").alias("field_name"), F.col("model_name").alias("model"), F.col("field_type").alias("type"), F.col("compute").alias("compute_method"), F.col("store").alias("stored")).orderBy("model", "field_name")


def views_of_model(graph: Graph, name: str) -> DataFrame:
    return _ends(graph, "DISPLAYS", "dst", "src", graph.views, "xml_id", name).select("xml_id", "name", "view_type")


def implied_dependencies(graph: Graph, name: str) -> DataFrame:
    """Modules, other than this one, that define a parent of a model which this module defines."""
    defined = graph.edges["DEFINED_IN"]
    own = defined.filter(F.col("dst") == name).select(F.col("src").alias("model"))
    parents = own.join(graph.edges["INHERITS_FROM"].select(F.col("src").alias("model"), F.col("dst").alias("parent")), "model").select("parent").distinct()
    return parents.join(defined.select(F.col("src").alias("parent"), F.col("dst").alias("dependency")), "parent").filter(F.col("dependency") != name).select("dependency").distinct()


def inheritance_pairs(graph: Graph, limit: int = 25) -> DataFrame:
    return graph.edges["INHERITS_FROM"].select(F.col("src").alias("child"), F.col("dst").alias("parent")).orderBy("child", "parent").limit(limit)


def module_contents(graph: Graph, name: str, limit: int = 50) -> DataFrame:
    """Models and views of a module: module, label, contained."""
    models = graph.edges["DEFINED_IN"].filter(F.col("dst") == name).select(F.col("dst").alias("module"), F.lit("Model").alias("label"), F.col("src").alias("contained"))
    views = graph.views.filter(F.col("module") == name).select("module", F.lit("View").alias("label"), F.col("xml_id").alias("contained"))
    return models.unionByName(views).distinct().orderBy("label", "contained").limit(limit)
