"""What parsed literals mean: modules, model definitions, fields and views as native expressions.

Two readings exist. loose: module metadata as given, models named by _name alone. strict: defaults and errors for manifests, every
class with a model base. intended=True repairs what the plain rules lose: the target of a relational field given as its first
argument, a view's type by its nested markup, priorities given by eval, and inherited ids without their module.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import VIEW_TYPES, model_kind, qualified, view_kind

#: Bases that make a class a model, and the field types of either reading.
MODEL_BASES = ("Model", "TransientModel", "AbstractModel")
FIELD_TYPES = ("Char", "Text", "Integer", "Float", "Boolean", "Date", "Datetime", "Binary", "Selection", "Html", "Monetary", "Many2one", "One2many", "Many2many", "Reference", "Json", "Properties")
STRICT_FIELD_TYPES = ("Char", "Text", "Integer", "Float", "Boolean", "Date", "Datetime", "Selection", "Many2one", "One2many", "Many2many", "Binary", "Html", "Monetary", "Reference")
RELATIONAL = ("Many2one", "One2many", "Many2many")
#: Keywords of a field that are stored, by type.
FLAGS = ("required", "readonly", "store", "copy", "index", "translate", "sanitize", "strip_style")
TEXTS = ("string", "help", "default", "compute", "related", "depends", "inverse_name", "comodel_name", "domain", "selection", "states", "digits", "relation")


def is_string(v: Column) -> Column:
    return v["kind"] == "str"


def truthy(v: Column) -> Column:
    """Python's truth of a literal."""
    k, t = v["kind"], v["text"]
    return F.when(v.isNull() | (k == "none"), False).when(k == "bool", t == "True").when(k.isin("int", "float"), ~t.isin("0", "0.0")).when(k == "list", t != "[]").when(k == "dict", t != "{}").otherwise(t != "")


def strings(v: Column) -> Column:
    """The strings in a list; an empty array for anything else."""
    return F.when(v["kind"] == "list", F.transform(F.filter(v["items"], is_string), lambda x: x["text"])).otherwise(F.array().cast("array<string>"))


def modules(found: DataFrame, parsed: DataFrame, strict: bool = False) -> DataFrame:
    """Rows of modules from module directories and their parsed manifests.

    Loose: unreadable manifests have no row. Strict: every module has one, with defaults and error texts; its name must be its directory's.
    """
    joined = found.join(parsed, found["manifest"] == parsed["path"], "left" if strict else "inner").withColumn("v", F.col("strict" if strict else "loose"))
    if not strict:
        joined = joined.filter("v is not null")
    v = lambda k: F.col("v").getItem(k)
    default = {"version": "1.0.0", "category": "Uncategorized"} if strict else {}
    said = lambda k: F.coalesce(v(k)["text"], F.lit(default.get(k, "")))
    display = F.coalesce(v("name")["text"], F.col("module"))
    none = F.lit(None).cast("string")
    errors = F.array()
    depends = strings(v("depends"))
    if strict:
        all_strings = F.forall(v("depends")["items"], is_string)
        depends = F.when((v("depends")["kind"] == "list") & ~all_strings, F.transform(F.filter(v("depends")["items"], truthy), lambda x: x["text"])).otherwise(depends)
        wrong = lambda k: v(k).isNotNull() & (v(k)["kind"] != "list")
        checks = [F.when(F.col("manifest_bytes") > LIMIT, F.lit("manifest is too large")), F.coalesce(F.when(F.col("v").isNull() & (F.col("manifest_bytes") <= LIMIT), F.coalesce("strict_error", F.lit("unreadable"))), none), F.when(display != F.col("module"), F.concat(F.lit("name "), display, F.lit(" differs from directory "), F.col("module"))), F.when(wrong("depends"), F.concat(F.lit("depends is no list but "), v("depends")["kind"])), F.when((v("depends")["kind"] == "list") & ~all_strings, F.lit("some dependencies are not strings")), F.when(wrong("data"), F.concat(F.lit("data is no list but "), v("data")["kind"]))]
        errors = F.array_compact(F.array(*checks))
    flag = lambda k, otherwise: F.when(v(k).isNull(), F.lit(otherwise)).otherwise(truthy(v(k)))
    texts = [said(k).alias(k) for k in ("version", "category", "summary", "description", "author", "website", "license")]
    return joined.select(F.col("module").alias("name"), display.alias("display_name"), *texts, flag("installable", True).alias("installable"), flag("auto_install", False).alias("auto_install"), flag("application", False).alias("application"), F.col("manifest").alias("file_path"), "manifest_file", depends.alias("depends"), strings(v("data")).alias("data"), errors.cast("array<string>").alias("errors"))


LIMIT = 1 << 20


def discovered(modules: DataFrame, include_uninstallable: bool = False) -> DataFrame:
    return modules if include_uninstallable else modules.filter("installable")


def dependency_lists(modules: DataFrame) -> DataFrame:
    """module, depends: of several modules of a name the last by path."""
    return modules.groupBy(F.col("name").alias("module")).agg(F.max_by("depends", "file_path").alias("depends"))


def _base(prefixed: bool) -> Column:
    ok = [f"models.{b}" for b in MODEL_BASES] + list(MODEL_BASES)
    if prefixed:
        return F.exists("bases", lambda b: b.isin(*ok))
    return F.exists("bases", lambda b: F.element_at(F.split(b, r"\."), -1).isin(*MODEL_BASES))


def model_definitions(parsed: DataFrame, owners: DataFrame | None = None, strict: bool = True) -> DataFrame:
    """One row a class that defines or extends a model. owners: (path, module), unless parsed has the module. Fields stay raw, see fields()."""
    rows = _owned(parsed.filter(F.col("error").isNull() & _base(not strict)), owners)
    a = lambda k: F.col("attributes").getItem(k)
    said = lambda k: F.when(is_string(a(k)), a(k)["text"])
    name, inherit = said("_name"), a("_inherit")
    inherits = F.filter(F.when(is_string(inherit), F.array(inherit["text"])).otherwise(strings(inherit)), lambda x: x != "") if strict else F.when(is_string(inherit), F.array(inherit["text"])).otherwise(strings(inherit))
    delegates = F.coalesce(F.when(a("_inherits")["kind"] == "dict", F.from_json(a("_inherits")["text"], "map<string,string>")), F.create_map().cast("map<string,string>"))
    text = lambda k: F.coalesce(said(k), F.lit(""))
    return rows.select(name.alias("own_name"), F.coalesce(F.when(name != "", name), F.col("class_name")).alias("name"), "module", "class_name", model_kind(name, inherits).alias("model_type"), F.coalesce(inherits, F.array().cast("array<string>")).alias("inherits"), delegates.alias("inherits_delegation"), text("_description").alias("description"), text("_rec_name").alias("rec_name"), text("_order").alias("order"), text("_table").alias("table"), F.col("path").alias("file_path"), "line_number", F.col("fields").alias("raw_fields"))


def defining(defs: DataFrame) -> DataFrame:
    """Only classes that define a model: with a _name that they don't inherit. Extensions make no model of their own."""
    return defs.filter((F.coalesce("own_name", F.lit("")) != "") & ~F.array_contains("inherits", F.col("own_name")))


def fields(defs: DataFrame, strict: bool = False, intended: bool = True) -> DataFrame:
    """One row a field definition of the given classes, with the keywords that are stored."""
    f = defs.select(F.col("name").alias("model_name"), "module", "file_path", "line_number", F.explode("raw_fields").alias("f"))
    if strict:
        return f.filter(F.col("f.type").isin(*STRICT_FIELD_TYPES)).select(F.col("f.name").alias("name"), "model_name", "module", F.col("f.type").alias("field_type"), F.lit("").alias("string"), F.lit(False).alias("required"), F.lit(False).alias("readonly"), F.lit(None).cast("string").alias("comodel_name"), "file_path", "line_number")
    f = f.filter((F.col("f.owner") == "fields") & F.col("f.type").isin(*FIELD_TYPES))
    k, first, kind = (lambda n: F.col("f.keywords").getItem(n)), F.col("f.first"), F.col("f.type")
    target = kind.isin(*RELATIONAL) & is_string(first) if intended else F.lit(False)
    found = {n: k(n)["text"] for n in TEXTS}
    found["string"] = F.when(F.col("f.keywords").getItem("string").isNotNull(), found["string"]).otherwise(F.when(is_string(first) & ~F.coalesce(target, F.lit(False)), first["text"]))
    found["selection"] = F.coalesce(found["selection"], F.when((kind == "Selection") & (first["kind"] == "list"), first["text"]))
    found["comodel_name"] = F.coalesce(found["comodel_name"], F.when(target, first["text"]))
    flags = [F.when(k(n).isNotNull() & (k(n)["kind"] != "none"), truthy(k(n))).alias(n) for n in FLAGS]
    return f.select(F.col("f.name").alias("name"), "model_name", "module", kind.alias("field_type"), *[c.alias(n) for n, c in found.items()], k("default")["kind"].alias("default_type"), *flags, "file_path", "line_number")


def _owned(parsed: DataFrame, owners: DataFrame | None) -> DataFrame:
    return parsed if owners is None else parsed.join(owners.select("path", "module"), "path")


def views(parsed: DataFrame, owners: DataFrame | None = None, intended: bool = True) -> DataFrame:
    """One row a view record; lines aren't known, so line_number is 0. Plain rules drop views whose priority is no whole number."""
    rows = _owned(parsed.filter("error is null"), owners)
    f = lambda n: F.col("fields").getItem(n)
    said = lambda n: F.when(f(n).isNotNull(), F.coalesce(F.when(f(n)["ref"] != "", f(n)["ref"]), f(n)["text"], F.lit("")))
    inherit, arch = F.nullif(F.trim(said("inherit_id")), F.lit("")), F.coalesce(said("arch"), F.lit(""))
    kind, priority = view_kind(arch), said("priority")
    whole = F.expr("1 = 1")
    if intended:
        kind = F.when(kind == "unknown", F.when(F.lower(f("arch")["child"]).isin(*VIEW_TYPES), F.lower(f("arch")["child"])).otherwise(kind)).otherwise(kind)
        inherit = F.when(inherit.isNotNull(), qualified(F.col("module"), inherit))
        number = F.coalesce(F.expr("try_cast(trim(p) as int)"), F.expr("try_cast(trim(e) as int)"), F.lit(16))
    else:
        number = F.when(f("priority").isNull(), 16).otherwise(F.expr("try_cast(trim(p) as int)"))
        whole = number.isNotNull()
    errors = F.array_compact(F.array(F.when(F.col("id") == "", "missing id"), F.when((F.coalesce(F.col("model"), F.lit("")) == "") & F.col("inherit_id").isNull(), "neither model nor inherited view")))
    out = rows.withColumn("p", priority).withColumn("e", f("priority")["eval"]).filter(whole)
    out = out.select("id", qualified(F.col("module"), F.col("id")).alias("xml_id"), F.coalesce(said("name"), F.lit("")).alias("name"), F.coalesce(said("model"), F.lit("")).alias("model"), kind.alias("view_type"), "module", inherit.alias("inherit_id"), number.alias("priority"), F.when(inherit.isNotNull(), "extension").otherwise("primary").alias("mode"), F.col("path").alias("file_path"), F.lit(0).alias("line_number"), F.col("position").alias("position"))
    return out.withColumn("errors", errors).drop("id")


def broken(parsed: DataFrame) -> DataFrame:
    """path, error of the files that couldn't be parsed."""
    return parsed.filter("error is not null").select("path", "error")
