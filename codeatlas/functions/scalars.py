"""Column expressions shared by extraction and queries."""

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The kinds of views.
VIEW_TYPES = ("form", "tree", "kanban", "search", "calendar", "graph", "pivot", "qweb")


def model_kind(name: Column, inherits: Column) -> Column:
    """parent, child, redefined or mixin, by whether a class names itself and what it inherits."""
    named, inheriting = F.coalesce(name, F.lit("")) != "", F.size(F.coalesce(inherits, F.array().cast("array<string>"))) > 0
    return F.when(named & ~inheriting, "parent").when(~named & inheriting, "child").when(named & inheriting, "redefined").otherwise("mixin")


def qualified(module: Column, xml_id: Column) -> Column:
    """module.id, unless the id has a dot."""
    return F.when(F.instr(xml_id, ".") > 0, xml_id).otherwise(F.concat_ws(".", module, xml_id))


def view_kind(text: Column, kinds: tuple[str, ...] = VIEW_TYPES) -> Column:
    """The first of the kinds whose opening tag is in a text, else unknown."""
    low, out = F.lower(text), None
    for k in kinds:
        has = F.instr(low, f"<{k}") > 0
        out = F.when(has, k) if out is None else out.when(has, k)
    return out.otherwise("unknown")


def csv_list(text: Column) -> Column:
    """The trimmed, non-empty parts between commas."""
    return F.filter(F.transform(F.split(text, ","), lambda x: F.trim(x)), lambda x: x != "")


def base_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def shortened(text: Column, n: int = 40) -> Column:
    return F.substring(F.coalesce(text, F.lit("")), 1, n)


def first_items(items: Column, n: int = 3) -> Column:
    """The first n elements of an array, all of a shorter one."""
    return F.slice(items, 1, n)


def links(text: Column) -> Column:
    """All href values in double quotes."""
    return F.regexp_extract_all(text, F.lit('href="([^"]*)"'), F.lit(1))


def serialised(value: Column, is_collection: bool) -> Column:
    """Collections as JSON, scalars as they are."""
    return F.to_json(value) if is_collection else value
