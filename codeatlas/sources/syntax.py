"""Source text to rows of literals: the only Python in extraction. What the literals mean is decided by column expressions."""

import ast
import json
import xml.etree.ElementTree as ET
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from .schemas import CLASS, MANIFEST, RECORD


def literal(node: ast.AST | None):
    """The value of a literal; None for whatever isn't one, also inside collections."""
    if isinstance(node, ast.Constant):
        return node.value
    if isinstance(node, ast.List):
        return [literal(x) for x in node.elts]
    if isinstance(node, ast.Tuple):
        return tuple(literal(x) for x in node.elts)
    if isinstance(node, ast.Dict):
        return {literal(k): literal(v) for k, v in zip(node.keys, node.values, strict=True) if k is not None}
    return None


def item(x) -> dict:
    kind = "none" if x is None else type(x).__name__
    if isinstance(x, (list, dict)):
        return {"kind": kind, "text": json.dumps({str(k): v for k, v in x.items()} if isinstance(x, dict) else x, default=str, ensure_ascii=False)}
    return {"kind": kind if kind in ("none", "str", "bool", "int", "float") else "other", "text": None if x is None else str(x)}


def value(x) -> dict:
    return item(x) | {"items": [item(y) for y in x] if isinstance(x, list) else None}


def values(d: dict) -> list[tuple]:
    """A map's entries."""
    return [(k, value(v)) for k, v in d.items() if isinstance(k, str)]


def decoded(content: bytes) -> tuple[str, bool]:
    """The text, and whether it was UTF-8; anything else is read as Latin-1."""
    try:
        return content.decode("utf-8"), True
    except UnicodeDecodeError:
        return content.decode("latin-1"), False


def manifest(content: bytes) -> tuple:
    """Loose and strict readings of a manifest. Loose: the first dict at top level, alone or assigned. Strict: the whole file is one literal."""
    text, utf8 = decoded(content)
    loose, loose_error, strict, strict_error = None, None, None, None
    try:
        for stmt in ast.parse(text).body:
            if isinstance(stmt, (ast.Expr, ast.Assign)) and isinstance(stmt.value, ast.Dict):
                loose = values(literal(stmt.value))
                break
        else:
            loose_error = "no dictionary"
    except (SyntaxError, ValueError, RecursionError) as e:
        loose_error = f"{type(e).__name__}: {e}"
    try:
        whole = ast.literal_eval(text.strip()) if utf8 else None
        if isinstance(whole, dict):
            strict = values(whole)
        else:
            strict_error = "not a dictionary" if utf8 else "not UTF-8"
    except (SyntaxError, ValueError, TypeError, RecursionError) as e:
        strict_error = f"{type(e).__name__}: {e}"
    return loose, strict, loose_error, strict_error


def dotted(node: ast.AST) -> str | None:
    if isinstance(node, ast.Name):
        return node.id
    if isinstance(node, ast.Attribute):
        head = dotted(node.value)
        return f"{head}.{node.attr}" if head else f"?.{node.attr}"
    return None


def classes(content: bytes, strict: bool = False) -> Iterator[tuple]:
    """Every class of a file, nested ones too, with the plain assignments in its body: literals to underscored names, and calls.

    strict: a file that isn't UTF-8 is an error.
    """
    text, utf8 = decoded(content)
    if strict and not utf8:
        yield None, None, None, None, None, "not UTF-8"
        return
    try:
        tree = ast.parse(text)
    except (SyntaxError, ValueError, RecursionError) as e:
        yield None, None, None, None, None, f"{type(e).__name__}: {e}"
        return
    for node in ast.walk(tree):
        if not isinstance(node, ast.ClassDef):
            continue
        attributes, fields = {}, {}
        for stmt in node.body:
            if not isinstance(stmt, ast.Assign):
                continue
            for name in (t.id for t in stmt.targets if isinstance(t, ast.Name)):
                if name.startswith("_"):
                    attributes[name] = value(literal(stmt.value))
                if isinstance(stmt.value, ast.Call) and isinstance(stmt.value.func, ast.Attribute):
                    call = stmt.value
                    fields[name] = {"name": name, "owner": dotted(call.func.value), "type": call.func.attr, "first": value(literal(call.args[0])) if call.args else None, "keywords": list({k.arg: value(literal(k.value)) for k in call.keywords if k.arg}.items())}
        yield node.name, node.lineno, [b for b in map(dotted, node.bases) if b], list(attributes.items()), list(fields.values()), None


def records(content: bytes, model: str = "ir.ui.view") -> Iterator[tuple]:
    """The records of one model in an XML file: id, place, and of each field its ref, text, eval and first child's tag."""
    try:
        root = ET.fromstring(content)
    except (ET.ParseError, ValueError, LookupError) as e:
        yield None, None, None, f"{type(e).__name__}: {e}"
        return
    for n, r in enumerate(x for x in root.iter("record") if x.get("model") == model):
        fields = {}
        for f in r.findall("field"):
            if f.get("name"):
                child = next((c.tag for c in f if isinstance(c.tag, str)), None)
                fields[f.get("name")] = {"ref": f.get("ref"), "text": f.text, "eval": f.get("eval"), "child": child}
        yield r.get("id", ""), n, list(fields.items()), None


def arrow_schema(ddl: str) -> pa.Schema:
    return to_arrow_schema(StructType.fromDDL(ddl))


#: Files whose rows are made at once; a file's rows are some times as large as its text.
FILES = 1024


def parsed(path: pa.Array, content: pa.Array, parse: Callable, schema: pa.Schema, many: bool, keep: Sequence[pa.Array] = ()) -> pa.RecordBatch:
    """What parse makes of each content, as rows of a schema, with the columns to keep; a null content is an empty file."""
    rows, at = [], []
    for k, (p, c) in enumerate(zip(path.to_pylist(), content.to_pylist(), strict=True)):
        own = [(p, *row) for row in (parse(c or b"") if many else [parse(c or b"")])]
        rows += own
        at += [k] * len(own)
    made = schema if not keep else pa.schema(list(schema)[: len(schema) - len(keep)])
    columns = list(zip(*rows, strict=True)) if rows else [[]] * len(made)
    kept = [c.take(pa.array(at, pa.int64())) for c in keep]
    return pa.RecordBatch.from_arrays([*(pa.array(c, f.type) for c, f in zip(columns, made, strict=True)), *kept], schema=schema)


def _mapped(files: DataFrame, parse: Callable, ddl: str, many: bool, keep: Sequence[str] = ()) -> DataFrame:
    """keep: further columns of files that each of their rows has too, after those of ddl."""
    files = files.select("path", "content", *keep)
    kinds = StructType([*StructType.fromDDL(ddl).fields, *files.schema.fields[2:]])
    schema = to_arrow_schema(kinds)

    def run(batches):
        for whole in batches:
            for k in range(0, whole.num_rows, FILES):
                batch = whole.slice(k, FILES)
                yield parsed(batch.column(0), batch.column(1), parse, schema, many, batch.columns[2:])

    return files.mapInArrow(run, kinds)


def parse_manifests(files: DataFrame) -> DataFrame:
    """files: (path, content). See schemas.MANIFEST."""
    return _mapped(files, manifest, MANIFEST, False)


def parse_classes(files: DataFrame, strict: bool = False, keep: Sequence[str] = ()) -> DataFrame:
    return _mapped(files, lambda content: classes(content, strict), CLASS, True, keep)


def parse_records(files: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    return _mapped(files, records, RECORD, True, keep)
