"""The parsers as table functions for SQL, after register(spark).

Over a table of files (path, content), in Arrow batches and in all of its partitions:
    SELECT * FROM parse_classes(TABLE(SELECT path, content FROM files))
Of one file at a time, beside its other columns (lateral joins take no Arrow functions):
    SELECT f.owner, c.* FROM files f, LATERAL classes_of(f.content) c

parse_manifests, parse_classes, parse_classes_strict and parse_records give the rows of schemas.MANIFEST, CLASS and RECORD; manifest_of, classes_of,
classes_strict_of and records_of give the same without the path.
"""

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.functions import arrow_udtf, udtf

from . import syntax
from .schemas import CLASS, MANIFEST, RECORD


def strict_classes(content: bytes):
    return syntax.classes(content, True)


def of_table(parse: Callable, ddl: str, many: bool):
    schema = syntax.arrow_schema(ddl)

    class Parser:
        def eval(self, batch: pa.RecordBatch):
            path, content = (batch.column(batch.schema.get_field_index(c)) for c in ("path", "content"))
            yield pa.Table.from_batches([syntax.parsed(path, content, parse, schema, many)])

    return arrow_udtf(Parser, returnType=ddl)


def of_file(parse: Callable, ddl: str, many: bool, maps: tuple[int, ...], holders: tuple[int, ...] = ()):
    """maps: the columns that are maps; holders: those with structs whose keywords are one. Parsers give maps as entries, as Arrow takes them."""

    def plain(k: int, x):
        if x is not None and k in holders:
            return [f | {"keywords": dict(f["keywords"])} for f in x]
        return dict(x) if x is not None and k in maps else x

    class Parser:
        def eval(self, content: bytes):
            for row in parse(bytes(content or b"")) if many else [parse(bytes(content or b""))]:
                yield tuple(plain(k, x) for k, x in enumerate(row))

    return udtf(Parser, returnType=ddl.split(", ", 1)[1])


PARSERS = {"manifest": (syntax.manifest, MANIFEST, False, (0, 1)), "classes": (syntax.classes, CLASS, True, (3,), (4,)), "classes_strict": (strict_classes, CLASS, True, (3,), (4,)), "records": (syntax.records, RECORD, True, (2,))}


def register(spark: SparkSession) -> None:
    for name, (parse, ddl, many, *columns) in PARSERS.items():
        spark.udtf.register("parse_manifests" if name == "manifest" else f"parse_{name}", of_table(parse, ddl, many))
        spark.udtf.register(f"{name}_of", of_file(parse, ddl, many, *columns))
