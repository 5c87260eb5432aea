"""The parsers as SQL table functions give what the DataFrame functions give."""

import pytest

from codeatlas.sources import syntax, table_functions

TEXTS = {
    "a": b"class A(models.Model):\n    _name = 'a'\n    _inherits = {'b': 'b_id'}\n    x = fields.Char('X', size=3, help=None)\n    class In:\n        y = fields.Many2one('b', required=True)\n",
    "bad": b"class (",
    "latin": "# é\nclass L(Model): pass\n".encode("latin-1"),
    "manifest": b"{'name': 'M', 'depends': ['a', 'b'], 'x': -1, 'installable': False}",
    "views": b'<data><record id="v" model="ir.ui.view"><field name="name">N</field><field name="arch"><form/></field></record><record id="o" model="other"/></data>',
    "empty": b"",
}


@pytest.fixture(scope="module")
def texts(spark):
    table_functions.register(spark)
    df = spark.createDataFrame([(k, bytearray(v), k.upper()) for k, v in TEXTS.items()] + [("none", None, "NONE")], "path string, content binary, owner string").repartition(3)
    df.createOrReplaceTempView("files")
    return df


@pytest.mark.parametrize(("name", "function"), [("manifests", syntax.parse_manifests), ("classes", syntax.parse_classes), ("classes_strict", lambda f: syntax.parse_classes(f, True)), ("records", syntax.parse_records)])
def test_same_rows(spark, texts, name, function):
    flat = lambda x: sorted((k, flat(v)) for k, v in x.items()) if isinstance(x, dict) else [flat(y) for y in x] if isinstance(x, list) else x
    ordered = lambda df: sorted(repr(flat(r.asDict(True))) for r in df.collect())
    want = ordered(function(texts))
    assert ordered(spark.sql(f"SELECT * FROM parse_{name}(TABLE(SELECT owner, content, path FROM files))")) == want and want
    one = "manifest" if name == "manifests" else name
    got = spark.sql(f"SELECT f.path, f.owner, c.* FROM files f, LATERAL {one}_of(f.content) c")
    assert all(r["owner"] == r["path"].upper() for r in got.collect())
    assert ordered(got.drop("owner")) == want


def test_in_a_query(spark, texts, rows):
    found = spark.sql("SELECT c.class_name, f.name, f.type, f.keywords['required'].text AS required FROM parse_classes(TABLE(SELECT path, content FROM files)) c LATERAL VIEW explode(c.fields) x AS f")
    assert rows(found) == [("A", "x", "Char", None), ("In", "y", "Many2one", "True")]
