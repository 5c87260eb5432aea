"""Extraction from source trees, in full and incrementally."""

import time

import pytest

from codeatlas.operators import lookups, paths
from codeatlas.sources import files, index, records, syntax

SALE = "{'name': 'Sales', 'version': '1.1', 'depends': ['base', 'product'], 'auto_install': ['product'], 'data': ['views/a.xml'], 'price': -1, 'x': f'{1}'}"
MODELS = '''
from x import models, fields
class Partner(models.Model):
    _name = "res.partner"
    _inherit = "mail.thread"
    _description = "Contact"
    name = fields.Char("Name", required=True, help="h")
    parent_id = fields.Many2one("res.partner", string="Parent")
    kind: str = fields.Char()
    total = fields.Float(compute="_total", digits=(16, 2), store=False)
    state = fields.Selection([("a", "A")], default="a")
    class Inner(models.AbstractModel):
        _name = "res.inner"
class Thread(models.AbstractModel):
    _name = "mail.thread"
class Users(models.Model):
    _name = "res.users"
    _inherits = {"res.partner": "partner_id"}
    partner_id = fields.Many2one(comodel_name="res.partner")
class PartnerMore(models.Model):
    _inherit = "res.partner"
    extra = fields.Boolean()
class Same(models.Model):
    _name = "res.partner"
    _inherit = ["res.partner", "mail.thread"]
class Other(object):
    _name = "no.model"
class Odd(zz.Model):
    _name = "odd.model"
'''
VIEWS = '''<data>
<record id="form" model="ir.ui.view"><field name="name">f</field><field name="model">res.partner</field><field name="arch" type="xml"><form><field name="x"/></form></field></record>
<record id="other.ext" model="ir.ui.view"><field name="name">e</field><field name="model">res.partner</field><field name="inherit_id" ref="form"/><field name="priority" eval="20"/><field name="arch"><![CDATA[<tree/>]]></field></record>
<record id="bad" model="ir.ui.view"><field name="priority">high</field></record>
<record id="r" model="res.partner"/>
</data>'''


@pytest.fixture
def tree(tmp_path):
    def put(path, text):
        p = tmp_path / "src" / path
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_bytes(text if isinstance(text, bytes) else text.encode())

    put("sale/__manifest__.py", SALE)
    put("base/__manifest__.py", "# comment\n{'name': 'base'}")
    put("base/models/partner.py", MODELS)
    put("base/models/__init__.py", "")
    put("base/models/deep/more.py", "class D(models.Model):\n    _name = 'deep.model'\n")
    put("base/models/wrong.py", "class (")
    put("base/views/partner.xml", VIEWS)
    put("base/views/wrong.xml", "<data>")
    put("base/inner/nested/__manifest__.py", "{'name': 'nested'}")
    put("old/__openerp__.py", "{'name': 'old', 'installable': False}")
    put("a/product/__manifest__.py", "manifest = {'name': 'Pröduct', 'depends': ('base',)}".encode("latin-1"))
    put("a/b/c/three/__manifest__.py", "{}")
    put(".git/hidden/__manifest__.py", "{}")
    put("sale/broken/README", "")
    put("broken/__manifest__.py", "{'name': ")
    return tmp_path / "src"


def test_module_scans(spark, tree, rows):
    listed = files.listing(spark, str(tree), hidden=True)
    assert rows(files.module_directories(listed), "module") == [("base",), ("broken",), ("old",), ("product",), ("sale",)]
    strict = files.module_directories(listed, None, hidden=True)
    assert rows(strict, "module") == [("base",), ("broken",), ("hidden",), ("old",), ("product",), ("sale",), ("three",)]
    assert rows(files.module_directories(listed, 2, inclusive=False), "module") == [("base",), ("broken",), ("old",), ("sale",)]
    with pytest.raises(files.ModuleRootError):
        files.listing(spark, str(tree / "nothing"))


def test_empty_tree(spark, tmp_path, rows):
    (tmp_path / "none").mkdir()
    x = index.extract(spark, str(tmp_path / "none"))
    assert rows(index.run_counts(x), "n") == [(0,)] * 6


def test_loose_modules(spark, tree):
    x = index.extract(spark, str(tree))
    found = {r["name"]: r for r in x.modules.collect()}
    assert set(found) == {"sale", "base", "old", "product"}
    s = found["sale"]
    assert (s["display_name"], s["version"], s["depends"], s["auto_install"], s["category"]) == ("Sales", "1.1", ["base", "product"], True, "")
    assert found["product"]["display_name"] == "Pröduct" and found["product"]["depends"] == []
    assert {r["name"] for r in records.discovered(x.modules).collect()} == {"sale", "base", "product"}


def test_strict_modules(spark, tree):
    x = index.extract(spark, str(tree), strict=True, max_depth=None)
    found = {r["name"]: r for r in x.modules.collect()}
    assert found["sale"]["version"] == "1.0.0" and found["sale"]["errors"]  # not a literal as a whole
    assert found["base"]["category"] == "Uncategorized" and found["base"]["errors"] == []
    assert found["broken"]["errors"] and found["product"]["errors"]
    kinds = {(r["class_name"], r["model_type"]) for r in x.defs.collect()}
    assert {("Partner", "redefined"), ("PartnerMore", "child"), ("Thread", "parent"), ("Odd", "parent"), ("D", "parent")} <= kinds
    assert len(x.broken.collect()) == 2


def test_models_fields_and_views(spark, tree, rows):
    g = index.model_graph(index.extract(spark, str(tree)))
    assert rows(g.models, "name") == [("mail.thread",), ("res.inner",), ("res.partner",), ("res.users",)]
    fields = {r["name"]: r for r in g.fields.filter("model_name = 'res.partner'").collect()}
    assert set(fields) == {"name", "parent_id", "total", "state", "extra"}
    assert fields["name"]["string"] == "Name" and fields["name"]["required"] and fields["name"]["readonly"] is None
    assert fields["parent_id"]["comodel_name"] == "res.partner" and fields["parent_id"]["string"] == "Parent"
    assert fields["total"]["digits"] == "(16, 2)" and fields["total"]["store"] is False
    assert fields["state"]["selection"] == '[["a", "A"]]' and fields["state"]["default_type"] == "str"
    assert rows(lookups.model_children(g, "mail.thread"), "child") == [("res.partner",)]
    assert rows(lookups.model_delegation(g, "res.users")) == [("res.partner", "partner_id")]
    assert rows(lookups.module_dependents(g, "base"), "dependent") == [("sale",)]
    views = {r["xml_id"]: r for r in g.views.collect()}
    assert views["base.form"]["view_type"] == "form" and views["base.form"]["mode"] == "primary"
    assert (views["other.ext"]["view_type"], views["other.ext"]["inherit_id"], views["other.ext"]["priority"]) == ("tree", "base.form", 20)
    assert views["base.bad"]["priority"] == 16 and views["base.bad"]["errors"]
    assert rows(paths.view_extensions(g, "base.form"), "xml_id") == [("other.ext",)]


def test_plain_rules(spark, tree, rows):
    x = index.extract(spark, str(tree), intended=False)
    fields = {(r["model_name"], r["name"]): r for r in x.fields.collect()}
    assert ("res.partner", "extra") not in fields
    assert fields["res.partner", "parent_id"]["comodel_name"] is None and fields["res.partner", "parent_id"]["string"] == "Parent"
    assert rows(x.views, "xml_id", "view_type", "inherit_id") == [("base.form", "unknown", None)]  # priorities that are no numbers drop their views


def test_class_graph(spark, tree, rows):
    g = index.class_graph(index.extract(spark, str(tree), strict=True, max_depth=None))
    assert ("base:PartnerMore", "base:res.partner") in rows(g.edges["INHERITS"])
    assert ("base", "base.form") in rows(g.edges["CONTAINS"], "src", "dst")
    assert rows(paths.descendants(g, "base:mail.thread", 2), "name") != []
    assert ("base.form", "base:res.partner") in rows(g.edges["DISPLAYS"], "src", "dst")


def test_modules_by_display_name(spark, tree, rows):
    x = index.extract(spark, str(tree))
    g = index.class_graph(x, by_display_name=True)
    assert rows(g.modules, "name") == [("Pröduct",), ("Sales",), ("base",), ("old",)]
    assert {r[0] for r in rows(g.edges["CONTAINS"], "src")} == {"base"}
    assert {r[0] for r in rows(index.class_graph(x).modules, "name")} == {"base", "old", "product", "sale"}


def test_strict_skips_what_is_not_utf8(spark, tree, rows):
    (tree / "base/models/latin.py").write_bytes("# é\nclass L(models.Model):\n    _name = 'latin.one'\n".encode("latin-1"))
    (tree / "base/models/large.py").write_text("class B(models.Model):\n    _name = 'large.one'\n" + "#" * (1 << 20))
    strict, loose = index.extract(spark, str(tree), strict=True, max_depth=None), index.extract(spark, str(tree))
    assert not {("latin.one",), ("large.one",)} & set(rows(strict.defs, "name")) and {("latin.one",), ("large.one",)} <= set(rows(loose.defs, "name"))
    assert ("base/models/latin.py", "not UTF-8") in rows(strict.broken, "path", "error")


def test_dependency_lists(spark, rows):
    m = spark.createDataFrame([("a", "p1", ["x"]), ("a", "p2", ["y", "z"]), ("b", "p1", [])], "name string, file_path string, depends array<string>")
    assert rows(records.dependency_lists(m)) == [("a", ["y", "z"]), ("b", [])]


def test_refresh(spark, tree, tmp_path, rows):
    store = str(tmp_path / "store")
    first = index.refresh(spark, str(tree), store)
    assert rows(first, "change") == [("new",)]
    assert rows(index.refresh(spark, str(tree), store), "change") == [("unchanged",)]
    (tree / "base/models/partner.py").write_text("class T(models.Model):\n    _name = 'only.one'\n")
    (tree / "base/views/partner.xml").unlink()
    (tree / "sale/models").mkdir()
    (tree / "sale/models/o.py").write_text("class O(models.Model):\n    _name = 'sale.order'\n")
    assert {r[0] for r in rows(index.refresh(spark, str(tree), store))} == {"new", "modified", "deleted", "unchanged"}
    kept, full = index.load(spark, store), index.extract(spark, str(tree))
    for name in ("modules", "defs", "fields", "views", "broken"):
        a, b = getattr(kept, name), getattr(full, name)
        assert rows(a, *b.columns) == rows(b), name
    assert rows(kept.state, "path", "hash") == rows(full.state, "path", "hash")


def test_clear(spark, tree, tmp_path, rows):
    store = str(tmp_path / "store")
    index.refresh(spark, str(tree), store)
    index.clear(spark, store)
    assert rows(index.run_counts(index.load(spark, store)), "n") == [(0,)] * 6
    assert index.load(spark, store, 1).modules.count() == 4
    assert rows(index.refresh(spark, str(tree), store), "change") == [("new",)]


def test_parsers_on_odd_input(spark):
    odd = spark.createDataFrame([("a", bytearray(b"")), ("b", bytearray(b"\xff\xfe(")), ("c", bytearray(b"x = 1\n[1]"))], "path string, content binary")
    assert syntax.parse_manifests(odd).filter("loose is not null").count() == 0
    assert syntax.parse_classes(odd).filter("error is not null").count() == 1
    assert syntax.parse_records(odd).filter("error is not null").count() == 3


def test_states(spark, tree, rows):
    listed = files.listing(spark, str(tree)).filter(files.is_watched_file() & ~files.F.col("is_dir"))
    s = files.states(listed, str(tree), time.time())
    assert s.filter("path = 'base/models/__init__.py'").first()["hash"] == "e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855"


def test_command_line(spark, tree, tmp_path, rows):
    from codeatlas import cli

    ask = lambda *a: cli.answer(spark, cli.parser().parse_args(["--store", str(tmp_path / "s"), *a]))
    ask("index", str(tree))
    assert rows(ask("dependencies", "sale")[0], "dependency") == [("base",), ("product",)]
    assert rows(ask("dependencies", "base", "--reverse")[0], "dependent") == [("sale",)]
    found = ask("find-model", "res.partner", "--fields", "--limit", "2")
    assert rows(found[0], "kind") == [("base",)] and found[1].count() == 2
    assert ("res.users", "", "partner.py") in rows(ask("list-models", "base")[0])
    assert rows(ask("inheritance", "res.partner")[0], "parent") == [("mail.thread",)]
    assert rows(ask("find-field", "extra")[0], "model") == [("res.partner",)]
    assert ask("sql", "select count(*) from edges")[0].first()[0] > 0
    assert rows(ask("dump", str(tmp_path / "out"))[0]) == [("modules", 4)]
    dumped = {r["name"]: r for r in spark.read.json(str(tmp_path / "out")).collect()}
    assert set(dumped) == {"sale", "base", "old", "product"} and dumped["sale"]["depends"] == ["base", "product"] and dumped["sale"]["display_name"] == "Sales"
    assert ask("dump", str(tmp_path / "edges"), "--table", "edges")[0].first()["n"] == spark.read.json(str(tmp_path / "edges")).count() > 0
    assert ask("stats")[0].count() > 0 and ask("config")[0].count() >= 1


def places(store, version):
    """table/bucket of all that a version has written."""
    from pathlib import Path

    return {"/".join(p.parts[-3:-1]) for p in Path(store).glob(f"version={version}/*/bucket=*/*.parquet")}


def test_refresh_writes_touched_buckets_only(spark, tmp_path, rows):
    root, store = tmp_path / "many", str(tmp_path / "store")
    for k in range(40):
        (root / f"m{k}/models").mkdir(parents=True)
        (root / f"m{k}/__manifest__.py").write_text(f"{{'name': 'M{k}'}}")
        (root / f"m{k}/models/a.py").write_text(f"class A(models.Model):\n    _name = 'a{k}'\n    x = fields.Char()\n")
    index.refresh(spark, str(root), store)
    assert index.versions(spark, store) == [1]
    index.refresh(spark, str(root), store)
    assert index.versions(spark, store) == [1]  # nothing has changed
    (root / "m7/models/a.py").write_text("class A(models.Model):\n    _name = 'other'\n")
    index.refresh(spark, str(root), store)
    bucket = index.bucket_of("p", index.BUCKETS)
    own = spark.createDataFrame([("m7/models/a.py",)], "p string").select(bucket).first()[0]
    assert index.versions(spark, store) == [1, 2] and {p.split("/")[1] for p in places(store, 2)} == {f"bucket={own}"}
    assert len(places(store, 1)) > 60
    now, before = index.load(spark, store), index.load(spark, store, 1)
    assert {r[0] for r in rows(before.defs, "name")} - {r[0] for r in rows(now.defs, "name")} == {"a7"}
    assert now.fields.count() == 39 and before.fields.count() == 40 and rows(now.modules) == rows(before.modules)
    (root / "m9/__manifest__.py").unlink()  # a module goes, with all its files
    (root / "m3/__openerp__.py").write_text("{'name': 'older'}")  # not the preferred manifest
    assert dict(index.refresh(spark, str(root), store).collect()) == {"deleted": 2, "new": 1, "unchanged": 78}
    now = index.load(spark, store)
    assert ("m9",) not in rows(now.modules, "name") and now.modules.count() == 39 and ("a9",) not in rows(now.defs, "name")
    (root / "m3/__manifest__.py").unlink()
    index.refresh(spark, str(root), store)
    assert rows(index.load(spark, store).modules.filter("name = 'm3'"), "display_name", "manifest_file") == [("older", "__openerp__.py")]
    full = index.extract(spark, str(root))
    for name in ("modules", "defs", "fields", "views", "broken"):
        assert rows(getattr(index.load(spark, store), name), *getattr(full, name).columns) == rows(getattr(full, name)), name


def test_run_counts_are_taken_while_writing(spark, tree, tmp_path, rows):
    x, store = index.extract(spark, str(tree), strict=True, max_depth=None), str(tmp_path / "store")
    counts = index.save(x, store)
    stored = index.load(spark, store)
    assert {k: n for k, n in counts.items() if k != "errors"} == dict(index.run_counts(stored).collect())
    assert counts["errors"] == stored.broken.count() + sum(len(r["errors"]) for r in stored.modules.collect()) > 2
    assert dict(index.runs(spark, store).select("name", "n").collect()) == counts
    report = dict(index.run_report(spark, counts, 7, 1.5).collect())
    assert report["relationships"] == 7 and report["seconds"] == 1.5 and report["modules"] == counts["modules"]


def test_contents_come_many_files_a_batch(spark, tmp_path):
    """Files are read into common batches with the columns to keep; unreadable ones are left out."""
    from codeatlas.sources import files

    for k in range(300):
        (tmp_path / f"f{k}.py").write_text(f"x = {k}\n")
    listed = spark.createDataFrame([(f"f{k}.py", f"m{k}") for k in range(310)], "path string, module string").coalesce(1)
    found = files.contents(listed, str(tmp_path), ("module",))
    assert sorted((r["path"], r["module"], bytes(r["content"])) for r in found.collect()) == sorted((f"f{k}.py", f"m{k}", f"x = {k}\n".encode()) for k in range(300))
    sizes = found.select("path").mapInArrow(lambda batches: (type(b).from_pydict({"n": [b.num_rows]}) for b in batches), "n long").collect()
    assert len(sizes) < 300


def test_parsers_keep_columns(spark):
    from codeatlas.sources import syntax

    made = spark.createDataFrame([(f"p{k}", f"class A{k}: pass\nclass B{k}: pass\n".encode(), f"m{k}") for k in range(2100)], "path string, content binary, module string").coalesce(1)
    found = syntax.parse_classes(made, keep=("module",)).select("path", "class_name", "module").collect()
    assert sorted(map(tuple, found)) == sorted((f"p{k}", f"{c}{k}", f"m{k}") for k in range(2100) for c in "AB")
