"""The data source of source trees against os.walk, with and without pushed filters."""

import os

import pytest
from pyspark.sql import functions as F

from codeatlas.sources import files, index, tree


@pytest.fixture(scope="module")
def root(tmp_path_factory):
    top = tmp_path_factory.mktemp("tree")
    put = lambda path, text="x": ((top / path).parent.mkdir(parents=True, exist_ok=True), (top / path).write_text(text))
    for k in range(6):
        put(f"addons/m{k}/__manifest__.py", f"{{'name': 'M{k}', 'depends': ['base']}}")
        put(f"addons/m{k}/models/a.py", "y = 1\n" * k)
        put(f"addons/m{k}/models/deep/er/b.py", "z")
    put("addons/m0/m3/__manifest__.py", "{'name': 'inside another'}")
    put("addons/m5/__openerp__.py", "{'name': 'older'}")
    put("old/x/__openerp__.py", "{'name': 'X', 'version': '9'}")
    put("a/b/c/d/e/far/__manifest__.py", "{'name': 'far'}")
    put(".hidden/h/__manifest__.py", "{'name': 'h'}")
    put("big/__manifest__.py", "{'name': 'big'}" + " " * (1 << 20))
    put("README.md", "top")
    os.symlink(top / "addons", top / "link")
    return str(top)


def walked(root, hidden=False):
    out = set()
    for at, dirs, names in os.walk(root):
        dirs[:] = [d for d in dirs if (hidden or not d.startswith(".")) and not os.path.islink(f"{at}/{d}")]
        parent = os.path.relpath(at, root).replace(".", "", 1) if at == root else os.path.relpath(at, root)
        for n in dirs + names:
            path = f"{parent}/{n}".lstrip("/")
            out.add((path, parent, n, parent.rpartition("/")[2], n in dirs, None if n in dirs else os.path.getsize(f"{at}/{n}"), path.count("/")))
    return out


COLUMNS = ("path", "parent", "name", "directory", "is_dir", "length", "depth")


@pytest.mark.parametrize("hidden", [False, True])
@pytest.mark.parametrize("partitions", [1, 3, 50])
def test_listing(spark, root, hidden, partitions):
    got = tree.read(spark, root, hidden=hidden, partitions=partitions).select(*COLUMNS).collect()
    assert {tuple(r) for r in got} == walked(root, hidden) and len(got) == len(walked(root, hidden))


FILTERS = ["name = 'a.py'", "name in ('a.py', 'b.py') and depth <= 3", "length <= 6", "not (length <= 6)", "length > 3 and depth < 4", "name like '%.py' and name like 'b%'", "is_dir", "not is_dir and depth = 0", "length is null", "length is not null and not name = 'a.py'", "directory = 'm2' or name = 'README.md'", "not (length is null)", "parent <=> 'addons/m1'", "depth in (0, 2)", "depth < 0", "name like '%dme%' or length % 2 = 1", "depth <= 9 and depth >= 4"]


@pytest.mark.parametrize("condition", FILTERS)
def test_filters(spark, root, condition):
    """With filters pushed down the rows are those that Spark's own filter leaves of all entries."""
    everything = spark.createDataFrame(sorted(walked(root)), "path string, parent string, name string, directory string, is_dir boolean, length long, depth int")
    got = tree.read(spark, root).filter(condition).select(*COLUMNS).collect()
    want = everything.filter(condition).collect()
    assert sorted(got, key=repr) == sorted(want, key=repr)


def test_plan_shows_pushed_filters(spark, root):
    df = tree.read(spark, root, content=True).filter((F.col("name") == "a.py") & (F.col("length") <= files.PYTHON_BYTES) & (F.col("depth") <= 3))
    plan = df._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    assert "LessThanOrEqual(length,1048576)" in plan and "EqualTo(name,a.py)" in plan and "Filter" not in plan.replace("PushedFilters", "").replace("(Filter", "")


def test_contents_and_prune(spark, root):
    read = lambda **o: {r["path"]: r["content"] and bytes(r["content"]) for r in tree.read(spark, root, content=True, **o).filter("not is_dir").collect()}
    everything = read()
    assert everything["addons/m2/models/a.py"] == b"y = 1\n" * 2 and len(everything["big/__manifest__.py"]) > 1 << 20
    small = read(contentBytes=files.MANIFEST_BYTES)
    assert small["big/__manifest__.py"] is None and small["addons/m2/models/a.py"] == b"y = 1\n" * 2
    assert set(read(prune="__manifest__.py,__openerp__.py")) == {p for p in everything if not any(f"/{x}/" in f"/{p}" for x in ("models", "m0/m3"))}


def test_missing_root(spark, root):
    with pytest.raises(files.ModuleRootError):
        files.listing(spark, f"{root}/none")
    with pytest.raises(Exception, match="no such directory"):
        tree.read(spark, f"{root}/none").count()


@pytest.mark.parametrize("strict", [False, True])
def test_find_module(spark, root, strict):
    """The module's record equals that of a whole extraction; modules inside others, too deep or hidden ones aren't found in the loose reading."""
    whole = {r["name"]: r for r in index.extract(spark, root, strict).modules.collect()}
    for name in ("m1", "m3", "m5", "x", "far", "h", "big", "none"):
        got = index.find_module(spark, root, name, strict).collect()
        assert [r["file_path"] for r in got] == ([whole[name]["file_path"]] if name in whole else []), name
        assert not got or got[0] == whole[name]
