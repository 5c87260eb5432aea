"""Paths of variable length. A path never uses an edge twice but may meet a node again, and each path is a row of its own.

Levels are a chain of joins in one plan: every node also has an arc to stay where it is, which paths that have ended take, so no level is read
twice. Every few levels the rows are settled in the shared folder. Loops end with the depth bound or the first level without rows.
"""

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..graph import Graph, observed, settled

#: Levels of one plan.
LEVELS = 5
#: Steps of one plan where rows are few and small: labels that spread.
STEPS = 8


def with_stays(arcs: DataFrame) -> DataFrame:
    """arcs (a, b, ...) and for each node an arc of its own, with stay = true and nulls elsewhere."""
    nodes = arcs.select("a").unionByName(arcs.select(F.col("b").alias("a"))).distinct()
    return arcs.withColumn("stay", F.lit(False)).unionByName(nodes.withColumn("stay", F.lit(True)), allowMissingColumns=True)


def stepped(level: DataFrame, arcs: DataFrame, depth: int, new: dict[str, Column], free: Column | None = None) -> DataFrame:
    """level's rows, and those of depth - 1 continued over arcs (of with_stays) that are free. new: columns of a row that has gone on."""
    on = (F.col("node") == F.col("a")) & (F.col("stay") | ((F.col("depth") == depth - 1) & (F.lit(True) if free is None else free)))
    new = {"node": F.col("b"), "depth": F.lit(depth), **new}
    return level.join(arcs, on).select(*[F.when(F.col("stay"), F.col(c)).otherwise(new[c]).alias(c) if c in new else F.col(c) for c in level.columns])


def trails(edges: DataFrame, starts: DataFrame, least: int, most: int, levels: int = LEVELS) -> DataFrame:
    """(start, node, depth, path, first_label) of all trails of least to most edges from starts (start). edges: (a, b), with id and label if given.

    levels: how many are one plan; for a few starts that may be all of them.
    """
    return _trails(edges, starts, least, most, levels).drop("used")


def _trails(edges: DataFrame, starts: DataFrame, least: int, most: int, levels: int = LEVELS) -> DataFrame:
    e = edges if "id" in edges.columns else edges.withColumn("id", F.struct("a", "b"))
    e = e if "label" in e.columns else e.withColumn("label", F.lit(None).cast("string"))
    kind = e.schema["id"].dataType.simpleString()
    arcs = with_stays(e)
    alone = starts.select("start", F.col("start").alias("node"), F.lit(0).alias("depth"), F.array("start").alias("path"), F.expr(f"cast(array() as array<{kind}>)").alias("used"), F.lit(None).cast("string").alias("first_label"))
    level = alone.join(arcs.filter("stay").select(F.col("a").alias("node")), "node", "left_semi").select(*alone.columns)
    out = [alone] if least == 0 else []
    new = {"path": F.array_append("path", F.col("b")), "used": F.array_append("used", F.col("id")), "first_label": F.coalesce("first_label", "label")}
    for depth in range(1, most + 1, levels):
        last = min(depth + levels - 1, most)
        for d in range(depth, last + 1):
            level = stepped(level, arcs, d, new, ~F.array_contains("used", F.col("id")))
        if last == most:
            out.append(level.filter(F.col("depth") >= max(least, depth)))
            break
        found, seen = observed(level, "trails", n=F.count(F.when(F.col("depth") == last, 1)))
        out.append(found.filter(F.col("depth") >= max(least, depth)))
        level = found.filter(F.col("depth") == last)
        if not seen["n"]:
            break
    return reduce(DataFrame.unionByName, out)


def _arcs(df: DataFrame, reverse: bool = False) -> DataFrame:
    a, b = ("dst", "src") if reverse else ("src", "dst")
    return df.select(F.col(a).alias("a"), F.col(b).alias("b")).distinct()


def _named(nodes: DataFrame, key: str, name: str) -> DataFrame:
    return nodes.filter(F.col(key) == name).select(F.col(key).alias("start")).distinct()


def ancestors(graph: Graph, model: str, max_depth: int = 10) -> DataFrame:
    """model, parent, depth: the model itself at depth 0, then a row for each path upwards."""
    found = trails(_arcs(graph.edges["INHERITS_FROM"]), _named(graph.models, "name", model), 0, max_depth, max_depth)
    return found.select(F.col("start").alias("model"), F.col("node").alias("parent"), "depth").orderBy("depth", "parent")


def descendants(graph: Graph, model: str, max_depth: int = 10) -> DataFrame:
    """name, module, description: a row for each path down to a child."""
    found = trails(_arcs(graph.edges["INHERITS_FROM"], True), _named(graph.models, "name", model), 1, max_depth, max_depth)
    return found.select(F.col("node").alias("name"), "depth").join(graph.models, "name").select("name", "module", "description", "depth")


def view_extensions(graph: Graph, xml_id: str, max_depth: int = 10) -> DataFrame:
    found = trails(_arcs(graph.edges["EXTENDS"], True), _named(graph.views, "xml_id", xml_id), 1, max_depth, max_depth)
    return found.select(F.col("node").alias("xml_id"), "depth").join(graph.views, "xml_id").select("xml_id", "name", "view_type", "depth")


# ---- strongly connected components


def trimmed(arcs: DataFrame, rounds: int = 3) -> DataFrame:
    """Distinct arcs (a, b) without those that start at nodes that nothing leads to, or end at nodes that lead nowhere: such arcs are on no cycle. Settled."""
    arcs, seen = observed(arcs.select("a", "b").distinct(), "arcs", n=F.count(F.lit(1)))
    for _ in range(rounds):
        inner = arcs.select(F.col("a").alias("node")).intersect(arcs.select(F.col("b").alias("node")))
        kept = arcs.join(inner.withColumnRenamed("node", "a"), "a", "left_semi").join(inner.withColumnRenamed("node", "b"), "b", "left_semi").select("a", "b")
        before = seen["n"]
        arcs, seen = observed(kept, "arcs", n=F.count(F.lit(1)))
        if seen["n"] == before:
            break
    return arcs


def spread(arcs: DataFrame, marks: DataFrame) -> DataFrame:
    """marks (node, mark, ...) where every node takes the greatest mark of the nodes that lead to it over any number of arcs (node, to)."""
    steps = settled(arcs.unionByName(arcs.select("node").unionByName(arcs.select(F.col("to").alias("node"))).distinct().withColumn("to", F.col("node"))), "steps")
    while True:
        new = marks.withColumn("old", F.col("mark"))
        for _ in range(STEPS):
            own = F.max(F.when(F.col("to") == F.col("node"), F.col("old"))).alias("old")
            new = new.join(steps, "node").groupBy(F.col("to").alias("node")).agg(F.max("mark").alias("mark"), own)
        new, seen = observed(new, "spread", moved=F.count(F.when(~F.col("mark").eqNullSafe(F.col("old")), 1)))
        marks = new.select("node", "mark")
        if not seen["moved"]:
            return marks


def strong_components(edges: DataFrame) -> DataFrame:
    """(node, component): of each node of edges (a, b) that is on a cycle of several nodes, the least node of its strongly connected component.

    Forward and backward colouring: a node takes the greatest name that leads to it as its colour, and the nodes of a colour that lead back to
    the node it is named after are a component. Arcs between colours, and those of finished components, go; the rest is coloured again.
    """
    out = []
    arcs = trimmed(edges.filter("a <> b"))
    while not arcs.isEmpty():
        forth = arcs.select(F.col("a").alias("node"), F.col("b").alias("to"))
        names = forth.select("node").unionByName(forth.select(F.col("to").alias("node"))).distinct()
        colours = spread(forth, names.withColumn("mark", F.col("node")))
        colour = lambda key, name: colours.select(F.col("node").alias(key), F.col("mark").alias(name))
        within = settled(arcs.join(colour("a", "ca"), "a").join(colour("b", "cb"), "b").filter("ca = cb").select("a", "b", F.col("ca").alias("c")), "within")
        back = spread(within.select(F.col("b").alias("node"), F.col("a").alias("to")), colours.select("node", F.when(F.col("node") == F.col("mark"), F.lit(1)).otherwise(0).alias("mark")))
        whole = colours.join(back.filter("mark = 1").select("node"), "node", "left_semi")
        whole = settled(whole.select("node", F.min("node").over(_by("mark")).alias("component"), F.count("*").over(_by("mark")).alias("n")), "components")
        out.append(whole.filter("n > 1").select("node", "component"))
        rest = within.join(whole.select(F.col("node").alias("a")), "a", "left_anti").join(whole.select(F.col("node").alias("b")), "b", "left_anti")
        arcs = trimmed(rest)
    return reduce(DataFrame.unionByName, out) if out else edges.limit(0).select(F.col("a").alias("node"), F.col("a").alias("component"))


def _by(column: str):
    from pyspark.sql import Window

    return Window.partitionBy(column)


def cyclic_arcs(arcs: DataFrame) -> DataFrame:
    """The arcs (a, b) inside strongly connected components, loops at one node included: those on cycles."""
    part = strong_components(arcs)
    inside = arcs.join(part.select(F.col("node").alias("a"), F.col("component").alias("ca")), "a", "left").join(part.select(F.col("node").alias("b"), F.col("component").alias("cb")), "b", "left")
    return inside.filter("a = b or ca = cb").select("a", "b")


def dependency_components(graph: Graph) -> DataFrame:
    """module, component, size: modules that depend on each other, directly or not, by the least name among them."""
    found = strong_components(_arcs(graph.edges["DEPENDS_ON"]))
    return found.select(F.col("node").alias("module"), "component", F.count("*").over(_by("component")).alias("size"))


def dependency_cycles(graph: Graph, max_depth: int = 10, by_component: bool = False) -> DataFrame:
    """module, cycle_length, cycle_path of each closed trail, once for each module that it may start from.

    Arcs are followed for half of the depth only: a closed trail is a trail out and a trail back, as long or one arc shorter, that share no arc.
    So trails that can't return in the depth left are never made. by_component: only arcs inside strongly connected components are followed, which
    pays where few of many arcs are on cycles; the result is the same.
    """
    arcs = _arcs(graph.edges["DEPENDS_ON"])
    arcs = settled(cyclic_arcs(arcs), "cyclic") if by_component else trimmed(arcs)
    half = settled(_trails(arcs, arcs.select(F.col("a").alias("start")).distinct(), 0, (max_depth + 1) // 2), "halves")
    there = half.filter("depth > 0").select("start", "node", "depth", "path", "used")
    back = half.select(F.col("start").alias("node"), F.col("node").alias("start"), F.col("depth").alias("more"), F.col("path").alias("rest"), F.col("used").alias("other"))
    both = there.join(back, ["start", "node"]).filter((F.col("more") <= F.col("depth")) & (F.col("more") >= F.col("depth") - 1) & (F.col("depth") + F.col("more") <= max_depth) & ~F.arrays_overlap("used", "other"))
    found = both.select(F.col("start").alias("module"), (F.col("depth") + F.col("more")).alias("cycle_length"), F.concat("path", F.slice("rest", 2, F.size("rest"))).alias("cycle_path"))
    return found.orderBy("cycle_length", "module", "cycle_path")


# ---- shortest chains


def dependency_chains(graph: Graph, source: str, max_depth: int = 10) -> DataFrame:
    """target, path, depth: one shortest path, the least in order, to every module that can be reached."""
    arcs = with_stays(_arcs(graph.edges["DEPENDS_ON"]))
    level = graph.modules.filter(F.col("name") == source).select(F.col("name").alias("node"), F.lit(0).alias("depth"), F.array("name").alias("path")).distinct()
    for depth in range(1, max_depth + 1, LEVELS):
        last = min(depth + LEVELS - 1, max_depth)
        for d in range(depth, last + 1):
            step = stepped(level, arcs, d, {"path": F.array_append("path", F.col("b"))})
            level = step.groupBy("node").agg(F.min(F.struct("depth", "path")).alias("best")).select("node", "best.depth", "best.path")
        if last < max_depth:
            level, seen = observed(level, "chains", n=F.count(F.when(F.col("depth") == last, 1)))
            if not seen["n"]:
                break
    return level.filter("depth > 0").select(F.col("node").alias("target"), "path", "depth")


def _layer(front: DataFrame, arcs: DataFrame, seen: DataFrame, other: DataFrame, depth: int) -> tuple[DataFrame, dict]:
    """The nodes one arc (node, to) beyond a front that haven't been seen: node, depth, met (whether the other front has it); how many there are."""
    step = arcs.join(front.select("node"), "node", "left_semi").select(F.col("to").alias("node")).distinct()
    new = step.join(seen.select("node"), "node", "left_anti").join(other.select("node", F.lit(True).alias("met")), "node", "left")
    return observed(new.select("node", F.lit(depth).alias("depth"), F.coalesce("met", F.lit(False)).alias("met")), "layer", n=F.count(F.lit(1)), met=F.count(F.when(F.col("met"), 1)))


def dependency_chain(graph: Graph, source: str, target: str, max_depth: int = 10) -> DataFrame:
    """path and depth of one shortest chain between two modules, the least in order; no row if there is none.

    Two fronts, of which the smaller one moves, grow from both ends until they meet. They hold nodes and distances alone. From where they
    meet, pointers to the least next node that still leads to the target are set back to the source, and the path follows these.
    """
    if source == target:
        raise ValueError("a chain needs two different modules")
    spark = graph.spark
    ends = graph.modules.filter(F.col("name").isin(source, target)).select("name").distinct()
    none = spark.range(0).select(F.expr("cast(array() as array<string>)").alias("path"), F.lit(0).alias("depth"))
    if ends.count() < 2:
        return none
    arcs = graph.edges["DEPENDS_ON"].select(F.col("src").alias("node"), F.col("dst").alias("to"))
    back = arcs.select(F.col("to").alias("node"), F.col("node").alias("to"))
    layers = {end: [spark.range(1).select(F.lit(name).alias("node"), F.lit(0).alias("depth"), F.lit(False).alias("met"))] for end, name in (("out", source), ("in", target))}
    sizes, seen = {"out": 1, "in": 1}, {end: layers[end][0] for end in layers}
    while True:
        if len(layers["out"]) + len(layers["in"]) - 2 >= max_depth:
            return none
        end, other = ("out", "in") if sizes["out"] <= sizes["in"] else ("in", "out")
        new, counts = _layer(layers[end][-1], arcs if end == "out" else back, seen[end], layers[other][-1], len(layers[end]))
        layers[end].append(new)
        seen[end], sizes[end] = seen[end].unionByName(new), counts["n"]
        if not sizes[end]:
            return none
        if counts["met"]:
            met = new.filter("met")
            break
    n = len(layers["out"]) - 1
    depth = n + len(layers["in"]) - 1
    ahead, pointers = (met.select("node") if end == "out" else layers["out"][-1].join(met.select("node"), "node", "left_semi").select("node")), []
    for k in range(n - 1, -1, -1):  # nodes of the outgoing layers that lead on, with the least next one
        step = arcs.join(ahead.select(F.col("node").alias("to")), "to", "left_semi").join(layers["out"][k].select("node"), "node", "left_semi")
        step = step.groupBy("node").agg(F.min("to").alias("to"))
        pointers.append(step)
        ahead = step.select("node")
    pointers.reverse()
    for k in range(n, depth):  # incoming layers hold exactly the nodes that lead to the target
        later = layers["in"][depth - k - 1].select(F.col("node").alias("to"))
        pointers.append(arcs.join(later, "to", "left_semi").join(layers["in"][depth - k].select("node"), "node", "left_semi").groupBy("node").agg(F.min("to").alias("to")))
    row = layers["out"][0].select("node", F.array("node").alias("path"))
    for step in pointers:
        row = row.join(step, "node").select(F.col("to").alias("node"), F.array_append("path", F.col("to")).alias("path"))
    return row.select("path", F.lit(depth).alias("depth"))


def neighbourhood(graph: Graph, model: str, depth: int = 2) -> DataFrame:
    """center, related, relation (type of the first edge), distance over inheritance and delegation, in either direction."""
    e = graph.typed_edges("INHERITS_FROM", "DELEGATES_TO").distinct().withColumn("id", F.to_json(F.struct("rel_type", "src", "dst", "field")))
    forth = e.select(F.col("src").alias("a"), F.col("dst").alias("b"), "id", F.col("rel_type").alias("label"))
    back = e.filter("src <> dst").select(F.col("dst").alias("a"), F.col("src").alias("b"), "id", F.col("rel_type").alias("label"))
    found = trails(forth.unionByName(back), _named(graph.models, "name", model), 0, depth)
    return found.select(F.col("start").alias("center"), F.col("node").alias("related"), F.col("first_label").alias("relation"), F.col("depth").alias("distance")).distinct().orderBy("distance", "related")
