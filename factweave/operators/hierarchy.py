"""Parent-child rows to full hierarchies: paths, depths, roots, descendants and loops.

Everything runs level by level: a frontier is joined with the edges below it, written to the shared folder and
joined again, until it is empty. Ways of several edges are made once, by joining ways with ways, so that one round
goes several levels on. A parent with very many children is sliced: its edges carry a slice number and a frontier row
goes to each slice, so no task gets all children of one parent.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.names import raw_name
from ..session import cut


def latest_rows(types: DataFrame, key: str = "fqn", at: str = "scanned_at") -> DataFrame:
    """Of rows with the same key the one with the latest time; a row without time is the oldest, ties go to the row
    that sorts last. Rows without key are left out."""
    others = [c for c in types.columns if c != key]
    row = F.struct(F.col(f"`{at}`").alias("_at"), *[F.col(f"`{c}`") for c in others])
    newest = types.where(F.col(f"`{key}`").isNotNull()).groupBy(key).agg(F.max(row).alias("_row"))
    return newest.select(key, *[F.col("_row").getField(c).alias(c) for c in others])


def parents_of(superclass: Column, interfaces: Column) -> Column:
    """The array of a type's parents, each once: read plainly, without type arguments, blanks and the root class."""
    names = F.concat(F.array(superclass), F.coalesce(interfaces, F.array().cast("array<string>")))
    return F.array_distinct(F.filter(F.transform(names, raw_name), lambda x: x.isNotNull() & (x != "") & (x != "java.lang.Object")))


def build_graph(types: DataFrame, slice_rows: int = 200_000) -> tuple[DataFrame, DataFrame, DataFrame]:
    """nodes(fqn, parents, slices), inner edges(parent, slice, node, slices) and outer edges(parent, node, slices) whose
    parent has no row, from types(fqn, superclass, interfaces, scanned_at). `slices` is the node's own as a parent.

    A parent is sliced if it has more than `slice_rows` children, and more than a ten thousandth of all edges: hence
    there are at most ten thousand such parents, and their names are sent to every task."""
    held = latest_rows(types.select("fqn", "superclass", "interfaces", "scanned_at"))
    held = cut(held.select("fqn", parents_of(F.col("superclass"), F.col("interfaces")).alias("parents")))
    edges = held.select(F.explode("parents").alias("parent"), F.col("fqn").alias("node"))
    limit = max(slice_rows, (held.agg(F.sum(F.size("parents"))).head()[0] or 0) // 10_000)
    wide = cut(edges.groupBy("parent").count().where(F.col("count") > limit).select("parent", F.ceil(F.col("count") / limit).cast("int").alias("n")))
    of = lambda name, n: F.broadcast(wide.select(F.col("parent").alias(name), F.col("n").alias(n)))
    sliced = edges.join(of("parent", "own"), "parent", "left").join(of("node", "n"), "node", "left")
    sliced = sliced.select("parent", F.pmod(F.xxhash64("node"), F.coalesce("own", F.lit(1))).cast("int").alias("slice"), "node", F.coalesce("n", F.lit(1)).alias("slices"))
    nodes = held.join(of("fqn", "n"), "fqn", "left").select("fqn", "parents", F.coalesce("n", F.lit(1)).alias("slices"))
    known = held.select(F.col("fqn").alias("parent"), F.lit(True).alias("inner"))
    marked = cut(sliced.join(known, "parent", "left").withColumn("inner", F.coalesce("inner", F.lit(False))))
    return nodes, marked.where("inner").drop("inner"), marked.where("not inner").select("parent", "node", "slices")


def _empty(df: DataFrame) -> bool:
    return not df.head(1)


def _spread(nodes: DataFrame) -> DataFrame:
    """(parent, slice, ...) for each slice of nodes(node, slices, ...), to join with ways down from them."""
    return nodes.withColumn("slice", F.explode(F.sequence(F.lit(0), F.col("slices") - 1))).drop("slices").withColumnRenamed("node", "parent")


def _then(first: DataFrame, second: DataFrame) -> DataFrame:
    """The pairs(parent, slice, node, slices) joined by a way of the first and one of the second."""
    middle = first.select(F.col("parent").alias("top"), F.col("slice").alias("top_slice"), "node", "slices")
    return _spread(middle).join(second, ["parent", "slice"]).select(F.col("top").alias("parent"), F.col("top_slice").alias("slice"), "node", "slices").distinct()


def powers(edges: DataFrame) -> list[DataFrame]:
    """The edges, and the pairs joined by ways of exactly eight of them."""
    out = [edges]
    for k in range(3):
        out.append(cut(_then(out[-1], out[-1]), *out[-1:] * (k > 0)))
    return [edges, out[-1]]


def _staying(start: DataFrame, step) -> DataFrame:
    """The nodes that are left when `step`, which gives those of them that stay, changes nothing any more. Two steps go
    into each round, since what one of them takes away the next would take away as well."""
    left, size = cut(start), None
    while (now := left.count()) != size and now:
        size = now
        left = cut(step(step(left)), left)
    return left


def fed_by_loops(far: DataFrame) -> DataFrame:
    """The nodes(node, slices) to which ways of any length lead: those of loops and those below. Round after round the
    nodes stay that a way of several edges, one of the pairs `far`, reaches from a node that stayed."""
    return _staying(far.select("node", "slices").distinct(), lambda left: far.join(_spread(left), ["parent", "slice"], "left_semi").select("node", "slices").distinct())


def feeding_loops(far: DataFrame) -> DataFrame:
    """The nodes(node) from which ways of any length lead on: those of loops and those above."""
    return _staying(far.select(F.col("parent").alias("node")).distinct(), lambda left: far.join(left, "node", "left_semi").select(F.col("parent").alias("node")).distinct())


def between(ways: DataFrame, nodes: DataFrame) -> DataFrame:
    """The ways both of whose ends are among nodes(node, slices)."""
    return ways.join(_spread(nodes), ["parent", "slice"], "left_semi").join(nodes.select("node"), "node", "left_semi").select("parent", "slice", "node", "slices")


def merged_loops(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes that reach one another by up to eight edges each way lie on one loop: (node, label) gives such nodes the least
    name of those they meet, and the edges between labels are the graph in which loops so short are points."""
    within = edges
    for k in range(3):
        within = cut(_then(within, within).union(within).distinct(), *[within] * (k > 0))
    back = within.select(F.col("parent").alias("node"), F.col("node").alias("other"))
    met = within.join(back, (within.node == back.node) & (within.parent == back.other)).select(within.node.alias("node"), F.col("parent").alias("other"))
    labels = cut(met.groupBy("node").agg(F.least(F.min("other"), F.first("node")).alias("label")))
    named = edges.join(labels.select(F.col("node").alias("parent"), F.col("label").alias("top")), "parent", "left").join(labels, "node", "left")
    points = named.select(F.coalesce("top", "parent").alias("parent"), F.coalesce("label", "node").alias("node")).where("parent <> node").distinct()
    return labels, cut(points.select("parent", F.lit(0).alias("slice"), "node", F.lit(1).alias("slices")))


def loop_members(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Those of nodes(node, slices) that are their own ancestors by the edges between them: those on short loops, and those
    on loops that are left once these are points."""
    labels, points = merged_loops(nodes, edges)
    members = labels.select("node")
    far = powers(points)[-1]
    fed = fed_by_loops(far)
    if _empty(fed):
        return members
    rest = cut(fed.join(feeding_loops(far), "node", "left_semi"))
    more = long_loop_members(rest, *[between(x, rest) for x in (points, points.union(far))])
    return cut(members.union(more).distinct())


def long_loop_members(nodes: DataFrame, edges: DataFrame, ways: DataFrame) -> DataFrame:
    """Those of nodes(node, slices) that are their own ancestors by the edges between them. `ways` are pairs of any
    lengths along the edges, these included.

    Every node takes the least name above it until nothing changes; those from which the namesake can be reached
    again, within one name, form its component. What isn't in a component of its own goes round again.
    """
    members = edges.where("parent = node").select("node")
    ways = cut(ways.where("parent <> node").distinct())
    while not _empty(ways):
        colour = nodes.withColumn("colour", F.col("node"))
        while True:  # least name among all ancestors
            above = ways.join(_spread(colour), ["parent", "slice"]).groupBy("node").agg(F.min("colour").alias("above"))
            step = cut(colour.join(above, "node", "left").select("node", "slices", F.least("colour", "above").alias("now"), "colour"))
            colour = step.select("node", "slices", F.col("now").alias("colour"))
            if _empty(step.where("now <> colour")):
                break
        named = ways.join(_spread(colour), ["parent", "slice"])
        same = cut(named.join(colour.select("node", F.col("colour").alias("own")), "node").where("colour = own").select("parent", "node", "colour"))
        reached = frontier = cut(colour.where("node = colour").select("node", "colour"))
        while True:  # up from the namesake, within its colour
            up = same.join(frontier.select("node"), "node", "left_semi").select(F.col("parent").alias("node"), "colour").distinct()
            frontier = cut(up.join(reached, "node", "left_anti"))
            if _empty(frontier):
                break
            reached = reached.union(frontier)
        reached = cut(reached)
        big = reached.groupBy("colour").count().where("count > 1").select("colour")
        members = members.union(reached.join(big, "colour", "left_semi").select("node"))
        nodes = cut(colour.select("node", "slices").join(reached, "node", "left_anti"))
        ways = cut(between(ways, nodes))
    return cut(members.distinct())


def loops_and_below(inner: DataFrame) -> tuple[DataFrame, DataFrame] | None:
    """By inner edges the nodes(node, slices) in or below loops, and those of them in loops(node); None without any."""
    pairs = powers(inner)
    stuck = fed_by_loops(pairs[-1])
    if _empty(stuck):
        return None
    near, far = (cut(x.join(_spread(stuck), ["parent", "slice"], "left_semi")) for x in (pairs[0], pairs[-1]))  # what is below them is stuck too
    core = cut(stuck.join(feeding_loops(far), "node", "left_semi"))
    return stuck, loop_members(core, cut(between(near, core)))


def _tails(edges: DataFrame) -> tuple[DataFrame, int]:
    """Ways of 1 to 8 edges without loops: (parent, slice, tail, node, hops, slices), `tail` joining the names after the
    parent, and the most edges of any. A node has no more of one length than ways from roots."""
    found = longest = edges.select("parent", "slice", F.col("node").alias("tail"), "node", F.lit(1).alias("hops"), "slices")
    for k in (1, 2, 4):  # the longest so far with all so far: up to twice as long
        first = longest.select(F.col("parent").alias("top"), F.col("slice").alias("top_slice"), F.col("tail").alias("begin"), "node", "slices")
        longer = _spread(first).join(found, ["parent", "slice"])
        longer = cut(longer.select(F.col("top").alias("parent"), F.col("top_slice").alias("slice"), F.concat_ws(">", "begin", "tail").alias("tail"), "node", (F.col("hops") + k).alias("hops"), "slices"))
        found, longest = found.union(longer), longer.where(F.col("hops") == 2 * k)
    return found, 8


def hierarchy_paths(types: DataFrame, slice_rows: int = 200_000) -> DataFrame:
    """(fqn, root_fqn, depth, path): one row for each way from a root down to a type.

    A type without parents, or a parent without a row, is a root; `path` joins the names from root to type by `>`.
    A type that is its own ancestor has one row (fqn, '', -1, ''), any other type below such a one (fqn, '', -2, '').
    The latest row of a name holds; rows without a name are left out; an empty table gives no rows.
    """
    nodes, inner, outer = build_graph(types, slice_rows)
    looped = loops_and_below(inner)
    if looped is None:
        return _free_paths(nodes, inner, outer)
    stuck, loops = looped
    marks = stuck.join(loops.withColumn("own", F.lit(True)), "node", "left")
    marks = marks.select(F.col("node").alias("fqn"), F.lit("").alias("root_fqn"), F.when(F.col("own"), -1).otherwise(-2).alias("depth"), F.lit("").alias("path"))
    return _free_paths(nodes, inner, outer, stuck).union(marks)


def _free_paths(nodes: DataFrame, inner: DataFrame, outer: DataFrame, stuck: DataFrame | None = None) -> DataFrame:
    """The rows of `hierarchy_paths` of the types that aren't among stuck(node), those in or below loops."""
    if stuck is not None:  # what leads to a free type is free
        inner = cut(inner.join(stuck, "node", "left_anti"))
        outer = outer.join(stuck, "node", "left_anti")
    ways, hops = _tails(inner)
    tops = nodes.where(F.size("parents") == 0).select(F.col("fqn").alias("node"), F.col("fqn").alias("root_fqn"), F.lit(0).alias("depth"), F.col("fqn").alias("path"), "slices")
    first = outer.select("node", F.col("parent").alias("root_fqn"), F.lit(1).alias("depth"), F.concat_ws(">", "parent", "node").alias("path"), "slices")
    frontier = out = cut(tops.union(first))
    while True:
        down = _spread(frontier).join(ways, ["parent", "slice"])
        level = cut(down.select("node", "root_fqn", (F.col("depth") + F.col("hops")).alias("depth"), F.concat_ws(">", "path", "tail").alias("path"), "slices", "hops"))
        out = out.union(level.drop("hops"))
        frontier = level.where(F.col("hops") == hops).drop("hops")
        if _empty(frontier):
            break
    return out.select(F.col("node").alias("fqn"), "root_fqn", "depth", "path")


def descendant_pairs(paths: DataFrame) -> DataFrame:
    """(fqn, descendant_fqn): each proper ancestor with each type below it, once, from rows of `hierarchy_paths`;
    types in or below loops have none. `all_descendants` has theirs too."""
    names = F.split("path", ">")
    pairs = paths.where("depth > 0").select(F.explode(F.slice(names, 1, F.size(names) - 1)).alias("fqn"), F.col("fqn").alias("descendant_fqn"))
    return pairs.distinct()


def all_descendants(types: DataFrame, slice_rows: int = 200_000) -> DataFrame:
    """(fqn, descendant_fqn): each ancestor with each type below it, once, in and below loops too.

    A type that is its own ancestor is its own descendant; a parent without a row is an ancestor. Pairs of free types
    come from their paths. A type in or below a loop has no path: pairs between such types are joined on, up to four
    levels a round, until none is new; those with free ancestors come from the edges that enter them.
    """
    nodes, inner, outer = build_graph(types, slice_rows)
    looped = loops_and_below(inner)
    if looped is None:
        return descendant_pairs(_free_paths(nodes, inner, outer))
    stuck = looped[0]
    free = cut(descendant_pairs(_free_paths(nodes, inner, outer, stuck)))
    step = cut(inner.join(_spread(stuck), ["parent", "slice"], "left_semi"))
    near = cut(_then(step, step).union(step).distinct())
    near = cut(_then(near, near).union(near).distinct())  # up to four edges
    inside = frontier = near
    while True:
        frontier = cut(_then(frontier, near).join(inside.select("parent", "node"), ["parent", "node"], "left_anti"))
        if _empty(frontier):
            break
        inside = inside.unionByName(frontier)
    inside = cut(inside.select("parent", "slice", "node"))
    edges = inner.select("parent", "node", "slices").union(outer)
    entering = edges.join(stuck.select("node"), "node", "left_semi").join(stuck.select(F.col("node").alias("parent")), "parent", "left_anti")
    higher = free.join(entering, free.descendant_fqn == entering.parent).select("fqn", "node", "slices")
    entered = cut(entering.select(F.col("parent").alias("fqn"), "node", "slices").union(higher).distinct())
    below = _spread(entered).join(inside, ["parent", "slice"]).select("fqn", F.col("node").alias("descendant_fqn"))
    return free.union(inside.select("parent", "node").distinct()).union(entered.select("fqn", "node").union(below).distinct())
