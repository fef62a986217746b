"""Relations between types: implementations, hierarchy, dependencies, the project graph and what it rests on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.names import erased, plain_name
from ..session import cut
from ..sources.facts import DEPENDENCY_KINDS, ROOT_CLASS, Facts


def supertype_edges(facts: Facts, include_libraries: bool = False) -> DataFrame:
    """(super, sub), each once; without libraries only project types contribute, so a library type breaks the chain."""
    t = facts.types if include_libraries else facts.types.where("source = 'PROJECT'")
    ups = F.array_distinct(F.filter(F.concat(F.array("superclass"), "interfaces"), lambda x: x.isNotNull()))
    return t.select(F.explode(ups).alias("super"), F.col("fqn").alias("sub")).where("super <> sub")


def _strides(edges: DataFrame, stride: int) -> DataFrame:
    """(src, dst, hops): pairs joined by up to `stride` edges (a power of two), with the least number of them."""
    ways = edges.withColumn("hops", F.lit(1))
    while stride > 1:
        second = ways.select(F.col("src").alias("dst"), F.col("dst").alias("next"), F.col("hops").alias("more"))
        longer = ways.join(second, "dst").select("src", F.col("next").alias("dst"), (F.col("hops") + F.col("more")).alias("hops"))
        ways = cut(ways.union(longer).groupBy("src", "dst").agg(F.min("hops").alias("hops")))
        stride //= 2
    return ways


def closure(edges: DataFrame, start: DataFrame, max_depth: int | None = None, stride: int = 1) -> DataFrame:
    """(start, fqn, depth): every node that can be reached from each start(start) over edges(src, dst), with its
    least depth; loops end because a node that was seen isn't visited again, and a start isn't its own result.

    Each round goes `stride` levels on (a power of two): for graphs in which few nodes can be reached by few edges, such
    as the supertypes of types, where levels are many."""
    ways = _strides(cut(edges.select("src", "dst").distinct()), stride)
    frontier = cut(start.select("start", F.col("start").alias("fqn")).distinct())
    seen = frontier.withColumn("depth", F.lit(0))
    depth = 0
    while max_depth is None or depth < max_depth:
        step = frontier.select("start", "fqn").join(ways, frontier.fqn == ways.src).groupBy("start", F.col("dst").alias("fqn")).agg((F.min("hops") + depth).alias("depth"))
        new = cut(step.join(seen, ["start", "fqn"], "left_anti").select("start", "fqn", "depth"))
        depth += stride
        seen = seen.union(new)
        frontier = new.where(F.col("depth") == depth)
        if not frontier.head(1):
            break
    return seen.where("depth > 0" if max_depth is None else f"depth between 1 and {max_depth}")


def implementations(facts: Facts, targets: DataFrame, include_libraries: bool = False) -> DataFrame:
    """(target, fqn, relation, depth): DIRECT subtypes at depth 1 and INDIRECT ones below, for each of targets(target)
    that has a row; each type once per target, an unknown target gives nothing."""
    known = targets.join(facts.types.select(F.col("fqn").alias("target")), "target", "left_semi").select(F.col("target").alias("start"))
    edges = supertype_edges(facts, include_libraries).select(F.col("super").alias("src"), F.col("sub").alias("dst"))
    found = closure(edges, known, stride=8)
    return found.select(F.col("start").alias("target"), "fqn", F.when(F.col("depth") == 1, "DIRECT").otherwise("INDIRECT").alias("relation"), "depth")


def parent_chain(facts: Facts, targets: DataFrame) -> DataFrame:
    """(target, depth, fqn, source): the superclasses of each target upwards. A class without one has the root class as
    parent, an interface or annotation has none, and a parent without a row is a LIBRARY type that ends the chain. A
    chain that comes back to a type it has ends there."""
    t = facts.types
    is_class = ~F.col("is_interface") & ~F.col("is_annotation")
    up = F.when(F.col("superclass").isNotNull(), F.col("superclass")).when(is_class & (F.col("fqn") != ROOT_CLASS), F.lit(ROOT_CLASS))
    edges = t.select(F.col("fqn").alias("src"), up.alias("dst")).where("dst is not null")
    chain = closure(edges, targets.select(F.col("target").alias("start")), stride=8)
    named = chain.join(t.select("fqn", "source"), "fqn", "left")
    source = F.when(F.col("fqn") == ROOT_CLASS, "JDK").otherwise(F.coalesce("source", F.lit("LIBRARY")))
    return named.select(F.col("start").alias("target"), "depth", "fqn", source.alias("source"))


def children_tree(facts: Facts, targets: DataFrame) -> DataFrame:
    """(target, depth, path, fqn): subtypes downwards, of any source, one row per way; an interface has those that
    name it, a class those that extend it. A way doesn't visit a type twice, so loops end. A round goes up to four levels
    on."""
    kinds = facts.types.select(F.col("fqn").alias("super"), "is_interface")
    t = facts.types
    ext = t.where("superclass is not null").select(F.col("superclass").alias("super"), F.col("fqn").alias("sub"), F.lit(False).alias("by_interface"))
    imp = t.select(F.explode("interfaces").alias("super"), F.col("fqn").alias("sub"), F.lit(True).alias("by_interface"))
    edges = cut(ext.unionByName(imp).join(kinds, "super").where("is_interface = by_interface").select("super", "sub").distinct())
    # ways of up to four edges, none of which comes back to a type it has
    ways = longest = edges.select(F.col("super").alias("from"), F.array("sub").alias("tail"), F.col("sub").alias("to"), F.lit(1).alias("hops"))
    for k in (1, 2):
        second = ways.select(F.col("from").alias("to"), F.col("tail").alias("more"), F.col("to").alias("end"), F.col("hops").alias("n"))
        joined = longest.join(second, "to").where(~F.arrays_overlap(F.concat(F.array("from"), "tail"), "more"))
        longer = cut(joined.select("from", F.concat("tail", "more").alias("tail"), F.col("end").alias("to"), (F.col("n") + k).alias("hops")))
        ways, longest = ways.union(longer), longer.where(F.col("hops") == 2 * k)
    level = cut(targets.join(kinds, targets.target == kinds.super, "left_semi").select("target", F.col("target").alias("fqn"), F.array("target").alias("way")))
    found = None
    while True:
        down = level.join(ways, level.fqn == ways["from"]).where(~F.arrays_overlap("way", "tail"))
        now = cut(down.select("target", F.col("to").alias("fqn"), F.concat("way", "tail").alias("way"), "hops"))
        rows = now.select("target", (F.size("way") - 1).alias("depth"), F.array_join("way", ">").alias("path"), "fqn")
        found = rows if found is None else found.union(rows)
        level = now.where("hops = 4").drop("hops")
        if not level.head(1):
            return found


def declared_interfaces(facts: Facts, targets: DataFrame) -> DataFrame:
    """(target, position, fqn): the interfaces of each target that have a row, in declared order."""
    listed = facts.types.join(targets.select(F.col("target").alias("fqn")), "fqn", "left_semi").select(F.col("fqn").alias("target"), F.posexplode("interfaces").alias("position", "interface"))
    known = facts.types.select(F.col("fqn").alias("interface"))
    return listed.join(known, "interface", "left_semi").select("target", "position", F.col("interface").alias("fqn"))


def dependencies(facts: Facts, targets: DataFrame, include_libraries: bool = False) -> DataFrame:
    """(target, direction, class_fqn, type, location, source): what each target depends on (OUTGOING) and what depends
    on it (INCOMING). The other type's source is LIBRARY where it has no row; only project types unless libraries
    are included."""
    e, t = facts.dep_edges, targets.select("target").distinct()
    out = e.join(t, e.src == t.target).select("target", F.lit("OUTGOING").alias("direction"), F.col("dst").alias("class_fqn"), "type", "location", "ord")
    # as something depended on, the root class counts like any other
    from_root = facts.types.where(F.col("superclass") == ROOT_CLASS).select(F.col("fqn").alias("src"), F.col("superclass").alias("dst"), F.lit("EXTENDS").alias("type"), F.lit(None).cast("string").alias("location"), F.lit(0).alias("ord"))
    e = e.unionByName(from_root)
    into = e.join(t, e.dst == t.target).select("target", F.lit("INCOMING").alias("direction"), F.col("src").alias("class_fqn"), "type", "location", "ord")
    both = out.unionByName(into).join(facts.types.select(F.col("fqn").alias("class_fqn"), "source"), "class_fqn", "left").withColumn("source", F.coalesce("source", F.lit("LIBRARY")))
    if not include_libraries:
        both = both.where("source = 'PROJECT'")
    return both.orderBy("target", "direction", "class_fqn", "ord", "location").drop("ord")


def graph_edges(facts: Facts) -> DataFrame:
    """(source, target, type): project types that depend on project types, one edge per ordered pair, of the kind that
    comes first in the fixed order."""
    project = facts.types.where("source = 'PROJECT'").select("fqn")
    e = facts.dep_edges.groupBy("src", "dst").agg(F.min("ord").alias("ord"))
    e = e.join(project.select(F.col("fqn").alias("src")), "src", "left_semi").join(project.select(F.col("fqn").alias("dst")), "dst", "left_semi")
    kind = F.element_at(F.array(*[F.lit(k) for k in DEPENDENCY_KINDS]), F.col("ord") + 1)
    return e.select(F.col("src").alias("source"), F.col("dst").alias("target"), kind.alias("type"))


def graph_nodes(facts: Facts, edges: DataFrame | None = None) -> DataFrame:
    """(fqn, simple_name, in_degree, out_degree) of every project type."""
    edges = graph_edges(facts) if edges is None else edges
    # both degrees from one pass over the edges
    ends = edges.select(F.explode(F.array(F.struct(F.col("source").alias("fqn"), F.lit(0).alias("i"), F.lit(1).alias("o")), F.struct(F.col("target").alias("fqn"), F.lit(1).alias("i"), F.lit(0).alias("o")))).alias("e")).select("e.*")
    degree = ends.groupBy("fqn").agg(F.sum("i").alias("in_degree"), F.sum("o").alias("out_degree"))
    nodes = facts.types.where("source = 'PROJECT'").select("fqn", "simple_name")
    return nodes.join(degree, "fqn", "left").fillna(0, ["in_degree", "out_degree"])


def foundation(facts: Facts, min_dependents: int = 2, edges: DataFrame | None = None) -> DataFrame:
    """(fqn, dependent_count): project types that at least so many project types depend on, the most depended on first.
    With 0 or less every project type counts. Who they are is in `foundation_links`: a type may have very many."""
    edges = graph_edges(facts) if edges is None else edges
    grouped = edges.groupBy(F.col("target").alias("fqn")).agg(F.count("*").alias("dependent_count"))
    if min_dependents <= 0:
        nodes = facts.types.where("source = 'PROJECT'").select("fqn")
        grouped = nodes.join(grouped, "fqn", "left").fillna(0, ["dependent_count"])
    return grouped.where(F.col("dependent_count") >= min_dependents).orderBy(F.desc("dependent_count"), "fqn")


def foundation_links(facts: Facts, min_dependents: int = 2, edges: DataFrame | None = None) -> DataFrame:
    """(fqn, dependent): the types of `foundation` with each project type that depends on them."""
    edges = graph_edges(facts) if edges is None else edges
    return edges.join(foundation(facts, min_dependents, edges).select(F.col("fqn").alias("target")), "target", "left_semi").select(F.col("target").alias("fqn"), F.col("source").alias("dependent"))


def referenced_types(facts: Facts) -> DataFrame:
    """(fqn, type_fqn): every type that a type names in any way, each once: supertypes, type arguments, recorded references,
    annotations, owners of methods it calls; primitives and the type itself are left out."""
    t = facts.types
    ups = t.select("fqn", F.explode(F.concat(F.array("superclass"), "superclass_args", "interfaces", "interface_args")).alias("type_fqn"))
    refs = facts.refs.select(F.col("from_fqn").alias("fqn"), erased(F.col("type_fqn")).alias("type_fqn"))
    notes = facts.sites.select(F.col("owner_fqn").alias("fqn"), F.col("ann_type").alias("type_fqn"))
    calls = facts.raw("call_sites").where("not invoke_dynamic").select(plain_name("caller_fqn").alias("fqn"), erased(plain_name("owner_type")).alias("type_fqn"))
    return ups.union(refs).union(notes).union(calls).where("type_fqn <> '' and fqn <> type_fqn").distinct()


def dot_escaped(c: Column) -> Column:
    return F.replace(F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit("\n"), F.lit("\\n"))


def dot_lines(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(section, fqn, target, line): the lines of a Graphviz text, to be written in the order of the first three:
    header, nodes, edges (bold for EXTENDS, dashed for IMPLEMENTS, else solid), footer."""
    style = F.when(F.col("type") == "EXTENDS", "bold").when(F.col("type") == "IMPLEMENTS", "dashed").otherwise("solid")
    q = lambda c: F.concat(F.lit('"'), dot_escaped(F.col(c)), F.lit('"'))
    node = nodes.select(F.lit(1).alias("section"), "fqn", F.lit("").alias("target"), F.concat(F.lit("  "), q("fqn"), F.lit(" [label="), q("simple_name"), F.lit("];")).alias("line"))
    edge = edges.select(F.lit(2).alias("section"), F.col("source").alias("fqn"), "target", F.concat(F.lit("  "), q("source"), F.lit(" -> "), q("target"), F.lit(" [style="), style, F.lit("];")).alias("line"))
    ends = nodes.sparkSession.createDataFrame([(0, "", "", "digraph dependencies {"), (3, "", "", "}")], "section int, fqn string, target string, line string")
    return ends.unionByName(node).unionByName(edge).orderBy("section", "fqn", "target")


def isolated(facts: Facts, edges: DataFrame | None = None) -> DataFrame:
    """(fqn): project types that no project type depends on."""
    edges = graph_edges(facts) if edges is None else edges
    return facts.types.where("source = 'PROJECT'").select("fqn").join(edges.select(F.col("target").alias("fqn")), "fqn", "left_anti")
