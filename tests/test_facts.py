"""The code-fact operators on small tables written by hand."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from factweave.functions import names
from factweave.operators import calls, catalog, declarations, graph, paging, text, usages, xref
from factweave.sources import classpath
from factweave.sources.facts import Facts
from factweave.streaming import refresh

TYPES = "fqn string, simple_name string, package_name string, source string, visibility string, is_interface boolean, is_abstract boolean, is_final boolean, is_enum boolean, is_annotation boolean, is_synthetic boolean, superclass string, interfaces array<string>, superclass_args array<string>, interface_args array<string>, location string, scanned_at timestamp"


def make_type(fqn, source="PROJECT", sup=None, faces=(), face=False, sup_args=(), abstract=False):
    package, _, simple = fqn.rpartition(".")
    return (fqn, simple, package, source, "PUBLIC", face, abstract, False, False, False, False, sup, list(faces), list(sup_args), [], "/build/x" if source == "PROJECT" else "/lib/a-1.2.jar", None)


@pytest.fixture(scope="module")
def facts(spark, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("facts"))
    types = [
        make_type("p.A", face=True), make_type("p.B", faces=["p.A"]), make_type("p.C", sup="p.B", faces=["p.A", "p.A"], sup_args=["lib.L"]), make_type("p.D", sup="lib.L"),
        make_type("lib.L", "LIBRARY", sup="lib.Gone"), make_type("p.X", sup="p.Y"), make_type("p.Y", sup="p.X"), make_type("p.E", abstract=True),
    ]
    spark.createDataFrame(types, TYPES).write.parquet(f"{at}/types.parquet")
    refs = [
        (1, "p.A", "p.B", "p", "PROJECT", "FIELD", "f", "p.A", None), (2, "p.A", "p.C", "p", "PROJECT", "RETURN", "m", None, None), (3, "p/A[]", " p.C ", "p", "PROJECT", "PARAM", "m", None, None),
        (3, "p.A[]", "p.C", "p", "PROJECT", "PARAM", "m", None, None), (4, "int", "p.C", "p", "PROJECT", "RETURN", "n", None, None), (5, None, "p.C", "p", None, None, None, None, None), (6, "java.util.List", "p.B", "p", "PROJECT", "RETURN", "<init>", None, None),
    ]
    spark.createDataFrame(refs, "ref_id long, type_fqn string, from_fqn string, from_simple_name string, from_source string, kind string, member string, detail string, line_number int").withColumn("seen_at", F.lit("2025-01-01").cast("timestamp") + F.make_interval(days=F.col("ref_id").cast("int"))).write.parquet(f"{at}/type_refs.parquet")
    k = lambda *x: [("STRING", v) for v in x]
    call = lambda i, m, idx, owner, name, args, indy=False: (i, "p.C", m, idx, owner, name, "()V", False, args, 10 + i, indy, None, "impl" if indy else None, None)
    sites = [
        call(1, "m", 0, "p.A", "go", k("a", "b")), call(2, "m", 1, "p.B", "lam", k("c"), True), call(3, "m", 2, "p.B", "<init>", k(*"defghijklmnopqrstuv")), call(4, "m", 3, None, "lost", k("z")),
        call(5, "m", 4, "lib.L", "end", None), call(6, "n", 0, "p.C", "m", []),
    ]
    spark.createDataFrame(sites, "call_id long, caller_fqn string, caller_method string, call_idx int, owner_type string, method_name string, descriptor string, is_interface boolean, constant_args array<struct<kind:string,value:string>>, line_number int, invoke_dynamic boolean, impl_method_owner string, impl_method_name string, scanned_at timestamp").write.parquet(f"{at}/call_sites.parquet")
    notes = [
        (1, "p.B", "CLASS", None, None, None, None, None, None, "n.N"), (2, "p.C", "METHOD", "m", "()V", None, None, None, None, "n.N"), (3, "p.C", "CONSTRUCTOR", None, "()", None, None, None, None, "n.N"),
        (4, "p.C", "PARAMETER", "m", "()V", None, "q", 0, "int", "n.N"), (5, "lib.L", "CLASS", None, None, None, None, None, None, "n.N"), (6, "p.C", "FIELD", None, " ", "f", None, None, None, "n.M"),
    ]
    spark.createDataFrame(notes, "site_id long, owner_fqn string, target string, member string, descriptor string, field string, param_name string, param_index int, param_type string, ann_type string").withColumn("attrs", F.lit("{}")).write.parquet(f"{at}/annotation_sites.parquet")
    spark.createDataFrame([("p.A", "src/A.java", "JAVA", None, "main", "PROJECT_SOURCE", "class A {}"), ("p.A", "lib/A.java", "JAVA", None, None, "SOURCE_JAR", "x")], "fqn string, path string, language string, module string, source_set string, origin string, content string").write.parquet(f"{at}/sources.parquet")
    return Facts(spark, at)


def col(df, *names_):
    return sorted(tuple(r[n] for n in names_) if len(names_) > 1 else r[names_[0]] for r in df.collect())


def test_lists(facts):
    assert col(catalog.list_classes(facts, name="*"), "fqn") == ["p.A", "p.B", "p.C", "p.D", "p.E", "p.X", "p.Y"]
    assert col(catalog.list_classes(facts, include_libraries=True, source="LIBRARY"), "fqn") == ["lib.L"]
    assert col(catalog.list_classes(facts, annotation="n.N"), "fqn") == ["p.B"]
    assert col(catalog.list_classes(facts, extends="p.B"), "fqn") == ["p.C"]
    assert col(catalog.list_classes(facts, implements="p.A"), "fqn") == ["p.B", "p.C"]
    assert col(catalog.list_classes(facts, package="q"), "fqn") == []
    row = catalog.list_classes(facts, name="C").head()
    assert (row["method_count"], row["field_count"]) == (2, 1)
    assert catalog.class_detail(facts, fqn="p.nowhere").count() == 0
    s = catalog.statistics(facts).head()
    assert (s["project_classes"], s["library_classes"], s["interfaces"], s["abstract_classes"], s["methods"], s["fields"]) == (7, 1, 1, 1, 2, 2)


def test_methods(facts):
    assert col(catalog.search_methods(facts), "class_fqn", "name") == [("p.C", "m"), ("p.C", "n")]  # no constructor
    assert col(catalog.search_methods(facts, return_type="A"), "name") == ["m"]
    assert col(catalog.search_methods(facts, return_type="int"), "name") == []  # primitives never match
    assert col(catalog.search_methods(facts, annotation="n.N"), "name") == ["m"]


def test_graph(facts, spark):
    t = lambda *x: spark.createDataFrame([(v,) for v in x], "target string")
    assert col(graph.implementations(facts, t("p.A", "nope")), "target", "fqn", "relation", "depth") == [("p.A", "p.B", "DIRECT", 1), ("p.A", "p.C", "DIRECT", 1)]
    assert col(graph.implementations(facts, t("p.X")), "fqn") == ["p.Y"]  # a loop ends
    assert col(graph.parent_chain(facts, t("p.D")), "depth", "fqn", "source") == [(1, "lib.L", "LIBRARY"), (2, "lib.Gone", "LIBRARY")]
    assert col(graph.parent_chain(facts, t("p.B", "p.A")), "target", "fqn", "source") == [("p.B", "java.lang.Object", "JDK")]
    assert col(graph.children_tree(facts, t("p.A")), "path") == ["p.A>p.B", "p.A>p.B>p.C", "p.A>p.C"]
    assert col(graph.children_tree(facts, t("p.X")), "path") == ["p.X>p.Y"]
    assert col(graph.declared_interfaces(facts, t("p.C")), "position", "fqn") == [(0, "p.A")]
    assert col(graph.dependencies(facts, t("p.A")), "direction", "class_fqn", "type") == [("INCOMING", "p.B", "FIELD_TYPE"), ("INCOMING", "p.B", "IMPLEMENTS"), ("INCOMING", "p.C", "IMPLEMENTS"), ("INCOMING", "p.C", "METHOD_PARAMETER"), ("INCOMING", "p.C", "METHOD_RETURN_TYPE")]
    assert col(graph.graph_edges(facts), "source", "target", "type") == [("p.B", "p.A", "IMPLEMENTS"), ("p.C", "p.A", "IMPLEMENTS"), ("p.C", "p.B", "EXTENDS"), ("p.X", "p.Y", "EXTENDS"), ("p.Y", "p.X", "EXTENDS")]
    assert [tuple(r) for r in graph.foundation(facts).collect()] == [("p.A", 2)]
    assert col(graph.foundation_links(facts), "fqn", "dependent") == [("p.A", "p.B"), ("p.A", "p.C")]
    assert ("p.C", "lib.L") in col(graph.referenced_types(facts), "fqn", "type_fqn")
    assert graph.foundation(facts, 0).count() == 7
    n = {r["fqn"]: (r["in_degree"], r["out_degree"]) for r in graph.graph_nodes(facts).collect()}
    assert n["p.A"] == (2, 0) and n["p.C"] == (0, 2) and n["p.D"] == (0, 0)
    assert col(graph.isolated(facts), "fqn") == ["p.C", "p.D", "p.E"]
    lines = [r["line"] for r in graph.dot_lines(graph.graph_nodes(facts), graph.graph_edges(facts)).collect()]
    assert lines[0] == "digraph dependencies {" and lines[-1] == "}" and '  "p.C" -> "p.B" [style=bold];' in lines


def test_usages(facts):
    u = usages.annotation_usages(facts, "n.N")
    assert [(r["site_id"], r["member"]) for r in u.orderBy(*usages.usage_order()).collect()] == [(1, None), (2, "m"), (3, "<init>"), (4, "m")]
    assert [tuple(r) for r in usages.counts_by_target(u).collect()] == [("CLASS", 1), ("METHOD", 1), ("CONSTRUCTOR", 1), ("PARAMETER", 1)]
    assert usages.annotation_usages(facts, "n.N", "METHOD").count() == 2
    assert usages.annotation_usages(facts, "n.N", include_libraries=True).count() == 5
    assert usages.annotation_usages(facts, "n.M").head()["descriptor"] is None
    with pytest.raises(ValueError):
        usages.annotation_usages(facts, scope="X")


def test_call_windows(facts):
    w = {r["call_id"]: r["constants"] for r in calls.call_windows(facts.calls).collect()}
    assert w[1] == ["STRING:a", "STRING:b"] and w[2] == []  # a dynamic call has none
    assert w[3] == [f"STRING:{x}" for x in "ghijklmnopqrstuv"]  # the last sixteen
    assert 4 not in w and w[5] == [] and w[6] == []  # a call without a name has no row


def test_call_filters(facts):
    assert col(calls.calls_in(facts, in_methods_annotated="n.N"), "call_id") == [1, 2, 3, 4, 5]
    assert col(calls.calls_in(facts, in_class="p.C", method="n"), "call_id") == [6]
    assert col(calls.calls_in(facts, in_methods_returning="int"), "call_id") == []
    assert col(calls.methods_with_calls(facts), "owner_fqn", "name", "calls") == [("p.C", "m", 5), ("p.C", "n", 1)]
    assert col(calls.methods_with_calls(facts, "p.C", "m"), "name", "calls") == [("m", 5)] and col(calls.methods_with_calls(facts, method="none"), "name") == []


def test_meta_annotations(facts, spark, tmp_path):
    rows = [(1, "a.B", "CLASS", None, "n.Meta"), (2, "a.C", "CLASS", None, "a.B"), (3, "p.X", "METHOD", "m", "a.C"), (4, "p.Y", "CLASS", None, "n.Meta"), (5, "n.Meta", "CLASS", None, "n.Meta"), (6, "p.Z", "CLASS", None, "n.Other")]
    df = spark.createDataFrame(rows, "site_id long, owner_fqn string, target string, member string, ann_type string")
    for c, t in (("descriptor", "string"), ("field", "string"), ("param_name", "string"), ("param_index", "int"), ("param_type", "string"), ("attrs", "string")):
        df = df.withColumn(c, F.lit(None).cast(t))
    df.write.parquet(f"{tmp_path}/annotation_sites.parquet")
    f = Facts(spark, str(tmp_path))
    assert col(usages.sites_with(f, "n.Meta"), "site_id") == [1, 2, 3, 4, 5]
    assert col(usages.sites_with(f, "n.Me*", ("METHOD",)), "site_id") == [3] and col(usages.sites_with(f, "n.Meta", meta=False), "site_id") == [1, 4, 5]


def test_attributes(facts, spark):
    v = usages.with_attributes(facts, usages.annotation_usages(facts, "n.N"))
    assert {r["attributes"] for r in v.collect()} == {""} and usages.usage_values(facts, v.drop("attributes")).count() == 0


@pytest.mark.parametrize("adaptive", ["true", "false"])
def test_values_are_not_broadcast(spark, smallest, adaptive):
    before = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", adaptive)
    try:
        f = Facts(spark, smallest)
        v = usages.usage_values(f, usages.annotation_usages(f))
        assert v.collect()
        plan = v._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", before)
    assert "SortMergeJoin [site_id" in plan and "BroadcastHashJoin [site_id" not in plan


def test_xref(facts):
    x = xref.xref(facts)
    assert {r["kind"]: r["n"] for r in xref.counts_by_kind(x.where("type_fqn = 'p.A'")).collect()} == {"IMPLEMENTS": 2, "FIELD": 1, "RETURN": 1, "PARAM": 1, "CALL_RECEIVER": 1}
    assert x.where("kind = 'INSTANTIATION'").select("type_fqn", "detail").head() == ("p.B", None)
    assert x.where("kind = 'CALL_RECEIVER'").count() == 2  # not the dynamic one, not its own type
    assert x.where("kind = 'ANNOTATION' and type_fqn = 'n.N'").count() == 3  # not on parameters
    assert xref.xref(facts, "lib.L", scope_implementing="p.A").select("kind").distinct().count() == 2
    with pytest.raises(ValueError):
        xref.xref(facts, kind="X")


def test_paging(spark):
    df = spark.range(7).select(F.col("id"))
    assert [r["id"] for r in paging.paginate(df, [F.desc("id")], 1, 3).collect()] == [3, 2, 1]
    assert paging.paginate(df, [F.col("id")], 43_000_000, 50).collect() == []
    assert paging.paginate(df, [F.col("id")], 5, 3).collect() == []
    assert [paging.page_arguments(*x) for x in ((None, None), (" 2 ", "x"), ("", "7"))] == [(0, 50), (2, 50), (0, 7)]
    assert [paging.flag(x) for x in ("TRUE", "1", None)] == [True, False, False]
    with pytest.raises(ValueError):
        paging.page_arguments("-1", "5")
    assert (paging.total_pages(0, 50), paging.total_pages(101, 50)) == (1, 3)
    assert [(r["id"], r["row_no"]) for r in paging.paginate(spark.range(200_010), [F.col("id")], 4000, 50).collect()] == [(200_000 + i, 200_001 + i) for i in range(10)]
    assert paging.page_of(df, [F.col("id")], 1, 3)[1:] == (7, 3)
    for bad in ((-1, 5), (0, 0)):
        with pytest.raises(ValueError):
            paging.paginate(df, [F.col("id")], *bad)


def test_names(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).head()["x"]
    assert not one(names.glob(F.lit("Foo$1"), "Foo$*")) and one(names.glob(F.lit("Foo$1"), "Foo$*", strict=False))
    assert one(names.glob(F.lit("a.b"), "a.*")) and not one(names.glob(F.lit("axb"), "a.*")) and one(names.glob(F.lit("ab"), "ab"))
    assert one(names.erased(F.lit("java.util.List<String>[]"))) == "java.util.List" and one(names.erased(F.lit("int[]"))) is None
    assert one(names.percent_encoded(F.lit("a b*~/é"))) == "a%20b%2A~%2F%C3%A9"
    assert one(names.duration_text(F.lit(7384))) == "2h 3m 4s" and one(names.duration_text(F.lit(64))) == "1m 4s"
    assert [one(names.timeout_minutes(F.lit(x))) for x in ("30m", " 2h ", "0", "7", "junk", "-1", "", None)] == [30, 120, 0, 7, 30, 30, 30, 30]
    assert one(names.short_type(F.lit("java.util.Map<a.B, c.D>"))) == "Map<B, D>"
    assert one(names.package_of(F.lit("a.b.C"))) == "a.b" and one(names.package_of(F.lit("C"))) == ""


def test_classpath(spark):
    lines = spark.createDataFrame([(0, "# c"), (1, "/p/a/build/x"), (2, ""), (3, "/lib/a.jar"), (4, " /lib/a.jar ")], "ordinal int, value string")
    assert col(classpath.parse_classpath_file(lines, "/p"), "ordinal", "path", "kind", "is_project_output") == [(1, "/p/a/build/x", "DIRECTORY", True), (3, "/lib/a.jar", "JAR", False)]
    text_ = spark.createDataFrame([("f", i, v) for i, v in enumerate(["lost", "# one", "a|b", "", "# two", "c"])], "file string, ordinal int, value string")
    assert col(classpath.parse_sections(text_), "section", "fields") == [("one", ["a", "b"]), ("two", ["c"])]
    row = spark.range(1).select(classpath.coordinates(F.lit("g.h:a:1:x")).alias("c"), classpath.coordinates(F.lit("g:a")).alias("d"), classpath.is_zip(F.lit(b"PK\x03\x04x")).alias("z"), classpath.safe_entry(F.lit("a/../b")).alias("s"), classpath.jar_name(F.lit("a"), F.lit("1"), "sources").alias("j"), classpath.artifact_path(F.lit("g.h"), F.lit("a"), F.lit("1")).alias("p")).head()
    assert tuple(row["c"]) == ("g.h", "a", "1") and row["d"] is None and row["z"] and not row["s"] and row["j"] == "a-1-sources.jar" and row["p"] == "g/h/a/1"


def test_coordinates_and_entries(spark, facts):
    lines = spark.createDataFrame([(0, "g.h:a:1:x|/lib/a-1.2.jar"), (1, "g:b:2|/lib/a-1.2.jar|y"), (2, "bad|/x"), (3, "g:a:1"), (4, "g:c:3|/lib/c.jar")], "ordinal int, value string")
    m = classpath.mapped_coordinates(lines)
    assert col(m, "path", "artifact") == [("/lib/a-1.2.jar", "a"), ("/lib/a-1.2.jar|y", "b"), ("/lib/c.jar", "c")]
    assert [tuple(r) for r in classpath.located_coordinates(facts.types, m).collect()] == [("lib.L", "g.h", "a", "1")]
    assert [tuple(r) for r in classpath.located_coordinates(facts.types, m.limit(0)).collect()] == [("lib.L", None, "a", "1.2")]
    e = spark.createDataFrame([("a.jar", n) for n in ("p/A.java", "java.base/p/B.kt", "p/B.java", "p/x.txt", "../evil.java", "p/")], "archive string, entry string")
    e = classpath.source_listing(e)
    assert col(e, "entry") == ["java.base/p/B.kt", "p/A.java", "p/B.java"]
    t = spark.createDataFrame([("p.A",), ("p.B$In",), ("q.C",)], "fqn string")
    assert {r["fqn"]: r["entry"] for r in classpath.entry_for_type(e, t).collect()} == {"p.A": "p/A.java", "p.B$In": "p/B.java"}
    assert [r[0] for r in spark.createDataFrame([("a.B$1",), ("a..b",), ("a/b",), (None,)], "n string").select(classpath.cacheable_name(F.col("n"))).collect()] == [True, False, False, False]


def test_source_or_stub(facts, spark):
    stubs_ = spark.createDataFrame([("p.A", "stub A"), ("p.B", "stub B")], "fqn string, text string")
    got = {r["fqn"]: (r["found"], r["text"]) for r in classpath.source_or_stub(facts.types, facts.sources, stubs_).collect()}
    assert got["p.A"] == ("PROJECT_SOURCE", "class A {}") and got["p.B"] == ("STUB", "stub B") and got["p.C"] == ("SOURCE_NOT_FOUND", None)


def test_sources(facts):
    found = {r["fqn"]: (r["path"], r["found"]) for r in classpath.resolve_sources(facts.types, facts.sources).collect()}
    assert found["p.A"] == ("src/A.java", "PROJECT_SOURCE") and found["p.B"] == (None, "SOURCE_NOT_FOUND")


def test_lint_and_format(spark):
    rows = [("a", "import x.*;\n\n\n\tint a; \nlast"), ("b", ""), ("c", None), ("d", "ok\n"), ("e", "x" * 141 + "\r\n")]
    df = spark.createDataFrame(rows, "path string, content string")
    f = text.lint(df)
    assert text.lint_summary(df).head() == (4, 2, 6)
    assert col(f, "path", "line_no", "rule") == [("a", 1, "no-wildcard-imports"), ("a", 3, "no-consecutive-blank-lines"), ("a", 4, "no-tabs"), ("a", 4, "no-trailing-spaces"), ("a", 5, "final-newline"), ("e", 1, "max-line-length")]
    assert col(text.lint_rollup(f), "path", "errors", "fixable") == [("a", 5, 4), ("e", 1, 0)]
    new = {r["path"]: (r["content"], r["changed"], r["remaining"]) for r in text.format_files(df).collect()}
    assert new["a"] == ("import x.*;\n\n    int a;\nlast\n", True, 1) and new["b"] == ("", False, 0) and new["d"] == ("ok\n", False, 0) and new["e"][2] == 1
    assert text.lint(df.limit(0)).count() == 0
    assert "Exchange" not in f._jdf.queryExecution().executedPlan().toString()


def test_signatures(spark):
    src = "package a;\n\n/**\n * T.\n */\npublic class A {\n    /**\n     * M.\n     */\n    @X\n    public int m() {\n        if (x) {\n        }\n        int local = go(1);\n    }\n    /**\n     * gone\n     */\n    ;\n    private int f;\n    abstract public void n();\n    static class In {\n        /** one line\n        goes on */\n        int g = 1;\n    }\n    A(int x) {\n    }\n}\n"
    df = spark.createDataFrame([("p.java", src), ("q.java", None), ("r.kt", "package b\n\ninternal class K(val a: Int) {\n    fun <T> List<T>.go(): Int {\n        val x = 1\n        return x\n    }\n    private val y: Int = 2\n    companion object {\n        fun z() = 1\n    }\n}\nfun top() = 1\n")], "path string, content string")
    out = {}
    for r in text.doc_signatures(df).orderBy("line_no").collect():
        out.setdefault(r["path"], []).append(r["text"])
    assert out["p.java"] == ["package a;", "/**", " * T.", " */", "public class A {", "    /**", "     * M.", "     */", "    public int m() { /* ... */ }", "    private int f;", "    abstract public void n();", "    static class In {", "        /** one line", "        goes on */", "        int g = 1;", "    A(int x) { /* ... */ }"]
    assert out["r.kt"] == ["package b", "internal class K(val a: Int) {", "    fun <T> List<T>.go(): Int { /* ... */ }", "    private val y: Int = 2;", "    companion object {", "        fun z() = 1;"]
    hidden = text.doc_signatures(df, visibility="PUBLIC")
    assert "    private int f;" not in [r["text"] for r in hidden.collect()]
    assert text.doc_signatures(df.limit(0)).collect() == []


@pytest.mark.parametrize("language,line,want", [
    ("JAVA", "  public static <T extends A<T>> Map<String, List<T>> go(int a) {", ("FUNCTION", "go")), ("JAVA", "  return go(1);", None), ("JAVA", "  x.go(1);", None), ("JAVA", "  go(1);", None), ("JAVA", "  Foo(int a) {", ("FUNCTION", "Foo")),
    ("JAVA", "  int[] a = new int[3];", ("VALUE", "a")), ("JAVA", '  @X(name = ")") private final String s = "void go(";', ("VALUE", "s")), ("JAVA", "  else if (go(1)) {", None), ("JAVA", "  new Foo(1) {", None), ("JAVA", "@interface N {", ("TYPE", "N")), ("JAVA", "// void go() {", None), ("JAVA", "}", None), ("JAVA", "", None),
    ("KOTLIN", "  override suspend fun <T> Map<String, T>.go(a: Int) = 1", ("FUNCTION", "go")), ("KOTLIN", "  go(1)", None), ("KOTLIN", "  private val a: Int = 1", ("VALUE", "a")), ("KOTLIN", "fun interface F {", ("TYPE", "F")), ("KOTLIN", "  companion object {", ("TYPE", "Companion")), ("KOTLIN", "  fun `a b`() {", ("FUNCTION", "a b")), ("KOTLIN", "  fun (Int.() -> Unit).go() {", ("FUNCTION", "go")),
])
def test_declarations(language, line, want):
    d = declarations.declared(declarations.tokens(line), language)
    assert (d and (d.kind, d.name)) == want


def test_methods_in_files(spark):
    src = 'class A {\n  @X\n  int go(int a) {\n    String s = "}";\n    if (a) { go(1); }\n  }\n  int go() { return 1; }\n  private\n  Map<String, A> put(final java.util.List<A> x,\n    B... y) { }\n}\n'
    df = spark.createDataFrame([("p.java", src, ["go", "none", "go()", "go(int)", "put", "go(Other)"]), ("q.java", None, ["go"]), ("r.java", src, None)], "path string, content string, method_names array<string>")
    r = text.methods_in_files(df, 1).collect()
    assert [(x["method_name"], x["start_line"], x["end_line"], x["before"], x["after"]) for x in r] == [
        ("go", 3, 6, "  @X", "  int go() { return 1; }"), ("go()", 7, 7, "  }", "  private"), ("go(int)", 3, 6, "  @X", "  int go() { return 1; }"), ("put", 9, 10, "  private", "}"), ("go(Other)", 3, 6, "  @X", "  int go() { return 1; }"),
    ]
    assert declarations.parameter_kinds(declarations.tokens("Map<String, A> put(final java.util.List<A> x, B... y) { }"), "put", "JAVA") == ("List", "B[]")
    assert declarations.parameter_kinds(declarations.tokens("fun put(a: Map<Int, A>, vararg b: B? = null)"), "put", "KOTLIN") == ("Map", "B")


def test_declaration_starts(spark):
    src = "class A {\n  @X\n  public int go(int a) {\n    x();\n  }\n}"
    df = spark.createDataFrame([("p.java", src), ("q.kt", "fun go() {\n  x()\n}")], "path string, content string")
    places = spark.createDataFrame([("p.java", 4), ("p.java", 1), ("p.java", 2), ("q.kt", 2)], "path string, at int")
    assert col(text.declaration_starts(text.source_lines(df), places), "path", "at", "start") == [("p.java", 1, 1), ("p.java", 2, 2), ("p.java", 4, 3), ("q.kt", 2, 1)]


def test_streaming_counts_as_batch(facts, spark, tmp_path):
    batch = {tuple(r) for r in refresh.reference_counts(facts.raw("type_refs")).collect()}
    q = refresh.reference_counts(refresh.read_stream(spark, facts.folder, "type_refs")).writeStream.format("memory").queryName("counts").outputMode("complete").option("checkpointLocation", str(tmp_path)).trigger(availableNow=True).start()
    q.awaitTermination()
    assert {tuple(r) for r in spark.sql("select * from counts").collect()} == batch


def test_snapshots(spark, tmp_path):
    root = str(tmp_path)
    assert refresh.current_snapshot(spark, root) is None
    for i in (1, 2):
        refresh.write_snapshot({"t": spark.range(i)}, root, i)
    assert spark.read.parquet(f"{refresh.current_snapshot(spark, root)}/t.parquet").count() == 2
