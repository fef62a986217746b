from __future__ import annotations

import pytest

from factweave.llm.docpairs import description, documented_functions, documented_places, file_pairs, is_informative, language_of, method_pair

JAVA = '''package a.b;
/** Class doc with many words here. */
@Entity(name = "x)")
public class Foo extends Bar<String> implements Baz {
    private final String s = "/** not a doc */";
    char open = '{';
    /** Makes the quick brown thing. */
    public Foo(String n) { this.n = n; }
    /**
     * Computes quick brown values.
     * @return x
     */
    @Override
    // note
    public <T extends Comparable<T>> Map<String, Long> compute(int a,
         byte[] b) throws IOException {
        Runnable r = new Runnable() {
            /** Inner quick brown doc. */
            @Override public void run() { }
        };
        String b = """
           /** Not quick brown doc. */ void q() { } }
        """;
        return null;
    }
    /** Abstract method not quick. */
    abstract void nope();
    // /** Old quick brown thing. */
    // void gone() { }
    void plain() { }
    /*
    /** hidden quick brown doc here
    void ghost() { }
    */
    void plain2() { }
    /** Field quick brown doc. */
    private int x = 3;
    void plain3() { }
    /** Find audit writer. */
    void findAuditWriter() {}
    /** Array quick brown doc. */
    int[] arr2() { return new int[]{1}; }
    int[] f = {1,2};
    /** After array quick doc. */
    static class In { /** Nested quick brown. */ void m() {} enum E { A, B { /** Const quick body.*/ void z(){} }; /** Enum quick brown. */ void e(){} } }
    Runnable g = new Runnable() { public void run() { } };
    /** After anon quick doc. */
    default long last() { return 1; }
    static { int q = 1; }
    /** After static quick doc. */ public static void aft() {}
}
/** Outer quick brown doc. */
'''
KOTLIN = '''package a
/** File quick brown doc. */
fun top(x: Int): Int = x + 1
// /** Old quick brown. */
// fun gone() {}
class Foo(private val d: Map<String, Long>) : Base<String>(1), Other {
    val a = "${m["x"].count { it > 3 }} } {"
    /** Quick brown receiver doc. */
    @Timed
    @Checks(
       name = ")",
    )
    internal suspend fun <T> List<T>.render(a: (Int) -> Unit = { x -> y }): Map<String, List<Long>> {
        /** Local quick brown doc. */
        fun local(x: Int): Int { return 1 }
        val s = """ ${ "}" } /** quick brown raw */ fun q() {} """
        return m
    }
    abstract fun nope(): Int
    /** Expr quick brown doc. */
    override fun expr() = a.b(3) { it.c() }
    /** Property quick brown doc. */
    val p: Int
        get() = 3
    fun plain() {}
    val open = '{'
    /* /** Nested quick brown. */ fun ghost() {} */
    fun plain2() {}
    class NoBody(val x: Int)
    /** After nobody quick doc. */
    fun after() {}
    enum class E { A, B(1) { fun z() {} }; /** Enum quick brown. */ fun e() {} }
    companion object { /** Companion quick brown. */ fun c() {} }
    init { println("x") }
    constructor(a: Int) : this(a, 2) { x() }
    /** Last quick brown doc. */ private inline fun String.last(): String { return "a" }
    /** Doc of val quick */ val zz = 3 /** Trail quick brown doc. */
    fun trail() {}
    interface I { /** No body quick. */ fun nb(): Int
       /** With body quick brown. */ fun wb(): Int { return 1 } }
    fun `back tick`(a: Int) { }
}
/** After class quick doc. */
private fun tail(a: Int) {
}
'''


def test_java():
    assert [(a, b) for a, b, *_ in file_pairs(JAVA, "JAVA")] == [(15, "compute"), (42, "arr2"), (45, "m"), (45, "e"), (48, "last"), (50, "aft")]
    code = file_pairs(JAVA, "JAVA")[0][2]
    assert code.startswith("@Override") and code.endswith("return null;\n    }")


def test_kotlin():
    want = [(3, "top"), (13, "render"), (21, "expr"), (31, "after"), (32, "e"), (33, "c"), (36, "last"), (38, "trail"), (40, "wb"), (44, "tail")]
    assert [(a, b) for a, b, *_ in file_pairs(KOTLIN, "KOTLIN")] == want
    assert [(a, b) for a, b, *_ in file_pairs("﻿" + KOTLIN.replace("\n", "\r\n").replace("    ", "\t"), "KOTLIN")] == want


@pytest.mark.parametrize("text", ["", " ", "{", "}" * 50, "/**", '"', "class", "fun", "/** quick brown fox */ fun", "{" * 3000, "class A {" * 300, '"""${"${"' * 50, "x" * 200_000])
@pytest.mark.parametrize("language", ["JAVA", "KOTLIN"])
def test_broken_texts(text, language):
    assert file_pairs(text, language) == []


def test_descriptions():
    assert description("/** a {@link x\n * y} <b>c</b>\n * @return no */").split() == ["a", "c"]
    assert description("/** */") == "" and description("/***/") == "" and description("/**\n * x\n **/") == "x"
    assert not is_informative("The find of audit Writer with WRITER fresh new", "findAuditWriter")
    assert is_informative("one two three", "x") and not is_informative("one one two todo", "x")


def test_language():
    assert language_of("a/B.kt", "JAVA", "") == "KOTLIN" and language_of("a/B.java.orig", None, "") == "JAVA"
    assert language_of(None, None, "class A {\n  private fun x() {\n}}") == "KOTLIN" and language_of(None, "UNKNOWN", "int a;\n") == "JAVA"


def test_methods():
    doc = "    /** Quick brown fox. */\n    @X(a = 1)"
    assert method_pair("go", "    int go() { return 1; }", doc)[2] == "Quick brown fox."
    assert method_pair("go", "    /** Quick brown fox. */ int go() { return 1; }", None) is not None
    assert method_pair("go", "    int go();", doc) is None  # no body
    assert method_pair("go", "    int go() { return 1; }", "     brown fox. */") is None  # not all of it
    assert method_pair("go", "    int go() { return 1; }", "    // /** Quick brown fox. */") is None
    assert method_pair("go", "    int go() { return 1; }", "    /*\n    /** Quick brown fox.\n    */") is None
    assert method_pair("go", "    int go() { return 1; }", doc + "\n    int a;") is None
    assert method_pair("go", "    int go() { return 1; }", "    /** Quick brown fox.\n    void x() {\n    }\n    */") is None  # its /* was cut off
    assert method_pair("go", "    int go() { return 1; }", "    /**\n     Quick brown fox:\n     }\n    */") is not None
    assert method_pair("go", "    int go() { return 1; }", "    /** Quick brown fox:\n     if (x) {\n     }\n    */") is not None  # no function
    assert method_pair("go", "    /** Quick brown fox. */ override fun go(): Int = 1", "  }") is not None
    assert method_pair("go", "    fun go(): Int = 1", "  }\n" + doc) is not None
    assert method_pair("go", "    fun go(): Int", doc) is None
    assert method_pair("go", "    int go() { return 1; }", 'it\'s cut off\n  }\n""";\n' + doc) is not None


def test_file_and_method_agree():
    doc, code = "    /** Sends the payload:\n    if (x) {\n    }\n    */", "    void send() { }"
    assert file_pairs(f"class A {{\n{doc}\n{code}\n}}", "JAVA")[0][1:] == method_pair("send", code, doc)


@pytest.mark.parametrize("language,function", [("JAVA", "void go() { }"), ("KOTLIN", "fun go() { }")])
def test_deep_nesting(language, function):
    text = "class A {\n" * 20_000 + f"/** Quick brown fox. */ {function}\n" + "}" * 20_000
    assert [x[:2] for x in file_pairs(text, language)] == [(20_001, "go")]


def test_enum_far_from_class():
    text = f"enum /* {'x' * 300} */ class E {{ A, B {{ fun z() {{}} }}; /** Quick brown fox. */ fun e() {{}} }}"
    assert [x[1] for x in file_pairs(text, "KOTLIN")] == ["e"]
    assert [x[1] for x in file_pairs("class A { enum class E { A; } /** Quick brown fox. */ fun e() {} }", "KOTLIN")] == ["e"]


def test_tables(spark):
    sources = spark.createDataFrame([("a.Foo", "Foo.java", "JAVA", JAVA, 1), ("a.Foo", "Foo.java", "JAVA", JAVA, 1), (None, "x.kt", None, KOTLIN, 1), ("b.K", None, None, KOTLIN, 1), ("c", "c.kt", None, None, 1)], "fqn string, path string, language string, content string, function int")
    methods = spark.createDataFrame([("m.A", "go", 5, "int go() { return 1; }", None), ("m.A", "go", 5, "int go() { return 1; }", "/** Quick brown fox. */"), ("m.A", None, 6, None, None)], "class_fqn string, method_name string, start_line int, content string, context_before string")
    got = sorted(tuple(r) for r in documented_places(sources, methods).collect())
    assert got == sorted([("a.Foo", a) for a in {x[0] for x in file_pairs(JAVA, "JAVA")}] + [("b.K", x[0]) for x in file_pairs(KOTLIN, "KOTLIN")] + [("m.A", 5)])
    assert documented_functions(sources.limit(0), methods.limit(0)).collect() == []


def test_pairs_at_one_line_all_stay(spark):
    sources = spark.createDataFrame([], "fqn string, path string, language string, content string")
    rows = [("m.A", n, 5, f"int {n}() {{ return 1; }}", "/** Quick brown fox. */") for n in ("go", "stop", "go")]
    methods = spark.createDataFrame(rows, "class_fqn string, method_name string, start_line int, content string, context_before string")
    assert sorted(r["function"] for r in documented_functions(sources, methods).collect()) == ["go", "stop"]
    assert [tuple(r) for r in documented_places(sources, methods).collect()] == [("m.A", 5)]
