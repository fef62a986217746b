from __future__ import annotations

import json

from pyspark.sql import functions as F

from factweave.sources.classpath import source_files
from factweave.sources.sinks import as_json, write_lines


def test_source_files(spark, tmp_path):
    for n in ("src/main/A.kt", "src/test/ATest.kt", "build/G.kt", "x.java", "b.kts"):
        (tmp_path / n).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / n).write_text("a\nb")
    got = lambda **k: sorted(r["path"].rsplit("/", 1)[-1] for r in source_files(spark, str(tmp_path), **k).collect())
    assert got() == ["A.kt", "ATest.kt", "b.kts"] and got(include_tests=False) == ["A.kt", "b.kts"] and got(pattern="*Test.kt") == ["ATest.kt"]
    assert source_files(spark, str(tmp_path)).head()["content"] == "a\nb"


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, None), (2, "x")], "a int, b string")
    assert [json.loads(r["json"]) for r in as_json(df).orderBy("json").collect()] == [{"a": 1, "b": None}, {"a": 2, "b": "x"}]
    assert json.loads(as_json(df, False).orderBy(F.length("json")).head()["json"]) == {"a": 1}
    write_lines(spark.range(100).select(F.format_string("%03d", "id").alias("line")), ["line"], str(tmp_path / "o"))
    text = "".join(p.read_text() for p in sorted((tmp_path / "o").glob("part-*")))
    assert text.split() == [f"{i:03d}" for i in range(100)]
