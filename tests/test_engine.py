"""Compiled programs against the row interpreter and DuckDB."""

import glob
import json
import os

import duckdb
import pytest
from pyspark.sql import functions as F

from quern.api import run
from quern.functions import values
from quern.functions.reader import Reader
from quern.plans import catalog
from quern.sources import text
from quern.streaming import each as streaming

FOLDER = "/root/testdata/sf0.001"


def plain(rows):
    def one(x):
        return round(x, 6) if isinstance(x, float) else x.item() if hasattr(x, "item") else x

    return sorted((tuple(None if x is None or x != x else one(x) for x in r) for r in rows), key=repr)


@pytest.fixture(scope="module")
def database():
    con = duckdb.connect()
    for f in glob.glob(FOLDER + "/*.parquet"):
        con.sql(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return con


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query(spark, database, name):
    found = catalog.queries()[name](spark, FOLDER)
    expected = database.sql(catalog.oracle_sql()[name])
    columns = sorted(found.columns)
    assert columns == sorted(expected.columns)
    assert plain(found.select(columns).toPandas().itertuples(index=False)) == plain(expected.df()[columns].itertuples(index=False))


AGREE = [
    "select(.a > 1) | {a, b}", "{x: (.a + .f), y: (.b // \"none\"), z: (.f == null), w: (.a < .f)}", "{n: (.b | length), u: (.b // \"x\" | ascii_upcase), g: (.f > 0), l: (.a <= 2), e: (2 == .a), x: (.f <= 0.5)}", "{t: (if .a then .b else \"no\" end)}",
    "{l: (.l | map(select(. > 1)) | length), s: (.l | add)}", "{q: (.a == 1 or .f > 0 | not)}", "{c: \"<\\(.b)>\", h: (.b | @html), e: (.b | @uri)}", "{m: (.a % 2), d: .missing}", ".a += 1 | .b |= . + \"!\"",
    "{p: (.l | .[1:] | length), r: (.l | reverse | .[0]), k: (.b // \"\" | split(\"b\") | length), i: (.a | IN(1, 3))}",
]


@pytest.mark.parametrize("program", AGREE)
def test_tiers_agree(spark, program):
    df = spark.createDataFrame([(1, "abc", 0.5, [1, 2, 3]), (2, "<b&'>", float("nan"), []), (3, None, None, [5]), (-4, "é 😀", -1.5, [2, 2])], "a long, b string, f double, l array<long>")
    native = [json.loads(values.dumps(as_json(r.asDict(recursive=True)))) for r in run(spark, df, program, native=True).collect()]
    kernel = [json.loads(r["value"]) for r in run(spark, df, program, native=False).collect()]
    assert native == kernel


ARRAYS = ["{s: (.d | sort), u: (.d | unique | length), lo: (.d | min), hi: (.d | max)}", "{a: (.d | any(. > 1)), e: (.d | all(. == null)), r: (reduce .l[] as $x (1; . * $x)), i: (.s | rindex(\"ab\")), w: (.s | [splits(\"b+\")]), f: (.s | [scan(\"[a-c]\")])}"]


@pytest.mark.parametrize("program", ARRAYS)
def test_arrays_agree(spark, program):
    nan = float("nan")
    df = spark.createDataFrame([([2.0, None, nan, 1.0, nan, None, 2.0], [2, 3], "ababxab"), ([], [], ""), ([None], [7], "é😀abé")], "d array<double>, l array<long>, s string")
    native = [json.loads(values.dumps(as_json(r.asDict(recursive=True)))) for r in run(spark, df, program, native=True).collect()]
    assert native == [json.loads(r["value"]) for r in run(spark, df, program, native=False).collect()]


@pytest.mark.parametrize("program", ["map(.a) - ($t | map(.a)) | .[]", "map(.a) + ($t | map(.a)) | .[]", "(map(.a) + ($t | map(.a))) | unique | length", "sort_by(.b) | .[1:3] | map(.b) | .[]"])
def test_bags_agree(spark, program):
    nan = float("nan")
    df = spark.createDataFrame([(1.0, 5), (None, 3), (2.0, 4), (2.0, 1), (nan, 2)], "a double, b long").coalesce(1)
    other = spark.createDataFrame([(2.0,), (nan,), (None,)], "a double").coalesce(1)
    native = run(spark, df, program, "slurp", tables={"t": other}, native=True).collect()
    kernel = run(spark, df, program, "slurp", tables={"t": other}, native=False).collect()
    assert sorted(values.dumps(as_json(r["value"])) for r in native) == sorted(r["value"] for r in kernel)


def test_only_needed_columns_are_read(spark):
    plan = run(spark, spark.read.parquet(FOLDER + "/events.parquet"), "select(.value > 1) | .props | fromjson | keys", native=False)._jdf.queryExecution().executedPlan().toString()
    assert "user_id" not in plan and "props" in plan


def as_json(x):
    if isinstance(x, dict):
        return {k: as_json(v) for k, v in x.items()}
    if isinstance(x, list):
        return [as_json(v) for v in x]
    return float(x) if isinstance(x, (int, float)) and not isinstance(x, bool) else x


def test_text_sources(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"n": 1.50}\n{"n": 2}\n')
    (tmp_path / "b.json").write_text('[1,\n 2]\n"x" {"a":{}}\n')
    found = run(spark, str(tmp_path / "a.json"), ".n, error(\"no\")").collect()
    assert [(r["value"], r["error"]) for r in found] == [("1.50", None), (None, "no"), ("2", None), (None, "no")]
    assert [r["value"] for r in run(spark, str(tmp_path / "a.json"), "map(.n) | add", "slurp").collect()] == ["3.5"]
    assert [r["value"] for r in run(spark, str(tmp_path / "a.json"), "[inputs.n] | length", "null").collect()] == ["2"]
    assert [r["value"] for r in run(spark, str(tmp_path / "a.json"), "length", raw=True).collect()] == ["11", "8"]
    assert [r["value"] for r in run(spark, str(tmp_path / "b.json"), ".", whole_text=True).collect()] == ["[1,2]", '"x"', '{"a":{}}']
    assert [r["value"] for r in run(spark, str(tmp_path / "b.json"), ".", whole_text=True, stream=True).collect()][:3] == ["[[0],1]", "[[1],2]", "[[1]]"]
    assert text.documents(spark, str(tmp_path / "b.json")).count() == 3
    result = run(spark, str(tmp_path / "b.json"), "..", whole_text=True)
    assert [r["value"] for r in text.rendered(result, indent=2, sort_keys=True).collect()][0] == "[\n  1,\n  2\n]"
    assert text.report(result).code == 0
    assert text.report(run(spark, str(tmp_path / "a.json"), "error")).code == 5
    assert text.report(run(spark, str(tmp_path / "a.json"), "halt_error(3)")).code == 3
    assert text.report(run(spark, str(tmp_path / "a.json"), "empty"), exit_status=True).code == 4
    text.write(result, str(tmp_path / "out"))


def test_variables(spark):
    assert [r["value"] for r in run(spark, None, "$x + $ARGS.named.y?, [$t[].r_name] | length", "null", args={"x": 1.0}, tables={"t": spark.read.parquet(FOLDER + "/region.parquet")}).collect()] == ["1", "5"]


def test_plans(spark):
    """Filters and columns reach the scan, and groups are aggregated before they are shuffled."""
    plan = catalog.queries()["group_agg"](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(o_totalprice" in plan and "partial_sum" in plan and "o_custkey" not in plan
    assert "Python" not in plan and "Arrow" not in plan


def test_streaming(spark, tmp_path):
    events = spark.readStream.schema(spark.read.parquet(FOLDER + "/events.parquet").schema).option("pathGlobFilter", "events.parquet").parquet(FOLDER)
    for name, df in (
        ("plain", streaming.each(events, "select(.value > 50) | {event_id, value}")),
        ("windows", streaming.windowed(events.withColumn("ts", F.col("ts").cast("timestamp")), "group_by(.event_type) | map({t: .[0].event_type, n: length})", "ts", "1 day", "1 hour")),
    ):
        q = df.writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / name)).start()
        q.processAllAvailable()
        q.stop()
        assert spark.table(name).count() > 0
    assert spark.table("plain").count() == spark.read.parquet(FOLDER + "/events.parquet").where("value > 50").count()


def test_order_of_all_kinds():
    every = list(Reader('null false true -1 0 2.5 "" "a" "é" [] [1] [1,0] {} {"a":1} {"a":2} {"b":0}').values())
    assert sorted(reversed(every), key=values.order) == every


def test_halt_behind_many_errors(spark):
    rows = [(None, f"error {i}") for i in range(150)] + [(None, "halt 3: stop")]
    found = text.report(spark.createDataFrame(rows, "value string, error string").coalesce(1))
    assert found.code == 3 and len(found.errors) == 100
