from pyspark.sql import functions as F

from stratagraph.operators import blocks, inspection


def test_a_text_that_repeats_is_walked_once(spark, monkeypatch):
    seen, walked = [], inspection.walked
    monkeypatch.setattr(inspection, "walked", lambda rows, *a: seen.append(rows.count()) or walked(rows, *a))
    body = '{"name": "${var.a}", "size": 3, "tags": {"x": "${var.a}"}}'
    rows = spark.range(20).select(F.concat(F.lit("b"), F.col("id").cast("string")).alias("src"), F.parse_json(F.lit(body)).alias("attributes"))
    got = sorted(map(tuple, blocks.dependencies(rows, "src").collect()))
    assert got == sorted((f"b{i}", path, source, "var.a", "var.a") for i in range(20) for path, source in (("name", "attribute"), ("tags.x", "nested")))
    assert seen == [2]


def test_a_body_is_opened_and_written_once(spark, monkeypatch):
    calls, write = [], blocks.written
    monkeypatch.setattr(blocks, "written", lambda *a: calls.append(1) or write(*a))
    body = '{"count": "${var.n}", "none": null, "empty": {}, "no": [], "tags": {"a": 1.50, "__lines__": 3}, "list": [1, [true, {"x": "y"}]], "rule": [{"from": [{"deep": "d"}]}], "__lines__": {"z": 1}}'
    rows = spark.createDataFrame([("b", body), ("c", None), ("d", '"text"'), ("e", "[7, [8]]")], "src string, body string").select("src", F.parse_json("body").alias("attributes"))
    got = sorted(map(tuple, blocks.values(rows, "src").collect()))
    assert got == [
        ("b", "count", "count", "${var.n}"), ("b", "list[0]", "attribute", "1"), ("b", "list[1][0]", "attribute", "true"), ("b", "list[1][1].x", "nested", "y"), ("b", "rule[0].from[0].deep", "nested", "d"), ("b", "tags.a", "nested", "1.5"),
        ("e", "[0]", "attribute", "7"), ("e", "[1][0]", "attribute", "8"),
    ]
    assert len(calls) == 1


def test_a_body_deeper_than_a_round(spark):
    deep = blocks.LEVELS * 2 + 3
    body = '{"a": ' * deep + '{"count": [5]}' + "}" * deep
    rows = spark.createDataFrame([("b", body)], "src string, body string").select("src", F.parse_json("body").alias("attributes"))
    assert list(map(tuple, blocks.values(rows, "src").collect())) == [("b", "a." * deep + "count[0]", "nested", "5")]
