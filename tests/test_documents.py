"""Documents in ordered lines: what the parts of a folder say one after the other."""

import glob
import gzip
import json

from pyspark.sql import functions as F

from stratagraph.rules.registry import _SCHEMA
from stratagraph.sinks import documents

OBJECTS = "full_name string, type string, name string, state string, line_number int"


def text(path):
    return "".join(open(f).read() for f in sorted(glob.glob(f"{path}/part-*")))


def test_project_in_lines(spark, tmp_path):
    o = spark.createDataFrame([("var.a", "variable", "a", "input", 1), ('var."b', "variable", '"b', "input", 2), ("local.c", "local", "c", "active", 3), ("aws_x.y", "resource", "y", None, None)], OBJECTS)
    e = spark.createDataFrame([("local.c", "var.a"), ("local.c", "var.a"), ("aws_x.y", "local.c"), ("aws_x.y", "var.a")], "src string, dst string")
    v = spark.createDataFrame([("a", '1"'), ("z", "{x}"), ("m", None)], "name string, value string")
    back = spark.createDataFrame([('{"s3": {}}',)], "backend string")
    issues = spark.createDataFrame([("warning",), ("warning",), ("error",)], "severity string")
    for k, (lines, n) in enumerate([(documents.project_lines(o, e, {"path": "é"}, v, back, issues), 4), (documents.project_lines(o.limit(0), e), 0)]):
        documents.write_lines(lines, f"{tmp_path}/{k}")
        doc = json.loads(text(f"{tmp_path}/{k}"))
        assert sum(map(len, doc["objects"].values())) == n
        if n:
            assert doc["metadata"] == {"path": "é"} and doc["variables"] == {"a": '1"', "z": "{x}", "m": None} and doc["backend"] == {"s3": {}}
            assert doc["statistics"] == {"counts": {"local": 1, "resource": 1, "variable": 2}, "states": {"active": 1, "input": 2}} and doc["validation"] == {"error": 1, "warning": 2}
            assert [x["full_name"] for x in doc["objects"]["variable"]] == ['var."b', "var.a"] and doc["objects"]["variable"][1]["dependents"] == ["aws_x.y", "local.c"]
            assert doc["objects"]["resource"][0]["dependencies"] == ["local.c", "var.a"]


def test_sarif_in_lines(spark, tmp_path):
    rows = [("p", "R2", "error", "c", 'm "1"', "f", 3, "x", "t", "do"), ("p", "R1", "info", "c", "m", None, None, None, "t", ""), ("p", "R1", "info", "c", "m", None, None, None, "t", "")]
    for k, some in enumerate((rows, [])):
        documents.write_lines(documents.sarif_lines(spark.createDataFrame(some, _SCHEMA)), f"{tmp_path}/{k}")
        results = json.loads(text(f"{tmp_path}/{k}"))["runs"][0]["results"]
        assert [r["ruleId"] for r in results] == (["R1", "R1", "R2"] if some else [])
        assert not some or results[2]["message"]["text"] == 'm "1". do' and results[2]["locations"][0]["physicalLocation"]["region"]["startLine"] == 3


def test_project_by_number_is_the_same(spark, tmp_path):
    names = ["var.a", "var.b", "local.c", "aws_x.y", "local.alone"]
    pairs = [(2, 0), (2, 0), (3, 2), (3, 0), (1, 3), (2, 1)]
    o = spark.createDataFrame([(n, n.split(".")[0], i) for i, n in enumerate(names)], "full_name string, type string, id long")
    said = F.array(*map(F.lit, names))
    by_number = documents.project_lines(o, spark.createDataFrame(pairs, "src long, dst long"), name=lambda c: F.get(said, c.cast("int")))
    by_name = documents.project_lines(o.drop("id"), spark.createDataFrame([(names[a], names[b]) for a, b in pairs], "src string, dst string"))
    documents.write_lines(by_number, f"{tmp_path}/n", compression="gzip")
    documents.write_lines(by_name, f"{tmp_path}/s")
    packed = b"".join(open(f, "rb").read() for f in sorted(glob.glob(f"{tmp_path}/n/part-*")))
    assert json.loads(gzip.decompress(packed)) == json.loads(text(f"{tmp_path}/s"))
