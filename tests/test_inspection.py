"""References, arguments, dependencies and lines against a scan by character, on awkward input too."""

import json
import random
import re

import pytest
from pyspark.sql import functions as F

from stratagraph.operators import blocks, inspection
from stratagraph.sources import positions

NAME = "[a-zA-Z_][a-zA-Z0-9_-]*"
FORMS = {
    "variable": rf"\bvar\.{NAME}(\.{NAME})*", "local": rf"\blocal\.{NAME}(\.{NAME})*", "module": rf"\bmodule\.{NAME}(\.{NAME})*", "data": rf"\bdata\.{NAME}\.{NAME}(\.{NAME})*",
    "resource": rf"\b[a-z][a-z0-9]*_[a-z0-9_]+\.{NAME}(\.{NAME})*", "path": r"\bpath\.(module|root|cwd)", "terraform": r"\bterraform\.workspace", "count": r"\bcount\.index", "each": r"\beach\.(key|value)", "self": rf"\bself\.{NAME}(\.{NAME})*",
}
ODD = [
    None, "", ".", "var.", "var.x", "évar.a.var.b", "var.a-é", "var.cé", "path.modules", "each.key_x", "_self.id self.id", "data.a_b.c.d", '"var.in" var.out', "it's var.in", "\\'var.out' var.in", '"a\\" var.in" var.out', "var.xy.z",
    "x " * 20_000 + "var.end", "var." + ".".join(["a"] * 5000), "'" * 2001 + "var.in", "a_b.c " * 3000, "日本 local.a.b_c.d 日本",
]


def states(text):
    """For each position, whether it stands in a literal."""
    quote, skip, out = None, False, []
    for c in text:
        out.append(quote is not None)
        if skip:
            skip = False
        elif c == "\\":
            skip = True
        elif quote is None and c in "\"'":
            quote = c
        elif c == quote:
            quote = None
    return out


def found(text):
    inside = states(text or "")
    out = []
    for kind, form in FORMS.items():
        for m in re.finditer(form, text or ""):
            around = text[m.start() - 1 : m.start()] + text[m.end() : m.end() + 1]
            if not inside[m.start()] and not any(c.isalnum() for c in around):
                out.append((kind, m[0], m.start()))
    return out


def test_references_against_a_scan(spark):
    rng = random.Random(5)
    words = ["var.a", "local.b.c", "module.m", "data.x_y.z", "aws_a.b.c", "path.root", "count.index", "each.value", "self.q", '"', "'", "\\", " ", "é", ".", "-", "x", "${", "}", "(", ",", "terraform.workspace", "a_b"]
    texts = ODD + ["".join(rng.choices(words, k=rng.randrange(1, 14))) for _ in range(400)]
    got = {}
    for r in inspection.references(spark.createDataFrame(list(enumerate(texts)), "i int, t string"), "i", "t").collect():
        got.setdefault(r.i, []).append((r.kind, r.ref, r.position))
    for i, t in enumerate(texts):
        assert sorted(got.get(i, [])) == sorted(found(t)), t


def test_provenance(spark):
    texts = [
        '${a ${var.x} b} var.y', "${upper(var.z)}", "[for k in var.list : local.v]", "var.c ? local.d : 'x'", 'other(var.q) lower("${var.r}")', "${var.one} ${var.two}", None, "", "?:", "??::a ? var.k : local.l",
    ]
    rows = inspection.walked(spark.createDataFrame([*enumerate(texts), (0, texts[0])], "i int, t string"), "i", "t").collect()
    got = {(r.i, r.ref): (r.ref_type, r.via, r.position, r.is_conditional, r.is_computed) for r in rows}
    assert len(got) == len(rows)
    assert got == {
        (0, "var.x"): ("variable", "direct", 6, True, False), (0, "var.y"): ("variable", "direct", 16, True, False),
        (1, "upper(var.z)"): ("function", "function", 2, True, True), (1, "var.z"): ("variable", "direct", 8, False, False),
        (2, "var.list"): ("variable", "direct", 10, False, False), (2, "local.v"): ("local", "direct", 21, False, False),
        (3, "var.c"): ("variable", "direct", 0, False, False), (3, "local.d"): ("local", "direct", 8, False, False),
        (4, "var.q"): ("variable", "direct", 6, False, False), (4, "var.r"): ("variable", "template", 22, True, False), (4, 'lower("${var.r}")'): ("function", "function", 13, True, True),
        (5, "var.one"): ("variable", "direct", 2, True, False), (5, "var.two"): ("variable", "direct", 13, True, False),
        (9, "var.k"): ("variable", "direct", 8, False, False), (9, "local.l"): ("local", "direct", 16, False, False),
    }


def split(inside):
    """Arguments by a scan: commas outside literals and brackets."""
    depth, part, out = 0, "", []
    for c, quoted in zip(inside, states(inside), strict=True):
        if not quoted and c in "([{":
            depth += 1
        elif not quoted and c in ")]}":
            depth -= 1
        if c == "," and depth == 0 and not quoted:
            out.append(part)
            part = ""
        else:
            part += c
    return [x.strip(" ") for x in [*out, part] if x.strip(" ")]


def test_arguments_against_a_scan(spark):
    rng = random.Random(6)
    words = ["a", ",", ", ", "(", ")", "[", "]", "{", "}", '"', "'", "1", " "]
    texts = ["", " ", ",", ",,a", 'a, "b, c", [1, 2], {x = (3, 4)}, d', "x" * 9000 + "," + "y" * 9000] + ["".join(rng.choices(words, k=rng.randrange(1, 16))) for _ in range(300)]
    d = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", inspection.arguments(F.col("t")).alias("a"))
    for r in d.collect():
        assert r.a == split(texts[r.i]), texts[r.i]


def test_argument_types_and_trees(spark):
    call = """merge( {a = 1}, lookup(var.m, 'k', data.a_b.c), upper("x, \\"y"), -1.5, .5, 7, TRUE, none, var.a.b, "s", raw text, other(1), keys() )"""
    d = spark.createDataFrame([(1, call), (2, "other(var.x)"), (3, None), (4, ""), (5, "length([])")], "i int, t string")
    nodes = {(r.i, r.path): (r.depth, r.position, r.type, r.value) for r in inspection.argument_nodes(d, "i", "t").collect()}
    assert nodes == {
        (1, "0"): (0, 0, "call", "merge"), (1, "0.0"): (1, 0, "raw", "{a = 1}"), (1, "0.1"): (1, 1, "call", "lookup"), (1, "0.1.0"): (2, 0, "reference", "var.m"), (1, "0.1.1"): (2, 1, "string", "k"), (1, "0.1.2"): (2, 2, "raw", "data.a_b.c"),
        (1, "0.2"): (1, 2, "call", "upper"), (1, "0.2.0"): (2, 0, "string", 'x, \\"y'), (1, "0.3"): (1, 3, "number", "-1.5"), (1, "0.4"): (1, 4, "number", ".5"), (1, "0.5"): (1, 5, "number", "7"), (1, "0.6"): (1, 6, "bool", "true"),
        (1, "0.7"): (1, 7, "null", None), (1, "0.8"): (1, 8, "reference", "var.a.b"), (1, "0.9"): (1, 9, "string", "s"), (1, "0.10"): (1, 10, "raw", "raw text"), (1, "0.11"): (1, 11, "raw", "other(1)"), (1, "0.12"): (1, 12, "call", "keys"),
        (5, "0"): (0, 0, "call", "length"), (5, "0.0"): (1, 0, "raw", "[]"),
    }
    trees = {r.i: json.loads(r.tree) for r in inspection.argument_trees(d, "i", "t").select("i", F.to_json("tree").alias("tree")).collect()}
    assert trees[5] == {"call": "length", "args": [{"raw": "[]"}]}
    assert trees[1]["args"][1] == {"call": "lookup", "args": [{"ref": "var.m"}, "k", {"raw": "data.a_b.c"}]}
    assert trees[1]["args"][3:] == [-1.5, 0.5, 7, True, None, {"ref": "var.a.b"}, "s", {"raw": "raw text"}, {"raw": "other(1)"}, {"call": "keys", "args": []}]
    assert inspection.argument_nodes(d.limit(0), "i", "t").count() == 0 and inspection.argument_trees(d.limit(0), "i", "t").count() == 0


def test_dependencies(spark):
    bodies = [
        {"count": "${var.n}", "depends_on": "module.a", "provider": "aws.west", "lifecycle": {"ignore": ["${aws_a.b.c}"]}, "x": [1, "${local.l}"], "y": {"z": [{"deep": '${data.a_b.c.d}-${path.module}-"var.no"'}]}, "n": None}, {}, None, [],
    ]
    d = spark.createDataFrame([(i, None if b is None else json.dumps(b)) for i, b in enumerate(bodies)], "k int, b string").select("k", F.parse_json("b").alias("attributes"))
    got = {(r.k, r.path, r.source, r.ref, r.target) for r in blocks.dependencies(d, "k").collect()}
    assert got == {
        (0, "count", "count", "var.n", "var.n"), (0, "depends_on", "depends_on", "module.a", "module.a"), (0, "provider", "provider", "aws.west", "provider.aws.west"), (0, "lifecycle.ignore[0]", "lifecycle", "aws_a.b.c", "aws_a.b"),
        (0, "x[1]", "attribute", "local.l", "local.l"), (0, "y.z[0].deep", "nested", "data.a_b.c.d", "data.a_b.c"),
    }
    m = {r.k: (r.depends_on, r.own and sorted(r.own)) for r in blocks.meta_arguments(d).select("k", "depends_on", F.map_keys("own").alias("own")).collect()}
    assert m == {0: (["module.a"], ["n", "x", "y"]), 1: (None, []), 2: (None, None), 3: (None, None)}


HCL = """# resource "a" "b" {
resource "aws_a" "b" {
  x = 1

  rule {
    y = "}{"
  }
  x = 2
}
locals { one = 1 }
locals {
  two = { a = 1 }
}
variable "open" {
  type = string"""
JSON = """{
  "variable": {
    "v": {
      "default": {"a": 1}
    },
    "w": {}
  },
  "locals": {
    "k": 1
  },
  "resource": {
    "aws_a": {
      "b": {
        "x": 1
      }
    }
  }
}"""


@pytest.mark.parametrize("pieces", [1, 7])
def test_lines(spark, pieces):
    rows = [("p", f, i + 1, line) for f, text in (("a.tf", HCL), ("b.tf.json", JSON), ("c.tf", "")) for i, line in enumerate(text.split("\n"))]
    d = spark.createDataFrame(rows, "project string, file_path string, line_number int, line string").repartition(pieces)
    got = {(r.file_path, r.kind, r.label1, r.label2): (r.line_start, r.line_end) for r in positions.places(d).collect()}
    assert got == {
        ("a.tf", "resource", "aws_a", "b"): (2, 9), ("a.tf", "locals", None, None): (10, 13), ("a.tf", "variable", "open", None): (14, 15),
        ("b.tf.json", "variable", "v", None): (3, 5), ("b.tf.json", "variable", "w", None): (6, 8), ("b.tf.json", "locals", None, None): (8, 10), ("b.tf.json", "resource", "aws_a", "b"): (13, 15),
    }
    at = {(r.file_path, r.kind, r.attribute): r.line_number for r in positions.attribute_lines(d).collect()}
    assert at[("a.tf", "resource", "x")] == 3 and at[("a.tf", "resource", "y")] == 6 and at[("a.tf", "locals", "two")] == 12 and at[("b.tf.json", "resource", "x")] == 14 and at[("b.tf.json", "locals", "k")] == 9


def test_lines_are_shuffled_once(spark, monkeypatch):
    """All that places take of a file's lines is found where they are; files of many lines, whose braces are added up by pieces, have the same places."""
    text = {"a.tf": ['resource "t" "a" {', "  x = 1", "  in {", "    y = 2", "  }", "}", 'variable "v" { }', "", 'resource "t" "a" {', "  z = 1", "}", "locals {", "  q = 1"],
            "b.tf.json": ["{", '"resource": {', '"t": {', '"a": {', '"x": [{', '"y": 1', "}]", "}", "}", "}", "}"]}
    d = spark.createDataFrame([("p", f, i, x) for f, xs in text.items() for i, x in enumerate(xs, 1)], "project string, file_path string, line_number int, line string")
    found = []
    for many in (positions.MANY, 2, 11):
        monkeypatch.setattr(positions, "MANY", many)
        p, a = positions.places(d), positions.attribute_lines(d)
        if not found:
            assert [x._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") for x in (p, a)] == [1, 1]
        found.append((sorted(map(tuple, p.collect()), key=str), sorted(map(tuple, a.collect()), key=str)))
    assert found[0] == found[1] == found[2]
    assert found[0][0] == [("p", "a.tf", "locals", None, None, 12, 13), ("p", "a.tf", "resource", "t", "a", 1, 6), ("p", "a.tf", "variable", "v", None, 7, 8), ("p", "b.tf.json", "resource", "t", "a", 4, 8)]
    assert {(r[1], r[5], r[6]) for r in found[0][1]} == {("a.tf", "x", 2), ("a.tf", "y", 4), ("a.tf", "q", 13), ("b.tf.json", "a", 4), ("b.tf.json", "x", 5), ("b.tf.json", "y", 6)}
