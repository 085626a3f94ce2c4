"""What stands in an expression's text: references with positions and provenance, and calls with typed arguments.

A text is looked at in its row by SQL functions. Literals and escapes are found first, as the states of a scan by
character would have them, so that each match can be asked whether it stands inside one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.spans import bound, running, spans, within
from ..plans.storage import discard, written
from . import refs
from .expressions import FUNCTION_NAMES

#: Stands for a dot before a name, so that a path of any length is one run of characters to a pattern (no repeated groups).
DOT, OTHER = "\ue000", "\ue001"
# The inspector's reference patterns, each with its kind; a dot before a name is DOT.
_PATH = f"{DOT}[a-zA-Z_][a-zA-Z0-9_{DOT}-]*+"
REFERENCES = (
    ("variable", rf"\bvar{_PATH}"),
    ("local", rf"\blocal{_PATH}"),
    ("module", rf"\bmodule{_PATH}"),
    ("data", rf"\bdata{DOT}[a-zA-Z_][a-zA-Z0-9_-]*{_PATH}"),
    ("resource", rf"\b[a-z][a-z0-9]*_[a-z0-9_]+{_PATH}"),
    ("path", rf"\bpath{DOT}(?:module|root|cwd)"),
    ("terraform", rf"\bterraform{DOT}workspace"),
    ("count", rf"\bcount{DOT}index"),
    ("each", rf"\beach{DOT}(?:key|value)"),
    ("self", rf"\bself{_PATH}"),
)
#: A reference is no part of a longer word, in any alphabet.
ALONE = "(?<![\\p{L}\\p{N}])%s(?![\\p{L}\\p{N}])"
# The forms in which a text holds further expressions.
TEMPLATE = r"\$\{([^}]+)\}"
LOOP = r"\bfor\s+(\w+)\s+in\s+([^:]+)\s*:\s*(.+)"
CALL = r"(?is)([a-z_][a-z0-9_]*)\s*\(([^)]*(?:\([^)]*\))*[^)]*)\)"
CHOICE = r"([^?]+)\?([^:]+):(.+)"
DYNAMIC = r"""dynamic\s+["']([^"']+)["']"""
WHOLE_CALL = r"(?s)^([a-z][a-z0-9_]*)\s*\((.*)\)$"

#: An escape is two code points, whatever is escaped; and literals once there are no escapes, closed or running to the end.
ESCAPE = r"(?s)\\."
LITERAL = r""""[^"]*(?:"|\z)|'[^']*(?:'|\z)"""
#: Literals, brackets and commas, as they come.
TOKEN = LITERAL + r"|[()\[\]{},]"
HITS = "array<struct<kind:string,ref:string,position:int>>"


def _unescaped(text: Column) -> Column:
    """The text with other characters in place of escapes, as long as it was."""
    return F.when(text.contains("\\"), F.regexp_replace(text, ESCAPE, "~~")).otherwise(text)


def literals(text: Column) -> Column:
    """Spans of string literals in either quotes; one that isn't closed runs to the end."""
    return spans(_unescaped(text), LITERAL)


def _dotted(text: Column) -> Column:
    return F.regexp_replace(F.translate(text, DOT, OTHER), r"\.(?=[a-zA-Z_])", DOT)


def _mark(kind: str) -> str:
    """What a text holds if it has a reference of a kind."""
    return "_" if kind == "resource" else "var." if kind == "variable" else f"{kind}."


def located(text: Column) -> Column:
    """Array of ``kind, ref, position`` of each reference outside literals that is not part of a longer word, by pattern and position.

    The patterns are tried one by one, so that ``data.aws_x.y`` is a data source and, within it, a resource.
    """
    patterns = F.array(*(F.struct(F.lit(k).alias("kind"), F.lit(_mark(k)).alias("mark"), F.lit(ALONE % p).alias("pattern")) for k, p in REFERENCES))

    def of(x: Column, v: Column) -> Column:
        some = F.filter(spans(v["shown"], x["pattern"]), lambda m: ~within(v["closed"], m["s"]))
        return F.transform(some, lambda m: F.struct(x["kind"].alias("kind"), F.translate(m["m"], DOT, ".").alias("ref"), m["s"].alias("position")))

    def every(v: Column) -> Column:
        return F.flatten(F.transform(F.filter(patterns, lambda x: F.contains(v["text"], x["mark"])), lambda x: of(x, v)))

    whole = F.struct(text.alias("text"), literals(text).alias("closed"), _dotted(text).alias("shown"))
    return F.when(text.contains(".") | text.contains("_"), bound(whole, every)).otherwise(F.array().cast(HITS))


def _reference(text: Column) -> Column:
    """Whether a text is one reference and nothing else, not even another one within it."""

    def one(shown: Column) -> Column:
        whole = shown.rlike("^(?:" + "|".join(p for _, p in REFERENCES) + ")$")
        return whole & (sum((F.regexp_count(shown, F.lit(ALONE % p)) for _, p in REFERENCES), F.lit(0)) == 1)

    return text.contains(".") & bound(_dotted(text), one)


def references(rows: DataFrame, key: str, text: str) -> DataFrame:
    """``key, kind, ref, position`` of every reference in every text, repeats included; a null text has none."""
    x = rows.select(F.col(key), F.explode(located(F.col(text))).alias("x"))
    return x.select(key, "x.kind", "x.ref", "x.position")


def _parts(text: Column) -> Column:
    """The stretches of a text that are looked at on their own: ``stage, position, part, via``, in order of stages.

    A function call is a reference too, to what the whole of it gives.
    """
    row = lambda stage, at, part, via: F.struct(F.lit(stage).alias("stage"), at.cast("int").alias("position"), part.alias("part"), F.lit(via).alias("via"))
    group = lambda m, pattern, k: F.regexp_extract(m, pattern, k)

    def template(x: Column) -> Column:
        inner = group(x["m"], TEMPLATE, 1)
        lead = F.length(inner) - F.length(F.ltrim(inner))
        return row(2, x["s"] + 2 + lead, F.trim(inner), "template")

    def loop(x: Column) -> Column:
        over, gives = group(x["m"], LOOP, 2), group(x["m"], LOOP, 3)
        at = x["s"] + F.length(F.regexp_extract(x["m"], r"^(for\s+\w+\s+in\s+)", 1))
        return F.array(row(3, at, over, "for"), row(3, x["e"] - F.length(gives), gives, "for"))

    def call(x: Column) -> Column:
        inside = group(x["m"], CALL, 2)
        return F.array(row(4, x["s"], x["m"], "function"), row(5, x["e"] - 1 - F.length(inside), inside, "call"))

    def choice(x: Column) -> Column:
        a, b, c = (group(x["m"], CHOICE, k) for k in (1, 2, 3))
        return F.array(row(6, x["s"], a, "choice"), row(6, x["s"] + F.length(a) + 1, b, "choice"), row(6, x["e"] - F.length(c), c, "choice"))

    known = lambda x: group(x["m"], CALL, 1).isin(*FUNCTION_NAMES)
    some = lambda ok, parts: F.when(ok, parts).otherwise(F.array().cast("array<struct<stage:int,position:int,part:string,via:string>>"))
    return F.concat(
        F.array(row(1, F.lit(0), text, "direct")),
        some(text.contains("${"), F.transform(spans(text, TEMPLATE), template)),
        some(text.contains("for"), F.flatten(F.transform(spans(text, LOOP), loop))),
        some(text.contains("("), F.flatten(F.transform(F.filter(spans(text, CALL), known), call))),
        some(text.contains("?"), F.flatten(F.transform(F.slice(spans(text, CHOICE), 1, 1), choice))),
        some(text.contains("dynamic"), F.transform(spans(text, DYNAMIC), lambda x: row(7, x["s"], x["m"], "dynamic"))),
    )


def _function(part: Column) -> Column:
    """Whether a text is a call of a known function as a whole."""
    return F.regexp_extract(part, WHOLE_CALL, 1).isin(*FUNCTION_NAMES)


def walked(rows: DataFrame, key: str, text: str) -> DataFrame:
    """``key, ref, ref_type, target, scope, via, position, is_conditional, is_computed, is_sensitive``: each reference of a text once.

    A reference is looked for in the text itself, in its templates, loops, calls, choices and dynamic blocks, in this
    order, and what finds it first says how it was found; so does the position of that find. A template that opens another one is
    looked at in the same ways once more. References by templates, loops and choices are conditional, as are those of a text
    with several templates; those of dynamic blocks are computed. A null text has none; rows that repeat a key are one.
    """
    parts = rows.select(F.col(key).alias("k_"), F.col(text).alias("t_")).select("k_", F.posexplode(_parts(F.col("t_"))).alias("i", "p"))
    parts = parts.select("k_", F.col("i").alias("first"), F.lit(0).alias("second"), F.col("p.position").alias("from_"), F.col("p.part").alias("part"), F.col("p.via").alias("via"))
    opened = (F.col("via") == "template") & F.col("part").contains("${")
    again = parts.where(opened).select("k_", "first", F.col("from_").alias("f_"), F.posexplode(_parts(F.col("part"))).alias("i", "p"))
    again = again.select("k_", "first", (F.col("i") + 1).alias("second"), (F.col("f_") + F.col("p.position")).alias("from_"), F.col("p.part").alias("part"), F.col("p.via").alias("via"))
    every = parts.unionAll(again)
    several = F.size(F.split("part", r"\$\{")) > 2
    flags = (
        F.when(F.col("via").isin("template", "for", "choice"), True).when(F.col("via") == "direct", several).otherwise(False).alias("conditional"),
        (F.col("via") == "dynamic").alias("dynamic"),
    )
    order = ["first", "second"]
    # A template that is a call as a whole is a function too, after the references in it; one that opens another is looked at for calls by itself.
    calls = every.where((F.col("via") == "function") | ((F.col("via") == "template") & ~F.col("part").contains("${"))).where(_function(F.col("part")))
    calls = calls.select("k_", *order, F.lit(1 << 30).alias("third"), F.lit("function").alias("kind"), F.col("part").alias("ref"), F.lit("function").alias("via"), F.col("from_").alias("position"), F.lit(True).alias("conditional"), F.lit(False).alias("dynamic"))
    hits = every.where("via <> 'function'").select("k_", *order, "via", "from_", *flags, F.posexplode(located(F.col("part"))).alias("third", "x"))
    hits = hits.select("k_", *order, "third", "x.kind", "x.ref", "via", (F.col("from_") + F.col("x.position")).alias("position"), "conditional", "dynamic")
    best = F.min(F.struct(*order, "third", "via", "position", "kind", "conditional", "dynamic")).alias("x")
    first = hits.unionAll(calls).groupBy("k_", "ref").agg(best)
    p = refs.parsed(F.col("ref"))
    kind = F.col("x.kind")
    target = F.when(kind == "function", F.regexp_extract("ref", WHOLE_CALL, 1)).when(kind.isin("path", "terraform", "count", "each", "self"), F.col("ref")).otherwise(p["target"])
    return first.select(
        F.col("k_").alias(key), "ref", kind.alias("ref_type"), target.alias("target"), refs.scope(kind).alias("scope"), F.col("x.via").alias("via"), F.col("x.position").alias("position"), F.col("x.conditional").alias("is_conditional"),
        (refs.computed(kind) | (kind == "function") | F.col("x.dynamic")).alias("is_computed"), F.when(kind == "function", False).otherwise(refs.sensitive(p["path"])).alias("is_sensitive"),
    )


def arguments(inside: Column) -> Column:
    """The arguments in the text between a call's brackets: what commas outside literals and brackets part, without blanks."""

    def cut(tokens: Column) -> Column:
        step = F.transform(tokens, lambda t: F.when(t["m"].isin("(", "[", "{"), 1).when(t["m"].isin(")", "]", "}"), -1).otherwise(0))
        commas = F.filter(F.zip_with(tokens, running(step), lambda t, d: F.struct(t["s"].alias("s"), ((t["m"] == ",") & (d == 0)).alias("ok"))), lambda x: x["ok"])
        ends = F.concat(F.transform(commas, lambda c: c["s"]), F.array(F.length(inside)))
        return bound(ends, lambda e: F.transform(e, lambda x, i: F.trim(F.substring(inside, F.when(i == 0, F.lit(1)).otherwise(F.get(e, i - 1) + 2), x - F.when(i == 0, F.lit(0)).otherwise(F.get(e, i - 1) + 1)))))

    return F.filter(bound(spans(_unescaped(inside), TOKEN), cut), lambda a: a != "")


def _typed(arg: Column) -> Column:
    """``type, value`` of an argument: a reference, a call (its function's name), a literal, a number, a truth value, null or raw text."""
    quoted = (arg.startswith('"') & arg.endswith('"')) | (arg.startswith("'") & arg.endswith("'"))
    number = arg.rlike(r"^[+-]?[0-9]+(_[0-9]+)*$") | arg.rlike(r"^[+-]?([0-9]+\.[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$")
    kind = F.when(_reference(arg), "reference").when(_function(arg), "call").when(quoted, "string").when(number, "number")
    kind = kind.when(F.lower(arg).isin("true", "false"), "bool").when(F.lower(arg).isin("null", "none"), "null").otherwise("raw")
    return bound(kind, lambda k: F.struct(k.alias("type"), F.when(k == "call", F.regexp_extract(arg, WHOLE_CALL, 1)).when(k == "string", F.substring(arg, F.lit(2), F.length(arg) - 2)).when(k == "bool", F.lower(arg)).when(k != "null", arg).alias("value")))


def argument_nodes(rows: DataFrame, key: str, text: str) -> DataFrame:
    """``key, path, depth, position, type, value``: the tree of a call and its arguments, for texts that are calls of known functions.

    The call itself has the path ``0``; the second argument of its first, ``0.0.1``. A round takes all calls of a depth apart, each
    in its row; there are as many rounds as calls are nested. Other texts have no rows.
    """
    at = rows.select(F.col(key), F.lit("0").alias("path"), F.lit(0).alias("depth"), F.lit(0).alias("position"), F.trim(F.col(text)).alias("arg")).where(_function(F.col("arg")))
    at = written(at.select("*", _typed(F.col("arg")).alias("x")))
    levels = []
    while not at.isEmpty():
        levels.append(at)
        inside = F.trim(F.regexp_extract("arg", WHOLE_CALL, 2))
        below = at.where("x.type = 'call'").select(F.col(key), F.col("path").alias("up"), (F.col("depth") + 1).alias("depth"), F.posexplode(arguments(inside)).alias("position", "arg"))
        at = written(below.select(key, F.concat_ws(".", "up", F.col("position").cast("string")).alias("path"), "depth", "position", "arg", _typed(F.col("arg")).alias("x")))
    discard(at)
    out = (levels or [at.limit(0)])[0] if levels else rows.select(F.col(key), F.lit("").alias("path"), F.lit(0).alias("depth"), F.lit(0).alias("position"), F.lit("").alias("arg"), _typed(F.lit("")).alias("x")).where("false")
    for more in levels[1:]:
        out = out.unionAll(more)
    return out.select(key, "path", "depth", "position", "x.type", "x.value")


def argument_trees(rows: DataFrame, key: str, text: str) -> DataFrame:
    """``key, tree``: the call as a VARIANT of ``{"call": .., "args": [..]}``, references as ``{"ref": ..}``, raw texts as ``{"raw": ..}``.

    Put together from the deepest arguments up; a call's arguments are gathered in its row.
    """
    nodes = written(argument_nodes(rows, key, text))
    deepest = nodes.agg(F.coalesce(F.max("depth"), F.lit(0))).first()[0]
    quoted = F.to_json(F.struct(F.col("value").alias("v")))
    leaf = (
        F.when(F.col("type") == "reference", F.to_json(F.struct(F.col("value").alias("ref")))).when(F.col("type") == "raw", F.to_json(F.struct(F.col("value").alias("raw"))))
        .when(F.col("type") == "string", F.substring(quoted, F.lit(6), F.length(quoted) - 6)).when(F.col("type") == "null", "null")
        .when(F.col("type") == "number", F.regexp_replace(F.regexp_replace(F.regexp_replace("value", "[+_]", ""), r"^(-?)\.", "$10."), r"\.($|[eE])", ".0$1")).otherwise(F.col("value"))
    )
    made = None
    for depth in range(deepest, -1, -1):
        at = nodes.where(F.col("depth") == depth)
        args = F.lit(None).cast("string")
        if made is not None:
            of = made.groupBy(F.col(key).alias("k_"), "up").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("position", "json"))), lambda x: x["json"]), ", ").alias("args"))
            at, args = at.join(of, (F.col(key) == F.col("k_")) & (F.col("path") == F.col("up")), "left"), F.col("args")
        json = F.when(F.col("type") == "call", F.concat(F.lit('{"call": '), F.to_json(F.struct(F.col("value").alias("v"))).substr(F.lit(6), F.length("value") + 2), F.lit(', "args": ['), F.coalesce(args, F.lit("")), F.lit("]}"))).otherwise(leaf)
        made = at.select(key, "position", F.regexp_extract("path", r"^(.*)\.[0-9]+$", 1).alias("up"), json.alias("json"))
    return made.select(key, F.parse_json("json").alias("tree"))
