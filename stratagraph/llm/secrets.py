"""Secrets in texts: exact patterns, and weak parts of credentials where they stand together.

The base patterns report whatever they match. A credential often comes in parts that mean little by
themselves: an identifier, a secret value, an endpoint. Such weak candidates are found too, and
joined by interval: one is reported only where complementary parts (strong or weak) lie in its scope,
that is, in the same row within ``SCOPE`` code points of it:

- a weak secret with an identifier or an endpoint in scope,
- a weak identifier with a secret in scope,
- an endpoint with both an identifier and a secret in scope.

All of it is SQL functions on the row, so that nothing is shuffled and no hot key exists. A pattern's
positions follow from the parts between its matches: the text is split by the pattern, and the lengths
of parts and matches add up, in blocks, as arrays are copied when they grow. The spans of a kind are
sorted and disjoint, so the interval join looks up the last span that starts before a scope's end by
bisection: if any lies in the scope, that one does. A text of a million matches takes little more than
its share. Positions count code points; ends are exclusive.
"""

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import packed, texts

SCOPE = 200
MASK = "[SECRET]"

_NAMES = "([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])"
#: The base patterns. Matches of the last two that are too short never hide a longer one, so their
#: least length is part of the pattern; those of the first can, and are dropped afterwards.
ASSIGN = _NAMES + """["']?\\x20*[:=]\\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ASSIGN_LONG = """["']?\\x20*[:=]\\x20*["']?([A-Za-z0-9+/_.=-]{12,})$"""
ACCESS = "AKIA[A-Z0-9]{14,}"
HEX = "[0-9a-f]{16,}"
#: The weak ones.
IDENT = """([cC]lient_?[iI]d|[aA]ccess_?[kK]ey_?[iI]d|[uU]ser_?[nN]ame|[lL]ogin)["']?\\x20*[:=]\\x20*["']?[A-Za-z0-9._@-]{3,}"""
SECRET = "[A-Za-z0-9+/_-]{24,}={0,2}"
ENDPOINT = """https?://[A-Za-z0-9.-]+(:[0-9]+)?[^\\x20\\x09-\\x0D"'<>]*"""

KINDS = ("assign", "access", "hex", "ident", "secret", "endpoint")
SPANS = "array<struct<s:int,e:int,m:string>>"
#: Code points of a text that are masked at a time.
PIECE = 4096


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once, however often ``body`` and its lambdas use it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _prefix(values: Column, combine: Callable[[Column, Column], Column]) -> Column:
    """Running totals of an array of integers, by blocks of about the root of its length."""

    def along(xs: Column, first: Column) -> Column:
        start = F.struct(first.alias("at"), F.array().cast("array<int>").alias("out"))
        more = lambda done, x: F.struct(combine(done["at"], x).alias("at"), F.concat(done["out"], F.array(combine(done["at"], x))).alias("out"))
        return F.aggregate(xs, start, more, lambda done: done["out"])

    def cut(v: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.floor((F.size(v["x"]) - 1) / v["n"]).cast("int")), lambda i: F.slice(v["x"], i * v["n"] + 1, v["n"]))

    def joined(blocks: Column) -> Column:
        before = along(F.transform(blocks, lambda b: F.aggregate(b, F.lit(0), combine)), F.lit(0))
        first = F.concat(F.array(F.lit(0)), F.slice(before, F.lit(1), F.size(blocks) - 1))
        return F.flatten(F.zip_with(blocks, first, along))

    sized = lambda x: F.struct(x.alias("x"), F.greatest(F.lit(64), F.ceil(F.sqrt(F.size(x))).cast("int")).alias("n"))
    return _let(_let(_let(values, sized), cut), joined)


def spans(text: Column, pattern: str, wanted: Column | None = None) -> Column:
    """Leftmost, non-overlapping matches as an array of ``s, e, m``; empty where ``wanted`` is false."""

    def placed(v: Column) -> Column:
        sizes = F.zip_with(v["m"], F.slice(v["b"], F.lit(1), F.size(v["m"])), lambda m, b: F.length(m) + F.length(b))
        ends = _prefix(sizes, lambda a, b: a + b)
        return F.zip_with(v["m"], ends, lambda m, e: F.struct((e - F.length(m)).alias("s"), e.alias("e"), m.alias("m")))

    out = _let(F.struct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("m"), F.split(text, pattern, -1).alias("b")), placed)
    has = text.rlike(pattern) if wanted is None else wanted & text.rlike(pattern)
    return F.when(has, out).otherwise(F.array().cast(SPANS))


def _last(sorted_: Column, before: Callable[[Column], Column]) -> Column:
    """Index of the last item for which ``before`` holds, if it holds for those up to it; -1 if for none."""
    n = F.size(sorted_)

    def halve(r: Column, _: Column) -> Column:
        mid = F.shiftright(r["low"] + r["high"], 1)
        yes = before(F.get(sorted_, mid))
        halved = F.struct(F.when(yes, mid).otherwise(r["low"]).alias("low"), F.when(yes, r["high"]).otherwise(mid).alias("high"))
        return F.when(r["high"] - r["low"] > 1, halved).otherwise(r)

    steps = F.sequence(F.lit(0), F.length(F.bin(n)))
    return F.aggregate(steps, F.struct(F.lit(-1).alias("low"), n.alias("high")), halve, lambda r: r["low"])


def _near(sorted_: Column, of: Column, reach: int) -> Column:
    """Whether one of the spans lies within ``reach`` of ``of``; at 0, whether one overlaps it."""
    last = F.get(sorted_, _last(sorted_, lambda y: y["s"] < of["e"] + reach))
    return F.coalesce(last["e"] > of["s"] - reach, F.lit(False))


def _some(v: Column, names: list[str], of: Column, reach: int = SCOPE) -> Column:
    return reduce(lambda x, y: x | y, (_near(v[k], of, reach) for k in names))


def _kept(name: str, names: list[str], wanted: Callable[[Column, Column], Column]) -> Column:
    """The spans of a kind that are wanted, given all spans of some kinds. Where there are none, nothing is looked at."""
    every = F.struct(*(F.col(k) for k in dict.fromkeys([name, *names])))
    return F.when(F.size(name) > 0, _let(every, lambda v: F.filter(v[name], lambda x: wanted(v, x)))).otherwise(F.col(name))


def scan(docs: DataFrame, *keep: str) -> DataFrame:
    """``docs`` (``doc_id, text`` and the columns in ``keep``) with a column of spans for each kind.

    A null text is empty and has no spans. Every row is looked at by itself, so repeated rows have
    the same result, and an empty table gives no rows. Texts of any length are searched whole.
    """
    text = F.col("text")
    rows = texts(docs, "doc_id", "text", *keep)
    rows = rows.select("*", spans(text, ASSIGN).alias("assign"), spans(text, ACCESS).alias("access"), spans(text, HEX).alias("hex"), spans(text, SECRET).alias("secret"))
    rows = rows.withColumn("assign", F.filter("assign", lambda x: x["m"].rlike(ASSIGN_LONG)))
    base = ["assign", "access", "hex"]
    mixed = lambda x: x["m"].rlike("[0-9]") & x["m"].rlike("[A-Z]") & x["m"].rlike("[a-z]")
    rows = rows.withColumn("secret", _kept("secret", base, lambda v, x: mixed(x) & ~_some(v, base, x, 0)))
    any_ = (F.size("assign") + F.size("access") + F.size("hex") + F.size("secret")) > 0
    rows = rows.withColumns({"ident": spans(text, IDENT, any_), "endpoint": spans(text, ENDPOINT, any_)})
    rows = rows.withColumn("ident", _kept("ident", base, lambda v, x: ~_some(v, base, x, 0)))
    # Under names of their own: the kinds are joined as they are, not as the others' joins leave them.
    secrets, idents = ["assign", "hex", "secret"], ["access", "ident"]
    linked = {
        "ident_": _kept("ident", secrets, lambda v, x: _some(v, secrets, x)),
        "secret_": _kept("secret", [*idents, "endpoint"], lambda v, x: _some(v, [*idents, "endpoint"], x)),
        "endpoint_": _kept("endpoint", [*idents, *secrets], lambda v, x: _some(v, idents, x) & _some(v, secrets, x)),
    }
    return rows.withColumns(linked).drop("ident", "secret", "endpoint").withColumnsRenamed({k: k[:-1] for k in linked})


def _listed(kinds: tuple[str, ...]) -> Column:
    """Spans of some kinds, by start, then kind as listed."""

    def of(i: int, kind: str) -> Column:
        return F.transform(kind, lambda x: F.struct(x["s"].alias("s"), F.lit(i).alias("k"), x["e"].alias("e")))

    return F.array_sort(F.concat(*(of(i, k) for i, k in enumerate(kinds))))


def _text_of(kinds: tuple[str, ...]) -> Column:
    names = F.array(*(F.lit(k) for k in kinds))
    return F.array_join(F.transform(_listed(kinds), lambda x: F.concat_ws(":", F.get(names, x["k"]), x["s"].cast("string"), x["e"].cast("string"))), ",")


def report(docs: DataFrame) -> DataFrame:
    """``doc_id, n_assign, n_access, n_hex, base_sha256, spans`` of each row."""
    return scan(docs).select(
        F.col("doc_id").cast("long").alias("doc_id"),
        *(F.size(k).cast("long").alias(f"n_{k}") for k in KINDS[:3]),
        F.sha2(_text_of(KINDS[:3]), 256).alias("base_sha256"),
        _text_of(KINDS).alias("spans"),
    )


def _masked(text: Column, found: Column) -> Column:
    """``text`` with the spans ``found`` (sorted by start) replaced.

    It goes by pieces of the text, each with the spans that touch it: to cut a long text costs its length.
    """

    def one(v: Column, piece: Column, i: Column) -> Column:
        begin = i * PIECE
        end = begin + F.length(piece)

        def step(done: Column, x: Column) -> Column:
            fresh = F.concat(done["out"], F.substring(piece, done["at"] - begin + 1, x["s"] - done["at"]), F.lit(MASK))
            return F.struct(F.greatest(done["at"], F.least(x["e"], end)).alias("at"), F.when(x["s"] >= done["at"], fresh).otherwise(done["out"]).alias("out"))

        # ``reached`` is the furthest end up to each span, so it is sorted as the starts are.
        first = _last(v["reached"], lambda e: e <= begin) + 1
        inside = F.slice(v["found"], first + 1, F.greatest(_last(v["found"], lambda x: x["s"] < end) - first + 1, F.lit(0)))
        start = F.struct(begin.alias("at"), F.lit("").alias("out"))
        return F.aggregate(inside, start, step, lambda done: F.concat(done["out"], F.substring(piece, done["at"] - begin + 1, F.length(piece))))

    pieces = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0))
    reached = _prefix(F.transform(found, lambda x: x["e"]), lambda a, b: F.greatest(a, b))
    every = F.struct(pieces.alias("pieces"), found.alias("found"), reached.alias("reached"))
    return _let(every, lambda v: F.array_join(F.transform(v["pieces"], lambda piece, i: one(v, piece, i)), ""))


def redact(docs: DataFrame) -> DataFrame:
    """``docs`` with every reported span of ``text`` replaced by ``MASK``, overlapping ones by one.

    ``n_chars``, if there, follows. Rows without a span are unchanged, null and empty texts too. Columns of
    any name keep their values; repeated rows are masked alike; an empty table stays empty.
    """
    names, row = docs.columns, F.col("row_")
    found = scan(docs.select(F.lit(0).alias("doc_id"), F.col("text").cast("string").alias("text"), packed(docs).alias("row_")), "row_")
    found = found.select("row_", "text", _listed(KINDS).alias("all_"))
    found = found.withColumn("masked_", F.when(F.size("all_") > 0, _masked(F.col("text"), F.col("all_"))))
    changed = F.col("masked_").isNotNull()
    new = {"text": F.coalesce(F.col("masked_").cast(docs.schema["text"].dataType), row["text"])}
    if "n_chars" in names:
        new["n_chars"] = F.when(changed, F.length("masked_").cast(docs.schema["n_chars"].dataType)).otherwise(row["n_chars"])
    return found.select(*(new.get(c, row[c]).alias(c) for c in names))
