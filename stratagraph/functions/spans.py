"""Where things stand in a text, in SQL functions: matches with positions, running totals, bisection. No row leaves its task."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A match: start, end (exclusive), text. Positions count code points from 0.
SPANS = "array<struct<s:int,e:int,m:string>>"


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once, however often ``body`` uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def running(values: Column, kind: str = "int") -> Column:
    """Running sums of an array. Arrays are extended within blocks of about the root of its length, so that long ones stay cheap."""
    none = F.array().cast(f"array<{kind}>")

    def within(xs: Column, first: Column) -> Column:
        begin = F.struct(first.cast(kind).alias("sum"), none.alias("sums"))
        return F.aggregate(xs, begin, lambda a, x: F.struct((a["sum"] + x).cast(kind).alias("sum"), F.concat(a["sums"], F.array((a["sum"] + x).cast(kind))).alias("sums")), lambda a: a["sums"])

    def blocks(v: Column) -> Column:
        n = F.greatest(F.lit(32), F.ceil(F.sqrt(F.size(v))).cast("int"))
        return F.transform(F.sequence(F.lit(0), F.floor((F.size(v) - 1) / n).cast("int")), lambda i: F.slice(v, i * n + 1, n))

    def joined(cut: Column) -> Column:
        totals = within(F.transform(cut, lambda b: F.aggregate(b, F.lit(0).cast(kind), lambda a, x: (a + x).cast(kind))), F.lit(0))
        return bound(totals, lambda t: F.flatten(F.transform(cut, lambda b, i: within(b, F.when(i == 0, F.lit(0).cast(kind)).otherwise(F.get(t, i - 1))))))

    return F.when(F.size(values) > 0, bound(bound(values, blocks), joined)).otherwise(none)


def spans(text: Column, pattern: str | Column) -> Column:
    """Leftmost, non-overlapping matches of ``pattern`` (which never matches nothing), in order; none for a null text."""
    pattern = F.lit(pattern) if isinstance(pattern, str) else pattern

    def placed(v: Column) -> Column:
        sizes = F.zip_with(v["m"], F.slice(v["between"], F.lit(1), F.size(v["m"])), lambda m, b: F.length(m) + F.length(b))
        return F.zip_with(v["m"], running(sizes), lambda m, e: F.struct((e - F.length(m)).alias("s"), e.alias("e"), m.alias("m")))

    found = F.struct(F.regexp_extract_all(text, pattern, F.lit(0)).alias("m"), F.split(text, pattern, -1).alias("between"))
    return F.when(F.regexp_like(text, pattern), bound(found, placed)).otherwise(F.array().cast(SPANS))


def within(places: Column, at: Column) -> Column:
    """Whether position ``at`` lies inside one of the sorted, disjoint ``places`` (after its first code point), by bisection."""

    def halve(r: Column, _: Column) -> Column:
        mid = F.shiftright(r["low"] + r["high"], 1)
        before = F.get(places, mid)["s"] < at
        return F.when(r["high"] - r["low"] > 1, F.struct(F.when(before, mid).otherwise(r["low"]).alias("low"), F.when(before, r["high"]).otherwise(mid).alias("high"))).otherwise(r)

    steps = F.sequence(F.lit(0), F.length(F.bin(F.size(places))))
    last = F.aggregate(steps, F.struct(F.lit(-1).alias("low"), F.size(places).alias("high")), halve, lambda r: r["low"])
    return F.when(F.size(places) > 0, F.coalesce(F.get(places, last)["e"] > at, F.lit(False))).otherwise(False)
