"""The scalar functions of configuration expressions, as Columns. Nulls propagate as they do there."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def join(sep: str, xs: Column) -> Column:
    """Nulls are skipped."""
    return F.array_join(xs, sep)


def split(sep: str, x: Column) -> Column:
    """By a literal; null if the text is null or the separator empty."""
    return F.split(x, r"\Q" + sep.replace(r"\E", r"\E\\E\Q") + r"\E", -1) if sep else F.lit(None).cast("array<string>")


def concat(*xs: Column) -> Column:
    return F.flatten(F.filter(F.array(*xs), lambda x: x.isNotNull()))


def merge(a: Column, b: Column) -> Column:
    """The later map wins, without depending on the session's policy for repeated keys."""
    rest = F.map_filter(a, lambda k, _: ~F.array_contains(F.map_keys(b), k))
    return F.map_concat(rest, b)


def lookup(m: Column, key: Column | str, default: object = None) -> Column:
    return F.coalesce(F.try_element_at(m, F.lit(key) if isinstance(key, str) else key), F.lit(default))


def fmt(pattern: str, *xs: Column) -> Column:
    return F.format_string(pattern, *xs)


def replace(x: Column, old: str, new: str) -> Column:
    return F.replace(F.coalesce(x, F.lit("")), F.lit(old), F.lit(new))


def length(x: Column, kind: str = "string") -> Column:
    """0 for null."""
    return F.coalesce(F.length(x) if kind == "string" else F.size(x), F.lit(0))


def element(xs: Column, i: Column) -> Column:
    """From 0; negative from the end; null outside."""
    return F.try_element_at(xs, F.when(i >= 0, i + 1).otherwise(i).cast("int"))


def compact(xs: Column) -> Column:
    return F.filter(xs, lambda x: x.isNotNull() & (x != ""))


def contains(xs: Column, x: object) -> Column:
    return F.coalesce(F.array_contains(xs, x), F.lit(False))


def range_(start: Column, stop: Column, step: int = 1) -> Column:
    """Half open."""
    last = stop - (1 if step > 0 else -1)
    ok = (last >= start) if step > 0 else (last <= start)
    return F.when(ok, F.sequence(start, last, F.lit(step))).otherwise(F.array().cast("array<int>"))


def cidr_subnet(cidr: Column, bits: int, number: Column) -> Column:
    """The ``number``-th network of ``bits`` more prefix bits in an IPv4 network; null where it doesn't fit."""
    p, octets = F.split(cidr, "/")[1].cast("int"), F.split(F.split(cidr, "/")[0], r"\.")
    base = sum((octets[i].cast("long") * F.lit(256 ** (3 - i)) for i in range(1, 4)), octets[0].cast("long") * F.lit(256**3))
    new = p + bits
    size = F.pow(F.lit(2.0), F.lit(32) - new).cast("long")
    whole = F.pow(F.lit(2.0), F.lit(32) - p).cast("long")
    at = base - F.pmod(base, whole) + number * size
    octet = lambda k: F.pmod(F.floor(at / F.lit(256**k)), F.lit(256)).cast("string")
    text = F.concat(octet(3), F.lit("."), octet(2), F.lit("."), octet(1), F.lit("."), octet(0), F.lit("/"), new.cast("string"))
    return F.when((new <= 32) & (number * size < whole), text)


def json_encode(x: Column) -> Column:
    return F.to_json(x)


def json_decode(x: Column) -> Column:
    return F.try_parse_json(x)


def base64(x: Column) -> Column:
    return F.base64(x)


def timestamp(at: Column | None = None) -> Column:
    """ISO text in UTC, of a given time for reruns that agree."""
    return F.date_format(F.current_timestamp() if at is None else at, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def provider_of(resource_type: Column) -> Column:
    return F.when(resource_type != "", F.substring_index(resource_type, "_", 1))


def base_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def source_segment(source: Column) -> Column:
    """The last part of a module's source; ``module`` where there is none."""
    return F.when(F.coalesce(source, F.lit("")) == "", "module").otherwise(base_name(source))


def shortened(text: Column, most: int) -> Column:
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, most), F.lit("..."))).otherwise(text)


def percent(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, F.round(part * 100.0 / whole, 2)).otherwise(0.0)


TABLE = {"join": join, "split": split, "concat": concat, "merge": merge, "lookup": lookup, "format": fmt, "lower": F.lower, "upper": F.upper, "replace": replace, "length": length, "keys": F.map_keys, "values": F.map_values, "element": element, "flatten": F.flatten, "distinct": F.array_distinct, "compact": compact, "contains": contains, "min": F.least, "max": F.greatest, "range": range_, "cidrsubnet": cidr_subnet, "jsonencode": json_encode, "jsondecode": json_decode, "base64encode": base64, "timestamp": timestamp}
