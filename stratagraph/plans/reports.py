"""Registered queries of reports: states with their reasons, explicit and implicit edges, summaries of a scan, diagrams."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..api import Project
from ..operators import graph, metrics, states, summary
from ..sinks import documents
from .registry import query
from .scans import _folder
from .star import table
from .storage import written

#: Which part depends on which, by their places in a group of 32 parts. Three depend on each other.
_LINKS = (
    *((a, b) for a, bs in {3: (1,), 4: (1,), 5: (1, 2, 3, 4, 6), 6: (1, 2), 7: (8, 9), 22: (23,), 24: (25,), 25: (26,), 26: (24,), 27: (24,), 28: (1,), 29: (1,)}.items() for b in bs),
    *((a, 3) for a in range(10, 20)), *((a, 4) for a in range(10, 15)), (17, 6), (18, 6), (18, 7), (19, 7),
    *((20, b) for b in (5, 7, 8, 9, *range(10, 17))), *((21, b) for b in (1, 2, 3, 4, *range(6, 21), 23)),
)
_ON_CYCLE = (24, 25, 26)
_LINKED_SQL = f"""with recursive p as (select p_partkey as k, p_partkey % 32 as r, p_partkey - p_partkey % 32 as b from part),
links(s, t) as (values {", ".join(f"({a}, {b})" for a, b in _LINKS)}),
linked as (select p.k as src, q.k as dst from p join links on r = s join p q on q.k = p.b + t),
cyclic as (select k, r, b from p where r in {_ON_CYCLE} and b + 26 in (select k from p))"""


def _linked(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Parts (``k, r``: place in the group) and their links (``src, dst``) by number."""
    p = table(s, d, "part").select(F.col("p_partkey").alias("k"), (F.col("p_partkey") % 32).cast("int").alias("r"))
    some = s.createDataFrame([(a, [b for x, b in _LINKS if x == a]) for a in sorted({a for a, _ in _LINKS})], "r int, ts array<int>")
    e = p.join(some, "r").select(F.col("k").alias("src"), F.explode("ts").alias("t"), "r").select("src", (F.col("src") - F.col("r") + F.col("t")).alias("dst"))
    return p, e.join(p.select(F.col("k").alias("dst")), "dst", "left_semi").select("src", "dst")


def _choice(options: tuple[str, ...], at: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, options)), (at % len(options) + 1).cast("int"))


def _sql_choice(options: tuple[str, ...], at: str) -> str:
    return f"[{', '.join(repr(x) for x in options)}][{at} % {len(options)} + 1]"


@query(
    _LINKED_SQL
    + f""",
d as (select src as k, count(*) as d from linked group by 1), n as (select dst as k, count(*) as n from linked group by 1),
f as (select k, r, b // 32 as g, coalesce(d, 0) as d, coalesce(n, 0) as n, k in (select k from cyclic) as circular from p left join d using (k) left join n using (k)),
g as (select *, d + n * 0.5 as c from f)
select k, case when r = 30 then 'missing_dependency' when circular then 'broken' when r = 31 then 'incomplete'
  when r in (28, 29) then case when d = 0 then 'isolated' else 'active' end
  when d = 0 and n = 0 then 'isolated' when d = 0 then 'leaf' when n >= 10 or (n >= 5 and d <= 3) then 'hub' when d >= 5 and n = 1 then 'underutilized' when c >= 20 or d >= 10 then 'complex'
  when r % 4 = 2 and d between 2 and 8 and n >= 2 then 'healthy' when d > 0 and n >= 2 then 'integrated' else 'active' end as state,
case when r = 30 then 'References 5 undefined object(s): local.z' || k || ', var.y' || k || ', local.x' || k || ' (+2 more)' when circular then 'Circular dependency detected involving 3 object(s)'
  when r = 31 then case g % 3 when 0 then 'Instance resource missing required configuration (ami, instance_type, etc.)' when 1 then 'Output missing value attribute' else 'Module missing source attribute' end
  when r in (28, 29) then case when d = 0 then 'Resource not connected to any infrastructure' when r = 28 then 'Core infrastructure using ' || d || ' dependencies' else 'Infrastructure resource using ' || d || ' dependencies' end
  when d = 0 and n = 0 then 'Not connected to any infrastructure components' when d = 0 and r = 1 then 'External-facing resource used by ' || n || ' object(s)' when d = 0 then 'Independent resource used by ' || n || ' object(s)'
  when n >= 10 then 'Critical hub used by ' || n || ' objects' when n >= 5 and d <= 3 then 'Central resource distributing to ' || n || ' consumers' when d >= 5 and n = 1 then 'Complex resource (' || d || ' deps) used by only 1 object'
  when c >= 20 then 'High complexity (score: ' || printf('%.1f', c) || ') - consider refactoring' when d >= 10 then 'Very high dependency count (' || d || ') - consider simplification'
  when r % 4 = 2 and d between 2 and 8 and n >= 2 then 'Well-designed: ' || d || ' deps, ' || n || ' consumers, follows best practices' when d between 2 and 8 and n >= 2 then 'Well-integrated: ' || d || ' deps, ' || n || ' consumers'
  when n >= 2 then 'Integrated: ' || d || ' deps, ' || n || ' consumers' else 'Active: ' || d || ' dependencies, ' || n || ' consumers' end as state_reason from g"""
)
def states_of_other_kinds(s: SparkSession, d: str) -> DataFrame:
    """Parts as objects of a kind without states of its own; some in cycles, incomplete or with missing references in an
    order of their own, some of each family of core and outward-facing resource types."""
    p, e = _linked(s, d)
    name, g, r = F.col("k").cast("string"), F.floor(F.col("k") / 32), F.col("r")
    rt = F.when(r == 28, F.concat(F.lit("x_"), _choice(states.CORE, g))).when(r == 29, "x_thing").when(r == 1, F.concat(F.lit("x_"), _choice(states.OUTWARD, g), F.lit("_y"))).when((r == 31) & (g % 3 == 0), "aws_instance").when(r == 31, F.lit(None).cast("string")).otherwise("x_other")
    kind = F.when(r.isin(28, 29) | (r == 31) & (g % 3 == 0), "resource").when(r == 31, F.when(g % 3 == 1, "output").otherwise("module")).otherwise("check")
    o = p.select(name.alias("full_name"), kind.alias("type"), rt.alias("resource_type"), r, F.parse_json(F.lit('{"other": 1}')).alias("attributes"), F.when(r % 4 == 2, "a description").alias("description"))
    none = lambda t: F.lit(None).cast(t)
    lacks = states.incomplete(F.col("attributes"), F.col("type"), F.col("resource_type"), none("string"), none("boolean"), none("variant"), none("variant"))
    good = states.good_practice(F.col("description"), none("map<string,string>"), F.lit("good_name"), F.lit(False))
    o = o.select("full_name", "type", "resource_type", (lacks & (F.col("r") == 31)).alias("incomplete"), good.alias("good_practice"))
    names = F.array(*(F.concat(F.lit(x), F.col("k").cast("string")) for x in ("local.z", "var.y", "local.x", "var.a", "local.b")))
    missing = p.where("r = 30").select(F.col("k").cast("string").alias("src"), F.posexplode(names).alias("place", "ref"))
    f = states.features(o, e.select(F.col("src").cast("string").alias("src"), F.col("dst").cast("string").alias("dst")), missing)
    return states.classify(f).select(F.col("full_name").cast("long").alias("k"), "state", "state_reason")


@query("""with o as (select o_orderkey as k, o_custkey as c, unnest(case when o_orderkey % 9 = 0 then [1, 2] when o_orderkey % 3 = 0 then [1] else [] end) as i from orders)
select 'aws_lb.o' || k as src, 'aws_vpc.c' || c as dst, 'explicit' as kind from o
union all select 'aws_lb.o' || o_orderkey, 'aws_vpc.c' || o_custkey, 'implicit' from orders where o_orderkey % 3 <> 0
union all select 'aws_lb.o' || o_orderkey, 'provider.aws', 'implicit' from orders union all select 'aws_vpc.c' || c_custkey, 'provider.aws', 'implicit' from customer
union all select 'aws_vpc.c' || c_custkey, 'var.n' || c_nationkey, 'implicit' from customer""")
def explicit_and_implicit(s: SparkSession, d: str) -> DataFrame:
    """Orders depend on customers, which their texts name: not once more where they say so themselves, though as often as they say it."""
    none = F.lit(None).cast("string").alias("provider")
    row = lambda df, name, kind, rt, deps, text: df.select(name.alias("full_name"), F.lit(kind).alias("type"), F.regexp_extract(name, r"[^.]+$", 0).alias("name"), F.lit(rt).cast("string").alias("resource_type"), none, none.alias("provider_alias"), deps.alias("depends_on"), text.alias("attributes_text"))
    key = lambda c: F.col(c).cast("string")
    no = F.array().cast("array<string>")
    customer = F.concat(F.lit("aws_vpc.c"), key("o_custkey"))
    deps = F.when(F.col("o_orderkey") % 9 == 0, F.array(customer, customer)).when(F.col("o_orderkey") % 3 == 0, F.array(customer)).otherwise(no)
    o = row(table(s, d, "orders"), F.concat(F.lit("aws_lb.o"), key("o_orderkey")), "resource", "aws_lb", deps, F.concat(F.lit('{"vpc": "${'), customer, F.lit('.id}"}')))
    c = row(table(s, d, "customer"), F.concat(F.lit("aws_vpc.c"), key("c_custkey")), "resource", "aws_vpc", no, F.concat(F.lit('{"zone": "${var.n'), key("c_nationkey"), F.lit('}"}')))
    n = row(table(s, d, "nation"), F.concat(F.lit("var.n"), key("n_nationkey")), "variable", None, no, F.lit("{}"))
    p = row(s.range(1), F.lit("provider.aws"), "provider", None, no, F.lit("{}"))
    return Project(o.unionAll(c).unionAll(n).unionAll(p)).edges.select("src", "dst", "kind")


_KINDS = ("resource", "data", "module", "variable", "output", "provider", "local", "terraform")
_SOME = ("active", "unused", "orphaned", "isolated", "incomplete", "hub", "input", "configuration", "integrated")
_STATED_SQL = f"""with o as (select c_custkey as k, 'c' || c_custkey as full_name, {_sql_choice(_KINDS, 'c_custkey')} as type, {_sql_choice(_SOME, 'c_nationkey')} as state, c_nationkey as nk from customer),
stated as (select *, case when type in ('resource', 'data') then case when nk < 12 then 'AWS' else 'g' || nk % 3 end || '_t' || nk end as resource_type from o)"""


def _stated(s: SparkSession, d: str) -> DataFrame:
    """Customers as objects with states; the last come first."""
    nk, key = F.col("c_nationkey"), F.col("c_custkey")
    kind = _choice(_KINDS, key)
    rt = F.when(kind.isin("resource", "data"), F.concat(F.when(nk < 12, "AWS").otherwise(F.concat(F.lit("g"), (nk % 3).cast("string"))), F.lit("_t"), nk.cast("string")))
    return table(s, d, "customer").select(F.concat(F.lit("c"), key.cast("string")).alias("full_name"), kind.alias("type"), _choice(_SOME, nk).alias("state"), rt.alias("resource_type"), F.lit(None).cast("string").alias("provider"), (-key).alias("ord"))


_SCORE = "greatest(0.0, least(100.0, (count(*) filter (where state in ('active', 'input', 'configuration')) * 100.0 - count(*) filter (where state = 'unused') * 15.0 - count(*) filter (where state = 'orphaned') * 10.0 - count(*) filter (where state = 'incomplete') * 20.0) / count(*) filter (where type <> 'terraform')))"


@query(
    _STATED_SQL
    + f""" select 'counts' as section, type as key, count(*) as n, cast(null as double) as share, cast(null as varchar) as name from stated where type <> 'terraform' group by 2 union all select 'counts', 'total', count(*), null, null from stated where type <> 'terraform'
union all select 'health', state, count(*), null, null from stated where state in ('unused', 'orphaned', 'isolated', 'incomplete') group by 2 union all select 'health', 'score', null, round({_SCORE}, 2), null from stated
union all select 'resource_types', resource_type, count(*), null, null from stated where type = 'resource' group by 2 union all select 'state_distribution', state, count(*), null, null from stated group by 2
union all select 'providers', lower(split_part(resource_type, '_', 1)), count(*), null, null from stated where resource_type is not null group by 2
union all select 'issues', state, place, null, full_name from (select *, row_number() over (partition by state order by k desc) as place from stated where state in ('unused', 'orphaned', 'isolated', 'incomplete')) where place <= 5 or state = 'incomplete'"""
)
def scan_summary(s: SparkSession, d: str) -> DataFrame:
    return summary.scan_summary(_stated(s, d), order="ord")


@query(_STATED_SQL + """, t as (select resource_type, count(*) as n, max(k) as k from stated where type = 'resource' group by 1), r as (select *, row_number() over (order by n desc, k desc) as place, count(*) over () as m from t)
select place, resource_type as label, n from r where place <= 10 union all select distinct 11, '... and ' || (m - 10) || ' more', cast(null as bigint) from r where m > 10""")
def types_told(s: SparkSession, d: str) -> DataFrame:
    return metrics.top_types_told(_stated(s, d), order="ord")


@query(
    _STATED_SQL
    + f""", n as (select count(*) filter (where type <> 'terraform') as total, count(*) filter (where type = 'resource') as r, count(distinct resource_type) filter (where type = 'resource') as t, count(*) filter (where type = 'data') as dt,
array_to_string(list_sort(list(distinct lower(split_part(resource_type, '_', 1))) filter (where resource_type is not null)), ', ') as used, round({_SCORE}, 2) as score, count(*) filter (where state = 'unused') as u, count(*) filter (where state = 'orphaned') as o, count(*) filter (where state = 'incomplete') as i from stated)
select unnest([0, 1, 2, 3, 4, 5, 6, 7]) as place, unnest(['Total objects: ' || total, 'Resources: ' || r || ' (' || t || ' types)', 'Data sources: ' || dt, 'Providers: ' || used, 'Health: ' || printf('%.1f', score) || '% (' || case when score < 50 then 'poor' when score < 80 then 'fair' else 'good' end || ')', 'Unused: ' || u, 'Orphaned: ' || o, 'Incomplete: ' || i]) as line from n"""
)
def scan_in_short(s: SparkSession, d: str) -> DataFrame:
    return summary.short_lines(summary.scan_summary(_stated(s, d)))


_NAMES = ("module.p", "aws_long_resource_type_of_parts.part_", "data.aws_long_type_of_parts_here.part_", "moved.net.some.very.long.address.of.part_")
_TYPES = ("module", "resource", "data", "moved")
_NODES_SQL = (
    _LINKED_SQL
    + f""",
nodes as (select k, r, {_sql_choice(_NAMES, 'r')} || k as node, {_sql_choice(_TYPES, 'r')} as type, k in (select k from cyclic) as on_cycle from p),
edges as (select a.node as src, b.node as dst, src as a, dst as b from linked join nodes a on a.k = src join nodes b on b.k = dst),
free as (select * from nodes where not on_cycle),
inner_edges as (select a, b from edges where a in (select k from free) and b in (select k from free))"""
)


def _part_name(key: Column) -> Column:
    return F.concat(_choice(_NAMES, key % 32), key.cast("string"))


def _named_links(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    p, e = _linked(s, d)
    name = lambda k: _part_name(F.col(k))
    return p.select(name("k").alias("node"), _choice(_TYPES, F.col("r")).alias("type")), e.select(name("src").alias("src"), name("dst").alias("dst"))


_HEAD = "\n".join(("graph TD", *(f"    classDef {c} fill:{a},stroke:{b},stroke-width:2px" for c, a, b in documents.CLASSES), "    %% Dependencies"))


@query(
    _NODES_SQL
    + f""",
below as (select k as node, 0 as depth from free where k not in (select a from edges) union select a, depth + 1 from below join inner_edges on b = node),
waits as (select k from cyclic union select a from edges join waits on b = k),
deep as (select k, case when k not in (select k from waits) then (select max(depth) from below where below.node = nodes.k) end as depth, node, type, (select count(*) from edges where a = nodes.k) as d, (select count(*) from edges where b = nodes.k) as n from nodes),
num as (select src, dst, a, b, row_number() over (order by src, dst) - 1 as no from edges),
rings as (select b, row_number() over (order by {_NAMES[1]!r} || (b + 25)) as i from cyclic where r = 24)
select unnest(string_split({_HEAD!r}, chr(92) || 'n')) as line
union all select distinct case when depth is null then '    %% On a cycle or depending on one' else '    %% Depth ' || depth || case when depth = 0 then ' - Root nodes' else '' end end from deep
union all select '    ' || replace(node, '.', '_') || '["' || case type when 'module' then '📦 MODULE' when 'resource' then '🛠️ RESOURCE' when 'data' then '📊 DATA' else '📄 MOVED' end || '<br>`' || case type when 'data' then 'data...part_' || k when 'moved' then 'moved.net...part_' || k else node end || '`<br>Depth: ' || coalesce(depth::varchar, 'cycle') || '<br>╭─ Dependencies: ' || d || '<br>╰─ Dependents: ' || n || '"]' from deep
union all select '    class ' || replace(node, '.', '_') || ' ' || case type when 'moved' then 'default' else type end from deep
union all select '    ' || replace(src, '.', '_') || ' --> ' || replace(dst, '.', '_') from edges
union all select unnest(['    %% Circular Dependencies (highlighted)', '    linkStyle default fill:none,stroke:#ff0000,stroke-width:2px,stroke-dasharray:5,5']) where exists (from cyclic)
union all select '    %% Cycle ' || i from rings
union all select '    linkStyle ' || no || ' stroke:#ff0000,stroke-width:3px,stroke-dasharray:0' from num where a in (select k from cyclic) and b in (select k from cyclic)"""
)
def diagram_by_depth(s: SparkSession, d: str) -> DataFrame:
    """A chart of the parts, written in order and read back."""
    p, edges = _linked(s, d)
    nodes = p.select(F.col("k").alias("node"), _choice(_TYPES, F.col("r")).alias("type"))
    path = _folder(s)
    edges = written(graph.distinct_edges(edges))
    leveled = written(graph.levels(nodes, edges, distinct=True))
    documents.write_lines(documents.diagram_lines(nodes, edges, graph.cycle_witnesses(edges, leveled), _part_name, leveled), path)
    return s.read.text(path).select(F.col("value").alias("line"))


@query(
    _NODES_SQL
    + """,
above as (select k as node, 0 as layer from free where k not in (select b from edges) union select b, layer + 1 from above join inner_edges on a = node),
top as (select node as k, max(layer) as layer from above group by 1),
laid as (select nodes.k, nodes.node, type, coalesce(top.layer, (select max(layer) + 1 from top)) as layer from nodes left join top using (k)),
places as (select k, node, type, layer, 1000.0 / (count(*) over (partition by layer) + 1) * row_number() over (partition by layer order by node) as x, 800.0 / ((select count(distinct layer) from laid) + 1) * (layer + 1) as y from laid)
select node as a, type as b, layer, round(x, 6) as x1, round(y, 6) as y1, cast(null as double) as x2, cast(null as double) as y2 from places
union all select src, dst, null, round(f.x, 6), round(f.y, 6), round(t.x, 6), round(t.y, 6) from edges join places f on f.k = a join places t on t.k = b"""
)
def graph_with_layout(s: SparkSession, d: str) -> DataFrame:
    """The parts with their places in a drawing, and their links from end to end."""
    nodes, edges = graph.laid_out(*_named_links(s, d))
    r = lambda c: F.round(c, 6).alias(c)
    none = F.lit(None).cast("double")
    n = nodes.select(F.col("node").alias("a"), F.col("type").alias("b"), F.col("layer").cast("long").alias("layer"), r("x").alias("x1"), r("y").alias("y1"), none.alias("x2"), none.alias("y2"))
    return n.unionAll(edges.select("src", "dst", F.lit(None).cast("long"), r("x1"), r("y1"), r("x2"), r("y2")))
