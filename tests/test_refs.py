"""References bound by name and by prefix, against the definition."""

import random

from stratagraph.operators import refs


def bound(rows, names):
    found = {(s, r) if r in names else (s, n) for s, r in rows for n in ({r} if r in names else {n for n in names if n.startswith(r) and n != s})}
    return found, {(s, r) for s, r in rows if not any(n.startswith(r) for n in names)}


def test_prefixes_of_prefixes_bind_once(spark):
    pick = random.Random(5)
    word = lambda: "".join(pick.choice("ab￿😀") for _ in range(pick.randint(1, 5)))
    names = {word() for _ in range(60)}
    rows = [(pick.choice(["s", "t", "u", *sorted(names)[:4]]), word()) for _ in range(300)] + [(n, n) for n in sorted(names)[:3]] + [(n, n[:1]) for n in sorted(names)[:3]]
    found, missing = refs.resolve(spark.createDataFrame(rows * 2, "src string, ref string"), spark.createDataFrame([(n,) for n in names] * 2, "full_name string"))
    want, lost = bound(rows, names)
    got = [tuple(r) for r in found.collect()]
    assert len(got) == len(set(got)) and set(got) == want
    assert {tuple(r) for r in missing.collect()} == lost
    # Pairs are made once, so no aggregate follows the join that makes them.
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Join") < plan.index("Aggregate")


def test_a_name_under_no_object_stays(spark):
    rows = [(None, "a"), (None, "ab"), ("ab", "a"), ("ab", "ab"), ("x", None)]
    found, missing = refs.resolve(spark.createDataFrame(rows, "src string, ref string"), spark.createDataFrame([("ab",), ("ac",)], "full_name string"))
    assert sorted(map(str, map(tuple, found.collect()))) == ["('ab', 'ab')", "('ab', 'ac')", "(None, 'ab')"]
    assert [tuple(r) for r in missing.collect()] == [("x", None)]


def test_names_are_not_broadcast(spark, monkeypatch):
    plans, write = [], refs.written
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    monkeypatch.setattr(refs, "written", lambda df: plans.append(plan(df)) or write(df))
    names = [(f"part.{i}_key",) for i in range(50)]
    found, missing = refs.resolve(spark.createDataFrame([("s", "part.1"), ("t", "part.9_key"), ("u", "x")], "src string, ref string"), spark.createDataFrame(names, "full_name string"))
    assert len(found.collect()) == 12 and [tuple(r) for r in missing.collect()] == [("u", "x")]
    assert not [p for p in (*plans, plan(found), plan(missing)) if "Broadcast" in p]
