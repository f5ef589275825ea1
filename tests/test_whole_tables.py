"""Registered queries over whole tables, against brute force on the smallest one."""

from __future__ import annotations

import math
from collections import Counter

import __spark_entry__ as entry
from terralane.operators import export
from terralane.plans import inputs

SMALL = "/root/testdata/sf0.001"


def test_every_road_is_sampled(spark):
    want = {}
    for r in inputs.lines(spark, SMALL, 0).collect():
        dx, dy = r["x2"] - r["x1"], r["y2"] - r["y1"]
        size = math.hypot(dx, dy)
        if size == 0:
            continue
        n = max(math.ceil((size - 37.5) / 75), 0)
        for m in [i * 75 + 37.5 for i in range(n)] or [size / 2]:
            for off in (0.0, -8.0, 8.0):
                want[r["line"], round(m, 3), off] = r["x1"] + m / size * dx - off * (1 if dy >= 0 else -1) * dy / size
    got = {(r["line"], round(r["m"], 3), r["off"]): r["x"] for r in entry.queries()["route_sampling"](spark, SMALL).collect()}
    assert len({line for line, _, _ in want}) > 50 and set(got) == set(want)
    assert all(abs(got[k] - want[k]) < 2e-3 for k in want)


def test_union_has_every_site(spark):
    want = {(r["candidate_id"], 2 if r["is_culvert"] or r["field_denied"] else 1) for r in inputs.features(spark, SMALL).collect()}
    got = [(r["candidate_id"], r["v"]) for r in entry.queries()["union_by_id"](spark, SMALL).collect()]
    assert len(got) == len(want) and set(got) == want


def test_declutter_fold_is_the_walk_with_the_default_cap(spark):
    roads = {r["row"]: r["road_name"] for r in inputs.features(spark, SMALL).collect()}
    kept, count = [], Counter()
    for r in sorted(inputs.sites(spark, SMALL).collect(), key=lambda r: (r["c_nationkey"], r["row"])):
        if count[roads[r["row"]]] < export.PER_ROAD and all(math.hypot(r["x"] - k["x"], r["y"] - k["y"]) >= 100.0 for k in kept):
            count[roads[r["row"]]] += 1
            kept.append(r)
    got = {(r["row"], r["road_name"]) for r in entry.queries()["declutter_fold"](spark, SMALL).collect()}
    assert got == {(k["row"], roads[k["row"]]) for k in kept[:2000]}
