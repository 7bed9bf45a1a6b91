"""The relation merge and the shared entities without whole groups in one row."""

import contextlib
import io
import os
import random

import pytest

import __spark_entry__ as entry
from papertide.operators import merge

DATA = "/root/testdata/sf0.001"
FIELDS = "metric_value string, confidence double, section string, quote string, granularity string, polarity string"


def fold(rows):
    """Arrivals of one key, one after the other."""
    old, *rest = rows
    old = list(old)
    rank = lambda g: merge.GRANULARITY.get(g, 0)
    for metric, confidence, section, quote, granularity, polarity in rest:
        if rank(old[4]) > rank(granularity):
            continue
        if quote and quote not in (old[3] or ""):
            old[3] = f"{old[3]}; {quote}" if old[3] else quote
        best = max((c for c in (old[1], confidence) if c is not None), default=None)
        old = [metric or old[0], best, section or old[2], old[3], granularity, polarity]
    return (*old, len(rows))


def test_merge_matches_a_fold_row_by_row(spark):
    pick = random.Random(7)
    some = lambda *x: pick.choice(x)
    rows = [(some("1", "2", "3"), some("x", "y", None), n, some(None, "", "0.1", "0.2"), some(None, 0.1, 0.5, 0.9), some(None, "", "methods"), some(None, "", "a", "ab", "b; c", "b"), some(None, "odd", "abstract", "mineru_pdf", "fulltext"), some(None, "p", "q")) for n in range(40)]
    rows += [("9", "z", 100 + n, None, None, "", some("", None), some("abstract", "fulltext"), None) for n in range(5)]
    arrivals = spark.createDataFrame(rows, f"pmid string, k string, seq int, {FIELDS}")
    merged = merge.merge_relations(arrivals, ["pmid", "k"])
    want = {k: fold([r[3:] for r in rows if r[:2] == k]) for k in {r[:2] for r in rows}}
    assert {(r[0], r[1]): tuple(r[2:]) for r in merged.collect()} == want
    plan = io.StringIO()
    with contextlib.redirect_stdout(plan):
        merged.explain()
    collected = [line for line in plan.getvalue().splitlines() if "collect_list" in line]
    assert collected and all("granularity" not in line.split("collect_list")[1].split(")")[0] for line in collected)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")
def test_shared_entity_rows_are_those_of_the_lists(spark):
    found = entry.queries()["t17_shared_entity_rows"](spark, DATA).collect()
    lists = {(r["limitation"], kind, x) for r in entry.queries()["t17_shared_entities"](spark, DATA).collect() for kind, c in (("Disease", "diseases"), ("Task", "tasks"), ("Method", "methods")) for x in r[c].split("|") if x}
    assert len(found) == len(set(map(tuple, found))) and set(map(tuple, found)) == lists
