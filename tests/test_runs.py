"""Runs by batch and by stream on shuffled arrivals, landing with a stop, snapshots, samples and patched dates."""

import json
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from papertide.operators import runs, sampling, snapshots
from papertide.streaming import landing
from papertide.streaming import runs as streamed

DAY0 = datetime(2024, 1, 1)


def plain_states(events):
    out = {}
    for e in sorted(events, key=lambda e: (e[1], e[2])):
        run, at, _, kind, week, raw, key, source, gap, hot, proposal = e
        if kind == "insert":
            out.setdefault(run, [week, raw, key, source, at, None, None, None, None])
        elif run in out:
            s = out[run]
            if kind == "finalize":
                s[5:9] = [at, gap or s[6], hot or s[7], proposal or s[8]]
            elif kind == "hotspot":
                s[7] = hot
            elif kind == "proposal":
                s[8] = proposal or s[8]
    return {run: tuple(s) for run, s in out.items()}


def some_events(seed, n_runs):
    rng, events = random.Random(seed), []
    for run in range(n_runs):
        for seq in range(rng.randint(1, 8)):
            kind = rng.choice(["insert", "insert", "finalize", "hotspot", "proposal", "other"])
            path = lambda c: rng.choice([None, "", f"{c}{rng.randint(0, 99)}"])
            events.append((run, DAY0 + timedelta(hours=rng.randint(0, 30)), seq, kind, f"w{run % 3}", None, f"k{run % 2}", "s", path("g"), path("h"), path("p")))
    return events


def state_of(r):
    return (r.week_id, r.focus_raw, r.focus_key, r.source, r.started_at, r.finished_at, r.gap_report_path, r.hotspot_week_id, r.proposal_report_path)


def test_batch(spark):
    events = some_events(1, 80)
    got = {r.run_id: state_of(r) for r in runs.run_states(spark.createDataFrame(events, runs.EVENTS)).collect()}
    assert got == plain_states(events)


def test_stream_agrees_with_batch(spark, tmp_path):
    spark.conf.set(*streamed.PROVIDER)
    rng, events = random.Random(2), some_events(3, 25)
    rng.shuffle(events)
    third = len(events) // 3 + 1
    told = []
    for i in range(3):
        spark.createDataFrame(events[i * third : (i + 1) * third], runs.EVENTS).coalesce(1).write.parquet(f"{tmp_path}/in/{i}")
    spark.createDataFrame([(999, DAY0 + timedelta(days=30), 0, "insert", "w", None, "k", "s", None, None, None)], runs.EVENTS).coalesce(1).write.parquet(f"{tmp_path}/in/3")
    source = spark.readStream.schema(runs.EVENTS).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
    query = streamed.run_updates(source, timedelta(days=7), "30 days").writeStream.outputMode("update").foreachBatch(lambda df, i: told.extend((i, r) for r in df.collect())).option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
    query.awaitTermination(240)
    assert query.exception() is None
    last = {r.run_id: r for _, r in told if not r.abandoned}
    want = plain_states(events) | {999: ("w", None, "k", "s", DAY0 + timedelta(days=30), None, None, None, None)}
    assert {run: state_of(r) for run, r in last.items()} == want
    spark.conf.unset(streamed.PROVIDER[0])


def test_unfinished_runs_are_told(spark, tmp_path):
    spark.conf.set(*streamed.PROVIDER)
    event = lambda run, day, kind: (run, DAY0 + timedelta(days=day), day, kind, "w", None, "k", "s", None, None, None)
    for i, rows in enumerate([[event(1, 0, "insert"), event(2, 0, "insert")], [event(2, 1, "finalize")], [event(3, 20, "insert")], [event(3, 21, "proposal")], [event(3, 21, "hotspot")]]):
        spark.createDataFrame(rows, runs.EVENTS).coalesce(1).write.parquet(f"{tmp_path}/in/{i}")
    source = spark.readStream.schema(runs.EVENTS).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
    told = []
    query = streamed.run_updates(source).writeStream.outputMode("update").foreachBatch(lambda df, i: told.extend(df.collect())).option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
    query.awaitTermination(240)
    spark.conf.unset(streamed.PROVIDER[0])
    assert query.exception() is None and [r.run_id for r in told if r.abandoned] == [1]


def test_weeks_and_backfill(spark):
    states = spark.createDataFrame([(1, "w", "k", DAY0, None), (2, "w", "k", DAY0, DAY0), (3, "w", "k", DAY0 - timedelta(1), DAY0), (4, "v", "k", None, None)], "run_id long, week_id string, focus_key string, started_at timestamp, finished_at timestamp")
    assert {tuple(r) for r in runs.latest_of_week(states).collect()} == {("w", "k", 3), ("v", "k", 4)}
    items = spark.createDataFrame([(1, 10, "Deep nets for CT scans"), (1, 11, "Other gap"), (2, 12, "Other gap")], "run_id long, item_id long, title string")
    long = "\n# Other GAP \ntext" + "x" * 9000
    proposals = spark.createDataFrame(
        [(1, 1, "# deep nets for ct scans\n", None, None, ""), (2, 1, long, None, "", "done"), (3, 2, "a\nb\nc\nd\ne\n# Other gap", None, "p", None), (4, 1, "", 10, None, "s"), (5, 1, None, None, None, None)],
        "id long, run_id long, proposal_md string, gap_item_id long, proposal_path string, status string",
    )
    got = {r.id: r for r in runs.backfilled(proposals, items, "T").collect()}
    assert {i: (r.gap_item_id, r.status, r.proposal_path, r.filled) for i, r in got.items()} == {
        1: (10, "generated", "ops_proposal_1_backfill_T.md", ["gap_item_id", "status", "proposal_path"]), 2: (11, "done", "ops_proposal_1_backfill_T.md", ["gap_item_id", "proposal_path", "proposal_md"]),
        3: (None, "generated", "p", ["status"]), 4: (10, "s", None, []), 5: (None, "generated", None, ["status"]),
    }
    assert len(got[2].proposal_md) == runs.SECTION


def test_latest_results(spark):
    rows = [("a", 1, "tool_result", "t", '{"gaps": [1, 2]}'), ("a", 2, "tool_result", "t", '{"data": "x", "gaps": [{"method": "m"}, 4, 5]}'), ("a", 3, "tool_call", "t", "{}"), ("a", 1, "tool_result", "u", "nonsense"), ("b", 1, "tool_result", "t", '{"data": [], "gaps": [1]}'), ("b", 2, "tool_result", "u", None), ("b", 1, "tool_result", "u", "[1]")]
    latest = runs.latest_results(spark.createDataFrame(rows, "session string, seq long, type string, name string, result string"))
    assert {(r.session, r.name): (r.seq, r.records) for r in latest.collect()} == {("a", "t"): (2, 3), ("a", "u"): (1, 0), ("b", "t"): (1, 0), ("b", "u"): (2, 0)}
    assert [r.m for r in runs.rows_of(latest, "t", "gaps").filter("session = 'a'").selectExpr("place", "try_variant_get(row, '$.method', 'string') AS m").orderBy("place").collect()] == ["m", None, None]
    sessions = spark.createDataFrame([(None, [("final", "low"), ("difficulty_assessed", "high"), ("note", "x"), ("final", "")]), ("set", []), ("", None)], "stored string, events array<struct<type:string,target_difficulty:string>>")
    assert [r[0] for r in sessions.select(runs.display_target(F.col("stored"), F.col("events"))).collect()] == ["high", "set", None]
    evidence = spark.createDataFrame([("a", 3, "7"), ("a", 1, " 9 "), ("a", 2, "7"), ("a", 4, ""), ("a", 5, None), ("b", 1, " ")], "session string, place int, pmid string")
    assert [tuple(r) for r in runs.support_pmids(evidence).collect()] == [("a", ["9", "7"])]


def test_landing_stops_and_resumes(spark, tmp_path):
    manifest = tmp_path / "manifest.txt"
    manifest.write_text("")
    number = 0

    def land(n):
        nonlocal number
        path = tmp_path / f"f{number}.json"
        rows = [{"pmid": number * 10 + i, "title": "t", "landed_at": f"2024-01-01 00:00:{i:02}", "source_queries": ["a", "b"] if i % 2 else ["a"]} for i in range(n)]
        path.write_text("\n".join([json.dumps(r) for r in rows] + ["no json", "[1]", ""]))
        manifest.write_text(manifest.read_text() + f"{path}\n")
        number += 1

    log = landing.ProgressLog()
    spark.streams.addListener(log)

    def run():
        query = landing.observed(landing.landed(spark, str(manifest))).writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
        query.awaitTermination(120)
        assert query.exception() is None

    land(3), land(4)
    run()
    land(5)
    run()
    run()
    spark.streams.removeListener(log)
    got = spark.read.parquet(f"{tmp_path}/out")
    assert sorted(r.pmid for r in got.collect()) == [0, 1, 2, 10, 11, 12, 13, 20, 21, 22, 23, 24]  # nothing lost, nothing twice
    assert sum(b[1] for b in log.batches) == 12 and sum(b[2] for b in log.batches) == 17
    groups = spark.createDataFrame([("a", None), ("b", True), ("c", False), ("d", True)], "name string, enabled boolean")
    told = {r.group: tuple(r)[1:] for r in landing.progress(got, groups, "2024-01-01 00:00:05", 2).collect()}
    assert told == {"a": (12, 3, True), "b": (5, 2, False), "d": (0, 0, False)}
    assert {r.group: r.recent for r in landing.progress(got, groups, "2024-01-01").collect()} == {"a": None, "b": None, "d": None}


def test_fetch_window(spark):
    rows = spark.createDataFrame([(1, "2020-05-01", "2024-01-05 00:00:00"), (2, "2020-05-01", "2024-01-01 00:00:00"), (3, "1999-01-01", "2024-01-05 00:00:00"), (4, None, "2024-01-05 00:00:00"), (5, "2021-01-01", None)], "pmid int, pub_date string, landed_at string").selectExpr("pmid", "CAST(pub_date AS DATE) AS pub_date", "CAST(landed_at AS TIMESTAMP) AS landed_at")
    ids = lambda df: sorted(r.pmid for r in df.collect())
    assert ids(landing.fetch_window(rows, 2000, 2024)) == [1, 2, 5] and ids(landing.fetch_window(rows, 2000, 2024, "2024-01-06", 2)) == [1]


def test_snapshots(spark, tmp_path):
    rows = spark.createDataFrame([(f"2024-W{w:02}", b, i, float(i)) for w in range(1, 13) for b in ("x", "y") for i in range(3)], "week_id string, board string, rank_pos int, emerging_score double")
    snapshots.write_snapshots(rows, f"{tmp_path}/s")
    snapshots.write_snapshots(rows.filter("week_id = '2024-W03' AND rank_pos = 0"), f"{tmp_path}/s")
    weeks = spark.createDataFrame([("2024-W02", 1), ("2024-W03", 2), ("2024-W03", 3), ("2030-W01", 4)], "week_id string, at int").filter("at > 0")
    got = snapshots.snapshots_of(spark, f"{tmp_path}/s", weeks, "x")
    assert [(r.week_id, r.rank_pos) for r in got.collect()] == [("2024-W02", 0), ("2024-W02", 1), ("2024-W02", 2), ("2024-W03", 0)]
    assert "dynamicpruning" in got._jdf.queryExecution().executedPlan().toString().lower()
    taken = spark.createDataFrame([("a", 1), ("b", 3), ("c", 2)], "week_id string, snapshot_at int")
    assert [r.week_id for r in snapshots.recent_weeks(taken, 2).collect()] == ["b", "c"]
    assert [r.id for r in snapshots.recent_assessments(spark.createDataFrame([(1, 5), (2, 6), (3, 6)], "id int, assessed_at int"), 2).collect()] == [3, 2]


@pytest.mark.parametrize("by", [None, ["g"]])
def test_samples_do_not_depend_on_partitions(spark, by):
    rows = spark.range(500).selectExpr("id AS key", "id % 3 AS g").unionByName(spark.createDataFrame([(None, 0), (None, 1)], "key long, g long"))
    of = lambda df: sorted(tuple(r) for r in sampling.bottom_k(df, "key", 20, 5, by).collect() if r.key is not None)
    first = of(rows.repartition(1))
    assert first == of(rows.repartition(7)) and len(first) in ((19, 20) if by is None else (58, 59, 60))
    halves = sampling.bottom_k(rows.filter("key < 250 OR key IS NULL"), "key", 20, 5, by).unionByName(sampling.bottom_k(rows.filter("key >= 250"), "key", 20, 5, by))
    assert of(halves) == first and sampling.bottom_k(rows, "key", 0, 5, by).count() == 0


def test_dates_are_patched_in_one_pass(spark):
    papers = spark.createDataFrame([(1, 2020, None, None), (2, None, None, ""), (3, 2001, None, "day"), (4, None, None, None), (None, None, None, None)], "pmid long, year int, pub_date string, date_precision string")
    fetched = spark.createDataFrame([(1, "2020-05-01", 2020, "day"), (1, "2020-06-01", 2020, "day"), (2, "1999", 1999, "year"), (3, "1990", 1990, "year"), (4, "x", 1, ""), (None, "2000", 2000, "year")], "pmid long, pub_date string, year int, date_precision string")
    patched, watch = landing.with_precision(papers, fetched)
    got = {r.pmid: (r.year, r.pub_date, r.date_precision) for r in patched.collect()}
    assert got == {1: (2020, "2020-05-01", "day"), 2: (1999, "1999", "year"), 3: (2001, None, "day"), 4: (None, None, None), None: (None, None, None)}
    assert watch.get == {"pending": 3, "updated": 2, "failed": 1}
