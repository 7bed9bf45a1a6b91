"""Runs and their life cycle, proposals that lack what they should have, and the latest results of tools."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from papertide.operators.reports import resolved_items

#: What an event of a run can say; the paths keep what they have where an event says nothing.
PATHS = ("gap_report_path", "hotspot_week_id", "proposal_report_path")
EVENTS = "run_id long, at timestamp, seq long, kind string, week_id string, focus_raw string, focus_key string, source string, gap_report_path string, hotspot_week_id string, proposal_report_path string"
STATES = "run_id long, week_id string, focus_raw string, focus_key string, source string, started_at timestamp, finished_at timestamp, gap_report_path string, hotspot_week_id string, proposal_report_path string"
#: Lines of a proposal that may hold its title, and characters of one that are kept when its text has a file.
TITLE_LINES, SECTION = 5, 8192
#: Where a tool's result may list its records; the first list counts. Fixed values.
RECORDS = ("data", "gaps", "results_backed", "all_metrics")


def run_states(events: DataFrame) -> DataFrame:
    """The runs that their events (EVENTS) leave, by (at, seq), whatever order they come in.

    insert begins a run; finalize ends it and fills the paths that it tells; proposal fills its path;
    hotspot sets its week, also to nothing. Events before their run's insert, or of a run without one,
    change nothing; of several inserts the first counts. A run that finalizes again ends again.
    """
    order = F.struct("at", "seq")
    begun = events.filter("kind = 'insert' AND run_id IS NOT NULL").groupBy("run_id").agg(F.min_by(F.struct("week_id", "focus_raw", "focus_key", "source", F.col("at").alias("started_at"), order.alias("_begin")), order).alias("_i")).select("run_id", "_i.*")
    later = events.select("run_id", order.alias("_o"), "kind", "at", *[F.nullif(F.col(p), F.lit("")).alias(p) for p in PATHS], F.col("hotspot_week_id").alias("_set"))
    rows = begun.join(later, "run_id", "left").filter("_o IS NULL OR _o >= _begin")
    tells = {"gap_report_path": F.col("kind") == "finalize", "proposal_report_path": F.col("kind").isin("finalize", "proposal"), "hotspot_week_id": F.col("kind") == "finalize"}
    last = lambda p: F.max_by(p, F.when(tells[p] & F.col(p).isNotNull(), F.col("_o"))).alias(p)
    week = F.when(F.col("kind") == "hotspot", F.struct("_o", F.col("_set").alias("week"))).when((F.col("kind") == "finalize") & F.col("hotspot_week_id").isNotNull(), F.struct("_o", F.col("hotspot_week_id").alias("week")))
    keep = ["week_id", "focus_raw", "focus_key", "source", "started_at"]
    return rows.groupBy("run_id", *keep).agg(F.max(F.when(F.col("kind") == "finalize", F.col("at"))).alias("finished_at"), last("gap_report_path"), F.max(week)["week"].alias("hotspot_week_id"), last("proposal_report_path")).select("run_id", *keep, "finished_at", *PATHS)


def latest_of_week(runs: DataFrame) -> DataFrame:
    """(week_id, focus_key, run_id): the run that ended, or else began, last for each week and focus; larger ids of equals."""
    return runs.groupBy("week_id", "focus_key").agg(F.max(F.struct(F.coalesce("finished_at", "started_at").alias("at"), "run_id"))["run_id"].alias("run_id"))


def backfilled(proposals: DataFrame, items: DataFrame, stamp: str) -> DataFrame:
    """proposals (id, run_id, proposal_md, gap_item_id, proposal_path, status) with what they lack, and `filled`, what
    was: the gap item of their run that the first heading of their first lines names (as it is, else by overlap), the
    status generated, and a path for their text, which is then cut to SECTION characters."""
    filled = lambda c: F.nullif(F.col(c).cast("string"), F.lit(""))
    has_text = filled("proposal_md").isNotNull()
    lines = F.slice(F.split(F.coalesce("proposal_md", F.lit("")), r"\r\n|\n|\r"), 1, TITLE_LINES)
    heading = F.try_element_at(F.filter(lines, lambda x: F.startswith(x, F.lit("# "))), F.lit(1))
    rows = proposals.withColumn("_title", F.when(F.coalesce("gap_item_id", F.lit(0)) == 0, F.nullif(F.trim(F.substring(heading, 3, 1 << 20)), F.lit(""))))
    linked = resolved_items(rows.filter("_title IS NOT NULL").select("run_id", F.col("_title").alias("title")).distinct(), items)
    linked = linked.select("run_id", F.col("title").alias("_title"), F.col("item_id").alias("_item"))
    rows = rows.join(linked, ["run_id", "_title"], "left")
    no_path = filled("proposal_path").isNull() & has_text
    path = F.concat(F.lit("ops_proposal_"), F.col("run_id").cast("string"), F.lit(f"_backfill_{stamp}.md"))
    told = F.array_compact(F.array(F.when(F.col("_item").isNotNull(), "gap_item_id"), F.when(filled("status").isNull(), "status"), F.when(no_path, "proposal_path"), F.when(no_path & (F.length("proposal_md") > SECTION), "proposal_md")))
    new = {"gap_item_id": F.coalesce("_item", "gap_item_id"), "status": F.coalesce(filled("status"), F.lit("generated")), "proposal_path": F.when(no_path, path).otherwise(F.col("proposal_path")), "proposal_md": F.when(no_path, F.substring("proposal_md", 1, SECTION)).otherwise(F.col("proposal_md")), "filled": told}
    return rows.withColumns(new).select(*proposals.columns, "filled")


def latest_results(events: DataFrame) -> DataFrame:
    """(session, name, seq, result, records): of events (session, seq, type, name, result as JSON) the last result of each
    tool, as VARIANT, and how many records it lists: those of the first list among its known fields, 0 without one."""
    last = events.filter("type = 'tool_result'").groupBy("session", "name").agg(F.max_by(F.struct("seq", "result"), "seq").alias("_l")).select("session", "name", "_l.*")
    parsed = F.try_parse_json("result")
    lists = [F.size(F.try_variant_get("_v", f"$.{field}", "array<variant>")) for field in RECORDS]
    count = F.coalesce(*[F.when(size >= 0, size) for size in lists], F.lit(0))
    return last.withColumn("_v", parsed).select("session", "name", "seq", F.col("_v").alias("result"), count.alias("records"))


def rows_of(results: DataFrame, tool: str, field: str) -> DataFrame:
    """(session, place, row): the records that a tool's latest result lists in a field, one a row, as VARIANT."""
    listed = results.filter(F.col("name") == tool).select("session", F.try_variant_get("result", f"$.{field}", "array<variant>").alias("_rows"))
    return listed.select("session", F.posexplode("_rows").alias("place", "row"))


def display_target(stored: Column, events: Column) -> Column:
    """The target that a session stored, or else that of its last assessing event that tells one; events is an array of
    (type, target_difficulty)."""
    telling = F.filter(events, lambda e: e["type"].isin("difficulty_assessed", "final") & (e["target_difficulty"] != ""))
    return F.coalesce(F.nullif(stored, F.lit("")), F.try_element_at(telling, F.lit(-1))["target_difficulty"])


def support_pmids(evidence: DataFrame) -> DataFrame:
    """(session, pmids): the distinct pmids of evidence rows (session, place, pmid), without blanks, in the order in which
    they first come."""
    trimmed = F.trim(F.col("pmid").cast("string"))
    first = evidence.select("session", "place", trimmed.alias("pmid")).filter("pmid <> ''").groupBy("session", "pmid").agg(F.min("place").alias("place"))
    return first.groupBy("session").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "pmid"))), lambda x: x["pmid"]).alias("pmids"))


# Orders play runs: each says what happened to it in a few events. --------------------------------------


def events_of_orders(spark, sf_dir: str) -> DataFrame:
    """Order lines as events of their order's run: the first begins it, the others fill paths by their flags."""
    t = lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet")
    rows = t("lineitem").join(t("orders"), F.expr("l_orderkey = o_orderkey"))
    kind = F.expr("CASE WHEN l_linenumber = 2 THEN 'insert' WHEN l_returnflag = 'R' THEN 'finalize' WHEN l_returnflag = 'A' THEN 'hotspot' ELSE 'proposal' END")
    return rows.select(
        F.col("l_orderkey").alias("run_id"), F.col("l_shipdate").cast("timestamp").alias("at"), F.expr("l_partkey * 1000000 + CAST(l_extendedprice AS BIGINT) * 10 + l_linenumber").cast("long").alias("seq"), kind.alias("kind"), F.date_format("o_orderdate", "yyyy-MM").alias("week_id"), F.lit(None).cast("string").alias("focus_raw"), F.col("o_orderpriority").alias("focus_key"), F.col("o_orderstatus").alias("source"),
        F.expr("IF(l_suppkey % 3 = 0, '', concat('g', l_suppkey))").alias("gap_report_path"), F.expr("IF(l_suppkey % 4 = 0, NULL, concat('w', l_suppkey))").alias("hotspot_week_id"), F.expr("IF(l_suppkey % 5 = 0, '', concat('p', l_suppkey))").alias("proposal_report_path"),
    )


def runs_of_orders(spark, sf_dir: str) -> DataFrame:
    runs = run_states(events_of_orders(spark, sf_dir))
    return runs.select("run_id", "week_id", "focus_key", "source", *[F.date_format(c, "yyyy-MM-dd").alias(c) for c in ("started_at", "finished_at")], *PATHS)


def weeks_of_orders(spark, sf_dir: str) -> DataFrame:
    return latest_of_week(run_states(events_of_orders(spark, sf_dir)))


def results_of_events(spark, sf_dir: str) -> DataFrame:
    """Events of users as results of tools (their type), whose JSON lists as many records as its number says."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    listed = F.to_json(F.struct(F.when(F.col("value") > 5, F.sequence(F.lit(1), (F.floor("value") % 7 + 1).cast("int"))).alias("gaps"), F.col("value").alias("data"), "event_id"))
    rows = events.select(F.col("user_id").alias("session"), F.col("event_id").alias("seq"), F.expr("IF(event_id % 4 = 0, 'note', 'tool_result')").alias("type"), F.col("event_type").alias("name"), listed.alias("result"))
    return latest_results(rows).select("session", "name", "seq", "records", F.try_variant_get("result", "$.event_id", "long").alias("told"))


def support_of_events(spark, sf_dir: str) -> DataFrame:
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    rows = events.select((F.col("user_id") % 50).alias("session"), F.col("event_id").alias("place"), F.concat(F.lit(" "), F.expr("IF(value < 1, '', CAST(CAST(value AS INT) % 40 AS STRING))")).alias("pmid"))
    return support_pmids(rows).select("session", F.array_join("pmids", ",").alias("pmids"))
