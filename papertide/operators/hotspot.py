"""Hotspot boards over a trailing window, and their comparison with the week before."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from papertide.config import DEFAULT, EngineConfig
from papertide.functions import scoring
from papertide.operators import gap
from papertide.sources.corpus import Corpus


def week_id(day: Column) -> Column:
    return F.concat(F.extract(F.lit("YEAROFWEEK"), day).cast("string"), F.lit("-W"), F.lpad(F.weekofyear(day).cast("string"), 2, "0"))


def previous_week_id(day: Column) -> Column:
    return week_id(F.date_sub(day, 7))


def windows(papers: DataFrame, config: EngineConfig) -> DataFrame:
    """Papers dated to the day or month, marked as recent or prior. The recent window has no upper end."""
    as_of = F.lit(config.as_of)
    start, before = F.date_sub(as_of, config.window_days), F.date_sub(as_of, config.window_days + config.prior_days)
    dated = papers.filter(F.col("date_precision").isin("day", "month") & F.col("pub_date").isNotNull())
    return dated.withColumns({"recent": F.col("pub_date") >= start, "prior": (F.col("pub_date") >= before) & (F.col("pub_date") < start)})


def window_counts(corpus: Corpus, config: EngineConfig = DEFAULT) -> DataFrame:
    """Papers in the window, and those left out because their dates are too vague."""
    start = F.date_sub(F.lit(config.as_of), config.window_days)
    inside, sharp = F.col("pub_date") >= start, F.col("date_precision").isin("day", "month")
    return corpus.papers.agg(F.count_if(inside & sharp).alias("in_window"), F.count_if(inside & ~sharp).alias("low_precision"))


def emerging_entities(corpus: Corpus, kind: str, config: EngineConfig = DEFAULT) -> DataFrame:
    """Entities of one kind by how their papers of the window outnumber those before it.

    Papers outside both windows are dropped before any join: only the windows' rows are shuffled.
    """
    seen = windows(corpus.judged, config).filter("recent OR prior")
    rows = corpus.of(kind).join(seen, "pmid")
    cpy = F.floor(1000 * scoring.cite_per_year(F.col("citation_count"), F.col("year"), config.clock_year, config.end_year)).cast("long")
    counts = rows.groupBy("name").agg(
        F.count_distinct(F.when(F.col("recent"), F.col("pmid"))).alias("recent_cnt"),
        F.count_distinct(F.when(F.col("prior"), F.col("pmid"))).alias("prior_cnt"),
        F.count_if("recent").alias("n"),
        F.sum(F.when(F.col("recent"), F.col("citation_count"))).alias("cites"),
        F.sum(F.when(F.col("recent"), cpy)).alias("cpy_milli"),
        F.sum(F.when(F.col("recent"), F.coalesce("if_cents", F.lit(0)))).alias("if_cents"),
    ).filter(F.col("recent_cnt") >= config.min_recent)
    mean_cite = F.col("cites") / F.col("n")
    cpy = F.coalesce(F.nullif(F.col("cpy_milli") / F.col("n") / 1000, F.lit(0.0)), mean_cite)
    score = scoring.emerging_score(F.col("recent_cnt"), F.col("prior_cnt"), cpy, F.col("if_cents") / F.col("n") / 50000)
    velocity = F.floor((F.col("recent_cnt") - F.col("prior_cnt")) * 100 / F.greatest("prior_cnt", F.lit(1)) + 0.5).cast("long")
    return (
        counts.withColumns({"velocity_pct": velocity, "score_milli": F.floor(score * 1000 + 0.5).cast("long")})
        .orderBy(F.desc("score_milli"), "name").limit(config.hot_top_n)
        .select("name", "recent_cnt", "prior_cnt", "velocity_pct", "score_milli", "cites")
    )


def hot_combos(corpus: Corpus, config: EngineConfig = DEFAULT) -> DataFrame:
    """Method and disease pairs of the window: first the 2N with most recent papers, then the N best scores."""
    seen = windows(corpus.papers, config).filter("recent OR prior").select("pmid", "recent", "prior")
    rows = gap.pairs_of(corpus).join(seen, "pmid")
    counts = rows.groupBy("method", "disease").agg(
        F.count_distinct(F.when(F.col("recent"), F.col("pmid"))).alias("recent_cnt"), F.count_distinct(F.when(F.col("prior"), F.col("pmid"))).alias("prior_cnt"),
    ).filter("recent_cnt >= 1")
    first = counts.orderBy(F.desc("recent_cnt"), "prior_cnt", "method", "disease").limit(2 * config.hot_top_n)
    zero = F.lit(0.0)
    score = F.floor(scoring.emerging_score(F.col("recent_cnt"), F.col("prior_cnt"), zero, zero) * 1000 + 0.5).cast("long")
    scored = first.withColumns({"phase": scoring.combo_phase(F.col("recent_cnt"), F.col("prior_cnt")), "score_milli": score})
    return scored.orderBy(F.desc("score_milli"), "method", "disease").limit(config.hot_top_n)


def emerging_limitations(corpus: Corpus, config: EngineConfig = DEFAULT) -> DataFrame:
    rows = corpus.of("Limitation").join(windows(corpus.papers, config).filter("recent"), "pmid")
    counts = rows.groupBy(F.col("name").alias("limitation")).agg(F.count_distinct("pmid").alias("recent_cnt"), F.sum("citation_count").alias("cites"))
    return counts.orderBy(F.desc("recent_cnt"), "limitation").limit(config.hot_top_n)


def top_papers(corpus: Corpus, kind: str, config: EngineConfig = DEFAULT, entities: int = 5, papers: int = 3) -> DataFrame:
    """The most cited papers of the window for the first entities of a board."""
    board = emerging_entities(corpus, kind, config).orderBy(F.desc("score_milli"), "name").limit(entities).select("name")
    rows = corpus.of(kind).join(F.broadcast(board), "name", "left_semi").join(windows(corpus.papers, config).filter("recent"), "pmid")
    place = F.row_number().over(Window.partitionBy("name").orderBy(F.desc("citation_count"), F.desc("year"), "pmid"))
    return rows.select("name", "pmid", "citation_count", "year").distinct().withColumn("place", place).filter(F.col("place") <= papers).select("name", "place", "pmid", "citation_count")


def boards(corpus: Corpus, config: EngineConfig = DEFAULT) -> DataFrame:
    """All boards as snapshot rows (board, item_key, rank_pos, recent_cnt, prior_cnt, score_milli)."""
    keyed = lambda df, board, key: df.select(F.lit(board).alias("board"), key.alias("item_key"), "recent_cnt", "prior_cnt", "score_milli")
    limitations = emerging_limitations(corpus, config).withColumns({"prior_cnt": F.lit(0).cast("long"), "score_milli": F.col("recent_cnt") * 1000})
    found = keyed(emerging_entities(corpus, "Method", config), "method", F.col("name"))
    for kind in ("Disease", "Task"):
        found = found.unionByName(keyed(emerging_entities(corpus, kind, config), kind.lower(), F.col("name")))
    found = found.unionByName(keyed(hot_combos(corpus, config), "combo", F.concat_ws("|", "method", "disease"))).unionByName(keyed(limitations, "limitation", F.col("limitation")))
    rank = F.row_number().over(Window.partitionBy("board").orderBy(F.desc("score_milli"), "item_key"))
    return found.withColumn("rank_pos", rank)


def write_snapshot(board_rows: DataFrame, week: str, path: str) -> None:
    """Replace one week's partition of the snapshot table; other weeks stay as they are."""
    board_rows.withColumn("week_id", F.lit(week)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("week_id").parquet(path)


def compare_weeks(current: DataFrame, previous: DataFrame, top: int = 10, least_change: int = 3) -> DataFrame:
    """New, cooled and moved items of each board: new ones are in none of the previous board's places."""
    rank = F.coalesce(F.nullif(F.col("rank_pos"), F.lit(0)), F.lit(999))
    now = current.select("board", "item_key", rank.alias("new_rank"))
    then = previous.select("board", "item_key", rank.alias("old_rank"))
    first = now.filter(F.col("new_rank") <= top)
    new = first.join(then, ["board", "item_key"], "left_anti").select("board", "item_key", F.lit("new").alias("change"), F.lit(None).cast("int").alias("old_rank"), "new_rank")
    cooled = then.filter(F.col("old_rank") <= top).join(first, ["board", "item_key"], "left_anti").select("board", "item_key", F.lit("cooled").alias("change"), "old_rank", F.lit(None).cast("int").alias("new_rank"))
    moved = first.join(then, ["board", "item_key"]).filter(F.abs(F.col("old_rank") - F.col("new_rank")) >= least_change).select("board", "item_key", F.lit("moved").alias("change"), "old_rank", "new_rank")
    return new.unionByName(cooled).unionByName(moved)


def week_over_week(corpus: Corpus, config: EngineConfig = DEFAULT) -> DataFrame:
    """The boards of the week of as_of against those of the week before, both computed from the corpus."""
    from dataclasses import replace
    from datetime import timedelta

    chosen = ["method", "disease", "combo"]
    now = boards(corpus, config).filter(F.col("board").isin(chosen))
    earlier = replace(config, as_of=config.as_of - timedelta(days=7))
    return compare_weeks(now, boards(corpus, earlier).filter(F.col("board").isin(chosen)))


def emerging_gap_opportunities(corpus: Corpus, focus: str | None = None, config: EngineConfig = DEFAULT) -> DataFrame:
    """Hot pairs that the literature hardly covers, and scarce cells of hot methods or diseases.

    The focus chooses the gap grid; the boards of hot pairs, methods and diseases are those of all papers.
    """
    gaps = gap.method_disease_combo_gap(corpus, focus, config).select("method", "disease", "gap", F.col("paper_cnt").alias("papers"))
    combos = hot_combos(corpus, config).join(F.broadcast(gaps), ["method", "disease"], "left")
    hot = combos.select(
        "method", "disease", F.coalesce("gap", F.lit("active")).alias("literature_gap"), F.coalesce("papers", "recent_cnt").alias("paper_cnt"),
        "phase", "recent_cnt", "score_milli", F.lit(0).alias("branch"),
    ).filter((F.col("literature_gap") != "active") | F.col("phase").isin("heating", "nascent"))
    methods = emerging_entities(corpus, "Method", config).select(F.col("name").alias("method"), F.lit(True).alias("m"))
    diseases = emerging_entities(corpus, "Disease", config).select(F.col("name").alias("disease"), F.lit(True).alias("d"))
    near = gaps.join(F.broadcast(methods), "method", "left").join(F.broadcast(diseases), "disease", "left").filter("m OR d")
    scarce = near.select("method", "disease", F.col("gap").alias("literature_gap"), F.col("papers").alias("paper_cnt"), F.lit("nascent").alias("phase"), F.lit(0).cast("long").alias("recent_cnt"), F.lit(0).cast("long").alias("score_milli"), F.lit(1).alias("branch"))
    once = F.row_number().over(Window.partitionBy("method", "disease").orderBy("branch"))
    every = hot.unionByName(scarce).withColumn("nth", once).filter("nth = 1")
    points = scoring.literature_gap_points(F.col("literature_gap"))
    return (
        every.withColumn("opportunity_milli", F.col("score_milli") + 1000 * points)
        .orderBy(F.desc("opportunity_milli"), "method", "disease").limit(min(20, config.hot_top_n))
        .select("method", "disease", "literature_gap", "paper_cnt", "phase", "recent_cnt", "opportunity_milli")
    )
