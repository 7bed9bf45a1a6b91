"""What Markdown reports of gaps say: their titles, sections and questions, and which known gap a title means."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from papertide.operators.documents import fingerprint, fingerprint_tokens, jaccard
from papertide.operators.strings import overlapping

#: Headings, numbered lines and labels of reports; fixed formats.
GAP = r"(?:研究空白|Research\s+Gap|Gap|候选空白)"
HEADING = rf"(?i)###\s*{GAP}\s*\d+\s*[：:]\s*([^\n]+)"
BOLD_LINE = r"\*+\d+[.、]\s*([^\n]+?)\*+"
ANY_HEADING = rf"(?i)(?:###\s*)?{GAP}\s*\d+"
NUMBERED_LINE = r"(?m)^\s*(?:\d+[.)、]|\*\*\d+[.)、])\s*([^\n]+)"
BULLET = r"(?m)^[-*]\s+[^\n]{10,}"
QUESTION = (r"(?i)\*\*Research question\*\*[：:]\s*([^\n]+)", r"\*\*研究问题\*\*[：:]\s*([^\n]+)")
DISEASE = r"(?s)\*\*研究问题\*\*[：:]\s*(.+?)(?:\n|\*\*)"


def found(text: Column, pattern: str, group: int = 1) -> Column:
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(pattern), F.lit(group))


def bare(title: Column) -> Column:
    return F.trim(F.regexp_replace(F.trim(title), r"\*+$", ""))


def gap_titles(report: Column) -> Column:
    """Titles of a report's gap headings, each once, in order; where there are none, its bold numbered lines of 6
    to 119 characters. Null reports: none."""
    headed = F.array_distinct(F.filter(F.transform(found(report, HEADING), bare), lambda t: t != ""))
    bold = F.filter(F.transform(found(report, BOLD_LINE), F.trim), lambda t: (F.length(t) > 5) & (F.length(t) < 120))
    return F.when(F.size(headed) > 0, headed).otherwise(bold)


def research_question(section: Column) -> Column:
    """The labelled question of a section, its first 500 characters; empty if there is none."""
    first = lambda pattern: F.nullif(F.trim(F.regexp_extract(F.coalesce(section, F.lit("")), pattern, 1)), F.lit(""))
    return F.substring(F.coalesce(*map(first, QUESTION), F.lit("")), 1, 500)


def disease_hint(section: Column) -> Column:
    """What a section says of its disease: the first 200 characters of its question, else of itself; null if empty."""
    asked = F.nullif(F.trim(F.regexp_extract(F.coalesce(section, F.lit("")), DISEASE, 1)), F.lit(""))
    return F.substring(F.coalesce(asked, F.nullif(section, F.lit(""))), 1, 200)


def candidate_count(content: Column) -> Column:
    """Gaps that a proposal lists: its gap headings, else its numbered lines of 6 to 199 characters, else its
    bullets; 0 for blanks and nulls."""
    lines = F.filter(F.transform(found(content, NUMBERED_LINE), F.trim), lambda t: (F.length(t) > 5) & (F.length(t) < 200))
    sizes = [F.size(found(content, ANY_HEADING, 0)), F.size(lines), F.size(found(content, BULLET, 0))]
    return F.coalesce(*[F.nullif(n, F.lit(0)) for n in sizes], F.lit(0))


def gap_items(reports: DataFrame, key: str, text: str, most: int | None = None) -> DataFrame:
    """(key, rank_pos, title, research_question, fingerprint, section_md) of reports.

    A section goes from its heading to the next; without headings, the titles of bold lines stand for
    themselves. most: the characters kept of a section (None: all).
    """
    headings = rf"(?i)\n(?=###\s*{GAP}\s*\d+\s*[：:])"
    parts = F.filter(F.split(F.concat(F.lit("\n"), F.coalesce(F.col(text), F.lit(""))), headings), lambda p: p.rlike(rf"^{HEADING}"))
    headed = F.transform(parts, lambda p: F.struct(bare(F.regexp_extract(p, HEADING, 1)).alias("title"), F.trim(p).alias("body")))
    lines = F.transform(gap_titles(F.col(text)), lambda t: F.struct(t.alias("title"), t.alias("body")))
    rows = reports.select(key, F.posexplode(F.when(F.size(headed) > 0, headed).otherwise(lines)).alias("at", "x"))
    body = F.col("x.body") if most is None else F.substring("x.body", 1, most)
    return rows.select(key, (F.col("at") + 1).alias("rank_pos"), "x.title", research_question(F.col("x.body")).alias("research_question"), fingerprint(F.col("x.title")).alias("fingerprint"), body.alias("section_md"))


def resolved_items(titles: DataFrame, items: DataFrame, run: str = "run_id", least: float = 0.55) -> DataFrame:
    """titles (run, title) with the item of their run that each means, null where none does.

    The same title without case and outer blanks wins, then the largest overlap of words of at least `least`,
    ties to the smaller item_id. Titles and items of a run meet by their rarest words. Blank titles mean nothing.
    """
    asked = titles.select(run, "title").distinct().withColumns({"_low": F.lower(F.trim("title")), "_a": fingerprint_tokens(F.col("title"))}).filter("_low <> ''")
    known = items.select(run, "item_id", F.lower(F.trim(F.coalesce("title", F.lit("")))).alias("_other"), fingerprint_tokens(F.coalesce("title", F.lit(""))).alias("_b"))
    same = asked.join(known.withColumnRenamed("_other", "_low").drop("_b"), [run, "_low"]).select(run, "title", "item_id", F.lit(2.0).alias("score"))
    near = overlapping(asked.select(run, "title", F.col("_a").alias("a")), known.select(run, "item_id", F.col("_b").alias("b")).distinct(), int(least * 100), (run,))
    scored = near.select(run, "title", "item_id", jaccard(F.col("a"), F.col("b")).alias("score")).filter(F.col("score") >= least)
    best = same.unionByName(scored).groupBy(run, "title").agg(F.max_by("item_id", F.struct("score", -F.col("item_id"))).alias("item_id"))
    return titles.join(best, [run, "title"], "left")


def recent_runs(runs: DataFrame, n: int) -> DataFrame:
    """The n last finished runs (run_id, focus_key, finished_at) of each focus, later ones of the same time by run_id."""
    place = F.row_number().over(Window.partitionBy("focus_key").orderBy(F.desc("finished_at"), F.desc("run_id")))
    return runs.filter("finished_at IS NOT NULL").withColumn("place", place).filter(F.col("place") <= n)


def recent_orders(spark, sf_dir: str) -> DataFrame:
    """Orders that aren't open as finished runs, their priority the focus."""
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    runs = o.select(F.col("o_orderkey").alias("run_id"), F.col("o_orderpriority").alias("focus_key"), F.when(F.col("o_orderstatus") != "O", F.to_date("o_orderdate")).alias("finished_at"))
    return recent_runs(runs, 5).select("run_id", "focus_key", "place")


def reports_of_conversations(spark, sf_dir: str) -> DataFrame:
    """Conversations as reports, a gap each turn: the role and turn its title, the text its body."""
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    part = F.concat(F.lit("### Gap "), F.col("turn").cast("string"), F.lit(": "), F.col("role"), F.lit(" of "), F.col("turn").cast("string"), F.lit("**\n- **Research question**: "), F.coalesce("text", F.lit("")))
    per = turns.filter("conv_id IS NOT NULL").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", part.alias("part")))).alias("p"))
    return per.select("conv_id", F.array_join(F.transform("p", lambda x: x["part"]), "\n").alias("report"))


def gap_items_of_conversations(spark, sf_dir: str) -> DataFrame:
    reports = reports_of_conversations(spark, sf_dir)
    items = gap_items(reports, "conv_id", "report")
    return items.select("conv_id", F.col("rank_pos").cast("long").alias("rank_pos"), "title", "research_question", "fingerprint", F.length("section_md").cast("long").alias("chars"))
