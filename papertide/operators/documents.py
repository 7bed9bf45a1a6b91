"""Text and event transforms: sections, fingerprints, overlaps and turn statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from papertide.operators.strings import overlapping

#: Section types of structured articles by the first word that a section's type or title holds; fixed values.
SECTION_WORDS = (
    ("introduction", ("introduction", "background", "overview")),
    ("methods", ("method", "material", "patient", "study design", "experimental")),
    ("results", ("result", "finding", "outcome")),
    ("discussion", ("discussion", "interpretation")),
    ("limitations", ("limitation", "weakness", "shortcoming")),
    ("future_work", ("future work", "future direction", "perspective", "conclusion")),
)
#: Section types of Markdown headings by the first pattern found; fixed values.
HEADING_PATTERNS = (
    ("abstract", r"abstract"),
    ("introduction", r"introduction|background"),
    ("methods", r"methods|materials?\s+and\s+methods|methodology"),
    ("results", r"results|findings"),
    ("discussion", r"discussion"),
    ("limitations", r"limitations?"),
    ("future_work", r"conclusions?|future\s+work|future\s+directions?"),
)


def section_type(title: Column, sec_type: Column | None = None) -> Column:
    """The class of an article's section by its declared type (if any) and title."""
    filled = lambda c: F.coalesce(c, F.lit(""))
    low, out = F.lower(filled(title) if sec_type is None else F.concat_ws(" ", filled(sec_type), filled(title))), F.lit("other")
    for name, words in reversed(SECTION_WORDS):
        holds = F.lit(False)
        for word in words:
            holds = holds | F.contains(low, F.lit(word))
        out = F.when(holds, name).otherwise(out)
    return out


def heading_type(title: Column) -> Column:
    """The class of a Markdown heading."""
    low, out = F.lower(F.coalesce(title, F.lit(""))), F.lit("other")
    for name, pattern in reversed(HEADING_PATTERNS):
        out = F.when(low.rlike(pattern), name).otherwise(out)
    return out


def clean_markdown(text: Column) -> Column:
    """With a blank for each image, links unwrapped, white space of any kind collapsed."""
    bare = F.regexp_replace(F.regexp_replace(text, r"!\[[^\]]*\]\([^)]+\)", " "), r"\[([^\]]+)\]\([^)]+\)", "$1")
    return F.trim(F.regexp_replace(bare, r"(?U)\s+", " "))


#: A heading of one to three signs: white space of any kind, its title, and the white space behind it.
HEADING = r"(?mdU)^#{1,3}\s+(.+?)\s*$"
#: What stands before and behind a title while a text is split; in texts they are blanks.
BEFORE, BEHIND = "\ue000", "\ue001"


def markdown_sections(docs: DataFrame, key: str, text: str, least: int = 120, most: int | None = None, whole: int | None = None) -> DataFrame:
    """(key, order_idx, title, section_type, content) of Markdown texts, split at # to ### headings.

    What stands before the first heading is `other` and called Preamble; short sections go, and those that
    stay are counted from 0; a text without any section left is one section by itself, Full document.
    Nothing is cut unless lengths are stated: most for sections, whole for such texts.
    """
    upto = lambda content, n: content if n is None else F.substring(content, 1, n)
    marked = F.regexp_replace(F.translate(F.col(text), BEFORE + BEHIND, "  "), HEADING, f"{BEFORE}$1{BEHIND}")
    section = lambda i, title, content: F.struct(i.alias("order_idx"), title.alias("title"), content.alias("content"))
    pieces = F.split(marked, BEFORE)
    title = lambda p, i: F.when(i == 0, "Preamble").otherwise(F.substring_index(p, BEHIND, 1))
    parts = F.transform(pieces, lambda p, i: section(i, F.trim(title(p, i)), clean_markdown(F.substring_index(p, BEHIND, -1))))
    long = F.filter(parts, lambda s: F.length(s["content"]) >= least)
    rest = F.array(section(F.lit(0), F.lit("Full document"), upto(clean_markdown(F.col(text)), whole)))
    rows = docs.select(key, text, long.alias("_s"))
    kept = F.transform("_s", lambda s, i: section(i, s["title"], upto(s["content"], most)))
    named = F.col("title").isin("Preamble", "Full document")
    out = rows.select(key, F.explode(F.when(F.size("_s") > 0, kept).otherwise(rest)).alias("x")).select(key, "x.*")
    return out.withColumn("section_type", F.when(named, "other").otherwise(heading_type(F.col("title"))))


def truncated(text: Column, most: int) -> Column:
    """The text, or so many of its characters and a mark that more follow; none or fewer than none is no limit."""
    return text if most <= 0 else F.when(F.length(text) > most, F.concat(F.substring(text, 1, most), F.lit("\n... [truncated]"))).otherwise(text)


def merge_sections(sections: DataFrame, key: str) -> DataFrame:
    """One row for each key and section type: contents in order, joined by blank lines, the first title that isn't empty."""
    filled = sections.filter(F.trim("content") != "")
    grouped = filled.groupBy(key, "section_type").agg(F.array_sort(F.collect_list(F.struct("order_idx", "title", "content"))).alias("s"))
    titles = F.filter(F.transform("s", lambda x: x["title"]), lambda t: t != "")
    return grouped.select(key, "section_type", F.array_join(F.transform("s", lambda x: x["content"]), "\n\n").alias("content"), F.coalesce(F.get(titles, F.lit(0)), F.lit("")).alias("title"), F.get("s", F.lit(0))["order_idx"].alias("first_idx"))


def other_as_discussion(sections: DataFrame, key: str, least: int = 1500) -> DataFrame:
    """The merged `other` sections of each key as its discussion, where they have `least` characters or more."""
    long = merge_sections(sections.filter("section_type = 'other'"), key).filter(F.length(F.trim("content")) >= least)
    title = F.coalesce(F.nullif("title", F.lit("")), F.lit("discussion (from other)"))
    return long.select(key, F.lit("discussion").alias("section_type"), title.alias("title"), "content")


def fingerprint_tokens(text: Column) -> Column:
    return F.array_sort(F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(r"([a-z0-9\x{4e00}-\x{9fff}]+)"), F.lit(1))))


def fingerprint(text: Column) -> Column:
    return F.substring(F.sha1(F.array_join(fingerprint_tokens(text), " ")), 1, 16)


def jaccard(a: Column, b: Column) -> Column:
    """Overlap of two token arrays: 1 if both are empty, 0 if one is."""
    return F.when((F.size(a) == 0) & (F.size(b) == 0), 1.0).when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b)))


def revisited(titles: DataFrame, memory: DataFrame, threshold: float = 0.55) -> DataFrame:
    """titles (title) with whether any title of memory overlaps; they meet by their rarest tokens, never all with all."""
    t = titles.select("title").distinct().withColumn("a", fingerprint_tokens(F.col("title")))
    m = memory.select(F.col("title").alias("old")).distinct().withColumn("b", fingerprint_tokens(F.col("old")))
    hits = overlapping(t, m, int(threshold * 100)).filter(jaccard(F.col("a"), F.col("b")) >= threshold).select("title").distinct().withColumn("revisited", F.lit(True))
    return titles.join(hits, "title", "left").withColumn("revisited", F.coalesce("revisited", F.lit(False)))


def html_blocks(pages: DataFrame) -> DataFrame:
    """(page_id, order_idx, tag, content): headings, paragraphs and list items of a page in order."""
    body = F.regexp_replace(F.regexp_replace("html", r"(?s)<(script|style)[^>]*>.*?</\1>", ""), r"(?s)<!--.*?-->", "")
    pattern = F.lit(r"(?s)<(h[1-6]|p|li)(?:\s[^>]*)?>(.*?)</\1>")
    found = pages.select("page_id", F.posexplode(F.arrays_zip(F.regexp_extract_all(body, pattern, F.lit(1)).alias("tag"), F.regexp_extract_all(body, pattern, F.lit(2)).alias("raw"))).alias("order_idx", "x"))
    text = F.trim(F.regexp_replace(F.regexp_replace("x.raw", r"<[^>]*>", " "), r"\s+", " "))
    return found.select("page_id", "order_idx", F.col("x.tag").alias("tag"), text.alias("content")).filter("content <> ''")


def agent_event_counts(events: DataFrame, key: str) -> DataFrame:
    """For each conversation: turns by role, the last assistant turn and the longest text."""
    return events.groupBy(key).agg(
        F.count_if(F.col("role") == "user").alias("user_turns"), F.count_if(F.col("role") == "assistant").alias("assistant_turns"),
        F.max(F.when(F.col("role") == "assistant", F.col("turn"))).alias("last_assistant"), F.max(F.length("text")).alias("longest"),
    )


def read(spark, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sections_of_documents(spark, sf_dir: str) -> DataFrame:
    """Lines of every document as sections: their type, number and size by language."""
    lines = read(spark, sf_dir, "documents").select("doc_id", "lang", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("order_idx", "content"))
    typed = lines.filter(F.trim("content") != "").withColumn("section_type", section_type(F.col("content")))
    return typed.groupBy("lang", "section_type").agg(F.count(F.lit(1)).alias("sections"), F.count_distinct("doc_id").alias("documents"), F.sum(F.length("content")).alias("chars"))


def markdown_sections_of_documents(spark, sf_dir: str) -> DataFrame:
    """Every document as Markdown: its sections in full."""
    return markdown_sections(read(spark, sf_dir, "documents"), "doc_id", "text")


def merged_sections(spark, sf_dir: str) -> DataFrame:
    """Conversation turns as sections, merged by role."""
    turns = read(spark, sf_dir, "conversations").select("conv_id", F.col("role").alias("section_type"), F.col("turn").cast("int").alias("order_idx"), F.lit("").alias("title"), F.coalesce("text", F.lit("")).alias("content"))
    merged = merge_sections(turns, "conv_id")
    return merged.select("conv_id", "section_type", F.length("content").cast("long").alias("chars"), F.sha1("content").alias("content_sha1"), F.col("first_idx").cast("long").alias("first_idx"))


def user_turns_as_discussion(spark, sf_dir: str) -> DataFrame:
    """User turns as sections without a class of their own, by conversation."""
    turns = read(spark, sf_dir, "conversations").filter("role = 'user' AND conv_id IS NOT NULL")
    sections = turns.select("conv_id", F.lit("other").alias("section_type"), F.col("turn").cast("int").alias("order_idx"), F.lit("").alias("title"), F.coalesce("text", F.lit("")).alias("content"))
    return other_as_discussion(sections, "conv_id", 200).select("conv_id", "section_type", "title", F.length("content").cast("long").alias("chars"))


def benchmark_fingerprints(spark, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "benchmark").select("item_id", fingerprint(F.col("text")).alias("fingerprint"))


def title_overlap(spark, sf_dir: str) -> DataFrame:
    """Parts' names and types as titles: overlapping distinct pairs, by their shared tokens."""
    titles = read(spark, sf_dir, "part").select(F.lower(F.concat_ws(" ", "p_name", "p_type")).alias("title")).distinct()
    t = titles.withColumn("a", fingerprint_tokens(F.col("title")))
    other = t.select(F.col("title").alias("other"), F.col("a").alias("b"))
    near = overlapping(t, other, 50).filter("title < other")
    shared = F.size(F.array_intersect("a", "b"))
    return near.filter(shared * 100 >= 50 * F.size(F.array_union("a", "b"))).select("title", "other", shared.cast("long").alias("shared"))


def turn_funnel(spark, sf_dir: str) -> DataFrame:
    counts = agent_event_counts(read(spark, sf_dir, "conversations"), "conv_id")
    return counts.groupBy("user_turns", "assistant_turns").agg(F.count(F.lit(1)).alias("conversations"), F.max("longest").cast("long").alias("longest"))


def latest_assistant(spark, sf_dir: str) -> DataFrame:
    """The last assistant text of every conversation, by its size."""
    turns = read(spark, sf_dir, "conversations").filter("role = 'assistant'")
    last = turns.groupBy("conv_id").agg(F.max(F.struct("turn", "text")).alias("last"))
    return last.select("conv_id", F.col("last.turn").alias("turn"), F.length("last.text").cast("long").alias("chars"))


def page_sections(spark, sf_dir: str) -> DataFrame:
    blocks = html_blocks(read(spark, sf_dir, "pages"))
    return blocks.groupBy("page_id").agg(
        F.count_if(F.col("tag").startswith("h")).alias("headings"), F.count_if(F.col("tag") == "p").alias("paragraphs"), F.count_if(F.col("tag") == "li").alias("items"),
        F.sum(F.length("content")).cast("long").alias("chars"), F.first("page_id").alias("_p"),
    ).drop("_p")


def event_windows(spark, sf_dir: str) -> DataFrame:
    """Events of each type in the last 14 days and the 14 before them, up to 2024-01-31."""
    day = F.to_date("ts")
    start, before = F.date_sub(F.lit("2024-01-31").cast("date"), 14), F.date_sub(F.lit("2024-01-31").cast("date"), 28)
    counts = read(spark, sf_dir, "events").groupBy("event_type").agg(
        F.count_if(day >= start).alias("recent_cnt"), F.count_if((day >= before) & (day < start)).alias("prior_cnt"), F.count_distinct(F.when(day >= start, F.col("user_id"))).alias("recent_users"),
    )
    place = F.row_number().over(Window.orderBy(F.desc("recent_cnt"), "event_type"))  # a row for each event type
    return counts.withColumn("rank_pos", place)
