"""Papers as they land: a source that remembers which files it has read, a window on their dates, and progress by group."""

from __future__ import annotations

import json
from collections.abc import Iterator

from pyarrow import fs
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.streaming import StreamingQueryListener

PAPERS = "pmid long, title string, landed_at timestamp, source_queries string"


class LandedFile(InputPartition):
    def __init__(self, number: int, path: str):
        self.number, self.path = number, path


def read_text(path: str) -> str:
    """A file of any store that has a URI here; a plain path is local."""
    store, place = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)
    with store.open_input_stream(place) as file:
        return file.read().decode()


class LandedReader(DataSourceStreamReader):
    """Offsets count the files of a manifest, one path a line, which only ever grows; a batch is the lines that are new.

    Files hold a JSON object a line. Lines that are no objects are skipped, as Spark's readers do.
    """

    def __init__(self, schema, options: dict):
        self.schema, self.manifest = schema, options["manifest"]

    def lines(self) -> list[str]:
        return [line for line in read_text(self.manifest).splitlines() if line]

    def initialOffset(self) -> dict:
        return {"files": 0}

    def latestOffset(self) -> dict:
        return {"files": len(self.lines())}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        wanted = self.lines()[start["files"] : end["files"]]
        return [LandedFile(start["files"] + i, path) for i, path in enumerate(wanted)]

    def read(self, partition: LandedFile) -> Iterator[tuple]:
        for line in read_text(partition.path).splitlines():
            try:
                row = json.loads(line)
            except ValueError:
                continue
            if isinstance(row, dict):
                cells = [row.get(name) for name in self.schema.fieldNames()]
                yield tuple(c if c is None or isinstance(c, str) else json.dumps(c) for c in cells)

    def commit(self, end: dict) -> None:
        pass


class LandedPapers(DataSource):
    """format("landed_papers"), option("manifest", path): the lines of landed files as strings by name."""

    @classmethod
    def name(cls) -> str:
        return "landed_papers"

    def schema(self) -> str:
        return "pmid string, title string, landed_at string, source_queries string"

    def streamReader(self, schema) -> LandedReader:
        return LandedReader(schema, self.options)


def landed(spark: SparkSession, manifest: str) -> DataFrame:
    """The stream of landed papers (PAPERS)."""
    spark.dataSource.register(LandedPapers)
    raw = spark.readStream.format("landed_papers").option("manifest", manifest).load()
    return raw.select(F.expr("try_cast(pmid AS BIGINT)").alias("pmid"), "title", F.expr("try_cast(landed_at AS TIMESTAMP)").alias("landed_at"), "source_queries")


def fetch_window(papers: DataFrame, first_year: int, last_year: int, as_of: str | None = None, days: int = 0) -> DataFrame:
    """Papers (pub_date, landed_at) of the years, and, where days are asked for, landed within so many before as_of."""
    rows = papers.filter(F.year("pub_date").between(first_year, last_year))
    since = F.to_timestamp(F.lit(as_of)) - F.expr(f"INTERVAL {int(days)} DAYS") if as_of and days > 0 else None
    return rows if since is None else rows.filter((F.col("landed_at") > since) & (F.col("landed_at") <= F.to_timestamp(F.lit(as_of))))


def groups_of(papers: DataFrame) -> DataFrame:
    """Papers once for each group that found them, from a JSON list; none where it is no list."""
    return papers.withColumn("group", F.explode(F.from_json("source_queries", "array<string>")))


def progress(papers: DataFrame, groups: DataFrame, as_of: str, seconds: int | None = None) -> DataFrame:
    """(group, papers, recent, active): for each enabled group how many papers it found, how many of them in the last
    seconds before as_of, and whether no group found more of those.

    groups (name, enabled): null counts as enabled. recent is null where no window is asked for.
    """
    enabled = groups.filter(F.coalesce("enabled", F.lit(True))).select(F.col("name").alias("group"))
    recent = F.when(F.col("landed_at") >= F.to_timestamp(F.lit(as_of)) - F.expr(f"INTERVAL {int(seconds)} SECONDS"), 1) if seconds is not None else F.lit(None).cast("int")
    counts = groups_of(papers).groupBy("group").agg(F.count(F.lit(1)).alias("papers"), F.count(recent).alias("recent"))
    most = counts.filter("recent > 0").agg(F.max_by("group", F.struct("recent", "group")).alias("_active"))
    rows = enabled.join(counts, "group", "left").join(F.broadcast(most))  # one row
    shown = F.coalesce("recent", F.lit(0)) if seconds is not None else F.lit(None)
    return rows.select("group", F.coalesce("papers", F.lit(0)).alias("papers"), shown.cast("long").alias("recent"), F.coalesce(F.col("group") == F.col("_active"), F.lit(False)).alias("active"))


class ProgressLog(StreamingQueryListener):
    """Counts of landed rows by batch, as the query observed them in the pass that wrote them."""

    def __init__(self, name: str = "landed"):
        self.name, self.batches = name, []

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        row = event.progress.observedMetrics.get(self.name)
        if row is not None:
            self.batches.append((event.progress.batchId, *row))

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass


def observed(papers: DataFrame, name: str = "landed") -> DataFrame:
    """The stream with rows, grouped rows and last landing observed for ProgressLog."""
    listed = F.coalesce(F.size(F.from_json("source_queries", "array<string>")), F.lit(0))
    return papers.observe(name, F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum(F.greatest(listed, F.lit(0))), F.lit(0)).alias("grouped"), F.max("landed_at").alias("last"))


def with_precision(papers: DataFrame, fetched: DataFrame) -> tuple[DataFrame, Observation]:
    """papers (pmid, year, pub_date, date_precision) with the dates of fetched ones where their precision is missing.

    The observation counts pending, updated and failed rows in the pass that writes the result; nothing is
    scanned for it. Of a pmid fetched several times the first by its dates counts. Papers without a pmid are
    not looked up; fetched papers without a precision patch nothing.
    """
    found = fetched.filter("pmid IS NOT NULL AND date_precision <> ''").groupBy("pmid").agg(F.min(F.struct("pub_date", "year", "date_precision")).alias("_f"))
    pending = F.col("pmid").isNotNull() & (F.coalesce("date_precision", F.lit("")) == "")
    rows = papers.join(found, "pmid", "left").withColumn("_pending", pending).withColumn("_new", F.when(pending, F.col("_f")))
    watch = Observation()
    rows = rows.observe(watch, F.count_if("_pending").alias("pending"), F.count_if(F.col("_new").isNotNull()).alias("updated"), F.count_if(F.col("_pending") & F.col("_new").isNull()).alias("failed"))
    fields = {c: F.coalesce(F.col("_new")[c], F.col(c)).alias(c) for c in ("pub_date", "year", "date_precision")}
    return rows.select(*[fields.get(c, F.col(c)) for c in papers.columns]), watch
