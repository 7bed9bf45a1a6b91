"""Repair of damaged conversations by A* on the lattice of edits.

A place in the lattice is (rows read, what the output's roles allow next). Keeping, giving another
role, deleting and inserting lead on, at their costs; the heuristic of a place is the sum, over the
rows ahead, of mandatory deletions and of the charge that a truncated row costs at least. Places are
taken by (cost plus heuristic, audit), so that among the cheapest repairs the ASCII-least comes first:
two ways to one place of equal cost are never prefixes of each other, as the longer one would hold an
insertion more.

Rows are dealt by ranges of (conversation, turn, role, text), so that a conversation of any length is
many tasks' work. A task walks each conversation in segments and tells, for a segment whose beginning
or end it can't see, the cheapest way from each place before it to each place behind it; a
conversation's segments are then joined. Texts are hashed in a second walk, which holds none of them.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_folder, read_table, settle, shared_dir

KEEP, REROLE, DELETE, INSERT, CHARGE = 0, 2, 3, 2, 1
#: Rows of a segment, and of a batch that is read at once.
SEGMENT, STEP = 1024, 1024
#: What has been written: nothing, a system row, a user's, an assistant's; and what a role leads to.
NOTHING, SYSTEM, USER, ASSISTANT = range(4)
LEADS = {"s": {NOTHING: SYSTEM}, "u": {NOTHING: USER, SYSTEM: USER, ASSISTANT: USER}, "a": {USER: ASSISTANT}}
#: The only role that may be given or inserted, and where it leads.
NEXT = {NOTHING: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}
ROLE = {USER: "user", ASSISTANT: "assistant"}
LEGAL = {"su", "ua", "au"}
#: A row's first fault: none, truncated, or one that must be deleted.
SOUND, TRUNCATED, VOID = range(3)
#: ASCII white space, as SQL text.
BLANK = "concat(' ', char(9), char(10), char(11), char(12), char(13))"


def ways(initials: list[str], faults: list[int], start: int, goals: set[int]) -> dict[int, tuple[int, str]]:
    """The cheapest (cost, audit) over all rows from a state to each of the goals that can be reached."""
    n = len(faults)
    ahead = [0] * (n + 1)
    for i in range(n - 1, -1, -1):
        ahead[i] = ahead[i + 1] + (0, CHARGE, DELETE)[faults[i]]
    heap, taken, found = [(ahead[0], "", 0, start)], set(), {}
    while heap and len(found) < len(goals):
        total, audit, i, state = heapq.heappop(heap)
        if (i, state) in taken:
            continue
        taken.add((i, state))
        if i == n and state in goals:
            found[state] = (total, audit)
        heapq.heappush(heap, (total + INSERT, audit + "I", i, NEXT[state]))
        if i == n:
            continue
        behind = total - ahead[i] + ahead[i + 1]
        heapq.heappush(heap, (behind + DELETE, audit + "D", i + 1, state))
        if faults[i] == VOID:
            continue
        charge = CHARGE if faults[i] == TRUNCATED else 0
        heapq.heappush(heap, (behind + REROLE + charge, audit + "R", i + 1, NEXT[state]))
        kept = LEADS.get(initials[i], {}).get(state)
        if kept is not None:
            heapq.heappush(heap, (behind + KEEP + charge, audit + "K", i + 1, kept))
    return found


def cheapest(initials: list[str], faults: list[int]) -> tuple[int, str]:
    """The repair of a whole conversation."""
    return min(ways(initials, faults, NOTHING, {NOTHING, ASSISTANT}).values())


def joined(segments: list[list[tuple[int, int, int, str]]]) -> tuple[int, str]:
    """The cheapest repair over segments of (from, to, cost, audit)."""
    best = {NOTHING: (0, "")}
    for segment in segments:
        onward: dict[int, tuple[int, str]] = {}
        for start, end, cost, audit in segment:
            if start in best:
                way = (best[start][0] + cost, best[start][1] + audit)
                onward[end] = min(onward.get(end, way), way)
        best = onward
    return min(way for state, way in best.items() if state in (NOTHING, ASSISTANT))


def damaged(rows: DataFrame) -> DataFrame:
    """conversations (conv_id, turn, role, text) after the damage that each row's crc32 deals it."""
    texts = F.expr("concat(coalesce(CAST(conv_id AS STRING), ' '), ':', coalesce(CAST(turn AS STRING), ' '))")
    rows = rows.select("conv_id", "turn", F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"), (F.crc32(texts) % 20).alias("kind"))
    return rows.filter("kind <> 0").select(
        "conv_id",
        "turn",
        F.expr("IF(kind = 4, 'user', role)").alias("role"),
        F.expr("CASE kind WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END").alias("text"),
        F.expr("IF(kind = 3, 2L, 1L)").alias("copies"),
    )


def judged(rows: DataFrame) -> DataFrame:
    """One row for equal neighbours (conv_id, turn, role, text): how many copies, whether the first is new, its fault.

    The first of a role and text is that of the least turn; it is found by an equality of all four
    columns, so that no conversation and no repeated text is one task's.
    """
    rows = rows.groupBy("conv_id", "turn", "role", "text").agg(F.sum("copies").alias("copies"))
    first = rows.groupBy("conv_id", "role", "text").agg(F.min(F.struct(F.col("turn").isNotNull().alias("some"), "turn")).alias("least"))
    first = first.select(F.col("conv_id").alias("c"), F.col("role").alias("r"), F.col("text").alias("t"), F.col("least.turn").alias("n"))
    rows = rows.join(first, F.expr("role = r AND text = t AND conv_id <=> c AND turn <=> n"), "left").withColumn("new", F.col("r").isNotNull()).drop("c", "r", "t", "n")
    ended = F.expr(f"rtrim({BLANK}, text)")
    fault = F.when(ended == "", "blank").when(~F.col("new"), "duplicate").when(~F.right(ended, F.lit(1)).isin(".", "!", "?"), "truncated")
    return rows.withColumn("fault", fault)


def facts_of(rows: DataFrame) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated) of judged rows."""
    turns = rows.groupBy("conv_id", "turn").agg(
        F.sum(F.expr("IF(fault = 'blank', copies, 0L)")).alias("blank"),
        F.sum(F.expr("CASE WHEN fault = 'blank' THEN 0L WHEN fault = 'duplicate' THEN copies ELSE copies - 1 END")).alias("duplicate"),
        F.sum(F.expr("IF(fault = 'truncated', 1L, 0L)")).alias("truncated"),
    )
    gaps = F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count("turn"), F.lit(0)).cast("long")
    return turns.groupBy("conv_id").agg(gaps.alias("gaps"), *[F.sum(c).cast("long").alias(c) for c in ("blank", "duplicate", "truncated")])


ORDER = ["conv_id", "turn", "role", "text"]
SEGMENTS = pa.schema([("conv_id", pa.int64()), ("at", pa.int64()), ("begin", pa.string()), ("end", pa.string()), ("illegal", pa.int64()), ("ways", pa.list_(pa.struct([("start", pa.int32()), ("to", pa.int32()), ("cost", pa.int64()), ("audit", pa.string())])))])
SEGMENTS_DDL = "conv_id long, at long, begin string, end string, illegal long, ways array<struct<start:int,to:int,cost:long,audit:string>>"


def segments(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """Segments of at most `size` sorted rows (conv_id, initial, fault, copies).

    Only a conversation that has begun and ended within the task, in one segment, is known to be whole;
    of the others all ways are told, for their beginning or end may be another task's.
    """
    base, number = TaskContext.get().partitionId() << 40, 0
    out: list[dict] = []

    def segment(conv: int | None, initials: list[str], faults: list[int], whole: bool) -> dict:
        pairs = sum(a + b not in LEGAL for a, b in zip(initials, initials[1:], strict=False))
        starts, goals = ([NOTHING], {NOTHING, ASSISTANT}) if whole else (range(4), set(range(4)))
        told = [{"start": s, "to": e, "cost": c, "audit": a} for s in starts for e, (c, a) in ways(initials, faults, s, goals).items()]
        return {"conv_id": conv, "at": base + number, "begin": initials[0], "end": initials[-1], "illegal": pairs, "ways": told}

    initials: list[str] = []
    faults: list[int] = []
    conv, first, split = None, True, False
    for batch in batches:
        for i, initial, fault, copies in zip(*[batch.column(c).to_pylist() for c in ("conv_id", "initial", "fault", "copies")], strict=True):
            if initials and i != conv:
                out.append(segment(conv, initials, faults, not first and not split))
                initials, faults, first, split, number = [], [], False, False, number + 1
            conv = i
            for copy in range(copies):
                if len(faults) == size:
                    out.append(segment(conv, initials, faults, False))
                    initials, faults, split, number = [], [], True, number + 1
                initials.append(initial)
                faults.append(VOID if fault == "blank" or fault == "duplicate" or copy else TRUNCATED if fault else SOUND)
            if len(out) >= STEP:
                yield pa.RecordBatch.from_pylist(out, SEGMENTS)
                out = []
    if initials:
        out.append(segment(conv, initials, faults, False))
    yield pa.RecordBatch.from_pylist(out, SEGMENTS)


def planned(table: pa.Table) -> pa.Table:
    """(conv_id, illegal, cost, audit) of one conversation's segments."""
    told = sorted(table.to_pylist(), key=lambda s: s["at"])
    cost, audit = joined([[(w["start"], w["to"], w["cost"], w["audit"]) for w in s["ways"]] for s in told])
    illegal = sum(s["illegal"] for s in told) + sum(a["end"] + b["begin"] not in LEGAL for a, b in zip(told, told[1:], strict=False))
    return pa.table([pa.array([told[0]["conv_id"]], pa.int64()), pa.array([illegal], pa.int64()), pa.array([cost], pa.int64()), pa.array([audit], pa.string())], names=["conv_id", "illegal", "cost", "audit"])


class Writer:
    """The output of one conversation, line by line, from its audit and its rows in order."""

    def __init__(self, conv: int | None, audit: str):
        self.conv, self.audit, self.at, self.state, self.turn = conv, audit, 0, NOTHING, 0
        self.hash, self.lines = hashlib.sha256(), 0

    def line(self, role: str, text: str) -> tuple[int, str, str]:
        self.hash.update((("\n" if self.lines else "") + f"{role}:{text}").encode())
        self.lines += 1
        return self.lines - 1, role, text

    def inserted(self) -> Iterator[tuple[int, str, str]]:
        while self.at < len(self.audit) and self.audit[self.at] == "I":
            self.at, self.state = self.at + 1, NEXT[self.state]
            yield self.line(ROLE[self.state], "")

    def row(self, role: str, text: str, copies: int) -> Iterator[tuple[int, str, str]]:
        for _ in range(copies):
            yield from self.inserted()
            edit, self.at = self.audit[self.at], self.at + 1
            if edit == "K":
                self.state = LEADS[role[:1]][self.state]
                yield self.line(role, text)
            elif edit == "R":
                self.state = NEXT[self.state]
                yield self.line(ROLE[self.state], text)


def written(batches: Iterator[pa.RecordBatch], lines: bool) -> Iterator[pa.RecordBatch]:
    """Of sorted rows, each conversation's plan (audit) before its rows: digests, or else the repaired lines."""
    schema = pa.schema([("conv_id", pa.int64()), ("place", pa.int64()), ("role", pa.string()), ("text", pa.string())] if lines else [("conv_id", pa.int64()), ("repaired_sha256", pa.string())])
    names, writer, out = schema.names, None, []

    def ended() -> list[tuple]:
        rest = [(writer.conv, *line) for line in writer.inserted()]
        return rest if lines else [(writer.conv, writer.hash.hexdigest())]

    for whole in batches:
        for start in range(0, whole.num_rows, STEP):
            batch = whole.slice(start, STEP)
            for conv, audit, role, text, copies in zip(*[batch.column(c).to_pylist() for c in ("conv_id", "audit", "role", "text", "copies")], strict=True):
                if audit is not None:
                    out += ended() if writer else []
                    writer = Writer(conv, audit)
                    continue
                for line in writer.row(role, text, copies):
                    if lines:
                        out.append((conv, *line))
            yield pa.RecordBatch.from_pylist([dict(zip(names, row, strict=True)) for row in out], schema)
            out = []
    out = ended() if writer else []
    yield pa.RecordBatch.from_pylist([dict(zip(names, row, strict=True)) for row in out], schema)


def plans_of(rows: DataFrame, folder: str) -> DataFrame:
    """(conv_id, illegal, cost, audit) of judged rows."""
    parts = rows.sparkSession.conf.get("spark.sql.shuffle.partitions")
    short = rows.select(*ORDER, F.substring("role", 1, 1).alias("initial"), "fault", "copies")
    short = short.repartitionByRange(int(parts), "conv_id", "turn", "role", F.substring("text", 1, 64)).sortWithinPartitions(*ORDER)
    size = SEGMENT
    told = settle(short.select("conv_id", "initial", "fault", "copies").mapInArrow(lambda b: segments(b, size), SEGMENTS_DDL), folder, "segments")
    return settle(told.groupBy("conv_id").applyInArrow(planned, "conv_id long, illegal long, cost long, audit string"), folder, "plans")


def walked(rows: DataFrame, plans: DataFrame) -> DataFrame:
    """Each conversation's plan, then its rows in order, in one partition."""
    heads = plans.select("conv_id", F.lit(0).alias("kind"), "audit", F.lit(None).cast("long").alias("turn"), F.lit("").alias("role"), F.lit("").alias("text"), F.lit(0).cast("long").alias("copies"))
    body = rows.select("conv_id", F.lit(1).alias("kind"), F.lit(None).cast("string").alias("audit"), "turn", "role", "text", "copies")
    both = heads.union(body).repartition("conv_id").sortWithinPartitions("conv_id", "kind", "turn", "role", "text")
    return both.select("conv_id", "audit", "role", "text", "copies")


def repaired_lines(conversations: DataFrame) -> DataFrame:
    """(conv_id, place, role, text): the repaired conversations (conv_id, turn, role, text), undamaged before.

    Odd rows are as in repair_report. What is written on the way stays until release(), for the result
    to read.
    """
    folder = shared_dir(conversations.sparkSession)
    rows = settle(judged(whole(conversations).withColumn("copies", F.lit(1).cast("long"))), folder, "rows")
    return walked(rows, plans_of(rows, folder)).mapInArrow(lambda b: written(b, True), "conv_id long, place long, role string, text string")


def whole(conversations: DataFrame) -> DataFrame:
    nulls = [F.coalesce(c, F.lit(" ")).alias(c) for c in ("role", "text")]
    return conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), *nulls)


def repair_report(conversations: DataFrame) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256) of damaged conversations.

    conversations (conv_id, turn, role, text) are damaged by damaged() first. Null roles and texts are
    one space, and null ids and turns are one space where crc32 reads them. Rows go by turn, nulls
    first, and within a turn by role and text. Null conv_ids are one conversation, whose conv_id is
    null. Roles are known by their first character; one that is neither s, u nor a can't be kept.
    Conversations whose rows are all dropped have zeros, an empty audit and the empty string's hash. An
    empty table gives an empty result; other columns aren't read, however named. A conversation is
    hashed by one task, as its digest is one of all its lines in order; the task holds its audit, not
    its texts. All that is written on the way is removed, but for the result.
    """
    spark = conversations.sparkSession
    folder, kept = shared_dir(spark), shared_dir(spark)
    clean = whole(conversations)
    rows = settle(judged(damaged(clean)), folder, "rows")
    plans = plans_of(rows, folder)
    digests = walked(rows, plans).mapInArrow(lambda b: written(b, False), "conv_id long, repaired_sha256 string")
    found = clean.select("conv_id").distinct()
    for other in (settle(facts_of(rows), folder, "facts"), plans, settle(digests, folder, "digests")):
        other = other.withColumnRenamed("conv_id", "c")
        found = found.join(other, F.expr("conv_id <=> c"), "left").drop("c")
    zeros = {c: F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")}
    out = found.select("conv_id", *zeros.values(), F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(hashlib.sha256().hexdigest())).alias("repaired_sha256"))
    out = settle(out, kept, "report")
    drop_folder(spark, folder)
    return out


def op13_conversation_repair(spark, sf_dir):
    return repair_report(read_table(spark, sf_dir, "conversations"))
