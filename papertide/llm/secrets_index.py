"""Secret scans through a trigram inverted index.

Each rule's regular expression is analysed once into a Boolean query of the trigrams that any match
must hold. The index lists, for each such trigram, the texts that have it; intersecting and uniting
its postings gives each rule's candidates, and only those are searched with the expression. A rule
without mandatory trigrams is searched in all texts. Only DataFrame functions run here.
"""

from __future__ import annotations

from dataclasses import dataclass
from re import _constants as op
from re import _parser as regex

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read_table, settle, shared_dir, sized

#: Most strings that the analysis spells out for one stretch of an expression.
SPELLED = 64
#: Candidates that may be broadcast; hits of a text that are numbered in one go.
BROADCAST_ROWS, RUN = 1_000_000, 256


@dataclass(frozen=True)
class Rule:
    """kind: its name; pattern: the expression; group: whose length counts, of at least `least` characters."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1


#: The base rules, and published forms of well-known credentials; fixed values. A run that is long
#: enough is the same match whether its length is asked for in the expression (as here, where a run
#: that is too short holds no longer one) or afterwards; an assignment's value must be judged afterwards.
BASE = (
    Rule("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", r"AKIA[A-Z0-9]{16,}"),
    Rule("hex", r"[0-9a-f]{24,}"),
)
MORE = (
    Rule("github", r"gh[oprsu]_[A-Za-z0-9]{36,}"),
    Rule("google", r"AIza[A-Za-z0-9_-]{35,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{15,}"),
    Rule("stripe", r"[rs]k_live_[A-Za-z0-9]{16,}"),
)
RULES = BASE + MORE


def spelled(item: tuple) -> set[str] | None:
    """All strings (in lower case) that one parsed item matches, if they are few."""
    kind, value = item
    if kind is op.LITERAL:
        return {chr(value).lower()}
    if kind is op.IN and all(k is op.LITERAL for k, _ in value):
        return {chr(v).lower() for _, v in value}
    if kind is op.SUBPATTERN:
        return strings_of(value[-1])
    if kind is op.BRANCH:
        parts = [strings_of(x) for x in value[1]]
        return None if None in parts else set().union(*parts)
    if kind is op.MAX_REPEAT and value[1] <= 4 and (one := strings_of(value[2])) is not None:
        out, power = set(), {""}
        for n in range(value[1] + 1):
            out |= power if n >= value[0] else set()
            power = {a + b for a in power for b in one}
            if len(power) > SPELLED:
                return None
        return out
    return None


def strings_of(items) -> set[str] | None:
    out = {""}
    for item in items:
        if (some := spelled(item)) is None or len(out) * len(some) > SPELLED:
            return None
        out = {a + b for a in out for b in some}
    return out


def alternatives(strings: set[str]) -> list[frozenset[str]]:
    """One set of all its trigrams for each string, without those that imply another; a string too short for
    any makes the whole say nothing."""
    sets = [frozenset(s[i : i + 3] for i in range(len(s) - 2)) for s in strings]
    return [] if frozenset() in sets else sorted({s for s in sets if not any(t < s for t in sets)}, key=sorted)


def trigram_query(pattern: str) -> list[list[frozenset[str]]]:
    """A conjunction of disjunctions of trigram sets, in lower case, that every match fulfils.

    Stretches of an expression that match few strings are spelled out across their items; whatever
    matches more ends a stretch. An empty list: no trigram is mandatory.
    """
    query, run = [], {""}
    for item in [*regex.parse(pattern), None]:
        some = spelled(item) if item else None
        if some is not None and len(run) * len(some) <= SPELLED:
            run = {a + b for a in run for b in some}
            continue
        query.append(alternatives(run))
        run = some if some is not None else {""}
        if item and item[0] in (op.SUBPATTERN, op.MAX_REPEAT) and some is None and (item[0] is op.SUBPATTERN or item[1][0] > 0):
            query += trigram_query_of(item[1][-1])
    return [x for x in query if x]


def trigram_query_of(items) -> list[list[frozenset[str]]]:
    run = strings_of(items)
    return [alternatives(run)] if run is not None else []


def alternatives_of(rules) -> list[tuple[str, int, int, int, str]]:
    """Rows (kind, clause, alternative, trigrams that it needs, trigram) of all rules' queries."""
    rows = []
    for rule in rules:
        for c, clause in enumerate(trigram_query(rule.pattern)):
            for a, need in enumerate(clause):
                rows += [(rule.kind, c, a, len(need), t) for t in sorted(need)]
    return rows


def postings(docs: DataFrame, trigrams: list[str]) -> DataFrame:
    """The inverted index: a row (trigram, doc_id, digest) for each text of docs that holds the trigram in any case."""
    here = F.array_compact(F.array(*[F.when(F.contains("low", F.lit(t)), F.lit(t)) for t in trigrams]))
    lowered = docs.select("doc_id", "digest", F.lower("text").alias("low"))  # by itself: once for all trigrams
    return lowered.select("doc_id", "digest", F.explode(here).alias("trigram"))


def candidates(spark: SparkSession, docs: DataFrame, rules) -> DataFrame:
    """(doc_id, digest, kinds) of the texts that the rules' trigram queries leave to be searched."""
    rows = alternatives_of(rules)
    query = spark.createDataFrame(rows, "kind string, clause int, alternative int, need int, trigram string")
    clauses = spark.createDataFrame([(k, len({c for kind, c, *_ in rows if kind == k})) for k in {r[0] for r in rows}], "kind string, clauses int")
    index = postings(docs, sorted({r[-1] for r in rows}))
    full = (
        index.join(F.broadcast(query), "trigram")  # the rules' own rows
        .groupBy("kind", "clause", "alternative", "doc_id", "digest")
        .agg(F.count_distinct("trigram").alias("held"), F.first("need").alias("need"))
        .filter("held = need")
    )
    met = full.groupBy("kind", "doc_id", "digest").agg(F.count_distinct("clause").alias("met")).join(F.broadcast(clauses), "kind").filter("met = clauses")
    return met.groupBy("doc_id", "digest").agg(F.collect_set("kind").alias("kinds"))


def hits_of(text: Column, rule: Rule) -> tuple[Column, Column, Column]:
    """The stretches between a rule's matches, the matches, and what of each counts for its length."""
    find = lambda g: F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(g))
    return F.split(text, rule.pattern, -1), find(0), find(rule.group)


def spans_of(gaps: Column, hits: Column, values: Column, rule: Rule, number: int) -> Column:
    """(start, number, end) of each match that is long enough, in code points; needs plain columns.

    Matches are numbered in runs, so that a text with very many isn't copied once for each.
    """
    sizes = F.zip_with(F.zip_with(gaps, hits, lambda g, h: F.struct(F.length(g).alias("gap"), F.length(h).alias("hit"))), values, lambda s, v: F.struct(s["gap"].alias("gap"), s["hit"].alias("hit"), (F.length(v) >= rule.least).alias("fits")))
    # the last gap has no match behind it
    runs = F.transform(F.sequence(F.lit(0), F.ceil(F.size(hits) / RUN).cast("int")), lambda i: F.slice(sizes, i * RUN + 1, RUN))
    span = "struct<start:int,number:int,end:int>"

    def step(state: Column, x: Column) -> Column:
        start = state["at"] + x["gap"]
        end = start + F.coalesce(x["hit"], F.lit(0))
        found = F.when(F.coalesce(x["fits"], F.lit(False)), F.array(F.struct(start.alias("start"), F.lit(number).alias("number"), end.alias("end")))).otherwise(F.array().cast(f"array<{span}>"))
        return F.struct(end.alias("at"), F.concat(state["found"], found).alias("found"))

    nothing = F.array().cast(f"array<{span}>")

    def leap(state: Column, run: Column) -> Column:
        inner = F.aggregate(run, F.struct(state["at"].alias("at"), nothing.alias("found")), step)
        return F.struct(inner["at"].alias("at"), F.concat(state["found"], inner["found"]).alias("found"))

    return F.aggregate(runs, F.struct(F.lit(0).alias("at"), nothing.alias("found")), leap, lambda s: s["found"])


def searched(docs: DataFrame, rules=RULES) -> DataFrame:
    """docs (any columns, doc_id, text) with _pt_kinds: the rules by which each row is to be searched."""
    spark = docs.sparkSession
    digest = F.xxhash64(F.coalesce("text", F.lit("")))
    indexed = [r for r in rules if trigram_query(r.pattern)]
    always = [r.kind for r in rules if r not in indexed]
    keys = docs.select(F.col("doc_id").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).withColumn("digest", F.xxhash64("text"))
    found = sized(settle(candidates(spark, keys, indexed), shared_dir(spark), "candidates"), BROADCAST_ROWS)
    found = found.withColumnsRenamed({"doc_id": "_pt_d", "digest": "_pt_g", "kinds": "_pt_kinds"})
    rows = docs.withColumn("_pt_digest", digest).join(found, F.expr("_pt_digest = _pt_g AND doc_id <=> _pt_d"), "left")
    kinds = F.concat(F.coalesce("_pt_kinds", F.array().cast("array<string>")), F.array(*[F.lit(k) for k in always]).cast("array<string>"))
    return rows.withColumn("_pt_kinds", kinds).drop("_pt_d", "_pt_g", "_pt_digest")


def with_hits(rows: DataFrame, rule: Rule, text: str) -> DataFrame:
    """Add _pt_gaps, _pt_hits and _pt_values of one rule, for the rows that it is to be searched in."""
    body = F.coalesce(F.col(text), F.lit(""))
    gaps, hits, values = hits_of(body, rule)
    rows = rows.withColumn("_pt_hits", F.when(F.array_contains("_pt_kinds", rule.kind), hits))
    some = F.size("_pt_hits") > 0
    return rows.withColumns({"_pt_gaps": F.when(some, gaps), "_pt_values": F.when(some, values if rule.group else F.col("_pt_hits"))})


def scan(docs: DataFrame, rules=RULES) -> DataFrame:
    """Add spans to docs (doc_id, text): a sorted array of (start, number, end), number being the rule's place.

    Places are in code points, ends exclusive; spans of different rules may overlap. A null text counts
    as empty; repeated rows and null doc_ids are kept; an empty table gives an empty result. Columns
    named spans are replaced. Texts are searched whole, and only by the rules whose trigram query they
    meet; the index holds one row for each text and mandatory trigram in it.
    """
    rows = searched(docs, rules)
    for number, rule in enumerate(rules):
        rows = with_hits(rows, rule, "text")
        found = spans_of(F.col("_pt_gaps"), F.col("_pt_hits"), F.col("_pt_values"), rule, number)
        rows = rows.withColumn(f"_pt_spans{number}", F.when(F.size("_pt_hits") > 0, found)).drop("_pt_gaps", "_pt_hits", "_pt_values")
    nothing = F.array().cast("array<struct<start:int,number:int,end:int>>")
    every = F.concat(*[F.coalesce(f"_pt_spans{n}", nothing) for n in range(len(rules))])
    return rows.withColumn("spans", F.array_sort(every)).drop("_pt_kinds", *[f"_pt_spans{n}" for n in range(len(rules))])


def redact(docs: DataFrame, rules=RULES, text: str = "text", mark: str = "[REDACTED]") -> DataFrame:
    """docs with every secret's value in its texts replaced by a mark, rule by rule; other columns stay.

    All rows stay, repeated ones and those with null ids too; a null text stays null, and a text without
    secrets as it is. An empty table gives an empty result. Names that begin with _pt_ are reserved.
    """
    rows = searched(docs, rules)
    for rule in rules:
        rows = with_hits(rows, rule, text)
        hit = F.zip_with("_pt_hits", "_pt_values", lambda h, v: F.when(F.length(v) >= rule.least, F.concat(F.substring(h, F.lit(1), F.length(h) - F.length(v)), F.lit(mark))).otherwise(h))
        clean = F.array_join(F.zip_with("_pt_gaps", hit, lambda g, h: F.concat(g, F.coalesce(h, F.lit("")))), "")
        rows = rows.withColumn(text, F.when(F.size("_pt_hits") > 0, clean).otherwise(F.col(text))).drop("_pt_gaps", "_pt_hits", "_pt_values")
    return rows.drop("_pt_kinds")


def op9_trigram_secret_scan(spark, sf_dir):
    found = scan(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
    kinds = F.array(*[F.lit(r.kind) for r in RULES])
    told = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(kinds, s["number"] + 1), s["start"], s["end"])), ",")
    base = F.filter("spans", lambda s: s["number"] < len(BASE))
    count = lambda n: F.size(F.filter("spans", lambda s: s["number"] == n)).cast("long")
    return found.select(
        "doc_id",
        *[count(n).alias(f"n_{rule.kind}") for n, rule in enumerate(BASE)],
        F.sha2(told(base).cast("binary"), 256).alias("base_sha256"),
        told(F.col("spans")).alias("spans"),
    )
