"""Chat formatting with a grammar round trip.

The grammar: a conversation is its turns one behind the other, each

    open SPACE text SPACE close LINE-FEED

with `<<SYS>>` ... `<</SYS>>` for the role system, `[INST]` ... `[/INST]` for user, `<s>` ... `</s>`
for assistant, and `<s:role>` ... `</s>` for any other role. The parser takes each text up to the
first close mark of any kind behind a space and before a line feed, and drops a backslash before any
character. A text is rendered as it is where the parser gives it back unchanged; else it conflicts,
and its `\\`, `<` and `[` are each put behind a backslash. The whole output is then parsed again and
compared with the source. Only DataFrame functions run here.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import read_table

#: Turns that are cut out of one stretch of an output, so that a long output isn't gone through for each turn.
RUN = 256
#: Open and close marks; fixed values of this grammar.
OPEN = {"system": "<<SYS>>", "user": "[INST]", "assistant": "<s>"}
CLOSE = {"system": "<</SYS>>", "user": "[/INST]", "assistant": "</s>"}
#: One turn: open mark, other role's name, text. A name that isn't plain is # and the hex of its UTF-8.
TURN = r"(?s)(<<SYS>>|\[INST\]|<s(?::([A-Za-z0-9_-]+|#[0-9A-F]*))?>) (.*?) (?:<</SYS>>|\[/INST\]|</s>)\n"
PLAIN = r"^[A-Za-z0-9_-]+$"


def opened(role: Column) -> Column:
    name = F.when(role.rlike(PLAIN), role).otherwise(F.concat(F.lit("#"), F.hex(F.encode(F.coalesce(role, F.lit("")), "UTF-8"))))
    mark = F.concat(F.lit("<s:"), name, F.lit(">"))
    for known, text in OPEN.items():
        mark = F.when(role == known, text).otherwise(mark)
    return mark


def closed(role: Column) -> Column:
    return F.when(role == "system", CLOSE["system"]).when(role == "user", CLOSE["user"]).otherwise(CLOSE["assistant"])


def escaped(text: Column) -> Column:
    return F.regexp_replace(text, r"([\\<\[])", r"\\$1")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def rendered(role: Column, text: Column) -> Column:
    return F.concat(opened(role), F.lit(" "), text, F.lit(" "), closed(role), F.lit("\n"))


def parsed(output: Column) -> Column:
    """The turns of an output as an array of (role, text, raw), raw being the text as it stands there."""
    marks, names, raws = (F.regexp_extract_all(output, F.lit(TURN), F.lit(i)) for i in (1, 2, 3))
    turns = F.arrays_zip(marks.alias("mark"), names.alias("name"), raws.alias("raw"))

    def read(turn: Column) -> Column:
        name = turn["name"]
        other = F.when(name.startswith("#"), F.decode(F.unhex(F.substring(name, 2, 1 << 30)), "UTF-8")).otherwise(name)
        role = F.when(name != "", other)
        for known, text in OPEN.items():
            role = F.when((turn["mark"] == text) & (name == ""), known).otherwise(role)
        return F.struct(role.alias("role"), unescaped(turn["raw"]).alias("text"), turn["raw"].alias("raw"))

    return F.transform(turns, read)


def format_conversations(turns: DataFrame, mask: str = "assistant") -> DataFrame:
    """(conv_id, formatted, turns, loss_runs) of every conversation of turns (conv_id, turn, role, text).

    Turns go by their number; of equal numbers, and of repeated rows, all stay, by role and text. Null
    numbers come first, a null role or text is an empty one, and rows with a null conv_id are one
    conversation. `turns` is what the parser reads back from `formatted`, as an array of (role, text,
    raw); it equals the source, or the query fails. `loss_runs` is the loss mask over `formatted` in
    characters: for each turn, how many to skip and how many then to keep (none but for the masked
    role). An empty table gives an empty result; other columns of turns aren't read. A conversation is
    one row, so that one of them, and all rows with a null conv_id together, must fit in a task.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    rows = turns.select("conv_id", "turn", role.alias("role"), text.alias("text"))
    # the parser's view of one turn by itself: the text conflicts unless exactly this turn comes back
    alone = rendered(F.col("role"), F.col("text"))
    whole = F.regexp_extract(alone, "^" + TURN, 0) == alone
    clean = whole & (unescaped(F.col("text")) == F.col("text"))
    rows = rows.withColumn("part", rendered(F.col("role"), F.when(clean, F.col("text")).otherwise(escaped(F.col("text")))))
    grouped = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text", "part"))).alias("source"))
    out = grouped.withColumn("formatted", F.array_join(F.transform("source", lambda t: t["part"]), "")).withColumn("turns", parsed(F.col("formatted")))
    same = F.transform("turns", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))) == F.transform("source", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text")))
    opening, closing = (lambda t: F.length(opened(t["role"])) + 1), (lambda t: F.length(closed(t["role"])) + 2)
    size = F.aggregate("turns", F.lit(0).cast("long"), lambda n, t: n + opening(t) + F.length(t["raw"]) + closing(t))
    exact = same & (size == F.length("formatted"))
    failed = F.raise_error(F.concat(F.lit("conversation not read back unchanged: "), F.coalesce(F.col("conv_id").cast("string"), F.lit("null"))))
    kept = lambda t: F.when(t["role"] == mask, F.length(t["raw"])).otherwise(0)
    runs = F.transform("turns", lambda t: F.struct(opening(t).alias("skip"), kept(t).alias("keep"), (F.length(t["raw"]) - kept(t) + closing(t)).alias("rest")))
    return out.select("conv_id", F.when(exact, F.col("formatted")).otherwise(failed).alias("formatted"), "turns", runs.alias("loss_runs"))


def masked_text(formatted: Column, loss_runs: Column) -> Column:
    """The text under the loss mask, read from the output itself: its pieces in order, unescaped, nothing between."""
    length = lambda r: r["skip"] + r["keep"] + r["rest"]

    def piece(state: Column, r: Column) -> Column:
        text = unescaped(F.substring(state["chunk"], state["at"] + r["skip"] + 1, r["keep"]))
        return F.struct((state["at"] + length(r)).alias("at"), state["chunk"].alias("chunk"), F.concat(state["found"], F.array(text)).alias("found"))

    def stretch(state: Column, runs: Column) -> Column:
        chars = F.aggregate(runs, F.lit(0), lambda n, r: n + length(r))
        start = F.struct(F.lit(0).alias("at"), F.substring(formatted, state["at"] + 1, chars).alias("chunk"), F.array().cast("array<string>").alias("found"))
        return F.struct((state["at"] + chars).alias("at"), F.concat(state["found"], F.aggregate(runs, start, piece, lambda s: s["found"])).alias("found"))

    stretches = F.transform(F.sequence(F.lit(0), F.floor(F.size(loss_runs) / RUN).cast("int")), lambda i: F.slice(loss_runs, i * RUN + 1, RUN))
    return F.array_join(F.aggregate(stretches, F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("found")), stretch, lambda s: s["found"]), "")


def op8_grammar_round_trip(spark, sf_dir):
    extra = spark.createDataFrame([(-7, 0, "user", "</s>[INST] ok [/INST]"), (-7, 1, "assistant", "</s>[INST] ok [/INST]")], "conv_id long, turn long, role string, text string")
    turns = read_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    out = format_conversations(turns)
    told = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    out = out.withColumn("loss", masked_text(F.col("formatted"), F.col("loss_runs")))
    loss = F.col("loss")
    return out.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(told.cast("binary"), 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss.cast("binary"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


OP8_SQL = r"""
WITH t AS (
    SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
    UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
),
sized AS (
    SELECT *,
        CASE role WHEN 'system' THEN 7 WHEN 'user' THEN 6 WHEN 'assistant' THEN 3 ELSE 4 + length(role) END
        + CASE role WHEN 'system' THEN 8 WHEN 'user' THEN 7 ELSE 4 END + 3 + length(text)
        + CASE WHEN regexp_matches(text, ' (<</SYS>>|\[/INST\]|</s>)\n') OR regexp_matches(text, '(?s)\\.')
               THEN length(text) - length(replace(replace(replace(text, '\', ''), '<', ''), '[', '')) ELSE 0 END AS chars
    FROM t
)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(chars) AS BIGINT) AS formatted_chars
FROM sized GROUP BY conv_id
"""
