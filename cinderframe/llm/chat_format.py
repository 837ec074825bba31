"""Chat formatting with a grammar round trip: what the parser reads back is what was written."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

#: turn := OPEN role SEP text CLOSE; a formatted conversation is its turns without anything between.
OPEN, SEP, CLOSE = "<s>[INST] ", " [/INST]", "</s>"
#: Control strings and how they are written inside escaped content. % itself comes first, and last on reading.
ESCAPES = (("%", "%25"), ("<s>", "%3Cs>"), ("</s>", "%3C/s>"), ("[INST]", "%5BINST]"), ("[/INST]", "%5B/INST]"))


def escape(x: Column) -> Column:
    for plain, safe in ESCAPES:
        x = F.replace(x, F.lit(plain), F.lit(safe))
    return x


def unescape(x: Column) -> Column:
    for safe, plain in (("%3C", "<"), ("%5B", "["), ("%25", "%")):
        x = F.replace(x, F.lit(safe), F.lit(plain))
    return x


def render(role: Column, text: Column) -> Column:
    return F.concat(F.lit(OPEN), role, F.lit(SEP), text, F.lit(CLOSE))


def parse(formatted: Column) -> Column:
    """The turns that a formatted conversation holds, as (role, text); a piece that is no turn gives nulls."""
    pieces = F.split(formatted, CLOSE, -1)

    def turn(p: Column) -> Column:
        body = F.substr(p, F.lit(len(OPEN) + 1))
        at = F.instr(body, SEP)
        good = F.startswith(p, F.lit(OPEN)) & (at > 0)
        role = F.when(good, unescape(F.substr(body, F.lit(1), at - 1)))
        return F.struct(role.alias("role"), F.when(good, unescape(F.substr(body, at + len(SEP)))).alias("text"))

    return F.transform(F.slice(pieces, 1, F.greatest(F.size(pieces) - 1, F.lit(0))), turn)


def format_conversations(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", loss_role: str = "assistant") -> DataFrame:
    """One row per conversation: conv_col, formatted, loss_spans (start, n_chars from 0, in code points) and round_trip.

    A turn is rendered as it is and parsed again; where the parser does not give back exactly its role and
    text, or one of them holds a control string, their control strings and escape signs are escaped, which the
    parser undoes: so no control string of a text stands in the output. round_trip says that
    the whole formatted conversation parses to its turns. loss_spans covers the (escaped) text of turns of
    loss_role, without template signs.

    Turns stand in order of turn, then role, then text, nulls first. A null text or role is empty, null
    conversation ids form one conversation, repeated rows are repeated turns, other columns are not read,
    and an empty table gives an empty result. A conversation becomes one string, so its turns meet in a task.
    """
    empty = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    turns = rows.select(F.col(conv_col).alias("conv"), F.col(turn_col).alias("turn"), empty(role_col).alias("role"), empty(text_col).alias("text"))
    source = F.array(F.struct("role", "text"))
    control = F.lit(False)
    for c in ("role", "text"):
        for plain, _ in ESCAPES[1:]:
            control = control | F.contains(F.col(c), F.lit(plain))
    same = ~control & F.coalesce(parse(render(F.col("role"), F.col("text"))) == source, F.lit(False))
    shown = lambda c: F.when(F.col("same"), F.col(c)).otherwise(escape(F.col(c)))
    turns = turns.withColumn("same", same).select("conv", "turn", "role", "text", shown("role").alias("r"), shown("text").alias("t")).withColumn("shown", render(F.col("r"), F.col("t")))
    order = Window.partitionBy("conv").orderBy("turn", "role", "text")
    ended = F.sum(F.length("shown").cast("long")).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    turns = turns.withColumn("start", ended - F.length("t") - len(CLOSE)).select("conv", F.struct("turn", "role", "text", "start", F.length("t").cast("long").alias("n_chars"), "shown").alias("x"))
    out = turns.groupBy("conv").agg(F.sort_array(F.collect_list("x")).alias("x"))
    out = out.select("conv", F.array_join("x.shown", "").alias("formatted"), F.transform(F.filter("x", lambda y: y.role == loss_role), lambda y: F.struct(y.start.alias("start"), y.n_chars.alias("n_chars"))).alias("loss_spans"), F.transform("x", lambda y: F.struct(y.role.alias("role"), y.text.alias("text"))).alias("turns"))
    return out.select(F.col("conv").alias(conv_col), "formatted", "loss_spans", F.coalesce(parse(F.col("formatted")) == F.col("turns"), F.lit(False)).alias("round_trip"))


def op7_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    more = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    done = format_conversations(rows.unionByName(more))
    read = done.select("conv_id", parse(F.col("formatted")).alias("turns"), F.array_join(F.transform("loss_spans", lambda s: unescape(F.substr("formatted", (s.start + 1).cast("int"), s.n_chars.cast("int")))), "").alias("loss"), F.length("formatted").cast("long").alias("formatted_chars"), "round_trip")
    told = F.array_join(F.transform("turns", lambda t: F.concat(t.role, F.lit("\n"), t.text, F.lit("\n"))), "")
    return read.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(told, 256).alias("turns_sha256"), F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), "formatted_chars", "round_trip")


QUERIES = {"op7_chat_format": op7_chat_format}
SQL = {
    "op7_chat_format": r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
f AS (
  SELECT *, regexp_matches(text, '</?s>|\[/?INST\]') OR regexp_matches(role, '</?s>|\[/?INST\]')
            OR regexp_matches(text, '%(3C|5B|25)') OR regexp_matches(role, '%(3C|5B|25)') AS bad FROM t),
e AS (
  SELECT *, CASE WHEN bad THEN replace(replace(replace(replace(replace(text, '%', '%25'), '<s>', '%3Cs>'), '</s>', '%3C/s>'), '[INST]', '%5BINST]'), '[/INST]', '%5B/INST]') ELSE text END AS et,
            CASE WHEN bad THEN replace(replace(replace(replace(replace(role, '%', '%25'), '<s>', '%3Cs>'), '</s>', '%3C/s>'), '[INST]', '%5BINST]'), '[/INST]', '%5B/INST]') ELSE role END AS er FROM f)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(10 + length(er) + 8 + length(et) + 4) AS BIGINT) AS formatted_chars, true AS round_trip
FROM e GROUP BY conv_id
""",
}
