"""Chat formatting by prefix-target expansion, in DataFrame functions alone.

Every assistant turn becomes an example of its own: all turns before it are the
context, and only its reply is trainable. An example's row holds its full text,
the context written out, then the reply and its end mark, and the span of the
reply in it. So the examples of a conversation grow with the square of its length,
as the method has it; each is made in a row of its own, a conversation's rows
are never in one array. Turns after the last reply form one row without a target
(the whole conversation), so the last row of a conversation holds all of it.

A turn is ``### role ###``, a newline, the text, ``</turn>`` and a newline.
Inside roles and texts ``\\``, ``#`` and ``<`` are written ``\\b``, ``\\h`` and
``\\l``, so neither mark can occur there and reading back is exact.

Results for special rows: a null text or role is empty; turns are ordered by
(turn, role, text), a null turn first, and repeated turns are all kept; a null
``conv_id`` is a conversation like any other; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

OPEN, MIDDLE, CLOSE = "### ", " ###\n", "</turn>\n"
CLOSE_SQL = CLOSE.replace("\n", "\\n")
TARGET_ROLE = "assistant"
ESCAPES = (("\\", "\\b"), ("#", "\\h"), ("<", "\\l"))


def escape(text: Column) -> Column:
    for raw, written in ESCAPES:
        text = F.replace(text, F.lit(raw), F.lit(written))
    return text


def prefix_target_examples(turns: DataFrame, target_role: str = TARGET_ROLE) -> DataFrame:
    """One row per example of ``turns`` (conv_id, turn, role, text).

    conv_id; example_no from 0; is_target, false for a conversation's tail
    without reply; is_last; text, all turns up to the example's last one;
    reply_start and reply_end, the code points of ``text`` that are trainable.
    """
    said = turns.select(
        "conv_id",
        F.struct(
            F.col("turn").alias("turn"),
            F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
            F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).alias("said"))
    talks = said.groupBy("conv_id").agg(F.sort_array(F.collect_list("said")).alias("said"))
    talks = talks.withColumn("said", F.transform("said", lambda s: F.struct(
        (s["role"] == target_role).alias("target"),
        F.concat(F.lit(OPEN), escape(s["role"]), F.lit(MIDDLE)).alias("head"),
        escape(s["text"]).alias("body"))))
    # positions of the turns that end an example, and the code points before every turn
    talks = talks.withColumn("ends", F.expr(
        "filter(transform(said, (s, i) -> IF(s.target OR i = size(said) - 1, i, NULL)), i -> i IS NOT NULL)"))
    talks = talks.withColumn("before", F.expr(
        "aggregate(said, named_struct('at', 0L, 'out', cast(array() AS array<bigint>)), (a, s) -> named_struct("
        f"'at', a.at + length(s.head) + length(s.body) + {len(CLOSE)}, 'out', array_append(a.out, a.at)), a -> a.out)"))
    talks = talks.withColumn("whole", F.expr(f"array_join(transform(said, s -> concat(s.head, s.body, '{CLOSE_SQL}')), '')"))
    marks = F.expr(
        "transform(ends, (e, k) -> named_struct('is_target', get(said, e).target, 'is_last', k = size(ends) - 1, "
        "'start', get(before, e) + length(get(said, e).head), 'n', length(get(said, e).body)))")
    rows = talks.select("conv_id", "whole", F.posexplode(marks).alias("example_no", "x"))
    reply = F.when(F.col("x.is_target"), F.col("x.start"))
    text = F.substr("whole", F.lit(1), (F.col("x.start") + F.col("x.n") + len(CLOSE)).cast("int"))
    return rows.select("conv_id", F.col("example_no").cast("long").alias("example_no"), "x.is_target", "x.is_last",
                       text.alias("text"), reply.alias("reply_start"), (reply + F.col("x.n")).alias("reply_end"))


def conversations(examples: DataFrame) -> DataFrame:
    """Each conversation as its examples have it: (conv_id, formatted, replies as spans, masked: the texts under the loss mask).

    The formatted text is that of the last example; every masked text is read from its own example.
    """
    masked = F.expr(_unescaped("substr(text, cast(reply_start AS int) + 1, cast(reply_end - reply_start AS int))"))
    parts = examples.withColumn("masked", masked).groupBy("conv_id").agg(
        F.max(F.when(F.col("is_last"), F.col("text"))).alias("formatted"),
        F.sort_array(F.collect_list(F.when(F.col("is_target"), F.struct(
            "example_no", "reply_start", "reply_end", "masked")))).alias("parts"))
    return parts.select("conv_id", "formatted", F.expr("transform(parts, p -> struct(p.reply_start AS start, p.reply_end AS end))")
                        .alias("replies"), F.col("parts.masked").alias("masked"))


def full_examples(examples: DataFrame) -> DataFrame:
    """(conv_id, example_no, context, reply) of the examples with a reply, as a trainer reads them."""
    return examples.filter("is_target").select(
        "conv_id", "example_no", F.expr("substr(text, 1, cast(reply_start AS int))").alias("context"),
        F.expr("substr(text, cast(reply_start AS int) + 1, cast(reply_end - reply_start AS int))").alias("reply"))


def read_turns(formatted: str = "formatted") -> Column:
    """The turns (role, text) written in a conversation's formatted text."""
    quoted = CLOSE_SQL
    return F.expr(
        f"transform(filter(split({formatted}, '{quoted}', -1), p -> p <> ''), p -> struct("
        f"{_unescaped(f'substr(p, {len(OPEN) + 1}, instr(p, {_lit(MIDDLE)}) - {len(OPEN) + 1})')} AS role, "
        f"{_unescaped(f'substr(p, instr(p, {_lit(MIDDLE)}) + {len(MIDDLE)})')} AS text))")


def read_masked(formatted: str = "formatted", replies: str = "replies") -> Column:
    """The texts under the loss mask, in order."""
    return F.expr(f"transform({replies}, r -> " + _unescaped(
        f"substr({formatted}, cast(r.start AS int) + 1, cast(r.end - r.start AS int))") + ")")


def _lit(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("\n", "\\n") + "'"


def _unescaped(sql: str) -> str:
    for raw, written in reversed(ESCAPES):
        sql = f"replace({sql}, {_lit(written)}, {_lit(raw)})"
    return sql
