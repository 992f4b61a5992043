"""Quality rules as a short-circuit cascade, in DataFrame functions alone.

Every rule has a measure, an expression over the text's words, and a test that
rejects. Each rule's cost (seconds) and selectivity (share rejected) are
estimated on a bounded sample of rows; the cascade runs the rules by rejection
per cost. A row that one rule rejects is not measured by those after it. The
order decides the work, never the verdict: a row is kept when no rule rejects.

Results for special rows: a null or empty text has no words and is rejected
(too few words); a null or repeated ``doc_id`` is judged row by row.
"""

from __future__ import annotations

import re
import time
from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from .common import SPACE_CHARS, stored, text_or_empty, words_of

SYMBOLS = "#*$%&|<>"
SAMPLE_ROWS = 2_000
SPAN = 5  # words of a window


@dataclass(frozen=True)
class Rule:
    """``measures``: the measures the test needs; ``rejects``: SQL over them."""
    name: str
    measures: tuple[str, ...]
    rejects: str


# The first two are the base rules; the others' limits leave ordinary prose far away.
RULES = (
    Rule("few_words", ("n_words",), "n_words < 10"),
    Rule("repeated_windows", ("n_words", "n_repeat_words"), "100 * n_repeat_words > 20 * n_words"),
    Rule("symbols", ("n_words", "n_symbols"), "100 * n_symbols > 20 * n_words"),
    Rule("word_length", ("n_words", "word_chars"), "word_chars < 2 * n_words OR word_chars > 20 * n_words"),
    Rule("repeated_lines", ("n_lines", "n_dup_lines"), "n_dup_lines >= 5 AND 100 * n_dup_lines > 50 * n_lines"),
)
BASE = ("few_words", "repeated_windows")


def _let(value: str, name: str, body: str) -> str:
    """SQL for ``body`` with ``name`` bound to ``value``, which is so evaluated once."""
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def _without(chars: str) -> str:
    return f"cast(length(translate(text__, '{chars}', '')) AS bigint)"


def _lines() -> str:
    return f"filter(split(text__, '\\n'), l -> btrim(l, '{SPACE_CHARS}') <> '')"


def _repeat_words() -> str:
    """Words in windows of SPAN words that occur twice or more in the text.

    Windows are compared by a 64-bit hash. Only texts with a repeated hash have
    their (hash, position) pairs sorted; a position whose neighbour in that
    order has its hash begins a repeated window.
    """
    keys = (f"transform(sequence(0, size(words__) - {SPAN}), i -> xxhash64("
            + ", ".join(f"get(words__, i + {k})" for k in range(SPAN)) + "))")
    pairs = "sort_array(transform(k, (h, i) -> struct(h AS h, i AS i)))"
    starts = ("sort_array(transform(filter(transform(p, (x, j) -> struct(x.i AS i, coalesce(x.h = get(p, j - 1).h, false) "
              "OR coalesce(x.h = get(p, j + 1).h, false) AS twice)), y -> y.twice), z -> z.i))")
    covered = f"aggregate(transform(s, (a, j) -> least({SPAN}, coalesce(get(s, j + 1) - a, {SPAN}))), 0L, (t, u) -> t + u)"
    return (f"CASE WHEN size(words__) < {SPAN} THEN 0L ELSE "
            + _let(keys, "k", "CASE WHEN size(k) = size(array_distinct(k)) THEN 0L ELSE "
                   + _let(pairs, "p", _let(starts, "s", covered)) + " END") + " END")


# SQL over text__ and words__.
MEASURES: dict[str, str] = {
    "n_words": "cast(size(words__) AS bigint)",
    "word_chars": _without(SPACE_CHARS),
    "n_symbols": f"cast(length(text__) AS bigint) - {_without(SYMBOLS)}",
    "n_lines": f"cast(size({_lines()}) AS bigint)",
    "n_dup_lines": _let(_lines(), "ls", "cast(size(ls) - size(array_distinct(ls)) AS bigint)"),
    "n_repeat_words": _repeat_words(),
}


def _rejects(rule: Rule) -> str:
    """The rule's test with its measures written out, so that it is evaluated only where the cascade gets to it."""
    sql = rule.rejects
    for name in sorted(rule.measures, key=len, reverse=True):
        sql = re.sub(rf"\b{name}\b", lambda m, n=name: f"({MEASURES[n]})", sql)
    return sql


def _prepared(docs: DataFrame) -> DataFrame:
    """``docs`` with text__ and words__. The words come out of a generator, so no later filter evaluates them again."""
    rows = docs.withColumn("text__", text_or_empty())
    return rows.select("*", F.explode(F.array(words_of(F.col("text__")))).alias("words__"))


def estimate(docs: DataFrame, rules: tuple[Rule, ...] = RULES, sample_rows: int = SAMPLE_ROWS) -> list[dict]:
    """Cost and selectivity of each rule, measured on a sample of about ``sample_rows`` rows; best first."""
    total = docs.count()
    fraction = min(1.0, sample_rows / max(1, total))
    sample = stored(docs.select("text").sample(False, fraction, 11), "quality-sample")
    rows, found = max(1, sample.count()), []
    _prepared(sample).agg(F.sum(F.size("words__"))).collect()  # warm-up
    for rule in rules:
        t0 = time.perf_counter()
        rejected = _prepared(sample).agg(F.sum(F.expr(_rejects(rule)).cast("int"))).first()[0]
        cost = time.perf_counter() - t0
        found.append({"rule": rule, "cost": cost, "selectivity": (rejected or 0) / rows})
    return sorted(found, key=lambda x: (-x["selectivity"] / x["cost"], x["cost"]))


def cascade(docs: DataFrame, rules: tuple[Rule, ...] = RULES, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """``docs`` with ``rejected_by__``: the first rule of the cascade that rejects the row, null for kept rows.

    One CASE in the cascade's order: a later rule's measures aren't computed
    for a row that an earlier rule has rejected.
    """
    order = [x["rule"] for x in estimate(docs, rules, sample_rows)]
    case = "CASE " + " ".join(f"WHEN {_rejects(r)} THEN '{r.name}'" for r in order) + " END"
    return _prepared(docs).select(*docs.columns, F.expr(case).alias("rejected_by__"))


def judge(docs: DataFrame, rules: tuple[Rule, ...] = RULES, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """Every measure and the cascade's verdict per row: doc_id, the measures, base_failed, kept, rejected_by."""
    order = [x["rule"] for x in estimate(docs, rules, sample_rows)]
    rows = _prepared(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"))
    rows = rows.select("doc_id", *[F.expr(sql).alias(name) for name, sql in MEASURES.items()])
    verdict = F.lit(None).cast("string")
    for rule in reversed(order):
        verdict = F.when(F.expr(rule.rejects), F.lit(rule.name)).otherwise(verdict)
    base = [r for r in RULES if r.name in BASE]
    return (rows.withColumn("base_failed", F.expr(" OR ".join(f"({r.rejects})" for r in base)))
            .withColumn("rejected_by", verdict)
            .withColumn("kept", ~F.col("base_failed") & F.col("rejected_by").isNull()))


def keep_good(docs: DataFrame) -> DataFrame:
    """The rows of ``docs``, all columns, that the cascade keeps."""
    return cascade(docs).filter("rejected_by__ IS NULL").drop("rejected_by__")
