"""Secret scans: fixed patterns, and character Markov models of random strings against ordinary identifiers.

The patterns find spans of three kinds (``assign``, ``access``, ``hex``), each
leftmost and non-overlapping. Two first-order Markov models over characters are
trained on labelled strings of bounded samples, one of the rows with pattern
spans and one of those without: strings inside pattern spans are random, words of
rows without any are ordinary. A long run of key characters
outside the pattern spans, or what these leave of it, is a further span
(``random``) when its mean log-likelihood ratio per transition says random.
DataFrame functions only; spans are gathered in blocks, so that a text's cost
grows with its length, not with the square of its spans.

Results for special rows: a null or empty text has no spans; a null or repeated
``doc_id`` is scanned row by row. Positions are code points, ends exclusive.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from .common import SPACE_RUN, stored, text_or_empty

# The patterns of the three kinds.
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ASSIGN_LEAST = 12
ACCESS = r"AKIA[A-Z0-9]{14,}"  # a maximal run of 18 or more, as AKIA[A-Z0-9]+ with shorter ones dropped
HEX = r"[0-9a-f]{16,}"         # likewise for [0-9a-f]+ and 16
# A text with a span of any kind has a match of this.
LABELLED = f"{ASSIGN[:-2]}{{{ASSIGN_LEAST},}})|{ACCESS}|{HEX}"
KINDS = ("assign", "access", "hex", "random")

# Runs the models judge: so many key characters, digits and letters both among them.
CANDIDATE = r"[A-Za-z0-9+_=-]{20,}"
# Nats per transition in favour of random strings.
THRESHOLD = 0.6
# Pseudo-transitions that smooth each character's row.
SMOOTHING = 10
# Bound of the training sample, in rows of each label.
SAMPLE_ROWS = 20_000

ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=.-"
CLASSES = len(ALPHABET) + 1  # class 0: any other character

# Spans and pieces are gathered in blocks of so many before the blocks are put together.
BLOCK = 256


def _let(name: str, value: str, body: str) -> str:
    """SQL for ``body`` with ``name`` bound to ``value``, which is so evaluated once."""
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def _blocks(array: str) -> str:
    """SQL for the array named ``array``, not empty, cut into arrays of BLOCK elements."""
    return f"transform(sequence(0, (size({array}) - 1) div {BLOCK}), b -> slice({array}, b * {BLOCK} + 1, {BLOCK}))"


def _found(pattern: str, rank: int, text: str = "text__", least: int = 0) -> str:
    """SQL for the spans of the matches of ``pattern``: between two matches lies one piece of the split text."""
    quoted = pattern.replace("\\", "\\\\").replace("'", "\\'")
    spans = "array<struct<start:int,rank:int,end:int,value:string>>"
    hits = (f"zip_with(split({text}, '{quoted}', -1), regexp_extract_all({text}, '{quoted}', 0), "
            "(p, h) -> named_struct('piece', p, 'hit', h, 'value', h))")
    if least:
        hits = (f"zip_with({hits}, regexp_extract_all({text}, '{quoted}', 2), "
                "(x, v) -> named_struct('piece', x.piece, 'hit', x.hit, 'value', v))")
    block = (
        f"aggregate(block, named_struct('at', a.at, 'out', cast(array() AS {spans})), "
        f"(c, x) -> named_struct('at', c.at + length(x.piece) + coalesce(length(x.hit), 0), 'out', "
        f"CASE WHEN x.hit IS NULL THEN c.out ELSE concat(c.out, array(named_struct("
        f"'start', c.at + length(x.piece), 'rank', {rank}, 'end', c.at + length(x.piece) + length(x.hit), "
        f"'value', x.value))) END))")
    step = _let("r", block, "named_struct('at', r.at, 'out', concat(a.out, array(r.out)))")
    found = _let("hits", hits, f"flatten(aggregate({_blocks('hits')}, "
                               f"named_struct('at', 0, 'out', cast(array() AS array<{spans}>)), "
                               f"(a, block) -> {step}, a -> a.out))")
    return (f"CASE WHEN {text} RLIKE '{quoted}' THEN filter({found}, s -> length(s.value) >= {least}) "
            f"ELSE cast(array() AS {spans}) END")


def _replaced(text: str, spans: str, whole: str, rest: str) -> str:
    """SQL for ``text`` with its ``spans`` (some, by start) replaced by ``whole``, or by ``rest`` where one overlaps
    those before it; both may use the span ``s`` and ``c.at``, where the text is done up to."""
    block = (
        "aggregate(block, named_struct('at', a.at, 'out', ''), (c, s) -> CASE WHEN s.start < c.at "
        f"THEN named_struct('at', greatest(c.at, s.end), 'out', concat(c.out, {rest})) "
        f"ELSE named_struct('at', s.end, 'out', concat(c.out, substr(part, c.at - a.at + 1, s.start - c.at), {whole})) END)")
    reach = "substr(a.rest, 1, greatest(0, array_max(transform(block, s -> s.end)) - a.at))"
    step = _let("part", reach, _let("r", block, "named_struct('at', r.at, 'rest', substr(a.rest, r.at - a.at + 1), "
                                                "'out', concat(a.out, array(r.out)))"))
    return (f"aggregate({_blocks(spans)}, named_struct('at', 0, 'rest', {text}, 'out', cast(array() AS array<string>)), "
            f"(a, block) -> {step}, a -> concat_ws('', a.out, a.rest))")


def with_patterns(docs: DataFrame) -> DataFrame:
    """``docs`` with ``text__`` and ``base__``, the pattern spans by (start, kind) with their secret value."""
    rows = docs.withColumn("text__", text_or_empty())
    rows = (rows.withColumn("assign__", F.expr(_found(ASSIGN, 0, least=ASSIGN_LEAST)))
            .withColumn("access__", F.expr(_found(ACCESS, 1))).withColumn("hex__", F.expr(_found(HEX, 2))))
    return rows.withColumn("base__", F.sort_array(F.concat("assign__", "access__", "hex__"))).drop(
        "assign__", "access__", "hex__")


def _class(char: str) -> str:
    return f"instr('{ALPHABET}', {char})"


def train(docs: DataFrame, sample_rows: int = SAMPLE_ROWS) -> list[float]:
    """Log-likelihood ratio (random over ordinary) of every character transition, row by row.

    Random strings are the values inside pattern spans, of at most about
    ``sample_rows`` of the rows that have one, however rare these are; ordinary
    ones are the words of four or more characters of as many rows without any
    span. A table without either gives ratios of zero and so no further span.
    """
    rows = docs.select(text_or_empty().alias("text"))
    rows = rows.select("text", F.col("text").rlike(LABELLED).alias("labelled"))
    total, labelled = rows.agg(F.count(F.lit(1)), F.count_if("labelled")).first()
    share = [min(1.0, sample_rows / max(1, n)) for n in (total - labelled, labelled)]
    rows = rows.filter(F.rand(23) < F.when(F.col("labelled"), share[1]).otherwise(share[0]))
    rows = stored(with_patterns(rows).select("labelled", "text__", F.col("base__.value").alias("values")), "secrets-sample")
    ordinary = rows.filter("NOT labelled").select(
        F.lit(0).alias("label"), F.explode(F.split("text__", SPACE_RUN)).alias("s")).filter("length(s) >= 4")
    random = rows.select(F.lit(1).alias("label"), F.explode("values").alias("s"))
    strings = random.unionByName(ordinary).groupBy("label", "s").agg(F.count(F.lit(1)).alias("n"))
    steps = strings.select("label", "n", F.split("s", "").alias("c")).select("label", "n", F.explode(F.expr(
        f"transform(sequence(1, size(c) - 1), i -> struct({_class('c[i - 1]')} AS a, {_class('c[i]')} AS b))")).alias("step"))
    counted = steps.groupBy("label", "step.a", "step.b").agg(F.sum("n").alias("n"))
    tables = [[0] * (CLASSES * CLASSES) for _ in range(2)]
    for label, a, b, n in counted.collect():  # at most two rows per pair of classes
        tables[label][a * CLASSES + b] += n
    if not all(map(sum, tables)):
        return [0.0] * (CLASSES * CLASSES)
    logs = [_log_transitions(t) for t in tables]
    return [random - ordinary for ordinary, random in zip(*logs)]


def _log_transitions(counts: list[int]) -> list[float]:
    """Log-probability of every transition; a row is smoothed towards how often each character occurs at all."""
    total = sum(counts)
    share = [(sum(counts[b::CLASSES]) + 0.5) / (total + 0.5 * CLASSES) for b in range(CLASSES)]
    out = []
    for a in range(CLASSES):
        row = counts[a * CLASSES:(a + 1) * CLASSES]
        out += [math.log((n + SMOOTHING * p) / (sum(row) + SMOOTHING)) for n, p in zip(row, share)]
    return out


def scan(docs: DataFrame, model: list[float] | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with ``spans__``: all spans (start, rank of the kind, end, value) by start, then kind."""
    if model is None:
        model = train(docs)
    rows = with_patterns(docs)
    table = F.split(F.lit(",".join(f"{x:.6f}" for x in model)), ",").cast("array<double>")
    blank = _replaced("text__", "base__", "repeat(' ', s.end - s.start)", "repeat(' ', greatest(0, s.end - c.at))")
    rows = rows.withColumn("outside__", F.when(F.col("text__").rlike(CANDIDATE), F.expr(
        f"CASE WHEN size(base__) > 0 THEN {blank} ELSE text__ END")))
    rows = rows.withColumn("runs__", F.expr(
        f"filter({_found(CANDIDATE, 3, 'outside__')}, s -> s.value RLIKE '[0-9]' AND s.value RLIKE '[A-Za-z]')"))
    score = _let("c", "split(s.value, '')", "aggregate(sequence(1, size(c) - 1), 0.0D, (t, i) -> t + get(table__, "
                 f"{_class('c[i - 1]')} * {CLASSES} + {_class('c[i]')}))")
    rows = rows.withColumn("table__", F.when(F.size("runs__") > 0, table))
    rows = rows.withColumn("random__", F.expr(
        f"CASE WHEN size(runs__) > 0 THEN filter(runs__, s -> {score} >= {threshold} * (length(s.value) - 1)) END"))
    return (rows.withColumn("spans__", F.when(F.size("random__") > 0, F.sort_array(F.concat("base__", "random__")))
                            .otherwise(F.col("base__"))).drop("outside__", "runs__", "table__", "random__"))


def joined(spans: str) -> Column:
    """``kind:start:end`` of each span, comma-joined."""
    names = ", ".join(f"'{k}'" for k in KINDS)
    return F.expr(f"array_join(transform({spans}, s -> concat(element_at(array({names}), s.rank + 1), ':', "
                  "cast(s.start AS string), ':', cast(s.end AS string))), ',')")


def report(docs: DataFrame, model: list[float] | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """Per row: doc_id, spans of the patterns and of all kinds as text, and the counts by kind."""
    rows = scan(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), model, threshold)
    count = [F.expr(f"cast(size(filter(spans__, s -> s.rank = {i})) AS bigint)").alias(f"n_{k}")
             for i, k in enumerate(KINDS)]
    return rows.select("doc_id", *count, joined("base__").alias("base_spans"), joined("spans__").alias("spans"))


def redact(docs: DataFrame, mark: str = "<SECRET>", threshold: float = THRESHOLD) -> DataFrame:
    """``docs``, all columns, with every span replaced by ``mark``; spans that overlap become one.

    Where the text changes and there is an ``n_chars``, that is counted anew.
    """
    rows = scan(docs, None, threshold)
    changed = F.size("spans__") > 0
    text = F.expr(_replaced("text__", "spans__", f"'{mark}'", "''"))
    rows = rows.withColumn("new_text__", F.when(changed, text).otherwise(F.col("text")))
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        rows = rows.withColumn("n_chars", F.when(changed, F.length("new_text__").cast(kind)).otherwise(F.col("n_chars")))
    return rows.withColumn("text", F.col("new_text__")).select(*docs.columns)
