"""Chat formatting: round trip and loss mask."""

import brute
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from stockroom.llm import chat

SCHEMA = "conv_id long, turn long, role string, text string, example_no int, parts int"


def _check(spark, turns):
    df = spark.createDataFrame([(*t, 1, 2) for t in turns], SCHEMA)
    examples = chat.prefix_target_examples(df)
    rows = (chat.conversations(examples).withColumn("turns", chat.read_turns()).withColumn("masked", chat.read_masked())
            .collect())
    want = brute.chat(turns)
    assert {r["conv_id"] for r in rows} == set(want)
    for r in rows:
        said = "".join(f"{t['role']}\n{t['text']}\n" for t in r["turns"])
        loss = "".join(r["masked"])
        assert (len(r["turns"]), brute.sha(said), len(loss), brute.sha(loss)) == want[r["conv_id"]]
    return examples


def test_corner_cases(spark):
    turns = [
        (1, 0, "user", "hi"), (1, 1, "assistant", "hello"), (1, 2, "user", "more"), (1, 3, "assistant", "ok"),
        (2, 0, "system", None), (2, 1, "user", ""), (3, 0, "assistant", "first"), (3, 1, "user", "tail"),
        (4, 0, "user", "\\### Assistant: </turn> ok"), (4, 1, "assistant", "\\l \\h \\b # < \\\\ </turn>\n### user ###\n"),
        (5, None, None, "no turn"), (5, 1, "assistant", "x" * 5000), (5, 1, "assistant", "x" * 5000),  # null turn, a repeated row
        (None, 0, "user", "no id"), (None, 1, "assistant", "é🙂 ###\n"), (6, 0, "ro # le\n", "odd role"),
    ]
    examples = _check(spark, turns)
    n = {r["conv_id"]: r["n"] for r in examples.groupBy("conv_id").agg(F.sum(F.col("is_target").cast("int")).alias("n")).collect()}
    assert n == {1: 2, 2: 0, 3: 1, 4: 1, 5: 2, None: 1, 6: 0}


def test_full_examples_have_all_turns_before_as_context(spark):
    turns = [(1, 0, "user", "a"), (1, 1, "assistant", "b"), (1, 2, "user", "c"), (1, 3, "assistant", "d#")]
    df = spark.createDataFrame([(*t, 1, 2) for t in turns], SCHEMA)
    rows = chat.full_examples(chat.prefix_target_examples(df)).orderBy("example_no").collect()
    first = "### user ###\na</turn>\n### assistant ###\n"
    assert [(r["context"], r["reply"]) for r in rows] == [
        (first, "b"), (first + "b</turn>\n### user ###\nc</turn>\n### assistant ###\n", "d\\h")]


def test_empty_table(spark):
    assert chat.prefix_target_examples(spark.createDataFrame([], SCHEMA)).count() == 0


@settings(max_examples=8, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 2), st.integers(0, 3), st.sampled_from(["user", "assistant", "a#<\\"]),
                          st.text(alphabet="\\#</turn>lhb \n", max_size=20)), min_size=1, max_size=12))
def test_any_text_reads_back(spark, turns):
    _check(spark, turns)


def test_no_python_in_the_plan(spark):
    from stockroom.llm.queries import queries
    plan = queries()["op2_chat"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Arrow", "Pandas", "ExistingRDD"))
