"""Token counts against the tokenizers library."""

import brute
import numpy as np
import pyarrow as pa
import pytest
from corners import corner_texts
from hypothesis import given, settings, strategies as st

from stockroom.llm import token_counts as T
from stockroom.llm.queries import queries, word_vocabulary

PATH = word_vocabulary()
COLUMNS = ["doc_id", "n_bytes", "n_tokens", "over_limit"]


def _want(doc_id, text):
    n = len(brute.ids_of(text))
    return (doc_id, len((text or "").encode()), n, n > 2048)


def _key(row):
    return (row[0] is None, row[0] or 0, *row[1:])


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(alphabet="abcdelrstvmREX''''é×÷ÀÿßİΣ中🙂 \t\n\x1c ́.,'1|<>", max_size=40), max_size=12))
def test_counts_equal_the_librarys(texts):
    assert T.load(PATH).count(pa.array(texts, pa.string()), None).tolist() == [len(brute.ids_of(t)) for t in texts]


@pytest.mark.parametrize("text", [
    "don't y'all'dn't rock'n'roll 'tis ''s '.s it's' 's 'september '90s x'RE X'LL'VE", "a<|endoftext|>b <|STARTOFTEXT|>",
    "'re've'll'd'm't's", "'l 'll l'l' 'lé 'r 're're", "É'é à× ÷ Ünï'd", "'", "''''s", "I'M we'D"])
def test_contractions_and_special_tokens(text):
    assert T.load(PATH).count(pa.array([text, text[::-1], text]), None).tolist() == [
        len(brute.ids_of(t)) for t in (text, text[::-1], text)]


def test_the_table_and_the_cache_change_no_count(spark, monkeypatch):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    plain = sorted(map(tuple, T.token_counts(docs, PATH).collect()))
    table = T.frequent_lengths(docs, PATH, entries=64)
    assert 0 < len(np.flatnonzero(table.keys)) <= 64
    assert sorted(map(tuple, T.token_counts(docs, PATH, table=table).collect())) == plain
    nothing = T.LengthTable(np.zeros(0, np.uint64), np.zeros(0, np.int64))
    assert sorted(map(tuple, T.token_counts(docs, PATH, table=nothing).collect())) == plain
    monkeypatch.setattr(T, "CACHED", 50)
    counter, texts = T.Counter(PATH), pa.array([r["text"] or "" for r in docs.collect()])
    n = sum(int(x.sum()) for _, x in T.count_texts(counter, texts, None))
    assert n == sum(r[2] for r in plain)


def test_length_table():
    rng = np.random.default_rng(0)
    keys = np.unique(rng.integers(1, 2**63, 3000, dtype=np.uint64) * np.uint64(64))  # many share their first slot
    table = T.LengthTable(keys[::2], np.arange(len(keys[::2])) % 256)
    assert table.find(keys[::2]).tolist() == (np.arange(len(keys[::2])) % 256).tolist()
    assert (table.find(keys[1::2]) == -1).all()


def test_corner_cases(corner):
    rows = T.token_counts(corner, PATH)
    assert rows.columns == COLUMNS
    assert sorted(map(tuple, rows.collect()), key=_key) == sorted((_want(*x) for x in corner_texts()), key=_key)


def test_very_long_texts_are_counted_in_segments(monkeypatch):
    monkeypatch.setattr(T, "CHUNK_BYTES", 500)
    words = "it's 12 naïve <|endoftext|> plain. \n\n" * 200 + "y" * 3000 + " end"
    counter = T.Counter(PATH)
    got = list(T.count_texts(counter, pa.array(["a b", words, ""]), None))
    assert sum((x.tolist() for _, x in got), []) == [len(brute.ids_of(t)) for t in ("a b", words, "")]
    assert "".join(T.segments(words, 100)) == words and len(list(T.segments(words, 100))) > 20


def test_empty_table(no_docs):
    assert T.token_counts(no_docs, PATH).count() == 0


def test_nothing_but_one_stage_over_the_documents(spark):
    df = queries()["op12_token_counts"](spark, "/root/testdata/sf0.001")
    assert "Exchange" not in df._jdf.queryExecution().executedPlan().toString()


def test_contract(spark):
    sf = "/root/testdata/sf0.001"
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = queries()["op12_token_counts"](spark, sf)
    assert got.columns == COLUMNS and [t for _, t in got.dtypes] == ["bigint", "bigint", "bigint", "boolean"]
    assert sorted(map(tuple, got.collect())) == sorted(_want(*x) for x in docs)


def test_other_vocabularies_are_refused():
    import public_tokenizers
    with pytest.raises(ValueError):
        T.Counter(public_tokenizers.path("byte_bpe_50k.json"))
