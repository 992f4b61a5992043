"""The forms the operators take where no side of a join is small: shuffle joins throughout, same results."""

import brute
import pytest
from corners import corner_texts

from stockroom.llm import common, exact, minhash, substring


@pytest.fixture
def nothing_is_small(spark, monkeypatch):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    monkeypatch.setattr(common, "BROADCAST_ROWS", -1)
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def _key(row):
    return tuple((x is None, x if x is not None else 0) for x in row)


def test_exact(corner, nothing_is_small):
    got = [tuple(r) for r in exact.exact_dedup(corner, hash_all=True).collect()]
    assert sorted(got, key=_key) == sorted(brute.exact(corner_texts()), key=_key)
    assert exact.keep_one(corner).count() == sum(k for *_, k, _ in brute.exact(corner_texts()))


def test_substring(corner, nothing_is_small):
    got = [(r["doc_id"], r["n_words"], r["n_removed"], brute.sha(r["kept_text"]))
           for r in substring.remove_repeated(corner).collect()]
    assert sorted(got, key=_key) == sorted(brute.substring_removed(corner_texts()), key=_key)


def test_near(corner, nothing_is_small):
    got = [(r["doc_id"], r["n_shingles"], r["component_id"]) for r in minhash.near_dedup(corner).collect()]
    assert sorted(got, key=_key) == sorted(brute.near(corner_texts()), key=_key)
