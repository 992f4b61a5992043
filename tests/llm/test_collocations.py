"""Collocations against plain counting, and the filters against dictionaries."""

import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from corners import corner_texts
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from stockroom.llm import collocations as C, common

COLUMNS = ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]


def plain(rows, least=30, top=2000):
    """rows: (lang, text)."""
    f, n = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", text):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            for k in range(1, 5):
                for i in range(len(words) - k + 1):
                    f[lang][tuple(words[i:i + k])] += 1
    out = []
    for lang, counts in f.items():
        phrases = {p: a for p, a in counts.items() if len(p) > 1 and a >= least}
        found = []
        for p, a in phrases.items():
            cuts = [(2000000 * a // (counts[p[:k]] + counts[p[k:]]), k, counts[p[:k]], counts[p[k:]]) for k in range(1, len(p))]
            score, _, l, r = min(cuts)
            if not any(len(q) > len(p) and 100 * b >= 80 * a and any(q[i:i + len(p)] == p for i in range(len(q) - len(p) + 1))
                       for q, b in phrases.items()):
                found.append((-score, -a, " ".join(p).encode(), l, r))
        for rank, (score, a, phrase, l, r) in enumerate(sorted(found)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, l, r, n[lang], -score))
    return sorted(out)


def _frame(spark, rows):
    return spark.createDataFrame(rows, "lang string, text string").select(
        "*", F.lit(3).alias("a"), F.lit(1).alias("block"), F.lit("x").alias("word"), F.lit("y").alias("ids"), F.lit(None).alias("n"))


def _got(spark, rows, parts=3, **options):
    df = C.collocations(_frame(spark, rows).repartition(parts), **options)
    assert df.columns == COLUMNS
    assert [t for _, t in df.dtypes] == ["string", "bigint", "string", *["bigint"] * 5]
    return sorted(map(tuple, df.collect()))


def _corpus(seed, n=120):
    rng = np.random.default_rng(seed)
    words = ["the", "The", "of", "and", "naïve", "中文", "x-y", "'s", "a b", "\x1c", "Ab", "É"]
    marks = [" ", "  ", "\t", " ", " ", ". ", ",", "\n", " ; ", "\x0b", "!?"]
    out = []
    for i in range(n):
        k = int(rng.integers(0, 90))
        text = "".join(words[min(len(words) - 1, int(rng.geometric(0.25)) - 1)] + marks[int(rng.integers(0, len(marks)))] for _ in range(k))
        out.append(((None, "en", "und", "fr")[i % 4], text if i % 9 else None))
    out += [("en", "New York City hall is in new york city")] * 40 + [("de", "new york")] * 29
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_plain_counting(spark, seed):
    rows = _corpus(seed)
    want = plain(rows)
    assert len(want) > 15 and {r[0] for r in want} > {'en', 'und'}
    assert _got(spark, rows) == want


def test_many_slices_and_levels_and_a_full_bitmap(spark, monkeypatch):
    rows = _corpus(3)
    want = plain(rows, least=3, top=50)
    for name, value in {"SLICE_ENTRIES": 20, "LEVEL_BITS": 2, "BLOCK_BYTES": 1500, "CHUNK_BYTES": 300}.items():
        monkeypatch.setattr(C, name, value)
    monkeypatch.setattr(C, "pair_bitmap", lambda pairs, id_bits: np.full(4096, 255, np.uint8))  # every pair hits
    assert C.Shape(20, 4000, 2).slice_bits > 3 * C.LEVEL_BITS
    assert C.blocks_of(_frame(spark, rows).coalesce(1)).count() > 5
    assert _got(spark, rows, least=3, top=50) == want


def test_shuffle_joins_throughout(spark, monkeypatch):
    monkeypatch.setattr(common, "BROADCAST_ROWS", -1)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        rows = _corpus(5)
        assert _got(spark, rows) == plain(rows)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_corner_cases(spark, corner, no_docs):
    rows = [("en", t) for _, t in corner_texts()]
    got = sorted(map(tuple, C.collocations(corner).collect()))
    assert got == plain(rows) and got
    assert C.collocations(no_docs).count() == 0
    assert _got(spark, [("en", "just a few words")]) == []


def test_one_enormous_text_and_word(spark):
    text = "alpha beta gamma delta. " * 300_000 + "z" * 200_000 + " end"
    rows = [("en", text)]
    got = _got(spark, rows, parts=1)
    assert got == [("en", 1, "alpha beta gamma delta", 300_000, 300_000, 300_000, 1_200_002, 1_000_000)]
    parts = list(C.segments(("ab cd,ef gh\n" * 50 + "tail").encode(), 40))
    assert "".join(parts) == "ab cd,ef gh\n" * 50 + "tail" and all(p[-1] in ",\n" for p in parts[:-1])


@pytest.mark.parametrize("half", [2, 6, 34, 50, 64])
def test_permutation_is_turned_back(half):
    rng = np.random.default_rng(half)
    left, right = (rng.integers(0, 2**half, 500, dtype=np.uint64) if half < 64 else rng.integers(0, 2**64, 500, dtype=np.uint64)
                   for _ in range(2))
    p = C.Permutation(half)
    a, b = p.apply(left, right)
    assert (a <= p.mask).all() and (b <= p.mask).all()
    back = p.undo(a, b)
    assert (back[0] == left).all() and (back[1] == right).all()
    if half == 2:
        every = np.array([(x, y) for x in range(4) for y in range(4)], dtype=np.uint64)
        assert len(set(zip(*(x.tolist() for x in p.apply(every[:, 0], every[:, 1]))))) == 16


@settings(max_examples=80, deadline=None)
@given(st.sampled_from([2, 6, 34, 64]), st.integers(0, 6),
       st.dictionaries(st.tuples(st.integers(0, 2**64 - 1), st.integers(0, 2**64 - 1)), st.integers(1, 10**12), max_size=60))
def test_filters_lose_nothing(half, prefix, entries):
    prefix = min(prefix, half)
    mask = 2**half - 1
    want = {(a & mask, b & mask): n for (a, b), n in entries.items()}
    keys = sorted(want)
    left, right = (np.array([k[i] for k in keys], dtype=np.uint64) for i in range(2))
    batch = C._sliced(left, right, np.array([want[k] for k in keys], dtype=np.int64), half, prefix, 9)
    got = {}
    for row in pa.Table.from_batches([batch]).to_pylist():
        a, b, n = C.decode(row["slice"], *(row[c] for c in ("quotient_bits", "runs", "remainders", "more", "counts", "large")), half, prefix)
        assert row["source"] == 9 and all(x >> (half - prefix) == row["slice"] for x in a.tolist())
        got |= dict(zip(zip(a.tolist(), b.tolist()), n.tolist()))
    assert got == want


def test_exact_beyond_64_bits(spark):
    big = 3 * 10**13
    grams = spark.createDataFrame([([1], 2 * big), ([2], 2 * big - 1), ([1, 2], big + 1)], "ids array<long>, a long")
    row = C.scored(grams).first()
    assert (row["a"], row["l"], row["r"]) == (big + 1, 2 * big, 2 * big - 1)
    assert row["score"] == 2000000 * (big + 1) // (4 * big - 1)


def test_contract_on_a_small_table(spark):
    from stockroom.llm.queries import queries
    sf = "/root/testdata/sf0.001"
    rows = [(r["lang"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    assert sorted(map(tuple, queries()["op11_collocations"](spark, sf).collect())) == plain(rows)
