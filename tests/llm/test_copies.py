"""Substring dedup, near-dedup and components against brute force."""

import random

import brute
import numpy as np
import pyarrow as pa
from corners import corner_texts

from stockroom.llm import components, minhash, substring
from stockroom.llm.wordhash import Hasher, chunks, cut_words


def _key(row):
    return tuple((x is None, x if x is not None else 0) for x in row)


def _removed(df, length=20):
    rows = substring.remove_repeated(df, length).collect()
    return sorted(((r["doc_id"], r["n_words"], r["n_removed"], brute.sha(r["kept_text"])) for r in rows), key=_key)


def test_words_are_cut_on_six_separators():
    texts = ["a b  c", "", " \t", "é x\x0by", "end"]
    for _, group in chunks(pa.array(texts), limit=4):
        pass
    data, doc, first, end = cut_words(pa.array(texts))
    got = [(int(d), bytes(data[a:b]).decode()) for d, a, b in zip(doc, first, end)]
    assert got == [(i, w) for i, t in enumerate(texts) for w in brute.WORD.findall(t)]
    assert [g.to_pylist() for _, g in chunks(pa.array(texts), limit=4)] != [] and sum(
        len(g) for _, g in chunks(pa.array(texts), limit=4)) == len(texts)


def test_window_hashes_depend_on_content_alone():
    texts = pa.array(["x y z a b c", "a b c", "zz a b c d"])
    data, doc, first, end = cut_words(texts)
    h = Hasher(1)
    word = h.words(data, first, end)
    starts = np.array([3, 6, 10])
    assert len(set(h.windows(word, starts, starts + 3).tolist())) == 1


def test_substrings_of_corner_cases(corner):
    assert _removed(corner) == sorted(brute.substring_removed(corner_texts()), key=_key)


def test_substrings_of_random_texts(spark):
    rng = random.Random(7)
    passages = [" ".join(f"p{k}w{i}" for i in range(rng.randint(5, 40))) for k in range(12)]
    texts = []
    for d in range(120):
        parts = [rng.choice(passages) if rng.random() < 0.5 else " ".join(f"u{rng.randint(0, 10**6)}" for _ in range(rng.randint(0, 15)))
                 for _ in range(rng.randint(0, 6))]
        texts.append((rng.randint(0, 10**6), " ".join(parts)))
    texts = list({d: (d, t) for d, t in texts}.values())
    df = spark.createDataFrame(texts, "doc_id long, text string").repartition(5)
    assert _removed(df) == sorted(brute.substring_removed(texts), key=_key)
    assert _removed(df, 8) == sorted(brute.substring_removed(texts, 8), key=_key)


def _near(df):
    return sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in minhash.near_dedup(df).collect()), key=_key)


def test_near_copies_of_corner_cases(corner):
    assert _near(corner) == sorted(brute.near(corner_texts()), key=_key)


def test_crowded_region_loses_no_link(spark):
    """One large group of near copies, crowded regions and chains: every component as by all pairs."""
    rng = random.Random(8)
    base = [f"b{i}" for i in range(150)]
    texts = []
    for d in range(260):
        words = list(base)
        for _ in range(rng.choice([0, 1, 2, 3, 5, 8])):
            words[rng.randrange(len(words))] = f"e{rng.randint(0, 10**6)}"
        texts.append((d * 3 + 1, " ".join(words)))
    chain = [f"c{i}" for i in range(100)]
    for k in range(12):  # each a near copy of the next, the ends far apart
        chain = [*chain[3:], f"n{k}", f"m{k}", f"o{k}"]
        texts.append((5000 - k, " ".join(chain)))
    df = spark.createDataFrame(texts, "doc_id long, text string").repartition(4)
    assert _near(df) == sorted(brute.near(texts), key=_key)


def test_keep_one_keeps_whole_rows(corner):
    kept = minhash.keep_one(corner.dropDuplicates(["doc_id", "text"]))
    assert kept.columns == corner.columns
    want = {d for d, _, c in brute.near(corner_texts()) if d == c}
    assert {r["doc_id"] for r in kept.collect()} == want


def test_empty_tables(spark, no_docs):
    assert substring.remove_repeated(no_docs).count() == 0
    assert minhash.near_dedup(no_docs).count() == 0 and minhash.keep_one(no_docs).count() == 0


def test_components_of_a_path_and_a_star(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(200, 200)]
    nodes = sorted({x for e in edges for x in e} | {300})
    labels = components.connect(spark.createDataFrame([(v, v) for v in nodes], "v long, c long"),
                                spark.createDataFrame(edges, "a long, b long"))
    got = {r["v"]: r["c"] for r in labels.collect()}
    assert all(got[v] == (0 if v <= 40 else 100 if v < 200 else v) for v in nodes)
