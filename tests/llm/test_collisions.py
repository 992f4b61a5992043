"""Long words and long word sequences that polynomial hashes modulo 2**64 cannot tell apart."""

import brute
import numpy as np
import pyarrow as pa
import pytest

from stockroom.llm import bpe, minhash, packing, substring
from stockroom.llm.queries import word_vocabulary
from stockroom.llm.wordhash import Hasher, cut_words, sequence_keys


def thue_morse(n, a, b):
    """Two sequences of ``n`` symbols that swap ``a`` and ``b`` everywhere."""
    bits = [bin(i).count("1") % 2 for i in range(n)]
    return [(a, b)[x] for x in bits], [(b, a)[x] for x in bits]


LONG = ["".join(x) for x in thue_morse(1024, "a", "b")]
ROWS = [" ".join("one two three four five".split() + x) for x in thue_morse(1024, "cat", "dog")]


@pytest.mark.parametrize("n", [2, 64, 65, 1024, 4096])
@pytest.mark.parametrize("seed", [0, 11, 17])
def test_words_of_two_letters_differ(n, seed):
    texts = pa.array(["".join(x) for x in thue_morse(n, "a", "b")])
    data, _, first, end = cut_words(texts)
    assert len(set(Hasher(seed).words(data, first, end).tolist())) == 2


def test_sequences_of_two_words_differ():
    a, b = sequence_keys(pa.array([*ROWS, ROWS[0].replace(" ", " \n"), ""]))
    assert a[0] == a[2] and b[0] == b[2] and len(set(a.tolist())) == 3 and len(set(b.tolist())) == 3


def test_ids_of_both_words():
    path = word_vocabulary()
    texts = [f"{LONG[0]} and {LONG[1]}"]
    for encoder in (bpe.load(path).encode, packing.load(path).ids):
        counts, ids = encoder(pa.array(texts))
        assert np.asarray(ids).tolist() == brute.ids_of(texts[0])


def _docs(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string")


def test_substring_keeps_what_differs(spark):
    around = [f"w{i}" for i in range(25)]
    one = [(i, " ".join(around[:10] + [w] + around[10:19])) for i, w in enumerate(LONG)]
    two = [(10 + i, r) for i, r in enumerate(ROWS)]
    rows = one + two
    got = sorted((r["doc_id"], r["n_words"], r["n_removed"], brute.sha(r["kept_text"]))
                 for r in substring.remove_repeated(_docs(spark, rows)).collect())
    assert got == sorted(brute.substring_removed(rows))


def test_near_links_only_what_is_alike(spark):
    rows = [(i, f"a b {w} c d") for i, w in enumerate(LONG)] + [(10 + i, r) for i, r in enumerate(ROWS)]
    got = sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in minhash.near_dedup(_docs(spark, rows)).collect())
    assert got == sorted(brute.near(rows))
