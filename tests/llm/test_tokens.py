"""BPE and packing against the tokenizers library."""

import random

import brute
import numpy as np
import pyarrow as pa
import pytest
from corners import corner_texts
from hypothesis import given, settings, strategies as st

from stockroom.llm import bpe, packing
from stockroom.llm.queries import word_vocabulary

PATH = word_vocabulary()


def _split(counts, ids):
    at, out = 0, []
    for n in counts:
        out.append(ids[at:at + n].tolist())
        at += n
    return out


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="abcdeé́ßΣİ中🙂 \t\x1c\u00a0.,'1|<>", max_size=40), max_size=8))
def test_ids_equal_the_librarys(texts):
    want = [brute.ids_of(t) for t in texts]
    for encoder in (bpe.load(PATH).encode, packing.load(PATH).ids):
        assert _split(*encoder(pa.array(texts, pa.string()))) == want


def test_special_tokens_and_one_enormous_word():
    rng = random.Random(3)
    texts = ["a<|endoftext|>b <|startoftext|>", "".join(rng.choice("abcdefgh") for _ in range(20_000)), "İΣς ß"]
    want = [brute.ids_of(t) for t in texts]
    assert _split(*bpe.load(PATH).encode(pa.array(texts))) == want
    assert _split(*packing.load(PATH).ids(pa.array(texts))) == want


def test_merge_takes_the_leftmost_lowest_rank():
    rank = {1 << 32 | 1: 0 << 32, 2 << 32 | 2: 1 << 32}  # (1, 1) -> 2, (2, 2) -> 3
    assert bpe.merge_pairs([1, 1, 1], rank, [2, 3]) == [2, 1]
    assert bpe.merge_pairs([1, 1, 1, 1], rank, [2, 3]) == [3]
    assert bpe.merge_pairs([1] * 5, rank, [2, 3]) == [3, 1]
    assert bpe.merge_pairs([7], rank, [2, 3]) == [7]


def test_round_trip_of_corner_cases(corner):
    rows = bpe.round_trip(corner, PATH).collect()
    got = sorted((r["doc_id"] is None, r["doc_id"] or 0, r["ids"], r["decoded"]) for r in rows)
    want = []
    for d, t in corner_texts():
        ids = brute.ids_of(t)
        want.append((d is None, d or 0, ids, brute.tokenizer().decode(ids, skip_special_tokens=False)))
    assert got == sorted(want)
    again = bpe.decode(bpe.encode(corner, PATH), PATH).collect()
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0, r["ids"], r["decoded"]) for r in again) == got


def test_empty_tables(spark, no_docs):
    assert bpe.round_trip(no_docs, PATH).count() == 0
    assert packing.pack(no_docs, PATH).count() == 0


def test_packing_of_corner_cases(spark, corner):
    docs = corner.repartition(3)
    with_ids = docs.filter("doc_id IS NOT NULL").dropDuplicates(["doc_id"])
    rows = packing.pack(with_ids, PATH, window=64).collect()
    texts = dict((d, t) for d, t in corner_texts() if d is not None)
    fill = {}
    for r in rows:
        want = (brute.ids_of(texts[r["doc_id"]]) + [2])[r["start"]:r["start"] + r["length"]]
        assert np.frombuffer(r["ids"], "<u4").tolist() == want
        fill.setdefault(r["sequence_id"], []).append((r["offset"], r["length"], r["sequence_tokens"], r["padded_tokens"]))
    last = max(fill)
    for s, pieces in fill.items():
        at = 0
        for a, n, _, _ in sorted(pieces):
            assert a == at
            at += n
        assert at == 64 or s == last
        assert {p[2] for p in pieces} == {at}
        assert {p[3] for p in pieces} == {at if at & (at - 1) == 0 else 64}
    assert sum(r["length"] for r in rows) == sum(len(brute.ids_of(t)) + 1 for t in texts.values())
    # null and repeated ids are documents of their own
    every = packing.pack(docs, PATH).collect()
    assert sum(r["length"] for r in every) == sum(len(brute.ids_of(t)) + 1 for _, t in corner_texts())


def test_contract_on_a_small_table(spark):
    import pyarrow.parquet as pq
    from stockroom.llm.queries import queries
    sf = "/root/testdata/sf0.001"
    docs = {r["doc_id"]: r["text"] for r in pq.read_table(f"{sf}/documents.parquet").to_pylist()}
    got = sorted(tuple(r) for r in queries()["op1_bpe"](spark, sf).collect())
    assert got == sorted(brute.bpe(d, t) for d, t in docs.items())
    brute.pack_check([tuple(r)[:7] for r in queries()["op5_packing"](spark, sf).collect()], docs)


def test_other_vocabularies_are_refused(tmp_path):
    import public_tokenizers
    with pytest.raises(ValueError):
        bpe.Bpe(public_tokenizers.path("byte_bpe_50k.json"))
