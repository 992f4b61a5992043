"""The registered queries against SQL, and the pipeline stage by stage against brute force."""

import brute
import pytest

SF = "/root/testdata/sf0.001"


def _rows(rows):
    return sorted((tuple(r) for r in rows), key=repr)


def test_queries_match_their_sql(spark):
    import duckdb

    from stockroom.llm.oracle import ORACLE
    from stockroom.llm.queries import queries
    con = duckdb.connect()
    for t in ("documents", "pages", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    for name, sql in ORACLE.items():
        df = queries()[name](spark, SF)
        want = con.sql(sql)
        assert sorted(df.columns) == sorted(want.columns), name
        assert _rows(df.select(*want.columns).collect()) == _rows(want.fetchall()), name


def test_registered():
    from __spark_entry__ import oracle_sql, queries
    names = set(queries())
    assert {n.split("_")[0] for n in names if n.startswith("op")} == {f"op{i}" for i in range(1, 14)}
    assert "pipeline" in names and "pipeline" not in oracle_sql()


def kept_by_rules(text):
    n, chars, symbols, dup, rep, base = brute.quality(text)
    lines = [x for x in (text or "").split("\n") if brute.WORD.search(x)]
    return not (base or 100 * symbols > 20 * n or chars < 2 * n or chars > 20 * n or dup >= 5 and 100 * dup > 50 * len(lines))


def test_pipeline_equals_brute_force(spark):
    import corpus_pipeline
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    rows = [(d, t) for d, t in docs if kept_by_rules(t)]
    once = {d for d, _, _, kept, _ in brute.exact(rows) if kept}
    rows = [x for x in rows if x[0] in once]
    first = {d for d, _, c in brute.near(rows) if d == c}
    texts = {}
    for d, t in rows:
        if d in first:
            out, at = "", 0
            for a, _, b in brute.base_spans(t):
                if a >= at:
                    out += t[at:a] + "<SECRET>"
                at = max(at, b)
            texts[d] = out + t[at:]
    got = corpus_pipeline.run(spark, SF).collect()
    brute.pack_check([tuple(r)[:7] for r in got], texts)


@pytest.mark.parametrize("k", range(4))
def test_stages_bear_corner_cases(spark, corner, no_docs, k):
    import corpus_pipeline
    _, stage = corpus_pipeline.STAGES[k]
    docs = corner.select("doc_id", "text", "lang", "source", "n_chars")
    out = stage(spark, docs, SF)
    assert out.columns == docs.columns and out.schema["n_chars"].dataType == docs.schema["n_chars"].dataType
    assert 0 < out.count() <= docs.count()
    assert stage(spark, no_docs, SF).count() == 0
