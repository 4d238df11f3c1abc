import os
import random

import pytest

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    import corpus_pipeline as p

    rng = random.Random(5)
    words = {"en": "the and of thing is that which", "fr": "le la été où que des pour"}
    text = lambda k: " ".join(rng.choices(words[k].split(), k=40)) + f" mail a.b{rng.randint(0, 99)}@x.example.org"
    rows = [(i, text(k), k, f"s{i % 3}", 0) for i, k in enumerate(rng.choices(list(words), k=120))]
    rows += [(500, rows[3][1], rows[3][2], "s1", 0), (501, None, "en", "s1", 0), (502, "123 456", "fr", None, 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    said = p.language_id(spark, docs, "").persist()
    assert said.columns == docs.columns and {r["doc_id"] for r in said.collect()} == {*range(120), 500}
    one = p.near_duplicates(spark, said, "").persist()
    assert {r["doc_id"] for r in one.collect()} == set(range(120))
    clean = p.personal_data(spark, one, "").persist()
    assert all("@" not in r["text"] and r["n_chars"] == len(r["text"]) for r in clean.collect())
    mixed = p.source_mix(spark, clean, "").persist()
    assert 0 < mixed.count() <= 120 and mixed.columns == docs.columns
    assert p.encode(spark, mixed, "").count() == mixed.count()


def test_near_duplicates_by_five_words(spark):
    import corpus_pipeline as p

    w = [f"w{i}" for i in range(50)]
    near = [*w[:25], "other", *w[26:]]  # 41 of 51 shingles of five words in common (0.804), 43 of 51 of four (0.843)
    less = [*w[:12], "one", *w[13:38], "two", *w[39:]]  # 36 of 56 of five words: not a near copy of either
    rows = [(i, " ".join(x), "en", "s", 0) for i, x in enumerate([w, near, less], 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    assert sorted(r["doc_id"] for r in p.near_duplicates(spark, docs, "").collect()) == [1, 3]


def test_empty(spark):
    import corpus_pipeline as p

    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in p.STAGES:
        assert stage(spark, docs, "").count() == 0


@pytest.mark.skipif(not os.path.isdir(SF), reason="given tables are not here")
def test_op5_against_sql(spark):
    import duckdb

    from quillmill.llm import queries

    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM read_parquet('{SF}/pages.parquet')")
    want = sorted(con.execute(queries.ORACLE_SQL["op5_warc"]).fetchall())
    assert sorted(tuple(r) for r in queries.op5_warc(spark, SF).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()) == want


def test_edge_rows_and_clashing_columns(spark):
    """Nulls, repeated ids, very long texts and columns with the operators' own names, in every stage."""
    import corpus_pipeline as p

    extra = ["kept_id", "component_id", "class_id", "lang_pred", "score", "redacted", "spans", "n_tokens", "topic", "probability", "kept", "id", "sig", "ids", "text_"]
    rows = [(i, f"the and of thing number {i} is that which x{i} " * 12, "en", f"s{i % 2}", 0) for i in range(60)]
    rows += [(None, None, None, None, None), (None, "the thing that is without an id " * 9, "en", "s0", 0), (7, rows[7][1], "en", "s1", 0), (70, "the of and that which is " * 20_000, "en", None, 0), (71, "", "en", "s0", None)]
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} string" for c in extra)
    docs = spark.createDataFrame([(*r, *([f"v{r[0]}"] * len(extra))) for r in rows], schema)
    for name, stage in p.STAGES:
        out = stage(spark, docs, "").collect()
        if name == "encode":
            assert len(out) == len(rows)
            continue
        assert list(out[0].asDict()) == docs.columns, name
        assert all(r[c] == f"v{r['doc_id']}" for r in out for c in extra), name
        ids = [r["doc_id"] for r in out]
        assert len(ids) <= len(rows) and {70} <= set(ids) or name == "source_mix", name
        if name == "near_duplicates":
            assert ids.count(7) == 2 and ids.count(None) == 2  # rows that share an id stand together, null ids stay
        if name == "personal_data":
            assert len(ids) == len(rows)
