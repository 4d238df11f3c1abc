import os

import pytest

import __spark_entry__ as entry
from quillmill.plans import catalog

SF = "/root/testdata/sf0.001"


def test_oracles_have_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert catalog.FLAGSHIP in entry.queries()


@pytest.mark.skipif(not os.path.isdir(SF), reason="given tables are not here")
@pytest.mark.parametrize("name", ["doc_verdicts", "strip_quoted_conversations", "shingle_pairs", "metering_admission", "chat_history", "cost_by_model", "budget_trim_by_source", "planted_secrets", "secret_findings", "html_clean", "commits_mined", "metering_refunds", "blame_lines", "prompts", "answers_parsed", "shingle_sets", "near_dup_survivors", "triage_budget", "mined_all", "put_back", "usage_compacted", "files_of_all_authors"])
def test_against_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for f in os.listdir(SF):
        path = f"{SF}/{f}" + ("/*" if os.path.isdir(f"{SF}/{f}") else "")
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM read_parquet('{path}')")
    df = entry.queries()[name](spark, SF)
    cols = sorted(df.columns)
    want = con.execute(entry.oracle_sql()[name])
    names = [c[0] for c in want.description]
    rows = sorted(str([r[names.index(c)] for c in cols]) for r in want.fetchall())
    assert sorted(str([r[c] for c in cols]) for r in df.collect()) == rows
