"""Driver contract and a DuckDB oracle comparison for the cheap queries."""
import math
import os

import pytest

import __spark_entry__ as E

CHEAP = ["normalize_corpus", "merge_first_wins", "clean_all", "validate_rows", "class_balance",
         "length_describe", "length_histogram", "log_odds_top", "vocabulary_idf", "tfidf_weights",
         "stratified_split", "macro_f1", "per_register_f1", "leaderboard", "confident_fp",
         "accuracy_by_length", "linear_score"]


def test_contract_shapes():
    qs, sql = E.queries(), E.oracle_sql()
    assert set(sql) <= set(qs)
    assert all(callable(f) for f in qs.values())
    for name in CHEAP:
        assert name in sql


def _norm(v):
    if v is None:
        return (0, "")
    if isinstance(v, float):
        return (1, "nan") if math.isnan(v) else (2, round(v, 6))
    if isinstance(v, bool):
        return (3, int(v))
    if isinstance(v, int):
        return (2, float(v))
    if isinstance(v, (list, tuple)):
        return (4, str([_norm(x) for x in v]))
    return (5, str(v))


@pytest.fixture(scope="module")
def duck(sf):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for f in os.listdir(sf):
        if f.endswith(".parquet"):
            con.execute(f"CREATE VIEW {f[:-8]} AS SELECT * FROM read_parquet('{os.path.join(sf, f)}')")
    return con


@pytest.mark.parametrize("name", CHEAP)
def test_matches_sql_oracle(spark, sf, duck, name):
    sdf = E.queries()[name](spark, sf)
    srows = [r.asDict(recursive=True) for r in sdf.collect()]
    rel = duck.sql(E.oracle_sql()[name])
    drows = [dict(zip(rel.columns, r)) for r in rel.fetchall()]
    assert sorted(sdf.columns) == sorted(rel.columns)
    cols = sorted(sdf.columns)
    assert sorted(tuple(_norm(r[c]) for c in cols) for r in srows) == \
        sorted(tuple(_norm(r[c]) for c in cols) for r in drows)


def test_entry_runs_with_stable_schema(spark, sf):
    df = E.entry(spark)
    rows = df.collect()
    assert rows and all(0 <= r["macro_f1"] <= 1 and r["n"] > 0 for r in rows)
    assert df.schema == E.entry(spark).schema
