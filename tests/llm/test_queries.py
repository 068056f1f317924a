"""The corpus queries that have SQL, against DuckDB on the smallest tables."""

import math
import os

import pytest

duckdb = pytest.importorskip("duckdb")
from aidlake.llm import queries  # noqa: E402

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def plain(v):
    return repr(round(v, 4) + 0.0) if isinstance(v, float) and not math.isnan(v) else str(v)


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_same_rows(spark, name):
    c = duckdb.connect()
    for t in ("documents", "embeddings", "conversations"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df, want = queries.QUERIES[name](spark, SF), c.execute(queries.SQL[name])
    names = [d[0] for d in want.description]
    rows = lambda found: sorted(tuple(plain(v) for v in r) for r in found)
    assert sorted(df.columns) == sorted(names)
    got = df.select(*names).collect()
    assert got and rows(got) == rows(want.fetchall())


def test_word_scores_learn_no_more_than_pairs(spark, monkeypatch):
    from aidlake.llm import kneser_ney

    seen, fit = [], kneser_ney.fit
    monkeypatch.setattr(kneser_ney, "fit", lambda df, *a, **k: seen.append(fit(df, *a, **k)) or seen[-1])
    assert queries.QUERIES["word_scores"](spark, "/root/testdata/sf0.001").count() == 200
    assert seen[0].order == 2
