"""Each registered query of the core against its SQL, over the smallest tables."""

import datetime
import math

import duckdb
import pytest

from dossier.plans import registry
from dossier.plans.views import TABLES

from .conftest import SMALL


def plain(x):
    if x is None or (isinstance(x, float) and math.isnan(x)):
        return "~"
    if isinstance(x, bool):
        return str(x)
    if isinstance(x, int | float) or type(x).__name__ == "Decimal":
        return f"{round(float(x), 9) + 0.0:.6g}" if abs(x) < 1e6 else str(int(x))
    if isinstance(x, list | tuple):
        return "[" + ",".join(map(plain, x)) + "]"
    if isinstance(x, datetime.date):
        return x.isoformat()
    return str(x)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_same_rows(spark, duck, name):
    df = registry.queries()[name](spark, SMALL)
    found = duck.execute(registry.oracle_sql()[name])
    columns = sorted(df.columns)
    assert columns == sorted(c[0] for c in found.description)
    order = [[c[0] for c in found.description].index(c) for c in columns]
    want = sorted([plain(r[i]) for i in order] for r in found.fetchall())
    got = sorted([plain(r[c]) for c in columns] for r in df.collect())
    assert got == want


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(registry.oracle_sql())))
def test_gives_rows(spark, name):
    assert registry.queries()[name](spark, SMALL).count() > 0


def test_no_product_and_no_python_in_core_plans(spark):
    for name in ("c8_match_terms", "c10_candidate_pairs", "e1_rank_jobs", "h20_tfidf_cosine", "h5_redact", "e10_evidence_snippets"):
        plan = registry.queries()[name](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" not in plan and "Python" not in plan and "InPandas" not in plan, name
        if name not in ("h20_tfidf_cosine",):  # one row of counts is crossed there
            assert "BroadcastNestedLoopJoin" not in plan, name


def test_pairs_are_not_shuffled(spark):
    plan = registry.queries()["e1_rank_jobs"](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    moved = [line for line in plan.splitlines() if "Exchange hashpartitioning" in line]
    assert moved and not any("job_id" in line for line in moved)
