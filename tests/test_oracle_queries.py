"""Every query with an oracle agrees with DuckDB; the others run, with a stable schema."""

import oracle
import pytest

from stopflow.operators import matching
from stopflow.plans import catalogue
from stopflow.sources import working

SQL = catalogue.oracle_sql()


@pytest.fixture(scope="module")
def db(sf):
    return oracle.database(sf)


@pytest.mark.parametrize("name", sorted(SQL))
def test_agrees_with_sql(spark, sf, db, name):
    assert oracle.difference(catalogue.queries()[name](spark, sf), db, SQL[name]) == ""


@pytest.mark.parametrize("name", sorted(set(catalogue.queries()) - set(SQL)))
def test_runs(spark, sf, name):
    df = catalogue.queries()[name](spark, sf)
    assert df.columns and df.count() > 0


@pytest.mark.parametrize("name", ["match_significance", "match_significance_countries"])
def test_significance_reads_written_summaries(spark, sf, name):
    """The plan of the shuffles is long and was held three times by the driver."""
    plan = catalogue.queries()[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and plan.count("Join") <= 2


def test_significance_matches_each_direction_once(spark, sf, monkeypatch):
    """Observed and shuffled people had a plan each, with the men's matches twice and frames persisted: too much for the driver."""
    scopes, nearest = [], matching.nearest
    monkeypatch.setattr(matching, "nearest", lambda asking, offered, scope: scopes.append(scope) or nearest(asking, offered, scope))
    catalogue.queries()["match_significance_countries"](spark, sf)
    assert scopes == [[*catalogue.SCOPE, "b"]] * 2 and not working._kept


def test_significance_rests_on_all_shuffles(spark, sf, monkeypatch):
    """Ten shuffles of the thousand were made: p-values moved in tenths."""
    made, judged = [], matching.significance
    monkeypatch.setattr(matching, "significance", lambda seen, each, scope: made.append(each.select("b").distinct().count()) or judged(seen, each, scope))
    assert catalogue.queries()["match_significance"](spark, sf).filter("p_value * 10 <> round(p_value * 10)").count() > 0
    assert made == [1000] and "range(1000)" in SQL["match_significance"]


def test_every_oracle_has_a_query():
    assert set(SQL) <= set(catalogue.queries())
