"""Every query with SQL gives DuckDB's rows."""

import duckdb
import pandas as pd
import pytest

from fieldlog.operators.search import PARAMETERS, QueryError, Search, Tables, search_from_params
from fieldlog.plans.queries import oracle_sql, queries
from fieldlog.plans.roles import tables

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents conversations labels".split()


def opened(data):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{data}/{t}.parquet'")
    return con


@pytest.fixture(scope="module")
def duck():
    return opened(DATA)


def rows(frame):
    def plain(x):
        return None if pd.isna(x) else int(x) if isinstance(x, float) and x.is_integer() else round(x, 6) if isinstance(x, float) else x

    frame = frame[sorted(frame.columns)]
    return sorted(tuple(str(plain(x)) for x in r) for r in frame.itertuples(index=False))


@pytest.mark.parametrize("name", sorted(queries()))
def test_same_rows_as_sql(spark, duck, name):
    ours, theirs = queries()[name](spark, DATA).toPandas(), duck.sql(oracle_sql()[name]).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert rows(ours) == rows(theirs)


@pytest.mark.parametrize("name", ["R8_flags", "R8_status", "R9_placed_runners"])
def test_same_rows_on_more_data(spark, name):
    """Rare states of the fold don't occur in the smallest tables."""
    data = DATA.replace("0.001", "0.01")
    assert rows(queries()[name](spark, data).toPandas()) == rows(opened(data).sql(oracle_sql()[name]).df())


def test_refusals():
    with pytest.raises(KeyError):
        search_from_params({"nothing": "1"})
    with pytest.raises(ValueError):
        Search().bases("12")
    with pytest.raises(ValueError):
        Search().limit(0)
    with pytest.raises(QueryError, match="whole search"):
        Search().any_of(Search().outs(1).include_uncertain())
    with pytest.raises(QueryError):
        Search().any_of()
    with pytest.raises(QueryError):
        Search().any_of(Search())
    for wrong in ({"assist_by": "2"}, {"force_certainty": "likely"}, {"offset": "3"}, {"outs": "two"}, {"out_at": "5"}, {"seasons": "2001"}, {"order": "by name"}, {"half": "middle"}, {"position_played": "QB"}):
        with pytest.raises(QueryError):
            search_from_params(wrong)
    assert len(PARAMETERS) == len(set(PARAMETERS)) == 56


def test_names_and_tables_are_checked(spark):
    t = tables(spark, DATA)
    with pytest.raises(QueryError, match="several parks") as several:
        Search().park_named("Wrigley Field").run(t)
    assert len(several.value.candidates) > 1
    with pytest.raises(QueryError, match="no person"):
        Search().batter_named("Nobody At All").run(t)
    assert Search().batter_named("Babe Roster7").run(t).count() >= 0
    with pytest.raises(QueryError, match="no play_tags"):
        Search().tag("click").matches(Tables(t.plays))
    with pytest.raises(QueryError, match="plays.hit_location"):
        Search().none_of(Search().hit_located()).matches(Tables(t.plays.drop("hit_location"), t.games))
    with pytest.raises(QueryError, match="offset"):
        Search().offset(3).run(t)
    assert Search().tag("click").any_of(Search().tag("Nonsense")).unknown_tags(t) == ["Nonsense"]
