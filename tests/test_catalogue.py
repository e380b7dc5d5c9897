"""Every query against its SQL on the smallest tables, and the entry module's contract."""

import duckdb
import pytest

import __spark_entry__ as entry
from sparrowlog.plans.catalogue import ORACLE_SQL, QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(tiny):
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{tiny}/{t}.parquet')")
    return con


def plain(df):
    df = df[sorted(df.columns)]
    return sorted(str(tuple(None if v is None or v != v else v for v in r)) for r in df.itertuples(index=False))


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, tiny, duck, name):
    got, want = QUERIES[name](spark, tiny).toPandas(), duck.execute(ORACLE_SQL[name]).fetchdf()
    assert sorted(got.columns) == sorted(want.columns)
    assert plain(got) == plain(want)


@pytest.fixture(scope="module")
def larger(duck, tiny, tmp_path_factory):
    """``events`` 60 times with new users and ids: payloads of more than 200 bytes, and what SQL makes of them."""
    folder = tmp_path_factory.mktemp("larger")
    duck.execute(f"""COPY (SELECT event_id + r.range * n AS event_id, ts, user_id + r.range * users AS user_id, event_type, value, props
        FROM range(60) r, (SELECT *, count(*) OVER () AS n, max(user_id) OVER () + 1 AS users FROM events)) TO '{folder}/events.parquet' (FORMAT parquet)""")
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    con.execute(f"CREATE VIEW events AS SELECT * FROM read_parquet('{folder}/events.parquet')")
    return str(folder), con


@pytest.fixture(scope="module")
def stripped(duck, tmp_path_factory):
    """One partition of 60,000 events whose payload is too long for a commit's metadata."""
    folder = tmp_path_factory.mktemp("stripped")
    duck.execute(f"""COPY (SELECT event_id + r.range * n AS event_id, ts, CAST(hash(event_id, r.range) % 2000 AS BIGINT) * 12 AS user_id, event_type, value, props
        FROM range(60) r, (SELECT *, count(*) OVER () AS n FROM events)) TO '{folder}/events.parquet' (FORMAT parquet)""")
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    con.execute(f"CREATE VIEW events AS SELECT * FROM read_parquet('{folder}/events.parquet')")
    return str(folder), con


def equals_sql(spark, larger, name):
    folder, con = larger
    return plain(QUERIES[name](spark, folder).toPandas()) == plain(con.execute(ORACLE_SQL[name]).fetchdf())


@pytest.mark.parametrize("name", ["q_codec_sizes", "q_codec_choice", "q_metadata_pressure", "q_metrics_encoder"])
def test_long_payloads(spark, larger, name):
    assert larger[1].execute(f"SELECT min(size) FROM ({ORACLE_SQL['q_codec_sizes']})").fetchone()[0] >= 200
    assert equals_sql(spark, larger, name)


@pytest.mark.parametrize("name", ["q_commit_restore"])
def test_stripped_payloads(spark, stripped, name):
    assert equals_sql(spark, stripped, name)


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
