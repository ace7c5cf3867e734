"""Queries on feature levels against their SQL over whole tables: copies of the events with keys of their own and the same users, a file each."""

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from tessera.plans import chain, pixels
from tests.conftest import plain

COPIES = 12


@pytest.fixture(scope="module")
def copies(tmp_path_factory):
    """The tables' folder, and a connection that adds a table's rows as they are stored: one thread does."""
    events = pq.read_table("/root/testdata/sf0.01/events.parquet")
    folder = tmp_path_factory.mktemp("copies")
    (folder / "events.parquet").mkdir()
    for c in range(COPIES):
        keys = pa.array(events["event_id"].to_numpy() + c * events.num_rows)
        pq.write_table(events.set_column(0, "event_id", keys), folder / "events.parquet" / f"part-{c:02}.parquet")
    con = duckdb.connect()
    con.execute("SET threads = 1")
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{folder}/events.parquet/*.parquet'")
    return str(folder), con


@pytest.mark.parametrize("name", ["detect_pyramids", "evaluate_detected", "image_crops"])
def test_rows_are_those_of_the_sql(name, copies, spark):
    folder, con = copies
    df = (chain.queries() | pixels.queries())[name](spark, folder)
    statement = (chain.oracle_sql() | pixels.oracle_sql())[name]
    wanted = con.execute(f"SELECT {', '.join(df.columns)} FROM ({statement})").fetchall()
    assert wanted and sorted(tuple(map(plain, r)) for r in df.collect()) == sorted(tuple(map(plain, r)) for r in wanted)
