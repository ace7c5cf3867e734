"""Queries on feature levels against their SQL on all threads, where values are quarters: their sums are exact, so no order of addition tells."""

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from tessera.plans import chain, pixels
from tests.conftest import plain

COPIES = 12


@pytest.fixture(scope="module")
def copies(tmp_path_factory):
    """The tables' folder and a connection of eight threads: copies with keys of their own and the same users, rows at random, in row groups of one copy's length."""
    events = pq.read_table("/root/testdata/sf0.01/events.parquet")
    quarters = pa.array(np.floor(events["value"].to_numpy() * 4) / 4)
    events = events.set_column(events.schema.get_field_index("value"), "value", quarters)
    whole = pa.concat_tables([events.set_column(0, "event_id", pa.array(events["event_id"].to_numpy() + c * events.num_rows)) for c in range(COPIES)])
    folder = tmp_path_factory.mktemp("exact")
    pq.write_table(whole.take(pa.array(np.random.default_rng(5).permutation(whole.num_rows))), folder / "events.parquet", row_group_size=events.num_rows)
    con = duckdb.connect()
    con.execute("SET threads = 8")
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{folder}/events.parquet'")
    return str(folder), con


@pytest.mark.parametrize("name", ["evaluate_detected", "image_crops"])
def test_rows_are_those_of_the_sql_on_all_threads(name, copies, spark):
    folder, con = copies
    df = (chain.queries() | pixels.queries())[name](spark, folder)
    statement = (chain.oracle_sql() | pixels.oracle_sql())[name]
    wanted = con.execute(f"SELECT {', '.join(df.columns)} FROM ({statement})").fetchall()
    assert wanted and sorted(tuple(map(plain, r)) for r in df.collect()) == sorted(tuple(map(plain, r)) for r in wanted)
