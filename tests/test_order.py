"""Sums of a day's values near a whole number: queries on feature levels against their SQL, whatever the order of the table's rows."""

import datetime
import random

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from tessera.plans import chain, pixels
from tests.conftest import plain


@pytest.fixture(scope="module")
def events(tmp_path_factory):
    """Days of three events each, one for an image, whose values come to 26 or a little less, by the order; stored from the last on."""
    rng, rows = random.Random(3), []
    while len(rows) < 60:
        a, b = rng.randrange(1, 1200), rng.randrange(1, 1200)
        values = [a / 100, b / 100, (2600 - a - b) / 100]
        if (values[0] + values[1] + values[2] < 26) != (values[2] + values[1] + values[0] < 26):
            rows += [(len(rows) + i, datetime.datetime(2024, 1, 11, 5), 5 + 32 * (len(rows) // 3), "purchase", v, "") for i, v in enumerate(values)]
    kinds = [("event_id", pa.int64()), ("ts", pa.timestamp("us")), ("user_id", pa.int64()), ("event_type", pa.string()), ("value", pa.float64()), ("props", pa.string())]
    found = pa.table([pa.array(c, t) for c, (_, t) in zip(zip(*rows[::-1], strict=True), kinds, strict=True)], [n for n, _ in kinds])
    folder = tmp_path_factory.mktemp("order")
    pq.write_table(found, folder / "events.parquet")
    con = duckdb.connect()
    con.execute("SET threads = 1")
    con.execute(f"CREATE TABLE events AS SELECT * FROM '{folder}/events.parquet' ORDER BY event_id")
    return str(folder), con


@pytest.mark.parametrize("name", ["boxes_detected", "detect_pyramids", "evaluate_detected", "image_crops"])
def test_values_are_added_in_order_of_events(name, events, spark):
    folder, con = events
    df = (chain.queries() | pixels.queries())[name](spark, folder)
    statement = (chain.oracle_sql() | pixels.oracle_sql())[name]
    wanted = con.execute(f"SELECT {', '.join(df.columns)} FROM ({statement})").fetchall()
    assert wanted and sorted(tuple(map(plain, r)) for r in df.collect()) == sorted(tuple(map(plain, r)) for r in wanted)
