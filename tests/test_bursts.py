"""Streamed bursts against the batch forms, with rows that arrive out of order over many batches."""

import random

import pytest

from examloom.operators import eventlog as E
from examloom.streaming import bursts, jobs

SCHEMA = "event_id BIGINT, ts TIMESTAMP_NTZ, user_id BIGINT, event_type STRING, value DOUBLE, props STRING"


@pytest.mark.parametrize("flush", [None, "leave"])
def test_order_of_arrival_does_not_matter(spark, tmp_path, flush):
    import datetime as dt

    rng = random.Random(4)
    start, rows = dt.datetime(2024, 1, 1), []
    for k in range(160):
        at = start + dt.timedelta(seconds=60 * k + rng.randrange(60))
        rows.append((k, at, rng.choice([1, 2, None]), rng.choice(["edit", "edit", "leave"]), 1.0, '{"k": %d}' % rng.randrange(9)))
    rows.append((900, start + dt.timedelta(hours=9), 1, "edit", 1.0, "{}"))  # open when the source ends, without an item
    for n in range(4):  # a file holds an hour or so, shuffled against its neighbours by less than the lateness
        part = [r for r in rows if max(0, min(r[0], 159) + rng.randrange(-12, 12)) // 40 == n]
        rest = [r for r in rows if r not in part]
        rows, part = rest, part if n < 3 else part + rest
        rng.shuffle(part)
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.parquet(f"{tmp_path}/f{n}")
    import glob
    import os
    import shutil

    os.makedirs(f"{tmp_path}/in")
    for n in range(4):
        for f in glob.glob(f"{tmp_path}/f{n}/part-*"):
            shutil.copy(f, f"{tmp_path}/in/{n}.parquet")
            os.utime(f"{tmp_path}/in/{n}.parquet", (1000 + n, 1000 + n))
    stream = jobs.event_stream(spark, f"{tmp_path}/in", "*.parquet", max_files=1)
    out = spark.read.schema(bursts.RESULT).parquet(bursts.run(stream, 150_000_000, "1 hour", flush))
    batch = spark.read.parquet(f"{tmp_path}/in").selectExpr(
        "event_id", "user_id", "unix_micros(CAST(ts AS TIMESTAMP)) AS ts_us", "CAST(get_json_object(props, '$.k') AS INT) AS item",
        "event_type AS type",
    )
    want = E.debounce(batch, 150_000_000) if flush is None else E.debounce_flush(batch, 150_000_000, flush)
    cols = want.columns
    plain = lambda df: sorted(map(repr, df.select(*cols).collect()))
    assert out.select("batch").distinct().count() > 2
    assert plain(out) == plain(want)
