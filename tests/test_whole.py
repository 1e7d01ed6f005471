"""Queries that cover every row, against values computed in DuckDB without any filter."""

import functools
import math
import os

import duckdb
import numpy as np
from pyspark.sql import functions as F

from planespark.jobs import queries
from planespark.operators import statistics
from planespark.streaming import live

SF = "/root/testdata/sf0.001"


def rounded(rows):
    return sorted(tuple(str(round(x, 6) + 0.0 if isinstance(x, float) else x) for x in r) for r in rows)


def test_stream_profile_of_files_out_of_time_order(spark, tmp_path, monkeypatch):
    """Nine files in nine batches, the newest rows first: no row is late, and the last windows are returned."""
    con = duckdb.connect()
    con.execute(f"create table dealt as select *, ntile(9) over (order by ts desc) as part from '{SF}/events.parquet'")
    for k in range(1, 10):
        con.execute(f"copy (select * exclude part from dealt where part = {k}) to '{tmp_path}/events{k}.parquet' (format parquet)")
        os.utime(tmp_path / f"events{k}.parquet", (1_700_000_000 + 60 * k,) * 2)
    monkeypatch.setattr(live, "arriving", functools.partial(live.arriving, files_a_batch=1))
    got = queries.stream_frame_profile(spark, str(tmp_path)).select("start", "event_type", "n", "mean", "least", "most").collect()
    want = con.sql("select time_bucket(interval 6 hours, ts) as start, event_type, count(*), round(avg(value), 6), min(value), max(value) from dealt group by all").fetchall()
    assert sum(r.n for r in got) == con.sql("select count(*) from dealt").fetchall()[0][0]
    assert rounded(got) == rounded(want)


def test_fractal_boxes_of_a_full_plane(spark):
    """Nine box sizes by hand: a full plane of 64 x 32 has ceil(64 / s) * ceil(32 / s) boxes of size s."""
    px = spark.range(64 * 32).select(F.lit(1).alias("image_id"), (F.col("id") % 64).alias("x"), F.floor(F.col("id") / 64).alias("y"), F.lit(255).alias("v"))
    sizes = [2, 3, 4, 6, 8, 12, 16, 32, 64]
    slope = np.polyfit(np.log(sizes), [math.log(math.ceil(64 / s) * math.ceil(32 / s)) for s in sizes], 1)[0]
    got = statistics.fractal(px, ["image_id"]).collect()[0]
    assert math.isclose(got.dimension, -slope, abs_tol=1e-9) and got.most_boxes == 512
