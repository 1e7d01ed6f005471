"""What large tables need: what is shuffled and broadcast, read from plans, beside results."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from planespark.jobs import queries
from planespark.operators import statistics, volumes
from planespark.sources import derived, scratch

SF = "/root/testdata/sf0.001"


def final_plan(df) -> str:
    """The plan that ran, with what adaptive execution made of it."""
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


def test_planes_take_one_shuffle(spark):
    for made in (derived.pixels, derived.stack, derived.rgb):
        assert made(spark, SF)._jdf.queryExecution().executedPlan().toString().count("Exchange ") == 1


def test_regions_are_not_broadcast(spark):
    """The planner sees the size of the regions' table, not that of the places made of it."""
    for query in (queries.moved_regions, queries.composite_regions):
        assert "BroadcastHashJoin" not in final_plan(query(spark, SF))


def test_polygons_meet_image_rows(spark):
    """Slices are joined as image rows: no pixel goes through a shuffle before its region is known."""
    plan = queries.polygon_regions(spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    joined = plan[plan.index("Join ") :]
    assert "posexplode" not in joined and "Generate inline" in joined


def written(df) -> int:
    """Exchanges in the plan that ran."""
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange ")


def test_filter_3d_of_lines(spark):
    """Rows of several lengths and a slice that is not there, against all voxels; and one shuffle for the whole query."""
    rng = np.random.default_rng(5)
    voxels = {(x, y, z): int(rng.integers(0, 9)) for z in (1, 2, 4, 5, 6) for y in range(5) for x in range(4 + y % 2)}
    rows = [(1, z, y, [voxels[x, y, z] for x in range(4 + y % 2)]) for z in (1, 2, 4, 5, 6) for y in range(5)]
    df = spark.createDataFrame(rows, "image_id int, z int, y int, line array<int>")
    for radii in ((1, 1, 1), (2, 1, 2), (1, 2, 0)):
        got = {(r.x, r.y, r.z): (r.mean, r.least, r.most, r.variance) for r in volumes.filter3d(df, ["image_id"], radii).collect()}
        assert set(got) == set(voxels)
        for x, y, z in voxels:
            near = [voxels[p] for dx, dy, dz in volumes.ellipsoid(*radii) if (p := (x + dx, y + dy, z + dz)) in voxels]
            assert np.allclose(got[x, y, z], (np.mean(near), min(near), max(near), np.var(near, ddof=1) if len(near) > 1 else 0))
    assert written(queries.filter_3d(spark, SF)) == 1


def test_grouped_projection_of_lines(spark):
    """A slab with a slice less, rows of two lengths; and one shuffle for the whole query."""
    lines = {(z, y): [float(10 * z + y + x * x) for x in range(3 + (z + y) % 2)] for z, y in itertools.product((1, 2, 3), (0, 1))}
    df = spark.createDataFrame([(7, z, y, v) for (z, y), v in lines.items()], "image_id int, z int, y int, line array<double>")
    got = {(r.slab, r.x, r.y): r.average for r in statistics.grouped_projection(df, ["image_id"], 2).collect()}
    near = {}
    for (z, y), v in lines.items():
        for x, value in enumerate(v):
            near.setdefault(((z - 1) // 2, x, y), []).append(value)
    assert got == pytest.approx({k: np.mean(v) for k, v in near.items()})
    assert written(queries.grouped_projection(spark, SF)) == 1


def test_band_pass_takes_one_shuffle(spark):
    """Besides that of the source; and the plane is not made a square."""
    df = queries.band_passed(spark, SF)
    assert written(df) == 2 and "128" not in df._jdf.queryExecution().optimizedPlan().toString().split("Generate")[1]


def test_planes_are_paired_before_they_are_transformed(spark):
    plan = queries.correlated_planes(spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join ") == 1 and "ArrowEvalPython" not in plan[plan.index("Join ") :]
    assert written(queries.correlated_planes(spark, SF)) <= 6  # two sources, two sides of the join, one for each turn


def test_saved_tables_leave_no_shuffle_files(spark, tmp_path):
    """The setting that does it is as it was afterwards."""
    files = lambda: spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().size()
    before, setting = files(), spark.conf.get(scratch.CLEANUP, None)
    out = scratch.saved(spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count(), f"{tmp_path}/t")
    assert files() <= before  # fewer, where the driver collected its garbage meanwhile
    assert spark.conf.get(scratch.CLEANUP, None) == setting and out.count() == 7


def test_shapes_between_take_one_shuffle(spark):
    """All windows over lines of a stack lie within the partition of its image."""
    assert written(queries.shapes_between(spark, SF)) == 1


def test_scaled_bicubic_takes_one_shuffle(spark):
    """Image rows go to their tiles within the partition of their image, and are not made of pixels again."""
    df = queries.scaled_bicubic(spark, SF)
    assert written(df) == 1 and df._jdf.queryExecution().optimizedPlan().toString().count("posexplode") == 0
