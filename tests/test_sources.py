"""Table files, image folders, streams that restart, regions and resampling against values worked out by hand or by plain loops."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from planespark.operators import combine, metadata, resample, stacks
from planespark.sources import folders, tables, text
from planespark.streaming import live

PIXEL = "image_id int, x int, y int, v int"


def plane(spark, values, image=1):
    return spark.createDataFrame([(image, x, y, int(v)) for y, row in enumerate(values) for x, v in enumerate(row)], PIXEL)


def array(px, width, height):
    out = np.zeros((height, width), int)
    for r in px.collect():
        out[r.y, r.x] = r.v
    return out


def rows_of(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.mark.parametrize(
    ("content", "sep", "columns", "want"),
    [
        ("﻿ ,Label,Area\n1,\"a,b\",2.5\n2,c,\n", ",", ["Label", "Area"], [("a,b", 2.5), ("c", "nan")]),
        ("1\t2\n3\t4\n", "\t", ["C1", "C2"], [(1.0, 2.0), (3.0, 4.0)]),
        ("Name,n\n\"say \"\"x\"\"\",7\n", ",", ["Name", "n"], [('say "x"', 7.0)]),
    ],
)
def test_table_files(spark, tmp_path, content, sep, columns, want):
    (tmp_path / "t.csv").write_text(content, encoding="utf-8")
    got = tables.read(spark, str(tmp_path / "t.csv"), sep)
    assert got.columns == columns
    plain = [tuple("nan" if isinstance(x, float) and math.isnan(x) else x for x in r) for r in got.collect()]
    assert sorted(plain) == sorted(want)


def test_image_folder_in_natural_order(spark, tmp_path):
    """Names a2, a10, a100 and b1: by rule, start, count and step."""
    for name, v in (("a100", 3), ("a10", 2), ("a2", 1), ("b1", 4)):
        (tmp_path / f"{name}.txt").write_text(f"{v}\t{v}\n{v}\t0\n")
    read = lambda **k: rows_of(folders.read_images(spark, str(tmp_path), **k).where("x = 0 and y = 0").select("z", "name", "v"))
    assert read(rule="a") == [(1, "a2.txt", 1.0), (2, "a10.txt", 2.0), (3, "a100.txt", 3.0)]
    assert read(rule="(^a1)") == [(1, "a10.txt", 2.0), (2, "a100.txt", 3.0)]
    assert read(start=2, step=2) == [(1, "a10.txt", 2.0), (2, "b1.txt", 4.0)]
    assert read(start=2, count=1) == [(1, "a10.txt", 2.0)]


def test_folder_stream_goes_on_after_a_restart(spark, tmp_path):
    """Images that arrive between two runs are measured once, those of the first run not again."""
    arriving, kept = tmp_path / "in", str(tmp_path / "out")
    arriving.mkdir()
    seen = []
    for name, text in (("one", "1 2\n3 4"), ("two", "5\nx\n7")):
        (arriving / f"{name}.txt").write_text(text)
        images = folders.files(spark, str(arriving), stream=True)
        seen.append(rows_of(live.append(folders.measured(images), "folder", kept)))
    assert seen[0] == [("one.txt", 4, 2.5, 1.0, 4.0)]
    assert seen[1] == [("one.txt", 4, 2.5, 1.0, 4.0), ("two.txt", 2, 6.0, 5.0, 7.0)]


def test_polygon_by_plain_crossings(spark):
    corners = [(1.2, 0.7), (11.4, 3.1), (4.3, 5.2), (12.7, 10.4), (2.1, 11.6)]
    rois = spark.createDataFrame([(1, 9, [(float(x), float(y)) for x, y in corners]), (1, 8, [(0.0, 0.0), (3.0, 3.0)]), (1, 7, [])], "image_id int, roi_id int, points array<struct<x: double, y: double>>")
    got = combine.inside_polygons(plane(spark, np.zeros((14, 14))), rois)

    def holds(x, y):
        odd = False
        for (ax, ay), (bx, by) in zip(corners, corners[1:] + corners[:1], strict=True):
            if (ay > y) != (by > y) and x < ax + (bx - ax) * (y - ay) / (by - ay):
                odd = not odd
        return odd

    want = sorted((9, x, y) for x in range(14) for y in range(14) if holds(x + 0.5, y + 0.5))
    assert rows_of(got.select("roi_id", "x", "y")) == want and len(want) > 20


def test_resampling_keeps_what_it_should(spark):
    """The same size and no turn change nothing; a flat plane stays flat; halves are means of four; a quarter turn moves pixels."""
    a = np.random.default_rng(3).integers(0, 256, (6, 6))
    px = plane(spark, a)
    assert (array(resample.scaled(px, ["image_id"], 6, 6, 6, 6), 6, 6) == a)[:-1, :-1].all()
    assert (array(resample.scaled(plane(spark, np.full((6, 6), 9)), ["image_id"], 6, 6, 11, 4), 11, 4) == 9).all()
    halves = np.floor(a.reshape(3, 2, 3, 2).mean((1, 3)) + 0.5)
    assert (array(resample.averaged(px, ["image_id"], 6, 6, 3, 3), 3, 3) == halves).all()
    assert (array(resample.rotated(px, ["image_id"], 6, 6, 0), 6, 6) == a)[:-1, :-1].all()
    assert (array(resample.rotated(px, ["image_id"], 6, 6, 90), 6, 6) == np.rot90(a, -1))[1:-1, 1:-1].all()
    assert array(resample.rotated(px, ["image_id"], 6, 6, 45, 77), 6, 6)[0, 0] == 77


def test_ranks_and_deletions(spark):
    """Numbers after texts, ties and nulls share a rank, whatever the partitions."""
    cells = ["10", "9", "b", "a", "a", None, "9"]
    rows = spark.createDataFrame([(k, c) for k, c in enumerate(cells)], "k int, c string").repartition(5)
    got = {r.k: r["rank"] for r in stacks.table_sort(rows, "c").collect()}
    assert got == {5: 1, 3: 2, 4: 2, 2: 4, 1: 5, 6: 5, 0: 7}
    numbers = spark.range(100).repartition(7)
    assert rows_of(stacks.rows_deleted(numbers, ["id"], 10, 19)) == [(k, k if k < 10 else k - 10) for k in range(100) if not 10 <= k < 20]
    assert stacks.table_sort(rows.limit(0), "c").count() == 0


def test_metadata(spark):
    rows = spark.createDataFrame([("s", 0.0, "a", None), ("s", 2.0, "a", "q"), ("s", 4.5, "a", "q"), ("t", 1.0, "b", "r")], "series string, at double, one string, two string")
    got = metadata.consistency(rows, ["series"], ["one", "two"])
    assert rows_of(got) == [("s", "one", 1, 0, True), ("s", "two", 1, 1, False), ("t", "one", 1, 0, True), ("t", "two", 1, 0, True)]
    assert [tuple(r) for r in metadata.spacing(rows, ["series"], "at").orderBy("series").collect()] == [("s", 2, 2.25, 2.0, 2.5, False), ("t", 0, None, None, None, True)]


def test_divisions_by_zero_of_real_images(spark):
    px, other = plane(spark, [[0, 5, 6]]), plane(spark, [[0, 0, 4]])
    got = combine.calculate(px, other, ["image_id", "x", "y"], ["divide"], top=None).orderBy("x").select(F.col("divide").cast("string")).collect()
    assert [r[0] for r in got] == ["NaN", "Infinity", "1.5"]


def test_table_cells_with_line_breaks_and_odd_rows(spark, tmp_path):
    rows = spark.createDataFrame([(1.0, 'two\nlines, "quoted"'), (2.0, "")], "n double, label string")
    tables.write(rows, f"{tmp_path}/out")
    assert sorted((r.n, r.label) for r in tables.read(spark, f"{tmp_path}/out").collect()) == [(1.0, 'two\nlines, "quoted"'), (2.0, None)]
    (tmp_path / "same.tsv").write_text("a\ta\tb\n1\t2\n3\t4\tx\n")
    got = tables.read(spark, f"{tmp_path}/same.tsv")
    assert got.columns == ["a", "a_2", "b"] and sorted(map(tuple, got.collect())) == [(1.0, 2.0, None), (3.0, 4.0, "x")]
    (tmp_path / "long.csv").write_text("a,b\n1,2,3\n")
    with pytest.raises(Exception, match="more cells"):
        tables.read(spark, f"{tmp_path}/long.csv", numeric=[]).collect()


def test_text_images(spark):
    lines = [(1, 0, "left right"), (1, 1, ""), (1, 2, "1,2"), (1, 4, "3\tx"), (2, 0, "7")]
    got = text.from_lines(spark.createDataFrame(lines, "image_id int, y int, line string"), ["image_id"]).collect()
    assert sorted((r.image_id, r.x, r.y, str(r.v)) for r in got) == [(1, 0, 0, "1.0"), (1, 0, 1, "3.0"), (1, 1, 0, "2.0"), (1, 1, 1, "nan"), (2, 0, 0, "7.0")]
    with pytest.raises(Exception, match="a line has 1 numbers"):
        text.from_lines(spark.createDataFrame([(1, 0, "1 2"), (1, 1, "3")], "image_id int, y int, line string"), ["image_id"]).collect()


def test_stream_windows_late_rows_and_restart(spark, tmp_path):
    """Rows behind the watermark are dropped, a restart goes on, and the last version of each key is what counts."""
    folder, kept = tmp_path / "in", str(tmp_path / "state")
    write = lambda name, rows: spark.createDataFrame([(f"2024-01-01 {t}", k, v) for t, k, v in rows], "ts string, kind string, value double").selectExpr("cast(ts as timestamp) ts", "kind", "value").coalesce(1).write.parquet(f"{folder}/{name}")
    closed, running = [], []
    parts = [[("00:10:00", "a", 1.0), ("01:20:00", "a", 5.0)], [("00:50:00", "a", 3.0), ("04:00:00", "b", 9.0)], [("00:20:00", "a", 100.0), ("09:00:00", "b", 1.0)]]
    for k, rows in enumerate(parts):
        write(f"p{k}", rows)
        arriving = lambda: live.arriving(spark, f"{folder}/*/*.parquet")
        closed = live.append(live.frame_profile(arriving(), "ts", ["kind"], F.col("value"), "1 hour", "1 hour"), "closed", f"{kept}/closed")
        stream = live.running_profile(arriving(), "ts", ["kind"], F.col("value"), "1 hour")
        running = live.latest(stream, "running", ["start", "kind"], f"{kept}/running")
    hour = lambda r: r.start.hour
    # 00:50 came while 01:20 was the newest: in time. 00:20 came after 04:00: too late.
    assert sorted((hour(r), r.kind, r.n, r["mean"]) for r in closed.collect()) == [(0, "a", 2, 2.0), (1, "a", 1, 5.0), (4, "b", 1, 9.0)]
    want = [(0, "a", 3, 104 / 3), (1, "a", 1, 5.0), (4, "b", 1, 9.0), (9, "b", 1, 1.0)]
    assert sorted((hour(r), r.kind, r.n, r["mean"]) for r in running.collect()) == want
    live.upkeep(spark, stream.schema, ["start", "kind"], f"{kept}/running", 2)
    assert sorted((hour(r), r.kind, r.n, r["mean"]) for r in spark.read.parquet(f"{kept}/running/changes").collect()) == want


def test_listed_images(spark, tmp_path):
    """Order of the list, a missing image, another size, the end at a blank line."""
    for name, value in (("b.txt", "1 2\n3 4"), ("a.txt", "1 2 3 4\n5 6 7 8\n9 10 11 12\n13 14 15 16"), ("c.txt", "9")):
        (tmp_path / "in" / name).parent.mkdir(exist_ok=True)
        (tmp_path / "in" / name).write_text(value)
    (tmp_path / "list.txt").write_text("b.txt\nnone.txt\na.txt\n\nc.txt\n")
    got = folders.read_listed(spark, str(tmp_path / "list.txt"), str(tmp_path / "in"))
    assert sorted((r.z, r.y, r.x, r.v) for r in got.collect()) == [(z, y, x, v) for z, plane_of in ((1, [[1, 2], [3, 4]]), (2, [[0, 0], [0, 0]]), (3, [[1, 3], [9, 11]])) for y, row in enumerate(plane_of) for x, v in enumerate(row)]
    (tmp_path / "empty.txt").write_text("\nb.txt")
    assert folders.read_listed(spark, str(tmp_path / "empty.txt"), str(tmp_path / "in")).count() == 0
