"""DuckDB SQL for the registered queries."""

from __future__ import annotations

import math

_PLACE = "l_suppkey AS image_id, CAST(l_partkey % 64 AS INT) AS x, CAST((l_partkey // 64) % 32 AS INT) AS y"
_GRID = "(SELECT CAST(unnest(range(64)) AS INT) AS x), (SELECT CAST(unnest(range(32)) AS INT) AS y)"


def _cells(keys: str) -> str:
    """Every cell of every plane, with what ``cells`` has there."""
    return f"(SELECT {keys}, x, y FROM (SELECT DISTINCT {keys} FROM cells), {_GRID}) LEFT JOIN cells USING ({keys}, x, y)"


def _level(what: str) -> str:
    return f"least(255, CAST(sum({what}) AS INT))"


PX = f"""cells AS MATERIALIZED (SELECT {_PLACE}, {_level("l_quantity")} AS v FROM lineitem GROUP BY ALL),
px AS MATERIALIZED (SELECT image_id, x, y, coalesce(v, 0) AS v FROM {_cells('image_id')})"""
STACK = f"""cells AS MATERIALIZED (SELECT {_PLACE}, CAST(l_linenumber AS INT) AS z, {_level("l_quantity")} AS v FROM lineitem GROUP BY ALL),
st AS MATERIALIZED (SELECT image_id, z, x, y, coalesce(v, 0) AS v FROM {_cells('image_id, z')})"""
_FLAG = "CASE WHEN l_returnflag = '{}' THEN l_quantity ELSE 0 END"
RGB = f"""cells AS MATERIALIZED (SELECT {_PLACE}, {_level(_FLAG.format("N"))} AS r, {_level(_FLAG.format("A"))} AS g, {_level(_FLAG.format("R"))} AS b FROM lineitem GROUP BY ALL),
rgb AS MATERIALIZED (SELECT image_id, x, y, coalesce(r, 0) AS r, coalesce(g, 0) AS g, coalesce(b, 0) AS b FROM {_cells('image_id')})"""
FL = """vec AS (SELECT label AS image_id, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS z, embedding FROM embeddings),
items AS (SELECT image_id, z, unnest(embedding) AS e, generate_subscripts(embedding, 1) - 1 AS i FROM vec),
fl AS (SELECT image_id, CAST(z AS INT) AS z, CAST(i % 8 AS INT) AS x, CAST(i // 8 AS INT) AS y, CAST(e AS DOUBLE) AS v FROM items)"""


def _px(body: str) -> str:
    return f"WITH {PX}\n{body}"


def _st(body: str) -> str:
    return f"WITH {STACK}\n{body}"


def _near(value: str, where: str = "") -> str:
    """Neighbours of each pixel, with the nearest edge pixel where there is none; ``value`` aggregates n.v over dx, dy."""
    return _px(f"""SELECT p.image_id, p.x, p.y, {value} AS v FROM (SELECT * FROM px, (SELECT CAST(unnest([-1, 0, 1]) AS INT) AS dx), (SELECT CAST(unnest([-1, 0, 1]) AS INT) AS dy)) p
    JOIN px n ON n.image_id = p.image_id AND n.x = greatest(0, least(63, p.x + dx)) AND n.y = greatest(0, least(31, p.y + dy))
    {where} GROUP BY p.image_id, p.x, p.y""")


_AROUND = """SELECT p.image_id, p.x, p.y, any_value(p.v) AS v, sum(CASE WHEN n.v > {t} AND (dx <> 0 OR dy <> 0) THEN 1 ELSE 0 END) AS k FROM (SELECT * FROM px, (SELECT CAST(unnest([-1, 0, 1]) AS INT) AS dx), (SELECT CAST(unnest([-1, 0, 1]) AS INT) AS dy)) p LEFT JOIN px n ON n.image_id = p.image_id AND n.x = p.x + dx AND n.y = p.y + dy GROUP BY p.image_id, p.x, p.y"""
_ROIS = "rois AS (SELECT image_id, k AS roi_id, CASE WHEN k % 2 = 0 THEN 'rectangle' ELSE 'oval' END AS kind, k % 8 * 8 AS x0, k // 8 * 8 AS y0 FROM (SELECT DISTINCT image_id FROM cells), (SELECT CAST(unnest(range(32)) AS INT) AS k)), members AS MATERIALIZED (SELECT px.*, roi_id, kind FROM px JOIN rois ON px.image_id = rois.image_id AND x >= x0 AND x < x0 + 8 AND y >= y0 AND y < y0 + 8 AND (kind = 'rectangle' OR pow((x + 0.5 - x0 - 4) / 4.0, 2) + pow((y + 0.5 - y0 - 4) / 4.0, 2) <= 1))"
_PAIR = "FROM px a JOIN px b ON b.image_id + 1 = a.image_id AND a.x = b.x AND a.y = b.y"
_LINE = "CASE WHEN {0} / 255.0 <= 0.04045 THEN {0} / 255.0 / 12.92 ELSE pow(({0} / 255.0 + 0.055) / 1.055, 2.4) END"
_R, _G, _B = (_LINE.format(c) for c in "rgb")

SQL = {
    "pixel_arithmetic": _px("SELECT image_id, x, y, least(255, v + 40) AS added, greatest(0, v - 20) AS subtracted, CAST(least(255, floor(v * 1.5 + 0.5)) AS INT) AS multiplied, CAST(least(255, floor(v * (1.0 / 3) + 0.5)) AS INT) AS divided, v & 12 AS anded, v | 3 AS ored, xor(v, 255) AS xored, greatest(v, 5) AS raised, least(v, 30) AS lowered FROM px"),
    "pixel_functions": _px("SELECT image_id, x, y, CASE WHEN v <= 0 THEN 0 ELSE CAST(floor(exp(ln(v / 255.0) * 0.5) * 255 + 0.5) AS INT) END AS gamma, CASE WHEN v <= 0 THEN 0 ELSE CAST(floor(ln(v) * (255.0 / ln(255.0)) + 0.5) AS INT) END AS log, least(255, v * v) AS square, round(sqrt(v), 6) AS root, round(1.0 / (v + 1), 6) AS reciprocal, 255 - v AS inverted, CASE WHEN v <= 20 THEN 0 ELSE 255 END AS binary, CASE WHEN v BETWEEN 10 AND 40 THEN 255 ELSE 0 END AS mask, round(CASE WHEN v = 0 THEN log10(510.0) ELSE log10(255.0 / v) END, 6) AS density, round(CAST(1 AS DOUBLE) + CAST(0.5 AS DOUBLE) * v + CAST(0.01 AS DOUBLE) * v * v, 6) AS polynomial, CAST(x - 2 AS DOUBLE) * 0.5 AS cal_x FROM px"),
    "pixel_expression": _px("SELECT image_id, x, y, round(v * 2 + sqrt(pow(x - 31.5, 2) + pow(15.5 - y, 2)) - CAST(x AS DOUBLE) / (y + 1), 6) AS v FROM px"),
    "type_conversion": _px("SELECT image_id, x, y, CAST(greatest(0, least(255, trunc(CAST(v - lo AS DOUBLE) * 256 / (hi - lo + 1) + 0.5))) AS INT) AS v FROM px JOIN (SELECT image_id, min(v) AS lo, max(v) AS hi FROM px GROUP BY image_id) USING (image_id)"),
    "rgb_gray_hsb": f"WITH {RGB}, q AS (SELECT *, greatest(r, g, b) AS hi, CAST(greatest(r, g, b) - least(r, g, b) AS DOUBLE) AS span FROM rgb), h AS (SELECT *, CASE WHEN span = 0 THEN 0 WHEN r = hi THEN (g - b) / span / 6 WHEN g = hi THEN (2 + (b - r) / span) / 6 ELSE (4 + (r - g) / span) / 6 END AS hue0 FROM q) SELECT image_id, x, y, CAST(trunc(r * 0.25 + g * 0.5 + b * 0.25 + 0.5) AS INT) AS gray, round(CASE WHEN hue0 < 0 THEN hue0 + 1 ELSE hue0 END, 6) AS hue, round(CASE WHEN hi = 0 THEN 0 ELSE span / hi END, 6) AS saturation, round(CAST(hi AS DOUBLE) / 255, 6) AS brightness FROM h",
    "rgb_xyz": f"WITH {RGB} SELECT image_id, x, y, round((0.4124 * ({_R}) + 0.3576 * ({_G}) + 0.1805 * ({_B})) * 100, 4) AS cx, round((0.2126 * ({_R}) + 0.7152 * ({_G}) + 0.0722 * ({_B})) * 100, 4) AS cy, round((0.0193 * ({_R}) + 0.1192 * ({_G}) + 0.9505 * ({_B})) * 100, 4) AS cz FROM rgb",
    "split_channels": f"WITH {RGB} SELECT image_id, 1 AS c, x, y, r AS v FROM rgb UNION ALL SELECT image_id, 2, x, y, g FROM rgb UNION ALL SELECT image_id, 3, x, y, b FROM rgb",
    "colour_threshold": f"WITH {RGB} SELECT image_id, x, y, CASE WHEN r BETWEEN 1 AND 60 AND NOT g BETWEEN 30 AND 255 AND b BETWEEN 0 AND 200 THEN 255 ELSE 0 END AS v FROM rgb",
    "crop_flip_rotate": _px("SELECT image_id, 15 - (y - 4) AS x, 31 - (x - 8) AS y, v FROM px WHERE x BETWEEN 8 AND 39 AND y BETWEEN 4 AND 19"),
    "rotate_right": _px("SELECT image_id, 31 - y AS x, 63 - x AS y, v FROM px"),
    "translate": _px("SELECT g.image_id, g.x, g.y, coalesce(p.v, 7) AS v FROM px g LEFT JOIN px p ON p.image_id = g.image_id AND p.x = g.x - 5 AND p.y = g.y + 3"),
    "canvas": _px("SELECT g.image_id, g.x, g.y, coalesce(px.v, 9) AS v FROM (SELECT image_id, x, y FROM (SELECT DISTINCT image_id FROM cells), (SELECT CAST(unnest(range(72)) AS INT) AS x), (SELECT CAST(unnest(range(30)) AS INT) AS y)) g LEFT JOIN px ON px.image_id = g.image_id AND px.x = g.x - 4 AND px.y = g.y + 1"),
    "bin_blocks": _px("SELECT image_id, x // 5 AS x, y // 3 AS y, avg(v) AS average, median(v) AS median, min(v) AS least, max(v) AS most, CAST(sum(v) AS BIGINT) AS total FROM px WHERE x < 60 AND y < 30 GROUP BY image_id, x // 5, y // 3"),
    "reslice": _st("SELECT image_id, y + 1 AS z, x, z - 1 AS y, v FROM st"),
    "montage": _st("SELECT image_id, x + (z - 1) % 3 * 64 AS x, y + (z - 1) // 3 * 32 AS y, v FROM st"),
    "tile_histogram": _px("SELECT image_id, tx, ty, count(*) AS n, CAST(sum(v) AS BIGINT) AS total FROM px JOIN (SELECT CAST(unnest(range(4)) AS INT) AS tx) ON x >= tx * 16 - 2 AND x < tx * 16 + 18 JOIN (SELECT CAST(unnest(range(2)) AS INT) AS ty) ON y >= ty * 16 - 2 AND y < ty * 16 + 18 GROUP BY ALL"),
    "image_calculator": _px(f"SELECT a.image_id, a.x, a.y, least(255, a.v + b.v) AS add, greatest(0, a.v - b.v) AS subtract, least(255, a.v * b.v) AS multiply, CASE WHEN b.v = 0 THEN 255 ELSE a.v // b.v END AS divide, a.v & b.v AS \"and\", a.v | b.v AS \"or\", xor(a.v, b.v) AS xor, least(a.v, b.v) AS min, greatest(a.v, b.v) AS max, (a.v + b.v) // 2 AS average, abs(a.v - b.v) AS difference, CASE WHEN b.v = 0 THEN a.v ELSE b.v END AS copy_nonzero {_PAIR}"),
    "paste": _px("SELECT a.image_id, a.x, a.y, CASE WHEN b.v IS NULL THEN a.v ELSE greatest(a.v, b.v) END AS v FROM px a LEFT JOIN px b ON b.image_id + 1 = a.image_id AND b.x = a.x - 20 AND b.y = a.y - 10 AND b.x < 16 AND b.y < 16"),
    "measure_regions": f"WITH {PX}, {_ROIS} SELECT image_id, roi_id, kind, count(*) AS n, avg(v) AS mean, max(v) AS most FROM members GROUP BY ALL",
    "outside_regions": f"WITH {PX}, {_ROIS} SELECT px.* FROM px ANTI JOIN members USING (image_id, x, y)",
    "compare_images": _px(f"SELECT a.image_id, round(avg(CAST((a.v - b.v) * (a.v - b.v) AS DOUBLE)), 6) AS mse, round(sqrt(avg(CAST((a.v - b.v) * (a.v - b.v) AS DOUBLE))), 6) AS rmse, round(avg(CAST(abs(a.v - b.v) AS DOUBLE)), 6) AS mae, CAST(max(abs(a.v - b.v)) AS DOUBLE) AS most, round(10 * log10(65025.0 / avg(CAST((a.v - b.v) * (a.v - b.v) AS DOUBLE))), 6) AS psnr {_PAIR} GROUP BY a.image_id"),
    "histogram": _px("SELECT image_id, v, count(*) AS n FROM px GROUP BY image_id, v"),
    "histogram_binned": _px("SELECT image_id, CASE WHEN hi > lo THEN CAST(least(15, trunc(CAST(v - lo AS DOUBLE) * 16 / (hi - lo))) AS INT) ELSE 0 END AS bin, count(*) AS n FROM px JOIN (SELECT image_id, min(v) AS lo, max(v) AS hi FROM px GROUP BY image_id) USING (image_id) GROUP BY ALL"),
    "statistics": _px("SELECT image_id, count(*) AS n, min(v) AS least, max(v) AS most, round(avg(v), 6) AS mean, round(stddev_samp(v), 6) AS sd, round(avg(pow(v - m, 3)) / pow(avg(pow(v - m, 2)), 1.5), 6) AS skewness, round(avg(pow(v - m, 4)) / pow(avg(pow(v - m, 2)), 2) - 3, 6) AS kurtosis FROM px JOIN (SELECT image_id, avg(v) AS m FROM px GROUP BY image_id) USING (image_id) GROUP BY image_id"),
    "moments": _px("SELECT image_id, CAST(sum(v) AS BIGINT) AS raw_density, round(avg(x) + 0.5, 6) AS cx, round(avg(y) + 0.5, 6) AS cy, round(CAST(sum(x * v) AS DOUBLE) / sum(v) + 0.5, 6) AS mx, round(CAST(sum(y * v) AS DOUBLE) / sum(v) + 0.5, 6) AS my, round(100.0 * count(*) FILTER (WHERE v <> 0) / count(*), 6) AS percent_area FROM px GROUP BY image_id"),
    "thresholded_statistics": _px("SELECT image_id, count(*) AS n, round(avg(v), 6) AS mean FROM px WHERE v BETWEEN 20 AND 60 GROUP BY image_id"),
    "mode_median": _px("SELECT image_id, mode, median FROM (SELECT image_id, v AS mode FROM (SELECT image_id, v, row_number() OVER (PARTITION BY image_id ORDER BY count(*) DESC, v) AS k FROM px GROUP BY image_id, v) WHERE k = 1) JOIN (SELECT image_id, min(v) AS median FROM (SELECT image_id, v, sum(count(*)) OVER (PARTITION BY image_id ORDER BY v) AS below, sum(count(*)) OVER (PARTITION BY image_id) AS total FROM px GROUP BY image_id, v) WHERE below > total / 2.0 GROUP BY image_id) USING (image_id)"),
    "stack_statistics": _st("SELECT image_id, count(*) AS voxels, round(avg(v), 6) AS mean, max(v) AS most, round(100.0 * count(*) FILTER (WHERE v > 0) / count(*), 6) AS percent_volume FROM st GROUP BY image_id"),
    "z_projection": f"WITH {FL} SELECT image_id, x, y, round(avg(v), 6) AS average, round(max(v), 6) AS most, round(min(v), 6) AS least, round(sum(v), 6) AS total, round(coalesce(stddev_samp(v), 0), 6) AS sd, round(median(v), 6) AS median FROM fl GROUP BY image_id, x, y",
    "grouped_projection": _st("SELECT image_id, (z - 1) // 2 AS slab, x, y, avg(v) AS average FROM st GROUP BY ALL"),
    "z_profile": _st("SELECT image_id, z, avg(v) AS mean FROM st GROUP BY image_id, z"),
    "axis_profiles": _px("SELECT image_id, x, avg(v) AS mean FROM px GROUP BY image_id, x"),
    "table_summary": " UNION ALL ".join(f"SELECT '{n}' AS label, round({f}(o_totalprice), 2) AS o_totalprice, round(CAST({f}(o_custkey) AS DOUBLE), 4) AS o_custkey FROM orders" for n, f in (("Mean", "avg"), ("SD", "stddev_samp"), ("Min", "min"), ("Max", "max"))),
    "table_distribution": "WITH e AS (SELECT min(o_totalprice) AS lo, max(o_totalprice) AS hi, 3.49 * stddev_samp(o_totalprice) * pow(count(*), -1.0 / 3) AS w FROM orders), b AS (SELECT lo, hi, CAST(greatest(2, floor((hi - lo) / w + 0.5)) AS INT) AS bins FROM e) SELECT CAST(least(trunc((o_totalprice - lo) * bins / (hi - lo)), bins - 1) AS INT) AS bin, count(*) AS n FROM orders, b GROUP BY ALL",
    "fractal_boxes": _px("SELECT image_id, round(-regr_slope(ln(k), ln(s)), 6) AS dimension, max(k) AS most_boxes FROM (SELECT image_id, s, count(*) AS k FROM (SELECT DISTINCT image_id, s, (x - x0) // s AS bx, (y - y0) // s AS by_ FROM (SELECT image_id, x, y, unnest([2, 3, 4, 6, 8, 12, 16, 32, 64]) AS s FROM px WHERE v > 0) JOIN (SELECT image_id, min(x) AS x0, min(y) AS y0 FROM px WHERE v > 0 GROUP BY image_id) USING (image_id)) GROUP BY image_id, s) GROUP BY image_id"),
    "otsu_threshold": _px(""",
h AS (SELECT image_id, v, count(*) AS n FROM px GROUP BY ALL),
c AS (SELECT image_id, v, sum(n) OVER w AS n1, sum(n * v) OVER w AS s1, sum(n) OVER (PARTITION BY image_id) AS n0, sum(n * v) OVER (PARTITION BY image_id) AS s0 FROM h WINDOW w AS (PARTITION BY image_id ORDER BY v)),
b AS (SELECT image_id, v, CASE WHEN n1 < n0 THEN CAST(s1 * n0 - s0 * n1 AS DOUBLE) * CAST(s1 * n0 - s0 * n1 AS DOUBLE) / (CAST(n1 AS DOUBLE) * CAST(n0 - n1 AS DOUBLE)) ELSE -1 END AS between_ FROM c),
l AS (SELECT image_id, v AS level FROM (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY between_ DESC, v) AS k FROM b) WHERE k = 1)
SELECT image_id, level, CAST(sum(CASE WHEN v > level THEN 1 ELSE 0 END) AS BIGINT) AS foreground FROM px JOIN l USING (image_id) GROUP BY ALL"""),
    "contrast_stretch": _px(""",
c AS (SELECT image_id, v, n, sum(n) OVER (PARTITION BY image_id ORDER BY v) AS below, sum(n) OVER (PARTITION BY image_id) AS total FROM (SELECT image_id, v, count(*) AS n FROM px GROUP BY ALL)),
e AS (SELECT image_id, min(v) FILTER (WHERE below > floor(total * 2.0 / 200)) AS lo, max(v) FILTER (WHERE total - below + n > floor(total * 2.0 / 200)) AS hi FROM c GROUP BY image_id)
SELECT image_id, x, y, CAST(CASE WHEN hi > lo THEN greatest(0, least(255, floor(CAST(v - lo AS DOUBLE) * 255 / (hi - lo) + 0.5))) ELSE v END AS INT) AS v FROM px JOIN e USING (image_id)"""),
    "equalised": _px(""",
h AS (SELECT image_id, v, sqrt(count(*)) AS k FROM px GROUP BY ALL),
c AS (SELECT image_id, v, k, sum(k) OVER (PARTITION BY image_id ORDER BY v) AS upto, sum(k) OVER (PARTITION BY image_id) AS total, min(v) OVER (PARTITION BY image_id) AS lo, max(v) OVER (PARTITION BY image_id) AS hi FROM h)
SELECT image_id, x, y, CAST(CASE WHEN px.v = lo THEN 0 WHEN px.v = hi THEN 255 ELSE floor((upto - k / 2) / total * 255 + 0.5) END AS INT) AS v FROM px JOIN c USING (image_id, v)"""),
    "substack": _st("SELECT image_id, x, y, v, CAST(dense_rank() OVER (PARTITION BY image_id ORDER BY z) AS INT) AS z FROM st WHERE z IN (2, 4, 6)"),
    "delete_slices": _st("SELECT image_id, x, y, v, CAST(dense_rank() OVER (PARTITION BY image_id ORDER BY z) AS INT) AS z FROM st WHERE z NOT IN (1, 4)"),
    "reduced_stack": _st("SELECT image_id, (z - 1) // 3 + 1 AS z, x, y, v FROM st WHERE (z - 1) % 3 = 0"),
    "concatenated": _st("SELECT image_id, z, x, y, v FROM st UNION ALL SELECT image_id, 15 - z, x, y, v FROM st"),
    "hyperstack_order": "SELECT event_id, c, z, t, CAST((c - 1) * 12 + (z - 1) * 4 + t AS BIGINT) AS back FROM (SELECT event_id, CAST(event_id % 24 % 2 + 1 AS INT) AS c, CAST(event_id % 24 // 2 % 3 + 1 AS INT) AS z, CAST(event_id % 24 // 6 % 4 + 1 AS INT) AS t FROM events)",
    "natural_names": "SELECT c_custkey, regexp_replace(lower(c_name), '[0-9]+', '') || lpad(CAST(CAST(regexp_extract(c_name, '[0-9]+') AS BIGINT) AS VARCHAR), 12, '0') AS sort_key FROM customer",
    "plane_hashes": _px("SELECT image_id, md5(string_agg(CAST(v AS VARCHAR), ',' ORDER BY y, x)) AS md5 FROM px GROUP BY image_id"),
    "table_sorted": "SELECT o_orderkey, o_orderpriority, rank() OVER (ORDER BY TRY_CAST(o_orderpriority AS DOUBLE) IS NOT NULL, CASE WHEN TRY_CAST(o_orderpriority AS DOUBLE) IS NULL THEN o_orderpriority END NULLS FIRST, TRY_CAST(o_orderpriority AS DOUBLE) NULLS FIRST) AS rank FROM orders",
    "line_fits": "SELECT l_suppkey, round(regr_intercept(l_extendedprice, l_quantity), 3) AS a, round(regr_slope(l_extendedprice, l_quantity), 4) AS b, round(regr_r2(l_extendedprice, l_quantity), 6) AS r2 FROM lineitem GROUP BY l_suppkey",
    "event_frames": "SELECT CAST(hour(ts) AS INT) AS t, CAST(user_id % 16 AS INT) AS x, CAST(event_id % 16 AS INT) AS y, round(sum(value), 4) AS v FROM events GROUP BY ALL",
    "text_image": _px("SELECT image_id, y, string_agg(CAST(v AS VARCHAR), chr(9) ORDER BY x) AS line FROM px GROUP BY image_id, y"),
    "text_image_read": _px("SELECT image_id, x, y, CAST(v AS DOUBLE) AS v FROM px"),
    "xy_coordinates": _px("SELECT image_id, x, 31 - y AS y, v FROM px WHERE v <> 0"),
    "image_to_table": _px("SELECT image_id, 'Y' || CAST(y AS VARCHAR) AS label, " + ", ".join(f"CAST(max(CASE WHEN x = {k} THEN v END) AS DOUBLE) AS X{k}" for k in range(64)) + " FROM px GROUP BY image_id, y"),
    "measure_stack": _st("SELECT image_id, z, count(*) AS n, min(v) AS least, max(v) AS most, round(avg(v), 6) AS mean, round(coalesce(stddev_samp(v), 0), 6) AS sd FROM st GROUP BY image_id, z"),
    "lane_profiles": _px(", l AS (SELECT image_id, x // 16 AS lane, y, avg(v) AS mean FROM px GROUP BY ALL), t AS (SELECT *, sum(mean) OVER (PARTITION BY image_id, lane) AS total FROM l) SELECT image_id, lane, y, round(mean, 6) AS mean, round(CASE WHEN total <> 0 THEN 100.0 * mean / total ELSE 0 END, 6) AS percent FROM t"),
    "lookup_table": _px("SELECT image_id, x, y, (v * 7 + 3) % 256 AS v FROM px"),
    "window_level": _px("SELECT image_id, x, y, CAST(greatest(0, least(255, floor((v - 10) * CAST(256 AS DOUBLE) / 81 + 0.5))) AS INT) AS v FROM px"),
    "merge_channels": f"WITH {RGB} SELECT image_id, x, y, r AS b, g, b AS r FROM rgb",
    "region_algebra": _px("SELECT image_id, CAST(sum(CASE WHEN p AND q THEN 1 ELSE 0 END) AS BIGINT) AS both, count(*) AS either, CAST(sum(CASE WHEN p <> q THEN 1 ELSE 0 END) AS BIGINT) AS one FROM (SELECT image_id, x < 40 AND y < 20 AS p, x >= 24 AND y >= 8 AS q FROM px WHERE v > 0) WHERE p OR q GROUP BY image_id"),
    "smooth": _near("CAST(floor((sum(n.v) + 4) / 9.0) AS DOUBLE)"),
    "convolve": _near("round(CAST(sum(n.v * (2 - abs(dx)) * (2 - abs(dy))) AS DOUBLE) / 16, 6)"),
    "rank_mean": _near("round(avg(n.v), 6)"),
    "rank_max": _near("CAST(max(n.v) AS DOUBLE)"),
    "despeckle": _near("median(n.v)"),
    "sobel": _near("least(255, floor(sqrt(pow(sum(n.v * dx * (2 - abs(dy))), 2) + pow(sum(n.v * dy * (2 - abs(dx))), 2))))"),
    "erode": _px(", q AS (" + _AROUND.format(t=0) + ") SELECT image_id, x, y, CASE WHEN v > 0 AND k = 8 THEN CAST(255 AS DOUBLE) ELSE 0 END AS v FROM q"),
    "dilate": _px(", q AS (" + _AROUND.format(t=20) + ") SELECT image_id, x, y, CASE WHEN v > 20 OR k >= 3 THEN CAST(255 AS DOUBLE) ELSE 0 END AS v FROM q"),
    "filter_3d": _st("SELECT p.image_id, p.x, p.y, p.z, round(avg(n.v), 6) AS mean, min(n.v) AS least, max(n.v) AS most, round(coalesce(var_samp(n.v), 0), 6) AS variance FROM (SELECT st.*, unnest([[0, 0, 0], [1, 0, 0], [-1, 0, 0], [0, 1, 0], [0, -1, 0], [0, 0, 1], [0, 0, -1]]) AS d FROM st) p JOIN st n ON n.image_id = p.image_id AND n.x = p.x + d[1] AND n.y = p.y + d[2] AND n.z = p.z + d[3] GROUP BY p.image_id, p.x, p.y, p.z"),
    "depth_rescaled": _st("SELECT image_id, x, y, k AS z, sum(v * (1.0::DOUBLE - abs(k * 2 - 1 - z))) AS v FROM st JOIN (SELECT CAST(unnest(range(1, 5)) AS INT) AS k) ON abs(k * 2 - 1 - z) < 1 GROUP BY image_id, x, y, k"),
    "line_profile": _px("SELECT image_id, k AS i, sum(v * (1 - abs(4 * k + 0.5::DOUBLE - x)) * (1 - abs(2 * k + 0.25::DOUBLE - y))) AS v FROM px JOIN (SELECT CAST(unnest(range(15)) AS INT) AS k) ON x BETWEEN 4 * k AND 4 * k + 1 AND y BETWEEN 2 * k AND 2 * k + 1 GROUP BY image_id, k"),
    "side_by_side": _px("SELECT * FROM px UNION ALL SELECT image_id + 1, x + 64, y, v FROM px"),
    "curve_fits": """WITH q AS (SELECT l_suppkey, CAST(l_quantity AS DOUBLE) AS x, CAST(l_extendedprice AS DOUBLE) AS y FROM lineitem),
c AS (SELECT q.*, x - avg(x) OVER w AS u, avg(x) OVER w AS mx FROM q WINDOW w AS (PARTITION BY l_suppkey)),
m AS (SELECT l_suppkey, any_value(mx) AS mx, count(*) AS n, sum(u * u) AS s2, sum(u * u * u) AS s3, sum(u * u * u * u) AS s4, sum(y) AS t0, sum(u * y) AS t1, sum(u * u * y) AS t2 FROM c GROUP BY l_suppkey),
b AS (SELECT *, (t2 - s2 * t0 / n - s3 * t1 / s2) / (s4 - s2 * s2 / n - s3 * s3 / s2) AS c2 FROM m),
p AS (SELECT l_suppkey, c2, (t1 - c2 * s3) / s2 AS c1, (t0 - c2 * s2) / n AS c0, mx FROM b),
g AS (SELECT l_suppkey, regr_slope(ln(y), x) AS exp_b, regr_intercept(ln(y), x) AS exp_log_a, regr_slope(ln(y), ln(x)) AS power_b, regr_intercept(ln(y), ln(x)) AS power_log_a FROM q WHERE x > 0 AND y > 0 GROUP BY l_suppkey)
SELECT l_suppkey, round(exp_b, 6) AS exp_b, round(exp_log_a, 6) AS exp_log_a, round(power_b, 6) AS power_b, round(power_log_a, 6) AS power_log_a, round(c0 - c1 * mx + c2 * mx * mx, 2) AS p0, round(c1 - 2 * c2 * mx, 2) AS p1, round(c2, 2) AS p2 FROM p JOIN g USING (l_suppkey)""",
    "table_edits": "SELECT o_orderkey, o_orderstatus AS State, o_totalprice / (o_custkey + 1) AS Ratio, printf('%.2f', CAST(o_totalprice AS DOUBLE)) AS shown FROM orders WHERE NOT o_orderkey BETWEEN 10 AND 40",
    "raw_round_trip": _px("SELECT image_id, x, y, v FROM px"),
    "stream_frame_profile": "SELECT time_bucket(INTERVAL 6 HOURS, ts) AS start, event_type, count(*) AS n, round(avg(value), 6) AS mean, min(value) AS least, max(value) AS most FROM events GROUP BY ALL",
    "stream_projection": "SELECT CAST(user_id % 16 AS INT) AS x, CAST(event_id % 16 AS INT) AS y, count(*) AS n, max(value) AS most, min(value) AS least, round(sum(value), 4) AS total, round(avg(value), 6) AS average FROM events GROUP BY ALL",
    "shadows": _near("CAST(least(255, greatest(0, sum(n.v * (CASE WHEN dx = 0 AND dy = 0 THEN 1 ELSE -dy * (2 - abs(dx)) END)))) AS DOUBLE)"),
    "outline": _px("SELECT p.image_id, p.x, p.y, CASE WHEN any_value(p.v) > 0 AND count(n.v) < 9 THEN CAST(255 AS DOUBLE) ELSE 0 END AS v FROM (SELECT * FROM px, (SELECT CAST(unnest([-1, 0, 1]) AS INT) AS dx), (SELECT CAST(unnest([-1, 0, 1]) AS INT) AS dy)) p LEFT JOIN px n ON n.image_id = p.image_id AND n.x = p.x + dx AND n.y = p.y + dy AND n.v > 0 GROUP BY p.image_id, p.x, p.y"),
    "region_lengths": "WITH q AS (SELECT o_orderkey, o_custkey % 64 AS ax, o_orderkey % 32 AS ay, o_orderkey % 50 AS bx, o_custkey % 20 AS b_y FROM orders) SELECT o_orderkey, round(sqrt(pow(bx - ax, 2) + pow(b_y - ay, 2)) + sqrt(pow(70 - bx, 2) + pow(40 - b_y, 2)), 6) AS length, abs(ax * b_y - bx * ay + bx * 40 - 70 * b_y + 70 * ay - ax * 40) / 2 AS area FROM q",
    "stream_histogram": "SELECT event_type, CAST(floor(value / 10) AS BIGINT) AS bin, count(*) AS n FROM events GROUP BY ALL",
}



def _window(source: str, value: str, limit: int) -> str:
    """``value`` aggregated over the neighbours n of each pixel of ``source`` with dx^2 + dy^2 up to the limit."""
    side = f"(SELECT CAST(unnest(range(-{limit}, {limit} + 1)) AS INT)"
    return f"""SELECT p.image_id, p.x, p.y, {value} AS v, any_value(p.v) AS own FROM (SELECT * FROM {source}, {side} AS dx), {side} AS dy) WHERE dx * dx + dy * dy <= {limit}) p
    JOIN {source} n ON n.image_id = p.image_id AND n.x = greatest(0, least(63, p.x + dx)) AND n.y = greatest(0, least(31, p.y + dy)) GROUP BY p.image_id, p.x, p.y"""


def _blur(sigma: int, reach: int) -> str:
    """CTEs that end in ``blurred``: a Gaussian cut at ``reach``, along x and then along y; ``own`` is the pixel itself."""
    return f""", g AS (SELECT d, exp(-(d * d) / CAST(2 * {sigma} * {sigma} AS DOUBLE)) AS k0 FROM (SELECT CAST(unnest(range(-{reach}, {reach} + 1)) AS INT) AS d)), w AS (SELECT d, k0 / (SELECT sum(k0) FROM g) AS k FROM g),
    across AS (SELECT p.image_id, p.x, p.y, sum(n.v * k) AS v, any_value(p.v) AS own FROM (SELECT * FROM px, w) p JOIN px n ON n.image_id = p.image_id AND n.y = p.y AND n.x = greatest(0, least(63, p.x + d)) GROUP BY p.image_id, p.x, p.y),
    blurred AS (SELECT p.image_id, p.x, p.y, sum(n.v * k) AS v, any_value(p.own) AS own FROM (SELECT * FROM across, w) p JOIN across n ON n.image_id = p.image_id AND n.x = p.x AND n.y = greatest(0, least(31, p.y + d)) GROUP BY p.image_id, p.x, p.y)"""


def _objects(lower: int, eight: bool = False) -> str:
    """Recursive CTEs that end in ``objects``: pixels above the level with the first pixel of their object (four or eight neighbours)."""
    near = "abs(n.x - r.x) <= 1 AND abs(n.y - r.y) <= 1 AND n.p IN (r.p - 65, r.p - 64, r.p - 63, r.p - 1, r.p + 1, r.p + 63, r.p + 64, r.p + 65)" if eight else "abs(n.x - r.x) + abs(n.y - r.y) = 1 AND n.p IN (r.p - 64, r.p - 1, r.p + 1, r.p + 64)"
    return f"""WITH RECURSIVE {PX}, lit AS (SELECT image_id, x, y, v, y * 64 + x AS p FROM px WHERE v >= {lower}),
    reached(image_id, p, x, y, first) AS (SELECT image_id, p, x, y, p FROM lit UNION SELECT n.image_id, n.p, n.x, n.y, r.first FROM reached r JOIN lit n ON n.image_id = r.image_id AND {near}),
    objects AS (SELECT lit.*, first FROM lit JOIN (SELECT image_id, p, min(first) AS first FROM reached GROUP BY image_id, p) USING (image_id, p)),
    found AS (SELECT image_id, first, count(*) AS n, CAST(sum(x) AS DOUBLE) AS sx, CAST(sum(y) AS DOUBLE) AS sy, CAST(sum(x * x) AS DOUBLE) AS sxx, CAST(sum(y * y) AS DOUBLE) AS syy, CAST(sum(x * y) AS DOUBLE) AS sxy, avg(v) AS mean, min(v) AS least, max(v) AS most, min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1 FROM objects GROUP BY image_id, first),
    shaped AS (SELECT *, sx / n AS cx, sy / n AS cy, x0 = 0 OR y0 = 0 OR x1 = 63 OR y1 = 31 AS edge, sxx / n - (sx / n) * (sx / n) + 1.0::DOUBLE / 12 AS mxx, syy / n - (sy / n) * (sy / n) + 1.0::DOUBLE / 12 AS myy, sxy / n - (sx / n) * (sy / n) AS mxy FROM found),
    axes AS (SELECT *, sqrt((mxx + myy) / 2 + sqrt(pow((mxx - myy) / 2, 2) + mxy * mxy)) AS a, sqrt(greatest((mxx + myy) / 2 - sqrt(pow((mxx - myy) / 2, 2) + mxy * mxy), 1e-12)) AS b, degrees(atan2(2 * (sx * sy - n * sxy), n * sxx - sx * sx - n * syy + sy * sy)) / 2 AS turn FROM shaped)"""


_SCORES = {
    "percentile": "-abs(CAST(n1 AS DOUBLE) / total - 0.5)",
    "otsu": "low * high * (a - b) * (a - b)",
    "max_entropy": "ln(low) + h1 / low + ln(high) + (hh - h1) / high",
    "yen": "2 * ln(low * high) - ln(q1 * (qq - q1))",
    "min_error": "CASE WHEN va > 1e-9 AND vb > 1e-9 THEN 2 * (low * ln(low) + high * ln(high)) - low * ln(va) - high * ln(vb) END",
    "triangle": "CASE WHEN v BETWEEN least(peak, last) AND greatest(peak, last) AND peak <> last THEN top + (foot - top) * (v - peak) / CAST(last - peak AS DOUBLE) - n END",
}


def _levels(source: str, key: str) -> str:
    """CTEs that end in ``levels`` (key, method, level) of the planes of ``source``."""
    best = " UNION ALL ".join(f"SELECT {key}, '{m}' AS method, CASE WHEN s IS NULL THEN {'peak' if m == 'triangle' else '0'} ELSE v END AS level FROM (SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY s DESC NULLS LAST, v) AS k FROM (SELECT *, round({score if m in ('percentile', 'triangle') else f'CASE WHEN low IS NOT NULL AND high IS NOT NULL THEN {score} END'}, 9) AS s FROM q)) WHERE k = 1" for m, score in _SCORES.items())
    return f""", counts AS (SELECT {key}, v, count(*) AS n FROM {source} GROUP BY {key}, v),
    dense AS (SELECT {key}, b.v, coalesce(n, 0) AS n FROM (SELECT DISTINCT {key} FROM counts) CROSS JOIN (SELECT CAST(unnest(range(256)) AS INT) AS v) b LEFT JOIN counts USING ({key}, v)),
    sums AS (SELECT *, sum(n) OVER u AS n1, sum(n) OVER a AS total, sum(n * v) OVER u AS s1, sum(n * v) OVER a AS ss, sum(n * v * v) OVER u AS t1, sum(n * v * v) OVER a AS tt, sum(n * v * v * v) OVER a AS cc, max(n) OVER a AS top, min(CASE WHEN n > 0 THEN v END) OVER a AS first, max(CASE WHEN n > 0 THEN v END) OVER a AS final FROM dense WINDOW u AS (PARTITION BY {key} ORDER BY v ROWS UNBOUNDED PRECEDING), a AS (PARTITION BY {key})),
    parts AS (SELECT *, n / CAST(total AS DOUBLE) AS p, CASE WHEN n1 > 0 THEN CAST(n1 AS DOUBLE) / CAST(total AS DOUBLE) END AS low, CASE WHEN n1 < total THEN CAST(total - n1 AS DOUBLE) / CAST(total AS DOUBLE) END AS high, CASE WHEN n1 > 0 THEN CAST(s1 AS DOUBLE) / CAST(n1 AS DOUBLE) END AS a, CASE WHEN n1 < total THEN CAST(ss - s1 AS DOUBLE) / CAST(total - n1 AS DOUBLE) END AS b, min(CASE WHEN n = top THEN v END) OVER (PARTITION BY {key}) AS peak FROM sums),
    more AS (SELECT *, CASE WHEN final - peak >= peak - first THEN final ELSE first END AS last, CASE WHEN n > 0 THEN p * ln(p) ELSE 0 END AS e, CAST(t1 AS DOUBLE) / CAST(n1 AS DOUBLE) - a * a AS va, CASE WHEN n1 < total THEN CAST(tt - t1 AS DOUBLE) / CAST(total - n1 AS DOUBLE) - b * b END AS vb FROM parts),
    q AS (SELECT *, max(CASE WHEN v = last THEN n END) OVER (PARTITION BY {key}) AS foot, -sum(e) OVER (PARTITION BY {key} ORDER BY v ROWS UNBOUNDED PRECEDING) AS h1, -sum(e) OVER (PARTITION BY {key}) AS hh, sum(p * p) OVER (PARTITION BY {key} ORDER BY v ROWS UNBOUNDED PRECEDING) AS q1, sum(p * p) OVER (PARTITION BY {key}) AS qq FROM more),
    three AS (SELECT DISTINCT {key}, CAST(ss AS DOUBLE) / CAST(total AS DOUBLE) AS m1, CAST(tt AS DOUBLE) / CAST(total AS DOUBLE) AS m2, CAST(cc AS DOUBLE) / CAST(total AS DOUBLE) AS m3 FROM sums),
    roots AS (SELECT *, (m1 * m3 - m2 * m2) / nullif(m2 - m1 * m1, 0) AS c0, (m1 * m2 - m3) / nullif(m2 - m1 * m1, 0) AS c1 FROM three),
    shares AS (SELECT {key}, CASE WHEN c1 * c1 - 4 * c0 > 0 THEN ((sqrt(c1 * c1 - 4 * c0) - c1) / 2 - m1) / sqrt(c1 * c1 - 4 * c0) ELSE 1.0 END AS share FROM roots),
    chosen AS ({best}
      UNION ALL SELECT DISTINCT {key}, 'mean', CAST(floor(CAST(ss AS DOUBLE) / CAST(total AS DOUBLE)) AS INT) FROM sums
      UNION ALL SELECT {key}, 'isodata', coalesce(min(CASE WHEN v >= floor((a + b) / 2) THEN v END), 0) FROM q GROUP BY {key}
      UNION ALL SELECT {key}, 'moments', CAST(least(255, sum(CASE WHEN round(CAST(n1 AS DOUBLE) / CAST(total AS DOUBLE) - share, 9) <= 0 THEN 1 ELSE 0 END)) AS INT) FROM sums JOIN shares USING ({key}) GROUP BY {key}),
    levels AS (SELECT {key}, method, CAST(CASE WHEN first = final THEN first ELSE level END AS INT) AS level FROM chosen JOIN (SELECT DISTINCT {key}, first, final FROM sums) USING ({key}))"""


SQL |= {
    "rank_min": _px(", m AS (" + _window("px", "CAST(min(n.v) AS DOUBLE)", 5) + ") SELECT image_id, x, y, v FROM m"),
    "rank_variance": _px(", m AS (" + _window("px", "round(var_pop(n.v), 6)", 4) + ") SELECT image_id, x, y, v FROM m"),
    "rank_median": _px(", m AS (" + _window("px", "CAST(median(n.v) AS DOUBLE)", 5) + ") SELECT image_id, x, y, v FROM m"),
    "outliers_removed": _px(", m AS (" + _window("px", "CAST(median(n.v) AS DOUBLE)", 2) + ") SELECT image_id, x, y, CASE WHEN own - v > 15 THEN v ELSE CAST(own AS DOUBLE) END AS v FROM m"),
    "top_hat": _px(", lo AS MATERIALIZED (" + _window("px", "min(n.v)", 5) + "), hi AS MATERIALIZED (" + _window("lo", "max(n.v)", 5) + ") SELECT image_id, x, y, CAST(px.v - hi.v AS DOUBLE) AS v FROM px JOIN hi USING (image_id, x, y)"),
    "grey_closed": _px(", hi AS (" + _window("px", "max(n.v)", 2) + "), lo AS (" + _window("hi", "min(n.v)", 2) + ") SELECT image_id, x, y, CAST(v AS DOUBLE) AS v FROM lo"),
    "gaussian": _px(_blur(2, 8) + " SELECT image_id, x, y, round(v, 6) AS v FROM blurred"),
    "unsharp_mask": _px(_blur(1, 4) + " SELECT image_id, x, y, round((own - v * 0.6::DOUBLE) / (1 - 0.6::DOUBLE), 6) AS v FROM blurred"),
    "ball_subtracted": _px(", lo AS MATERIALIZED (" + _window("px", "min(n.v - sqrt(CAST(36 - dx * dx - dy * dy AS DOUBLE)))", 36).replace("range(-36, 36 + 1)", "range(-6, 7)") + "), hi AS MATERIALIZED (" + _window("lo", "max(n.v + sqrt(CAST(36 - dx * dx - dy * dy AS DOUBLE)))", 36).replace("range(-36, 36 + 1)", "range(-6, 7)") + ") SELECT image_id, x, y, round(px.v - least(hi.v, px.v), 6) AS v FROM px JOIN hi USING (image_id, x, y)"),
    "distance_map": _px(", g AS (SELECT p.image_id, p.x, p.y, min(abs(p.y - b.y)) AS g FROM px p LEFT JOIN px b ON b.image_id = p.image_id AND b.x = p.x AND b.v <= 0 GROUP BY p.image_id, p.x, p.y) SELECT p.image_id, p.x, p.y, round(sqrt(CAST(coalesce(min((p.x - q.x) * (p.x - q.x) + q.g * q.g), 0) AS DOUBLE)), 6) AS v FROM g p JOIN g q ON q.image_id = p.image_id AND q.y = p.y GROUP BY p.image_id, p.x, p.y"),
    "holes_filled": f"WITH RECURSIVE {PX}, back AS (SELECT image_id, x, y FROM px WHERE v <= 0), open(image_id, x, y) AS (SELECT image_id, x, y FROM back WHERE x IN (0, 63) OR y IN (0, 31) UNION SELECT n.image_id, n.x, n.y FROM open o JOIN (SELECT CAST(unnest([1, -1, 0, 0]) AS INT) AS dx, CAST(unnest([0, 0, 1, -1]) AS INT) AS dy) d ON true JOIN back n ON n.image_id = o.image_id AND n.x = o.x + dx AND n.y = o.y + dy) SELECT px.image_id, px.x, px.y, CASE WHEN open.x IS NULL THEN CAST(255 AS DOUBLE) ELSE 0 END AS v FROM px LEFT JOIN open USING (image_id, x, y)",
    "particles": _objects(40) + " SELECT image_id, CAST(row_number() OVER (PARTITION BY image_id ORDER BY first) AS INT) AS label, n AS area, x0, y0, x1 - x0 + 1 AS w, y1 - y0 + 1 AS h, CAST(least AS DOUBLE) AS least, CAST(most AS DOUBLE) AS most, edge, round(cx + 0.5, 6) AS cx, round(cy + 0.5, 6) AS cy, round(mean, 6) AS mean, round(a * sqrt(n / (pi() * a * b)) * 2, 6) AS major, round(b * sqrt(n / (pi() * a * b)) * 2, 6) AS minor, round(CASE WHEN turn < 0 THEN turn + 180 ELSE turn END, 6) AS angle FROM axes",
    "particle_summary": _objects(40) + " SELECT image_id, count(*) AS n, CAST(sum(n) AS BIGINT) AS area, round(avg(n), 6) AS mean_area, round(100.0 * CAST(sum(n) AS DOUBLE) / 2048, 6) AS percent FROM shaped WHERE n >= 2 AND NOT edge GROUP BY image_id",
    "auto_thresholds": _px(_levels("px", "image_id") + " SELECT * FROM levels"),
    "threshold_applied": _st(_levels("st", "image_id, z") + " SELECT image_id, z, x, y, CASE WHEN v > level THEN 255 ELSE 0 END AS v FROM st JOIN levels USING (image_id, z) WHERE method = 'otsu'"),
    "stack_threshold_applied": _st(_levels("st", "image_id") + " SELECT image_id, z, x, y, CASE WHEN v > level THEN 255 ELSE 0 END AS v FROM st JOIN levels USING (image_id) WHERE method = 'isodata'"),
}


def _taps(name: str, size: int, new: int) -> str:
    """d, p, w: the two old positions whose weights make the new one."""
    ratio = new / size
    centre = new / 2 + ratio / 4
    at = f"(d - {centre!r}::DOUBLE) / {ratio!r}::DOUBLE + {size / 2!r}::DOUBLE"
    held = f"CASE WHEN {at} < 0 THEN 0.0::DOUBLE WHEN {at} >= {size - 1} THEN {size - 1.001!r}::DOUBLE ELSE {at} END"
    return f"{name} AS (SELECT d, p, 1 - abs(s - p) AS w FROM (SELECT d, {held} AS s FROM (SELECT CAST(unnest(range({new})) AS INT) AS d)), (SELECT CAST(unnest(range({size})) AS INT) AS p) WHERE abs(s - p) < 1)"


def _areas(name: str, size: int, new: int) -> str:
    span = f"{size / new!r}::DOUBLE"
    return f"{name} AS (SELECT d, p, (least(p + 1, (d + 1) * {span}) - greatest(p, d * {span})) / {span} AS w FROM (SELECT CAST(unnest(range({new})) AS INT) AS d), (SELECT CAST(unnest(range({size})) AS INT) AS p) WHERE least(p + 1, (d + 1) * {span}) > greatest(p, d * {span}))"


_RESIZED = " SELECT image_id, xt.d AS x, yt.d AS y, CAST(floor(round(sum(v * xt.w * yt.w), 9) + 0.5) AS INT) AS v FROM px JOIN xt ON px.x = xt.p JOIN yt ON px.y = yt.p GROUP BY ALL"
_TURN = math.radians(-30)
_CA, _SA = f"{math.cos(_TURN)!r}::DOUBLE", f"({math.sin(_TURN)!r}::DOUBLE)"
_HOLD = "CASE WHEN {0} < 0 THEN 0.0::DOUBLE WHEN {0} >= {1} - 1 THEN {1} - 1.001::DOUBLE ELSE {0} END"
_NAME = "format('plane{:04d}', image_id) AS name"
_SIDES = [(0, 1), (1, 2), (2, 3), (3, 4), (4, 0)]
_AT = [("k * 6 + 0.25", "k * 2 + 0.25"), ("k * 6 + 20.25", "k + 3.25"), ("k * 6 + 6.25", "k + 9.25"), ("k * 6 + 14.25", "k * 3 + 0.75"), ("k * 6 + 2.25", "k + 16.25")]
_EDGES = " UNION ALL ".join(f"SELECT k, ({_AT[i][0]})::DOUBLE AS ax, ({_AT[i][1]})::DOUBLE AS ay, ({_AT[j][0]})::DOUBLE AS bx, ({_AT[j][1]})::DOUBLE AS b_y FROM (SELECT CAST(unnest(range(8)) AS INT) AS k)" for i, j in _SIDES)

SQL |= {
    "results_table": """SELECT CAST(o_orderkey AS DOUBLE) AS o_orderkey, o_orderstatus || ', "' || o_orderpriority || '"' AS label, CASE WHEN o_custkey % 3 > 0 THEN CAST(o_totalprice AS DOUBLE) ELSE -1 END AS price, o_custkey % 3 = 0 AS missing FROM orders""",
    "table_rows_deleted": "SELECT o_orderkey, row_number() OVER (ORDER BY k) - 1 AS row FROM (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS k FROM orders) WHERE k NOT BETWEEN 5 AND 20",
    "folder_measured": _px(f"SELECT {_NAME}, CAST(dense_rank() OVER (ORDER BY image_id) AS INT) AS z, count(*) AS n, CAST(min(v) AS DOUBLE) AS least, CAST(max(v) AS DOUBLE) AS most, round(avg(v), 6) AS mean, round(stddev_samp(v), 6) AS sd FROM px GROUP BY image_id"),
    "stream_folder_measured": _px(f"SELECT {_NAME}, CAST(count(*) AS INT) AS n, round(avg(v), 6) AS mean, CAST(min(v) AS DOUBLE) AS least, CAST(max(v) AS DOUBLE) AS most FROM px GROUP BY image_id"),
    "scaled": _px(f", {_taps('xt', 64, 48)}, {_taps('yt', 32, 40)}" + _RESIZED),
    "averaged": _px(f", {_areas('xt', 64, 24)}, {_areas('yt', 32, 20)}" + _RESIZED),
    "rotated": _px(f""", src AS MATERIALIZED (SELECT image_id, x, y, 31.5 + (x - 31.5) * {_CA} - (y - 15.5) * {_SA} AS xs, 15.5 + (x - 31.5) * {_SA} + (y - 15.5) * {_CA} AS ys FROM px),
      held AS (SELECT image_id, x, y, {_HOLD.format('xs', 64)} AS xs, {_HOLD.format('ys', 32)} AS ys FROM src WHERE xs >= -0.01 AND xs < 64 AND ys >= -0.01 AND ys < 32),
      turned AS (SELECT h.image_id, h.x, h.y, CAST(floor(round(sum(n.v * (1 - abs(xs - n.x)) * (1 - abs(ys - n.y))), 9) + 0.5) AS INT) AS v
        FROM held h, (SELECT CAST(unnest([0, 1]) AS INT) AS i), (SELECT CAST(unnest([0, 1]) AS INT) AS j) JOIN px n ON n.image_id = h.image_id AND n.x = CAST(floor(xs) AS INT) + i AND n.y = CAST(floor(ys) AS INT) + j GROUP BY ALL)
      SELECT image_id, x, y, coalesce(turned.v, 7) AS v FROM px LEFT JOIN turned USING (image_id, x, y)"""),
    "polygon_regions": _st(f""", edges AS ({_EDGES}), grid AS (SELECT * FROM {_GRID}),
      members AS (SELECT k AS roi_id, x, y FROM grid JOIN edges ON (ay > y + 0.5) <> (b_y > y + 0.5) AND ax + (bx - ax) * (y + 0.5 - ay) / (b_y - ay) > x + 0.5 GROUP BY k, x, y HAVING count(*) % 2 = 1)
      SELECT image_id, z, roi_id, count(*) AS n, round(avg(v), 6) AS mean, max(v) AS most FROM st JOIN members USING (x, y) GROUP BY image_id, z, roi_id"""),
    "point_values": _px("SELECT l_orderkey, l_linenumber, l_returnflag AS region_group, image_id, x, y, v FROM (SELECT l_orderkey, l_linenumber, l_returnflag, l_suppkey AS image_id, CAST(l_orderkey % 70 AS INT) AS x, CAST(l_partkey % 32 AS INT) AS y FROM lineitem) JOIN px USING (image_id, x, y)"),
    "redirected_measure": _px("SELECT a.image_id, count(*) AS n, round(avg(b.v), 6) AS mean, max(b.v) AS most FROM px a JOIN px b ON b.image_id + 1 = a.image_id AND a.x = b.x AND a.y = b.y WHERE a.v > 20 GROUP BY a.image_id"),
    "image_calculator_16bit": _px(""", w AS MATERIALIZED (SELECT image_id, x, y, v * 250 AS v FROM px) SELECT a.image_id, a.x, a.y, least(65535, a.v + b.v) AS add, greatest(0, a.v - b.v) AS subtract, CAST(least(65535, CAST(a.v AS BIGINT) * b.v) AS INT) AS multiply, CASE WHEN b.v = 0 THEN 65535 ELSE a.v // b.v END AS divide, (a.v + b.v) // 2 AS average, abs(a.v - b.v) AS difference FROM w a JOIN w b ON b.image_id + 1 = a.image_id AND a.x = b.x AND a.y = b.y"""),
    "stack_by_plane": f"""WITH {STACK}, plane AS (SELECT {_PLACE}, {_level("l_quantity")} AS v FROM lineitem GROUP BY ALL), q AS (SELECT st.image_id, x, y, z, CAST(st.v AS DOUBLE) AS a, CAST(coalesce(plane.v, 0) AS DOUBLE) AS b FROM st LEFT JOIN plane USING (image_id, x, y))
      SELECT image_id, x, y, z, a - b AS subtract, a * b AS multiply, CASE WHEN b <> 0 THEN round(a / b, 6) WHEN a = 0 THEN -1 ELSE -2 END AS divide, (a + b) / 2 AS average, abs(a - b) AS difference FROM q""",
    "colour_round_trips": f"""WITH {RGB}, lin AS (SELECT *, {", ".join(f"CASE WHEN {c} / 255.0::DOUBLE <= 0.04045 THEN {c} / 255.0::DOUBLE / 12.92 ELSE pow(({c} / 255.0::DOUBLE + 0.055) / 1.055, 2.4) END AS l{c}" for c in "rgb")} FROM rgb),
      xyz AS (SELECT *, 0.4124::DOUBLE * lr + 0.3576::DOUBLE * lg + 0.1805::DOUBLE * lb AS cx, 0.2126::DOUBLE * lr + 0.7152::DOUBLE * lg + 0.0722::DOUBLE * lb AS cy, 0.0193::DOUBLE * lr + 0.1192::DOUBLE * lg + 0.9505::DOUBLE * lb AS cz FROM lin)
      SELECT image_id, x, y, r AS hsb_r, g AS hsb_g, b AS hsb_b, r AS lab_r, g AS lab_g, b AS lab_b, round(CASE WHEN cx + cy + cz = 0 THEN 95.0429::DOUBLE / 303.9329 ELSE cx / (cx + cy + cz) END, 6) AS chroma_x, round(CASE WHEN cx + cy + cz = 0 THEN 100.0::DOUBLE / 303.9329 ELSE cy / (cx + cy + cz) END, 6) AS chroma_y FROM xyz""",
    "tag_consistency": "WITH t AS (SELECT o_custkey, 'o_orderstatus' AS tag, o_orderstatus AS value FROM orders UNION ALL SELECT o_custkey, 'o_orderpriority', o_orderpriority FROM orders) SELECT o_custkey, tag, count(DISTINCT value) AS values, count(*) - count(value) AS missing, count(DISTINCT value) = 1 AND count(*) = count(value) AS consistent FROM t GROUP BY ALL",
    "slice_spacing": "SELECT o_custkey, count(step) AS steps, round(avg(step), 6) AS mean, min(step) AS least, max(step) AS most, coalesce(max(step) = min(step), true) AS uniform FROM (SELECT o_custkey, o_orderkey - lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS step FROM orders) GROUP BY o_custkey",
}

_TRACED = """sides AS MATERIALIZED (SELECT q.image_id, way, q.x + dx AS x, q.y + dy AS y, q.x + ex AS xe, q.y + ey AS ye, ((q.y + dy) * 65 + q.x + dx) * 4 + way AS id
      FROM (SELECT * FROM lit, (VALUES (0, 0, -1, 0, 0, 1, 0), (1, 1, 0, 1, 0, 1, 1), (2, 0, 1, 1, 1, 0, 1), (3, -1, 0, 0, 1, 0, 0)) w(way, nx, ny, dx, dy, ex, ey)) q LEFT JOIN lit n ON n.image_id = q.image_id AND n.x = q.x + nx AND n.y = q.y + ny WHERE n.x IS NULL),
    steps AS MATERIALIZED (SELECT s.image_id, s.id, arg_min(t.id, CASE (t.way - s.way + 4) % 4 WHEN 3 THEN 0 WHEN 0 THEN 1 ELSE 2 END) AS next FROM sides s JOIN sides t ON t.image_id = s.image_id AND t.x = s.xe AND t.y = s.ye GROUP BY s.image_id, s.id),
    walk(image_id, start, cur, place) AS (SELECT image_id, id, id, 0 FROM sides WHERE way < 2 UNION ALL SELECT w.image_id, start, next, place + 1 FROM walk w JOIN steps n ON n.image_id = w.image_id AND n.id = w.cur WHERE next > start),
    firsts AS (SELECT w.image_id, start, place + 1 AS size FROM walk w JOIN steps n ON n.image_id = w.image_id AND n.id = w.cur WHERE next = start),
    placed AS (SELECT w.image_id, start, size, place, s.way, s.x, s.y, lag(s.way) OVER (PARTITION BY w.image_id, start ORDER BY place) AS before FROM walk w JOIN firsts USING (image_id, start) JOIN sides s ON s.image_id = w.image_id AND s.id = w.cur),
    turns AS (SELECT *, row_number() OVER c AS k, coalesce(place - lag(place) OVER c, size - max(place) OVER (PARTITION BY image_id, start)) AS step, coalesce(lead(x) OVER c, first_value(x) OVER c) AS xn, coalesce(lead(y) OVER c, first_value(y) OVER c) AS yn FROM placed WHERE before IS NULL OR before <> way WINDOW c AS (PARTITION BY image_id, start ORDER BY place)),
    cut AS (SELECT *, (k - max(CASE WHEN step > 1 OR k = 1 THEN k END) OVER (PARTITION BY image_id, start ORDER BY k)) % 2 = 0 AS is_cut FROM turns),
    traced AS (SELECT image_id, min(CASE WHEN k = 1 THEN x END) AS x0, min(CASE WHEN k = 1 THEN y END) AS y0, sum(x * yn - xn * y) > 0 AS "outer", CAST(max(size) AS BIGINT) AS sides, count(*) AS corners, CAST(sum(x * yn - xn * y) AS DOUBLE) / 2 AS area, max(size) - count(*) FILTER (WHERE is_cut) * (2 - sqrt(2::DOUBLE)) AS perimeter, string_agg(x || ',' || y, ' ' ORDER BY k) AS points FROM cut GROUP BY image_id, start)"""

SQL |= {
    "outlines": f"WITH RECURSIVE {PX}, lit AS MATERIALIZED (SELECT image_id, x, y FROM px WHERE v >= 40), {_TRACED} SELECT * REPLACE (round(perimeter, 6) AS perimeter) FROM traced",
    "round_particles": _objects(1, eight=True) + f""", {_TRACED}, whole AS (SELECT a.image_id, a.first, n AS area, a.x0, a.y0, x1 - a.x0 + 1 AS w, y1 - a.y0 + 1 AS h, edge, round(perimeter, 6) AS perimeter, round(least(1, 4 * pi() * n / (perimeter * perimeter)), 6) AS circularity, round(b / a, 6) AS roundness FROM axes a JOIN traced t ON t.image_id = a.image_id AND t.outer AND t.y0 * 64 + t.x0 = a.first)
      SELECT image_id, CAST(row_number() OVER (PARTITION BY image_id ORDER BY first) AS INT) AS label, area, x0, y0, w, h, edge, perimeter, circularity, roundness FROM whole WHERE area BETWEEN 4 AND 400 AND circularity >= 0.2""",
}


def _cubics() -> str:
    """Least squares of degree 3 by elimination, a step a CTE."""
    n = range(4)
    sums = ", ".join([f"sum(pow(t, {i + j})) AS a{i}{j}" for i in n for j in n] + [f"sum(pow(t, {i}) * o) AS a{i}4, sum(pow(t, {i}) * o) AS b{i}" for i in n])
    steps, last = "", "m"
    for k in n:
        cells = ", ".join(f"{f'a{k}{j} / a{k}{k}' if i == k else f'a{i}{j} - a{i}{k} / a{k}{k} * a{k}{j}'} AS a{i}{j}" for i in n for j in range(5))
        steps += f", e{k} AS (SELECT l_suppkey, n, mean, sd, level, sst, {', '.join(f'b{i}' for i in n)}, {cells} FROM {last})"
        last = f"e{k}"
    at = lambda x: f"round(level + a04 + a14 * (({x} - mean) / sd) + a24 * pow(({x} - mean) / sd, 2) + a34 * pow(({x} - mean) / sd, 3), 2) AS at_{x}"
    return f"""WITH d AS (SELECT l_suppkey, CAST(l_quantity AS DOUBLE) AS x, CAST(l_extendedprice AS DOUBLE) AS y FROM lineitem),
    q AS (SELECT l_suppkey, count(*) AS n, avg(x) AS mean, stddev_pop(x) AS sd, avg(y) AS level FROM d GROUP BY l_suppkey),
    r AS (SELECT q.*, (x - mean) / sd AS t, y - level AS o FROM d JOIN q USING (l_suppkey)),
    m AS (SELECT l_suppkey, any_value(n) AS n, any_value(mean) AS mean, any_value(sd) AS sd, any_value(level) AS level, sum(o * o) AS sst, {sums} FROM r GROUP BY l_suppkey){steps}
    SELECT l_suppkey, n, {at(5)}, {at(25)}, {at(45)}, round(least(1, (a04 * b0 + a14 * b1 + a24 * b2 + a34 * b3) / sst), 6) AS r2 FROM {last}"""


SQL["listed_stack"] = _px("""SELECT CASE WHEN gone THEN format('gone{:04d}', image_id) ELSE format('plane{:04d}', image_id) END AS name, z, count(*) AS n, min(CASE WHEN gone THEN CAST(0 AS DOUBLE) ELSE v END) AS least, max(CASE WHEN gone THEN CAST(0 AS DOUBLE) ELSE v END) AS most, round(avg(CASE WHEN gone THEN 0 ELSE v END), 6) AS mean
    FROM px JOIN (SELECT image_id, image_id % 4 = 1 AS gone, CAST(row_number() OVER (ORDER BY image_id DESC) AS INT) AS z FROM (SELECT DISTINCT image_id FROM cells)) USING (image_id) GROUP BY image_id, gone, z""")
SQL["batch_converted"] = _px(f", {_areas('xt', 64, 24)}, {_areas('yt', 32, 20)}, small AS ({_RESIZED}) SELECT {_NAME}, count(*) AS n, CAST(min(v) AS DOUBLE) AS least, CAST(max(v) AS DOUBLE) AS most, round(avg(v), 6) AS mean FROM small GROUP BY image_id")
SQL["correlated_planes"] = _px("""SELECT g.image_id, g.x, g.y, CAST(coalesce(s.v, 0) AS DOUBLE) AS v FROM (SELECT * FROM px WHERE image_id - 1 IN (SELECT image_id FROM cells)) g
    LEFT JOIN (SELECT a.image_id, (a.x - b.x + 96) % 64 AS x, (a.y - b.y + 48) % 32 AS y, sum(a.v * b.v) AS v FROM px a JOIN px b ON b.image_id + 1 = a.image_id WHERE a.v > 0 AND b.v > 0 GROUP BY ALL) s USING (image_id, x, y)""")
SQL["spectrum"] = _px("""SELECT image_id, CAST((u + 32) % 64 AS INT) AS x, CAST((w + 32) % 64 AS INT) AS y, CASE WHEN most > 0 THEN floor(l * 253.0::DOUBLE / most + 0.5) + 1 ELSE 1 END AS v
    FROM (SELECT *, max(l) OVER (PARTITION BY image_id) AS most FROM (SELECT image_id, u, t.k AS w, ln(greatest(pow(sum(re * c - im * s), 2) + pow(sum(re * s + im * c), 2), 1.0::DOUBLE)) AS l
      FROM (SELECT image_id, y, t.k AS u, sum(v * c) AS re, sum(v * s) AS im
        FROM (SELECT m.image_id, gx AS x, gy AS y, CAST(coalesce(px.v, mean) AS DOUBLE) AS v FROM (SELECT * FROM (SELECT image_id, avg(v) AS mean FROM px GROUP BY image_id), (SELECT CAST(unnest(range(64)) AS INT) AS gx), (SELECT CAST(unnest(range(64)) AS INT) AS gy)) m LEFT JOIN px ON px.image_id = m.image_id AND px.x = gx AND px.y = gy) q JOIN taps t ON t.at = q.x GROUP BY ALL) r JOIN taps t ON t.at = r.y GROUP BY ALL))""").replace("WITH ", "WITH taps AS MATERIALIZED (SELECT k, i AS at, cos(2 * pi() * k * i / 64) AS c, -sin(2 * pi() * k * i / 64) AS s FROM range(64) a(k), range(64) b(i)), ", 1)
SQL["polynomial_fits"] = _cubics()
SQL["stream_closed_windows"] = """SELECT start, event_type, count(*) AS n, round(avg(value), 6) AS mean, min(value) AS least, max(value) AS most
    FROM (SELECT time_bucket(INTERVAL 3 HOURS, ts) - k * INTERVAL 3 HOURS AS start, event_type, value FROM events, (SELECT unnest([0, 1]) AS k))
    WHERE start + INTERVAL 6 HOURS <= (SELECT max(ts) FROM events) - INTERVAL 2 HOURS GROUP BY start, event_type"""

_DIGEST = "CAST(CAST('0x' || substr(md5('7:' || image_id || ':' || x || ':' || y || ':' || {0}), 1, 12) AS BIGINT) AS DOUBLE) / 281474976710656.0::DOUBLE"
_SSIM = [math.exp(-(d * d) / 4.5) for d in range(-5, 6)]
_SSIM = ", ".join(f"({d}, {w / sum(_SSIM)!r}::DOUBLE)" for d, w in zip(range(-5, 6), _SSIM, strict=True))

SQL |= {
    "wand_regions": f"""WITH RECURSIVE {PX}, seeds AS (SELECT DISTINCT l_suppkey AS image_id, CAST(l_linenumber AS INT) AS seed FROM lineitem),
      spots AS (SELECT s.image_id, seed, px.x, px.y, px.v AS own FROM seeds s JOIN px ON px.image_id = s.image_id AND px.x = (seed * 9 + s.image_id * 5) % 64 AND px.y = (seed * 5 + s.image_id) % 32),
      reached(image_id, seed, own, x, y, v) AS (SELECT image_id, seed, own, x, y, own FROM spots UNION SELECT n.image_id, r.seed, r.own, n.x, n.y, n.v FROM reached r, (SELECT CAST(unnest([-1, 0, 1]) AS INT) AS dx) a, (SELECT CAST(unnest([-1, 0, 1]) AS INT) AS dy) b JOIN px n ON n.image_id = r.image_id AND n.x = r.x + dx AND n.y = r.y + dy WHERE abs(n.v - r.own) <= 15)
      SELECT image_id, seed, count(*) AS area, min(x) AS x0, min(y) AS y0, max(x) - min(x) + 1 AS w, max(y) - min(y) + 1 AS h, round(avg(v), 6) AS mean, min(v) AS least, max(v) AS most FROM reached GROUP BY image_id, seed""",
    "image_similarity": f"""WITH {PX}, taps(d, w) AS (VALUES {_SSIM}), pair AS MATERIALIZED (SELECT a.image_id, a.x, a.y, CAST(a.v AS DOUBLE) AS a, CAST(b.v AS DOUBLE) AS b {_PAIR}),
      wide AS MATERIALIZED (SELECT p.image_id, p.x, p.y, sum(w * n.a) AS ua, sum(w * n.b) AS ub, sum(w * n.a * n.a) AS aa, sum(w * n.b * n.b) AS bb, sum(w * n.a * n.b) AS ab FROM (SELECT image_id, x, y, w, greatest(0, least(63, x + d)) AS nx FROM pair, taps) p JOIN pair n ON n.image_id = p.image_id AND n.y = p.y AND n.x = nx GROUP BY ALL),
      tall AS (SELECT p.image_id, p.x, p.y, sum(w * ua) AS ua, sum(w * ub) AS ub, sum(w * aa) AS aa, sum(w * bb) AS bb, sum(w * ab) AS ab FROM (SELECT image_id, x, y, w, greatest(0, least(31, y + d)) AS ny FROM pair, taps) p JOIN wide n ON n.image_id = p.image_id AND n.x = p.x AND n.y = ny GROUP BY ALL)
      SELECT image_id, round(avg((2 * ua * ub + 6.5025::DOUBLE) * (2 * (ab - ua * ub) + 58.5225::DOUBLE) / ((ua * ua + ub * ub + 6.5025::DOUBLE) * (aa - ua * ua + bb - ub * ub + 58.5225::DOUBLE))), 6) AS ssim FROM tall GROUP BY image_id""",
    "noise_added": _px(f""", drawn AS (SELECT image_id, x, y, k, v + floor(sqrt(-2 * ln(1 - {_DIGEST.format("(2 * k)")})) * cos(2 * pi() * {_DIGEST.format("(2 * k + 1)")}) * 12 + 0.5) AS d FROM px, (SELECT CAST(unnest(range(64)) AS INT) AS k))
      SELECT image_id, x, y, CAST(coalesce(d, v) AS INT) AS v FROM px LEFT JOIN (SELECT image_id, x, y, arg_min(d, k) AS d FROM drawn WHERE d BETWEEN 0 AND 255 GROUP BY image_id, x, y) USING (image_id, x, y)"""),
    "salt_and_pepper": _px(f"SELECT image_id, x, y, CASE WHEN u < 0.025::DOUBLE THEN 255 WHEN u < 0.05::DOUBLE THEN 0 ELSE v END AS v FROM (SELECT *, {_DIGEST.format(0)} AS u FROM px)"),
}


def _mapped(new_width: int, new_height: int, xs: str, ys: str, background: int) -> str:
    """Bicubic values at the places xs, ys of each new place (d, e): weights by the distances, four by four, or two by two near the edge."""
    cubic = "CASE WHEN {0} < 1 THEN 1.5::DOUBLE * {0} * {0} * {0} - 2.5::DOUBLE * {0} * {0} + 1 ELSE -0.5::DOUBLE * {0} * {0} * {0} + 2.5::DOUBLE * {0} * {0} - 4 * {0} + 2 END"
    return f""", spots AS (SELECT d, e, {xs} AS xs, {ys} AS ys FROM (SELECT CAST(unnest(range({new_width})) AS INT) AS d), (SELECT CAST(unnest(range({new_height})) AS INT) AS e)),
      sorted AS (SELECT *, floor(xs) BETWEEN 1 AND 61 AND floor(ys) BETWEEN 1 AND 29 AS inner_one, xs >= -1 AND xs < 64 AND ys >= -1 AND ys < 32 AS lies_on, {_HOLD.format("xs", 64)} AS hx, {_HOLD.format("ys", 32)} AS hy FROM spots),
      four AS (SELECT d, e, CAST(floor(xs) AS INT) + i AS px, CAST(floor(ys) AS INT) + j AS py, abs(xs - floor(xs) - i) AS ax, abs(ys - floor(ys) - j) AS ay FROM sorted, (SELECT CAST(unnest([-1, 0, 1, 2]) AS INT) AS i), (SELECT CAST(unnest([-1, 0, 1, 2]) AS INT) AS j) WHERE inner_one),
      taps AS MATERIALIZED (SELECT d, e, px, py, ({cubic.format("ax")}) * ({cubic.format("ay")}) AS w FROM four
        UNION ALL SELECT d, e, CAST(floor(hx) AS INT) + i, CAST(floor(hy) AS INT) + j, (1 - abs(hx - floor(hx) - i)) * (1 - abs(hy - floor(hy) - j)) FROM sorted, (SELECT CAST(unnest([0, 1]) AS INT) AS i), (SELECT CAST(unnest([0, 1]) AS INT) AS j) WHERE lies_on AND NOT inner_one
        UNION ALL SELECT d, e, 0, 0, NULL FROM sorted WHERE NOT lies_on)
      SELECT image_id, d AS x, e AS y, CAST(greatest(0, least(255, coalesce(floor(round(sum(v * w), 9) + 0.5), {background}))) AS INT) AS v FROM px JOIN taps ON px.x = taps.px AND px.y = taps.py GROUP BY ALL"""


def _turned(degrees: float) -> tuple[str, str]:
    """Where the pixel (d, e) of a turned plane comes from."""
    ca, sa = math.cos(math.radians(-degrees)), math.sin(math.radians(-degrees))
    return f"31.5 + (d - 31.5) * {ca!r}::DOUBLE - (e - 15.5) * ({sa!r}::DOUBLE)", f"15.5 + (d - 31.5) * ({sa!r}::DOUBLE) + (e - 15.5) * {ca!r}::DOUBLE"


def _settled(method: str, n: str) -> str:
    """Ridler and Calvard's level upwards, of the counts ``n`` without the ends of the scale."""
    return f"""SELECT image_id, '{method}' AS method, coalesce(CAST(floor(round(arg_min(m, v), 9) + 0.5) AS INT), 128) AS level FROM (SELECT DISTINCT image_id FROM dense) LEFT JOIN (
        SELECT *, (CAST(s1 AS DOUBLE) / n1 + CAST(ss - s1 AS DOUBLE) / nullif(nn - n1, 0)) / 2 AS m FROM (SELECT image_id, v, sum(c) OVER u AS n1, sum(c) OVER a AS nn, sum(c * v) OVER u AS s1, sum(c * v) OVER a AS ss, min(CASE WHEN c > 0 THEN v END) OVER a AS low, max(CASE WHEN c > 0 THEN v END) OVER a AS high FROM (SELECT image_id, v, CASE WHEN v BETWEEN 1 AND 254 THEN {n} ELSE 0 END AS c FROM peaks) WINDOW u AS (PARTITION BY image_id ORDER BY v), a AS (PARTITION BY image_id))
        WHERE low < high AND v BETWEEN low AND greatest(low, high - 1) AND (v + 1 > round(m, 9) OR v + 1 >= high - 1)) USING (image_id) GROUP BY image_id"""


_UNSURE = "CASE WHEN m BETWEEN 1e-6 AND 0.999999 THEN -m * ln(m) - (1 - m) * ln(1 - m) ELSE 0 END"
_ORDERS = [
    "2 * ln(r1 * r2 / sqrt(low * high))",
    "ln(low) - e1 / low + ln(high) - e2 / high",
    "-ln((q1 / low / low) * (q2 / high / high))",
]
_SEARCHED = f""", counts AS (SELECT image_id, v, count(*) AS n FROM px GROUP BY ALL),
    dense AS MATERIALIZED (SELECT image_id, b.v, coalesce(n, 0) AS n FROM (SELECT DISTINCT image_id FROM counts) CROSS JOIN (SELECT CAST(unnest(range(256)) AS INT) AS v) b LEFT JOIN counts USING (image_id, v)),
    tops AS (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY n DESC, v) AS k FROM dense),
    peaks AS (SELECT *, CASE WHEN k = 1 AND n > 2 * second AND second > 0 THEN CAST(floor(second * 1.5) AS BIGINT) ELSE n END AS tamed FROM (SELECT *, max(CASE WHEN k = 2 THEN n END) OVER (PARTITION BY image_id) AS second FROM tops)),
    cum AS MATERIALIZED (SELECT image_id, v, n, CAST(sum(n) OVER u AS DOUBLE) AS low, CAST(sum(n) OVER a - sum(n) OVER u AS DOUBLE) AS high, CAST(sum(n * v) OVER u AS DOUBLE) AS s1, CAST(sum(n * v) OVER a - sum(n * v) OVER u AS DOUBLE) AS s2,
      CAST(sum(n * n) OVER u AS DOUBLE) AS q1, CAST(sum(n * n) OVER a - sum(n * n) OVER u AS DOUBLE) AS q2, sum(sqrt(n)) OVER u AS r1, sum(sqrt(n)) OVER a - sum(sqrt(n)) OVER u AS r2, sum(CASE WHEN n > 0 THEN n * ln(n) ELSE 0 END) OVER u AS e1, sum(CASE WHEN n > 0 THEN n * ln(n) ELSE 0 END) OVER a - sum(CASE WHEN n > 0 THEN n * ln(n) ELSE 0 END) OVER u AS e2,
      min(CASE WHEN n > 0 THEN v END) OVER a AS first, max(CASE WHEN n > 0 THEN v END) OVER a AS final, count(*) FILTER (WHERE n > 0) OVER a AS used FROM dense WINDOW u AS (PARTITION BY image_id ORDER BY v ROWS UNBOUNDED PRECEDING), a AS (PARTITION BY image_id)),
    pairs AS (SELECT t.image_id, t.v AS t, t.low, t.high, t.first, t.final, k.v, k.n, k.low AS upto, k.high AS beyond, 1 / (1 + abs(k.v - CASE WHEN k.v <= t.v THEN CASE WHEN t.low > 0 THEN t.s1 / t.low ELSE 0 END ELSE CASE WHEN t.high > 0 THEN t.s2 / t.high ELSE 0 END END) / nullif(t.final - t.first, 0)) AS m FROM cum t JOIN cum k ON k.image_id = t.image_id),
    scores AS (SELECT image_id, t, round(sum(n * ({_UNSURE})), 9) AS fuzzy, any_value(t >= first AND t < final) AS between_ends,
      round(abs(sum(CASE WHEN v <= t THEN n * ln(1 - 0.5::DOUBLE * (upto - n) / nullif(low, 0)) END) * 0.5::DOUBLE / any_value(nullif(low, 0)) - coalesce(sum(CASE WHEN v > t THEN n * ln(1 - 0.5::DOUBLE * beyond / nullif(high, 0)) END), 0) * 0.5::DOUBLE / any_value(nullif(high, 0))), 9) AS told FROM pairs GROUP BY image_id, t),
    orders_ AS ({" UNION ALL ".join(f"SELECT image_id, coalesce(arg_max(v, (s, -v)) FILTER (WHERE s > 0), 0) AS t FROM (SELECT image_id, v, CASE WHEN v >= first AND v < final THEN round({f}, 9) END AS s FROM cum) GROUP BY image_id" for f in _ORDERS)}),
    three AS (SELECT image_id, list_sort(list(t)) AS ts FROM orders_ GROUP BY image_id),
    renyi AS (SELECT image_id, ts[1] AS t1, ts[2] AS t2, ts[3] AS t3, a.low / (a.low + a.high) AS p1, c.low / (c.low + c.high) AS p3, CASE WHEN (ts[2] - ts[1] <= 5) = (ts[3] - ts[2] <= 5) THEN [1, 2, 1] WHEN ts[2] - ts[1] <= 5 THEN [0, 1, 3] ELSE [3, 1, 0] END AS b FROM three JOIN cum a USING (image_id) JOIN cum c USING (image_id) WHERE a.v = ts[1] AND c.v = ts[3]),
    found AS ({_settled("isodata_plain", "n")} UNION ALL {_settled("default", "tamed")}
      UNION ALL SELECT image_id, 'huang', arg_min(t, (fuzzy, t)) FROM scores GROUP BY image_id
      UNION ALL SELECT image_id, 'shanbhag', arg_min(t, (told, t)) FILTER (WHERE between_ends) FROM scores GROUP BY image_id
      UNION ALL SELECT image_id, 'renyi', CAST(floor(round(t1 * (p1 + (p3 - p1) * b[1] / 4) + t2 * (p3 - p1) * b[2] / 4 + t3 * (1 - p3 + (p3 - p1) * b[3] / 4), 9)) AS INT) FROM renyi)
    SELECT image_id, method, CAST(CASE used WHEN 1 THEN first WHEN 2 THEN final - 1 ELSE level END AS INT) AS level FROM found JOIN (SELECT DISTINCT image_id, used, first, final FROM cum) USING (image_id)"""


def _swept(source: str, line: str, along: str, step: int) -> str:
    """``d`` lowered along lines."""
    return f"SELECT * REPLACE (least(min(d - {step} * {along}) OVER (PARTITION BY image_id, z, {line} ORDER BY {along}) + {step} * {along}, min(d + {step} * {along}) OVER (PARTITION BY image_id, z, {line} ORDER BY {along} DESC) - {step} * {along}) AS d) FROM {source}"


def _weights(name: str, sigma: float) -> str:
    reach = int(sigma * math.sqrt(-2 * math.log(2e-4)))
    side = [math.exp(-(d * d) / (2 * sigma * sigma)) for d in range(-reach, reach + 1)]
    return f"{name}(d, w) AS (VALUES " + ", ".join(f"({d}, {w / sum(side)!r}::DOUBLE)" for d, w in zip(range(-reach, reach + 1), side, strict=True)) + ")"


def _polygon(name: str, corners: str) -> str:
    """CTEs that end in ``name`` (keys, x, y, n): how many sides of the polygons lie to the right of each pixel's centre; ``corners`` has roi_id, image_id, part, i, x, y."""
    return f"""corners AS MATERIALIZED ({corners}), sides AS (SELECT a.image_id, a.roi_id, a.part, a.x AS ax, a.y AS ay, b.x AS bx, b.y AS b_y FROM corners a JOIN corners b ON b.image_id = a.image_id AND b.roi_id = a.roi_id AND b.part = a.part AND b.i = (a.i + 1) % 4),
      {name} AS (SELECT px.image_id, roi_id, part, px.x, px.y, v, count(*) AS n FROM px JOIN sides s ON s.image_id = px.image_id AND (ay > px.y + 0.5) <> (b_y > px.y + 0.5) AND ax + (bx - ax) * (px.y + 0.5 - ay) / (b_y - ay) > px.x + 0.5 GROUP BY ALL)"""


_RINGS = "SELECT image_id, roi_id, part, i, CASE part WHEN 0 THEN roi_id * 6 + 0.25::DOUBLE + CASE WHEN i IN (1, 2) THEN 14 ELSE 0 END ELSE roi_id * 6 + 4.25::DOUBLE + CASE WHEN i IN (1, 2) THEN 6 ELSE 0 END END AS x, CASE part WHEN 0 THEN roi_id + 0.25::DOUBLE + CASE WHEN i > 1 THEN 14 ELSE 0 END ELSE roi_id + 5.25::DOUBLE + CASE WHEN i > 1 THEN 6 ELSE 0 END END AS y FROM (SELECT DISTINCT image_id FROM cells), (SELECT CAST(unnest(range(8)) AS INT) AS roi_id), (SELECT CAST(unnest([0, 1]) AS INT) AS part), (SELECT CAST(unnest(range(4)) AS INT) AS i)"
_C30, _S30 = f"{math.cos(math.radians(30))!r}::DOUBLE", f"{math.sin(math.radians(30))!r}::DOUBLE"
_MOVED = f"""SELECT image_id, roi_id, part, i, (x - (min(x) OVER r + max(x) OVER r) / 2) * {_C30} - (y - (min(y) OVER r + max(y) OVER r) / 2) * {_S30} + (min(x) OVER r + max(x) OVER r) / 2 + image_id % 5 + 0.125::DOUBLE AS x, (x - (min(x) OVER r + max(x) OVER r) / 2) * {_S30} + (y - (min(y) OVER r + max(y) OVER r) / 2) * {_C30} + (min(y) OVER r + max(y) OVER r) / 2 + 2 AS y
      FROM (SELECT image_id, roi_id, part, i, (x - (min(x) OVER r + max(x) OVER r) / 2) * 1.5::DOUBLE + (min(x) OVER r + max(x) OVER r) / 2 AS x, (y - (min(y) OVER r + max(y) OVER r) / 2) * 0.75::DOUBLE + (min(y) OVER r + max(y) OVER r) / 2 AS y FROM ({_RINGS}) WINDOW r AS (PARTITION BY image_id, roi_id, part)) WINDOW r AS (PARTITION BY image_id, roi_id, part)"""

SQL |= {
    "scaled_bicubic": _px(_mapped(96, 40, "(d - 48.375::DOUBLE) / 1.5::DOUBLE + 32", "(e - 20.3125::DOUBLE) / 1.25::DOUBLE + 16", 0)),
    "rotated_bicubic": _px(_mapped(64, 32, *_turned(30), 7)),
    "rotated_nearest": _px(f""", spots AS MATERIALIZED (SELECT d, e, {_turned(-40)[0]} AS xs, {_turned(-40)[1]} AS ys FROM (SELECT CAST(unnest(range(64)) AS INT) AS d), (SELECT CAST(unnest(range(32)) AS INT) AS e)),
      taken AS (SELECT d, e, CASE WHEN xs >= -0.01 AND xs < 64 AND ys >= -0.01 AND ys < 32 THEN CAST(least(63, floor(xs + 0.5)) AS INT) END AS tx, CAST(least(31, floor(ys + 0.5)) AS INT) AS ty FROM spots)
      SELECT g.image_id, g.x, g.y, coalesce(px.v, 3) AS v FROM px g JOIN taken ON taken.d = g.x AND taken.e = g.y LEFT JOIN px ON px.image_id = g.image_id AND px.x = tx AND px.y = ty"""),
    "searched_thresholds": _px(_SEARCHED),
    "shapes_between": _st(f""", mask AS MATERIALIZED (SELECT image_id, z, x, y, z % 3 = 1 AND v > 0 AS lit FROM st),
      near AS (SELECT m.image_id, m.z, m.x, m.y, any_value(m.lit) AS lit, count(n.x) AS k FROM (SELECT * FROM mask, (SELECT CAST(unnest([-1, 0, 1]) AS INT) AS dx), (SELECT CAST(unnest([-1, 0, 1]) AS INT) AS dy)) m LEFT JOIN (SELECT * FROM mask WHERE lit) n ON n.image_id = m.image_id AND n.z = m.z AND n.x = m.x + dx AND n.y = m.y + dy GROUP BY m.image_id, m.z, m.x, m.y),
      seeds AS (SELECT image_id, z, x, y, lit, CASE WHEN lit AND k < 9 THEN 0 WHEN NOT lit AND k > 0 THEN 1 END AS d FROM near),
      h AS ({_swept("seeds", "y", "x", 3)}), w AS ({_swept("h", "x", "y", 3)}), g AS ({_swept("w", "x - y", "y", 4)}),
      s AS MATERIALIZED (SELECT image_id, z, x, y, CASE WHEN lit THEN d ELSE -d END AS d FROM g),
      q AS (SELECT *, last_value(CASE WHEN d IS NOT NULL THEN [z, d] END IGNORE NULLS) OVER (PARTITION BY image_id, x, y ORDER BY z ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS a, first_value(CASE WHEN d IS NOT NULL THEN [z, d] END IGNORE NULLS) OVER (PARTITION BY image_id, x, y ORDER BY z ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS b FROM s)
      SELECT image_id, z, x, y, CASE WHEN d >= 0 OR (d IS NULL AND a[2] * (b[1] - z) + b[2] * (z - a[1]) >= 0) THEN 255 ELSE 0 END AS v FROM q"""),
    "gaussian_3d": _st(f""", {_weights("wx", 1.5)}, {_weights("wy", 1.0)}, {_weights("wz", 0.7)},
      across AS MATERIALIZED (SELECT image_id, z, p.d AS x, y, sum(v * w) AS v FROM st JOIN (SELECT CAST(g.x AS INT) AS d, greatest(0, least(63, g.x + d)) AS x, w FROM range(64) g(x), wx) p USING (x) GROUP BY ALL),
      tall AS MATERIALIZED (SELECT image_id, z, x, p.d AS y, sum(v * w) AS v FROM across JOIN (SELECT CAST(g.y AS INT) AS d, greatest(0, least(31, g.y + d)) AS y, w FROM range(32) g(y), wy) p USING (y) GROUP BY ALL),
      ranked AS (SELECT DISTINCT image_id, z, CAST(dense_rank() OVER (PARTITION BY image_id ORDER BY z) AS INT) AS k FROM (SELECT DISTINCT image_id, z FROM st)),
      deep AS (SELECT a.image_id, a.z, b.z AS other, w FROM ranked a JOIN wz ON true JOIN (SELECT *, max(k) OVER (PARTITION BY image_id) AS depth FROM ranked) b ON b.image_id = a.image_id AND b.k = greatest(1, least(b.depth, a.k + wz.d)))
      SELECT image_id, deep.z, x, y, round(sum(v * w), 6) AS v FROM deep JOIN (SELECT image_id, z AS other, x, y, v FROM tall) USING (image_id, other) GROUP BY ALL"""),
    "composite_regions": _px(f", {_polygon('parts', _RINGS)} SELECT image_id, roi_id, count(*) AS n, round(avg(v), 6) AS mean, max(v) AS most FROM (SELECT image_id, roi_id, x, y, any_value(v) AS v FROM parts GROUP BY ALL HAVING sum(n) % 2 = 1) GROUP BY ALL"),
    "moved_regions": _px(f", {_polygon('parts', _MOVED)} SELECT image_id, roi_id, part, count(*) AS n, round(avg(v), 6) AS mean, max(v) AS most FROM parts WHERE n % 2 = 1 GROUP BY ALL"),
    "slices_by_number": "WITH t AS (SELECT o_custkey, o_orderkey, CASE WHEN o_custkey % 3 + o_orderkey % 11 > 0 THEN CAST(regexp_extract(o_orderpriority, '[0-9]+') AS INT) END AS number FROM orders) SELECT *, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY CASE WHEN o_custkey IN (SELECT o_custkey FROM t WHERE number IS NULL) THEN NULL ELSE number END, o_orderkey) AS INT) AS z FROM t",
}

SQL = {k: s.replace("\n,", ",").replace("\n, ", ", ") for k, s in SQL.items()}
