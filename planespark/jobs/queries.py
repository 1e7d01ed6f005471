"""Registered queries over the derived images. Each covers one or a few operators on a whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from planespark.functions import pixel as P
from planespark.functions import points
from planespark.operators import combine, contours, fits, fourier, geometry, hulls, metadata, noise, peaks, resample, shapes, stacks, stencils, thinning, thresholds, volumes
from planespark.operators import particles as objects_of
from planespark.operators import statistics as S
from planespark.sources import derived as D
from planespark.sources import folders, raw, scratch, tables, text
from planespark.streaming import live

W, H = D.WIDTH, D.HEIGHT
IMAGE = ["image_id"]


def pixel_arithmetic(spark: SparkSession, sf: str) -> DataFrame:
    return D.pixels(spark, sf).select("image_id", "x", "y", P.add(F.col("v"), 40).alias("added"), P.subtract(F.col("v"), 20).alias("subtracted"), P.multiply(F.col("v"), 1.5).alias("multiplied"), P.divide(F.col("v"), 3).alias("divided"), P.bit_and(F.col("v"), 12).alias("anded"), P.bit_or(F.col("v"), 3).alias("ored"), P.bit_xor(F.col("v"), 255).alias("xored"), P.raise_to(F.col("v"), 5).cast("int").alias("raised"), P.lower_to(F.col("v"), 30).cast("int").alias("lowered"))


def pixel_functions(spark: SparkSession, sf: str) -> DataFrame:
    return D.pixels(spark, sf).select("image_id", "x", "y", P.gamma(F.col("v"), 0.5).alias("gamma"), P.log(F.col("v")).alias("log"), P.square(F.col("v")).alias("square"), F.round(P.root(F.col("v"), 32), 6).alias("root"), F.round(P.reciprocal(F.col("v") + 1), 6).alias("reciprocal"), P.invert(F.col("v")).alias("inverted"), P.threshold(F.col("v"), 20).alias("binary"), P.mask(F.col("v"), 10, 40).alias("mask"), F.round(P.optical_density(F.col("v")), 6).alias("density"), F.round(P.polynomial(F.col("v").cast("double"), [1.0, 0.5, 0.01]), 6).alias("polynomial"), P.calibrated(F.col("x"), 2.0, 0.5).alias("cal_x"))


def pixel_expression(spark: SparkSession, sf: str) -> DataFrame:
    d, _ = P.polar(F.col("x"), F.col("y"), W, H)
    return D.pixels(spark, sf).withColumn("d", d).select("image_id", "x", "y", F.round(F.expr("v * 2 + d - x / (y + 1)"), 6).alias("v"))


def type_conversion(spark: SparkSession, sf: str) -> DataFrame:
    px = D.pixels(spark, sf)
    ends = px.groupBy("image_id").agg(F.min("v").alias("lo"), F.max("v").alias("hi"))
    return px.join(ends, "image_id").select("image_id", "x", "y", P.to_8bit(F.col("v"), F.col("lo"), F.col("hi")).alias("v"))


def rgb_gray_hsb(spark: SparkSession, sf: str) -> DataFrame:
    r, g, b = F.col("r"), F.col("g"), F.col("b")
    h, s, br = P.hsb(r, g, b)
    return D.rgb(spark, sf).select("image_id", "x", "y", P.gray(r, g, b, (0.25, 0.5, 0.25)).alias("gray"), F.round(h, 6).alias("hue"), F.round(s, 6).alias("saturation"), F.round(br, 6).alias("brightness"))


def rgb_xyz(spark: SparkSession, sf: str) -> DataFrame:
    x, y, z = P.xyz(F.col("r"), F.col("g"), F.col("b"))
    return D.rgb(spark, sf).select("image_id", "x", "y", F.round(x, 4).alias("cx"), F.round(y, 4).alias("cy"), F.round(z, 4).alias("cz"))


def split_channels(spark: SparkSession, sf: str) -> DataFrame:
    return D.rgb(spark, sf).select("image_id", "x", "y", F.explode(F.array(*(F.struct(F.lit(k).alias("c"), F.col(n).alias("v")) for k, n in enumerate("rgb", 1)))).alias("p")).select("image_id", "p.c", "x", "y", "p.v")


def colour_threshold(spark: SparkSession, sf: str) -> DataFrame:
    rgb = D.rgb(spark, sf)
    on = F.col("r").between(1, 60) & ~F.col("g").between(30, 255) & F.col("b").between(0, 200)
    return rgb.select("image_id", "x", "y", F.when(on, 255).otherwise(0).alias("v"))


def crop_flip_rotate(spark: SparkSession, sf: str) -> DataFrame:
    px = geometry.crop(D.pixels(spark, sf), 8, 4, 32, 16)
    return geometry.rotate_left(geometry.flip(px, "y", 16), 32)


def rotate_right(spark: SparkSession, sf: str) -> DataFrame:
    return geometry.rotate_right(geometry.flip(D.pixels(spark, sf), "x", W), H)


def translate(spark: SparkSession, sf: str) -> DataFrame:
    return geometry.translate(D.pixels(spark, sf), IMAGE, W, H, 5, -3, 7)


def canvas(spark: SparkSession, sf: str) -> DataFrame:
    return geometry.canvas(D.pixels(spark, sf), IMAGE, 72, 30, 4, -1, 9)


def bin_blocks(spark: SparkSession, sf: str) -> DataFrame:
    return geometry.binned(D.pixels(spark, sf), IMAGE, W, H, 5, 3)


def reslice(spark: SparkSession, sf: str) -> DataFrame:
    return geometry.reslice(D.stack(spark, sf))


def montage(spark: SparkSession, sf: str) -> DataFrame:
    return geometry.montage(D.stack(spark, sf), W, H, 3)


def tile_histogram(spark: SparkSession, sf: str) -> DataFrame:
    return geometry.tiles(D.pixels(spark, sf), 16, 2, W, H).groupBy("image_id", "tx", "ty").agg(F.count("*").alias("n"), F.sum("v").alias("total"))


def image_calculator(spark: SparkSession, sf: str) -> DataFrame:
    px = D.pixels(spark, sf)
    other = px.withColumn("image_id", F.col("image_id") + 1)
    return combine.calculate(px, other, ["image_id", "x", "y"], ["add", "subtract", "multiply", "divide", "and", "or", "xor", "min", "max", "average", "difference", "copy_nonzero"])


def paste(spark: SparkSession, sf: str) -> DataFrame:
    px = D.pixels(spark, sf)
    patch = geometry.crop(px.withColumn("image_id", F.col("image_id") + 1), 0, 0, 16, 16)
    return combine.paste(px, patch, ["image_id", "x", "y"], 20, 10, "max")


def _rois(px: DataFrame) -> DataFrame:
    """8 x 8 rectangles and the ovals inscribed in them, on each plane."""
    grid = px.select("image_id").distinct().select("image_id", F.explode(F.sequence(F.lit(0), F.lit(W * H // 64 - 1))).alias("roi_id"))
    place = grid.select("image_id", "roi_id", F.when(F.col("roi_id") % 2 == 0, "rectangle").otherwise("oval").alias("kind"), (F.col("roi_id") % (W // 8) * 8).alias("x0"), ((F.col("roi_id") / (W // 8)).cast("int") * 8).alias("y0"))
    return place.withColumns({"w": F.lit(8), "h": F.lit(8)})


def measure_regions(spark: SparkSession, sf: str) -> DataFrame:
    px = D.pixels(spark, sf)
    return combine.inside(px, _rois(px)).groupBy("image_id", "roi_id", "kind").agg(F.count("*").alias("n"), F.avg("v").alias("mean"), F.max("v").alias("most"))


def outside_regions(spark: SparkSession, sf: str) -> DataFrame:
    px = D.pixels(spark, sf)
    return combine.outside(px, _rois(px), ["image_id", "x", "y"])


def compare_images(spark: SparkSession, sf: str) -> DataFrame:
    px = D.pixels(spark, sf)
    out = combine.compare(px, px.withColumn("image_id", F.col("image_id") + 1), ["image_id", "x", "y"], IMAGE)
    return out.select("image_id", *(F.round(c, 6).alias(c) for c in ("mse", "rmse", "mae", "most", "psnr")))


def histogram(spark: SparkSession, sf: str) -> DataFrame:
    return S.histogram(D.pixels(spark, sf), IMAGE)


def histogram_binned(spark: SparkSession, sf: str) -> DataFrame:
    return S.binned(D.pixels(spark, sf).withColumn("v", F.col("v").cast("double")), IMAGE, 16)


def statistics(spark: SparkSession, sf: str) -> DataFrame:
    out = D.pixels(spark, sf).groupBy("image_id").agg(*S.basic())
    return out.select("image_id", "n", "least", "most", *(F.round(c, 6).alias(c) for c in ("mean", "sd", "skewness", "kurtosis")))


def moments(spark: SparkSession, sf: str) -> DataFrame:
    out = D.pixels(spark, sf).groupBy("image_id").agg(*S.moments())
    return out.select("image_id", "raw_density", *(F.round(c, 6).alias(c) for c in ("cx", "cy", "mx", "my", "percent_area")))


def thresholded_statistics(spark: SparkSession, sf: str) -> DataFrame:
    return D.pixels(spark, sf).where(F.col("v").between(20, 60)).groupBy("image_id").agg(F.count("*").alias("n"), F.round(F.avg("v"), 6).alias("mean"))


def mode_median(spark: SparkSession, sf: str) -> DataFrame:
    h = S.histogram(D.pixels(spark, sf), IMAGE)
    return S.mode(h, IMAGE).join(S.median(h, IMAGE), "image_id")


def stack_statistics(spark: SparkSession, sf: str) -> DataFrame:
    return D.stack(spark, sf).groupBy("image_id").agg(F.count("*").alias("voxels"), F.round(F.avg("v"), 6).alias("mean"), F.max("v").alias("most"), F.round(100.0 * F.sum(F.when(F.col("v") > 0, 1).otherwise(0)) / F.count("*"), 6).alias("percent_volume"))


def z_projection(spark: SparkSession, sf: str) -> DataFrame:
    out = S.projection(D.floats(spark, sf), IMAGE)
    return out.select("image_id", "x", "y", *(F.round(c, 6).alias(c) for c in ("average", "most", "least", "total", "sd", "median")))


def grouped_projection(spark: SparkSession, sf: str) -> DataFrame:
    return S.grouped_projection(D.stack_lines(spark, sf), IMAGE, 2)


def z_profile(spark: SparkSession, sf: str) -> DataFrame:
    return S.profile(D.stack(spark, sf), IMAGE, "z")


def axis_profiles(spark: SparkSession, sf: str) -> DataFrame:
    return S.profile(D.pixels(spark, sf), IMAGE, "x")


def table_summary(spark: SparkSession, sf: str) -> DataFrame:
    out = S.summary(D.table(spark, sf, "orders"), ["o_totalprice", "o_custkey"])
    return out.select("label", F.round("o_totalprice", 2).alias("o_totalprice"), F.round("o_custkey", 4).alias("o_custkey"))


def table_distribution(spark: SparkSession, sf: str) -> DataFrame:
    return S.distribution(D.table(spark, sf, "orders"), "o_totalprice")


def fractal_boxes(spark: SparkSession, sf: str) -> DataFrame:
    return S.fractal(D.pixels(spark, sf), IMAGE).select("image_id", F.round("dimension", 6).alias("dimension"), "most_boxes")


def otsu_threshold(spark: SparkSession, sf: str) -> DataFrame:
    px = D.pixels(spark, sf)
    level = S.otsu(S.histogram(px, IMAGE), IMAGE)
    return px.join(level, "image_id").groupBy("image_id", "level").agg(F.sum(F.when(F.col("v") > F.col("level"), 1).otherwise(0)).alias("foreground"))


def contrast_stretch(spark: SparkSession, sf: str) -> DataFrame:
    return S.stretch(D.pixels(spark, sf), IMAGE, 2.0)


def equalised(spark: SparkSession, sf: str) -> DataFrame:
    return S.equalise(D.pixels(spark, sf), IMAGE)


def substack(spark: SparkSession, sf: str) -> DataFrame:
    return stacks.substack(D.stack(spark, sf), IMAGE, "2-7-2", 7)


def delete_slices(spark: SparkSession, sf: str) -> DataFrame:
    return stacks.substack(D.stack(spark, sf), IMAGE, "1,4", 7, delete=True)


def reduced_stack(spark: SparkSession, sf: str) -> DataFrame:
    return stacks.reduce(D.stack(spark, sf), 3)


def concatenated(spark: SparkSession, sf: str) -> DataFrame:
    px = D.stack(spark, sf)
    return stacks.concatenate(px, geometry.flip(px, "z", 7), 7)


def hyperstack_order(spark: SparkSession, sf: str) -> DataFrame:
    rows = D.table(spark, sf, "events").select("event_id", (F.col("event_id") % 24 + 1).alias("index"))
    rows = rows.withColumns(stacks.to_hyperstack(F.col("index"), "czt", 2, 3, 4))
    return rows.withColumn("back", stacks.to_index("tzc", 2, 3, 4)).select("event_id", "c", "z", "t", F.col("back").cast("long").alias("back"))


def natural_names(spark: SparkSession, sf: str) -> DataFrame:
    return D.table(spark, sf, "customer").select("c_custkey", stacks.natural_key("c_name").alias("sort_key"))


def plane_hashes(spark: SparkSession, sf: str) -> DataFrame:
    p = D.to_planes(D.pixels(spark, sf))
    return p.select("image_id", F.md5(F.array_join(F.transform("pixels", lambda x: x.cast("int").cast("string")), ",")).alias("md5"))


def table_sorted(spark: SparkSession, sf: str) -> DataFrame:
    return stacks.table_sort(D.table(spark, sf, "orders").select("o_orderkey", "o_orderpriority"), "o_orderpriority")


def line_fits(spark: SparkSession, sf: str) -> DataFrame:
    out = stacks.line_fit(D.table(spark, sf, "lineitem"), ["l_suppkey"], "l_quantity", "l_extendedprice")
    return out.select("l_suppkey", F.round("a", 3).alias("a"), F.round("b", 4).alias("b"), F.round("r2", 6).alias("r2"))


def event_frames(spark: SparkSession, sf: str) -> DataFrame:
    rows = D.table(spark, sf, "events").groupBy(F.hour("ts").alias("t"), (F.col("user_id") % 16).cast("int").alias("x"), (F.col("event_id") % 16).cast("int").alias("y")).agg(F.sum("value").alias("v"))
    return rows.select("t", "x", "y", F.round("v", 4).alias("v"))


def text_image(spark: SparkSession, sf: str) -> DataFrame:
    return text.to_lines(D.pixels(spark, sf), IMAGE)


def text_image_read(spark: SparkSession, sf: str) -> DataFrame:
    return text.from_lines(text.to_lines(D.pixels(spark, sf), IMAGE), IMAGE)


def xy_coordinates(spark: SparkSession, sf: str) -> DataFrame:
    return text.coordinates(D.pixels(spark, sf), H)


def image_to_table(spark: SparkSession, sf: str) -> DataFrame:
    return text.to_table(D.pixels(spark, sf), IMAGE, W)


def measure_stack(spark: SparkSession, sf: str) -> DataFrame:
    out = D.stack(spark, sf).groupBy("image_id", "z").agg(*S.basic())
    return out.select("image_id", "z", "n", "least", "most", F.round("mean", 6).alias("mean"), F.round("sd", 6).alias("sd"))


def lane_profiles(spark: SparkSession, sf: str) -> DataFrame:
    return S.lanes(D.pixels(spark, sf), IMAGE, 16).select("image_id", "lane", "y", F.round("mean", 6).alias("mean"), F.round("percent", 6).alias("percent"))


def lookup_table(spark: SparkSession, sf: str) -> DataFrame:
    return D.pixels(spark, sf).select("image_id", "x", "y", P.looked_up(F.col("v"), [(k * 7 + 3) % 256 for k in range(256)]).alias("v"))


def window_level(spark: SparkSession, sf: str) -> DataFrame:
    return D.pixels(spark, sf).select("image_id", "x", "y", P.windowed(F.col("v"), 10, 90).alias("v"))


def merge_channels(spark: SparkSession, sf: str) -> DataFrame:
    return combine.merged(split_channels(spark, sf), ["image_id", "x", "y"], {1: "b", 2: "g", 3: "r"})


def region_algebra(spark: SparkSession, sf: str) -> DataFrame:
    px = D.pixels(spark, sf)
    first, second = px.where("x < 40 and y < 20 and v > 0"), px.where("x >= 24 and y >= 8 and v > 0")
    return combine.algebra(first, second, ["image_id", "x", "y"]).groupBy("image_id").agg(*(F.sum(F.col(c).cast("long")).alias(c) for c in ("both", "either", "one")))


def filter_3d(spark: SparkSession, sf: str) -> DataFrame:
    out = volumes.filter3d(D.stack_lines(spark, sf), IMAGE, (1, 1, 1))
    return out.select("image_id", "x", "y", "z", F.round("mean", 6).alias("mean"), "least", "most", F.round("variance", 6).alias("variance"))


def depth_rescaled(spark: SparkSession, sf: str) -> DataFrame:
    return volumes.rescale_z(D.stack(spark, sf), IMAGE, 7, 4)


def line_profile(spark: SparkSession, sf: str) -> DataFrame:
    return volumes.sampled(D.pixels(spark, sf), IMAGE, [(4 * k + 0.5, 2 * k + 0.25) for k in range(15)])


def side_by_side(spark: SparkSession, sf: str) -> DataFrame:
    px = D.pixels(spark, sf)
    return volumes.beside(px, px.withColumn("image_id", F.col("image_id") + 1), W)


def curve_fits(spark: SparkSession, sf: str) -> DataFrame:
    out = volumes.fits(D.table(spark, sf, "lineitem"), ["l_suppkey"], "l_quantity", "l_extendedprice")
    return out.select("l_suppkey", F.round("exp_b", 6).alias("exp_b"), F.round(F.log("exp_a"), 6).alias("exp_log_a"), F.round("power_b", 6).alias("power_b"), F.round(F.log("power_a"), 6).alias("power_log_a"), *(F.round(f"p{k}", 2).alias(f"p{k}") for k in range(3)))


def polynomial_fits(spark: SparkSession, sf: str) -> DataFrame:
    """Cubics of all suppliers side by side, with their values at three places."""
    out = fits.polynomials(D.table(spark, sf, "lineitem"), ["l_suppkey"], "l_quantity", "l_extendedprice", 3)
    at = lambda x: F.round(F.aggregate(F.reverse("p"), F.lit(0.0), lambda s, c: s * x + c), 2)
    return out.select("l_suppkey", "n", at(5).alias("at_5"), at(25).alias("at_25"), at(45).alias("at_45"), F.round("r2", 6).alias("r2"))


def iterated_fits(spark: SparkSession, sf: str) -> DataFrame:
    """A power curve through the prices of each supplier, by least squares of the prices themselves."""
    out = fits.iterated(D.table(spark, sf, "lineitem"), ["l_suppkey"], "l_quantity", "l_extendedprice", "power")
    return out.select("l_suppkey", "n", *(F.get("p", F.lit(k)).alias(f"p{k}") for k in range(2)), "sse", "converged")


def table_edits(spark: SparkSession, sf: str) -> DataFrame:
    rows = D.table(spark, sf, "orders").where("not o_orderkey between 10 and 40")
    rows = rows.withColumn("Ratio", F.expr("o_totalprice / (o_custkey + 1)")).withColumnRenamed("o_orderstatus", "State")
    return rows.select("o_orderkey", "State", "Ratio", F.printf(F.lit("%.2f"), F.col("o_totalprice").cast("double")).alias("shown"))


def raw_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    files = raw.encode(D.to_planes(D.pixels(spark, sf)), "16u")
    px = D.to_pixels(raw.decode(files, "16u", W, H))
    return px.select("image_id", F.col("x").cast("int").alias("x"), "y", F.col("v").cast("int").alias("v"))


def stream_frame_profile(spark: SparkSession, sf: str) -> DataFrame:
    rows = live.arriving(spark, f"{sf}/events*.parquet")
    out = live.latest(live.running_profile(rows, "ts", ["event_type"], F.col("value"), "6 hours"), "frame-profile", ["start", "event_type"])
    return out.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("mean", 6).alias("mean"), "least", "most")


def stream_closed_windows(spark: SparkSession, sf: str) -> DataFrame:
    """Windows that are over: two hours behind the newest event at least, appended once."""
    rows = live.arriving(spark, f"{sf}/events*.parquet")
    out = live.append(live.frame_profile(rows, "ts", ["event_type"], F.col("value"), "6 hours", "2 hours", "3 hours"), "closed")
    return out.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("mean", 6).alias("mean"), "least", "most")


def stream_projection(spark: SparkSession, sf: str) -> DataFrame:
    rows = live.arriving(spark, f"{sf}/events*.parquet").select((F.col("user_id") % 16).cast("int").alias("x"), (F.col("event_id") % 16).cast("int").alias("y"), "value")
    out = live.latest(live.running_projection(rows, ["x", "y"], F.col("value")), "projection", ["x", "y"])
    return out.select("x", "y", "n", "most", "least", F.round("total", 4).alias("total"), F.round("average", 6).alias("average"))


def stream_histogram(spark: SparkSession, sf: str) -> DataFrame:
    rows = live.arriving(spark, f"{sf}/events*.parquet")
    return live.latest(live.running_histogram(rows, ["event_type"], F.floor(F.col("value") / 10)), "histogram", ["event_type", "bin"])


def auto_thresholds(spark: SparkSession, sf: str) -> DataFrame:
    return thresholds.levels(D.pixels(spark, sf), IMAGE)


def iterated_thresholds(spark: SparkSession, sf: str) -> DataFrame:
    return thresholds.iterated_levels(D.pixels(spark, sf), IMAGE)


def threshold_applied(spark: SparkSession, sf: str) -> DataFrame:
    """Every slice by its own level."""
    return thresholds.applied(D.stack(spark, sf), ["image_id", "z"], "otsu")


def stack_threshold_applied(spark: SparkSession, sf: str) -> DataFrame:
    """Every slice by the level of its stack."""
    return thresholds.applied(D.stack(spark, sf), ["image_id", "z"], "isodata", whole_stack=True)


def _over(function, source=D.pixels):
    """A query that applies an operator over long-form pixels, or over image rows, to every plane."""

    def run(spark: SparkSession, sf: str) -> DataFrame:
        return function(source(spark, sf)).select("image_id", F.col("x").cast("int").alias("x"), F.col("y").cast("int").alias("y"), F.round("v", 6).alias("v"))

    return run


smooth = _over(lambda px: stencils.smooth(px, IMAGE))
sobel = _over(lambda px: stencils.sobel(px, IMAGE))
rank_mean = _over(lambda px: stencils.rank(px, IMAGE, 1.0, "mean"))
rank_max = _over(lambda px: stencils.rank(px, IMAGE, 1.0, "max"))
rank_min = _over(lambda px: stencils.rank(px, IMAGE, 2.0, "min"))
rank_variance = _over(lambda px: stencils.rank(px, IMAGE, 1.5, "variance"))
rank_median = _over(lambda px: stencils.rank(px, IMAGE, 2.0, "median"))
outliers_removed = _over(lambda px: stencils.outliers(px, IMAGE, 1.0, 15))
convolve = _over(lambda px: stencils.convolve(px, IMAGE, [[1, 2, 1], [2, 4, 2], [1, 2, 1]]))
despeckle = _over(lambda px: stencils.rank(px, IMAGE, 1.0, "median"))
gaussian = _over(lambda px: stencils.gaussian(px, IMAGE, 2.0))
unsharp_mask = _over(lambda px: stencils.unsharp(px, IMAGE, 1.0, 0.6))
top_hat = _over(lambda px: stencils.top_hat(px, IMAGE, 2.0))
grey_closed = _over(lambda px: stencils.closed(px, IMAGE, 1.0))
erode = _over(lambda px: stencils.eroded(px, IMAGE, F.col("v") > 0))
dilate = _over(lambda px: stencils.dilated(px, IMAGE, F.col("v") > 20, 3))
outline = _over(lambda px: stencils.outline(px, IMAGE, F.col("v") > 0))
shadows = _over(lambda px: stencils.shadows(px, IMAGE, 0))
ball_subtracted = _over(lambda px: stencils.ball_background(px, IMAGE, 6).withColumn("v", F.col("v") - F.col("ball")))
distance_map = _over(lambda px: stencils.distance(px, IMAGE, F.col("v") > 0))
holes_filled = _over(lambda px: objects_of.holes_filled(px, IMAGE, F.col("v") > 0, W, H))


def particles(spark: SparkSession, sf: str) -> DataFrame:
    out = objects_of.particles(D.pixels(spark, sf), IMAGE, 40, 255, W, H, eight=False)
    return out.select("image_id", "label", "area", "x0", "y0", "w", "h", "least", "most", "edge", *(F.round(c, 6).alias(c) for c in ("cx", "cy", "mean", "major", "minor", "angle")))


def particle_summary(spark: SparkSession, sf: str) -> DataFrame:
    found = particles(spark, sf).where("area >= 2 and not edge")
    return found.groupBy("image_id").agg(F.count("*").alias("n"), F.sum("area").alias("area"), F.round(F.avg("area"), 6).alias("mean_area"), F.round(100.0 * F.sum("area") / (W * H), 6).alias("percent"))


def outlines(spark: SparkSession, sf: str) -> DataFrame:
    """Every closed contour of every plane, corner by corner."""
    out = contours.traced(D.pixels(spark, sf), IMAGE, F.col("v") >= 40, W)
    return out.select("image_id", "x0", "y0", "outer", "sides", "corners", "area", F.round("perimeter", 6).alias("perimeter"), "points")


def round_particles(spark: SparkSession, sf: str) -> DataFrame:
    out = objects_of.outlined(D.pixels(spark, sf), IMAGE, 1, 255, W, H, size=(4, 400), circularity=(0.2, 1.0))
    return out.select("image_id", "label", "area", "x0", "y0", "w", "h", "edge", *(F.round(c, 6).alias(c) for c in ("perimeter", "circularity", "roundness")))


def wand_regions(spark: SparkSession, sf: str) -> DataFrame:
    """Seven seeds on each plane, and what each reaches within 15 of its own value."""
    k = F.col("seed")
    seeds = D.table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("image_id"), F.col("l_linenumber").cast("int").alias("seed")).distinct()
    seeds = seeds.select("image_id", "seed", ((k * 9 + F.col("image_id") * 5) % W).cast("int").alias("x"), ((k * 5 + F.col("image_id")) % H).cast("int").alias("y"))
    out = objects_of.wand(D.pixel_lines(spark, sf), seeds, IMAGE, "seed", W, H, 15, eight=True)
    return out.select("image_id", "seed", F.col("area").cast("long").alias("area"), "x0", "y0", "w", "h", F.round("mean", 6).alias("mean"), "least", "most")


def image_similarity(spark: SparkSession, sf: str) -> DataFrame:
    """Structural similarity of each plane and the one before."""
    px = D.pixels(spark, sf)
    return combine.ssim(px, px.withColumn("image_id", F.col("image_id") + 1), IMAGE).select("image_id", F.round("ssim", 6).alias("ssim"))


def noise_added(spark: SparkSession, sf: str) -> DataFrame:
    return noise.gaussian(D.pixels(spark, sf), IMAGE, 12.0, 7)


def salt_and_pepper(spark: SparkSession, sf: str) -> DataFrame:
    return noise.salt_and_pepper(D.pixels(spark, sf), IMAGE, 5.0, 7)


spectrum = _over(lambda px: fourier.power_spectrum(px, IMAGE, W, H))
skeleton = _over(lambda px: thinning.thinned(px, IMAGE, F.col("v") > 0))
watershed = _over(lambda px: peaks.watershed(px, IMAGE, F.col("v") > 0, W))
ultimate_points = _over(lambda px: peaks.ultimate_points(px, IMAGE, F.col("v") > 0, W, H))
band_passed = _over(lambda px: fourier.band_passed(px, IMAGE, W, H, 20, 3), D.pixel_lines)


def find_maxima(spark: SparkSession, sf: str) -> DataFrame:
    return peaks.maxima(D.pixels(spark, sf), IMAGE, W, H, 30)


def hull_shapes(spark: SparkSession, sf: str) -> DataFrame:
    return hulls.shapes(D.pixels(spark, sf), IMAGE, F.col("v").between(1, 255), W, H)


def correlated_planes(spark: SparkSession, sf: str) -> DataFrame:
    """Each plane and the one before."""
    px = D.pixel_lines(spark, sf)
    out = fourier.product(px, px.withColumn("image_id", F.col("image_id") + 1), IMAGE, W, H, "correlate")
    return out.select("image_id", "x", "y", F.round("v", 6).alias("v"))


def region_lengths(spark: SparkSession, sf: str) -> DataFrame:
    corner = lambda x, y: F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))
    key, customer = F.col("o_orderkey"), F.col("o_custkey")
    rows = D.table(spark, sf, "orders").select("o_orderkey", F.array(corner(customer % 64, key % 32), corner(key % 50, customer % 20), corner(F.lit(70), F.lit(40))).alias("p"))
    return rows.select("o_orderkey", F.round(points.length(F.col("p")), 6).alias("length"), points.shoelace(F.col("p")).alias("area"))


def results_table(spark: SparkSession, sf: str) -> DataFrame:
    """Written as text and read back: quoted cells, missing numbers, columns told apart."""
    rows = D.table(spark, sf, "orders")
    label = F.concat("o_orderstatus", F.lit(', "'), "o_orderpriority", F.lit('"'))
    path = scratch.folder(spark, "table")
    tables.write(rows.select("o_orderkey", label.alias("label"), F.when(F.col("o_custkey") % 3 > 0, F.col("o_totalprice").cast("double")).alias("price")), path)
    return tables.read(spark, path).select("o_orderkey", "label", "price", F.isnan("price").alias("missing")).withColumn("price", F.nanvl("price", F.lit(-1.0)))


def table_rows_deleted(spark: SparkSession, sf: str) -> DataFrame:
    return stacks.rows_deleted(D.table(spark, sf, "orders").select("o_orderkey"), ["o_orderkey"], 5, 20)


def _image_folder(spark: SparkSession, sf: str) -> str:
    path = scratch.folder(spark, "images")
    folders.write_images(D.pixels(spark, sf), "image_id", path)
    return path


def folder_measured(spark: SparkSession, sf: str) -> DataFrame:
    """A file a plane, read in natural order as one stack, measured by slice."""
    px = folders.read_images(spark, _image_folder(spark, sf), "(^plane[0-9]+$)")
    out = px.groupBy("name", "z").agg(*S.basic())
    return out.select("name", "z", "n", "least", "most", F.round("mean", 6).alias("mean"), F.round("sd", 6).alias("sd"))


def listed_stack(spark: SparkSession, sf: str) -> DataFrame:
    """A stack by a list of names, every fourth of an image that is not there."""
    path, listing = _image_folder(spark, sf), scratch.folder(spark, "list")
    names = D.table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("k")).distinct()
    name = F.when(F.col("k") % 4 == 1, F.format_string("gone%04d", "k")).otherwise(F.format_string("plane%04d", "k"))
    lines = names.agg(F.reverse(F.sort_array(F.collect_list(F.struct("k", name.alias("name"))))).alias("r"))  # one name a plane
    lines.select(F.concat(F.array_join(F.transform("r", lambda r: r["name"]), "\n"), F.lit("\n\nplane0000\n"))).coalesce(1).write.text(listing)
    out = folders.read_listed(spark, listing, path).groupBy("name", "z").agg(*S.basic())
    return out.select("name", "z", "n", "least", "most", F.round("mean", 6).alias("mean"))


def batch_converted(spark: SparkSession, sf: str) -> DataFrame:
    """A folder of images made smaller, image by image, into another folder, and measured there."""
    out = scratch.folder(spark, "converted")
    folders.convert(spark, _image_folder(spark, sf), out, lambda px: resample.averaged(px, ["name"], W, H, 24, 20))
    return folders.read_images(spark, out).groupBy("name").agg(*S.basic()).select("name", "n", "least", "most", F.round("mean", 6).alias("mean"))


def stream_folder_measured(spark: SparkSession, sf: str) -> DataFrame:
    """Each arriving image measured once."""
    images = folders.files(spark, _image_folder(spark, sf), stream=True)
    out = live.append(folders.measured(images), "folder")
    return out.select("name", "n", F.round("mean", 6).alias("mean"), "least", "most")


def scaled(spark: SparkSession, sf: str) -> DataFrame:
    return resample.scaled(D.pixels(spark, sf), IMAGE, W, H, 48, 40)


def averaged(spark: SparkSession, sf: str) -> DataFrame:
    return resample.averaged(D.pixels(spark, sf), IMAGE, W, H, 24, 20)


def rotated(spark: SparkSession, sf: str) -> DataFrame:
    return resample.rotated(D.pixels(spark, sf), IMAGE, W, H, 30, 7)


def polygon_regions(spark: SparkSession, sf: str) -> DataFrame:
    """Every polygon on every slice of every stack."""
    px = D.stack_lines(spark, sf)
    k = F.col("roi_id")
    corner = lambda x, y: F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))
    ids = D.table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("image_id")).distinct().select("image_id", F.explode(F.sequence(F.lit(0), F.lit(7))).alias("roi_id"))
    rois = ids.withColumn("points", F.array(corner(k * 6 + 0.25, k * 2 + 0.25), corner(k * 6 + 20.25, k + 3.25), corner(k * 6 + 6.25, k + 9.25), corner(k * 6 + 14.25, k * 3 + 0.75), corner(k * 6 + 2.25, k + 16.25)))
    return combine.inside_polygons(px, rois).groupBy("image_id", "z", "roi_id").agg(F.count("*").alias("n"), F.round(F.avg("v"), 6).alias("mean"), F.max("v").alias("most"))


def point_values(spark: SparkSession, sf: str) -> DataFrame:
    """Points with the values below them."""
    spots = D.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_returnflag").alias("region_group"), F.col("l_suppkey").alias("image_id"), (F.col("l_orderkey") % 70).cast("int").alias("x"), (F.col("l_partkey") % H).cast("int").alias("y"))
    return combine.at_points(D.pixels(spark, sf), spots, ["image_id", "x", "y"])


def redirected_measure(spark: SparkSession, sf: str) -> DataFrame:
    """Segmented on one plane, measured on the plane before."""
    px = D.pixels(spark, sf)
    found = combine.redirected(px.where(F.col("v") > 20), px.withColumn("image_id", F.col("image_id") + 1), ["image_id", "x", "y"])
    return found.groupBy("image_id").agg(F.count("*").alias("n"), F.round(F.avg("v"), 6).alias("mean"), F.max("v").alias("most"))


def image_calculator_16bit(spark: SparkSession, sf: str) -> DataFrame:
    px = D.pixels(spark, sf).withColumn("v", F.col("v") * 250)
    return combine.calculate(px, px.withColumn("image_id", F.col("image_id") + 1), ["image_id", "x", "y"], ["add", "subtract", "multiply", "divide", "average", "difference"], top=65535)


def stack_by_plane(spark: SparkSession, sf: str) -> DataFrame:
    """Every slice of a stack with the one plane of its image, as 32-bit values."""
    out = combine.calculate(D.stack(spark, sf), D.pixels(spark, sf), ["image_id", "x", "y"], ["subtract", "multiply", "divide", "average", "difference"], top=None, along=("z",))
    return out.withColumn("divide", F.when(F.isnan("divide"), -1.0).when(F.col("divide") == float("inf"), -2.0).otherwise(F.round("divide", 6)))


def colour_round_trips(spark: SparkSession, sf: str) -> DataFrame:
    """Colours by hue, saturation and brightness and back, and by XYZ and Lab and back."""
    rgb = D.rgb(spark, sf)
    hsb = P.rgb_of_hsb(*P.hsb(*(F.col(c) for c in "rgb")))
    there = rgb.withColumns(dict(zip(("cx", "cy", "cz"), P.xyz(*(F.col(c) for c in "rgb")), strict=True)))
    there = there.withColumns(dict(zip(("l", "a", "bb"), P.lab(*(F.col(c) for c in ("cx", "cy", "cz"))), strict=True)))
    there = there.withColumns(dict(zip(("lx", "ly", "lz"), P.xyz_of_lab(*(F.col(c) for c in ("l", "a", "bb"))), strict=True)))
    back = P.rgb_of_xyz(*(F.col(c) for c in ("lx", "ly", "lz")))
    small = P.xyy(*(F.col(c) for c in ("cx", "cy", "cz")))
    return there.select("image_id", "x", "y", *(c.alias(f"hsb_{n}") for c, n in zip(hsb, "rgb", strict=True)), *(c.alias(f"lab_{n}") for c, n in zip(back, "rgb", strict=True)), F.round(small[0], 6).alias("chroma_x"), F.round(small[1], 6).alias("chroma_y"))


def tag_consistency(spark: SparkSession, sf: str) -> DataFrame:
    return metadata.consistency(D.table(spark, sf, "orders"), ["o_custkey"], ["o_orderstatus", "o_orderpriority"])


def slice_spacing(spark: SparkSession, sf: str) -> DataFrame:
    out = metadata.spacing(D.table(spark, sf, "orders"), ["o_custkey"], "o_orderkey")
    return out.withColumn("mean", F.round("mean", 6))


def scaled_bicubic(spark: SparkSession, sf: str) -> DataFrame:
    return resample.resized(D.pixel_lines(spark, sf), IMAGE, (W, H), (96, 40))


def rotated_bicubic(spark: SparkSession, sf: str) -> DataFrame:
    return resample.turned(D.pixels(spark, sf), IMAGE, (W, H), 30, background=7)


def rotated_nearest(spark: SparkSession, sf: str) -> DataFrame:
    return resample.turned(D.pixels(spark, sf), IMAGE, (W, H), -40, "nearest", 3)


def searched_thresholds(spark: SparkSession, sf: str) -> DataFrame:
    return thresholds.searched_levels(D.pixels(spark, sf), IMAGE)


def shapes_between(spark: SparkSession, sf: str) -> DataFrame:
    """Shapes of every third slice, and between these."""
    return shapes.between(D.stack(spark, sf), IMAGE, (F.col("z") % 3 == 1) & (F.col("v") > 0))


def gaussian_3d(spark: SparkSession, sf: str) -> DataFrame:
    out = volumes.gaussian3d(D.stack(spark, sf), IMAGE, (1.5, 1.0, 0.7))
    return out.select("image_id", "z", "x", "y", F.round("v", 6).alias("v"))


def _ring(k) -> list:
    """A square and a smaller one inside it, by region number."""
    corner = lambda x, y: F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))
    square = lambda x, y, side: F.array(corner(x, y), corner(x + side, y), corner(x + side, y + side), corner(x, y + side))
    return [square(k * 6 + 0.25, k + 0.25, 14), square(k * 6 + 4.25, k + 5.25, 6)]


def _rings(spark: SparkSession, sf: str) -> DataFrame:
    ids = D.table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("image_id")).distinct().select("image_id", F.explode(F.sequence(F.lit(0), F.lit(7))).alias("roi_id"))
    return ids.withColumn("parts", F.array(*_ring(F.col("roi_id"))))


def composite_regions(spark: SparkSession, sf: str) -> DataFrame:
    """Regions with a hole on every plane."""
    found = combine.inside_composites(D.pixel_lines(spark, sf), _rings(spark, sf))
    return found.groupBy("image_id", "roi_id").agg(F.count("*").alias("n"), F.round(F.avg("v"), 6).alias("mean"), F.max("v").alias("most"))


def moved_regions(spark: SparkSession, sf: str) -> DataFrame:
    """The parts of the regions, larger, turned and moved, on every plane."""
    rois = combine.split(_rings(spark, sf))
    rois = rois.withColumn("points", points.moved(points.rotated(points.scaled(F.col("points"), 1.5, 0.75), 30), F.col("image_id") % 5 + 0.125, F.lit(2.0)))
    found = combine.inside_polygons(D.pixel_lines(spark, sf), rois)
    return found.groupBy("image_id", "roi_id", "part").agg(F.count("*").alias("n"), F.round(F.avg("v"), 6).alias("mean"), F.max("v").alias("most"))


def slices_by_number(spark: SparkSession, sf: str) -> DataFrame:
    rows = D.table(spark, sf, "orders").select("o_custkey", "o_orderkey", F.when(F.col("o_custkey") % 3 + F.col("o_orderkey") % 11 > 0, F.regexp_extract("o_orderpriority", "[0-9]+", 0).cast("int")).alias("number"))
    return metadata.sorted_slices(rows, ["o_custkey"], "o_orderkey", "number")
