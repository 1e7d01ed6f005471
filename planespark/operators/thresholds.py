"""Automatic thresholds of 8-bit planes: published methods on 256 counts a plane.

Counting is a grouped aggregation, and most methods are windows over the counts
of each plane. Three methods repeat steps until nothing changes; these are
aggregations over the steps, on an array of 256 counts a plane. A level t puts values above t in the foreground. A
plane with one value has that value as its level; where a method finds nothing
it gives 0. Scores are compared to nine decimals, ties go to the lower level.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Methods that are windows over the counts, with their sources.
#: mean (Glasbey 1993), percentile (Doyle 1962), isodata (Ridler and Calvard 1978), otsu (Otsu 1979),
#: max_entropy (Kapur, Sahoo and Wong 1985), yen (Yen, Chang and Chang 1995), min_error (Kittler and Illingworth 1986),
#: moments (Tsai 1985), triangle (Zack, Rogers and Latt 1977).
DIRECT = ("mean", "percentile", "isodata", "otsu", "max_entropy", "yen", "min_error", "moments", "triangle")


def _counts(px: DataFrame, keys: list[str]) -> DataFrame:
    """keys and 256 counts."""
    counts = px.groupBy(*keys, F.col("v").cast("int").alias("v")).agg(F.count("*").alias("n"))
    counts = counts.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("v", "n"))).alias("at"))
    dense = F.transform(F.array("at"), lambda at: F.transform(F.sequence(F.lit(0), F.lit(255)), lambda k: F.coalesce(F.try_element_at(at, k), F.lit(0))))  # the map is made once
    return counts.select(*keys, F.get(dense, F.lit(0)).alias("counts"))


def levels(px: DataFrame, keys: list[str], methods: tuple[str, ...] = DIRECT) -> DataFrame:
    """keys, method, level for every plane of 8-bit values, by methods of DIRECT."""
    line = Window.partitionBy(*keys).orderBy("v")
    upto, whole = line.rowsBetween(Window.unboundedPreceding, 0), line.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    h = _counts(px, keys).select(*keys, F.posexplode("counts").alias("v", "n"))
    v, n = F.col("v").cast("double"), F.col("n").cast("double")
    h = h.withColumns({"n_all": F.sum(n).over(whole), "n1": F.sum(n).over(upto), "s_all": F.sum(n * v).over(whole), "s1": F.sum(n * v).over(upto), "t_all": F.sum(n * v * v).over(whole), "t1": F.sum(n * v * v).over(upto), "c_all": F.sum(n * v * v * v).over(whole)})
    h = h.withColumn("p", n / F.col("n_all")).withColumn("e", F.when(F.col("n") > 0, F.col("p") * F.log("p")).otherwise(0.0))
    h = h.withColumns({"h_all": -F.sum("e").over(whole), "h1": -F.sum("e").over(upto), "q_all": F.sum(F.col("p") * F.col("p")).over(whole), "q1": F.sum(F.col("p") * F.col("p")).over(upto)})
    some, rest = F.col("n1") > 0, F.col("n1") < F.col("n_all")
    h = h.withColumns({"low": F.when(some, F.col("n1") / F.col("n_all")), "high": F.when(rest, (F.col("n_all") - F.col("n1")) / F.col("n_all")), "a": F.when(some, F.col("s1") / F.col("n1")), "b": F.when(rest, (F.col("s_all") - F.col("s1")) / (F.col("n_all") - F.col("n1")))})
    used = F.when(F.col("n") > 0, F.col("v"))
    h = h.withColumns({"peak": F.min_by("v", F.struct((-n).alias("k"), F.col("v"))).over(whole), "first": F.min(used).over(whole), "last": F.max(used).over(whole), "top": F.max(n).over(whole)})
    h = h.withColumn("end", F.when(F.col("last") - F.col("peak") >= F.col("peak") - F.col("first"), F.col("last")).otherwise(F.col("first")))
    h = h.withColumn("foot", F.max(F.when(F.col("v") == F.col("end"), n)).over(whole))
    m1, m2, m3 = F.col("s_all") / F.col("n_all"), F.col("t_all") / F.col("n_all"), F.col("c_all") / F.col("n_all")
    spread = F.nullif(m2 - m1 * m1, F.lit(0.0))
    c0, c1 = (m1 * m3 - m2 * m2) / spread, (m1 * m2 - m3) / spread
    root = F.sqrt(F.greatest(c1 * c1 - c0 * 4, F.lit(0.0)))
    share = F.when(root > 0, ((root - c1) / 2 - m1) / root).otherwise(1.0)
    low, high, a, b = (F.col(c) for c in ("low", "high", "a", "b"))
    va, vb = F.try_divide(F.col("t1"), F.col("n1")) - a * a, F.try_divide(F.col("t_all") - F.col("t1"), F.col("n_all") - F.col("n1")) - b * b
    between = F.col("v").between(F.least("peak", "end"), F.greatest("peak", "end"))

    def best(score: Column) -> Column:
        s = F.round(score, 9)
        return F.coalesce(-F.max(F.when(s.isNotNull() & ~F.isnan(s), F.struct(s.alias("s"), (-F.col("v")).alias("v"))))["v"], F.lit(0))

    made = {
        "mean": F.floor(F.max(m1)),
        "percentile": best(-F.abs(F.col("n1") / F.col("n_all") - 0.5)),
        "isodata": F.coalesce(F.min(F.when(F.col("v") >= F.floor((a + b) / 2), F.col("v"))), F.lit(0)),
        "otsu": best(low * high * (a - b) * (a - b)),
        "max_entropy": best(F.log(low) + F.col("h1") / low + F.log(high) + (F.col("h_all") - F.col("h1")) / high),
        "yen": best(F.log(low * high) * 2 - F.log(F.col("q1") * F.when(rest, F.col("q_all") - F.col("q1")))),
        "min_error": best(F.when((va > 1e-9) & (vb > 1e-9), (low * F.log(low) + high * F.log(high)) * 2 - low * F.log(va) - high * F.log(vb))),
        "moments": F.least(F.sum(F.when(F.round(F.col("n1") / F.col("n_all") - share, 9) <= 0, 1).otherwise(0)), F.lit(255)),
        "triangle": F.when(F.max("end") == F.max("peak"), F.max("peak")).otherwise(best(F.when(between, F.col("top") + (F.col("foot") - F.col("top")) * (F.col("v") - F.col("peak")) / F.nullif(F.col("end") - F.col("peak"), F.lit(0)) - n))),
    }
    found = h.groupBy(*keys).agg(F.min("first").alias("_first"), F.max("last").alias("_last"), *(made[m].cast("int").alias(f"_{m}") for m in methods))
    pairs = F.array(*(F.struct(F.lit(m).alias("method"), F.when(F.col("_first") == F.col("_last"), F.col("_first")).otherwise(F.col(f"_{m}")).alias("level")) for m in methods))
    return found.select(*keys, F.inline(pairs))


def applied(px: DataFrame, keys: list[str], method: str, whole_stack: bool = False) -> DataFrame:
    """255 above the method's level of each plane (keys and z), or of each stack, and 0 up to it."""
    at = [k for k in keys if k != "z"] if whole_stack else keys
    level = levels(px, at, (method,)).select(*at, "level")
    return px.join(level, at).select(*keys, "x", "y", F.when(F.col("v") > F.col("level"), 255).otherwise(0).alias("v"))


# Methods that repeat steps: each is one aggregation over the steps, on the array of 256 counts of a plane. A state that is done passes through.

#: Steps at most of Li's method, and of smoothing.
LI_STEPS, SMOOTH_STEPS = 256, 10_000


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda s, v: s + v)


def _li(n: Column) -> Column:
    """Minimum cross entropy, by iteration from the mean (Li and Tam 1998)."""
    levels = F.transform(n, lambda c, k: c * k)
    mean = F.floor(_sum(levels) / _sum(n)).cast("int")

    def step(s: Column, _: Column) -> Column:
        t = s["t"]
        below, above = _sum(F.slice(n, 1, t + 1)), _sum(F.slice(n, t + 2, 255 - t))
        a = F.try_divide(_sum(F.slice(levels, 1, t + 1)), below)
        b = F.try_divide(_sum(F.slice(levels, t + 2, 255 - t)), above)
        low, high = F.greatest(a, F.lit(1e-9)), F.greatest(b, F.lit(1e-9))
        new = F.floor((high - low) / F.try_subtract(F.log(high), F.log(low)) + 0.5).cast("int")
        stop = a.isNull() | b.isNull() | (high <= low)
        ended = F.struct(t.alias("t"), F.lit(True).alias("done"))
        return F.when(s["done"] | stop, ended).when((new == t) | (new == t - 1), F.struct(F.least(new, t).alias("t"), F.lit(True).alias("done"))).otherwise(F.struct(F.least(new, F.lit(255)).alias("t"), F.lit(False).alias("done")))

    return F.aggregate(F.sequence(F.lit(1), F.lit(LI_STEPS)), F.struct(mean.alias("t"), F.lit(False).alias("done")), step, lambda s: s["t"])


def _two_modes(n: Column) -> Column:
    """Counts after running means of three until two peaks are left at most (struct h, peaks, done)."""
    at = lambda h, k, beyond: F.coalesce(F.get(h, k), F.lit(beyond))
    peaks = lambda h: F.filter(F.sequence(F.lit(0), F.lit(255)), lambda k: (F.get(h, k) > at(h, k - 1, -1.0)) & (F.get(h, k) >= at(h, k + 1, -1.0)) & (F.get(h, k) > 0))
    third = 1 / 3
    mean = lambda h: F.transform(h, lambda v, k: at(h, k - 1, 0.0) * third + v * third + at(h, k + 1, 0.0) * third)
    state = lambda h, p: F.struct(h.alias("h"), p.alias("peaks"))

    def step(s: Column, _: Column) -> Column:
        smooth = F.aggregate(F.array(F.lit(0)), s["h"], lambda h, _: mean(h))
        return F.when(F.size(s["peaks"]) <= 2, s).otherwise(F.element_at(F.transform(F.array(smooth), lambda h: state(h, peaks(h))), 1))

    return F.aggregate(F.sequence(F.lit(1), F.lit(SMOOTH_STEPS)), state(n, peaks(n)), step)


ITERATED = ("li", "intermodes", "minimum")


def iterated_levels(px: DataFrame, keys: list[str], methods: tuple[str, ...] = ITERATED) -> DataFrame:
    """keys, method, level for every plane of 8-bit values, by methods of ITERATED.

    Intermodes is the middle of the two modes of the smoothed histogram, minimum
    the lowest place between them (Prewitt and Mendelsohn 1966); both are 0
    where smoothing leaves no two modes.
    """
    counts = _counts(px, keys).select(*keys, F.transform("counts", lambda c: c.cast("double")).alias("n"))
    used = F.filter(F.sequence(F.lit(0), F.lit(255)), lambda k: F.get("n", k) > 0)
    counts = counts.withColumns({"_used": used, "_modes": _two_modes(F.col("n"))})
    first, last = F.get("_modes.peaks", F.lit(0)), F.get("_modes.peaks", F.lit(1))
    between = F.transform(F.sequence(first, last), lambda k: F.struct(F.get("_modes.h", k).alias("h"), k.alias("k")))
    two = F.size("_modes.peaks") == 2
    level = {"li": _li(F.col("n")), "intermodes": F.when(two, F.floor((first + last) / 2)).otherwise(0), "minimum": F.when(two, F.array_min(between)["k"]).otherwise(0)}
    each = F.array(*(F.struct(F.lit(m).alias("method"), F.when(F.size("_used") == 1, F.get("_used", F.lit(0))).otherwise(level[m]).cast("int").alias("level")) for m in methods))
    return counts.select(*keys, F.explode(each).alias("m")).select(*keys, "m.method", "m.level")


# Methods on running sums of the counts, as arrays of 256 values in one row a plane; two of them score every level against every count.

SEARCHED = ("default", "isodata_plain", "huang", "renyi", "shanbhag")
PAIRED = ("huang", "shanbhag")
#: Shares in quarters of the three levels of Renyi's method, by whether the lower two and the upper two are near each other (at most NEAR apart).
RENYI_SHARES = {(True, True): (1, 2, 1), (True, False): (0, 1, 3), (False, True): (3, 1, 0), (False, False): (1, 2, 1)}
NEAR = 5
#: Fixed values of the default method: a highest count above FAR times the second is cut to CUT times the second.
FAR, CUT = 2, 1.5


def _running(values: Column) -> Column:
    """Sums up to each place."""
    return F.aggregate(values, F.array().cast("array<double>"), lambda done, v: F.concat(done, F.array(F.coalesce(F.get(done, F.size(done) - 1), F.lit(0.0)) + v)))


def _least(levels: Column, score) -> Column:
    """The level of the least score to nine decimals, the lower one of equals; null without a score."""
    scored = F.transform(levels, lambda t: F.struct(F.round(score(t), 9).alias("s"), t.alias("t")))
    return F.array_min(F.filter(scored, lambda p: p["s"].isNotNull() & ~F.isnan(p["s"])))["t"]


def _first_settled(n: str, n1: str, s1: str) -> Column:
    """Ridler and Calvard's level found upwards from the lowest: the first one that is not below the middle of the two means, or the last but two.

    The ends of the scale do not count; 128 where fewer than two levels are left.
    """
    at = lambda array, t: F.get(array, t)
    last = lambda array: F.get(array, F.lit(255))
    used = F.filter(F.sequence(F.lit(0), F.lit(255)), lambda t: at(n, t) > 0)
    middle = lambda t: (at(s1, t) / at(n1, t) + F.try_divide(last(s1) - at(s1, t), last(n1) - at(n1, t))) / 2

    def stop(ends: Column) -> Column:
        low, high = ends["low"], ends["high"]
        steps = F.when(low < high, F.transform(F.sequence(low, high - 1), lambda t: F.struct(t.alias("t"), middle(t).alias("m"))))
        return F.get(F.filter(steps, lambda p: (p["t"] + 1 > F.round(p["m"], 9)) | (p["t"] + 1 >= high - 1)), F.lit(0))["m"]

    ends = F.transform(F.array(used), lambda u: F.struct(F.array_min(u).alias("low"), F.array_max(u).alias("high")))
    return F.coalesce(F.floor(F.round(F.get(F.transform(ends, stop), F.lit(0)), 9) + 0.5), F.lit(128))


def searched_levels(px: DataFrame, keys: list[str], methods: tuple[str, ...] = SEARCHED) -> DataFrame:
    """keys, method, level for every plane of 8-bit values, by methods of SEARCHED.

    default is isodata_plain with a dominant count cut down; huang the least
    fuzziness (Huang and Wang 1995), renyi a mean of the levels of greatest
    entropy of orders 1/2, 1 and 2 (Sahoo, Wilkins and Yeager 1997), shanbhag
    the level at which both sides tell as much (Shanbhag 1994). A plane with two
    values has the level just below the higher one.
    """
    every = F.sequence(F.lit(0), F.lit(255))
    at, last = (lambda array, t: F.get(array, t)), (lambda array: F.get(array, F.lit(255)))
    rows = _counts(px, keys).select(*keys, F.transform("counts", lambda c: c.cast("double")).alias("n"))
    peak = F.array_position("n", F.array_max("n")).cast("int")
    second = F.array_max(F.transform("n", lambda c, k: F.when(k + 1 != F.col("peak"), c).otherwise(0.0)))
    cut = F.when((F.array_max("n") > F.col("second") * FAR) & (F.col("second") > 0), F.floor(F.col("second") * CUT).cast("double")).otherwise(F.array_max("n"))
    rows = rows.withColumns({"used": F.filter(every, lambda t: at("n", t) > 0), "peak": peak}).withColumns({"first": F.array_min("used"), "end": F.array_max("used"), "second": second})
    rows = rows.withColumns({"tamed": F.transform("n", lambda c, k: F.when(k + 1 == F.col("peak"), cut).otherwise(c))})
    inner = lambda array: F.transform(array, lambda c, k: F.when((k > 0) & (k < 255), c).otherwise(0.0))
    rows = rows.withColumns({"plain": inner("n"), "tamed": inner("tamed")})
    moment = lambda array: F.transform(array, lambda c, k: c * k)
    rows = rows.withColumns({
        "n1": _running(F.col("n")), "s1": _running(moment("n")), "r1": _running(F.transform("n", F.sqrt)), "q1": _running(F.transform("n", lambda c: c * c)), "e1": _running(F.transform("n", lambda c: F.when(c > 0, c * F.log(c)).otherwise(0.0))),
        "plain_n": _running(F.col("plain")), "plain_s": _running(moment("plain")), "tamed_n": _running(F.col("tamed")), "tamed_s": _running(moment("tamed")),
    })
    first, end = F.col("first"), F.col("end")
    low, high = (lambda t: at("n1", t)), (lambda t: last("n1") - at("n1", t))
    rest = lambda array, t: last(array) - at(array, t)
    between = F.filter(every, lambda t: (t >= first) & (t < end))

    order = {
        "half": lambda t: F.log(at("r1", t) * rest("r1", t) / F.sqrt(low(t) * high(t))) * 2,
        "one": lambda t: F.log(low(t)) - at("e1", t) / low(t) + F.log(high(t)) - rest("e1", t) / high(t),
        "two": lambda t: -F.log(at("q1", t) / low(t) / low(t) * (rest("q1", t) / high(t) / high(t))),
    }
    best = lambda f: F.coalesce(_least(between, lambda t: F.when(F.round(f(t), 9) > 0, -f(t))), F.lit(0))
    rows = rows.withColumn("three", F.array_sort(F.array(*(best(f) for f in order.values()))))
    t1, t2, t3 = (F.get("three", F.lit(k)) for k in range(3))
    mid = (at("n1", t3) - at("n1", t1)) / last("n1")

    def mixed(shares: tuple[int, int, int]) -> Column:
        q = [mid * s / 4 for s in shares]
        return F.floor(F.round(t1 * (at("n1", t1) / last("n1") + q[0]) + t2 * q[1] + t3 * (high(t3) / last("n1") + q[2]), 9))

    renyi = F.lit(None).cast("long")
    for (lower, upper), shares in RENYI_SHARES.items():
        renyi = F.when(((t2 - t1 <= NEAR) == F.lit(lower)) & ((t3 - t2 <= NEAR) == F.lit(upper)), mixed(shares)).otherwise(renyi)
    level = {"default": _first_settled("tamed", "tamed_n", "tamed_s"), "isodata_plain": _first_settled("plain", "plain_n", "plain_s"), "renyi": renyi}
    plane = {"first": first, "end": end, "used": F.size("used")} | {m: level[m].cast("int") for m in methods if m in level}
    rows = rows.select(*keys, *(c.alias(f"_{m}") for m, c in plane.items()), "n", "n1", "s1")
    if set(methods) & set(PAIRED):
        rows = _paired(rows, keys, [f"_{m}" for m in plane])
    each = F.array(*(F.struct(F.lit(m).alias("method"), F.when(F.col("_used") == 1, F.col("_first")).when(F.col("_used") == 2, F.col("_end") - 1).otherwise(F.col(f"_{m}")).alias("level")) for m in methods))
    return rows.select(*keys, F.explode(each).alias("m")).select(*keys, "m.method", "m.level")


def _paired(rows: DataFrame, keys: list[str], kept: list[str]) -> DataFrame:
    """keys, ``kept`` (whole numbers of a plane), _huang, _shanbhag: each level t against each count k, summed before they are shuffled; a group holds 256 levels."""
    at, last = (lambda array, t: F.get(array, t)), (lambda array: F.get(array, F.lit(255)))
    high = lambda t: last("n1") - at("n1", t)
    every = F.sequence(F.lit(0), F.lit(255))
    levels_of = F.transform(every, lambda t: F.struct(t.alias("t"), at("n1", t).alias("low"), high(t).alias("high"), F.coalesce(F.try_divide(at("s1", t), at("n1", t)), F.lit(0.0)).alias("a"), F.coalesce(F.try_divide(last("s1") - at("s1", t), high(t)), F.lit(0.0)).alias("b")))
    counts_of = F.filter(F.transform(every, lambda k: F.struct(k.alias("k"), at("n", k).alias("n"), (at("n1", k) - at("n", k)).alias("before"), high(k).alias("beyond"))), lambda c: c["n"] > 0)
    rows = rows.select(*keys, *kept, counts_of.alias("_counts"), levels_of.alias("_levels"))  # once a plane, before its rows
    rows = rows.select(*keys, *kept, "_counts", F.explode_outer("_levels").alias("l")).select(*keys, *kept, "l.*", F.explode_outer("_counts").alias("c"))  # outer: a test for empty arrays would work them out again
    n, below = F.col("c.n"), F.col("c.k") <= F.col("t")
    m = 1 / (1 + F.abs(F.col("c.k") - F.when(below, F.col("a")).otherwise(F.col("b"))) / F.nullif(F.col("_end") - F.col("_first"), F.lit(0)))
    rows = rows.withColumn("m", m)
    unsure = F.when((F.col("m") >= 1e-6) & (F.col("m") <= 0.999999), -F.col("m") * F.log("m") - (1 - F.col("m")) * F.log(1 - F.col("m"))).otherwise(0.0)
    inside = (F.col("t") >= F.col("_first")) & (F.col("t") < F.col("_end"))
    told = F.when(inside & below, n * F.log(1 - F.col("c.before") * 0.5 / F.col("low")) / F.col("low")).when(inside, -n * F.log(1 - F.col("c.beyond") * 0.5 / F.col("high")) / F.col("high"))
    whole = [F.max(c).alias(c) for c in kept]
    scores = rows.groupBy(*keys, "t").agg(*whole, F.round(F.sum(n * unsure), 9).alias("fuzzy"), F.round(F.abs(F.sum(told)) * 0.5, 9).alias("told"))
    least = lambda score: F.min(F.when(F.col(score).isNotNull(), F.struct(score, "t")))["t"]
    return scores.groupBy(*keys).agg(*whole, least("fuzzy").alias("_huang"), least("told").alias("_shanbhag"))
