"""Signal tracks (T1-T10, W8, W9, A22). A track has rows sample, chrom, start, end, value that do not overlap within a sample; bases without a row are 0.

Regions have a unique id. Results stay run-length coded as long as they can: bins get value x overlap of each track row, and only per-base answers are exploded.
Defined results: null values and reversed rows count as absent; a region without signal has 0 everywhere; regions with a null bound give nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanweave.operators.intervals import overlap_join
from spanweave.runtime import attach, once


def _parts(regions: DataFrame, track: DataFrame) -> DataFrame:
    """Track rows clipped to regions: id, r_start, r_end, sample, s, e (from the region's start), value."""
    t = track.where("value IS NOT NULL AND end > start").select("sample", "chrom", "start", "end", F.col("value").cast("double").alias("value"))
    hits = overlap_join(regions.where("end > start").select("id", "chrom", "start", "end"), t, ["chrom"])
    s, e = F.greatest("start", "start_b"), F.least("end", "end_b")
    return hits.select("id", F.col("start").alias("r_start"), F.col("end").alias("r_end"), F.col("sample_b").alias("sample"), (s - F.col("start")).alias("s"), (e - F.col("start")).alias("e"), F.col("value_b").alias("value"))


def _all_pairs(regions: DataFrame, track: DataFrame) -> DataFrame:
    """Each region with each sample; the samples are the names of the tracks, one row each."""
    return regions.where("end > start").select("id", (F.col("end") - F.col("start")).alias("length")).crossJoin(F.broadcast(track.select("sample").distinct()))


def values(regions: DataFrame, track: DataFrame) -> DataFrame:
    """(id, sample, pos, value) of every base, pos from 0. Gaps are filled while signal is still run-length coded; bases are exploded last and never moved."""
    track = once(track)
    none = _all_pairs(regions, track).select("id", "sample", "length", F.lit(0).cast("bigint").alias("s"), F.lit(0).cast("bigint").alias("e"), F.lit(0.0).alias("value"))
    runs = none.unionByName(_parts(regions, track).select("id", "sample", (F.col("r_end") - F.col("r_start")).alias("length"), "s", "e", "value"))
    after = F.coalesce(F.lead("s").over(Window.partitionBy("id", "sample").orderBy("s", "e")), F.col("length"))
    run, gap = F.struct("s", "e", "value"), F.struct(F.col("e").alias("s"), F.col("_next").alias("e"), F.lit(0.0).alias("value"))
    out = runs.withColumn("_next", after).select("id", "sample", F.explode(F.array(run, gap)).alias("_r")).where("_r.s < _r.e")
    return out.select("id", "sample", F.explode(F.sequence("_r.s", F.col("_r.e") - 1)).alias("pos"), F.col("_r.value").alias("value"))


def stats(regions: DataFrame, track: DataFrame) -> DataFrame:
    """Mean, max, min, sum, coverage and std over the bases that have a value; all 0 where none has."""
    track = once(track)
    n, v = F.col("e") - F.col("s"), F.col("value")
    got = _parts(regions, track).groupBy("id", "sample").agg(
        F.sum(n).alias("n"), F.sum(v * n).alias("sum"), F.max(v).alias("max"), F.min(v).alias("min"), F.sum(v * v * n).alias("_q")
    )
    var = (F.col("_q") - F.col("sum") * F.col("sum") / F.col("n")) / (F.col("n") - 1)
    out = _all_pairs(regions, track).join(got, ["id", "sample"], "left")
    cols = {"mean": F.col("sum") / F.col("n"), "max": F.col("max"), "min": F.col("min"), "sum": F.col("sum"), "coverage": F.col("n") / F.col("length"), "std": F.when(F.col("n") > 1, F.sqrt(F.greatest(var, F.lit(0.0))))}
    return out.select("id", "sample", *[F.coalesce(c, F.lit(0.0)).alias(k) for k, c in cols.items()])


def _binned(parts: DataFrame, width: Column, n: Column, value: Column) -> DataFrame:
    """id, sample, bin, value: sums of value x overlap over bins of ``width`` bases, ``n`` bins."""
    p = parts.withColumn("_w", width).withColumn("_n", n).where((F.col("_w") > 0) & (F.col("s") < F.col("_w") * F.col("_n")))
    last = F.least(F.expr("(e - 1) div _w"), F.col("_n") - 1)
    p = p.withColumn("bin", F.explode(F.sequence(F.expr("s div _w"), last)))
    size = F.least("e", (F.col("bin") + 1) * F.col("_w")) - F.greatest("s", F.col("bin") * F.col("_w"))
    return p.groupBy("id", "sample", "bin").agg((F.sum(value * size) / F.max("_w")).alias("value"))


def _with_zeros(regions: DataFrame, track: DataFrame, got: DataFrame, n: int) -> DataFrame:
    bins = _all_pairs(regions, track).select("id", "sample", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(n - 1).cast("bigint"))).alias("bin"))
    return bins.join(got, ["id", "sample", "bin"], "left").withColumn("value", F.coalesce("value", F.lit(0.0)))


def coverage_bins(regions: DataFrame, track: DataFrame, nbins: int, fractional: bool = False) -> DataFrame:
    """T4: share of bases other than 0 in each of ``nbins`` equal bins; a length that does not divide raises.

    ``fractional``: bins of exactly length / nbins bases at any length; a base that two or more bins share counts in each by its part."""
    track = once(track)
    parts = _parts(regions, track).withColumn("length", F.col("r_end") - F.col("r_start"))
    if fractional:  # in units of 1 / nbins of a base every bin is ``length`` units wide
        parts = parts.withColumns({"s": F.col("s") * nbins, "e": F.col("e") * nbins}).where("value <> 0")
        return _with_zeros(regions, track, _binned(parts, F.col("length"), F.lit(nbins), F.lit(1.0)), nbins)
    fits = F.when(F.col("length") % nbins == 0, F.col("length")).otherwise(F.raise_error(F.lit("the length is no multiple of the number of bins")).cast("bigint"))
    got = _binned(parts.withColumn("length", fits).where("value <> 0"), F.expr(f"length div {nbins}"), F.lit(nbins), F.lit(1.0))
    return _with_zeros(regions, track, got, nbins)


def scale_region(regions: DataFrame, track: DataFrame, length: int = 1000, nbins: int = 10) -> DataFrame:
    """T5: regions scaled to ``length // nbins`` values, means of equal windows; what is left over at the end is cut; regions shorter than that are 0."""
    track = once(track)
    n = length // nbins
    got = _binned(_parts(regions, track), F.expr(f"(r_end - r_start) div {n}"), F.lit(n), F.col("value"))
    return _with_zeros(regions, track, got, n)


def sliding_coverage(regions: DataFrame, track: DataFrame, nbins: int) -> DataFrame:
    """(id, sample, pos, value): share of bases other than 0 among the ``nbins`` from pos on, as far as that many are left.

    The count of such bases is linear between the places where an end of the window meets an end of a run, so it is summed over these and exploded last."""
    track = once(track)
    zero = F.lit(0).cast("bigint")

    def turn(at: Column, slope: int, count: Column) -> Column:
        return F.struct(F.greatest(at, zero).alias("p"), F.lit(slope).cast("bigint").alias("slope"), count.alias("count"))

    runs = _parts(regions, track).where("value <> 0").withColumn("length", F.col("r_end") - F.col("r_start")).where(F.col("length") >= nbins)
    first = F.greatest(F.least("e", F.lit(nbins).cast("bigint")) - F.col("s"), zero)
    turns = [turn(F.col("s") - nbins, 1, zero), turn(F.col("e") - nbins, -1, zero), turn(F.col("s"), -1, zero), turn(F.col("e"), 1, zero), turn(zero, 0, first)]
    none = _all_pairs(regions, track).where(F.col("length") >= nbins).select("id", "sample", "length", turn(zero, 0, zero).alias("_t"))
    got = none.unionByName(runs.select("id", "sample", "length", F.explode(F.array(*turns)).alias("_t"))).select("id", "sample", "length", "_t.*").where(F.col("p") <= F.col("length") - nbins)
    got = got.groupBy("id", "sample", "length", "p").agg(F.sum("slope").alias("slope"), F.sum("count").alias("count"))
    w = Window.partitionBy("id", "sample").orderBy("p")
    until = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    line = {"_slope": F.sum("slope").over(until), "_count": F.sum(F.col("count") - F.col("slope") * F.col("p")).over(until), "_next": F.coalesce(F.lead("p").over(w), F.col("length") - nbins + 1)}
    at = got.withColumns(line).select("id", "sample", "_slope", "_count", F.explode(F.sequence("p", F.col("_next") - 1)).alias("pos"))
    return at.select("id", "sample", "pos", ((F.col("_count") + F.col("_slope") * F.col("pos")) / nbins).alias("value"))


def _flipped(df: DataFrame, n: int) -> Column:
    return F.when(F.col("strand") == "-", F.lit(n - 1) - F.col("bin")).otherwise(F.col("bin"))


def _profile(loci: DataFrame, track: DataFrame, got: DataFrame, n: int) -> DataFrame:
    """Mean over loci: (sample, bin, value), zeros included."""
    total = loci.agg(F.count("*").alias("_c"))
    sums = got.join(loci.select("id", "strand"), "id").withColumn("bin", _flipped(got, n)).groupBy("sample", "bin").agg(F.sum("value").alias("value"))
    bins = track.select("sample").distinct().select("sample", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(n - 1).cast("bigint"))).alias("bin"))
    out = bins.join(sums, ["sample", "bin"], "left").transform(attach, total)
    return out.select("sample", "bin", (F.coalesce("value", F.lit(0.0)) / F.col("_c")).alias("value"))


def _window(loci: DataFrame, point: str, up: int, down: int) -> DataFrame:
    minus = F.col("strand") == "-"
    at = F.when(minus, F.col("start") if point == "TES" else F.col("end")).otherwise(F.col("end") if point == "TES" else F.col("start"))
    lo, hi = F.when(minus, at - down).otherwise(at - up), F.when(minus, at + up).otherwise(at + down)
    return loci.select("id", "chrom", "strand", lo.alias("start"), hi.alias("end"))


def reference_point(loci: DataFrame, track: DataFrame, point: str = "TES", method: str = "reads", up: int = 2000, down: int = 10000, bins: int = 10) -> DataFrame:
    """Mean profile around a point, in the loci's direction; before position 0 the signal is 0. ``reads``: means of bins; ``coverage``: sliding share of bases with signal."""
    track = once(track)
    w = _window(loci, point, up, down)
    if method == "reads":
        n = (up + down) // bins
        return _profile(w, track, _binned(_parts(w, track), F.lit(bins), F.lit(n), F.col("value")), n)
    return _profile(w, track, sliding_coverage(w, track, bins).withColumnRenamed("pos", "bin"), up + down - bins + 1)


def signal_point(loci: DataFrame, track: DataFrame, point: str = "TES", up: int = 2000, down: int = 2000) -> DataFrame:
    """Per-base mean profile; call it with the sense and the antisense track."""
    track = once(track)
    w = _window(loci, point, up, down)
    return _profile(w, track, _binned(_parts(w, track), F.lit(1), F.lit(up + down), F.col("value")), up + down)


def scale_regions(loci: DataFrame, track: DataFrame, up: int = 2000, down: int = 2000, length: int = 5000, bins: int = 10) -> DataFrame:
    """Mean profile of upstream bins, the body scaled to ``length // bins`` bins, and downstream bins, in the loci's direction."""
    track = once(track)
    minus = F.col("strand") == "-"
    lo, hi = F.when(minus, down).otherwise(up), F.when(minus, up).otherwise(down)  # left and right in coordinates
    parts = [
        (loci.select("id", "chrom", "strand", (F.col("start") - lo).alias("start"), F.col("start").alias("end")), F.expr(f"(r_end - r_start) div {bins}"), F.lit(bins), F.lit(0)),
        (loci.select("id", "chrom", "strand", "start", "end"), F.lit(length // bins), None, lo / bins),
        (loci.select("id", "chrom", "strand", F.col("end").alias("start"), (F.col("end") + hi).alias("end")), F.expr(f"(r_end - r_start) div {bins}"), F.lit(bins), lo / bins + length // bins),
    ]
    out = None
    for regions, n, width, first in parts:
        p = _parts(regions, track)
        w = F.expr(f"(r_end - r_start) div {length // bins}") if width is None else width
        b = _binned(p.withColumn("_count", n), w, F.col("_count"), F.col("value"))
        b = b.join(loci.select("id", "strand"), "id").withColumn("bin", F.col("bin") + first.cast("bigint")).drop("strand")
        out = b if out is None else out.unionByName(b)
    return _profile(loci, track, out, (up + down + length) // bins)


def savgol(window: int, order: int) -> list[float]:
    """Weights of the Savitzky-Golay smoother's middle point."""
    import numpy as np

    half = window // 2
    a = np.vander(np.arange(-half, half + 1), order + 1, increasing=True).astype(float)
    return np.linalg.pinv(a)[0].tolist()


def smooth(profile: DataFrame, window: int, order: int, by: str = "sample", at: str = "bin", value: str = "value") -> DataFrame:
    """A smoothed profile; at either end the polynomial of the outermost full window goes on. Profiles are short and come as one array each."""
    import numpy as np
    import pandas as pd

    half = window // 2
    grid = np.vander(np.arange(-half, half + 1), order + 1, increasing=True).astype(float)
    solve = np.linalg.pinv(grid)

    def run(p: pd.DataFrame) -> pd.DataFrame:
        p = p.sort_values(at)
        y = p[value].to_numpy(float)
        if len(y) >= window:
            out = np.convolve(y, solve[0][::-1], "same")
            out[:half] = (grid @ (solve @ y[:window]))[:half]
            out[-half:] = (grid @ (solve @ y[-window:]))[-half:]
            p = p.assign(**{value: out})
        return p

    return profile.groupBy(by).applyInPandas(run, profile.schema)
