"""Estimators over numeric series ``[*by,] i, v`` (``i`` dense from 0): R/S, DFA, MF-DFA.

A window's linear detrending has a closed form in sums, RMS^2 = (Syy - Sxy^2 / Sxx) / k, so every
estimator is an aggregation by (scale, window) with map-side combination. Scales depend on a
series' length only; they come as a table made from the distinct lengths.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quirelab.operators.corpus import prefix


def log_scales(low: int, high: int, count: int) -> list[int]:
    """Distinct whole numbers of ``count`` log-spaced ones from ``low`` to ``high``."""
    if high < low:
        return []
    ks = np.unique(np.logspace(np.log10(low), np.log10(high), count).astype(int))
    return [int(k) for k in ks if low <= k <= high]


def _profile(df: DataFrame, by: Sequence[str]) -> DataFrame:
    """Add ``n``, ``sd`` and the profile ``z``: the running sum of v minus its mean, up to each row."""
    stats = df.groupBy(*by).agg(F.count("*").alias("n"), F.avg("v").alias("mu"), F.stddev_pop("v").alias("sd"))
    joined = df.join(stats, list(by)) if by else df.crossJoin(F.broadcast(stats))  # one row
    return prefix(joined, by, "i", F.col("v"), "before").withColumn("z", F.col("before") + F.col("v") - (F.col("i") + 1) * F.col("mu"))


def _scales(df: DataFrame, by: Sequence[str], make) -> DataFrame:
    """``n, k``: scales for every distinct length, made where the lengths are; how they are joined is left to their size."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame([(n, k) for n in b["n"] for k in make(int(n))], columns=["n", "k"]).astype("int64")

    return df.groupBy(*by).agg(F.count("*").alias("n")).select("n").distinct().mapInPandas(run, "n long, k long")


def _slope(points: DataFrame, by: Sequence[str], least: int, y: str) -> DataFrame:
    fit = points.groupBy(*by).agg(F.count("*").alias("scales"), F.expr(f"regr_slope(ln({y}), ln(k))").alias("s"))
    return fit.where(F.col("scales") >= least).select(*by, "scales", F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("s"))).alias("h"))


def _residual() -> Column:
    """RMS of a window's residuals around its line; at least 0."""
    rest = F.expr("regr_syy(z, x) - regr_sxy(z, x) * regr_sxy(z, x) / regr_sxx(z, x)")
    return F.sqrt(F.greatest(rest, F.lit(0.0)) / F.count("*"))


def segments(df: DataFrame, by: Sequence[str], make, windows: int) -> DataFrame:
    """Residuals of whole tumbling windows: ``[*by,] k, win, rms`` with rms > 0, for scales with at least ``windows`` windows."""
    rows = _profile(df, by).join(_scales(df, by, make), "n").where(f"n div k >= {windows}")
    rows = rows.select(*by, "k", F.expr("i div k").alias("win"), F.expr("i % k").alias("x"), "z", "n").where("win < n div k")
    # Residuals this far below the profile's own size are rounding, not fluctuation.
    out = rows.groupBy(*by, "k", "win").agg(_residual().alias("rms"), F.max(F.abs("z")).alias("top"))
    return out.where("rms > 1e-10 * greatest(top, 1)").select(*by, "k", "win", "rms")


def hurst_dfa(df: DataFrame, by: Sequence[str] = (), low: int = 4) -> DataFrame:
    """DFA exponent ``[*by,] scales, h`` in [0, 1]; no row under 20 points or five usable scales."""
    make = lambda n: log_scales(low, min(n // 4, 1000), 30) if n >= 20 else []
    per = segments(df, by, make, 4).groupBy(*by, "k").agg(F.avg("rms").alias("f"), F.count("*").alias("w")).where("w >= 4")
    return _slope(per, by, 5, "f")


def hurst_rs(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """R/S exponent ``[*by,] scales, h`` over half-overlapping windows; no row where undefined."""
    make = lambda n: log_scales(8, min(n // 4, 1000), 30) if n >= 20 else []
    rows = _profile(df, by).join(_scales(df, by, make), "n").withColumn("step", F.expr("greatest(1, k div 2)")).where("(n - k) div step + 1 >= 4")
    wins = F.expr("sequence(greatest(0L, cast(ceil((i - k + 1) / step) as bigint)), i div step)")
    rows = rows.select(*by, "k", "v", "z", F.expr("(n - k) div step").alias("last"), F.explode(wins).alias("win")).where("win <= last")
    per = rows.groupBy(*by, "k", "win").agg((F.max("z") - F.min("z")).alias("r"), F.stddev_pop("v").alias("s")).where("s > 0")
    mean = per.groupBy(*by, "k").agg(F.avg(F.col("r") / F.col("s")).alias("rs"), F.count("*").alias("w")).where("w >= 4")
    return _slope(mean, by, 5, "rs")


def hurst_ensemble(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Both exponents with mean and population deviation: ``[*by,] rs, dfa, mean, std``; undefined ones are null."""
    keys = df.select(*by).distinct() if by else df.sparkSession.range(1).select()
    rs, dfa = hurst_rs(df, by).select(*by, F.col("h").alias("rs")), hurst_dfa(df, by).select(*by, F.col("h").alias("dfa"))
    put = lambda a, b: a.join(b, list(by), "left") if by else a.join(b, F.lit(True), "left")
    out = put(put(keys, rs), dfa)
    mean = F.when(F.col("rs").isNull(), F.col("dfa")).when(F.col("dfa").isNull(), F.col("rs")).otherwise((F.col("rs") + F.col("dfa")) / 2)
    std = F.when(F.col("rs").isNull() | F.col("dfa").isNull(), F.when(mean.isNotNull(), 0.0)).otherwise(F.abs(F.col("rs") - F.col("dfa")) / 2)
    return out.select(*by, "rs", "dfa", mean.alias("mean"), std.alias("std"))


def by_group(df: DataFrame, group: str, least: int, estimate) -> DataFrame:
    """An estimator per group with at least ``least`` values, and over all these together as group 'aggregate'.

    ``df``: ``group, i, v``. Groups with fewer values are left out of both. In the aggregate the
    groups stand one after another in order of their name.
    """
    sizes = df.groupBy(group).agg(F.count("*").alias("n"), F.min("i").alias("lo")).where(F.col("n") >= least)
    offsets = sizes.select(group, "lo", (F.sum("n").over(Window.orderBy(group)) - F.col("n")).alias("b"))  # one row per group
    kept = df.join(offsets, group)
    local = prefix(kept.select(group, "i", "v", "b"), [group], "i", F.lit(1), "j")
    rows = local.select(group, "v", F.col("j").cast("long").alias("i"), "b")
    whole = rows.select(F.lit("aggregate").alias(group), (F.col("b") + F.col("i")).cast("long").alias("i"), "v")
    return estimate(rows.select(group, "i", "v").unionByName(whole), [group])


def multifractal(df: DataFrame, by: Sequence[str] = (), q_low: float = -5.0, q_high: float = 5.0, q_step: float = 0.5) -> DataFrame:
    """MF-DFA spectrum ``[*by,] q, hq, tau, r2, alpha, f_alpha``.

    No rows under 1000 points, for a constant series, or with fewer than three exponents. Each
    fluctuation keeps its own scale, also where an earlier scale is unusable.
    """
    make = lambda n: log_scales(16, n // 4, 20) if n >= 1000 else []
    count = int(round((q_high - q_low) / q_step)) + 1
    qs = F.array(*(F.lit(round(q_low + i * q_step, 10)) for i in range(count)))
    seg = segments(df, by, make, 2).withColumn("q", F.explode(qs))
    # Powers are taken against the geometric mean, so they neither overflow nor vanish.
    mean = seg.groupBy(*by, "k").agg(F.avg(F.ln("rms")).alias("g"))
    seg = seg.join(mean, [*by, "k"])
    per = seg.groupBy(*by, "k", "q").agg(F.first("g").alias("g"), F.avg(F.exp(F.col("q") * (F.ln("rms") - F.col("g")))).alias("m"), F.count("*").alias("w")).where("w >= 2")
    f = per.withColumn("f", F.when(F.col("q") == 0, F.col("g")).otherwise(F.col("g") + F.ln("m") / F.col("q")))
    fit = f.groupBy(*by, "q").agg(F.count("*").alias("scales"), F.expr("regr_slope(f, ln(k))").alias("hq"), F.coalesce(F.expr("regr_r2(f, ln(k))"), F.lit(0.0)).alias("r2")).where("scales >= 4")
    w = Window.partitionBy(*by).orderBy("q")
    step = (F.lead("hq").over(w) - F.lag("hq").over(w)) / (F.lead("q").over(w) - F.lag("q").over(w))
    ahead = (F.lead("hq").over(w) - F.col("hq")) / (F.lead("q").over(w) - F.col("q"))
    back = (F.col("hq") - F.lag("hq").over(w)) / (F.col("q") - F.lag("q").over(w))
    out = fit.withColumn("tau", F.col("q") * F.col("hq") - 1).withColumn("slope", F.coalesce(step, ahead, back)).withColumn("n_q", F.count("*").over(Window.partitionBy(*by))).where("n_q >= 3")
    alpha = F.col("hq") + F.col("q") * F.col("slope")
    return out.select(*by, "q", "hq", "tau", "r2", alpha.alias("alpha"), (F.col("q") * alpha - F.col("tau")).alias("f_alpha"))


def multifractal_summary(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """``[*by,] delta_h, delta_alpha, mean_r2, min_r2`` of the spectrum; no row where undefined."""
    spread = lambda c: (F.max(c) - F.min(c)).alias(f"delta_{c[0] if c == 'hq' else c}")
    return multifractal(df, by).groupBy(*by).agg(spread("hq"), spread("alpha"), F.avg("r2").alias("mean_r2"), F.min("r2").alias("min_r2")).where("delta_h is not null")
