"""Box-counting dimension of point clouds ``[*by,] x, y``."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quirelab.operators.corpus import word_ids

#: Points whose pairwise distances estimate the spacing.
SAMPLE = 500


def line_points(lines: DataFrame, flat: DataFrame, by: Sequence[str] = (), scale: str = "line", least_words: int = 1, keep: Sequence[str] = ()) -> DataFrame:
    """Points of a word stream: x is the place in the line (or in the corpus), y the alphabetical rank, both in [0, 1]."""
    if scale not in ("line", "corpus"):
        raise ValueError("scale is 'line' or 'corpus'")
    ids = word_ids(flat, by, first=False)
    size = ids.groupBy(*by).agg(F.count("*").alias("types"))
    rows = flat.join(ids, [*by, "word"])
    rows = rows.join(size, list(by)) if by else rows.crossJoin(F.broadcast(size))  # one row
    if scale == "line":
        lengths = lines.select(*by, "line_no", F.size("words").alias("m")).where(F.col("m") >= least_words)
        rows = rows.join(lengths, [*by, "line_no"])
        x = F.col("idx") / F.greatest(F.lit(1), F.col("m") - 1)
    else:
        n = flat.groupBy(*by).agg(F.count("*").alias("m"))
        rows = rows.join(n, list(by)) if by else rows.crossJoin(F.broadcast(n))
        x = F.col("pos") / F.greatest(F.lit(1), F.col("m") - 1)
    return rows.select(*by, *keep, x.alias("x"), (F.col("id") / F.greatest(F.lit(1), F.col("types") - 1)).alias("y"))


def unit_square(points: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Points stretched to [0, 1] in either direction; a range of 0 stays as it is."""
    box = points.groupBy(*by).agg(*(f(c).alias(f"{n}_{c}") for c in "xy" for n, f in (("lo", F.min), ("hi", F.max))), F.count("*").alias("n"))
    rows = points.join(box, list(by)) if by else points.crossJoin(F.broadcast(box))  # one row
    to = lambda c: ((F.col(c) - F.col(f"lo_{c}")) / F.when(F.col(f"hi_{c}") > F.col(f"lo_{c}"), F.col(f"hi_{c}") - F.col(f"lo_{c}")).otherwise(1.0)).alias(c)
    return rows.select(*by, to("x"), to("y"), "n")


def box_counts(points: DataFrame, by: Sequence[str] = (), n_scales: int = 30, spacing: float | None = None) -> DataFrame:
    """Occupied boxes per scale: ``[*by,] j, scale, n, boxes``, for at least 100 points.

    ``spacing``: the least distance to resolve; by default the first percentile of the distances
    within a sample of SAMPLE points, those lowest by hash (a fixed-size estimate of one
    parameter; every point is counted).
    """
    unit = unit_square(points, by).where("n >= 100")
    if spacing is None:
        w = Window.partitionBy(*by).orderBy(F.xxhash64("x", "y"), "x", "y")
        few = unit.withColumn("r", F.row_number().over(w)).where(F.col("r") <= SAMPLE).select(*by, "r", "x", "y")
        # Pairs of at most SAMPLE points, a stated bound, within one row.
        listed = few.groupBy(*by).agg(F.collect_list(F.struct("x", "y")).alias("p"))
        apart = F.expr(f"flatten(transform(p, (a, i) -> transform(slice(p, i + 2, {SAMPLE}), b -> sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2)))))")
        gap = listed.select(*by, F.explode(apart).alias("d")).groupBy(*by).agg(F.expr("percentile(d, 0.01)").alias("gap"))
        rows = unit.join(gap, list(by)) if by else unit.crossJoin(F.broadcast(gap))
    else:
        rows = unit.withColumn("gap", F.lit(float(spacing)))
    low = F.greatest(F.col("gap") * 2, F.lit(1e-3))
    low = F.when(low >= 0.5, F.lit(0.05)).otherwise(low)
    scale = F.pow(F.lit(10.0), F.log10(F.lit(0.5)) + F.col("j") * (F.log10("low") - F.log10(F.lit(0.5))) / (n_scales - 1))
    rows = rows.withColumn("low", low).withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(n_scales - 1)))).withColumn("scale", scale).withColumn("k", F.ceil(1 / F.col("scale"))).where("k between 2 and 1024")
    cell = lambda c: F.least(F.floor(F.col(c) * F.col("k")), F.col("k") - 1)
    cells = rows.select(*by, "j", "scale", "n", (cell("x") * F.col("k") + cell("y")).alias("cell")).distinct()
    return cells.groupBy(*by, "j", "scale", "n").agg(F.count("*").alias("boxes")).where("boxes > 1")


def box_dimension(points: DataFrame, by: Sequence[str] = (), n_scales: int = 30, spacing: float | None = None) -> DataFrame:
    """``[*by,] dimension, r2, scales``: slope of ln boxes on ln 1/scale over the scales that are not saturated.

    No row under 100 points, six scales, or four in the scaling regime.
    """
    counts = box_counts(points, by, n_scales, spacing)
    group = Window.partitionBy(*by)
    good = F.expr("boxes < 0.9 * n and boxes > 4").cast("int")
    rows = counts.withColumn("all", F.count("*").over(group)).withColumn("ok", good).withColumn("oks", F.sum("ok").over(group)).where("all >= 6")
    used = rows.where("case when oks >= 4 then ok = 1 else boxes < 0.95 * n end")
    fit = used.groupBy(*by).agg(F.expr("regr_slope(ln(boxes), ln(1 / scale))").alias("dimension"), F.coalesce(F.expr("regr_r2(ln(boxes), ln(1 / scale))"), F.lit(0.0)).alias("r2"), F.count("*").alias("scales"))
    return fit.where("scales >= 4")


def stream_dimension(lines: DataFrame, flat: DataFrame, by: Sequence[str] = (), spacing: float | None = None) -> DataFrame:
    """the dimension of a whole stream's points; no row under 100 words or with one type."""
    types = flat.groupBy(*by).agg(F.countDistinct("word").alias("types")).where("types >= 2")
    found = box_dimension(line_points(lines, flat, by, "corpus"), by, spacing=spacing)
    return (found.join(types, list(by)) if by else found.join(types, F.lit(True))).select(*found.columns)


def observed_dimension(lines: DataFrame, flat: DataFrame, spacing: float | None = None) -> DataFrame:
    """one row ``n_points, dimension, r2, scales, status`` with points by line; ``too few points`` under 100."""
    points = line_points(lines, flat)
    n = points.agg(F.count("*").alias("n_points"))
    out = n.join(box_dimension(points, spacing=spacing), F.lit(True), "left")  # single rows
    status = F.when(F.col("n_points") < 100, "too few points").when(F.col("dimension").isNull(), "too few scales").otherwise("ok")
    return out.withColumn("status", status)
