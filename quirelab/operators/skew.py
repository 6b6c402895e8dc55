"""Hot keys: finding them with a mergeable sketch, and joining past them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Counters in the sketch. A key with a share above about 3 / SKETCH of the rows is always seen.
SKETCH = 4096


def hot_keys(df: DataFrame, key: Column, share: float = 0.01) -> dict:
    """Keys that hold at least ``share`` of the rows, with their estimated share.

    One pass, aggregated on the map side into a frequent-items sketch of fixed size; at most
    1 / share keys come back. The answer only steers where rows go, never what comes out.
    """
    k = max(1, int(1 / share))
    keyed = df.select(key.alias("k")).where("k is not null")
    row = keyed.agg(F.expr(f"approx_top_k(k, {k}, {max(SKETCH, 4 * k)})").alias("top"), F.count("*").alias("n")).first()
    return {r["item"]: r["count"] / row["n"] for r in row["top"] or [] if row["n"] and r["count"] >= share * row["n"]}


def salted_join(left: DataFrame, right: DataFrame, key: str, spread: Column, how: str = "inner", hot: dict | None = None, target: float = 0.01) -> DataFrame:
    """Equi-join on ``key`` whose hot keys are cut into several tasks.

    A left row of a hot key goes to one of ceil(share / target) salts, chosen by ``spread``; the
    right rows of such a key are repeated once per salt. Other rows keep salt 0. ``right`` must
    hold few rows per key (a dimension). ``how``: inner or left.
    """
    hot = hot_keys(left, F.col(key), target) if hot is None else hot
    if not hot:
        return left.join(right, key, how)
    n = F.create_map(*(F.lit(x) for k, s in hot.items() for x in (k, int(s / target) + 2)))
    salts = F.coalesce(F.try_element_at(n, F.col(key)), F.lit(1))
    salted = left.withColumn("_salt", F.pmod(F.xxhash64(spread), salts).cast("int"))
    repeated = right.withColumn("_salt", F.explode(F.sequence(F.lit(0), (salts - 1).cast("int"))))
    return salted.join(repeated, [key, "_salt"], how).drop("_salt")
