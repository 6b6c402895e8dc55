"""Audit of sources: does each load, how many rows, which columns, which content hash."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Sequence
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quirelab.schema import SOURCE_STATUS


def payload_hash(payload: object) -> str:
    """A2 for a small object in memory: SHA-256 of its JSON with sorted keys."""
    return hashlib.sha256(json.dumps(payload, sort_keys=True, default=str).encode()).hexdigest()


def table_hash(df: DataFrame) -> str:
    """A2 for a table of any size: a hash of its rows that depends on neither their order nor that of the columns.

    Each row's SHA-256 is cut into 32-bit numbers, which are added up over the table (so repeated
    rows count), and the sums are hashed with the number of rows.
    """
    row = F.sha2(F.to_json(F.struct(*(F.col(f"`{c}`") for c in sorted(df.columns))), {"ignoreNullFields": "false"}), 256)
    parts = [F.sum(F.conv(F.substring("h", 8 * i + 1, 8), 16, 10).cast("decimal(38,0)")).alias(f"s{i}") for i in range(8)]
    sums = df.select(row.alias("h")).agg(F.count("*").alias("n"), *parts).first()
    return hashlib.sha256("|".join(str(x) for x in sums).encode()).hexdigest()


def source_status(name: str, load: Callable[[], DataFrame], kind: str = "table", place: str | None = None, config: str | None = None, hashed: bool = True) -> dict:
    """A1: try to load and count a source; any failure is reported in the row, never raised."""
    row = {"name": name, "source_type": kind, "repo_id": place, "config": config, "status": "failed", "row_count": 0, "schema": {}, "sha256": None, "error": None}
    try:
        df = load()
        row |= {"row_count": df.count(), "schema": dict(df.dtypes), "sha256": table_hash(df) if hashed else None, "status": "loaded"}
    except Exception as e:  # the status is the result
        row["error"] = str(e).splitlines()[0][:500] if str(e) else type(e).__name__
    return row


def first_that_loads(name: str, candidates: Sequence[tuple[str, Callable[[], DataFrame]]]) -> tuple[dict, DataFrame | None]:
    """A3: the first of several places that loads; ``unavailable`` with all their errors if none does."""
    errors = []
    for place, load in candidates:
        row = source_status(name, load, "fallback", place)
        if row["status"] == "loaded":
            return row, load()
        errors.append(f"{place}: {row['error']}")
    return row | {"status": "unavailable", "repo_id": None, "error": "; ".join(errors)} if candidates else {"name": name, "source_type": "fallback", "repo_id": None, "config": None, "status": "unavailable", "row_count": 0, "schema": {}, "sha256": None, "error": "no candidates"}, None


def fetch_json(url: str, timeout: int = 30) -> object | None:
    """A4: JSON from an address, None on any error. For small status documents on the driver."""
    from urllib.request import Request, urlopen

    try:
        with urlopen(Request(url, headers={"User-Agent": "quirelab"}), timeout=timeout) as r:
            return json.load(r)
    except Exception:
        return None


def status_table(spark: SparkSession, rows: Sequence[dict]) -> DataFrame:
    """Statuses as a table."""
    names = [c.split()[0] for c in SOURCE_STATUS.split(", ")]
    return spark.createDataFrame([tuple(r.get(n) for n in names) for r in rows], SOURCE_STATUS)


def write_manifest(statuses: DataFrame, path: str) -> None:
    """A5: statuses with the time, as JSON lines; nulls are kept."""
    statuses.withColumn("generated_at", F.lit(datetime.now(UTC).isoformat())).write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def run_audit(spark: SparkSession, places: dict[str, str], hashed: bool = True) -> DataFrame:
    """The status of every named Parquet table."""
    return status_table(spark, [source_status(n, lambda p=p: spark.read.parquet(p), "parquet", p, None, hashed) for n, p in places.items()])
