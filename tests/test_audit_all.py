import glob
from pathlib import Path

from quirelab.plans import corpus as plans


def test_every_table_is_hashed(spark, data):
    rows = plans.QUERIES["source_hashes"](spark, data).collect()
    assert {r["name"] for r in rows} == {Path(p).stem for p in glob.glob(f"{data}/*.parquet")}
    assert all(r["status"] == "loaded" and len(r["sha256"]) == 64 and r["row_count"] > 0 for r in rows)
