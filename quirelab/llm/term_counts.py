"""Frequency of every distinct term, kept up to date by signed deltas.

A change of the collection is a table of record images: what a record held before (sign -1) and
what it holds now (sign +1). Only these are turned into changes of occurrence and record counts
per term, which are merged into a written table of counts, partitioned by a hash of the term.
Buckets no delta touches keep their files.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quirelab.session import drop_path, path_exists, scratch_path


def images(before: DataFrame | None, after: DataFrame | None) -> DataFrame:
    """Record images ``record_id, words, sign`` of a change; each side ``record_id, words``, one row per record."""
    sides = [df.select("record_id", "words", F.lit(s).alias("sign")) for df, s in ((before, -1), (after, 1)) if df is not None]
    return reduce(DataFrame.unionByName, sides)


def changed(old: DataFrame, new: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Before and after images of the records that were added, changed or deleted between two states.

    Both states: ``record_id, words``, one row per record. A record whose words are the same in
    both has no image.
    """
    mark = lambda df, n: df.select("record_id", F.col("words").alias(n), F.lit(True).alias(f"in_{n}"))
    both = mark(old, "a").join(mark(new, "b"), "record_id", "full").where("not (in_a <=> true and in_b <=> true and a <=> b)")
    return both.where("in_a").select("record_id", F.col("a").alias("words")), both.where("in_b").select("record_id", F.col("b").alias("words"))


def term_deltas(change: DataFrame) -> DataFrame:
    """Signed changes ``term, occurrences, records``; the null term counts the records themselves.

    A record's words are first counted within the record, where its row already is, then summed
    per term with map-side aggregation, so a term that is everywhere does not gather anywhere.
    Null words inside a record are no terms; a record with null words counts as one without words.
    """
    words = F.array_compact(F.coalesce("words", F.array().cast("array<string>")))
    runs = change.select(F.col("sign"), F.explode(F.concat(F.array(F.lit(None).cast("string")), F.array_sort(words))).alias("term"), F.col("record_id"))
    within = runs.groupBy("record_id", "sign", "term").agg(F.count("*").alias("tf"))
    sums = within.groupBy("term").agg(F.sum(F.col("tf") * F.col("sign")).alias("occurrences"), F.sum("sign").cast("long").alias("records"))
    return sums.where("occurrences <> 0 or records <> 0")


class TermCounts:
    """The persistent counts. Every call of :meth:`apply` writes a new version of the buckets it touches.

    A version is written to a folder of its own attempt and counts once the manifest names it, so a
    failure on the way leaves the last version as it was, and the change can be applied again. One
    writer at a time. :meth:`vacuum` removes what the manifest no longer names.
    """

    def __init__(self, spark: SparkSession, path: str | None = None, buckets: int | None = None):
        self.spark = spark
        self.path = path or scratch_path(spark, "term-counts")
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.version = 0
        self.place: dict[int, str] = {}  # bucket -> folder that holds it
        if path and path_exists(spark, f"{path}/manifest"):
            self._read_manifest()

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64("term"), F.lit(self.buckets)).cast("int").alias("bucket")

    def _write(self, rows: DataFrame, what: str) -> str:
        """Write ``term, occurrences, records`` with one folder and one task per bucket; the name of the attempt's folder."""
        name = f"{what}-{uuid.uuid4().hex[:12]}"
        rows.select("term", "occurrences", "records", self._bucket()).repartition(min(self.buckets, 4096), "bucket").write.partitionBy("bucket").parquet(f"{self.path}/{name}")
        return name

    def _read(self, name: str) -> DataFrame:
        return self.spark.read.schema("term string, occurrences long, records long, bucket int").parquet(f"{self.path}/{name}")

    def _read_manifest(self) -> None:
        # A manifest that was not finished has no _SUCCESS mark; the greatest finished version holds.
        files = self.spark.read.schema("version int, buckets int, bucket int, place string").json(f"{self.path}/manifest/*")
        done = [r[0] for r in files.select("version").distinct().collect() if path_exists(self.spark, f"{self.path}/manifest/{r[0]:08d}/_SUCCESS")]
        if done:
            last = files.where(F.col("version") == max(done)).collect()  # at most one row per bucket
            self.version, self.buckets = last[0]["version"], last[0]["buckets"]
            self.place = {r["bucket"]: r["place"] for r in last if r["bucket"] is not None}

    def _publish(self, version: int, place: dict[int, str]) -> None:
        rows = [(version, self.buckets, b, v) for b, v in sorted(place.items())] or [(version, self.buckets, None, None)]
        frame = self.spark.createDataFrame(rows, "version int, buckets int, bucket int, place string")
        frame.coalesce(1).write.mode("overwrite").json(f"{self.path}/manifest/{version:08d}")
        self.version, self.place = version, place

    def apply(self, change: DataFrame) -> TermCounts:
        """Merge a change (from :func:`images`) into the counts."""
        version = self.version + 1
        name = self._write(term_deltas(change), f"v{version}")
        deltas = self._read(name)
        touched = [r[0] for r in deltas.select("bucket").distinct().collect()]  # at most `buckets` numbers
        merged = name
        if self.place:
            old = self.counts([b for b in touched if b in self.place], whole=True)
            sums = old.unionByName(deltas.select("term", "occurrences", "records")).groupBy("term").agg(F.sum("occurrences").alias("occurrences"), F.sum("records").alias("records"))
            merged = self._write(sums.where("occurrences <> 0 or records <> 0"), f"v{version}")
        self._publish(version, self.place | {b: merged for b in touched})
        if merged != name:
            drop_path(self.spark, f"{self.path}/{name}")
        return self

    def vacuum(self) -> None:
        """Remove versions that no bucket is in, and attempts that failed; tables read before are then gone."""
        jvm = self.spark.sparkContext._jvm
        root = jvm.org.apache.hadoop.fs.Path(self.path)
        fs = root.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        for status in fs.listStatus(root):
            name = status.getPath().getName()
            if name.startswith("v") and name not in set(self.place.values()):
                fs.delete(status.getPath(), True)

    def counts(self, buckets: list[int] | None = None, whole: bool = False) -> DataFrame:
        """``term, occurrences, records`` of all (or some) buckets; ``whole`` keeps the null term."""
        wanted = self.place if buckets is None else {b: self.place[b] for b in buckets}
        by_version: dict[str, list[int]] = {}
        for b, v in wanted.items():
            by_version.setdefault(v, []).append(b)
        parts = [self._read(v).where(F.col("bucket").isin(bs)) for v, bs in by_version.items()]
        out = reduce(DataFrame.unionByName, parts) if parts else self.spark.createDataFrame([], "term string, occurrences long, records long, bucket int")
        return out.where("true" if whole else "term is not null").select("term", "occurrences", "records")

    def total(self) -> int:
        """Number of records in the collection."""
        row = self.counts(whole=True).where("term is null").agg(F.sum("records")).first()
        return row[0] or 0

    def marked(self, min_records: int = 3, max_share: float = 0.05) -> DataFrame:
        """``term, occurrences, records, mark``: ``rare`` below ``min_records``, ``common`` above ``max_share`` of all records, else null. Rare goes before common."""
        bound = F.lit(self.total() * max_share)
        mark = F.when(F.col("records") < min_records, "rare").when(F.col("records") > bound, "common")
        return self.counts().withColumn("mark", mark)
