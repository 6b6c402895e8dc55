"""Reading, parsing and writing the corpus tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quirelab.functions.keys import normalize_quire, strip
from quirelab.schema import COORDINATE, INTERVALS, SIGNATURE


def read_first(spark: SparkSession, parquet: str, json: str, schema: str | None = None) -> DataFrame:
    """Parquet if it is there, else JSON lines; FileNotFoundError if neither is."""
    from pyspark.errors import AnalysisException

    for kind, path in (("parquet", parquet), ("json", json)):
        try:
            reader = spark.read.schema(schema) if schema and kind == "json" else spark.read
            return reader.format(kind).load(path)
        except AnalysisException:
            continue
    raise FileNotFoundError(f"neither {parquet} nor {json}")


def white_words(text: Column) -> Column:
    """B2: words between white space; null or empty gives none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), r"(?U)\s+"), lambda w: w != "")


def dotted_words(tokens: str, first_only: bool = False) -> Column:
    """The parts of token strings between dots and commas; ``first_only`` takes the first string alone.

    Null arrays and null strings have no parts.
    """
    parts = lambda t: F.filter(F.split(F.coalesce(strip(t), F.lit("")), "[.,]"), lambda p: p != "")
    if first_only:
        return parts(F.get(tokens, F.lit(0)))
    return F.flatten(F.transform(F.coalesce(F.col(tokens), F.array().cast("array<string>")), parts))


def stream_words(tokens: str) -> Column:
    """The tokens as they stand."""
    return F.coalesce(F.col(tokens), F.array().cast("array<string>"))


def parse_lines(raw: DataFrame, *keep: str) -> DataFrame:
    """Raw transcription rows to line records, after the columns to keep; without a text_clean column, text is split.

    The folio is the page without a last r or v. Null texts have no tokens.
    """
    text = F.col("text_clean") if "text_clean" in raw.columns else F.col("text")
    page = F.coalesce("page_id", F.lit(""))
    return raw.select(
        *keep, page.alias("page"), F.regexp_replace(page, "[rv]$", "").alias("folio"), normalize_quire(F.col("quire")).alias("quire"), F.coalesce("line_number", F.lit(0)).alias("line_number"),
        white_words(text).alias("tokens"), F.coalesce("text", F.lit("")).alias("raw_text"), F.lit("unknown").alias("transcription_source"),
    )


def parse_metadata(pages: DataFrame | None, folios: DataFrame | None) -> DataFrame:
    """Page records from pages, or, without these, from folios, of which one per folio_id is kept."""
    if pages is not None:
        return pages.select("page_id", F.col("folio_id").alias("folio"), normalize_quire(F.col("quire_id")).alias("quire"), F.col("section_value").alias("section"), "illustration_type")
    if folios is None:
        raise ValueError("neither pages nor folios")
    one = folios.groupBy("folio_id").agg(F.max(F.struct("quire_id", "section_value")).alias("r"))
    return one.select(F.col("folio_id").alias("page_id"), F.col("folio_id").alias("folio"), normalize_quire(F.col("r.quire_id")).alias("quire"), F.col("r.section_value").alias("section"), F.lit(None).cast("string").alias("illustration_type"))


def parse_coordinates(spark: SparkSession, rows: DataFrame | list[dict] | dict | None) -> DataFrame:
    """Word coordinates; rows with fields that are no numbers are left out, missing fields are 0 or ''."""
    if rows is None:
        rows = []
    if isinstance(rows, dict):
        rows = [rows]
    names = [c.split()[0] for c in COORDINATE.split(", ")]
    if isinstance(rows, list):
        rows = spark.createDataFrame([tuple(None if r.get(n) is None else str(r[n]) for n in names) for r in rows if isinstance(r, dict)], COORDINATE)
    number = lambda c, kind: F.coalesce(F.col(c), F.lit("0")).try_cast(kind).alias(c)
    out = rows.select(F.coalesce("token_id", F.lit("")).alias("token_id"), F.coalesce("page", F.lit("")).alias("page"), number("line", "int"), *(number(c, "double") for c in ("x", "y", "width", "height")))
    return out.where("line is not null and x is not null and y is not null and width is not null and height is not null")


def join_records(lines: DataFrame, pages: DataFrame) -> DataFrame:
    """Every line with its page's section and illustration.

    ``lines``: ``page, folio, quire, ...``; ``pages``: ``page_id, folio, quire, section,
    illustration_type``. Null keys match null keys; several rows of a page repeat its lines.
    Folio and quire are the line's, or the page's where the line has null. The join is left to
    the optimiser, which broadcasts pages only as long as they are small.
    """
    side = pages.select("page_id", F.col("folio").alias("_folio"), F.col("quire").alias("_quire"), "section", "illustration_type")
    rows = lines.join(side, lines["page"].eqNullSafe(side["page_id"]), "left")
    keep = [F.coalesce(c, f"_{c}").alias(c) if c in ("folio", "quire") else F.col(c) for c in lines.columns]
    return rows.select(*keep, "page_id", "section", "illustration_type")


def distinct_pages(joined: DataFrame) -> DataFrame:
    """The page columns of a joined table, each combination once."""
    return joined.select("page_id", "folio", "quire", "section", "illustration_type").distinct()


def boundaries(corpus: DataFrame) -> DataFrame:
    """A10: ``line_no, n_words, end``: the running number of words up to and with each line."""
    from quirelab.operators.corpus import prefix

    sized = corpus.select("line_no", F.coalesce(F.size("words"), F.lit(0)).cast("long").alias("n_words"))
    return prefix(sized, [], "line_no", F.col("n_words"), "s").select("line_no", "n_words", (F.col("s") + F.col("n_words")).alias("end"))


def save_signature(signature: DataFrame, path: str) -> None:
    """``field, value`` as JSON lines with six decimals; nulls are kept."""
    signature.select("field", F.round("value", 6).alias("value")).coalesce(1).write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def load_signature(spark: SparkSession, path: str, compute=None) -> DataFrame:
    """A saved signature, or else the computed one, which is then saved."""
    from pyspark.errors import AnalysisException

    try:
        return spark.read.schema(SIGNATURE).json(path)
    except AnalysisException:
        if compute is None:
            raise
        save_signature(compute(), path)
        return spark.read.schema(SIGNATURE).json(path)


def save_intervals(intervals: DataFrame, path: str) -> None:
    """Tolerance intervals as JSON lines; nulls are kept."""
    intervals.select("field", "observed", "bootstrap_mean", "sd", "lower", "upper").coalesce(1).write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def load_intervals(spark: SparkSession, path: str) -> DataFrame:
    """Saved tolerance intervals."""
    return spark.read.schema(INTERVALS).json(path)


def save_folds(rows: DataFrame, path: str) -> None:
    """Rows with their fold, one folder per fold."""
    rows.write.mode("overwrite").partitionBy("fold").json(path)


def save_table(rows: DataFrame, path: str) -> None:
    """A table as JSON lines (one object a line, not one array)."""
    rows.write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def load_ledger(spark: SparkSession, path: str) -> DataFrame:
    """The hand-written hypothesis ledger: a JSON array."""
    return spark.read.option("multiLine", "true").json(path)
