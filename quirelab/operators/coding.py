"""LZ77 and Huffman coding of symbol sequences."""

from __future__ import annotations

import heapq
from collections import deque
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quirelab.session import cut

#: Types for which single codes are made on the driver; ratios have no such bound.
MOST_CODES = 1_000_000


def longest_matches(seq: Sequence, window: int, min_match: int, overlap: bool) -> Iterator[tuple[int, int, int]]:
    """Greedy LZ77 parse ``(i, offset, length)``; a literal has offset and length 0.

    Candidates come from chains of equal ``min_match``-grams inside the window, the earliest
    first, so of equally long matches the one with the largest offset is taken. With ``overlap``
    a match may run into itself; without, it ends before the cursor, one symbol short of it.
    """
    n = len(seq)
    chains: dict[tuple, deque[int]] = {}
    added = gone = 0
    i = 0
    while i < n:
        while added < i and added + min_match <= n:
            chains.setdefault(tuple(seq[added : added + min_match]), deque()).append(added)
            added += 1
        # What has left the window leaves the chains too, so they hold a window's worth at any length.
        while gone < min(i - window, added):
            key = tuple(seq[gone : gone + min_match])
            chains[key].popleft()
            if not chains[key]:
                del chains[key]
            gone += 1
        best, where = 0, 0
        key = tuple(seq[i : i + min_match])
        for j in chains.get(key, ()) if len(key) == min_match else ():
            room = n - i if overlap else min(n - i, i - 1 - j)
            if room <= best:
                if overlap:
                    break
                continue
            length = min_match if room >= min_match else 0
            while length and length < room and seq[j + length] == seq[i + length]:
                length += 1
            if length > best:
                best, where = length, j
                if best == n - i:
                    break
        if best >= min_match:
            yield i, i - where, best
            i += best
        else:
            yield i, 0, 0
            i += 1


def signature_cost(seq: Sequence, window: int = 4096, min_match: int = 3) -> float | None:
    """S8 of one sequence: a match costs 2, a literal 1, per symbol. None if empty."""
    if not len(seq):
        return None
    return sum(2 if length else 1 for _, _, length in longest_matches(seq, window, min_match, True)) / len(seq)


def triples(seq: Sequence, window: int = 1024, min_match: int = 3) -> list[tuple[int, int, object]]:
    """``(offset, length, next_symbol)`` of the parse without overlap; a match has no next symbol."""
    return [(o, k, None if k else seq[i]) for i, o, k in longest_matches(seq, window, min_match, False)]


def restore(code: Sequence[tuple[int, int, object]]) -> list:
    """The sequence behind triples."""
    out: list = []
    for offset, length, symbol in code:
        if length:
            start = len(out) - offset
            for k in range(length):
                out.append(out[start + k])
        else:
            out.append(symbol)
    return out


def _grouped(df: DataFrame, by: Sequence[str]):
    """Group by keys that are there; without any, the stream is one group."""
    return df.groupBy(*by) if by else df.withColumn("_all", F.lit(0)).groupBy("_all")


def _keys(schema_of: DataFrame, by: Sequence[str]) -> str:
    return "".join(f"{c} {schema_of.schema[c].dataType.simpleString()}, " for c in by)


def lz77_signature(flat: DataFrame, by: Sequence[str] = (), window: int = 4096, min_match: int = 3) -> DataFrame:
    """S8 per stream: ``[*by,] lz77_ratio``. A greedy parse is sequential, so a stream is one task's
    work, on 8 bytes a word; streams run beside each other."""
    coded = flat.select(*by, "pos", F.xxhash64("word").alias("x"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        x = pdf.sort_values("pos")["x"]
        ids = np.unique(x.to_numpy(), return_inverse=True)[1].tolist()
        out = pdf.iloc[:1][list(by)].copy()
        out["lz77_ratio"] = signature_cost(ids, window, min_match)
        return out

    return _grouped(coded, by).applyInPandas(run, _keys(flat, by) + "lz77_ratio double")


def lz77_encode(symbols: DataFrame, by: Sequence[str] = (), window: int = 1024, min_match: int = 3) -> DataFrame:
    """E1 for ``[*by,] i, sym``: ``[*by,] i, offset, length, next_symbol``, ``i`` numbering the triples. Null symbols are symbols."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        seq = [None if s is None or s is pd.NA or s != s else s for s in pdf.sort_values("i")["sym"].tolist()]
        code = triples(seq, window, min_match)
        out = pd.DataFrame({c: [pdf[c].iloc[0]] * len(code) for c in by} | {"i": range(len(code))})
        return out.assign(offset=[c[0] for c in code], length=[c[1] for c in code], next_symbol=[c[2] for c in code])

    return _grouped(symbols, by).applyInPandas(run, _keys(symbols, by) + "i long, offset int, length int, next_symbol string")


def lz77_decode(code: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Triples back to ``[*by,] i, sym``."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = pdf.sort_values("i")
        seq = restore(list(zip(rows["offset"].tolist(), rows["length"].tolist(), rows["next_symbol"].tolist())))
        return pd.DataFrame({c: [pdf[c].iloc[0]] * len(seq) for c in by} | {"i": range(len(seq)), "sym": seq})

    return _grouped(code, by).applyInPandas(run, _keys(code, by) + "i long, sym string")


def lz77_ratio(symbols: DataFrame, by: Sequence[str] = (), window: int = 1024) -> DataFrame:
    """Three units per triple over the length: ``[*by,] lz77_ratio``; 0 for an empty sequence without keys."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        x = pdf.sort_values("i")["sym"]
        ids = pd.factorize(x, use_na_sentinel=False)[0].tolist()
        out = pdf.iloc[:1][list(by)].copy()
        out["lz77_ratio"] = 3 * sum(1 for _ in longest_matches(ids, window, 3, False)) / max(len(ids), 1)
        return out

    got = _grouped(symbols, by).applyInPandas(run, _keys(symbols, by) + "lz77_ratio double")
    return got if by else got.agg(F.coalesce(F.max("lz77_ratio"), F.lit(0.0)).alias("lz77_ratio"))


def huffman_bits(classes: list[tuple[int, int]]) -> int:
    """Total bits of an optimal code for ``(count, number of types with it)``; types merge in bulk."""
    heap = [(c, m) for c, m in classes if c > 0 and m > 0]
    heapq.heapify(heap)
    bits = 0
    while heap:
        w, m = heapq.heappop(heap)
        while heap and heap[0][0] == w:
            m += heapq.heappop(heap)[1]
        if m > 1:
            bits += 2 * w * (m // 2)
            heapq.heappush(heap, (2 * w, m // 2))
        if m % 2:
            if not heap:
                break
            w2, m2 = heapq.heappop(heap)
            bits += w + w2
            heapq.heappush(heap, (w + w2, 1))
            if m2 > 1:
                heapq.heappush(heap, (w2, m2 - 1))
    return bits


def huffman_ratio(symbols: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Bits of an optimal code over 8 bits a symbol: ``[*by,] huffman_ratio``; 0 if empty or of one type.

    The total depends on how many types have each count, a table of at most about the root of
    twice the length, which is all that reaches one task per key.
    """
    counts = symbols.groupBy(*by, "sym").agg(F.count("*").alias("c"))
    classes = counts.groupBy(*by, "c").agg(F.count("*").alias("m"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        out = pdf.iloc[:1][list(by)].copy()
        out["huffman_ratio"] = huffman_bits(list(zip(pdf["c"].tolist(), pdf["m"].tolist()))) / (8 * int((pdf["c"] * pdf["m"]).sum()))
        return out

    got = _grouped(classes, by).applyInPandas(run, _keys(symbols, by) + "huffman_ratio double")
    return got if by else got.agg(F.coalesce(F.max("huffman_ratio"), F.lit(0.0)).alias("huffman_ratio"))


def code_book(counts: dict[str, int]) -> dict[str, str]:
    """E5: a prefix code for a frequency table; one type gets the empty code, none gives none."""
    if not counts:
        return {}
    heap: list[tuple[int, int, object]] = [(c, i, s) for i, (s, c) in enumerate(sorted(counts.items(), key=lambda x: (x[1], str(x[0]))))]
    heapq.heapify(heap)
    tick = len(heap)
    while len(heap) > 1:
        a, b = heapq.heappop(heap), heapq.heappop(heap)
        heapq.heappush(heap, (a[0] + b[0], tick, [a[2], b[2]]))
        tick += 1
    codes: dict[str, str] = {}
    stack: list[tuple[object, str]] = [(heap[0][2], "")]
    while stack:
        node, code = stack.pop()
        if isinstance(node, list):
            stack += [(node[0], code + "0"), (node[1], code + "1")]
        else:
            codes[node] = code
    return codes


def huffman_codes(symbols: DataFrame) -> DataFrame:
    """E5: ``sym, c, code`` for a sequence of at most MOST_CODES types (more raise; their ratio needs no codes)."""
    counts = symbols.where("sym is not null").groupBy("sym").agg(F.count("*").alias("c"))
    if counts.count() > MOST_CODES:
        raise ValueError(f"more than {MOST_CODES} types; huffman_ratio works without codes")
    rows = {r["sym"]: r["c"] for r in counts.collect()}
    codes = code_book(rows)
    return symbols.sparkSession.createDataFrame([(s, rows[s], codes[s]) for s in rows], "sym string, c long, code string")


def compression_profile(lines: DataFrame, flat: DataFrame, by: Sequence[str]) -> DataFrame:
    """``[*by,] lz77_w64, lz77_w256, lz77_w1024, huffman, lz77_line``; zeros under 100 words.

    The first four are over the words (``flat`` is their stream; they are read from the lines); the last is
    over whole lines, each as one symbol, in the order of the corpus; lines without words are left out, and
    lines go by 64-bit hashes of their text. The corpora are written once, and each of the few values of
    ``by`` is one task: no stream is exchanged.
    """
    from quirelab.operators import coded  # it builds upon this module

    spark = lines.sparkSession
    hashed = F.when(F.size("words") > 0, F.xxhash64(F.array_join("words", ""))).alias("h")
    written = cut(lines.select(*by, "line_no", "grp", "words", hashed))
    keys = [r.asDict() for r in written.select(*by).distinct().collect()]
    schema = "_key int, " + ", ".join(f"{c} double" for c in coded.PROFILE)
    path = written.inputFiles()[0].rsplit("/", 1)[0] if keys else ""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in batch.column(0).to_pylist():
                found = coded.profile_of(path, keys[i])
                yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), *(pa.array([found[c]], pa.float64()) for c in coded.PROFILE)], ["_key", *coded.PROFILE])

    made = spark.range(0, len(keys), 1, max(len(keys), 1)).mapInArrow(run, schema)
    names = spark.createDataFrame([(i, *k.values()) for i, k in enumerate(keys)], f"_key int, {_keys(lines, by)}".rstrip(", "))
    return made.join(names, "_key").select(*by, *coded.PROFILE)


def control_corpus(df: DataFrame, name: str, text: Column, length: int, chunk: int = 8) -> DataFrame:
    """Control corpora ``name, line_no, grp, words``: each text without blanks, its characters repeated
    to ``length`` and cut into lines of ``chunk`` characters as words. A text without characters gives none."""
    bare = df.select(F.col(name).alias("name"), F.regexp_replace(text, " ", "").alias("t")).where("t <> ''")
    rows = df.sparkSession.range((length + chunk - 1) // chunk).withColumnRenamed("id", "line_no").crossJoin(F.broadcast(bare))  # a few sample texts
    chars = F.expr(f"transform(sequence(line_no * {chunk}, least((line_no + 1) * {chunk}, {length}) - 1), i -> substring(t, cast(i % char_length(t) as int) + 1, 1))")
    return rows.select("name", F.col("line_no").cast("long").alias("line_no"), F.lit("control").alias("grp"), chars.alias("words"))
