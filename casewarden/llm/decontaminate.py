"""Benchmark decontamination with a broadcast hash set of normalised test n-grams.

Training token windows are scanned: the 64-bit hash of every window of words is looked up in the
broadcast set of the benchmark's window hashes, within the task that reads the document. Only
windows that hit leave it. They are then verified in full, as text: their documents are read again, and
their windows joined with the benchmark's. Hit word ranges are united per document.

A set of up to ``MAX_BROADCAST_BYTES`` is broadcast (16 bytes a hash), one beyond that is joined in a
shuffle of the windows' hashes; nothing else changes. The benchmark's windows as text likewise.

Hashes are taken of upper-cased words. Upper-casing works character by character and maps A-Z
and a-z together, so words that are equal after lower-casing A-Z always meet; the verification
compares words with only A-Z lower-cased.

Defined results: null or empty texts have no words; an item of fewer than ``window`` words, but
not none, is one window; an empty benchmark hits nothing, an empty table gives no rows; repeated rows
each get their row; very long texts are scanned whole; other columns are ignored. Rows with equal
doc_id and different texts are scanned apart.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from casewarden.storage import written

#: Fixed by the contract: what separates words.
NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: The same in upper-cased text, where letters are A-Z.
NOT_UPPER_WORD = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WINDOW = 10
MAX_BROADCAST_BYTES = 64 << 20


def words(text: Column) -> Column:
    return F.array_remove(F.split(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), NOT_WORD), "")


def _hash_words(text: Column) -> Column:
    return F.array_remove(F.split(F.upper(F.coalesce(text, F.lit(""))), NOT_UPPER_WORD), "")


def _window_hash(hashes: str, length: int) -> str:
    return "xxhash64(" + ", ".join(f"get({hashes}, i + {k})" for k in range(length)) + ")"


def _windows(hashes: str, length: int) -> Column:
    """Start, length and hash of all windows of so many words."""
    rows = f"if(size({hashes}) >= {length}, sequence(0, size({hashes}) - {length}), array())"
    return F.expr(f"transform({rows}, i -> struct(int(i) AS start, {length} AS len, {_window_hash(hashes, length)} AS hash))")


def _window_text(word_array: str) -> Column:
    return F.expr(
        f"transform(found, c -> struct(c.start AS start, c.len AS len, "
        f"array_join(transform(sequence(0, c.len - 1), k -> get({word_array}, c.start + k)), ' ') AS gram))"
    )


def benchmark_windows(benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """benchmark (item_id, text) -> gram, len, gram_hash, items: one row per distinct window."""
    b = benchmark.select("item_id", words(F.col("text")).alias("w"), _hash_words(F.col("text")).alias("u"))
    b = b.where(F.size("w") > 0).withColumn("len", F.least(F.size("w"), F.lit(window)))
    b = b.select("item_id", "len", "w", F.transform("u", lambda x: F.xxhash64(x)).alias("h"))
    each = F.expr(
        "transform(sequence(0, size(w) - len), i -> struct("
        "array_join(transform(sequence(0, len - 1), k -> get(w, i + k)), ' ') AS gram, i AS i))"
    )
    by_len = reduce(
        lambda rest, n: F.when(F.col("len") == n, F.expr(_window_hash("h", n))).otherwise(rest),
        range(1, window + 1),
        F.lit(None).cast("long"),
    )
    g = b.select("item_id", "len", "h", F.explode(each).alias("g")).select(
        "item_id", "len", F.col("g.gram").alias("gram"), F.col("g.i").alias("i"), "h"
    )
    g = g.select("item_id", "len", "gram", by_len.alias("gram_hash"))
    return g.groupBy("gram", "len", "gram_hash").agg(F.collect_set(F.col("item_id").cast("string")).alias("items"))


def scan(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, most: int = MAX_BROADCAST_BYTES) -> DataFrame:
    """docs (doc_id, text), benchmark (item_id, text) ->
    doc_id, text_hash, n_words, n_hit, items (sorted item ids), one row per document row."""
    grams = written(benchmark_windows(benchmark, window), "grams")
    seen = grams.groupBy("len").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("gram") + 16 * F.size("items") + 16).alias("bytes")
    ).collect()
    lengths, n = sorted(r["len"] for r in seen), sum(r["n"] for r in seen)
    known, table = grams.select(F.col("gram_hash").alias("hash"), F.lit(True).alias("known")).distinct(), grams.select("gram", "items")
    if 16 * n <= most:
        known = F.broadcast(known)
    if sum(r["bytes"] for r in seen) <= most:
        table = F.broadcast(table)

    # Windows whose hash is known, and one row of start -1 for the document itself.
    d = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), _hash_words(F.col("text")).alias("u"))
    d = d.select("doc_id", "text_hash", F.size("u").cast("long").alias("n_words"), F.transform("u", lambda x: F.xxhash64(x)).alias("h"))
    own = F.expr("array(struct(-1 AS start, 0 AS len, cast(null AS bigint) AS hash))")
    d = d.select("doc_id", "text_hash", "n_words", F.explode(F.concat(own, *[_windows("h", x) for x in lengths])).alias("c"))
    d = d.select("doc_id", "text_hash", "n_words", "c.start", "c.len", "c.hash").join(known, "hash", "left")
    found = written(d.where("start < 0 OR known").select("doc_id", "text_hash", "n_words", "start", "len"), "windows")

    some = found.where("start >= 0").groupBy("doc_id", "text_hash").agg(F.collect_set(F.struct("start", "len")).alias("found"))
    some = some.select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash"), "found")
    texts = docs.select("doc_id", "text", F.xxhash64("text").alias("text_hash"))
    texts = texts.join(some, texts["doc_id"].eqNullSafe(some["_id"]) & (texts["text_hash"] == some["_hash"]))
    texts = texts.select("doc_id", "text_hash", "found", words(F.col("text")).alias("w"))
    hits = texts.select("doc_id", "text_hash", F.explode(_window_text("w")).alias("c")).select("doc_id", "text_hash", "c.start", "c.len", "c.gram").join(table, "gram")
    rows = found.where("start < 0").select("doc_id", "text_hash", "n_words", "start", "len", F.lit(None).cast("array<string>").alias("items"))
    hits = rows.unionByName(hits.select("doc_id", "text_hash", F.lit(None).cast("long").alias("n_words"), "start", "len", "items"))

    doc = Window.partitionBy("doc_id", "text_hash")
    before = doc.orderBy("start", "len").rowsBetween(Window.unboundedPreceding, -1)
    end = F.col("start") + F.col("len")
    reach = F.greatest(F.coalesce(F.max(end).over(before), F.lit(0)), F.lit(0))
    hits = hits.withColumn("covered", F.greatest(end - F.greatest(F.col("start"), reach), F.lit(0)))
    out = hits.groupBy("doc_id", "text_hash").agg(
        F.max("n_words").alias("n_words"),
        F.sum("covered").cast("long").alias("n_hit"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"),
        F.count_if(F.col("len") == 0).alias("copies"),
    )
    # Repeated rows of a document were scanned as one; each gets its row again.
    return out.select("doc_id", "text_hash", "n_words", "n_hit", "items", F.explode(F.sequence(F.lit(1), "copies")).alias("copy")).drop("copy")


def clean(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """Documents without any hit, all columns; rows with null doc_id are judged like others."""
    bad = scan(docs, benchmark, window).where("n_hit > 0").select(F.col("doc_id").alias("_bad_id"), F.col("text_hash").alias("_bad_hash")).distinct()
    same = docs["doc_id"].eqNullSafe(bad["_bad_id"]) & (F.xxhash64(docs["text"]) == bad["_bad_hash"])
    return docs.join(bad, same, "left_anti")


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    bench = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text")
    return scan(docs, bench).select(
        "doc_id", "n_words", "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


OP7_SQL = r"""
WITH dw AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), bw AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), bg AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[i + 1 : i + least(len(w), 10)], ' ') AS gram
  FROM bw, unnest(range(0, len(w) - least(len(w), 10) + 1)) AS u(i) WHERE len(w) > 0
), dg AS (
  SELECT r, n, i, array_to_string(w[i + 1 : i + n], ' ') AS gram
  FROM dw, (SELECT DISTINCT n FROM bg) AS l, unnest(range(0, len(w) - n + 1)) AS u(i)
), hit AS (SELECT dg.r, dg.i, dg.n, item_id FROM dg JOIN bg ON dg.gram = bg.gram AND dg.n = bg.n),
cover AS (SELECT r, count(DISTINCT p) AS n_hit FROM hit, unnest(range(i, i + n)) AS u(p) GROUP BY r),
item AS (
  SELECT r, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS items
  FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS s FROM hit) GROUP BY r
)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM dw LEFT JOIN cover USING (r) LEFT JOIN item USING (r)
"""
