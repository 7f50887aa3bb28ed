"""Secret scans with multipart credential linking.

Strong findings are reported as they are: assigned secrets, access key identifiers, long hex
strings. Weak candidates (login or client names, mixed tokens, endpoints) are reported only when
complementary parts lie within the same scope, with at most ``SCOPE`` code points between them: a
name with a secret, a token with an identifier, an endpoint with both. Parts of any length link
to either side. This interval join is two windows over a document's parts by position, the
furthest end so far and the next start, so no pairs are made.

Spans are code points, end exclusive, of whole matches. Defined results: null text is empty;
repeated rows each get their row; texts with equal doc_id are scanned apart; other columns are
ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SCOPE = 200

#: Fixed by the contract: base patterns and shortest lengths.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")
MIN_ASSIGN, MIN_ACCESS = 12, 18

NAME = re.compile(r"""(?:user(?:name)?|login|account|client_?id)["']?\x20*[:=]\x20*["']?[A-Za-z0-9_.@-]{3,}""", re.I | re.A)
MIXED = re.compile(r"[A-Za-z0-9+/_=-]{24,}")
ENDPOINT = re.compile(r"""(?:https?|jdbc:[a-z]+|[a-z]+sql|mongodb|redis|amqps?|s3)://[^\s"'<>]+""")
KINDS = ("assign", "access", "hex", "weak_name", "weak_secret", "weak_endpoint")
_ASSIGN_KEYS = ("passw", "secret", "token", "apikey", "api_key")
_NAME_KEYS = ("user", "login", "account", "client")


def find_parts(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) of strong findings and of weak candidates."""
    low = text.lower()
    found = []
    if any(k in low for k in _ASSIGN_KEYS):
        found += [(0, m.start(), m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= MIN_ASSIGN]
    if "AKIA" in text:
        found += [(1, m.start(), m.end()) for m in ACCESS.finditer(text) if len(m[0]) >= MIN_ACCESS]
    found += [(2, m.start(), m.end()) for m in HEX.finditer(text)]
    names = [(3, m.start(), m.end()) for m in NAME.finditer(text)] if any(k in low for k in _NAME_KEYS) else []
    if names or any(f[0] == 1 for f in found):  # weak parts need an identifier somewhere
        strong = sorted((s, e) for _, s, e in found)
        weak = [m for m in MIXED.finditer(text) if re.search("[A-Z]", m[0]) and re.search("[a-z]", m[0]) and re.search("[0-9]", m[0])]
        at = 0
        for m in weak:
            while at < len(strong) and strong[at][1] <= m.start():
                at += 1
            if at == len(strong) or strong[at][0] >= m.end():
                found.append((4, m.start(), m.end()))
        if "://" in text:
            found += [(5, m.start(), m.end()) for m in ENDPOINT.finditer(text)]
    return found + names


def parts(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text, text_hash) -> doc_id, text_hash, kind, start, end; kind -1 for the row itself."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                b = batch.slice(at, 256)
                row, kind, start, end = [], [], [], []
                for i, text in enumerate(b.column(2).to_pylist()):
                    for k, s, e in [(-1, -1, -1), *find_parts(text or "")]:
                        row.append(i)
                        kind.append(k)
                        start.append(s)
                        end.append(e)
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).take(pa.array(row)), b.column(1).take(pa.array(row)), pa.array(kind, pa.int32()), pa.array(start, pa.int64()), pa.array(end, pa.int64())],
                    names=["doc_id", "text_hash", "kind", "start", "end"],
                )

    d = docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("text_hash"), "text")
    return d.mapInArrow(run, "doc_id long, text_hash long, kind int, start long, end long")


def link(found: DataFrame, scope: int = SCOPE) -> DataFrame:
    """Strong findings, and weak ones with their complementary parts within the scope."""
    own = Window.partitionBy("doc_id", "text_hash")
    before = own.orderBy("start").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    after = own.orderBy(F.col("start").desc()).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    known = F.col("kind")

    def near(*kinds: int):
        """A part of these kinds starts no later and ends within the scope, or starts no earlier and within it."""
        end = F.max(F.when(known.isin(*kinds), F.col("end"))).over(before)
        start = F.min(F.when(known.isin(*kinds), F.col("start"))).over(after)
        return F.coalesce(end >= F.col("start") - scope, F.lit(False)) | F.coalesce(start <= F.col("end") + scope, F.lit(False))

    f = found.withColumn("names", near(1, 3)).withColumn("secrets", near(0, 2, 4))
    need = F.when(known == 3, F.col("secrets")).when(known == 4, F.col("names"))
    need = need.when(known == 5, F.col("names") & F.col("secrets")).otherwise(True)
    return f.where(need).drop("names", "secrets")


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return scan_secrets(docs)


def scan_secrets(docs: DataFrame, scope: int = SCOPE) -> DataFrame:
    """docs (doc_id, text) -> doc_id, counts, base_sha256, spans: one row per row of docs."""
    f = link(parts(docs), scope)
    # A text that is repeated under one id was scanned once per row; its spans are the same.
    spans = F.array_sort(F.collect_set(F.when(F.col("kind") >= 0, F.struct("start", "kind", "end"))))
    g = f.groupBy("doc_id", "text_hash").agg(spans.alias("s"), F.count_if(F.col("kind") < 0).alias("copies"))

    def shown(array):
        name = F.array(*map(F.lit, KINDS))
        one = F.transform(array, lambda x: F.concat(F.get(name, x["kind"]), F.lit(":"), x["start"].cast("string"), F.lit(":"), x["end"].cast("string")))
        return F.array_join(one, ",")

    def number(kind: int):
        return F.size(F.filter("s", lambda x: x["kind"] == kind)).cast("long")

    g = g.select("*", F.explode(F.sequence(F.lit(1), "copies")).alias("copy"))
    return g.select(
        "doc_id", number(0).alias("n_assign"), number(1).alias("n_access"), number(2).alias("n_hex"),
        F.sha2(shown(F.filter("s", lambda x: x["kind"] < 3)), 256).alias("base_sha256"), shown(F.col("s")).alias("spans"),
    )
