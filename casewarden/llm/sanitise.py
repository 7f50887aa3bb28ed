"""Personal data: fixed patterns, and information-theoretic sanitisation of the terms that reveal them.

Protected entities are the values the base patterns find (addresses, card and phone numbers, each
normalised). A term discloses entity c by the share of c's information content that it gives
away: pointwise mutual information of the two over IC(c) = -log p(c), with p from document counts
of the whole corpus and co-occurrence within ``NEAR`` terms of the entity. The share is 1 if the
term stands nowhere but beside c. Terms at ``GENERALISE`` or more are replaced by their class,
terms at ``REMOVE`` or more are taken out, in every document. A pair counts only if it was seen with
``SUPPORT`` different surroundings on either side, so that copies of one passage prove nothing.

Three passes over the texts: entities with their surroundings; document counts of the terms
beside entities; places of the terms that disclose. The last two look words up in a bitmap of
2**24 bits (2 MB, whatever the number of terms) and join what passes on the term itself.

Spans are code points, end exclusive. Patterns are matched in time linear in the text. Defined
results: null and empty texts have no spans; each row gets its row, also repeated rows and null
ids; texts with equal doc_id are judged apart; (doc_id, text) pairs that are repeated count
as one document; a term inside a base span is no term; an empty table gives no rows; other columns
are ignored.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from casewarden.llm.textvec import pieces, string_buffers, word_spans
from casewarden.storage import written

NEAR, SUPPORT = 8, 3
GENERALISE, REMOVE = 0.9, 0.98
BITS = 24
#: Terms that may be broadcast; more are joined in a shuffle.
FEW = 100_000
KINDS = ("email", "ip", "card", "phone", "generalise", "remove")
BASE = 4

#: Fixed by the contract: base patterns, here with possessive or guarded repeats that match the same.
LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9]){11,}+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
_UPPER = {c: c + 32 for c in range(65, 91)}


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Each ``@`` belongs to the local part right before it, which starts after the last match."""
    free, at = 0, text.find("@")
    while at >= 0:
        before = text[free:at]
        start = len(before.rstrip(LOCAL)) + free
        domain = DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            yield start, domain.end()
        free = domain.end() if domain else at + 1
        at = text.find("@", free)


def luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2]))
    return (total + sum(d * 2 - 9 * (d > 4) for d in map(int, digits[-2::-2]))) % 10 == 0


def find_base(text: str) -> list[tuple[int, int, int, str]]:
    """(kind, start, end, normalised value) of the base spans, by kind."""
    found = []
    if "@" in text:
        found += [(0, s, e, text[s:e].translate(_UPPER)) for s, e in emails(text)]
    for m in IP.finditer(text):
        parts = [p.lstrip("0") or "0" for p in m[0].split(".")]
        if all(len(p) < 4 and int(p) < 256 for p in parts):
            found.append((1, m.start(), m.end(), ".".join(parts)))
    for m in CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if len(digits) <= 19 and luhn(digits):
            found.append((2, m.start(), m.end(), digits))
    if "+" in text:
        for m in PHONE.finditer(text):
            digits = re.sub("[^0-9]", "", m[0])
            if 9 <= len(digits) <= 15:
                found.append((3, m.start(), m.end(), digits))
    return found


def outside(found: list[tuple[int, int, int, str]]) -> Callable[[int, int], bool]:
    """Does a span keep clear of all base spans?"""
    covered, reach = [], -1
    for s, e in sorted((f[1], f[2]) for f in found):
        if s <= reach:
            covered[-1][1] = reach = max(reach, e)
        else:
            covered.append([s, reach := e])
    starts, ends = [c[0] for c in covered], [c[1] for c in covered]

    def free(start: int, end: int) -> bool:
        i = bisect_left(starts, end) - 1
        return i < 0 or ends[i] <= start

    return free


def surroundings(text: str, found: list[tuple[int, int, int, str]], near: int) -> list[tuple[list[str], list[str]]]:
    """Terms before and after each base span; terms that touch any base span are left out."""
    free = outside(found)
    terms = [m.span() for m in TERM.finditer(text) if free(*m.span())]
    first, last = [t[0] for t in terms], [t[1] for t in terms]
    word = lambda t: text[t[0] : t[1]].translate(_UPPER)
    out = []
    for _, s, e, _ in found:
        left, right = bisect_right(last, s), bisect_left(first, e)
        out.append(([word(t) for t in terms[max(0, left - near) : left]], [word(t) for t in terms[right : right + near]]))
    return out


def entities(docs: DataFrame, near: int = NEAR) -> DataFrame:
    """docs (doc_id, text, text_hash) -> one row of kind -1 per row, and one per base span: entity, hashes of
    the terms before and after, and those terms."""
    names = ["doc_id", "text_hash", "kind", "start", "end", "entity", "before", "after", "terms"]
    schema = "doc_id long, text_hash long, kind int, start long, end long, entity string, before long, after long, terms array<string>"

    def side(words: list[str]) -> int:
        return xxhash.xxh64_intdigest(" ".join(words)) >> 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                b = batch.slice(at, 256)
                row, own = [], []
                for i, text in enumerate(b.column(2).to_pylist()):
                    row.append(i)
                    own.append((-1, -1, -1, None, None, None, None))
                    found = find_base(text or "")
                    for (k, s, e, value), (left, right) in zip(found, surroundings(text, found, near) if found else ()):
                        row.append(i)
                        own.append((k, s, e, f"{KINDS[k]}:{value}", side(left), side(right), sorted({*left, *right})))
                types = [pa.int32(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.list_(pa.string())]
                columns = [pa.array(c, t) for c, t in zip(zip(*own), types)]
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(row)), b.column(1).take(pa.array(row)), *columns], names=names)

    return docs.select("doc_id", "text_hash", "text").mapInArrow(run, schema)


def bitmap(terms: DataFrame) -> np.ndarray:
    """terms (term) -> which of 2**BITS hash values occur; the driver gets 4 KB for each 2**15 of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, last in pieces(batch.column(0)):
                h = word_spans(*string_buffers(batch.column(0).slice(first, last - first)))[2]
                yield pa.RecordBatch.from_arrays([pa.array((h >> np.uint64(64 - BITS)).astype(np.int64) + 1)], names=["bit"])

    bits = terms.select("term").mapInArrow(run, "bit long")
    parts = bits.groupBy(F.bitmap_bucket_number("bit").alias("part")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("bit")).alias("set")).collect()
    out = np.zeros(1 << BITS >> 3, np.uint8)
    for p in parts:
        at = (p["part"] - 1) << 12
        out[at : at + 4096] = np.frombuffer(p["set"], np.uint8)
    return out


def _listed(column: pa.Array, known: np.ndarray) -> Iterator[tuple]:
    """Pieces of a text column: first row, bytes, offsets, and of the words in the bitmap their text index, start, end and hash."""
    for first, last in pieces(column):
        data, offsets = string_buffers(column.slice(first, last - first))
        start, end, h, words = word_spans(data, offsets)
        bit = (h >> np.uint64(64 - BITS)).astype(np.int64)
        at = np.flatnonzero(known[bit >> 3] >> (bit & 7).astype(np.uint8) & 1)
        yield first, data, offsets, np.searchsorted(words, at, "right") - 1, start[at], end[at], h[at]


def _terms(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> list[str]:
    raw = data.tobytes() if len(start) else b""
    return [raw[s:e].lower().decode() for s, e in zip(start.tolist(), end.tolist())]


def document_counts(docs: DataFrame, known: np.ndarray) -> DataFrame:
    """docs (text) -> term, documents: for terms in the bitmap; counted within each piece first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, data, _, doc, start, end, h in _listed(batch.column(0), known):
                _, first, code = np.unique(h, return_index=True, return_inverse=True)
                both = np.unique(doc * max(len(first), 1) + code)
                n = np.bincount(both % max(len(first), 1), minlength=len(first))
                yield pa.RecordBatch.from_arrays([pa.array(_terms(data, start[first], end[first]), pa.string()), pa.array(n, pa.int64())], names=["term", "n"])

    return docs.select("text").mapInArrow(run, "term string, n long").groupBy("term").agg(F.sum("n").alias("n_term"))


def places(docs: DataFrame, known: np.ndarray) -> DataFrame:
    """docs (doc_id, text, text_hash) -> doc_id, text_hash, term, start, end of words in the bitmap and outside base spans."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, data, offsets, doc, start, end, _ in _listed(batch.column(2), known):
                if not len(start):
                    continue
                points = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
                begin, stop = (points[x] - points[offsets[doc]] for x in (start, end))
                free = {i: outside(find_base(data[offsets[i] : offsets[i + 1]].tobytes().decode())) for i in np.unique(doc).tolist()}
                keep = np.array([free[i](s, e) for i, s, e in zip(doc.tolist(), begin.tolist(), stop.tolist())])
                doc, start, end = doc[keep], start[keep], end[keep]
                row, span = pa.array(doc + first, pa.int64()), [pa.array(x[keep], pa.int64()) for x in (begin, stop)]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(row), batch.column(1).take(row), pa.array(_terms(data, start, end), pa.string()), *span], names=["doc_id", "text_hash", "term", "start", "end"])

    return docs.select("doc_id", "text_hash", "text").mapInArrow(run, "doc_id long, text_hash long, term string, start long, end long")


def pairs(found: DataFrame, support: int = SUPPORT) -> DataFrame:
    """entity, term, n_both, n_entity: pairs with enough different surroundings on both sides."""
    spans = found.where("kind >= 0")
    many = spans.groupBy("entity").agg(F.count_distinct("before").alias("b"), F.count_distinct("after").alias("a")).where((F.col("b") >= support) & (F.col("a") >= support))
    spans = spans.join(many.select("entity"), "entity")
    n_entity = spans.select("entity", "doc_id", "text_hash").distinct().groupBy("entity").agg(F.count(F.lit(1)).alias("n_entity"))
    each = spans.select("entity", "doc_id", "text_hash", "before", "after", F.explode("terms").alias("term"))
    backed = each.groupBy("entity", "term").agg(F.count_distinct("before").alias("b"), F.count_distinct("after").alias("a")).where((F.col("b") >= support) & (F.col("a") >= support))
    n_both = each.select("entity", "term", "doc_id", "text_hash").distinct().groupBy("entity", "term").agg(F.count(F.lit(1)).alias("n_both"))
    return backed.select("entity", "term").join(n_both, ["entity", "term"]).join(n_entity, "entity")


def disclosing(pair: DataFrame, n_term: DataFrame, documents: int, generalise: float = GENERALISE, remove: float = REMOVE) -> DataFrame:
    """term, share, kind (4 generalise, 5 remove): each term with the most it gives away of any entity."""
    n = F.lit(float(documents))
    # A repeated (doc_id, text) row counts again in n_term only; the share of p(c, t) in p(t) is at most 1.
    given = F.log(n * F.col("n_both") / (F.col("n_entity") * F.greatest("n_term", "n_both")))
    share = F.when(F.col("n_entity") < n, given / F.log(n / F.col("n_entity")))
    best = pair.join(n_term, "term").groupBy("term").agg(F.max(share).alias("share")).where(F.col("share") >= generalise)
    return best.withColumn("kind", F.when(F.col("share") >= remove, 5).otherwise(4))


def scan(docs: DataFrame, near: int = NEAR, support: int = SUPPORT, generalise: float = GENERALISE, remove: float = REMOVE) -> DataFrame:
    """docs (doc_id, text) -> doc_id, text_hash, copies, spans (sorted array of start, kind, end): one row per distinct (doc_id, text)."""
    d = docs.select(F.col("doc_id").cast("long"), "text", F.xxhash64("text").alias("text_hash"))
    found = written(entities(d, near), "entities")
    pair = written(pairs(found, support), "pairs")
    documents = found.where("kind < 0").count()
    counts = document_counts(d, bitmap(pair.select("term").distinct()))
    risky = written(disclosing(pair, counts, documents, generalise, remove), "risky")
    few = risky.count() <= FEW
    told = places(d, bitmap(risky)).join(F.broadcast(risky) if few else risky, "term").select("doc_id", "text_hash", "kind", "start", "end")
    rows = found.select("doc_id", "text_hash", "kind", "start", "end").unionByName(told)
    spans = F.array_sort(F.collect_set(F.when(F.col("kind") >= 0, F.struct("start", "kind", "end"))))
    return rows.groupBy("doc_id", "text_hash").agg(F.count_if(F.col("kind") < 0).alias("copies"), spans.alias("spans"))


def sanitised(docs: DataFrame, spans: DataFrame) -> DataFrame:
    """docs (doc_id, text) and ``scan``'s result -> doc_id, text: base spans and generalised terms replaced, others taken out.

    Spans that overlap are replaced together, by the label of the first.
    """

    def label(kind: int, was: str) -> str:
        if kind < BASE:
            return f"[{KINDS[kind].upper()}]"
        if kind == 5:
            return ""
        return "[NUMBER]" if was.isdigit() else "[CODE]" if any(c.isdigit() for c in was) else "[NAME]" if was[0].isupper() else "[WORD]"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text, found in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                parts, free = [], 0
                for f in found or ():
                    if f["start"] >= free:
                        parts += [text[free : f["start"]], label(f["kind"], text[f["start"] : f["end"]])]
                    free = max(free, f["end"])
                out.append(None if text is None else "".join(parts) + text[free:])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string())], names=["doc_id", "text"])

    s = spans.select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash"), "spans")
    d = docs.select(F.col("doc_id").cast("long"), "text")
    both = d.join(s, d["doc_id"].eqNullSafe(s["_id"]) & (F.xxhash64("text") == s["_hash"]), "left")
    return both.select("doc_id", "text", "spans").mapInArrow(run, "doc_id long, text string")


def op13_sanitise(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = scan(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))

    def shown(array):
        name = F.array(*map(F.lit, KINDS))
        one = F.transform(array, lambda x: F.concat(F.get(name, x["kind"]), F.lit(":"), x["start"].cast("string"), F.lit(":"), x["end"].cast("string")))
        return F.array_join(one, ",")

    def number(kind: int):
        return F.size(F.filter("spans", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{KINDS[kind]}")

    g = g.select("*", F.explode(F.sequence(F.lit(1), "copies")).alias("copy"))
    base = F.filter("spans", lambda x: x["kind"] < BASE)
    return g.select("doc_id", *[number(k) for k in range(BASE)], F.sha2(shown(base), 256).alias("base_sha256"), shown(F.col("spans")).alias("spans"))
