"""MinHash near-dedup with BagMinHash signatures of word-shingle multisets.

Weights are counts of five-word shingles, discretised at 1, 2, 4, 8, ... Each shingle has an
independent Poisson process per dyadic weight interval, with a rate as wide as the interval; its
points carry a time, a signature component and a place within the interval. A process is only
run below the shingle's weight (points beyond it are thinned), so the same points arise for any
weight that reaches them, and each component's earliest point agrees between two texts with
probability equal to their weighted Jaccard similarity. Processes yield points in order of time
and stop once they are later than all components' earliest. Waits are whole ticks, whose sum is
the same however many points are drawn at a time: a text's signature does not depend on the
texts beside it.

``BANDS`` bands of ``ROWS`` components give candidates: a pair at 0.8 is missed with probability
(1 - 0.8**7)**45, under 3e-5. Buckets are not expanded into pairs: first each bucket's smallest
text is compared with the others, then a text drawn by the bucket, and last, in buckets that
still hold texts of several components, each text outside the bucket's most common component
with the texts of other components. Pairs inside one component need no comparison.
Estimates from whole signatures (tolerance ``SLACK``, over six standard deviations; two bits a component) only spare
hopeless verifications; a link needs an exact multiset overlap of 0.8 or more. Tables that a step
reads twice are written first: a plan's stages start together, and each takes memory of the driver.

Defined results: texts with the same words in the same order are one class and are compared
once; texts without words have no shingles and are alike to none; null ids and ids on several
texts: a null id is never grouped, an id's texts share its group. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from casewarden.llm.components import components
from casewarden.llm.textvec import give_back, mix, pieces, shingle_units, string_buffers, word_hashes
from casewarden.storage import unused, written

SHINGLE, SIMILARITY = 5, 0.8
BANDS, ROWS = 45, 7
SLACK = 0.62
#: So many ids (8 bytes each) are broadcast; more are joined by a shuffle.
MAX_BROADCAST_IDS = 2_000_000
#: Texts whose signatures are made together, a few KB each.
PIECE_ROWS = 1024
_GOLD = np.uint64(0x9E3779B97F4A7C15)
#: Ticks of a wait of one, the mean at rate one.
TICKS = 2.0**40


def bag_minhash(doc: np.ndarray, shingle: np.ndarray, count: np.ndarray, n_docs: int, m: int) -> np.ndarray:
    """Signatures (n_docs, m) of the multisets given by text index, shingle hash and count."""
    # One process per shingle and dyadic interval [low, low + width) that its count reaches into.
    low, width, item = [np.zeros(len(doc))], [np.ones(len(doc))], [np.arange(len(doc))]
    edge = 1
    while (more := np.flatnonzero(count > edge)).size:
        low.append(np.full(more.size, float(edge)))
        width.append(np.full(more.size, float(edge)))
        item.append(more)
        edge *= 2
    low, width, item = map(np.concatenate, (low, width, item))
    seed = mix(shingle[item] + mix(low.astype(np.uint64) + np.uint64(1)) * np.uint64(3))
    own, top = doc[item], count[item].astype(float)
    best = np.full((n_docs, m), np.inf)
    flat = best.reshape(-1)
    time, step = np.zeros(len(item), np.int64), 0  # ticks at rate one
    while len(item):
        k = int(np.clip(16384 // len(item), 1, 64))
        draw = mix(seed[:, None] + (np.arange(step, step + k, dtype=np.uint64) + np.uint64(1)) * _GOLD)
        step += k
        wait = -np.log(((draw >> np.uint64(11)).astype(float) + 0.5) / 2.0**53)
        ticks = time[:, None] + np.cumsum(np.rint(wait * TICKS).astype(np.int64), axis=1)
        at = ticks / (width[:, None] * TICKS)
        mark = mix(draw ^ np.uint64(0xD1B54A32D192ED03))
        cell = own[:, None] * m + ((mark >> np.uint64(32)) % np.uint64(m)).astype(np.int64)
        place = low[:, None] + width[:, None] * ((mark & np.uint64(0xFFFFFFFF)).astype(float) / 2.0**32)
        live = place < top[:, None]
        np.minimum.at(flat, cell[live], at[live])
        time = ticks[:, -1]
        go = at[:, -1] < best.max(axis=1)[own]
        seed, own, top, low, width, item, time = (x[go] for x in (seed, own, top, low, width, item, time))
    return best


def _row_units(column: pa.Array, width: int) -> Iterator[tuple]:
    for first, last in pieces(column, rows=PIECE_ROWS):
        data, offsets = string_buffers(column.slice(first, last - first))
        h, words = word_hashes(data, offsets)
        yield first, last, h, words, shingle_units(h, words, width)


def signatures(docs: DataFrame, shingle: int = SHINGLE, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """docs (doc_id, text) -> doc_id, n_words, class1, class2, n_units, bands, sig (two bits a component)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = bands * rows
        band_salt = mix(np.arange(1, bands + 1, dtype=np.uint64) * _GOLD)
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            for first, last, h, words, (doc, s, count) in _row_units(texts, shingle):
                n = last - first
                best = bag_minhash(doc, s, count, n, m).view(np.uint64)
                code = mix(best)
                key = np.zeros((n, bands), np.uint64)
                for k in range(rows):
                    key = mix(key + code[:, k::rows] * _GOLD + np.uint64(k))
                key = (key ^ band_salt).astype(np.int64, copy=False)
                n_words, n_units = np.diff(words), np.bincount(doc, count, n).astype(np.int64)
                place = np.arange(len(h), dtype=np.uint64) - np.repeat(words[:-1], n_words).astype(np.uint64)
                sums = []
                for salt in (np.uint64(1), np.uint64(2)):
                    each = np.concatenate([[np.uint64(0)], np.cumsum(mix(h * (salt + salt + np.uint64(1)) + mix(place + salt)), dtype=np.uint64)])
                    sums.append(mix(each[words[1:]] - each[words[:-1]]).view(np.int64))
                yield pa.RecordBatch.from_arrays(
                    [
                        ids.slice(first, n), pa.array(n_words, pa.int64()), pa.array(sums[0]), pa.array(sums[1]), pa.array(n_units),
                        pa.ListArray.from_arrays(pa.array(np.arange(0, n * bands + 1, bands), pa.int32()), pa.array(key.reshape(-1).view(np.int64))),
                        pa.array([r.tobytes() for r in _two_bits(code)], pa.binary()),
                    ],
                    names=["doc_id", "n_words", "class1", "class2", "n_units", "bands", "sig"],
                )
        give_back()

    schema = "doc_id long, n_words long, class1 long, class2 long, n_units long, bands array<long>, sig binary"
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, schema)


def _two_bits(code: np.ndarray) -> np.ndarray:
    """Two bits of each component, four to a byte."""
    code = np.pad((code & np.uint64(3)).astype(np.uint8), ((0, 0), (0, -code.shape[1] % 4)))
    return code[:, 0::4] | code[:, 1::4] << 2 | code[:, 2::4] << 4 | code[:, 3::4] << 6


def _estimated(pairs: DataFrame, components_: int = BANDS * ROWS) -> DataFrame:
    """Pairs (a, b, sig_a, sig_b) whose signatures estimate a similarity of SLACK or more: two-bit
    components that do not agree differ three times in four."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                x, y = (np.frombuffer(b"".join(c.to_pylist()), np.uint8).reshape(len(c), -1) for c in (part.column("sig_a"), part.column("sig_b")))
                differ = x ^ y
                differ = np.bitwise_count((differ | differ >> 1) & np.uint8(0x55)).sum(axis=1)
                keep = differ <= (1 - SLACK) * 0.75 * components_
                yield pa.RecordBatch.from_arrays([part.column(k).filter(pa.array(keep)) for k in ("a", "b")], names=["a", "b"])

    return pairs.select("a", "b", "sig_a", "sig_b").mapInArrow(run, "a long, b long")


def _unit_sets(docs: DataFrame, shingle: int) -> DataFrame:
    """doc_id, units: sorted distinct hashes of (shingle, occurrence), 8 bytes each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, last, _, _, (doc, s, count) in _row_units(batch.column(1), shingle):
                own = np.repeat(doc, count)
                nth = np.arange(len(own)) - np.repeat(np.cumsum(count) - count, count)
                unit = mix(np.repeat(s, count) + nth.astype(np.uint64) * _GOLD)
                order = np.lexsort((unit, own))
                unit, ends = unit[order], np.searchsorted(own[order], np.arange(last - first + 1))
                raw = [unit[ends[i] : ends[i + 1]].tobytes() for i in range(last - first)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, last - first), pa.array(raw, pa.binary())], names=["doc_id", "units"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, units binary")


def _only(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows of docs whose id is in the written table ids; it is broadcast if its size allows."""
    few = ids.count() <= MAX_BROADCAST_IDS
    return docs.join(F.broadcast(ids) if few else ids, "doc_id", "left_semi")


def _sharing_rare_units(texts: DataFrame, open_docs: DataFrame, sizes: DataFrame, similarity: float, shingle: int) -> DataFrame:
    """Pairs (a, b) of open_docs (doc_id, label) with different labels that can reach the similarity.

    With units in one order, rarest first, texts of n units that reach it share one of their
    first n - ceil(similarity * n) + 1 (prefix filter). At the first unit that two texts share,
    what follows in either bounds their overlap (positional filter). No pair is lost by either; a
    copy whose own edits fill half a prefix meets nobody of its size.
    """
    ids = open_docs.select("doc_id").distinct()
    units = written(_unit_rows(_only(texts, ids), shingle).distinct(), "unit_rows")
    common = units.groupBy("unit").agg(F.count(F.lit(1)).alias("n"))
    n_units = sizes.join(open_docs, "doc_id").select("doc_id", "label", "n_units").distinct()
    first = F.col("n_units") - F.ceil(F.col("n_units") * similarity - 1e-9) + 1
    rows = units.join(common, "unit").withColumn("place", F.row_number().over(Window.partitionBy("doc_id").orderBy("n", "unit")))
    rows = rows.join(n_units, "doc_id").where((F.col("place") <= first) & (F.col("n") > 1)).select("doc_id", "label", "n_units", "unit", (F.col("n_units") - F.col("place") + 1).alias("left"))
    rows = written(rows, "prefixes")
    x = rows.select("unit", F.col("doc_id").alias("a"), F.col("label").alias("la"), F.col("n_units").alias("ka"), F.col("left").alias("ra"))
    y = rows.select("unit", F.col("doc_id").alias("b"), F.col("label").alias("lb"), F.col("n_units").alias("kb"), F.col("left").alias("rb"))
    sized = F.least("ka", "kb") >= similarity * F.greatest("ka", "kb") - 1e-9
    enough = F.least("ra", "rb") >= similarity / (1 + similarity) * (F.col("ka") + F.col("kb")) - 1e-9
    return x.join(y, "unit").where((F.col("a") < F.col("b")) & (F.col("la") != F.col("lb")) & sized & enough).select("a", "b").distinct()


def _unit_rows(docs: DataFrame, shingle: int) -> DataFrame:
    """doc_id, unit: one row per (shingle, occurrence)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, last, _, _, (doc, s, count) in _row_units(batch.column(1), shingle):
                own = np.repeat(doc, count)
                nth = np.arange(len(own)) - np.repeat(np.cumsum(count) - count, count)
                unit = mix(np.repeat(s, count) + nth.astype(np.uint64) * _GOLD).view(np.int64)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, last - first).take(pa.array(own)), pa.array(unit)], names=["doc_id", "unit"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, unit long")


def _overlapping(pairs: DataFrame, similarity: float) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("units_a"), batch.column("units_b"), strict=True):
                x, y = (np.frombuffer(v.as_buffer(), np.uint64) for v in (x, y))
                both = np.concatenate([x, y])
                both.sort(kind="stable")
                common = int((both[1:] == both[:-1]).sum())
                keep.append(common >= similarity * (len(both) - common) - 1e-9 and common > 0)
            yield pa.RecordBatch.from_arrays([batch.column(k).filter(pa.array(keep, pa.bool_())) for k in ("a", "b")], names=["a", "b"])

    return pairs.select("a", "b", "units_a", "units_b").mapInArrow(run, "a long, b long")


def near_duplicates(docs: DataFrame, similarity: float = SIMILARITY, shingle: int = SHINGLE) -> DataFrame:
    """docs (doc_id, text) -> doc_id, class_id, group_id, kept: one row per row of docs.

    class_id: smallest doc_id with the same words; group_id: smallest doc_id of the texts that
    are connected by links; kept: the row stays (one of each group; rows without words stay).
    """
    sig = written(signatures(docs, shingle), "signatures")
    known = sig.where("doc_id IS NOT NULL AND n_words > 0")
    classes = known.groupBy("class1", "class2").agg(F.min("doc_id").alias("class_id"))
    member = known.select("doc_id", "class1", "class2").distinct().join(classes, ["class1", "class2"]).select("doc_id", "class_id")
    member = written(member.distinct(), "members")
    leaders = known.join(member.select("class_id").distinct(), F.col("doc_id") == F.col("class_id"), "left_semi")

    bands = leaders.select("doc_id", F.explode("bands").alias("bucket"))
    buckets = bands.groupBy("bucket").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where("first != last")
    shared = written(bands.join(buckets.select("bucket", "first"), "bucket"), "buckets")
    draws = shared.groupBy("bucket").agg(F.min_by("doc_id", F.xxhash64("doc_id", "bucket")).alias("drawn"))
    known_sig = sig.select("doc_id", "n_units", "sig")
    texts = docs.select("doc_id", "text")

    def check(pairs: DataFrame) -> DataFrame:
        """Pairs (a, b), a < b, of which the exact overlap is high enough; written."""
        x = known_sig.select(F.col("doc_id").alias("a"), F.col("n_units").alias("n_a"), F.col("sig").alias("sig_a"))
        y = known_sig.select(F.col("doc_id").alias("b"), F.col("n_units").alias("n_b"), F.col("sig").alias("sig_b"))
        sized = F.least("n_a", "n_b") >= similarity * F.greatest("n_a", "n_b") - 1e-9
        pairs = written(pairs, "pairs")
        likely = written(_estimated(pairs.join(x, "a").join(y, "b").where(sized)).distinct(), "likely")
        involved = written(likely.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct(), "involved")
        units = written(_unit_sets(_only(texts, involved), shingle), "units")
        ua = units.select(F.col("doc_id").alias("a"), F.col("units").alias("units_a"))
        ub = units.select(F.col("doc_id").alias("b"), F.col("units").alias("units_b"))
        return written(_overlapping(likely.join(ua, "a").join(ub, "b"), similarity).distinct(), "links")

    def ordered(pairs: DataFrame, one: str, other: str) -> DataFrame:
        return pairs.where(F.col(one) != F.col(other)).select(F.least(one, other).alias("a"), F.greatest(one, other).alias("b")).distinct()

    def labelled(rows: DataFrame, links: DataFrame) -> DataFrame:
        roots = components(links)
        return rows.join(roots, rows["doc_id"] == roots["node"], "left").withColumn("label", F.coalesce("root", "doc_id")).drop("node", "root")

    links = check(ordered(shared, "first", "doc_id"))
    tagged = written(labelled(shared.join(draws, "bucket"), links), "tagged")
    drawn = tagged.select("bucket", F.when(F.col("doc_id") == F.col("drawn"), F.col("label")).alias("l")).groupBy("bucket").agg(F.max("l").alias("drawn_label"))
    second = tagged.where(F.col("drawn") != F.col("first")).join(drawn, "bucket").where("label != drawn_label")
    links = written(links.union(check(ordered(second, "drawn", "doc_id"))), "links")

    tagged = written(labelled(shared.select("bucket", "doc_id"), links), "tagged")
    mixed = tagged.groupBy("bucket").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo != hi").select("bucket")
    open_docs = written(tagged.join(mixed, "bucket").select("doc_id", "label").distinct(), "open")
    links = links.union(check(_sharing_rare_units(texts, open_docs, known_sig, similarity, shingle)))

    roots = components(links).select(F.col("node").alias("class_id"), F.col("root").alias("group_id"))
    group = member.join(roots, "class_id", "left").select("doc_id", "class_id", F.coalesce("group_id", "class_id").alias("group_id"))
    group = group.groupBy("doc_id").agg(F.min("class_id").alias("class_id"), F.min("group_id").alias("group_id"))
    rows = sig.select("doc_id", "n_words").join(group, "doc_id", "left")
    nth = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.col("n_words").desc()))
    rows = rows.withColumn("class_id", F.coalesce("class_id", "doc_id")).withColumn("group_id", F.coalesce("group_id", "doc_id"))
    single = F.col("doc_id").isNull() | (F.col("n_words") == 0)
    kept = F.when(single, True).otherwise((F.col("doc_id") == F.col("group_id")) & (F.col("nth") == 1))
    return rows.withColumn("nth", nth).select("doc_id", "class_id", "group_id", kept.alias("kept"))


def keep_one_each(docs: DataFrame) -> DataFrame:
    """docs without the near-duplicates of other documents; all columns, each row at most once.

    Texts are told apart by a hash of id and text, so ids may be null or repeated; the id only
    says which text of a group stays: the smallest, a null id last. Of rows equal in id and text
    one stays; rows without words all stay.
    """
    key = F.xxhash64(F.lit(13), F.col("doc_id").isNull(), "doc_id", "text")
    own, nth_name = unused(docs, "_near_key"), unused(docs, "_near_nth")
    keyed = docs.withColumn(own, key)
    found = near_duplicates(keyed.select(F.col(own).alias("doc_id"), "text"))
    found = written(found.groupBy(F.col("doc_id").alias("_near_key")).agg(F.min("group_id").alias("group")), "near_groups")
    grouped = found.join(found.groupBy("group").agg(F.count(F.lit(1)).alias("texts")).where("texts > 1"), "group").select("_near_key", "group")
    grouped = written(grouped, "near_grouped")
    ids = keyed.select(F.col(own).alias("_near_key"), "doc_id").join(grouped, "_near_key")
    place = F.struct(F.col("doc_id").isNull(), "doc_id", "_near_key")
    stays = ids.groupBy("group").agg(F.min_by("_near_key", place).alias("_near_key"))
    gone = grouped.select("_near_key").join(stays.select("_near_key"), "_near_key", "left_anti")
    left = keyed.join(written(gone, "near_gone").withColumnRenamed("_near_key", own), own, "left_anti")
    others = [F.xxhash64(*(c for c in docs.columns if c not in ("doc_id", "text")))] if len(docs.columns) > 2 else []
    nth = F.row_number().over(Window.partitionBy(own).orderBy(*(others or [own])))
    wordless = ~F.coalesce(F.col("text").rlike(r"[0-9A-Za-z\x{80}-\x{10FFFF}]"), F.lit(False))
    return left.withColumn(nth_name, nth).where(wordless | (F.col(nth_name) == 1)).select(*docs.columns)


def op4_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
