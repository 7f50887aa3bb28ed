"""Sharding by k-d tree partitioning.

Documents are points of metadata (identifier, language, source). A language or source counts by its
place among the distinct values, so no two are taken for one. The tree splits recursively: a node
that is to become k shards is cut along its widest dimension, relative to the whole table's
range, at the weighted median (for odd k at floor(k/2) / k of its bytes). All nodes of a level
are cut by the same jobs: histograms of bytes, each round of them refining the one bin in which a
node's cut lies, until that bin is light. Documents with equal values are ordered by a hash of
the document id, the text and, for repeated rows, their number, so a source, a language or a group of
equal rows with a third of all rows is split like any other.

Law: ``bytes``, the shards' sizes are near equal. Only the tree's nodes (fewer than two per
shard) reach the driver.

Defined results: null text has no bytes and CRC 0; null metadata is the smallest value; repeated
rows each have their place, and may lie in several shards; an empty table gives no rows; very long texts
count by their bytes. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from casewarden.storage import written

SHARDS = 40
ROW_BYTES = 16
#: Order of a dimension: so many bits of the value, then bits of the id's hash.
VALUE_BITS, HASH_BITS = 36, 24
BINS = 4096
#: A cut is good enough when the bin that holds it has this part of a shard's bytes.
TOLERANCE = 0.002
SLOT_PARTS = 64


def _numbered(rows: DataFrame, group: list[str], order: list, spread) -> DataFrame:
    """Adds ``number``, from 0 without gaps within the group; parts of a group, dealt by ``spread``, are numbered apart, then offset."""
    p = rows.withColumn("_part", F.pmod(spread, F.lit(SLOT_PARTS)))
    counts = p.groupBy(*group, "_part").agg(F.count(F.lit(1)).alias("_n"))
    earlier = Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select(*group, "_part", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    own = Window.partitionBy(*group, "_part").orderBy(*order)
    p = p.withColumn("_place", F.row_number().over(own)).join(counts, [*group, "_part"])
    return p.withColumn("number", (F.col("_before") + F.col("_place") - 1).cast("long")).drop("_part", "_place", "_before")


def _ranks(base: DataFrame, column: str) -> DataFrame:
    """(value, rank): the distinct values of a column in order, null first; sorted by range, so no task has them all."""
    values = base.select(F.col(column).alias("value")).distinct().repartitionByRange(F.col("value").asc_nulls_first())
    values = written(values.withColumn("part", F.spark_partition_id()), "kd_values")
    counts = values.groupBy("part").agg(F.count(F.lit(1)).alias("n"))
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row a partition
    counts = counts.select("part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    own = F.row_number().over(Window.partitionBy("part").orderBy(F.col("value").asc_nulls_first()))
    return values.withColumn("own", own).join(counts, "part").select("value", (F.col("before") + F.col("own") - 1).alias("rank"))


def kd_shards(docs: DataFrame, shards: int = SHARDS, seed: int = 11) -> DataFrame:
    """docs (doc_id, text, lang, source) -> doc_id, size, text_crc32, shard, slot."""
    text = F.coalesce("text", F.lit(""))
    size = F.octet_length(text).cast("long") + ROW_BYTES
    rows = written(
        docs.select(
            F.col("doc_id").cast("long"), size.alias("size"), F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"), "lang", "source", F.monotonically_increasing_id().alias("row")
        ),
        "kd_rows",
    )
    # Rows that are equal in all of this get a number each; the others have number 0.
    same = ["doc_id", "size", "text_crc32", "lang", "source"]
    again = rows.groupBy(*same).agg(F.count(F.lit(1)).alias("copies")).where("copies > 1")
    key = F.xxhash64(*same)
    numbers = _numbered(rows.select("row", key.alias("key"), *same).join(again.select(key.alias("key")), "key", "left_semi"), ["key"], ["row"], F.xxhash64("row"))
    rows = rows.join(numbers.select("row", "number"), "row", "left")
    tie = F.shiftrightunsigned(F.xxhash64(F.lit(seed), "doc_id", "text_crc32", F.coalesce("number", F.lit(0))), 64 - HASH_BITS)
    for column in ("lang", "source"):
        ranks = _ranks(rows, column).select(F.col("value").alias(f"_{column}"), F.col("rank").alias(f"{column}_rank"))
        rows = rows.join(ranks, F.col(column).eqNullSafe(F.col(f"_{column}")), "left")
    base = written(
        rows.select("doc_id", "size", "text_crc32", tie.alias("tie"), F.col("doc_id").alias("v0"), F.col("lang_rank").alias("v1"), F.col("source_rank").alias("v2"), F.lit(1).alias("node")),
        "kd_points",
    )
    dims = range(3)
    ends = base.agg(*[f(f"v{i}").alias(f"{n}{i}") for i in dims for n, f in (("lo", F.min), ("hi", F.max))]).first()

    low, high = ([ends[f"{n}{i}"] or 0 for i in dims] for n in ("lo", "hi"))
    shift = [max(0, (high[i] - low[i] + 2).bit_length() - VALUE_BITS) for i in dims]
    spans = [max(1, (high[i] >> shift[i]) - (low[i] >> shift[i]) + 1) for i in dims]  # ranges of the whole table

    def order(i: int):
        """The value's place in the table's range, a null's is 0, in at most VALUE_BITS bits; then the tie."""
        lo, less = low[i], shift[i]
        place = F.coalesce(F.shiftright(f"v{i}", less) - (lo >> less) + 1, F.lit(0))
        return F.shiftleft(place, HASH_BITS).bitwiseOR(F.col("tie"))

    placed = base.select("node", "doc_id", "size", "text_crc32", "tie", *[order(i).alias(f"c{i}") for i in dims])
    nodes = {1: (0, shards)}  # open nodes: first shard, number of shards
    leaves: dict[int, int] = {}
    while open_nodes := {n: x for n, x in nodes.items() if x[1] > 1}:
        leaves |= {n: x[0] for n, x in nodes.items() if x[1] == 1}
        cuts = _cut_level(placed, open_nodes, spans)
        nodes = {}
        for n, (first, k) in open_nodes.items():
            nodes |= {2 * n: (first, k // 2), 2 * n + 1: (first + k // 2, k - k // 2)}
        dim, cut = _of_node({n: d for n, (d, _) in cuts.items()}), _of_node({n: c for n, (_, c) in cuts.items()})
        child = F.when(dim.isNull(), F.col("node")).otherwise(F.col("node") * 2 + (_along(dim) >= cut).cast("int"))
        # Written, so that no later plan holds the levels before it.
        placed = written(placed.withColumn("node", child), "kd_placed")
    leaves |= {n: x[0] for n, x in nodes.items()}
    out = placed.select("doc_id", "size", "text_crc32", "tie", _of_node(leaves).cast("int").alias("shard"))
    return with_slots(out)


def _of_node(values: dict[int, int | float]) -> Column:
    """The value of a row's node, null where it has none: looked up in a list from the first node to the last."""
    if not values:
        return F.lit(None).cast("long")
    first = min(values)
    kind = "D" if isinstance(values[first], float) else "L"
    listed = ", ".join(f"{values[n]!r}{kind}" if n in values else "NULL" for n in range(first, max(values) + 1))
    return F.expr(f"CASE WHEN node >= {first} THEN get(array({listed}), node - {first}) END")


def _along(dim: Column) -> Column:
    return F.when(dim == 0, F.col("c0")).when(dim == 1, F.col("c1")).otherwise(F.col("c2"))


def _cut_level(placed: DataFrame, open_nodes: dict[int, tuple[int, int]], spans: list[int]) -> dict[int, tuple[int, int]]:
    """Widest dimension and cut (first order value of the right side) of each open node."""
    inside = placed.where(F.col("node").isin(*open_nodes))
    stats = inside.groupBy("node").agg(
        F.sum("size").alias("bytes"), *[f(f"c{i}").alias(f"{n}{i}") for i in range(3) for n, f in (("lo", F.min), ("hi", F.max))]
    )
    state = {}
    for r in stats.collect():
        k = open_nodes[r["node"]][1]
        wide = max(range(3), key=lambda i: (((r[f"hi{i}"] >> HASH_BITS) - (r[f"lo{i}"] >> HASH_BITS)) / spans[i], -i))
        state[r["node"]] = {
            "dim": wide, "lo": r[f"lo{wide}"], "hi": r[f"hi{wide}"] + 1,
            "goal": r["bytes"] * (k // 2) / k, "fine": r["bytes"] / k * TOLERANCE,
        }
    done: dict[int, tuple[int, int]] = {}
    while state:
        for s in state.values():
            s["width"] = max(1, -(-(s["hi"] - s["lo"]) // BINS))
        dim, lo, hi, width, goal = (_of_node({n: s[key] for n, s in state.items()}) for key in ("dim", "lo", "hi", "width", "goal"))
        j = placed.where(F.col("node").isin(*state)).select("node", "size", _along(dim).alias("value"), lo.alias("lo"), hi.alias("hi"), width.alias("width"))
        h = j.where("value >= lo AND value < hi").groupBy("node", F.expr("(value - lo) div width").alias("bin")).agg(F.sum("size").alias("bytes"))
        h = h.withColumn("upto", F.sum("bytes").over(Window.partitionBy("node").orderBy("bin"))).where(F.col("upto") >= goal)
        at = h.groupBy("node").agg(F.min_by(F.struct("bin", "bytes", "upto"), "bin").alias("b")).collect()
        for r in at:
            n, s, b = r["node"], state[r["node"]], r["b"]
            start = s["lo"] + b["bin"] * s["width"]
            if b["bytes"] <= s["fine"] or s["width"] == 1:
                left = b["upto"] - s["goal"] <= s["goal"] - (b["upto"] - b["bytes"])
                done[n] = (s["dim"], start + s["width"] if left else start)
                del state[n]
            else:
                s["goal"] -= b["upto"] - b["bytes"]
                s["lo"], s["hi"] = start, start + s["width"]
        for n in [n for n in state if n not in {r["node"] for r in at}]:
            done[n] = (state[n]["dim"], state[n]["hi"])
            del state[n]
    return done


def with_slots(placed: DataFrame) -> DataFrame:
    """Gapless slots from 0 in each shard."""
    order = ["doc_id", "text_crc32", "size", "tie"]
    return _numbered(placed, ["shard"], order, F.xxhash64("doc_id", "tie")).withColumnRenamed("number", "slot").drop("tie")


def op10_kd_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang", "source")
    return kd_shards(docs).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )
