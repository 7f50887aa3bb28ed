"""Mixing sources to target weights by Sainte-Laguë apportionment.

Targets: sources share all words by weight; a target stops at ``max_epochs`` times its source's
size and the excess is reshared by weight. With sources sorted by cap / weight the common level
is the largest of (words - caps of the sources before) / (weights from here on).

Blocks of equal token count are the seats. They go to sources by the highest quotients
target / (2 s + 1), and a source's blocks go to its shards (documents dealt by a seeded hash) by
the highest quotients of the shards' sizes. A quota is certain up to a lower bound that follows
from the number of parties; only quotients between that and an upper bound are ranked, at most
about three per party, so no list of all seats is ever made.

A shard lays its documents end to end in seeded order and cuts them into blocks. It takes whole
passes, then as many blocks as are left, spread evenly over the shard from a seeded start. So a word is
taken at most ``max_epochs`` times. How many drawn blocks lie before a word follows from its place, so
no blocks are listed: what a document takes is the difference at its two ends.

Defined results: null text has size 0 and takes nothing; null sources are one source, last in
order; repeated rows are documents of their own; an empty table gives no rows; very long texts are
blocks like others. Block size is total words / 2**20, within 1 and 256. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from casewarden.storage import unused, written

#: Fixed by the contract: white space; weights repeat over the sources in order.
SPACE = r"[\x20\x09-\x0D]+"
WEIGHTS = (1, 2, 3)
MAX_EPOCHS = 3
SHARD_ROWS = 20_000
MAX_BLOCK = 256


def n_words(text: Column) -> Column:
    return F.size(F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE), "")).cast("long")


def targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """sources (key, source, size) -> the same with weight and target. One row per source."""
    place = F.row_number().over(Window.orderBy(F.col("source").isNull(), "source"))
    s = sources.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), F.pmod(place - 1, F.lit(len(weights))) + 1))
    s = s.withColumn("cap", F.col("size") * max_epochs)
    whole = Window.partitionBy()
    order = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").isNull(), "source")
    before = F.coalesce(F.sum("cap").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    onward = F.sum("weight").over(order.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    s = s.withColumn("level", (F.sum("size").over(whole) - before).cast("double") / onward)
    level = F.max("level").over(whole)
    return s.withColumn("target", F.least(F.col("cap").cast("double"), F.col("weight") * level)).drop("level", "cap")


def sainte_lague(parties: DataFrame, group: list[str], party: list[str], votes: str, seats: str) -> DataFrame:
    """Adds ``quota``: seats of each party in its group by highest quotients votes / (2 s + 1).

    ``seats`` is a column with the group's seats, the same on all its rows.
    """
    own = Window.partitionBy(*group)
    p = parties.withColumn("_all", F.sum(votes).over(own).cast("double")).withColumn("_n", F.count(F.lit(1)).over(own))
    share = F.when(F.col("_all") > 0, F.col(votes) / F.col("_all")).otherwise(0.0)
    low = F.greatest(F.lit(0), F.floor(share * (F.col(seats) - F.col("_n") / 2) - 0.5))
    high = F.when(F.col(votes) > 0, F.ceil(share * (F.col(seats) + F.col("_n") / 2) + 0.5)).otherwise(0)
    p = p.withColumn("_low", low.cast("long")).withColumn("_high", F.greatest(high, low).cast("long"))
    p = p.withColumn("_open", (F.col(seats) - F.sum("_low").over(own)).cast("long"))
    tries = F.explode_outer(F.when(F.col("_high") > F.col("_low"), F.sequence("_low", F.col("_high") - 1)))
    q = p.select("*", tries.alias("_s"))
    by = own.orderBy((F.col(votes) / (2 * F.col("_s") + 1)).desc_nulls_last(), *party)
    q = q.withColumn("_won", (F.col("_s").isNotNull() & (F.row_number().over(by) <= F.col("_open"))).cast("long"))
    return q.groupBy(*parties.columns).agg((F.max("_low") + F.sum("_won")).alias("quota"))


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS, seed: int = 7, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """docs (doc_id, source, text) -> doc_id, source, size, source_size, target, taken, per row.

    Also text_hash, xxhash64 of the text, to tell rows of equal doc_id apart.
    """
    key = F.when(F.col("source").isNull(), "").otherwise(F.concat(F.lit("s"), F.col("source")))
    light = written(
        docs.select(
            "doc_id", "source", key.alias("key"), n_words(F.col("text")).alias("size"), F.xxhash64("text").alias("text_hash"),
            F.xxhash64(F.lit(seed), "doc_id", "text").alias("draw"),
        ),
        "mix_sizes",
    )
    n, total = light.agg(F.count(F.lit(1)), F.coalesce(F.sum("size"), F.lit(0))).first()
    shards, block = -(-max(n, 1) // shard_rows), min(MAX_BLOCK, max(1, total >> 20))
    light = light.withColumn("shard", F.pmod(F.xxhash64(F.lit(seed + 1), "draw"), F.lit(shards)))

    cells = light.groupBy("key", "shard").agg(F.sum("size").alias("cell"), F.first("source").alias("source"))
    sources = cells.groupBy("key").agg(F.first("source").alias("source"), F.sum("cell").alias("size"))
    sources = targets(sources, weights, max_epochs).withColumn("_g", F.lit(0)).withColumn("seats", F.lit(total // block))
    sources = sainte_lague(sources, ["_g"], ["key"], "target", "seats").select(
        "key", F.col("size").alias("source_size"), "target", F.col("quota").alias("source_quota")
    )
    cells = cells.drop("source").join(sources, "key")
    cells = sainte_lague(cells, ["key"], ["shard"], "cell", "source_quota")
    take = F.least(F.col("quota") * block, F.col("cell") * max_epochs)
    passes = F.when(F.col("cell") > 0, F.expr("1")).otherwise(0)
    cells = cells.withColumn("take", take).withColumn("passes", F.when(F.col("cell") > 0, F.floor(F.col("take") / F.col("cell"))).otherwise(passes).cast("long"))
    left = F.col("take") - F.col("passes") * F.col("cell")
    cells = cells.withColumn("extra", F.round(left / block).cast("long"))

    cells = cells.withColumn("blocks", F.expr(f"(cell + {block - 1}) div {block}"))
    cells = cells.withColumn("shift", F.when(F.col("blocks") > 0, F.pmod(F.xxhash64(F.lit(seed + 2), "key", "shard"), F.col("blocks"))).otherwise(0))

    line = Window.partitionBy("key", "shard").orderBy("draw", "doc_id", "size", "text_hash").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    d = light.withColumn("end", F.sum("size").over(line)).withColumn("start", F.col("end") - F.col("size"))
    d = d.join(cells.select("key", "shard", "source_size", "target", "passes", "extra", "blocks", "shift"), ["key", "shard"])
    drawn = F.when((F.col("size") > 0) & (F.col("extra") > 0), words_drawn("end", block) - words_drawn("start", block)).otherwise(0)
    return d.select(
        "doc_id", "source", "size", "source_size", "target", (F.col("passes") * F.col("size") + drawn).cast("long").alias("taken"), "text_hash"
    )


def words_drawn(place: str, block: int) -> Column:
    """Words before ``place`` of a shard that lie in drawn blocks.

    Of ``blocks`` blocks ``extra`` are drawn: block b if (b + shift) * extra / blocks passes a whole number
    between b and b + 1.
    """
    before = f"(((({place} div {block}) + {{}} + shift) * extra) div blocks)"
    full = f"({before.format(0)} - ((shift * extra) div blocks))"
    return F.expr(f"{full} * {block} + ({before.format(1)} - {before.format(0)}) * ({place} % {block})")


def repeat_documents(docs: DataFrame, seed: int = 7) -> DataFrame:
    """All columns of docs, each document as often as the mix takes it: taken / size copies,
    the fraction rounded up or down by a seeded draw of the document, so that expected words
    are the words taken."""
    m = mix(docs, seed=seed).where("taken > 0")
    draw = F.pmod(F.xxhash64(F.lit(seed + 3), "doc_id", "text_hash"), F.lit(1 << 30)) / float(1 << 30)
    n = F.floor(F.col("taken") / F.col("size") + draw).cast("int")
    own, text_hash, times, copy = (unused(docs, f"_mix_{c}") for c in ("id", "hash", "n", "copy"))
    m = m.groupBy(F.col("doc_id").alias(own), F.col("text_hash").alias(text_hash)).agg(F.max(n).alias(times)).where(F.col(times) > 0)
    same = docs["doc_id"].eqNullSafe(m[own]) & (F.xxhash64(docs["text"]) == m[text_hash])
    return docs.join(m, same).withColumn(copy, F.explode(F.sequence(F.lit(1), times))).select(*docs.columns)


def op8_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "text")
    return mix(docs).select("doc_id", "size", "source_size", "target", "taken")
