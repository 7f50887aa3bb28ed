"""A keyed Parquet table that takes merges, inserts, updates and deletes.

Rows lie in buckets by a hash of their key. A write stages rows in a folder of its own, then
publishes a version: one small manifest that names the folders of every bucket. The manifest appears
by one rename, so a reader sees the table as it was before a write or after it. Files are never
changed; a write that fails leaves staged files that no version names, and the table as it was. One
writer at a time: a second one that publishes the same version fails.

An insert adds a folder to the buckets it touches: its rows are staged once, and again only if some of
them are known. A merge, update or delete writes the touched buckets again, and so does an insert into a
bucket of ``MOST`` folders. Untouched buckets are neither read nor
written. Keys are unique and not null; a source that breaks this is refused. Only the numbers of the
touched buckets, and the newest manifest, come to the driver (at most ``MOST`` rows a bucket).
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from casewarden.operators.ledgers import delete_where, merge_upsert, update_where
from casewarden.storage import written

BUCKETS, MOST = 32, 16
#: Tasks that write a bucket, so that a large one is no single task's work.
SPREAD = 16
_MANIFEST = "bucket int, folder string, about string"
Folders = dict[int, list[str]]


class KeyedTable:
    def __init__(self, spark: SparkSession, path: str, schema: StructType, keys: list[str], buckets: int):
        self.spark, self.path, self.schema, self.keys, self.buckets = spark, path, schema, keys, buckets

    @classmethod
    def create(cls, df: DataFrame, path: str, keys: list[str], buckets: int = BUCKETS) -> KeyedTable:
        """A new table with the rows of ``df``; the path must not hold one."""
        table = cls(df.sparkSession, path.rstrip("/"), df.schema, keys, buckets)
        table._publish(-1, table._source(df)[1])
        return table

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> KeyedTable:
        """The table at ``path``, as some earlier run left it."""
        table = cls(spark, path.rstrip("/"), StructType(), [], 0)
        about = json.loads(table._manifests().where(F.col("version") == table.version()).select("about").first()[0])
        table.schema, table.keys, table.buckets = StructType.fromJson(about["schema"]), about["keys"], about["buckets"]
        return table

    def version(self) -> int:
        return self._manifests().agg(F.max("version")).first()[0]

    def read(self, version: int | None = None) -> DataFrame:
        """The rows of a version, by default of the newest."""
        return self._rows(self._folders(version)[1])

    def merge(self, source: DataFrame, update: list[str] | None = None) -> None:
        """Rows of known keys take the ``update`` columns (default all) of source; new keys are inserted."""
        source, staged = self._source(source)
        self._rewrite(set(staged), lambda old: merge_upsert(old, source, self.keys, update), set(staged))

    def insert_absent(self, source: DataFrame) -> None:
        """Rows of new keys are inserted; known ones stay as they are."""
        source, staged = self._source(source)
        version, folders = self._folders()
        if any(b in folders for b in staged):
            known = self._rows(folders, staged).select(*self.keys)
            crowded = {b for b in staged if len(folders.get(b, ())) >= MOST}
            if crowded or self._hashes(source).join(self._hashes(known), "hash", "left_semi").count():
                new = written(source.join(known, self.keys, "left_anti").select(*self.schema.names), "inserted")
                touched = self._numbers(new)
                staged = self._stage(new.unionByName(self._rows(folders, crowded & touched)), touched) if touched else {}
                folders = {b: f for b, f in folders.items() if b not in crowded & touched}
        if staged:
            self._publish(version, {b: [*folders.get(b, ()), *staged.get(b, ())] for b in {*folders, *staged}})

    def delete_where(self, condition: Column) -> None:
        self._rewrite(self._numbers(self.read().where(condition)), lambda rows: delete_where(rows, condition))

    def update_where(self, condition: Column, values: dict[str, Column]) -> None:
        """Keys must not be changed."""
        if set(values) & set(self.keys):
            raise ValueError("keys cannot be updated")
        self._rewrite(self._numbers(self.read().where(condition)), lambda rows: update_where(rows, condition, values))

    def _bucket(self, key: Column | None = None) -> Column:
        return F.pmod(F.xxhash64(*self.keys) if key is None else key, F.lit(self.buckets)).cast("int")

    def _hashes(self, rows: DataFrame, *more: Column) -> DataFrame:
        return rows.select(F.xxhash64(*self.keys).alias("hash"), *more)

    def _numbers(self, rows: DataFrame) -> set[int]:
        return {r[0] for r in rows.select(self._bucket()).distinct().collect()}

    def _manifests(self) -> DataFrame:
        return self.spark.read.schema(f"{_MANIFEST}, version int").parquet(f"{self.path}/manifest")

    def _folders(self, version: int | None = None) -> tuple[int, Folders]:
        version = self.version() if version is None else version
        folders: Folders = {}
        for r in self._manifests().where(F.col("version") == version).where("folder IS NOT NULL").orderBy("folder").collect():
            folders.setdefault(r["bucket"], []).append(r["folder"])
        return version, folders

    def _rows(self, folders: Folders, buckets: Iterable[int] | None = None) -> DataFrame:
        paths = [f"{self.path}/{f}" for b in (folders if buckets is None else buckets) for f in folders.get(b, ())]
        return self.spark.read.schema(self.schema).parquet(*paths) if paths else self.spark.createDataFrame([], self.schema)

    def _source(self, source: DataFrame) -> tuple[DataFrame, Folders]:
        """``source`` staged once, after a check of its keys: its rows, and the folders of the buckets they are in."""
        folder = self._write(source)
        source = self.spark.read.schema(self.schema).parquet(f"{self.path}/{folder}").select(*self.schema.names)
        missing = F.exists(F.array(*[F.col(k).isNull() for k in self.keys]), lambda x: x)
        # Keys of different hashes differ; only if a hash occurs twice are keys compared in full.
        counts = self._hashes(source, missing.alias("null")).groupBy("hash").agg(F.count(F.lit(1)).alias("n"), F.bool_or("null").alias("null"))
        most, null, buckets = counts.agg(F.max("n"), F.bool_or("null"), F.collect_set(self._bucket(F.col("hash")))).first()
        if (most or 0) > 1 and not null:
            most = source.groupBy(*self.keys).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0]
        if null:
            raise ValueError(f"a key ({', '.join(self.keys)}) is null")
        if (most or 0) > 1:
            raise ValueError(f"several rows for one key ({', '.join(self.keys)})")
        return source, {b: [f"{folder}/_bucket={b}"] for b in buckets}

    def _rewrite(self, touched: set[int], change: Callable[[DataFrame], DataFrame], full: set[int] | None = None) -> None:
        """``full``: the buckets that will have rows, if known."""
        if touched:
            version, folders = self._folders()
            staged = self._stage(change(self._rows(folders, touched)), full)
            self._publish(version, {**{b: f for b, f in folders.items() if b not in touched}, **staged})

    def _stage(self, rows: DataFrame, full: set[int] | None = None) -> Folders:
        """Write rows by bucket into a new folder: the buckets that have rows (``full``, if known), and where."""
        folder = self._write(rows)
        if full is None:
            staged = self.spark.read.schema("_bucket int").parquet(f"{self.path}/{folder}")
            full = {r[0] for r in staged.select("_bucket").distinct().collect()}
        return {b: [f"{folder}/_bucket={b}"] for b in full}

    def _write(self, rows: DataFrame) -> str:
        folder = f"data/{uuid.uuid4().hex}"
        rows = rows.select(*self.schema.names).withColumn("_bucket", self._bucket())
        rows = rows.repartition(F.col("_bucket"), F.pmod(F.xxhash64(F.lit(1), *self.keys), F.lit(SPREAD)))
        rows.write.partitionBy("_bucket").parquet(f"{self.path}/{folder}")
        return folder

    def _publish(self, version: int, folders: Folders) -> None:
        about = json.dumps({"schema": self.schema.jsonValue(), "keys": self.keys, "buckets": self.buckets})
        rows = [(b, f, about) for b in sorted(folders) for f in folders[b]] or [(-1, None, about)]
        manifest = self.spark.createDataFrame(rows, _MANIFEST).coalesce(1)
        manifest.write.mode("errorifexists").parquet(f"{self.path}/manifest/version={version + 1}")
