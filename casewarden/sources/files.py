"""File sources and sinks under the shared folder."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructType

#: What an export is written and read with: times keep their microseconds, texts their spaces.
_AS_IS = {
    "header": True, "escape": '"', "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False,
    "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS", "timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX",
}
#: Stands for quoted empty text while it is read, to tell it from null.
_EMPTY = "\ue000"
#: Exports are committed by their tasks (into a staging folder, so an export that fails changes nothing), and have no
#: ``.crc`` files where the folder is a local one: with them, each small file costs two.
_COMMIT = {"mapreduce.fileoutputcommitter.algorithm.version": "2", "fs.file.impl": "org.apache.hadoop.fs.RawLocalFileSystem", "fs.file.impl.disable.cache": "true"}
#: Tasks for each core that list the folders of an export; Spark's default is one for each folder, up to 10,000.
LISTING_TASKS = 4
#: Rows of one case that a file of an export holds at most.
FILE_ROWS = 1_000_000


def overwrite_table(df: DataFrame, path: str) -> DataFrame:
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def append_table(df: DataFrame, path: str) -> DataFrame:
    df.write.mode("append").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.option("header", True).option("escape", '"').csv(path)


def export_csv(df: DataFrame, path: str, by: str, order: list[Column]) -> None:
    """A folder for each value of ``by``, with CSV files in UTF-8 with a header; folders of other values stay.

    Rows are sorted within a file. A value of more than ``FILE_ROWS`` rows has several files and tasks.
    """
    files = df.groupBy(by).agg(F.ceil(F.count(F.lit(1)) / FILE_ROWS).alias("_files"))
    dealt = df.join(files, by, "left")
    own = [c for c in df.columns if c != by]
    dealt = dealt.withColumn("_file", F.pmod(F.xxhash64(*own), F.coalesce("_files", F.lit(1)))).repartition(by, "_file").sortWithinPartitions(by, "_file", *order)
    out = dealt.select(*df.columns).write.mode("overwrite").partitionBy(by).option("partitionOverwriteMode", "dynamic")
    out.options(**_AS_IS, **_COMMIT).option("encoding", "UTF-8").csv(path)


def read_export(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """The rows of ``export_csv``, line ends, quotes and spaces inside fields included."""
    setting = "spark.sql.sources.parallelPartitionDiscovery.parallelism"
    usual = spark.conf.get(setting)
    spark.conf.set(setting, LISTING_TASKS * spark.sparkContext.defaultParallelism)
    try:  # folders are listed here, files read later
        rows = spark.read.schema(schema).options(**_AS_IS).option("multiLine", True).option("emptyValue", _EMPTY).csv(path)
    finally:
        spark.conf.set(setting, usual)
    text = lambda c: F.when(F.col(c) == _EMPTY, "").otherwise(F.col(c)).alias(c)
    return rows.select(*[text(f.name) if isinstance(f.dataType, StringType) else f.name for f in schema.fields])


def read_csv_checked(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """Typed columns of the CSV at ``path``, then ``reasons``: what is wrong with a row, none for good rows.

    Columns are found by name, any case; blank and NULL are null, and so is a column that the file does
    not have. A value that its type does not take is null with a reason, and so is a null in a column
    that must not be null. One bad value costs its row, never the job.
    """
    raw = spark.read.option("header", True).option("escape", '"').option("multiLine", True)
    raw = raw.option("ignoreLeadingWhiteSpace", True).option("ignoreTrailingWhiteSpace", True).csv(path)
    by_name = {c.strip().lower(): c for c in raw.columns}
    values, reasons = [], []
    for f in schema.fields:
        found = by_name.get(f.name.lower())
        text = F.lit(None).cast("string") if found is None else F.nullif(F.nullif(F.trim(F.col(f"`{found}`")), F.lit("")), F.lit("NULL"))
        value = text if isinstance(f.dataType, StringType) else text.try_cast(f.dataType)
        values.append(value.alias(f.name))
        reasons.append(F.when(text.isNotNull() & value.isNull(), F.concat(F.lit(f"{f.name}: "), text, F.lit(f" is no {f.dataType.simpleString()}"))))
        if not f.nullable:
            reasons.append(F.when(text.isNull(), F.lit(f"{f.name} is missing")))
    return raw.select(*values, F.array_compact(F.array(*reasons).cast("array<string>")).alias("reasons"))


def read_csv_typed(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """The good rows of ``read_csv_checked``."""
    return read_csv_checked(spark, path, schema).where(F.size("reasons") == 0).drop("reasons")


def parse_json_columns(df: DataFrame, schemas: dict[str, str]) -> DataFrame:
    """Text columns parsed to the given types (structs, maps or arrays); ``errors`` names those of a row that are no such JSON."""
    parsed, errors = {}, []
    for name, kind in schemas.items():
        bad = F.lit(False)
        if kind.lstrip().lower().startswith(("array", "map")):
            value = F.from_json(name, kind)
            bad = value.isNull()
        else:
            read = F.from_json(name, f"{kind}, _bad string", {"columnNameOfCorruptRecord": "_bad"})
            bad = read["_bad"].isNotNull()
            value = F.when(~bad, read.dropFields("_bad"))
        parsed[name] = value
        errors.append(F.when(F.col(name).isNotNull() & bad, F.lit(name)))
    return df.withColumn("errors", F.array_compact(F.array(*errors).cast("array<string>"))).withColumns(parsed)
