import pytest
from pyspark.sql import functions as F

from casewarden.sources.keyed_table import MOST, KeyedTable
from casewarden.storage import fresh_folder

SCHEMA = "id int, v string, w int"


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


@pytest.fixture()
def table(spark):
    df = spark.createDataFrame([(i, f"v{i}", i % 3) for i in range(60)], SCHEMA)
    return KeyedTable.create(df, fresh_folder(spark, "table"), ["id"], buckets=8)


def test_merge_is_written_and_may_be_repeated(spark, table):
    new = spark.createDataFrame([(3, "new", None), (100, "more", 7)], SCHEMA)
    for _ in range(2):
        table.merge(new, ["v"])
        want = {i: (i, f"v{i}", i % 3) for i in range(60)} | {3: (3, "new", 0), 100: (100, "more", 7)}
        assert rows(KeyedTable.open(spark, table.path).read()) == sorted(want.values(), key=repr)
    table.merge(new)
    assert (3, "new", None) in rows(table.read()) and len(rows(table.read(0))) == 60 and table.version() == 3


def test_only_touched_buckets_are_written(spark, table):
    before = table._folders()[1]
    table.merge(spark.createDataFrame([(3, "x", 1)], SCHEMA))
    after = table._folders()[1]
    assert sum(before[b] != after[b] for b in before) == 1
    table.merge(spark.createDataFrame([], SCHEMA))
    assert table.version() == 1  # nothing to do, no version


def test_insert_adds_folders_and_packs_full_buckets(spark, table):
    for turn in range(MOST + 2):
        table.insert_absent(spark.createDataFrame([(i, "late", turn) for i in (0, 5, 1000 + turn)], SCHEMA))
    got = rows(table.read())
    assert len(got) == 60 + MOST + 2 and (0, "v0", 0) in got and (1001, "late", 1) in got
    assert max(map(len, table._folders()[1].values())) <= MOST
    version = table.version()
    table.insert_absent(spark.createDataFrame([(0, "late", 1)], SCHEMA))
    assert table.version() == version


def test_delete_and_update(spark, table):
    table.delete_where(F.col("w") == 1)
    table.update_where(F.col("id") >= 57, {"v": F.concat("v", F.lit("!")), "w": F.lit(None)})
    want = {(i, f"v{i}" + "!" * (i >= 57), None if i >= 57 else i % 3) for i in range(60) if i % 3 != 1}
    assert set(map(tuple, table.read().collect())) == want
    table.delete_where(F.lit(True))
    assert table.read().count() == 0 and KeyedTable.open(spark, table.path).schema == table.schema
    table.insert_absent(spark.createDataFrame([(1, "again", None)], SCHEMA))
    assert rows(table.read()) == [(1, "again", None)]
    with pytest.raises(ValueError, match="keys"):
        table.update_where(F.lit(True), {"id": F.lit(1)})


@pytest.mark.parametrize("bad", [[(1, "a", 1), (1, "b", 1)], [(None, "a", 1)]])
def test_keys_are_checked(spark, table, bad):
    for write in (table.merge, table.insert_absent):
        with pytest.raises(ValueError, match="key"):
            write(spark.createDataFrame(bad, SCHEMA))
    assert table.version() == 0


def test_failed_write_leaves_the_old_table(spark, table):
    want = rows(table.read())
    broken = spark.createDataFrame([(3, "x", 1)], SCHEMA)
    with pytest.raises(Exception, match="stop here"):  # the data are staged in part, or not at all
        table._rewrite({0, 1, 2, 3, 4, 5, 6, 7}, lambda old: old.unionByName(broken.withColumn("v", F.raise_error(F.lit("stop here")))))
    assert rows(table.read()) == want and table.version() == 0
    publish, table._publish = table._publish, lambda *a: (_ for _ in ()).throw(OSError("lost before the manifest"))
    with pytest.raises(OSError):
        table.merge(broken)
    assert rows(KeyedTable.open(spark, table.path).read()) == want
    table._publish = publish
    table.merge(broken)
    assert (3, "x", 1) in rows(table.read())


def test_second_writer_of_a_version_fails(spark, table):
    folders = table._folders()
    table.merge(spark.createDataFrame([(3, "x", 1)], SCHEMA))
    with pytest.raises(Exception, match="PATH_ALREADY_EXISTS|already exists"):
        table._publish(*folders)
    assert (3, "x", 1) in rows(table.read())


def test_new_rows_are_staged_once(spark, table, monkeypatch):
    writes, write = [], table._write
    monkeypatch.setattr(table, "_write", lambda rows: writes.append(1) or write(rows))
    table.insert_absent(spark.createDataFrame([(i, "more", 1) for i in range(100, 160)], SCHEMA))
    assert len(writes) == 1 and len(rows(table.read())) == 120
    table.insert_absent(spark.createDataFrame([(i, "late", 1) for i in range(150, 170)], SCHEMA))
    assert len(writes) == 3 and len(rows(table.read())) == 130 and (155, "more", 1) in rows(table.read())
