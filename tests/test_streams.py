import pytest
from pyspark.sql import functions as F

from casewarden.operators import detectors as D
from casewarden.plans import incremental
from casewarden.plans.registry import QUERIES
from casewarden.sources.adapters import adapters
from casewarden.storage import fresh_folder
from casewarden.streaming.changes import capture, captured, dedupe_stream, file_stream, onward_stream
from casewarden.streaming.pipeline import TransactionPipeline

TX = "transaction_id string, transaction_type string, ts string, from_account_id string, to_account_id string, cents long, counterparty_country string"


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def add(spark, path, data):
    """One more file of transactions."""
    df = spark.createDataFrame(data, TX).withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    df.coalesce(1).write.mode("append").parquet(path)
    return df.schema


def wage(i, at, who="W"):
    return (f"P{i}", "PAYROLL", at, "E", who, 100, None)


def move(i, at, who="W"):
    return (f"M{i}", "TRANSFER", at, who, "K", 90, None)


def state_rows(progress):
    return sum(s["numRowsTotal"] for s in progress[-1]["stateOperators"])


@pytest.fixture()
def folders(spark):
    return fresh_folder(spark, "in"), fresh_folder(spark, "home")


@pytest.fixture()
def alerts(spark):
    return spark.createDataFrame([("C1", "E")], "case_id string, account_id string")


def test_capture_is_resumed(spark, folders):
    path, home = folders
    schema = add(spark, path, [wage(1, "2024-01-01 08:00:00"), wage(2, "2024-01-01 09:00:00")])
    run = lambda: rows(capture(file_stream(spark, path, schema), home).select("transaction_id"))
    assert run() == [("P1",), ("P2",)]
    assert run() == []
    add(spark, path, [wage(3, "2024-01-02 08:00:00")])
    assert run() == [("P3",)] and run() == []
    assert rows(captured(spark, home, schema).select("transaction_id")) == [("P1",), ("P2",), ("P3",)]


def test_failed_batch_is_given_again(spark, folders):
    path, home = folders
    schema = add(spark, path, [wage(1, "2024-01-01 08:00:00")])
    broken = file_stream(spark, path, schema).select(F.when(F.col("cents") > 0, F.raise_error(F.lit("lost"))).cast("string").alias("transaction_id"))
    with pytest.raises(Exception, match="lost"):
        capture(broken, home)
    assert rows(capture(file_stream(spark, path, schema).select("transaction_id"), home)) == [("P1",)]


def test_dedupe_forgets_and_asks_the_ledger(spark, folders):
    path, home = folders
    schema = add(spark, path, [wage(i % 50, "2024-01-01 08:00:00") for i in range(100)])
    ledger = spark.createDataFrame([(f"P{i}",) for i in range(0, 60, 10)], "transaction_id string")

    def run():
        progress = []
        stream = file_stream(spark, path, schema, 1).withColumn("at", F.col("ts").cast("timestamp"))
        got = capture(dedupe_stream(stream, ["transaction_id"], "at", "1 day", ledger).drop("at"), home, progress)
        return rows(got.select("transaction_id")), state_rows(progress)

    assert run() == (rows(spark.createDataFrame([(f"P{i}",) for i in range(50) if i % 10], "v string")), 50)
    add(spark, path, [wage(i, "2024-01-01 20:00:00") for i in range(40, 52)])  # repeats within the span, and two more
    got, held = run()
    assert got == [("P51",)] and held == 52
    add(spark, path, [wage(99, "2024-01-09 08:00:00")])
    got, held = run()
    assert got == [("P99",)] and held == 1  # the first day's keys are forgotten
    add(spark, path, [wage(3, "2024-01-01 08:00:00"), wage(99, "2024-01-09 08:00:00")])
    assert run() == ([], 1)  # a repeat from long ago is late


def test_window_edges_and_state(spark, folders, alerts):
    path, home = folders
    times = ("2024-01-01 10:29:59", "2024-01-01 10:30:00", "2024-01-02 10:30:00", "2024-01-02 10:30:01")
    schema = add(spark, path, [wage(1, "2024-01-01 10:30:00")])
    run = lambda p: rows(capture(onward_stream(alerts, file_stream(spark, path, schema)), home, p).select("transfer_id", "hours"))
    assert run([]) == []
    add(spark, path, [move(i, t) for i, t in enumerate(times)])
    progress = []
    assert run(progress) == [("M1", 0), ("M2", 24)]
    assert state_rows(progress) >= 5
    add(spark, path, [(k, k, "2024-01-05 00:00:00", "NOBODY", "NOBODY", 1, None) for k in ("PAYROLL", "TRANSFER")])
    assert run(progress) == []
    assert state_rows(progress) == 2  # all spans have passed; only the last transfer is kept, on its two days


def test_late_rows_do_not_pair(spark, folders, alerts):
    path, home = folders
    schema = add(spark, path, [wage(1, "2024-01-01 10:00:00"), wage(2, "2024-01-03 10:00:00"), move(9, "2024-01-03 10:00:00", "Z")])
    run = lambda: rows(capture(onward_stream(alerts, file_stream(spark, path, schema), delay="2 hours", how="left"), home).select("payroll_id", "transfer_id"))
    assert run() == [("P1", None)]  # the watermark, two hours behind, has passed P1's span
    add(spark, path, [move(1, "2024-01-01 12:00:00"), move(2, "2024-01-03 12:00:00"), move(3, "2024-01-03 09:00:00")])
    assert run() == [("P2", "M2")]
    add(spark, path, [wage(3, "2024-01-09 10:00:00"), move(8, "2024-01-09 10:00:00", "Z")])
    assert run() == []  # P2 had a partner, P3 is open


def test_streams_equal_the_batch_join(spark, sf, folders):
    path, home = folders
    t = adapters(spark, sf)
    t["transactions"].repartitionByRange(5, "ts").write.parquet(path)
    stream = file_stream(spark, path, t["transactions"].schema)
    got = rows(capture(onward_stream(t["alerts"], stream), home))
    assert got == rows(D.onward_transfers(t["alerts"], t["transactions"])) and got


def pipeline(spark, home):
    accounts = spark.createDataFrame([(a,) for a in ("ACC-E", "ACC-W", "ACC-V", "ACC-K")], "account_id string")
    cases = spark.createDataFrame([("CASE-1", "ACC-E", "OPEN")], "case_id string, account_id string, alert_status string")
    ledger = "processing_event_id string, transaction_id string, case_id string, account_id string, processed_at timestamp_ntz, processing_status string"
    audit = "audit_event_id string, case_id string, event_ts timestamp_ntz, event_type string, object_id string"
    old = spark.createDataFrame([("PRC-OLD-CASE-1", "OLD", "CASE-1", "ACC-E", None, "PROCESSED")], ledger)
    return accounts, TransactionPipeline.create(home, accounts, cases, old, spark.createDataFrame([], audit))


FIRST = [("T1", "PAYROLL", "2024-01-01 08:00:00", "ACC-E", "ACC-W", 5, None), ("OLD", "PAYROLL", "2024-01-01 08:00:00", "ACC-E", "ACC-W", 5, None), ("T2", "TRANSFER", "2024-01-01 09:00:00", "ACC-W", "ACC-K", 4, None)]
SECOND = [("T2", "TRANSFER", "2024-01-01 09:00:00", "ACC-W", "ACC-K", 4, None), ("T3", "CASH", "2024-01-02 08:00:00", None, "ACC-V", 3, None), ("T4", "CARD", "2024-01-02 08:00:00", "ACC-W", None, 1, None), ("T5", "CARD", "2024-01-02 09:00:00", "UNKNOWN", None, 1, None)]


def state(p):
    return {n: rows(p.read(n).drop("batch")) for n in ("cases", "ledger", "audit")}


def test_batches_replay_and_restart_equal_one_batch(spark, folders):
    path, home = folders
    schema = add(spark, path, FIRST)
    accounts, p = pipeline(spark, home)
    p.run(file_stream(spark, path, schema))
    add(spark, path, SECOND)
    TransactionPipeline.open(home, accounts).run(file_stream(spark, path, schema))  # a restart
    stored = state(p)
    assert rows(p.read("summary")) == [(0, 2, "Processed 2 new transaction(s)."), (1, 2, "Processed 2 new transaction(s).")]
    assert [r[0] for r in stored["cases"]] == ["CASE-1", "CASE-AUTO-V", "CASE-AUTO-W"]
    assert [r[1] for r in stored["ledger"]] == ["OLD", "T1", "T2", "T3", "T4"] and len(stored["audit"]) == 4
    replay = spark.createDataFrame(SECOND, TX).withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    versions = {n: t.version() for n, t in p.tables.items() if n != "summary"}
    p.step(replay, 1)
    assert state(p) == stored and {n: t.version() for n, t in p.tables.items() if n != "summary"} == versions
    assert rows(p.read("summary"))[1][1] == 2
    p.run(file_stream(spark, path, schema))
    assert state(p) == stored

    other = fresh_folder(spark, "once")
    _, once = pipeline(spark, other)
    once.run(file_stream(spark, path, schema))
    assert state(once) == stored and rows(once.read("summary")) == [(0, 4, "Processed 4 new transaction(s).")]


def test_step_that_fails_half_way_is_finished(spark, folders, monkeypatch):
    path, home = folders
    schema = add(spark, path, FIRST)
    accounts, p = pipeline(spark, home)
    audit = p.tables["audit"]
    monkeypatch.setattr(audit, "insert_absent", lambda rows: (_ for _ in ()).throw(OSError("lost")))
    with pytest.raises(Exception, match="lost"):
        p.run(file_stream(spark, path, schema))
    assert len(rows(p.read("ledger"))) == 3 and rows(p.read("audit")) == []
    again = TransactionPipeline.open(home, accounts)
    again.run(file_stream(spark, path, schema))
    assert len(rows(again.read("ledger"))) == 3 and len(rows(again.read("audit"))) == 2
    assert rows(again.read("summary")) == [(0, 2, "Processed 2 new transaction(s).")]


def test_deliveries_are_many_files_of_one_batch(spark, sf, monkeypatch):
    tx = adapters(spark, sf)["transactions"]
    want, size = tx.count(), 200
    monkeypatch.setattr(incremental, "FILE_ROWS", size)
    path, files = incremental._delivered(spark, tx, 2)
    held = [r["n"] for r in spark.read.parquet(path).groupBy(F.input_file_name()).agg(F.count(F.lit(1)).alias("n")).collect()]
    assert sum(held) == want and files == -(-want // (2 * size)) and max(held) <= 2 * size
    p = incremental.processed(spark, sf, 2)
    assert 1 < p.read("summary").count() <= 2 + (len(held) > 2 * files)
    assert rows(incremental._by_case(p)) == rows(QUERIES["stream_new_transactions"](spark, sf))
