import itertools

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from casewarden.operators import acceptance as A
from casewarden.operators import evidence as E
from casewarden.operators import ledgers as L
from casewarden.operators import network as N
from casewarden.operators import routing as Q
from casewarden.plans import registry
from casewarden.plans.registry import QUERIES
from casewarden.sources import adapters as adapters_module
from casewarden.sources.adapters import Tables, adapters
from casewarden.sources.files import export_csv, parse_json_columns, read_csv_checked, read_csv_typed, read_export
from casewarden.storage import fresh_folder


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def scenario(spark):
    """A ring (case C1: five workers, a controller, a funnel, one device) and a benign pair (case C2)."""
    make = spark.createDataFrame
    homes = {"W1": "RO", "W2": "VN", "W3": "RO", "W4": "TH", "W5": "IN"}
    people = [(w, "INDIVIDUAL", w, "EMP-E", c, None) for w, c in homes.items()] + [(k, "INDIVIDUAL", k, "EMP-E", "AE", None) for k in "KF"]
    people += [("E", "CORPORATE", "Ring Ltd", "EMP-E", "AE", "CONSTRUCTION"), ("B", "CORPORATE", "Shop", "EMP-B", "AE", "RETAIL"), ("P", "INDIVIDUAL", "P", "EMP-B", "AE", None)]
    tx, n = [], itertools.count()
    for month in ("2024-01", "2024-02"):
        for i, w in enumerate(homes):
            tx += [("PAYROLL", f"{month}-25 08:00:00", "E", w, 152_000, None), ("TRANSFER", f"{month}-25 11:{5 * i:02d}:00", w, "K", 137_500, None)]
        tx += [("TRANSFER", f"{month}-25 18:00:00", "K", "F", 650_000, None), ("CASH_WITHDRAWAL", f"{month}-26 09:00:00", "F", None, 620_000, "TR")]
    tx += [("CARD", "2024-02-27 10:00:00", w, None, 4_000, None) for w in homes]
    tx += [("PAYROLL", "2024-01-25 08:00:00", "B", "P", 360_000, None), ("TRANSFER", "2024-01-26 11:00:00", "P", None, 85_000, None), ("CARD", "2024-01-27 08:00:00", "P", None, 12_800, None)]
    seen = [(a, "D1", "10.0.0.1", "SUCCESS") for a in (*homes, "K", "E")] + [("P", "D2", "10.0.0.2", "SUCCESS"), ("B", "D3", "10.0.0.3", "SUCCESS")]
    docs = [(f"DOC-{i}", "C1", ["late wage", "shared flat"], c) for i, c in enumerate((97, 91, 62, 94))] + [("DOC-9", "C2", [], 99)]
    return Tables({
        "accounts": make(people, "account_id string, account_type string, display_name string, employer_id string, country string, sector string"),
        "alerts": make([("C1", "E", "OPEN", "HIGH"), ("C2", "B", "OPEN", "MEDIUM")], "case_id string, account_id string, alert_status string, priority string"),
        "transactions": make([(f"T{next(n)}", k, t, a, b, c, z) for k, t, a, b, c, z in tx], "transaction_id string, transaction_type string, ts string, from_account_id string, to_account_id string, cents long, counterparty_country string").withColumn("ts", F.col("ts").cast("timestamp_ntz")),
        "signals": make([(f"S{i}", *s) for i, s in enumerate(seen)], "signal_id string, account_id string, device_id string, ip_address string, login_result string"),
        "kyc": make([("E", "INCOMPLETE", 40), ("B", "COMPLETE", 2)], "account_id string, owner_status string, declared_employee_count int"),
        "watchlist": make([("WL1", "K", "K", "HIGH", 90), ("WL2", "P", "P", "LOW", 10)], "watchlist_id string, matched_account_id string, entity_name string, risk_level string, match_strength int"),
        "documents": make([(d, c, r, p, "memo", i, "REVIEWED") for i, (d, c, r, p) in enumerate(docs)], "document_id string, case_id string, risk_indicators array<string>, confidence int, document_type string, uploaded_seq int, review_status string"),
    })


def test_ring_and_benign_pair_are_accepted(spark):
    t = scenario(spark)
    made = E.risk(t).join(E.signals(t).groupBy("case_id").agg(F.count_if("detected").alias("found")), "case_id")
    actual = A.values(made, "case_id", score=F.col("risk_score"), band=F.col("risk_band"), evidence=F.col("evidence_strength"), route=F.col("recommended_route"), signals=F.col("found"))
    expected = spark.createDataFrame([
        ("C1", "score", "92"), ("C1", "band", "CRITICAL"), ("C1", "evidence", "STRONG"), ("C1", "route", "ESCALATE_TO_SAR"), ("C1", "signals", "5"),
        ("C2", "band", "LOW"), ("C2", "route", "CLOSE_AS_FALSE_POSITIVE"),
    ], "subject string, check_name string, value string")
    got = A.reconcile(expected, actual.join(expected.select("subject", "check_name"), ["subject", "check_name"]))
    assert {r["status"] for r in got.collect()} == {"PASS"} and got.count() == 7
    docs = {r["case_id"]: (r["documents"], r["risky"], r["min_confidence"], r["reviewed"]) for r in E.document_points(t).collect()}
    assert docs == {"C1": (4, 4, 62, 4), "C2": (1, 0, 99, 1)}


def test_reconcile_shows_what_differs(spark):
    schema = "subject string, check_name string, value string"
    e = spark.createDataFrame([("a", "x", "1"), ("b", "x", "1"), ("c", "x", "1"), ("n", "x", None)], schema)
    a = spark.createDataFrame([("a", "x", "1"), ("b", "x", "2"), ("d", "x", "1"), ("n", "x", None)], schema)
    assert rows(A.reconcile(e, a)) == sorted([("a", "x", "1", "1", "PASS"), ("b", "x", "1", "2", "FAIL"), ("c", "x", "1", None, "FAIL"), ("d", "x", None, "1", "FAIL"), ("n", "x", None, None, "PASS")], key=repr)


@pytest.mark.parametrize(("name", "most"), [("risk_summary", 1), ("case_brief", 1), ("case_network", 1), ("read_transactions", 1), ("pipe_status", 1)])
def test_fact_table_is_scanned_once(spark, sf, monkeypatch, name, most):
    plans = []

    def note(df, label):
        plans.append(df._jdf.queryExecution().optimizedPlan().toString())
        return adapters_written(df, label)

    adapters_written = adapters_module.written
    monkeypatch.setattr(adapters_module, "written", note)
    df = QUERIES[name](spark, sf)
    plans.append(df._jdf.queryExecution().optimizedPlan().toString())
    assert sum(p.count("o_orderpriority") for p in plans) <= most  # a relation lists its columns
    assert plans[-1].count("Join") <= 4 and "Cartesian" not in plans[-1]


def test_pairs_of_a_hot_device_are_spread(spark):
    n = 2000
    hot = spark.range(n).select(F.lit("C").alias("case_id"), F.lit("D").alias("device_id"), F.lit("I").alias("ip_address"), F.format_string("A%05d", "id").alias("account_id"))
    small = spark.createDataFrame([("C", "E", "I", a) for a in "xyz"] + [("C2", "E", "I", "x"), ("C2", "E", "I", None)], "case_id string, device_id string, ip_address string, account_id string")
    pairs = N.pairs_within(hot.unionByName(small), ["case_id", "device_id", "ip_address"], "account_id", 128)
    got = pairs.groupBy("case_id", "device_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("source") >= F.col("target")).alias("bad"), F.sum(F.xxhash64("source", "target").cast("decimal(38,0)")).alias("sum"))
    assert {(r["case_id"], r["device_id"]): (r["n"], r["bad"]) for r in got.collect()} == {("C", "D"): (n * (n - 1) // 2, 0), ("C", "E"): (3, 0)}
    assert pairs.where("device_id = 'D'").distinct().count() == n * (n - 1) // 2
    plan = pairs._jdf.queryExecution().optimizedPlan().toString()
    assert "_low" in plan and "_high" in plan  # what rows meet by: 136 keys for the hot device


@pytest.mark.parametrize("tile", [1, 3, 100])
def test_pairs_equal_all_combinations(spark, tile):
    groups = {"g": 11, "h": 3, "i": 1, "j": 4}
    df = spark.createDataFrame([(g, f"{i:02d}") for g, n in groups.items() for i in range(n)], "g string, m string")
    want = [(g, f"{i:02d}", f"{j:02d}") for g, n in groups.items() for i, j in itertools.combinations(range(n), 2)]
    assert rows(N.pairs_within(df, ["g"], "m", tile)) == sorted(want, key=repr)


def test_export_round_trip_and_one_case_again(spark):
    texts = ['plain, "quoted"', "line\nend", "cr\r\nlf", "", None, " spaced ", "é", '"', "a\\b"]
    df = spark.createDataFrame([(f"C{i % 3}/x y", f"A{i:02d}", t) for i, t in enumerate(texts * 2)], "case_id string, audit_event_id string, event_detail string")
    df = df.withColumn("event_ts", F.expr("TIMESTAMP_NTZ '2024-01-01 00:00:00.123456' + make_dt_interval(0, int(substr(audit_event_id, 2)))"))
    path = fresh_folder(spark, "export")
    export_csv(df, path, "case_id", [F.col("event_ts").desc()])
    assert rows(read_export(spark, path, df.schema)) == rows(df)
    files = lambda: {r[0] for r in spark.read.schema(df.schema).csv(path).select(F.input_file_name()).distinct().collect()}
    before = files()
    again = df.where("case_id LIKE 'C1%'").withColumn("event_detail", F.lit("new"))
    export_csv(again, path, "case_id", [F.col("event_ts").desc()])
    assert rows(read_export(spark, path, df.schema)) == rows(df.where("case_id NOT LIKE 'C1%'").unionByName(again))
    assert {f for f in before if "C1" not in f} == {f for f in files() if "C1" not in f}


def test_bad_csv_rows_are_rejected_with_reasons(spark):
    path = fresh_folder(spark, "csv")
    lines = ["ID , Amount,note", "1,10,ok", "2,abc,bad", "3,,NULL", ",7,no id", "5,99999999999,too large", ' 6 , 8 ,"a ""q"""', "", "7,2.5,x"]
    spark.createDataFrame([(x,) for x in lines], "value string").coalesce(1).write.text(path)
    schema = StructType.fromDDL("id int not null, amount int, note string, missing date")
    got = {r["note"]: r["reasons"] for r in read_csv_checked(spark, path, schema).collect()}
    assert got == {"ok": [], "bad": ["amount: abc is no int"], None: [], "no id": ["id is missing"], "too large": ["amount: 99999999999 is no int"], 'a "q"': [], "x": ["amount: 2.5 is no int"]}
    assert rows(read_csv_typed(spark, path, schema)) == sorted([(1, 10, "ok", None), (3, None, None, None), (6, 8, 'a "q"', None)], key=repr)


def test_valid_rows_and_violations_come_from_one_check(spark):
    df = spark.createDataFrame([(1, "a", "x"), (2, "b", None), (2, "b", "x"), (None, "c", "x"), (None, "c", "x")], "id int, k string, v string")
    done = L.checked(df, ["v"], ["id", "k"])
    assert rows(L.valid_rows(done)) == [(1, "a", "x")]
    assert rows(L.violations(done, "k")) == sorted([("b", "v is missing"), ("b", "id, k occurs 2 times"), ("b", "id, k occurs 2 times"), ("c", "id is missing"), ("c", "id is missing")], key=repr)
    assert rows(L.valid_rows(L.checked(df.limit(0), ["v"], ["id"]))) == []


def test_json_columns_name_their_errors(spark):
    df = spark.createDataFrame([(1, '{"k": 3}', '["a"]'), (2, "{cut", '["b", "c"]'), (3, None, "[cut"), (4, "7", None)], "id int, o string, a string")
    got = parse_json_columns(df, {"o": "k int", "a": "array<string>"})
    assert {r["id"]: (r["o"] and r["o"]["k"], r["a"], r["errors"]) for r in got.collect()} == {1: (3, ["a"], []), 2: (None, ["b", "c"], ["o"]), 3: (None, None, ["a"]), 4: (None, None, ["o"])}


def test_links_need_object_type_and_actor(spark):
    d = spark.createDataFrame([("D1", "ann"), ("D2", "ann")], "decision_id string, reviewer_name string")
    audit = [("A1", "D1", "DECISION", "HUMAN", "ann"), ("A2", "D1", "NOTE", "HUMAN", "ann"), ("A3", "D1", "DECISION", "SYSTEM", "ann"), ("A4", "D2", "DECISION", "HUMAN", "bob")]
    a = spark.createDataFrame(audit, "audit_event_id string, object_id string, object_type string, actor_type string, actor_name string")
    assert rows(L.linked_decisions(d, a).select("decision_id", "audit_event_id")) == [("D1", "A1")]


def test_sound_traces(spark):
    tools = ", ".join(f'{{"type": "tool_use", "tool_use": {{"name": "{n}"}}}}' for n in Q.TOOLS)
    payload = lambda text: f'{{"status": "completed", "content": [{{"type": "text", "text": "{text}"}}, {tools}]}}'
    r = spark.createDataFrame([("a", payload("Score 92")), ("b", payload("The time limit was hit at 92")), ("c", payload("no number")), ("d", "{cut"), ("e", None)], "message_id string, payload string")
    got = {x["status"]: x for x in Q.trace_quality(r).collect()}
    c = got["completed"]
    assert (c["responses"], c["text_parts"], c["failure_texts"], c["score_mentions"], c["distinct_tools"], c["sound"]) == (3, 3, 1, 2, 5, 1)
    assert (got["malformed"]["responses"], got["malformed"]["without_text"], got["malformed"]["without_tools"]) == (2, 2, 2)


def test_transactions_of_one_scan_equal_their_kinds(spark, sf):
    kinds = {r["transaction_type"]: r["n"] for r in adapters(spark, sf)["transactions"].groupBy("transaction_type").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert set(kinds) == {"PAYROLL", "TRANSFER", "CARD", "CASH_WITHDRAWAL"} and kinds["PAYROLL"] == kinds["TRANSFER"]


def test_many_cases_are_listed_by_few_tasks(spark):
    n = 300
    df = spark.range(n).select(F.concat(F.lit("C"), "id").alias("case_id"), F.col("id").cast("string").alias("event_detail"))
    path = fresh_folder(spark, "export")
    export_csv(df, path, "case_id", [F.col("event_detail")])
    setting = "spark.sql.sources.parallelPartitionDiscovery.parallelism"
    usual, tracker = spark.conf.get(setting), spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("listing", "listing")
    try:
        got = read_export(spark, path, df.schema)
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    jobs = [tracker.getJobInfo(j) for j in tracker.getJobIdsForGroup("listing")]
    tasks = [tracker.getStageInfo(s).numTasks for j in jobs for s in j.stageIds]
    assert tasks and max(tasks) <= 4 * spark.sparkContext.defaultParallelism
    assert rows(got) == rows(df) and spark.conf.get(setting) == usual


def test_only_cases_that_are_asked_about_are_answered(spark, monkeypatch):
    t, answered = scenario(spark), {}
    t["messages"] = spark.createDataFrame([("M1", "C1", "USER", "x" * i) for i in range(8)] + [("M9", "C2", "ASSISTANT", "x")], "message_id string, case_id string, message_role string, message_text string")
    t["messages"] = t["messages"].withColumn("message_id", F.concat("message_id", F.length("message_text")))
    t["audit"] = t["transactions"].select(F.col("transaction_id").alias("audit_event_id"), F.lit("C1").alias("case_id"), F.col("ts").alias("event_ts"), F.col("transaction_type").alias("event_type"))
    want = rows(Q.synthesis(registry._questions(t), {n: a(t) for n, a in registry._ANSWERS.items()}))
    write = registry.written

    def note(df, name):
        answered[name] = write(df, name)
        return answered[name]

    monkeypatch.setattr(registry, "written", note)
    assert rows(registry.BUILD["answer_synthesis"](t)) == want and len(want) == 8
    cases = {name: {r["case_id"] for r in df.collect()} for name, df in answered.items() if name.startswith("answer_")}
    assert len(cases) == 5 and set(map(frozenset, cases.values())) == {frozenset({"C1"})}
