"""Questions routed by their terms to specialists, templated answers per case, traces of tool calls.

Answers are one row for each case, specialist and topic; a question only picks among them, so the
work on evidence does not grow with the number of questions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Terms that route a question, specialists in order.
TERMS = {
    "risk": ("score", "risk", "92", "critical", "points", "band"),
    "typology": (
        "typology", "typologies", "wage", "payroll", "harvest", "transaction", "spending", "amount", "payment", "geograph", "country", "location", "jurisdiction", "sector",
    ),
    "network": ("network", "connected", "controller", "account control", "shared device", "funnel", "cash-out"),
    "evidence": ("document", "watchlist", "adverse", "media", "evidence", "missing", "gap", "need next"),
    "brief": ("summary", "summarise", "summarize", "brief", "hypothesis", "suspicion", "action", "recommend", "decision", "sar", "what should"),
}
#: Topics of a specialist, first match; the last is for all other questions.
TOPICS = {
    "typology": ({"wage": ("wage", "payroll", "harvest"), "spending": ("transaction", "spending", "amount", "payment"), "geography": ("geograph", "country", "location", "jurisdiction")}, "general"),
    "evidence": ({"gap": ("missing", "gap", "more evidence", "need next")}, "review"),
    "brief": ({"action": ("action", "recommend", "decision", "sar", "what should"), "hypothesis": ("hypothesis", "suspicion")}, "summary"),
}
DEFAULT = ("risk", "brief")
#: Evidence tables that a specialist reads.
SOURCES = {"risk": "risk_summary", "typology": "all_signals", "network": "case_network", "evidence": "documents, watchlist", "brief": "case_brief"}


def _mentions(terms: tuple[str, ...]) -> Column:
    return F.coalesce(F.lower("question").rlike("|".join(terms)), F.lit(False))


def routed(questions: DataFrame, terms: dict[str, tuple[str, ...]] = TERMS) -> DataFrame:
    """questions (message_id, case_id, question) with ``routes``: specialists in fixed order."""
    found = F.array_compact(F.array(*[F.when(_mentions(words), F.lit(name)) for name, words in terms.items()]))
    return questions.withColumn("routes", F.when(F.size(found) > 0, found).otherwise(F.array(*[F.lit(n) for n in DEFAULT])))


def topic_of(specialist: str) -> Column:
    topics, rest = TOPICS.get(specialist, ({}, "all"))
    chosen = F.lit(rest)
    for name, words in reversed(topics.items()):
        chosen = F.when(_mentions(words), F.lit(name)).otherwise(chosen)
    return chosen


def topics(questions: DataFrame, specialist: str) -> DataFrame:
    """Questions routed to the specialist, with their topic."""
    return routed(questions).where(F.array_contains("routes", specialist)).select("message_id", topic_of(specialist).alias("topic"))


def _text(*parts: str | Column) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def _answers(df: DataFrame, by_topic: dict[str, Column]) -> DataFrame:
    rows = F.array(*[F.struct(F.lit(t).alias("topic"), a.alias("answer")) for t, a in by_topic.items()])
    return df.select("case_id", F.inline(rows))


def answer_risk(risk: DataFrame, components: list[str]) -> DataFrame:
    """Score, band, strength and route, with the components by points."""
    parts = F.array_sort(F.array(*[F.struct((-F.col(c)).alias("less"), F.lit(c.replace("_", " ")).alias("name")) for c in components]))
    shown = F.array_join(F.transform(parts, lambda p: _text(p["name"], " +", -p["less"])), "; ")
    answer = _text(F.col("case_id"), " scores ", F.col("risk_score"), "/100 (", F.col("risk_band"), "), evidence ", F.col("evidence_strength"), ": ", shown, ". Proposed: ", F.col("recommended_route"), ".")
    return _answers(risk, {"all": answer})


def answer_typology(alerts: DataFrame, signals: DataFrame, case_tx: DataFrame, countries: DataFrame) -> DataFrame:
    """Wage and spending points, the transactions in scope, their countries, all detected signals."""
    s = signals.where("detected").groupBy("case_id").agg(
        F.max(F.when(F.col("signal_type") == "WAGE_HARVESTING", F.col("points"))).alias("wage"),
        F.array_join(F.array_sort(F.collect_set(_text(F.col("signal_type"), " +", F.col("points")))), "; ").alias("listed"),
    )
    x = case_tx.groupBy("case_id").agg(F.count(F.lit(1)).alias("n"), F.sum("cents").alias("total"), F.max("cents").alias("most"))
    rows = alerts.select("case_id").join(s, "case_id", "left").join(x, "case_id", "left").join(countries, "case_id", "left")
    zero = F.lit(0)
    return _answers(rows, {
        "wage": _text("Wage harvesting adds ", F.coalesce("wage", zero), " points."),
        "spending": _text(F.coalesce("n", zero), " transactions, ", F.coalesce("total", zero), " cents in all, ", F.coalesce("most", zero), " at most."),
        "geography": _text("Countries: ", F.coalesce("countries", F.lit("none")), "."),
        "general": _text("Signals: ", F.coalesce("listed", F.lit("none")), "."),
    })


def case_countries(case_tx: DataFrame, tx: DataFrame) -> DataFrame:
    """Counterparty countries of a case's transactions, sorted."""
    known = tx.where("counterparty_country IS NOT NULL").select("transaction_id", "counterparty_country")
    c = case_tx.select("case_id", "transaction_id").join(known, "transaction_id").select("case_id", "counterparty_country").distinct()
    return c.groupBy("case_id").agg(F.array_join(F.array_sort(F.collect_list("counterparty_country")), ", ").alias("countries"))


def answer_network(alerts: DataFrame, summary: DataFrame, control: DataFrame) -> DataFrame:
    """Edges by kind, most frequent first, then who shares a login. summary: case_id, relationship_type, edges; control: account-control signals."""
    kinds = F.array_sort(F.collect_list(F.struct((-F.col("edges")).alias("less"), "relationship_type")))
    s = summary.groupBy("case_id").agg(F.sum("edges").alias("n"), F.array_join(F.transform(kinds, lambda k: _text(k["relationship_type"], " (", -k["less"], ")")), ", ").alias("kinds"))
    rows = alerts.select("case_id").join(s, "case_id", "left").join(control.select("case_id", "shared_accounts", "device_id", "ip_address", "detected"), "case_id", "left")
    shared = _text(F.col("shared_accounts"), " accounts log in from ", F.col("device_id"), " at ", F.col("ip_address"), ".")
    shown = F.when(F.col("detected"), shared).otherwise("No sign of common control.")
    return _answers(rows, {"all": _text(F.coalesce("n", F.lit(0)), " edges: ", F.coalesce("kinds", F.lit("none")), ". ", shown)})


def answer_evidence(brief: DataFrame, document_points: DataFrame, intelligence: DataFrame) -> DataFrame:
    """What is open, or what is on file: documents and how many are reviewed, list matches and how many are of high risk, the evidence."""
    rows = brief.select("case_id", "missing_evidence", "evidence_summary").join(document_points.select("case_id", "documents", "reviewed"), "case_id")
    rows = rows.join(intelligence.select("case_id", "matches", "high_hits"), "case_id")
    review = _text(F.col("documents"), " documents (", F.col("reviewed"), " reviewed), ", F.col("matches"), " list matches (", F.col("high_hits"), " of high risk). ", F.col("evidence_summary"))
    return _answers(rows, {"gap": _text("Open: ", F.col("missing_evidence")), "review": review})


def answer_brief(brief: DataFrame) -> DataFrame:
    return _answers(brief, {"action": _text(F.col("recommended_action"), " A reviewer decides."), "hypothesis": F.col("hypothesis"), "summary": F.col("executive_summary")})


def synthesis(questions: DataFrame, answers: dict[str, DataFrame]) -> DataFrame:
    """Per question: specialists, sources and their answers as sections, in the order of specialists."""
    q = routed(questions)
    asked = F.array(*[F.struct(F.lit(i).alias("place"), F.lit(n).alias("specialist"), topic_of(n).alias("topic")) for i, n in enumerate(TERMS)])
    asked = q.select("message_id", "case_id", F.inline(F.filter(asked, lambda a: F.array_contains("routes", a["specialist"]))))
    every = None
    for name, rows in answers.items():
        rows = rows.select("case_id", F.lit(name).alias("specialist"), "topic", "answer")
        every = rows if every is None else every.unionByName(rows)
    parts = asked.join(every, ["case_id", "specialist", "topic"])
    source = F.element_at(F.create_map(*[F.lit(x) for kv in SOURCES.items() for x in kv]), F.col("specialist"))
    g = parts.groupBy("message_id").agg(F.array_sort(F.collect_list(F.struct("place", "specialist", source.alias("source"), "answer"))).alias("p"))
    return g.select(
        "message_id", F.array_join("p.specialist", ", ").alias("specialists"), F.array_join(F.array_distinct("p.source"), ", ").alias("sources"),
        F.array_join(F.transform("p", lambda s: _text(s["specialist"], ": ", s["answer"])), "\n").alias("answer"),
    )


PAYLOAD = "status string, content array<struct<type: string, text: string, tool_use: struct<name: string>>>"
#: Tools and the specialist that each stands for.
TOOLS = {"risk_explanation": "risk", "typology_detection": "typology", "network_intelligence": "network", "evidence_review": "evidence", "case_brief": "brief"}


#: Phrases by which a text tells that its analysis failed.
FAILURES = ("cannot complete", "failed", "sql compilation error", "no valid data", "time limit", "analysis may be incomplete")


def tool_trace(responses: DataFrame) -> DataFrame:
    """responses (message_id, payload JSON) -> status, text parts, distinct tools in order, their specialists.

    A payload that is no JSON object has the status ``malformed`` and no parts.
    """
    p = responses.withColumn("o", F.from_json("payload", PAYLOAD, {"mode": "PERMISSIVE"}))
    parts = F.coalesce("o.content", F.expr("array()").cast("array<struct<type: string, text: string, tool_use: struct<name: string>>>"))
    texts = F.size(F.filter(parts, lambda c: (c["type"] == "text") & (F.length(c["text"]) > 0)))
    tools = F.array_distinct(F.filter(F.transform(parts, lambda c: c["tool_use"]["name"]), lambda n: n.isNotNull()))
    lookup = F.create_map(*[F.lit(x) for kv in TOOLS.items() for x in kv])
    return p.select("message_id", F.coalesce("o.status", F.lit("malformed")).alias("status"), texts.alias("text_parts"), tools.alias("t")).select(
        "message_id", "status", "text_parts", F.array_join("t", ", ").alias("tools"), F.array_join(F.transform("t", lambda n: F.element_at(lookup, n)), ", ").alias("specialists"),
    )


def trace_quality(responses: DataFrame, phrases: tuple[str, ...] = FAILURES, score: str = "92", expected: int = len(TOOLS)) -> DataFrame:
    """Per status: responses, their texts, texts that tell of a failure or name the score, tools, and sound responses.

    A response is sound if it is completed, has a text, called all ``expected`` tools, mentions the score and
    tells of no failure. Malformed payloads have no parts and are counted.
    """
    o = F.from_json("payload", PAYLOAD, {"mode": "PERMISSIVE"})
    parts = F.coalesce(F.col("o.content"), F.expr("array()").cast("array<struct<type: string, text: string, tool_use: struct<name: string>>>"))
    texts = F.filter(F.transform(F.filter("parts", lambda c: c["type"] == "text"), lambda c: c["text"]), lambda x: F.length(x) > 0)
    names = F.array_distinct(F.filter(F.transform("parts", lambda c: c["tool_use"]["name"]), lambda n: n.isNotNull()))
    r = responses.select(o.alias("o")).select(F.coalesce("o.status", F.lit("malformed")).alias("status"), parts.alias("parts")).select("status", texts.alias("texts"), names.alias("names"))
    failed = F.size(F.filter("texts", lambda x: F.lower(x).rlike("|".join(phrases))))
    scored = F.size(F.filter("texts", lambda x: x.contains(score)))
    r = r.select("status", "names", F.size("texts").alias("n"), failed.alias("failed"), scored.alias("scored"))
    sound = (F.col("status") == "completed") & (F.col("n") > 0) & (F.size("names") == expected) & (F.col("failed") == 0) & (F.col("scored") > 0)
    tools = F.array_sort(F.array_distinct(F.flatten(F.collect_set("names"))))
    return r.groupBy("status").agg(
        F.count(F.lit(1)).alias("responses"), F.sum("n").alias("text_parts"), F.count_if(F.col("n") == 0).alias("without_text"), F.count_if(F.size("names") == 0).alias("without_tools"),
        F.sum("failed").alias("failure_texts"), F.sum("scored").alias("score_mentions"), F.size(tools).alias("distinct_tools"), F.array_join(tools, ", ").alias("tools_used"), F.count_if(sound).alias("sound"),
    )
