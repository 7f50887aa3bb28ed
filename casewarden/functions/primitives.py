"""Primitive predicates, joins, aggregates and scalar functions, one minimal query each."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

T = dict[str, DataFrame]
c = F.col

PRIMITIVES = {
    "flt_equality": lambda t: t["transactions"].where(c("transaction_type") == "CARD").select("transaction_id"),
    "flt_in_list": lambda t: t["accounts"].where(c("sector").isin("RETAIL", "FINANCE")).select("account_id", "sector"),
    "flt_not_equal_null_safe": lambda t: t["accounts"].where(c("sector") != "RETAIL").select("account_id"),
    "flt_null_checks": lambda t: t["transactions"].where(c("to_account_id").isNull() & c("counterparty_country").isNotNull()).select("transaction_id"),
    "flt_between_ts": lambda t: t["signals"].where("observed_at BETWEEN TIMESTAMP_NTZ '2024-01-05 00:00:00' AND TIMESTAMP_NTZ '2024-01-12 00:00:00'").select("signal_id"),
    "flt_point_lookup": lambda t: t["audit"].where(c("case_id") == "CASE-3").select("audit_event_id", "event_type"),
    "prj_constants_alias": lambda t: t["alerts"].select("case_id", F.lit("ALERT").alias("kind"), c("account_id").alias("subject")),
    "prj_ternary_null_false": lambda t: t["accounts"].select("account_id", F.when(c("sector") == "RETAIL", 1).otherwise(0).alias("is_retail")),
    "prj_case_searched": lambda t: t["transactions"].select("transaction_id", F.when(c("cents") >= 20_000_000, "L").when(c("cents") >= 5_000_000, "M").otherwise("S").alias("size")),
    "prj_case_simple": lambda t: t["decisions"].select(
        "decision_id", F.expr("CASE decision WHEN 'MONITOR_CASE' THEN 'watch' WHEN 'ESCALATE_TO_SAR' THEN 'report' ELSE 'other' END").alias("step")
    ),
    "join_inner_equi": lambda t: t["alerts"].join(t["kyc"], "account_id").select("case_id", "owner_status"),
    "join_multi_key": lambda t: t["signals"].where("login_result = 'FAILURE'").select("device_id", "ip_address").distinct()
    .join(t["signals"].where("login_result = 'SUCCESS'").select("device_id", "ip_address", "account_id").distinct(), ["device_id", "ip_address"]),
    "join_left_outer": lambda t: t["accounts"].join(t["watchlist"], c("account_id") == c("matched_account_id"), "left").select("account_id", c("watchlist_id").isNotNull().alias("listed")),
    "join_self_employer": lambda t: t["accounts"].where("account_type = 'CORPORATE'").select(c("account_id").alias("employer"), "employer_id")
    .join(t["accounts"].select(c("account_id").alias("worker"), "employer_id"), "employer_id").select("employer", "worker"),
    "join_semi_in_subquery": lambda t: t["accounts"].join(
        t["transactions"].select(c("from_account_id").alias("account_id")).union(t["watchlist"].select("matched_account_id")).distinct(), "account_id", "left_semi"
    ).select("account_id"),
    "join_anti_not_exists": lambda t: t["accounts"].join(t["transactions"].select(c("from_account_id").alias("account_id")), "account_id", "left_anti").select("account_id"),
    "join_coalesced_key": lambda t: t["transactions"].select("transaction_id", F.coalesce("to_account_id", "from_account_id").alias("account_id"))
    .join(t["accounts"], "account_id").select("transaction_id", "country"),
    "agg_count_sum_group": lambda t: t["transactions"].groupBy("transaction_type").agg(F.count(F.lit(1)).alias("n"), F.sum("cents").alias("cents")),
    "agg_count_distinct": lambda t: t["signals"].groupBy("ip_address").agg(F.count_distinct("account_id").alias("accounts"), F.count_distinct("device_id").alias("devices")),
    "agg_conditional_sum": lambda t: t["transactions"].groupBy("from_account_id").agg(F.sum(F.when(c("transaction_type").isin("TRANSFER", "CARD"), c("cents")).otherwise(0)).alias("cents")),
    "agg_count_if": lambda t: t["documents"].groupBy("document_type").agg(F.count_if(c("confidence") < 50).alias("low")),
    "agg_ratio_safe": lambda t: t["transactions"].groupBy("from_account_id").agg(
        F.round(F.sum(F.when(c("transaction_type") == "CARD", c("cents")).otherwise(0)).cast("double") / F.nullif(F.sum("cents"), F.lit(0)), 3).alias("ratio")
    ),
    "agg_avg_of_ratio": lambda t: t["transactions"].groupBy("transaction_type", "from_account_id").agg((F.max("cents").cast("double") / F.nullif(F.sum("cents"), F.lit(0))).alias("r"))
    .groupBy("transaction_type").agg(F.round(F.avg("r"), 4).alias("avg_ratio")),
    "agg_pivot_conditional_max": lambda t: t["transactions"].groupBy("from_account_id").agg(
        *[F.max(F.when(c("transaction_type") == k, c("cents"))).alias(k.lower()) for k in ("PAYROLL", "TRANSFER", "CARD")]
    ),
    "agg_min_max": lambda t: t["documents"].groupBy("case_id").agg(F.min("confidence").alias("lowest"), F.max("document_type").alias("last_type")),
    "agg_any_value": lambda t: t["signals"].groupBy("account_id").agg(F.max_by("device_id", F.struct("observed_at", "signal_id")).alias("last_device")),
    "agg_array_distinct_sorted": lambda t: t["accounts"].groupBy("employer_id").agg(F.array_join(F.array_sort(F.collect_set("country")), ",").alias("countries")),
    "agg_array_of_objects_ordered": lambda t: t["watchlist"].groupBy("matched_account_id").agg(
        F.to_json(F.transform(F.array_sort(F.collect_list(F.struct("watchlist_id", "risk_level"))), lambda x: F.struct(x["watchlist_id"].alias("id"), x["risk_level"].alias("level")))).alias("rows")
    ),
    "agg_listagg_ordered": lambda t: t["watchlist"].groupBy("risk_level").agg(F.expr("listagg(watchlist_id, ';') WITHIN GROUP (ORDER BY watchlist_id)").alias("ids")),
    "agg_listagg_distinct": lambda t: t["accounts"].groupBy("account_type").agg(F.expr("listagg(DISTINCT country, ',') WITHIN GROUP (ORDER BY country)").alias("countries")),
    "agg_bool_or": lambda t: t["signals"].groupBy("account_id").agg(F.bool_or(c("login_result") == "FAILURE").alias("failed")),
    "agg_scalar_subqueries": lambda t: t["transactions"].agg(
        F.count_if(c("transaction_type") == "PAYROLL").alias("wages"), F.count_distinct("from_account_id").alias("payers"), F.max("cents").alias("largest")
    ),
    "agg_distinct_rows": lambda t: t["signals"].select("account_id", "device_id").distinct(),
    "agg_value_counts": lambda t: t["documents"].select(F.explode("risk_indicators").alias("indicator")).groupBy("indicator").agg(F.count(F.lit(1)).alias("n")),
    "sort_nulls_last": lambda t: t["accounts"].select("account_id", "sector").orderBy(c("sector").desc_nulls_last(), "account_id"),
    "sort_multi_key": lambda t: t["watchlist"].select("risk_level", "match_strength", "watchlist_id").orderBy(c("risk_level").desc(), c("match_strength").desc(), "watchlist_id"),
    "set_union_distinct": lambda t: t["alerts"].select("account_id").union(t["watchlist"].select("matched_account_id")).distinct(),
    "set_union_all": lambda t: t["alerts"].select(F.lit("alert").alias("kind"), c("case_id").alias("id")).unionByName(t["watchlist"].select(F.lit("list").alias("kind"), c("watchlist_id").alias("id"))),
    "fn_string_concat": lambda t: t["accounts"].select("account_id", F.concat(c("sector"), F.lit("/"), c("country")).alias("place")),
    "fn_string_case": lambda t: t["messages"].select("message_id", F.lower("message_role").alias("low"), F.upper("session_id").alias("up")),
    "fn_string_replace": lambda t: t["decisions"].select("decision_id", F.initcap(F.replace("decision", F.lit("_"), F.lit(" "))).alias("shown")),
    "fn_string_split_list": lambda t: t["documents"].select("document_id", F.size(F.split(F.nullif(F.array_join("risk_indicators", ","), F.lit("")), ",")).alias("n")),
    "fn_string_like": lambda t: t["messages"].where(F.lower("message_text").contains("th")).select("message_id"),
    "fn_ts_format": lambda t: t["signals"].select("signal_id", F.date_format("observed_at", "yyyy-MM-dd HH:mm").alias("shown")),
    "fn_ts_add_diff": lambda t: t["signals"].groupBy("account_id").agg(F.min("observed_at").alias("first"), F.max("observed_at").alias("last")).select(
        "account_id", F.expr("last + INTERVAL 24 HOURS").alias("until"), F.expr("datediff(last, first)").alias("days"),
        F.expr("timestampdiff(HOUR, date_trunc('HOUR', first), date_trunc('HOUR', last))").alias("hours"),
    ),
    "fn_math_round_least": lambda t: t["transactions"].select("transaction_id", F.round(c("cents").cast("double") / 700, 2).alias("r"), F.least(F.lit(100_000), "cents").alias("capped")),
    "fn_array_size_guard": lambda t: t["documents"].select("document_id", (F.size("risk_indicators") > 0).alias("risky")),
    "fn_array_compact": lambda t: t["accounts"].select("account_id", F.array_join(F.array_compact(F.array("sector", "country")), "|").alias("known")),
    "fn_array_join": lambda t: t["documents"].select("document_id", F.array_join("risk_indicators", ", ").alias("text")),
    "fn_object_build": lambda t: t["accounts"].select("account_id", F.to_json(F.struct("sector", "country")).alias("j")),
    "fn_object_build_keep_null": lambda t: t["accounts"].select("account_id", F.to_json(F.struct("sector", "country"), {"ignoreNullFields": "false"}).alias("j")),
    "fn_json_path": lambda t: t["audit"].select("audit_event_id", F.get_json_object("event_metadata", "$.k").alias("k")),
    "fn_json_try_parse": lambda t: t["audit"].select("audit_event_id", F.from_json(F.when(c("actor_type") == "HUMAN", F.lit("{bad")).otherwise(c("event_metadata")), "k int").alias("o"))
    .select("audit_event_id", c("o.k").alias("k")),
    "fn_json_flatten": lambda t: t["audit"].select("audit_event_id", F.posexplode(F.from_json(F.concat(F.lit("["), c("event_metadata"), F.lit(","), c("event_metadata"), F.lit("]")), "array<struct<k: int>>")))
    .select("audit_event_id", c("pos").alias("i"), c("col.k").alias("k")),
    "fn_deterministic_id": lambda t: t["alerts"].select("case_id", F.concat(F.lit("RISK-"), c("case_id"), F.lit("-V1")).alias("id"), F.sha2(F.concat("case_id", F.lit("|"), "account_id"), 256).alias("key")),
    "fn_cast": lambda t: t["transactions"].select("transaction_id", c("cents").cast("string").alias("s"), F.substring("transaction_id", 4, 99).cast("bigint").alias("n")),
    "apply_defaults": lambda t: t["transactions"].select("transaction_id", F.coalesce("counterparty_country", F.lit("N0")).alias("country"), F.coalesce("to_account_id", F.lit("NONE")).alias("target")),
    "sort_breakdown": lambda t: t["transactions"].groupBy("from_account_id").agg(F.sum("cents").alias("all_cents"), F.count(F.lit(1)).alias("n"))
    .select("from_account_id", F.explode(F.create_map(F.lit("all_cents"), c("all_cents"), F.lit("n"), c("n"))).alias("factor", "points")),
}
