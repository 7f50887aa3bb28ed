"""Evidence tables derived from the supplied tables by integer arithmetic.

Money is BIGINT cents; times are timestamps without zone. The number of employers is a scalar
subquery inside each plan, never a driver-side count.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from casewarden.storage import written

#: Sectors by supplier number, and decision codes by order priority.
SECTORS = ("CONSTRUCTION", "RETAIL", "HOSPITALITY", "FINANCE", "LABOUR_SERVICES", "AGRICULTURE")
EPOCH = "TIMESTAMP_NTZ '2024-01-01 00:00:00'"

_SQL = {
    "accounts": """
SELECT concat('ACC-C-', s_suppkey) AS account_id, 'CORPORATE' AS account_type, s_name AS display_name,
  concat('EMP-', s_suppkey) AS employer_id, concat('N', s_nationkey) AS country,
  element_at(array({sectors}), int(s_suppkey % 6) + 1) AS sector FROM {supplier}
UNION ALL
SELECT concat('ACC-I-', c_custkey), 'INDIVIDUAL', c_name, concat('EMP-', c_custkey % {S}), concat('N', c_nationkey), cast(null AS string)
FROM {customer}""",
    "alerts": """
SELECT concat('CASE-', s_suppkey) AS case_id, concat('ACC-C-', s_suppkey) AS account_id, 'OPEN' AS alert_status,
  CASE WHEN s_suppkey % 3 = 0 THEN 'HIGH' ELSE 'MEDIUM' END AS priority FROM {supplier}""",
    "transactions": """
WITH o AS (
  SELECT o_orderkey AS k, o_custkey AS c, o_custkey % {S} AS emp, cast(round(o_totalprice * 100) AS bigint) AS cents,
    o_orderdate AS ts, {S} AS s FROM {orders}
), every AS (SELECT stack(4,
  k % 3 = 0 AND emp % 13 <> 7, concat('TP-', k), 'PAYROLL', ts, concat('ACC-C-', emp), concat('ACC-I-', c), cents, cast(null AS string),
  k % 3 = 0 AND emp % 13 <> 7, concat('TT-', k), 'TRANSFER', ts + make_dt_interval(0, int(k % 37)), concat('ACC-I-', c),
    concat('ACC-I-', CASE WHEN c < s THEN s + emp ELSE emp END),
    CASE WHEN emp % 3 = 0 THEN cents * (75 + k % 20) div 100 ELSE cents * (30 + k % 40) div 100 END, cast(null AS string),
  k % 3 = 1, concat('TC-', k), 'CARD', ts, concat('ACC-I-', c), cast(null AS string), CASE WHEN emp % 4 = 0 THEN cents ELSE cents div 20 END, cast(null AS string),
  k % 3 = 2 AND (k div 3) % 4 = 0 AND emp % 5 <> 1, concat('TW-', k), 'CASH_WITHDRAWAL', ts, concat('ACC-I-', c), cast(null AS string), cents div 4, concat('N', k % 25)
  ) AS (kept, transaction_id, transaction_type, ts, from_account_id, to_account_id, cents, counterparty_country) FROM o)
SELECT transaction_id, transaction_type, ts, from_account_id, to_account_id, cents, counterparty_country FROM every WHERE kept""",
    "signals": """
SELECT event_id AS signal_id, concat('ACC-I-', user_id) AS account_id, ts AS observed_at,
  CASE WHEN user_id % 2 = 0 THEN concat('DEV-S', user_id % 10) ELSE concat('DEV-P', user_id) END AS device_id,
  concat('10.0.0.', user_id % 10) AS ip_address, CASE WHEN event_type = 'error' THEN 'FAILURE' ELSE 'SUCCESS' END AS login_result
FROM {events}""",
    "kyc": """
SELECT concat('ACC-C-', s_suppkey) AS account_id, CASE WHEN s_suppkey % 7 = 0 THEN 'COMPLETE' ELSE 'INCOMPLETE' END AS owner_status,
  s_suppkey % 50 AS declared_employee_count FROM {supplier}""",
    "watchlist": """
SELECT concat('WL-', p_partkey) AS watchlist_id, concat('ACC-C-', (p_partkey div 10) % {S}) AS matched_account_id, p_name AS entity_name,
  CASE WHEN p_size <= 10 THEN 'HIGH' WHEN p_size <= 30 THEN 'MEDIUM' ELSE 'LOW' END AS risk_level, p_size AS match_strength
FROM {part} WHERE p_partkey % 10 = 0""",
    "documents": """
SELECT concat('DOC-', d.doc_id) AS document_id, concat('CASE-', d.doc_id % {S}) AS case_id,
  array_compact(array(CASE WHEN l.toxic = 1 THEN 'toxic_text' END, CASE WHEN l.quality = 0 THEN 'low_quality' END,
    CASE WHEN d.n_chars < 200 THEN 'short_document' END)) AS risk_indicators,
  d.n_chars % 100 AS confidence, d.lang AS document_type, d.doc_id AS uploaded_seq, CASE WHEN d.doc_id % 3 = 0 THEN 'REVIEWED' ELSE 'PENDING' END AS review_status
FROM {documents} d LEFT JOIN {labels} l ON d.doc_id = l.doc_id""",
    "messages": """
SELECT concat('MSG-', conv_id, '-', turn) AS message_id, concat('CASE-', conv_id % {S}) AS case_id, concat('SES-', conv_id) AS session_id,
  {epoch} + make_dt_interval(0, 0, int(conv_id * 7 + turn)) AS message_ts, upper(role) AS message_role, text AS message_text,
  concat('actor-', conv_id % 5) AS actor_name, CASE WHEN role = 'assistant' THEN 'risk_summary,case_network' ELSE '' END AS sources
FROM {conversations}""",
    "decisions": """
SELECT concat('DEC-', o_orderkey) AS decision_id, concat('CASE-', o_custkey % {S}) AS case_id,
  CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 'ESCALATE_TO_SAR' WHEN '2' THEN 'REQUEST_MORE_EVIDENCE' WHEN '3' THEN 'MONITOR_CASE'
    WHEN '5' THEN 'CLOSE_AS_FALSE_POSITIVE' ELSE 'AUTO_FILE_SAR' END AS decision,
  CASE WHEN o_orderkey % 11 = 0 THEN ' ' ELSE concat('reviewer-', o_custkey % 9) END AS reviewer_name,
  CASE WHEN o_orderkey % 17 = 0 THEN null ELSE concat('rationale ', o_orderkey) END AS rationale, o_orderdate AS decided_at, o_orderkey AS decision_seq
FROM {orders}""",
    "audit": """
SELECT concat('AUD-', event_id) AS audit_event_id, concat('CASE-', user_id % {S}) AS case_id, ts AS event_ts,
  CASE WHEN event_id % 3 = 0 THEN 'HUMAN' ELSE 'SYSTEM' END AS actor_type, concat('actor-', user_id % 5) AS actor_name,
  upper(event_type) AS event_type, concat('value ', cast(cast(round(value * 100) AS bigint) AS string)) AS event_detail, props AS event_metadata FROM {events}""",
    "executions": """
SELECT concat('EXE-', conv_id, '-', turn) AS execution_id, concat('CASE-', conv_id % {S}) AS case_id,
  element_at(array('risk', 'Typology', 'network', 'evidence', 'brief', 'orchestrator', 'unknown_agent'), int((conv_id + turn) % 7) + 1) AS agent_name,
  {epoch} + make_dt_interval(0, 0, int(conv_id * 7 + turn)) AS executed_at, concat('REQ-', conv_id) AS request_id, concat('SES-', conv_id) AS session_id,
  concat('turn ', turn, ' by ', role) AS routing_reason, text AS agent_response, CASE WHEN turn % 3 = 0 THEN '' ELSE 'case_network,documents' END AS sources FROM {conversations}""",
}


class Tables(dict[str, DataFrame]):
    """Evidence tables by name, and what was computed from them for one run."""

    def __init__(self, tables: dict[str, DataFrame]):
        super().__init__(tables)
        self.made: dict[str, DataFrame] = {}

    def once(self, name: str, build: Callable[[], DataFrame]) -> DataFrame:
        """The result of ``build``, written at first use and read from then on."""
        if name not in self.made:
            self.made[name] = written(build(), name)
        return self.made[name]


def adapters(spark: SparkSession, sf_dir: str) -> Tables:
    """The evidence tables by name."""
    names = "supplier customer orders events part documents labels conversations".split()
    paths = {n: f"parquet.`{sf_dir}/{n}.parquet`" for n in names}
    fixed = {"S": f"(SELECT count(*) FROM {paths['supplier']})", "epoch": EPOCH, "sectors": ", ".join(f"'{s}'" for s in SECTORS)}
    return Tables({name: spark.sql(sql.format(**paths, **fixed)) for name, sql in _SQL.items()})


def supplied(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")
