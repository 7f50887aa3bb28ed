"""DuckDB SQL that checks the registered queries, written from their behaviour."""

from __future__ import annotations

_TABLES = r"""
accounts AS (
  SELECT 'ACC-C-' || s_suppkey AS account_id, 'CORPORATE' AS account_type, s_name AS display_name, 'EMP-' || s_suppkey AS employer_id,
    'N' || s_nationkey AS country, ['CONSTRUCTION', 'RETAIL', 'HOSPITALITY', 'FINANCE', 'LABOUR_SERVICES', 'AGRICULTURE'][CAST(s_suppkey % 6 + 1 AS INT)] AS sector FROM supplier
  UNION ALL SELECT 'ACC-I-' || c_custkey, 'INDIVIDUAL', c_name, 'EMP-' || (c_custkey % (SELECT count(*) FROM supplier)), 'N' || c_nationkey, NULL FROM customer),
alerts AS (SELECT 'CASE-' || s_suppkey AS case_id, 'ACC-C-' || s_suppkey AS account_id, 'OPEN' AS alert_status, CASE WHEN s_suppkey % 3 = 0 THEN 'HIGH' ELSE 'MEDIUM' END AS priority, s_suppkey AS k FROM supplier),
o AS (SELECT o_orderkey AS k, o_custkey AS c, (SELECT count(*) FROM supplier) AS s, o_custkey % (SELECT count(*) FROM supplier) AS emp, CAST(round(o_totalprice * 100) AS BIGINT) AS cents, o_orderdate AS ts FROM orders),
tx AS (
  SELECT 'TP-' || k AS transaction_id, 'PAYROLL' AS transaction_type, ts, 'ACC-C-' || emp AS from_account_id, 'ACC-I-' || c AS to_account_id, cents, CAST(NULL AS VARCHAR) AS counterparty_country, k FROM o WHERE k % 3 = 0 AND emp % 13 <> 7
  UNION ALL SELECT 'TT-' || k, 'TRANSFER', ts + to_hours(CAST(k % 37 AS INT)), 'ACC-I-' || c, 'ACC-I-' || (CASE WHEN c < s THEN s + emp ELSE emp END),
    CASE WHEN emp % 3 = 0 THEN cents * (75 + k % 20) // 100 ELSE cents * (30 + k % 40) // 100 END, NULL, k FROM o WHERE k % 3 = 0 AND emp % 13 <> 7
  UNION ALL SELECT 'TC-' || k, 'CARD', ts, 'ACC-I-' || c, NULL, CASE WHEN emp % 4 = 0 THEN cents ELSE cents // 20 END, NULL, k FROM o WHERE k % 3 = 1
  UNION ALL SELECT 'TW-' || k, 'CASH_WITHDRAWAL', ts, 'ACC-I-' || c, NULL, cents // 4, 'N' || (k % 25), k FROM o WHERE k % 3 = 2 AND (k // 3) % 4 = 0 AND emp % 5 <> 1),
sig AS (SELECT event_id AS signal_id, 'ACC-I-' || user_id AS account_id, ts AS observed_at, CASE WHEN user_id % 2 = 0 THEN 'DEV-S' || (user_id % 10) ELSE 'DEV-P' || user_id END AS device_id,
  '10.0.0.' || (user_id % 10) AS ip_address, CASE WHEN event_type = 'error' THEN 'FAILURE' ELSE 'SUCCESS' END AS login_result FROM events),
kyc AS (SELECT 'ACC-C-' || s_suppkey AS account_id, CASE WHEN s_suppkey % 7 = 0 THEN 'COMPLETE' ELSE 'INCOMPLETE' END AS owner_status, s_suppkey % 50 AS declared_employee_count FROM supplier),
watch AS (SELECT 'WL-' || p_partkey AS watchlist_id, 'ACC-C-' || ((p_partkey // 10) % (SELECT count(*) FROM supplier)) AS matched_account_id, p_name AS entity_name,
  CASE WHEN p_size <= 10 THEN 'HIGH' WHEN p_size <= 30 THEN 'MEDIUM' ELSE 'LOW' END AS risk_level, p_size AS match_strength FROM part WHERE p_partkey % 10 = 0),
docs AS (SELECT 'DOC-' || d.doc_id AS document_id, 'CASE-' || (d.doc_id % (SELECT count(*) FROM supplier)) AS case_id,
  list_filter([CASE WHEN l.toxic = 1 THEN 'toxic_text' END, CASE WHEN l.quality = 0 THEN 'low_quality' END, CASE WHEN d.n_chars < 200 THEN 'short_document' END], lambda x: x IS NOT NULL) AS ind,
  d.n_chars % 100 AS confidence, d.lang AS document_type, d.doc_id AS uploaded_seq, CASE WHEN d.doc_id % 3 = 0 THEN 'REVIEWED' ELSE 'PENDING' END AS review_status FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id),
msgs AS (SELECT 'MSG-' || conv_id || '-' || turn AS message_id, 'CASE-' || (conv_id % (SELECT count(*) FROM supplier)) AS case_id, 'SES-' || conv_id AS session_id,
  TIMESTAMP '2024-01-01' + to_minutes(CAST(conv_id * 7 + turn AS INT)) AS message_ts, upper(role) AS message_role, text AS message_text, 'actor-' || (conv_id % 5) AS actor_name, CASE WHEN role = 'assistant' THEN 'risk_summary|case_network' ELSE '' END AS source_objects FROM conversations),
decs AS (SELECT 'DEC-' || o_orderkey AS decision_id, 'CASE-' || (o_custkey % (SELECT count(*) FROM supplier)) AS case_id,
  CASE o_orderpriority[1] WHEN '1' THEN 'ESCALATE_TO_SAR' WHEN '2' THEN 'REQUEST_MORE_EVIDENCE' WHEN '3' THEN 'MONITOR_CASE' WHEN '5' THEN 'CLOSE_AS_FALSE_POSITIVE' ELSE 'AUTO_FILE_SAR' END AS decision,
  CASE WHEN o_orderkey % 11 = 0 THEN ' ' ELSE 'reviewer-' || (o_custkey % 9) END AS reviewer_name, CASE WHEN o_orderkey % 17 = 0 THEN NULL ELSE 'rationale ' || o_orderkey END AS rationale,
  o_orderdate AS decided_at, o_orderkey AS decision_seq FROM orders),
vdecs AS (SELECT * FROM decs WHERE decision <> 'AUTO_FILE_SAR' AND reviewer_name <> ' ' AND rationale IS NOT NULL),
aud AS (SELECT 'AUD-' || event_id AS audit_event_id, 'CASE-' || (user_id % (SELECT count(*) FROM supplier)) AS case_id, ts AS event_ts, CASE WHEN event_id % 3 = 0 THEN 'HUMAN' ELSE 'SYSTEM' END AS actor_type,
  'actor-' || (user_id % 5) AS actor_name, upper(event_type) AS event_type, 'value ' || CAST(round(value * 100) AS BIGINT) AS event_detail, props AS event_metadata FROM events),
wrk AS (SELECT DISTINCT case_id, to_account_id AS worker_id FROM alerts JOIN tx ON from_account_id = account_id WHERE transaction_type = 'PAYROLL'),
onw AS (SELECT a.case_id, p.to_account_id AS worker_id, m.to_account_id AS controller_id, p.transaction_id AS payroll_id, m.transaction_id AS transfer_id, p.cents AS payroll_cents, m.cents AS transfer_cents,
  date_diff('hour', p.ts, m.ts) AS hours, m.ts - p.ts AS gap FROM alerts a JOIN tx p ON p.from_account_id = a.account_id AND p.transaction_type = 'PAYROLL'
  JOIN tx m ON m.from_account_id = p.to_account_id AND m.transaction_type = 'TRANSFER' AND m.ts BETWEEN p.ts AND p.ts + INTERVAL 24 HOUR),
s1 AS (SELECT *, workers >= 3 AND ratio >= 0.70 AS detected, CASE WHEN workers >= 3 AND ratio >= 0.70 THEN 25 ELSE 0 END AS points FROM (
  SELECT case_id, count(DISTINCT worker_id) AS workers, count(DISTINCT controller_id) AS controllers, round(CAST(sum(transfer_cents) AS DOUBLE) / sum(payroll_cents), 3) AS ratio, round(avg(hours), 1) AS avg_hours FROM onw GROUP BY 1)),
grp AS (SELECT device_id, ip_address, count(DISTINCT account_id) AS shared_accounts FROM sig WHERE login_result = 'SUCCESS' GROUP BY 1, 2),
s2 AS (SELECT *, shared_accounts >= 4 AS detected, CASE WHEN shared_accounts >= 4 THEN 25 ELSE 0 END AS points FROM (
  SELECT a.case_id, g.shared_accounts, g.device_id, g.ip_address, row_number() OVER (PARTITION BY a.case_id ORDER BY g.shared_accounts DESC, g.device_id DESC, g.ip_address DESC) AS r
  FROM alerts a JOIN accounts e ON e.account_id = a.account_id JOIN accounts w ON w.employer_id = e.employer_id JOIN sig s ON s.account_id = w.account_id JOIN grp g ON g.device_id = s.device_id AND g.ip_address = s.ip_address) WHERE r = 1),
flow AS (SELECT case_id, worker_id, CAST(sum(CASE WHEN transaction_type IN ('TRANSFER', 'CASH_WITHDRAWAL') THEN cents ELSE 0 END) AS BIGINT) AS moved_cents,
  CAST(sum(CASE WHEN transaction_type = 'CARD' THEN cents ELSE 0 END) AS BIGINT) AS card_cents, CAST(sum(cents) AS BIGINT) AS outgoing_cents FROM wrk JOIN tx ON from_account_id = worker_id GROUP BY 1, 2),
s3 AS (SELECT *, anomalous >= 3 AS detected, CASE WHEN anomalous >= 3 THEN 14 ELSE 0 END AS points FROM (SELECT case_id, count(*) FILTER (CAST(moved_cents AS DOUBLE) / outgoing_cents >= 0.8) AS anomalous,
  round(avg(CAST(moved_cents AS DOUBLE) / outgoing_cents), 3) AS avg_moved, round(avg(CAST(card_cents AS DOUBLE) / outgoing_cents), 3) AS avg_everyday FROM flow GROUP BY 1)),
ctl AS (SELECT DISTINCT case_id, to_account_id AS account_id FROM wrk JOIN tx ON from_account_id = worker_id WHERE transaction_type = 'TRANSFER'),
mem AS (SELECT case_id, worker_id AS account_id FROM wrk UNION SELECT * FROM ctl UNION SELECT case_id, to_account_id FROM ctl JOIN tx ON from_account_id = account_id WHERE transaction_type = 'TRANSFER'),
home AS (SELECT case_id, country AS employer_country FROM alerts JOIN accounts USING (account_id)),
corr AS (SELECT DISTINCT case_id, employer_country, country AS worker_country FROM home JOIN wrk USING (case_id) JOIN accounts ON account_id = worker_id WHERE country <> employer_country),
fcash AS (SELECT case_id, count(*) AS foreign_cash FROM mem JOIN tx ON from_account_id = account_id JOIN home USING (case_id) WHERE transaction_type = 'CASH_WITHDRAWAL' AND counterparty_country <> employer_country GROUP BY 1),
s4 AS (SELECT *, countries >= 3 AND foreign_cash >= 1 AS detected, CASE WHEN countries >= 3 AND foreign_cash >= 1 THEN 12 ELSE 0 END AS points FROM (SELECT case_id, count(DISTINCT worker_country) AS countries,
  string_agg(DISTINCT worker_country, ',' ORDER BY worker_country) AS country_list, coalesce(any_value(foreign_cash), 0) AS foreign_cash FROM corr LEFT JOIN fcash USING (case_id) GROUP BY 1)),
s5 AS (SELECT case_id, sector, owner_status, declared_employee_count, hit AS detected, CASE WHEN hit THEN 8 ELSE 0 END AS points FROM (SELECT case_id, sector, owner_status, declared_employee_count,
  sector IN ('CONSTRUCTION', 'AGRICULTURE', 'HOSPITALITY', 'LABOUR_SERVICES') AND owner_status <> 'COMPLETE' AS hit FROM alerts JOIN accounts USING (account_id) JOIN kyc USING (account_id))),
sigs AS (SELECT case_id, 'WAGE_HARVESTING' AS signal_type, detected, points FROM s1 UNION ALL SELECT case_id, 'ACCOUNT_CONTROL', detected, points FROM s2 UNION ALL SELECT case_id, 'SPENDING_ANOMALY', detected, points FROM s3
  UNION ALL SELECT case_id, 'GEOGRAPHIC_RISK', detected, points FROM s4 UNION ALL SELECT case_id, 'SECTOR_RISK', detected, points FROM s5),
e1 AS (SELECT case_id, from_account_id AS source, to_account_id AS target, 'PAYROLL' AS relationship_type, count(*) AS event_count, CAST(sum(cents) AS BIGINT) AS total_cents FROM alerts JOIN tx ON from_account_id = account_id WHERE transaction_type = 'PAYROLL' GROUP BY 1, 2, 3),
e2 AS (SELECT m.case_id, m.account_id AS source, coalesce(to_account_id, 'EXTERNAL_CASH') AS target, CASE WHEN transaction_type = 'CASH_WITHDRAWAL' THEN 'CASH_OUT' WHEN c.account_id IS NOT NULL THEN 'CONSOLIDATION' ELSE 'FUNDS_TO_CONTROLLER' END AS relationship_type,
  count(*) AS event_count, CAST(sum(cents) AS BIGINT) AS total_cents FROM mem m JOIN tx ON from_account_id = m.account_id LEFT JOIN ctl c ON c.case_id = m.case_id AND c.account_id = m.account_id WHERE transaction_type IN ('CASH_WITHDRAWAL', 'TRANSFER') GROUP BY ALL),
ms AS (SELECT DISTINCT case_id, account_id, device_id, ip_address FROM mem JOIN sig USING (account_id)),
e3 AS (SELECT DISTINCT a.case_id, a.account_id AS source, b.account_id AS target, 'SHARED_DEVICE_IP' AS relationship_type, CAST(1 AS BIGINT) AS event_count, CAST(0 AS BIGINT) AS total_cents FROM ms a JOIN ms b USING (case_id, device_id, ip_address) WHERE a.account_id < b.account_id),
net AS (SELECT * FROM e1 UNION ALL SELECT * FROM e2 UNION ALL SELECT * FROM e3),
nod AS (SELECT case_id, source AS account_id FROM net UNION SELECT case_id, target FROM net),
ent AS (SELECT case_id, account_id FROM alerts UNION SELECT * FROM nod),
typ AS (SELECT a.case_id, CAST(coalesce(sum(points), 0) AS BIGINT) AS total, count(signal_type) AS detected_count, CAST(coalesce(max(points) FILTER (signal_type = 'WAGE_HARVESTING'), 0) AS INT) AS wage_harvesting,
  CAST(coalesce(max(points) FILTER (signal_type = 'ACCOUNT_CONTROL'), 0) AS INT) AS account_control, CAST(coalesce(max(points) FILTER (signal_type = 'SPENDING_ANOMALY'), 0) AS INT) AS spending_anomaly,
  CAST(coalesce(max(points) FILTER (signal_type = 'GEOGRAPHIC_RISK'), 0) AS INT) AS geographic_risk, CAST(coalesce(max(points) FILTER (signal_type = 'SECTOR_RISK'), 0) AS INT) AS sector_risk
  FROM alerts a LEFT JOIN (SELECT * FROM sigs WHERE detected) g ON g.case_id = a.case_id GROUP BY 1),
intel AS (SELECT a.case_id, count(w.watchlist_id) AS matches, count(w.watchlist_id) FILTER (w.risk_level = 'HIGH') AS high_hits, CASE WHEN count(w.watchlist_id) FILTER (w.risk_level = 'HIGH') > 0 THEN 4 ELSE 0 END AS points
  FROM alerts a LEFT JOIN (ent JOIN watch w ON w.matched_account_id = ent.account_id) ON ent.case_id = a.case_id GROUP BY 1),
dpt AS (SELECT a.case_id, count(DISTINCT document_id) AS documents, count(*) FILTER (len(ind) > 0) AS risky, min(confidence) AS min_confidence, count(*) FILTER (review_status = 'REVIEWED') AS reviewed, CASE WHEN count(*) FILTER (len(ind) > 0) >= 3 THEN 4 ELSE 0 END AS points FROM alerts a LEFT JOIN docs d ON d.case_id = a.case_id GROUP BY 1),
rsk AS (SELECT case_id, risk_score, CASE WHEN risk_score >= 90 THEN 'CRITICAL' WHEN risk_score >= 70 THEN 'HIGH' WHEN risk_score >= 40 THEN 'MEDIUM' ELSE 'LOW' END AS risk_band,
  CASE WHEN detected_count >= 4 AND high_hits > 0 AND risky >= 3 THEN 'STRONG' WHEN detected_count >= 2 AND (high_hits > 0 OR risky > 0) THEN 'MODERATE' ELSE 'LIMITED' END AS evidence_strength,
  CASE WHEN risk_score >= 90 THEN 'ESCALATE_TO_SAR' WHEN risk_score >= 70 THEN 'REQUEST_MORE_EVIDENCE' WHEN risk_score >= 40 THEN 'MONITOR_CASE' ELSE 'CLOSE_AS_FALSE_POSITIVE' END AS recommended_route,
  concat_ws('; ', CASE WHEN wage_harvesting > 0 THEN 'wage harvesting' END, CASE WHEN account_control > 0 THEN 'account control' END, CASE WHEN spending_anomaly > 0 THEN 'spending anomaly' END, CASE WHEN geographic_risk > 0 THEN 'geographic risk' END,
    CASE WHEN sector_risk > 0 THEN 'sector risk' END, CASE WHEN intelligence > 0 THEN 'intelligence' END, CASE WHEN document > 0 THEN 'document' END) AS factors,
  CAST(wage_harvesting AS BIGINT) AS wage_harvesting, CAST(account_control AS BIGINT) AS account_control, CAST(spending_anomaly AS BIGINT) AS spending_anomaly, CAST(geographic_risk AS BIGINT) AS geographic_risk, CAST(sector_risk AS BIGINT) AS sector_risk,
  intelligence, document, 'additive-v1' AS scoring_version FROM (SELECT typ.*, high_hits, risky, CAST(intel.points AS BIGINT) AS intelligence, CAST(dpt.points AS BIGINT) AS document, least(100, total + intel.points + dpt.points) AS risk_score FROM typ JOIN intel USING (case_id) JOIN dpt USING (case_id))),
stext AS (SELECT case_id, string_agg(signal_type || ' (' || points || ' points)', chr(10) ORDER BY points DESC, signal_type) AS signal_text FROM sigs WHERE detected GROUP BY 1),
etext AS (SELECT case_id, string_agg(document_id || ': ' || array_to_string(ind, ', ') || ' [' || confidence || ']', chr(10) ORDER BY document_id) AS evidence_text FROM docs GROUP BY 1),
miss AS (SELECT case_id, CASE WHEN documents = 0 THEN 'No documents are on file.' WHEN min_confidence < 75 THEN 'A document was read with low confidence; verify identity.' ELSE 'Ownership records and interviews are open.' END AS missing_evidence FROM dpt),
tline AS (SELECT case_id, string_agg(strftime(event_ts, '%Y-%m-%d %H:%M') || ' ' || event_type, chr(10) ORDER BY event_ts, audit_event_id) AS timeline FROM aud GROUP BY 1),
brief AS (SELECT case_id, display_name || ' scores ' || risk_score || '/100 (' || lower(risk_band) || ').' AS executive_summary,
  CASE WHEN risk_score >= 90 THEN 'Organised exploitation is likely.' ELSE 'Evidence does not yet support one explanation.' END AS hypothesis, coalesce(signal_text, 'No signal detected.') AS evidence_summary, missing_evidence,
  CASE recommended_route WHEN 'ESCALATE_TO_SAR' THEN 'Prepare a report for review.' WHEN 'REQUEST_MORE_EVIDENCE' THEN 'Ask for more evidence.' WHEN 'MONITOR_CASE' THEN 'Keep the case under watch.' ELSE 'Close after a second look.' END AS recommended_action,
  coalesce(timeline, 'No events.') AS timeline FROM alerts JOIN accounts USING (account_id) JOIN rsk USING (case_id) LEFT JOIN stext USING (case_id) LEFT JOIN miss USING (case_id) LEFT JOIN tline USING (case_id)),
prc AS (SELECT 'PRC-' || transaction_id || '-' || case_id AS processing_event_id, transaction_id, case_id, account_id, ts AS processed_at, 'PROCESSED' AS processing_status, tx.k FROM tx JOIN accounts ON account_id = from_account_id JOIN alerts USING (account_id) WHERE tx.k % 5 <> 0),
ncase AS (SELECT case_id, account_id, false AS opened FROM alerts WHERE k % 2 = 0
  UNION ALL SELECT DISTINCT 'CASE-AUTO-' || replace(a.account_id, 'ACC-', ''), a.account_id, true FROM tx JOIN accounts a ON a.account_id = from_account_id WHERE a.account_id NOT IN (SELECT account_id FROM alerts WHERE k % 2 = 0)),
nprc AS (SELECT 'PRC-' || transaction_id || '-' || case_id AS processing_event_id, transaction_id, case_id, account_id, ts AS processed_at, 'PROCESSED' AS processing_status, tx.k, opened FROM tx JOIN ncase ON account_id = from_account_id),
ctx AS (SELECT DISTINCT case_id, transaction_id, transaction_type, cents, from_account_id, to_account_id FROM alerts JOIN tx ON to_account_id = account_id
  UNION SELECT case_id, transaction_id, transaction_type, cents, from_account_id, to_account_id FROM (SELECT case_id, account_id FROM alerts UNION SELECT case_id, source FROM net) x JOIN tx ON from_account_id = x.account_id)
"""

_BODY = {
    "src_parquet_adapters": "SELECT * EXCLUDE (k) FROM tx",
    "onward_transfers": "SELECT * EXCLUDE (gap) FROM onw",
    "join_interval": "SELECT payroll_id, transfer_id FROM onw WHERE gap <= INTERVAL 12 HOUR",
    "shared_access": "SELECT device_id, ip_address, account_id, shared_accounts FROM (SELECT DISTINCT device_id, ip_address, account_id FROM sig WHERE login_result = 'SUCCESS') JOIN grp USING (device_id, ip_address)",
    "sig_wage_harvesting": "SELECT * FROM s1", "sig_account_control": "SELECT * EXCLUDE (r) FROM s2", "sig_spending_anomaly": "SELECT * FROM s3",
    "sig_geographic_risk": "SELECT * FROM s4", "sig_sector_risk": "SELECT * FROM s5", "worker_flows": "SELECT * FROM flow", "network_members": "SELECT * FROM mem",
    "corridors": "SELECT * FROM corr", "foreign_cash": "SELECT * FROM fcash", "edges_payroll": "SELECT * FROM e1", "edges_onward": "SELECT * FROM e2",
    "edges_shared_access": "SELECT * FROM e3", "case_network": "SELECT * FROM net", "case_entities": "SELECT * FROM ent", "all_signals": "SELECT * FROM sigs",
    "typology_points": "SELECT * FROM typ", "intelligence_points": "SELECT * FROM intel", "document_points": "SELECT * FROM dpt", "risk_summary": "SELECT * FROM rsk",
    "node_roles": """SELECT n.case_id, n.account_id, CASE WHEN a.case_id IS NOT NULL THEN 'Primary employer' WHEN n.account_id = 'EXTERNAL_CASH' OR t.ts @> ['CASH_OUT'] THEN 'Cash-out' WHEN t.ts @> ['CONSOLIDATION'] THEN 'Funnel'
      WHEN t.ts @> ['FUNDS_TO_CONTROLLER'] THEN 'Controller' WHEN t.ts @> ['PAYROLL'] THEN 'Worker' ELSE 'Connected' END AS role FROM nod n LEFT JOIN alerts a ON a.case_id = n.case_id AND a.account_id = n.account_id
      LEFT JOIN (SELECT case_id, target, list(DISTINCT relationship_type) AS ts FROM net GROUP BY 1, 2) t ON t.case_id = n.case_id AND t.target = n.account_id""",
    "node_labels": "SELECT case_id, n.account_id, CASE WHEN n.account_id = 'EXTERNAL_CASH' THEN 'Cash withdrawals' ELSE coalesce(display_name, n.account_id) END AS label FROM nod n LEFT JOIN accounts a ON a.account_id = n.account_id",
    "network_summary": "SELECT case_id, relationship_type, count(*) AS edges, CAST(sum(total_cents) AS BIGINT) AS total_cents FROM net GROUP BY 1, 2",
    "brief_signal_text": "SELECT * FROM stext", "brief_evidence_text": "SELECT * FROM etext", "missing_evidence": "SELECT * FROM miss", "case_brief": "SELECT * FROM brief",
    "brief_audit_timeline": "SELECT case_id, string_agg(strftime(event_ts, '%Y-%m-%d %H:%M') || ' ' || actor_name, chr(10) ORDER BY event_ts, audit_event_id) AS timeline FROM aud GROUP BY 1",
    "case_prompt": "SELECT case_id, concat_ws(chr(10), 'Case ' || case_id, executive_summary, 'Signals:', evidence_summary, 'Documents:', coalesce(evidence_text, 'none'), 'Open:', missing_evidence) AS prompt_text FROM brief LEFT JOIN etext USING (case_id)",
    "case_json_risk": """SELECT case_id, '{"risk_score":' || risk_score || ',"risk_band":"' || risk_band || '","recommended_route":"' || recommended_route || '"}' AS payload FROM rsk""",
    "case_json_typologies": """SELECT case_id, '[' || string_agg('{"signal_type":"' || signal_type || '","detected":' || detected || ',"points":' || points || '}', ',' ORDER BY signal_type) || ']' AS payload FROM sigs GROUP BY 1""",
    "case_json_network": """SELECT case_id, '[' || string_agg('{"relationship_type":"' || relationship_type || '","source":"' || source || '","target":"' || target || '","event_count":' || event_count || ',"total_cents":' || total_cents || '}', ',' ORDER BY relationship_type, source, target) || ']' AS payload FROM net GROUP BY 1""",
    "decisions_validate": "SELECT decision_id, CASE WHEN decision = 'AUTO_FILE_SAR' THEN 'unknown decision' WHEN reviewer_name = ' ' THEN 'reviewer is missing' WHEN rationale IS NULL THEN 'rationale is missing' END AS reason FROM decs",
    "decisions_apply": "SELECT decision_id, case_id, decision, reviewer_name, rationale, decided_at FROM vdecs",
    "decisions_audit": "SELECT 'AUD-' || decision_id AS audit_event_id, case_id, decided_at AS event_ts, 'HUMAN' AS actor_type, reviewer_name AS actor_name, 'REVIEWER_DECISION' AS event_type, decision || ': ' || rationale AS event_detail, 'DECISION' AS object_type, decision_id AS object_id FROM vdecs",
    "decisions_alert_status": """SELECT a.case_id, account_id, CASE WHEN decision = 'REQUEST_MORE_EVIDENCE' THEN 'EVIDENCE_REQUESTED' WHEN decision IS NOT NULL THEN 'REVIEWED' ELSE alert_status END AS alert_status, reviewer_name AS assigned_to
      FROM alerts a LEFT JOIN (SELECT * FROM vdecs QUALIFY row_number() OVER (PARTITION BY case_id ORDER BY decided_at DESC, decision_seq DESC) = 1) d ON d.case_id = a.case_id""",
    "messages_validate": "SELECT message_id, CASE WHEN message_role NOT IN ('USER', 'ASSISTANT') THEN 'unknown role' WHEN case_id NOT IN (SELECT case_id FROM alerts WHERE k % 2 = 0) THEN 'unknown case' END AS reason FROM msgs",
    "messages_audit": "SELECT 'AUD-' || message_id AS audit_event_id, case_id, message_ts, CASE WHEN message_role = 'USER' THEN 'HUMAN' ELSE 'SYSTEM' END AS actor_type, 'COPILOT_' || message_role || '_MESSAGE' AS event_type, message_id AS object_id FROM msgs WHERE message_role IN ('USER', 'ASSISTANT')",
    "executions_validate": """SELECT 'EXE-' || conv_id || '-' || turn AS execution_id, CASE WHEN (conv_id + turn) % 7 = 6 THEN 'unknown agent' WHEN (conv_id % (SELECT count(*) FROM supplier)) % 2 <> 0 THEN 'unknown case' END AS reason FROM conversations""",
    "ledger_link_check": "SELECT count(*) AS decisions, count(*) FILTER (decision_seq % 10 <> 0) AS linked, bool_or(decision = 'ESCALATE_TO_SAR') AS any_escalated FROM vdecs",
    "pipe_auto_case": "SELECT DISTINCT 'CASE-AUTO-' || replace(a.account_id, 'ACC-', '') AS case_id, a.account_id, 'OPEN' AS alert_status FROM tx JOIN accounts a ON a.account_id = from_account_id WHERE a.account_id NOT IN (SELECT account_id FROM alerts WHERE k % 2 = 0)",
    "pipe_processing_events": "SELECT * EXCLUDE (k, opened) FROM nprc WHERE opened OR k % 5 <> 0",
    "pipe_audit_events": "SELECT 'AUD-' || processing_event_id AS audit_event_id, case_id, processed_at AS event_ts, 'TRANSACTION_PROCESSED' AS event_type, transaction_id AS object_id FROM nprc WHERE opened OR k % 5 <> 0 AND k % 7 <> 0",
    "pipe_batch_summary": "SELECT count(DISTINCT transaction_id) AS processed, 'Processed ' || count(DISTINCT transaction_id) || ' new transaction(s).' AS summary FROM nprc WHERE opened OR k % 5 <> 0",
    "stream_new_transactions": "SELECT case_id, opened, count(transaction_id) AS events, count(*) FILTER (opened OR k % 5 <> 0 OR k % 7 = 0) AS audited FROM ncase LEFT JOIN nprc USING (case_id, opened) GROUP BY 1, 2",
    "stream_wage_harvest": "SELECT * EXCLUDE (gap) FROM onw",
    "join_interval_stream": """SELECT p.transaction_id AS payroll_id, m.transaction_id AS transfer_id FROM alerts a JOIN tx p ON p.from_account_id = a.account_id AND p.transaction_type = 'PAYROLL'
      LEFT JOIN tx m ON m.from_account_id = p.to_account_id AND m.transaction_type = 'TRANSFER' AND m.ts BETWEEN p.ts AND p.ts + INTERVAL 24 HOUR""",
    "pipe_status": "SELECT processing_event_id, transaction_id, case_id, processing_status, risk_score, risk_band, recommended_route FROM prc LEFT JOIN rsk USING (case_id)",
    "read_triage_queue": "SELECT case_id, account_id, priority, display_name, risk_score, risk_band, evidence_strength, recommended_route FROM alerts JOIN accounts USING (account_id) LEFT JOIN rsk USING (case_id)",
    "read_documents": "SELECT case_id, document_id, document_type, confidence, array_to_string(ind, ', ') AS indicators, uploaded_seq FROM docs",
    "read_intelligence": "SELECT case_id, watchlist_id, account_id, risk_level, match_strength FROM ent JOIN watch ON matched_account_id = account_id",
    "read_transactions": "SELECT * FROM ctx",
    "read_decisions": "SELECT case_id, decision_id, decision, decided_at FROM vdecs", "read_audit": "SELECT case_id, audit_event_id, event_ts, event_type, event_detail FROM aud",
    "topk_recent_processing": "SELECT case_id, processing_event_id, processed_at, CAST(row_number() OVER w AS INT) AS place FROM prc WINDOW w AS (PARTITION BY case_id ORDER BY processed_at DESC, processing_event_id DESC) QUALIFY row_number() OVER w <= 10",
    "topk_chat_history": "SELECT case_id, message_id, message_ts, CAST(row_number() OVER w AS INT) AS place FROM msgs WINDOW w AS (PARTITION BY case_id ORDER BY message_ts DESC, message_id DESC) QUALIFY row_number() OVER w <= 20",
    "topk_largest_transaction": "SELECT case_id, count(*) AS n, CAST(sum(cents) AS BIGINT) AS total_cents, arg_max(transaction_id, (cents, transaction_id)) AS largest_id, max(cents) AS largest_cents FROM ctx GROUP BY 1",
    "merge_insert_only": "SELECT case_id, CASE WHEN k % 2 = 0 THEN account_id ELSE 'NEW-' || account_id END AS account_id FROM alerts",
    "merge_upsert_all": "SELECT case_id, CASE WHEN priority = 'HIGH' THEN 'X' ELSE account_id END AS account_id, CASE WHEN priority = 'HIGH' THEN 'Y' ELSE priority END AS priority FROM alerts WHERE k % 2 = 0 OR priority = 'HIGH'",
    "merge_upsert_partial": "SELECT case_id, CASE WHEN priority = 'HIGH' AND k % 2 <> 0 THEN 'X' ELSE account_id END AS account_id, CASE WHEN priority = 'HIGH' THEN 'Y' ELSE priority END AS priority FROM alerts WHERE k % 2 = 0 OR priority = 'HIGH'",
    "sink_delete_where": "SELECT account_id, sector FROM accounts WHERE sector IS DISTINCT FROM 'RETAIL'",
    "sink_update_where": "SELECT case_id, priority, CASE WHEN priority = 'HIGH' THEN 'REVIEWED' ELSE alert_status END AS alert_status FROM alerts",
    "validate_not_null": "SELECT transaction_id, 'to_account_id is missing' AS reason FROM tx WHERE to_account_id IS NULL UNION ALL SELECT transaction_id, 'counterparty_country is missing' FROM tx WHERE counterparty_country IS NULL",
    "validate_unique_key": "SELECT account_id, device_id, ip_address, count(*) AS copies FROM sig GROUP BY 1, 2, 3 HAVING count(*) > 1",
    "flt_equality": "SELECT transaction_id FROM tx WHERE transaction_type = 'CARD'", "flt_in_list": "SELECT account_id, sector FROM accounts WHERE sector IN ('RETAIL', 'FINANCE')",
    "flt_not_equal_null_safe": "SELECT account_id FROM accounts WHERE sector <> 'RETAIL'", "flt_null_checks": "SELECT transaction_id FROM tx WHERE transaction_type = 'CASH_WITHDRAWAL'",
    "flt_between_ts": "SELECT signal_id FROM sig WHERE observed_at >= '2024-01-05' AND observed_at <= '2024-01-12'", "flt_point_lookup": "SELECT audit_event_id, event_type FROM aud WHERE case_id = 'CASE-3'",
    "prj_constants_alias": "SELECT case_id, 'ALERT' AS kind, account_id AS subject FROM alerts", "prj_ternary_null_false": "SELECT account_id, CAST(coalesce(sector = 'RETAIL', false) AS INT) AS is_retail FROM accounts",
    "prj_case_searched": "SELECT transaction_id, CASE WHEN cents < 5000000 THEN 'S' WHEN cents < 20000000 THEN 'M' ELSE 'L' END AS size FROM tx",
    "prj_case_simple": "SELECT decision_id, CASE WHEN decision = 'MONITOR_CASE' THEN 'watch' WHEN decision = 'ESCALATE_TO_SAR' THEN 'report' ELSE 'other' END AS step FROM decs",
    "join_inner_equi": "SELECT 'CASE-' || s_suppkey AS case_id, CASE WHEN s_suppkey % 7 = 0 THEN 'COMPLETE' ELSE 'INCOMPLETE' END AS owner_status FROM supplier",
    "join_multi_key": "SELECT DISTINCT f.device_id, f.ip_address, s.account_id FROM sig f JOIN sig s ON f.device_id = s.device_id AND f.ip_address = s.ip_address WHERE f.login_result = 'FAILURE' AND s.login_result = 'SUCCESS'",
    "join_left_outer": "SELECT account_id, watchlist_id IS NOT NULL AS listed FROM accounts LEFT JOIN watch ON account_id = matched_account_id",
    "join_self_employer": "SELECT e.account_id AS employer, w.account_id AS worker FROM accounts e JOIN accounts w USING (employer_id) WHERE e.account_type = 'CORPORATE'",
    "join_semi_in_subquery": "SELECT account_id FROM accounts WHERE account_id IN (SELECT from_account_id FROM tx) OR account_id IN (SELECT matched_account_id FROM watch)",
    "join_anti_not_exists": "SELECT account_id FROM accounts a WHERE NOT EXISTS (SELECT 1 FROM tx WHERE from_account_id = a.account_id)",
    "join_coalesced_key": "SELECT transaction_id, country FROM tx JOIN accounts ON account_id = coalesce(to_account_id, from_account_id)",
    "join_ledger_link": "SELECT decision_id, 'AUD-' || decision_id AS audit_event_id FROM vdecs WHERE decision_seq % 10 <> 0 AND decision_seq % 6 <> 0",
    "join_self_theta_pairs": "SELECT case_id, device_id, ip_address, a.account_id AS source, b.account_id AS target FROM ms a JOIN ms b USING (case_id, device_id, ip_address) WHERE a.account_id < b.account_id",
    "read_signals": "SELECT case_id, signal_type, detected, points FROM sigs",
    "ledger_acceptance": """SELECT *, CASE WHEN expected = actual THEN 'PASS' ELSE 'FAIL' END AS status FROM (
      SELECT case_id AS subject, 'score' AS check_name, CAST(least(100, total + i.points + d.points) AS VARCHAR) AS expected, CAST(risk_score AS VARCHAR) AS actual FROM typ JOIN intel i USING (case_id) JOIN dpt d USING (case_id) JOIN rsk USING (case_id)
      UNION ALL SELECT case_id, 'band', CASE WHEN s >= 90 THEN 'CRITICAL' WHEN s >= 70 THEN 'HIGH' WHEN s >= 40 THEN 'MEDIUM' ELSE 'LOW' END, risk_band
        FROM (SELECT case_id, least(100, total + i.points + d.points) AS s, risk_band FROM typ JOIN intel i USING (case_id) JOIN dpt d USING (case_id) JOIN rsk USING (case_id))
      UNION ALL SELECT case_id, 'signals', CAST(detected_count AS VARCHAR), CAST((r.wage_harvesting > 0)::INT + (r.account_control > 0)::INT + (r.spending_anomaly > 0)::INT + (r.geographic_risk > 0)::INT + (r.sector_risk > 0)::INT AS VARCHAR) FROM typ JOIN rsk r USING (case_id)
      UNION ALL SELECT a.case_id, 'execution_audits', CAST(count(x.c) AS VARCHAR), CAST(count(x.c) AS VARCHAR) FROM alerts a LEFT JOIN (SELECT 'CASE-' || (conv_id % (SELECT count(*) FROM supplier)) AS c FROM conversations WHERE (conv_id + turn) % 7 < 6) x ON x.c = a.case_id AND a.k % 2 = 0 GROUP BY 1
      UNION ALL SELECT a.case_id, 'decision_audits', CAST(count(decision_id) AS VARCHAR), CAST(count(decision_id) FILTER (decision_seq % 10 <> 0) AS VARCHAR) FROM alerts a LEFT JOIN vdecs USING (case_id) GROUP BY 1)""",
    "sink_csv_export": """SELECT case_id, audit_event_id, event_ts, actor_type, actor_name, event_type, CASE WHEN CAST(substr(case_id, 6) AS INT) % 3 = 0 THEN 'again: ' ELSE '' END || 'it said "' || event_detail || '",' || chr(13) || chr(10) || 'then left' AS event_detail FROM aud""",
    "src_csv_rejects": "SELECT account_id, 'declared_employee_count: abc is no int' AS reason FROM kyc WHERE CAST(substr(account_id, 7) AS INT) % 10 = 3",
    "validate_rows": "SELECT signal_id, CASE WHEN count(*) OVER w > 1 THEN 'account_id, device_id, ip_address occurs ' || count(*) OVER w || ' times' END AS reason FROM sig WINDOW w AS (PARTITION BY account_id, device_id, ip_address)",
    "agg_count_sum_group": "SELECT transaction_type, count(*) AS n, CAST(sum(cents) AS BIGINT) AS cents FROM tx GROUP BY 1", "agg_count_distinct": "SELECT ip_address, count(DISTINCT account_id) AS accounts, count(DISTINCT device_id) AS devices FROM sig GROUP BY 1",
    "agg_conditional_sum": "SELECT from_account_id, CAST(coalesce(sum(cents) FILTER (transaction_type IN ('TRANSFER', 'CARD')), 0) AS BIGINT) AS cents FROM tx GROUP BY 1", "agg_count_if": "SELECT document_type, count(*) FILTER (confidence < 50) AS low FROM docs GROUP BY 1",
    "agg_ratio_safe": "SELECT from_account_id, round(CAST(coalesce(sum(cents) FILTER (transaction_type = 'CARD'), 0) AS DOUBLE) / nullif(sum(cents), 0), 3) AS ratio FROM tx GROUP BY 1",
    "agg_avg_of_ratio": "SELECT transaction_type, round(avg(r), 4) AS avg_ratio FROM (SELECT transaction_type, CAST(max(cents) AS DOUBLE) / nullif(sum(cents), 0) AS r FROM tx GROUP BY transaction_type, from_account_id) GROUP BY 1",
    "agg_pivot_conditional_max": "SELECT from_account_id, max(cents) FILTER (transaction_type = 'PAYROLL') AS payroll, max(cents) FILTER (transaction_type = 'TRANSFER') AS transfer, max(cents) FILTER (transaction_type = 'CARD') AS card FROM tx GROUP BY 1",
    "agg_min_max": "SELECT case_id, min(confidence) AS lowest, max(document_type) AS last_type FROM docs GROUP BY 1", "agg_any_value": "SELECT account_id, arg_max(device_id, (observed_at, signal_id)) AS last_device FROM sig GROUP BY 1",
    "agg_array_distinct_sorted": "SELECT employer_id, string_agg(DISTINCT country, ',' ORDER BY country) AS countries FROM accounts GROUP BY 1",
    "agg_array_of_objects_ordered": """SELECT matched_account_id, '[' || string_agg('{"id":"' || watchlist_id || '","level":"' || risk_level || '"}', ',' ORDER BY watchlist_id) || ']' AS rows FROM watch GROUP BY 1""",
    "agg_listagg_ordered": "SELECT risk_level, string_agg(watchlist_id, ';' ORDER BY watchlist_id) AS ids FROM watch GROUP BY 1", "agg_listagg_distinct": "SELECT account_type, string_agg(DISTINCT country, ',' ORDER BY country) AS countries FROM accounts GROUP BY 1",
    "agg_bool_or": "SELECT account_id, bool_or(login_result = 'FAILURE') AS failed FROM sig GROUP BY 1",
    "agg_scalar_subqueries": "SELECT (SELECT count(*) FROM tx WHERE transaction_type = 'PAYROLL') AS wages, (SELECT count(DISTINCT from_account_id) FROM tx) AS payers, (SELECT max(cents) FROM tx) AS largest",
    "agg_distinct_rows": "SELECT DISTINCT account_id, device_id FROM sig", "agg_value_counts": "SELECT indicator, count(*) AS n FROM (SELECT unnest(ind) AS indicator FROM docs) GROUP BY 1",
    "sort_nulls_last": "SELECT account_id, sector FROM accounts", "sort_multi_key": "SELECT risk_level, match_strength, watchlist_id FROM watch",
    "set_union_distinct": "SELECT account_id FROM alerts UNION SELECT matched_account_id FROM watch", "set_union_all": "SELECT 'alert' AS kind, case_id AS id FROM alerts UNION ALL SELECT 'list', watchlist_id FROM watch",
    "fn_string_concat": "SELECT account_id, sector || '/' || country AS place FROM accounts", "fn_string_case": "SELECT message_id, lower(message_role) AS low, upper(session_id) AS up FROM msgs",
    "fn_string_replace": "SELECT decision_id, CASE decision WHEN 'ESCALATE_TO_SAR' THEN 'Escalate To Sar' WHEN 'REQUEST_MORE_EVIDENCE' THEN 'Request More Evidence' WHEN 'MONITOR_CASE' THEN 'Monitor Case' WHEN 'AUTO_FILE_SAR' THEN 'Auto File Sar' ELSE 'Close As False Positive' END AS shown FROM decs",
    "fn_string_split_list": "SELECT document_id, CAST(nullif(len(ind), 0) AS INT) AS n FROM docs", "fn_string_like": "SELECT message_id FROM msgs WHERE message_text ILIKE '%th%'",
    "fn_ts_format": "SELECT signal_id, strftime(observed_at, '%Y-%m-%d %H:%M') AS shown FROM sig", "fn_ts_add_diff": "SELECT account_id, max(observed_at) + INTERVAL 24 HOUR AS until, CAST(date_diff('day', min(observed_at), max(observed_at)) AS INT) AS days, date_diff('hour', min(observed_at), max(observed_at)) AS hours FROM sig GROUP BY 1",
    "fn_math_round_least": "SELECT transaction_id, round(cents / 700.0::DOUBLE, 2) AS r, least(100000, cents) AS capped FROM tx", "fn_array_size_guard": "SELECT document_id, len(ind) > 0 AS risky FROM docs",
    "fn_array_compact": "SELECT account_id, concat_ws('|', sector, country) AS known FROM accounts", "fn_array_join": "SELECT document_id, array_to_string(ind, ', ') AS text FROM docs",
    "fn_object_build": """SELECT account_id, CASE WHEN sector IS NULL THEN '{"country":"' || country || '"}' ELSE '{"sector":"' || sector || '","country":"' || country || '"}' END AS j FROM accounts""",
    "fn_object_build_keep_null": """SELECT account_id, '{"sector":' || coalesce('"' || sector || '"', 'null') || ',"country":"' || country || '"}' AS j FROM accounts""",
    "fn_json_path": "SELECT audit_event_id, event_metadata ->> '$.k' AS k FROM aud", "fn_json_try_parse": "SELECT audit_event_id, CASE WHEN actor_type <> 'HUMAN' THEN CAST(event_metadata ->> '$.k' AS INT) END AS k FROM aud",
    "fn_json_flatten": "SELECT audit_event_id, CAST(i AS INT) AS i, CAST(event_metadata ->> '$.k' AS INT) AS k FROM aud, (SELECT unnest([0, 1]) AS i)",
    "fn_deterministic_id": "SELECT case_id, 'RISK-' || case_id || '-V1' AS id, sha256(case_id || '|' || account_id) AS key FROM alerts",
    "fn_cast": "SELECT transaction_id, CAST(cents AS VARCHAR) AS s, k AS n FROM tx", "apply_defaults": "SELECT transaction_id, coalesce(counterparty_country, 'N0') AS country, coalesce(to_account_id, 'NONE') AS target FROM tx",
    "sort_breakdown": "SELECT from_account_id, 'all_cents' AS factor, CAST(sum(cents) AS BIGINT) AS points FROM tx GROUP BY 1 UNION ALL SELECT from_account_id, 'n', count(*) FROM tx GROUP BY 1",
    "sink_overwrite": "SELECT case_id, priority FROM alerts WHERE k % 3 <> 0", "sink_append": "SELECT account_id, account_type, country FROM accounts", "src_csv_typed": "SELECT * FROM kyc",
    "src_change_stream": "SELECT event_id, user_id, upper(event_type) AS kind FROM events", "stream_dedupe": "SELECT DISTINCT event_id, user_id, event_type FROM events WHERE event_id % 5 <> 0",
    "src_parse_json_cols": """SELECT audit_event_id, CASE WHEN n % 13 <> 0 THEN CAST(event_metadata ->> '$.k' AS INT) * 2 END AS twice, CASE WHEN n % 17 <> 0 THEN event_type END AS name,
      concat_ws(',', CASE WHEN n % 13 = 0 THEN 'about' END, CASE WHEN n % 17 = 0 THEN 'names' END) AS errors FROM (SELECT *, CAST(substr(audit_event_id, 5) AS BIGINT) AS n FROM aud)""",
}

_EXE = """FROM (SELECT 'EXE-' || conv_id || '-' || turn AS execution_id, 'CASE-' || (conv_id % (SELECT count(*) FROM supplier)) AS case_id,
  ['risk', 'typology', 'network', 'evidence', 'brief', 'orchestrator', NULL][CAST((conv_id + turn) % 7 + 1 AS INT)] AS agent_name,
  TIMESTAMP '2024-01-01' + to_minutes(CAST(conv_id * 7 + turn AS INT)) AS executed_at, 'REQ-' || conv_id AS request_id, 'SES-' || conv_id AS session_id,
  'turn ' || turn || ' by ' || role AS routing_reason, text AS agent_response, CASE WHEN turn % 3 = 0 THEN '' ELSE 'case_network|documents' END AS source_objects FROM conversations)
  WHERE agent_name IS NOT NULL AND case_id IN (SELECT case_id FROM alerts WHERE k % 2 = 0)"""


def _upsert(new: str, key: str, old: str, kept: str) -> str:
    """New rows, stored ones with their kept columns, and old rows of cases that are gone."""
    return f"""SELECT * FROM (WITH n AS ({new}) SELECT n.* REPLACE ({kept}) FROM n LEFT JOIN (SELECT case_id AS c FROM alerts WHERE priority = 'HIGH') h ON h.c = n.case_id
      UNION ALL SELECT n.* REPLACE ('OLD-' || {key} AS {key}, 'OLD-' || case_id AS case_id, {old}) FROM n WHERE case_id IN (SELECT case_id FROM alerts WHERE priority = 'HIGH'))"""


_AGO, _AT = "TIMESTAMP '2023-12-31'", "TIMESTAMP '2024-06-01'"
_EVENT = {"key": "audit_event_id", "old": f"{_AGO} AS event_ts, 'old' AS event_detail", "kept": f"CASE WHEN c IS NULL THEN event_ts ELSE {_AGO} END AS event_ts"}
_BODY |= {
    "messages_apply": "SELECT *, 'RULES' AS model_provider, 'EVIDENCE_TABLES' AS grounding_mode FROM msgs WHERE message_role IN ('USER', 'ASSISTANT') AND case_id IN (SELECT case_id FROM alerts)",
    "executions_apply": f"SELECT *, 'COMPLETED' AS execution_status {_EXE}",
    "executions_audit": f"""SELECT 'AUD-' || execution_id AS audit_event_id, case_id, executed_at AS event_ts, 'AGENT' AS actor_type, agent_name AS actor_name, 'AGENT_EXECUTION' AS event_type, agent_name || ' answered; see the execution.' AS event_detail, 'AGENT_EXECUTION' AS object_type, execution_id AS object_id,
      '{{"request_id":"' || request_id || '","session_id":"' || session_id || '","agent_name":"' || agent_name || '","routing_reason":"' || routing_reason || '","source_objects":' || CASE WHEN source_objects = '' THEN '[]' ELSE '["case_network","documents"]' END || ',"execution_status":"COMPLETED"}}' AS event_metadata {_EXE}""",
    "risk_score_snapshot": _upsert(
        f"SELECT 'RSK-' || case_id AS score_id, case_id, risk_score, risk_band, evidence_strength, recommended_route, {_AT} AS calculated_at FROM rsk",
        "score_id", f"'OLD' AS risk_band, {_AGO} AS calculated_at", "calculated_at AS calculated_at",
    ),
    "risk_audit_event": _upsert(
        f"""SELECT 'AUD-RSK-' || case_id AS audit_event_id, case_id, {_AT} AS event_ts, 'RISK_CALCULATED' AS event_type,
          'Calculated ' || risk_score || '/100 ' || risk_band || ' risk with ' || evidence_strength || ' evidence.' AS event_detail FROM rsk""", **_EVENT
    ),
    "brief_snapshot": _upsert(
        f"SELECT 'BRF-' || case_id AS brief_id, case_id, executive_summary, recommended_action, {_AT} AS generated_at FROM brief",
        "brief_id", f"'old' AS executive_summary, {_AGO} AS generated_at", f"CASE WHEN c IS NULL THEN generated_at ELSE {_AGO} END AS generated_at",
    ),
    "brief_audit_event": _upsert(
        f"""SELECT 'AUD-BRF-' || case_id AS audit_event_id, case_id, {_AT} AS event_ts, 'BRIEF_GENERATED' AS event_type, 'Brief generated: ' || recommended_action AS event_detail FROM brief""", **_EVENT
    ),
    "case_json_brief": """SELECT case_id, '{"executive_summary":"' || executive_summary || '","hypothesis":"' || hypothesis || '","recommended_action":"' || recommended_action || '"}' AS payload FROM brief""",
    "case_json_evidence": """SELECT a.case_id, '{"documents":[' || coalesce(d.l, '') || '],"watchlist":[' || coalesce(w.l, '') || ']}' AS payload FROM alerts a
      LEFT JOIN (SELECT case_id, string_agg(DISTINCT '"' || document_id || '"', ',' ORDER BY '"' || document_id || '"') AS l FROM docs GROUP BY 1) d ON d.case_id = a.case_id
      LEFT JOIN (SELECT case_id, string_agg(DISTINCT '"' || watchlist_id || '"', ',' ORDER BY '"' || watchlist_id || '"') AS l FROM ent JOIN watch ON matched_account_id = account_id GROUP BY 1) w ON w.case_id = a.case_id""",
}

_HAS = "regexp_matches(lower(question), '{}')"
_ASK = """(SELECT message_id, case_id, ['Review score, typology, network, evidence and brief.', 'Why this score?', 'The payroll evidence?', 'Connected accounts?', 'What is missing?', 'Which country?', 'What do you recommend?', 'Hello.']
  [CAST(length(coalesce(message_text, '')) % 8 + 1 AS INT)] || ' ' || coalesce(message_text, '') AS question FROM msgs WHERE message_role = 'USER')"""
_R = {
    "risk": _HAS.format("score|risk|92|critical|points|band"),
    "typology": _HAS.format("typology|typologies|wage|payroll|harvest|transaction|spending|amount|payment|geograph|country|location|jurisdiction|sector"),
    "network": _HAS.format("network|connected|controller|account control|shared device|funnel|cash-out"),
    "evidence": _HAS.format("document|watchlist|adverse|media|evidence|missing|gap|need next"),
    "brief": _HAS.format("summary|summarise|summarize|brief|hypothesis|suspicion|action|recommend|decision|sar|what should"),
}
_R |= {n: f"({_R[n]} OR NOT ({' OR '.join(_R.values())}))" for n in ("risk", "brief")}
_T = {
    "risk": "'all'", "network": "'all'",
    "typology": f"CASE WHEN {_HAS.format('wage|payroll|harvest')} THEN 'wage' WHEN {_HAS.format('transaction|spending|amount|payment')} THEN 'spending' WHEN {_HAS.format('geograph|country|location|jurisdiction')} THEN 'geography' ELSE 'general' END",
    "evidence": f"CASE WHEN {_HAS.format('missing|gap|more evidence|need next')} THEN 'gap' ELSE 'review' END",
    "brief": f"CASE WHEN {_HAS.format('action|recommend|decision|sar|what should')} THEN 'action' WHEN {_HAS.format('hypothesis|suspicion')} THEN 'hypothesis' ELSE 'summary' END",
}
_POINTS = ", ".join(f"{{'l': -{c}, 'n': '{c.replace('_', ' ')}'}}" for c in ("wage_harvesting", "account_control", "spending_anomaly", "geographic_risk", "sector_risk", "intelligence", "document"))
_A = {
    "risk": f"""SELECT case_id, 'all' AS topic, case_id || ' scores ' || risk_score || '/100 (' || risk_band || '), evidence ' || evidence_strength || ': '
      || array_to_string(list_transform(list_sort([{_POINTS}]), lambda p: p.n || ' +' || (-p.l)), '; ') || '. Proposed: ' || recommended_route || '.' AS answer FROM rsk""",
    "typology": """SELECT case_id, topic, CASE topic WHEN 'wage' THEN 'Wage harvesting adds ' || coalesce(w, 0) || ' points.' WHEN 'geography' THEN 'Countries: ' || coalesce(c, 'none') || '.' WHEN 'general' THEN 'Signals: ' || coalesce(l, 'none') || '.'
      ELSE coalesce(n, 0) || ' transactions, ' || coalesce(s, 0) || ' cents in all, ' || coalesce(m, 0) || ' at most.' END AS answer FROM alerts
      LEFT JOIN (SELECT case_id, max(points) FILTER (signal_type = 'WAGE_HARVESTING') AS w, string_agg(signal_type || ' +' || points, '; ' ORDER BY signal_type) AS l FROM sigs WHERE detected GROUP BY 1) USING (case_id)
      LEFT JOIN (SELECT case_id, count(*) AS n, sum(cents) AS s, max(cents) AS m FROM ctx GROUP BY 1) USING (case_id)
      LEFT JOIN (SELECT case_id, string_agg(DISTINCT counterparty_country, ', ' ORDER BY counterparty_country) AS c FROM ctx JOIN (SELECT transaction_id, counterparty_country FROM tx) USING (transaction_id) GROUP BY 1) USING (case_id)
      CROSS JOIN (SELECT unnest(['wage', 'spending', 'geography', 'general']) AS topic)""",
    "network": """SELECT case_id, 'all' AS topic, coalesce(n, 0) || ' edges: ' || coalesce(kinds, 'none') || '. ' || CASE WHEN s2.detected THEN s2.shared_accounts || ' accounts log in from ' || s2.device_id || ' at ' || s2.ip_address || '.' ELSE 'No sign of common control.' END AS answer FROM alerts LEFT JOIN s2 USING (case_id) LEFT JOIN (SELECT case_id, sum(e) AS n, string_agg(relationship_type || ' (' || e || ')', ', ' ORDER BY e DESC, relationship_type) AS kinds
      FROM (SELECT case_id, relationship_type, count(*) AS e FROM net GROUP BY 1, 2) GROUP BY 1) USING (case_id)""",
    "evidence": """SELECT case_id, topic, CASE topic WHEN 'gap' THEN 'Open: ' || missing_evidence ELSE documents || ' documents (' || reviewed || ' reviewed), ' || matches || ' list matches (' || high_hits || ' of high risk). ' || evidence_summary END AS answer
      FROM brief JOIN (SELECT case_id, documents, reviewed FROM dpt) USING (case_id) JOIN (SELECT case_id, matches, high_hits FROM intel) USING (case_id) CROSS JOIN (SELECT unnest(['gap', 'review']) AS topic)""",
    "brief": """SELECT case_id, topic, CASE topic WHEN 'action' THEN recommended_action || ' A reviewer decides.' WHEN 'hypothesis' THEN hypothesis ELSE executive_summary END AS answer FROM brief CROSS JOIN (SELECT unnest(['action', 'hypothesis', 'summary']) AS topic)""",
}
_READS = {"risk": "risk_summary", "typology": "all_signals", "network": "case_network", "evidence": "documents, watchlist", "brief": "case_brief"}
_ASKED = " UNION ALL ".join(f"SELECT message_id, case_id, {i} AS place, '{n}' AS specialist, '{_READS[n]}' AS source, {_T[n]} AS topic FROM {_ASK} WHERE {_R[n]}" for i, n in enumerate(_R))
_N = "length(coalesce(message_text, ''))"
_TOOL = "['risk_explanation', 'typology_detection', 'network_intelligence', 'evidence_review', 'case_brief'][CAST({} % 5 + 1 AS INT)]"
_WHO = "['risk', 'typology', 'network', 'evidence', 'brief'][CAST({} % 5 + 1 AS INT)]"
_TRACE = f"""SELECT message_id, CASE WHEN {_N} % 7 = 0 THEN 'malformed' WHEN {_N} % 5 = 0 THEN 'failed' ELSE 'completed' END AS status, CAST(CASE WHEN {_N} % 7 = 0 THEN 0 ELSE 1 END AS INT) AS text_parts,
  CASE WHEN {_N} % 7 = 0 THEN '' WHEN {_N} % 5 = 0 THEN {_TOOL.format(_N)} ELSE {_TOOL.format(_N)} || ', ' || {_TOOL.format(f"({_N} * 2)")} END AS tools,
  CASE WHEN {_N} % 7 = 0 THEN '' WHEN {_N} % 5 = 0 THEN {_WHO.format(_N)} ELSE {_WHO.format(_N)} || ', ' || {_WHO.format(f"({_N} * 2)")} END AS specialists FROM msgs WHERE message_role = 'ASSISTANT'"""
_BODY |= {
    "route_questions": "SELECT message_id, case_id, concat_ws(', ', " + ", ".join(f"CASE WHEN {has} THEN '{n}' END" for n, has in _R.items()) + f") AS routes FROM {_ASK}",
    **{f"route_{n}_topic": f"SELECT message_id, {_T[n]} AS topic FROM {_ASK} WHERE {_R[n]}" for n in ("typology", "evidence", "brief")},
    **{f"answer_{n}": sql for n, sql in _A.items()},
    "answer_synthesis": f"""SELECT message_id, string_agg(specialist, ', ' ORDER BY place) AS specialists, string_agg(source, ', ' ORDER BY place) AS sources, string_agg(specialist || ': ' || answer, chr(10) ORDER BY place) AS answer
      FROM ({_ASKED}) JOIN ({" UNION ALL ".join(f"SELECT case_id, '{n}' AS specialist, topic, answer FROM ({sql})" for n, sql in _A.items())}) USING (case_id, specialist, topic) GROUP BY 1""",
    "tool_trace": _TRACE,
    "tool_trace_quality": f"""SELECT * EXCLUDE (list), CAST(coalesce(len(list), 0) AS INT) AS distinct_tools, coalesce(array_to_string(list, ', '), '') AS tools_used FROM (SELECT status, count(*) AS responses, CAST(sum(text_parts) AS BIGINT) AS text_parts, count(*) FILTER (text_parts = 0) AS without_text, count(*) FILTER (tools = '') AS without_tools,
      count(*) FILTER (text_parts = 1 AND lower(said) LIKE '%failed%') AS failure_texts, count(*) FILTER (text_parts = 1 AND said LIKE '%92%') AS score_mentions,
      count(*) FILTER (status = 'completed' AND text_parts = 1 AND lower(said) NOT LIKE '%failed%' AND said LIKE '%92%') AS sound,
      list_sort(list_distinct(flatten(list(string_split(tools, ', ')) FILTER (tools <> '')))) AS list FROM ({_TRACE}) JOIN (SELECT message_id,
      message_text || CASE WHEN {_N} % 11 = 0 THEN ' The analysis failed.' ELSE '' END || CASE WHEN {_N} % 4 = 0 THEN ' Score 92 of 100.' ELSE '' END AS said FROM msgs) USING (message_id) GROUP BY 1)""",
    "read_agent_runs": f"SELECT case_id, execution_id, agent_name, executed_at {_EXE}",
}

ORACLE_SQL = {name: f"WITH {_TABLES}\n{body}" for name, body in _BODY.items()}
