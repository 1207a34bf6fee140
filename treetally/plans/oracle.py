"""DuckDB SQL for the queries, over the driver's tables."""

from __future__ import annotations

from ..sources.fixtures import CHAIN, FOREST, PRICE, RUN_COLUMNS
from .queries import AFTER, BEFORE, ORG


def _runs(parent: str) -> str:
    columns = ", ".join(f"{e} AS {c}" for c, e in RUN_COLUMNS.items())
    return f"SELECT o_orderkey AS id, {parent} AS parent_run_id, {columns} FROM orders JOIN customer ON o_custkey = c_custkey"


def _ledger(parent: str = FOREST) -> str:
    return f"""WITH RECURSIVE
organizations AS (SELECT n_nationkey AS id, n_name AS external_id FROM nation),
users AS (SELECT c_custkey AS id, c_name AS external_id, c_nationkey AS organization_id FROM customer),
runs AS ({_runs(parent)}),
price_list AS (SELECT concat('part-', CAST(p_partkey AS STRING)) AS cost_name, {PRICE} AS unit_cost FROM part WHERE p_partkey % 97 <> 0),
cost_items AS (SELECT l_orderkey AS run_id, concat('part-', CAST(l_partkey AS STRING)) AS cost_name, CAST(l_quantity AS DECIMAL(20,6)) AS quantity FROM lineitem),
rejected AS (SELECT run_id, string_agg(DISTINCT cost_name, ',' ORDER BY cost_name) AS unknown_names FROM cost_items c WHERE NOT EXISTS (SELECT 1 FROM price_list p WHERE p.cost_name = c.cost_name) GROUP BY run_id),
priced AS (SELECT c.run_id, c.cost_name, c.quantity, p.unit_cost, CAST(c.quantity * p.unit_cost AS DECIMAL(16,10)) AS total FROM cost_items c JOIN price_list p USING (cost_name) WHERE c.run_id NOT IN (SELECT run_id FROM rejected)),
own AS (SELECT run_id, CAST(sum(total) AS DECIMAL(26,10)) AS own FROM priced GROUP BY run_id),
own_cost AS (SELECT id, coalesce(own, CAST(0 AS DECIMAL(26,10))) AS own_cost FROM runs LEFT JOIN own ON run_id = id),
tree AS (SELECT id AS root, id, 0 AS depth FROM runs WHERE parent_run_id IS NULL UNION ALL SELECT t.root, r.id, t.depth + 1 FROM tree t JOIN runs r ON r.parent_run_id = t.id),
below AS (SELECT root, id, depth FROM tree WHERE depth > 0),
updates AS (SELECT event_id AS request_id, event_id % (SELECT count(*) FROM orders) AS run_id, CASE event_type WHEN 'purchase' THEN 'completed' WHEN 'error' THEN 'failed' ELSE event_type END AS status, ts, event_id AS seq FROM events),
last AS (SELECT run_id, arg_max(status, (ts, seq)) AS status, max(ts) AS at FROM updates WHERE status IN ('completed', 'failed') GROUP BY run_id),
requests AS (SELECT o_orderkey AS request_id, o_orderdate AS ts, o_orderkey AS seq, concat('org-', CAST(c_custkey % 40 AS STRING)) AS org, CASE WHEN o_orderkey % 5 = 0 THEN NULL WHEN o_orderkey % 3 = 0 THEN concat('guest-', CAST(c_custkey % 100 AS STRING)) ELSE c_name END AS usr,
  CASE WHEN o_orderkey % 13 = 0 THEN '' ELSE o_orderpriority END AS app, CASE WHEN o_orderkey % 17 = 0 THEN '' WHEN o_orderkey % 3 = 0 THEN NULL ELSE 'brand' END AS brand,
  concat('svc-', CAST(o_orderkey % 6 AS STRING)) AS svc, CASE WHEN o_orderkey % 19 = 0 THEN NULL ELSE 'task' END AS task,
  CASE WHEN o_orderkey % 7 = 0 THEN '00000000-0000-0000-0000-000000000000' WHEN o_orderkey % 23 = 0 THEN 'parent' END AS parent FROM orders JOIN customer ON o_custkey = c_custkey),
judged AS (SELECT *, nullif(concat_ws('; ', CASE WHEN app = '' THEN 'appId required' END, CASE WHEN task IS NULL THEN 'taskName required' END, CASE WHEN brand = '' THEN 'brandId empty' END, CASE WHEN parent = 'parent' THEN 'parentRunId no UUID' END), '') AS reason FROM requests)
"""


_SUMS = """, closure AS (SELECT id AS top, id FROM runs UNION ALL SELECT c.top, r.id FROM closure c JOIN runs r ON r.parent_run_id = c.id),
sums AS (SELECT top, CAST(sum(own_cost) AS DECIMAL(26,10)) AS total_cost FROM closure JOIN own_cost USING (id) GROUP BY top)
"""
_SUMMARY = "SELECT o.id, o.own_cost, CAST(s.total_cost - o.own_cost AS DECIMAL(26,10)) AS children_cost, s.total_cost FROM own_cost o JOIN sums s ON s.top = o.id"
_LATEST = "ORDER BY started_at DESC, id"
_VERDICT = "SELECT request_id, CASE WHEN {bad} THEN '{reason}' END AS reason FROM {rows}"
_STATUS = "SELECT r.id, coalesce(l.status, r.status) AS status, coalesce(l.at, r.completed_at) AS completed_at FROM runs r LEFT JOIN last l ON l.run_id = r.id"
_BATCHES = """, batches AS (SELECT o_orderkey AS request_id, EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey) AS has_items FROM orders)
, batch_verdicts AS (SELECT request_id, CASE WHEN NOT has_items THEN 'items required' WHEN request_id % 29 = 0 OR request_id % 31 = 0 THEN 'bad item' END AS reason FROM batches)
"""

_BODIES = {
    "list_runs": f"SELECT r.*, o.own_cost FROM runs r JOIN own_cost o USING (id) WHERE organization_id = (SELECT id FROM organizations WHERE external_id = '{ORG}') {_LATEST} LIMIT 50",
    "list_runs_filtered": f"SELECT r.*, o.own_cost FROM runs r JOIN own_cost o USING (id) WHERE organization_id = (SELECT id FROM organizations WHERE external_id = '{ORG}') AND status = 'completed' AND app_id = '1-URGENT' AND started_at >= TIMESTAMP '{AFTER}' AND started_at <= TIMESTAMP '{BEFORE}' {_LATEST} LIMIT 200 OFFSET 2",
    "filter_tenant": f"SELECT r.* FROM runs r JOIN organizations o ON o.id = r.organization_id WHERE o.external_id = '{ORG}'",
    "filter_user": "SELECT * FROM runs WHERE user_id = (SELECT min(id) FROM users)",
    "filter_dims": "SELECT * FROM runs WHERE app_id = '1-URGENT' AND brand_id = 'brand-2' AND status = 'running'",
    "filter_parent": "SELECT * FROM runs WHERE parent_run_id = 32",
    "filter_started_range": f"SELECT * FROM runs WHERE started_at BETWEEN TIMESTAMP '{AFTER}' AND TIMESTAMP '{BEFORE}'",
    "unknown_key_is_empty": "SELECT * FROM runs WHERE organization_id = (SELECT id FROM organizations WHERE external_id = 'no such organization')",
    "page_second": f"SELECT id, started_at FROM runs {_LATEST} LIMIT 50 OFFSET 50",
    "runs_with_costs_join": "SELECT id, own FROM runs LEFT JOIN own ON run_id = id",
    "own_cost_per_run": "SELECT id, own_cost FROM own_cost",
    "own_total": "SELECT id, own_cost FROM own_cost JOIN runs USING (id) WHERE parent_run_id IS NULL",
    "price_cost_items": "SELECT * FROM priced",
    "priced_rejects": "SELECT * FROM rejected",
    "distinct_cost_names": "SELECT DISTINCT cost_name FROM cost_items",
    "read_price_list": "SELECT concat('part-', CAST(p_partkey AS STRING)) AS cost_name, TRY_CAST(CAST(p_retailprice / 10 AS STRING) AS DECIMAL(12,10)) AS unit_cost, CASE WHEN TRY_CAST(CAST(p_retailprice / 10 AS STRING) AS DECIMAL(12,10)) IS NULL THEN 'unit cost unfit' END AS reason FROM part",
    "validate_runs": "SELECT request_id, reason FROM judged",
    "validate_status_updates": _VERDICT.format(bad="status NOT IN ('completed', 'failed')", reason="status not allowed", rows="updates"),
    "validate_cost_batches": _BATCHES + "SELECT * FROM batch_verdicts",
    "lookup_runs": "SELECT DISTINCT user_id AS id, user_id IN (SELECT id FROM runs) AS found FROM events WHERE user_id IS NOT NULL",
    "check_run_exists": _VERDICT.format(bad="seq * 3 NOT IN (SELECT id FROM runs)", reason="run not found", rows="updates"),
    "update_target_exists": _VERDICT.format(bad="seq * 5 NOT IN (SELECT id FROM runs)", reason="run not found", rows="updates"),
    "check_parent_exists": "SELECT request_id, CASE WHEN seq % 7 <> 0 AND seq * 2 NOT IN (SELECT id FROM runs) THEN concat('parentRunId ', CAST(seq * 2 AS STRING), ' does not exist') END AS reason FROM requests",
    "resolve_orgs": "SELECT org AS clerkOrgId, CASE WHEN CAST(replace(org, 'org-', '') AS INTEGER) < 25 THEN replace(org, 'org-', '') ELSE concat('new-', org) END AS organization_id, count(*) AS requests FROM requests GROUP BY org",
    "resolve_users": "SELECT usr AS clerkUserId, CASE WHEN usr IS NULL THEN NULL WHEN u.id IS NOT NULL THEN CAST(u.id AS STRING) ELSE concat('new-', usr) END AS user_id, count(*) AS requests, CASE WHEN u.id IS NULL AND usr IS NOT NULL THEN arg_min(org, (ts, seq)) END AS first_organization FROM requests LEFT JOIN users u ON u.external_id = usr GROUP BY usr, u.id",
    "apply_run_defaults": "SELECT CAST(request_id AS STRING) AS id, parent AS parent_run_id, org AS organization_id, usr AS user_id, app AS app_id, nullif(brand, '') AS brand_id, CAST(NULL AS STRING) AS campaign_id, svc AS service_name, task AS task_name, 'running' AS status, CAST(NULL AS TIMESTAMP) AS completed_at FROM requests",
    "append_runs": "SELECT 'running' AS status, app AS app_id, count(*) AS n FROM requests GROUP BY app",
    "append_costs": "SELECT run_id, count(*) AS lines, CAST(sum(total) AS DECIMAL(26,10)) AS total FROM priced GROUP BY run_id",
    "read_requests": "SELECT org AS clerkOrgId, app AS appId, count(*) AS n, count(parent) AS parents FROM requests GROUP BY org, app",
    "descendants": "SELECT root, id, depth FROM below",
    "descendants_by_interval": "SELECT root, id, depth FROM below",
    "descendants_by_interval_chain": "SELECT root, id, depth FROM below",
    "is_below": "SELECT event_id, e.user_id AS id, e.user_id - e.user_id % 16 AS other, CASE WHEN a.id IS NOT NULL AND r.id IS NOT NULL THEN b.id IS NOT NULL END AS below FROM events e LEFT JOIN runs a ON a.id = e.user_id LEFT JOIN runs r ON r.id = e.user_id - e.user_id % 16 LEFT JOIN below b ON b.root = e.user_id - e.user_id % 16 AND b.id = e.user_id",
    "project_descendant": "SELECT root, depth, id, parent_run_id AS parentRunId, service_name AS serviceName, task_name AS taskName, status, started_at AS startedAt, completed_at AS completedAt FROM below JOIN runs USING (id)",
    "costs_of_descendants": "SELECT run_id, cost_name, quantity, unit_cost AS unit_cost_in_usd_cents, total AS total_cost_in_usd_cents FROM priced WHERE run_id IN (SELECT id FROM below)",
    "attach_costs_to_descendants": "SELECT b.root, b.id, b.depth, CAST(count(p.run_id) AS INTEGER) AS lines, coalesce(string_agg(p.cost_name, ',' ORDER BY p.cost_name), '') AS names FROM below b LEFT JOIN priced p ON p.run_id = b.id GROUP BY ALL",
    "descendant_own_totals": "SELECT root, id, own_cost FROM below JOIN own_cost USING (id)",
    "children_total": "SELECT root, CAST(sum(own_cost) AS DECIMAL(26,10)) AS children_cost FROM below JOIN own_cost USING (id) GROUP BY root",
    "run_cost_summary": _SUMS + _SUMMARY + " JOIN runs r ON r.id = o.id WHERE r.parent_run_id IS NULL",
    "tree_rollup_all": _SUMS + _SUMMARY,
    "tree_rollup_chain": _SUMS + _SUMMARY,
    "costs_by_run": "SELECT run_id, CAST(count(*) AS INTEGER) AS lines, string_agg(concat(cost_name, '=', CAST(total AS STRING)), ',' ORDER BY cost_name, CAST(quantity AS STRING)) AS lines_text FROM priced GROUP BY run_id",
    "run_document": _SUMS + f", s AS ({_SUMMARY}) SELECT s.id, CAST(s.own_cost AS STRING) AS ownCostInUsdCents, CAST(s.children_cost AS STRING) AS childrenCostInUsdCents, CAST(s.total_cost AS STRING) AS totalCostInUsdCents, CAST((SELECT count(*) FROM priced p WHERE p.run_id = s.id) AS INTEGER) AS lines, b.id AS descendant, CAST(o.own_cost AS STRING) AS descendant_own FROM s JOIN runs r ON r.id = s.id LEFT JOIN below b ON b.root = s.id LEFT JOIN own_cost o ON o.id = b.id WHERE r.parent_run_id IS NULL",
    "run_document_parts": "SELECT b.root AS id, b.id AS descendant, CAST(o.own_cost AS STRING) AS descendant_own, CAST((SELECT count(*) FROM priced p WHERE p.run_id = b.id) AS INTEGER) AS lines FROM below b JOIN own_cost o ON o.id = b.id",
    "write_documents": _SUMS + f", s AS ({_SUMMARY}) SELECT id, CAST(own_cost AS STRING) AS own_cost, CAST(children_cost AS STRING) AS children_cost, CAST(total_cost AS STRING) AS total_cost FROM s",
    "apply_status_updates": _STATUS,
    "stream_status_updates": _STATUS,
    "cascade_delete_runs": "SELECT id, own FROM runs LEFT JOIN own ON run_id = id WHERE id % 2 = 0",
    "evolve_add_dims": "SELECT id, status, CASE WHEN id % 2 = 0 THEN app_id ELSE 'unknown' END AS app_id, CAST(NULL AS STRING) AS brand_id, CAST(NULL AS STRING) AS campaign_id FROM runs",
    "scalar_functions": "SELECT p_partkey, CASE WHEN p_size > 25 THEN NULL ELSE nullif(p_brand, '') END AS brand, CAST(CAST(CAST(p_retailprice AS DECIMAL(10,2)) * CAST(0.333 AS DECIMAL(4,3)) AS DECIMAL(26,10)) AS STRING) AS third, TRY_CAST(CAST(p_size * 7 AS STRING) AS DECIMAL(3,1)) AS fits, true AS before FROM part",
    "read_requests_costs": _BATCHES + "SELECT b.request_id, count(l_orderkey) AS lines, CAST(CASE WHEN b.request_id % 29 = 0 THEN 0 ELSE coalesce(sum(CAST(l_quantity AS DECIMAL(20,6))), 0) END AS DECIMAL(30,6)) AS quantity, reason FROM batch_verdicts b LEFT JOIN lineitem ON l_orderkey = b.request_id GROUP BY b.request_id, reason",
    "scan_tables": "SELECT 'organizations' AS name, count(*) AS n, count(DISTINCT id) AS ids, CAST(0 AS DECIMAL(26,10)) AS amount, count(id) AS known FROM organizations UNION ALL SELECT 'users', count(*), count(DISTINCT id), 0, count(id) FROM users UNION ALL SELECT 'runs', count(*), count(DISTINCT id), 0, count(user_id) FROM runs UNION ALL SELECT 'runs_costs', count(*), count(DISTINCT concat(run_id, '/', cost_name, '/', quantity)), CAST(sum(total) AS DECIMAL(26,10)), count(*) FROM priced",
    "descendants_chain": "SELECT root, id, depth FROM below",
    "stream_status_json": _STATUS,
    "stream_status_snapshot": _STATUS,
    "stream_price_costs": _BATCHES + ", lines AS (SELECT request_id, CAST(sum(total) AS DECIMAL(26,10)) AS total FROM batch_verdicts JOIN priced ON run_id = request_id WHERE reason IS NULL GROUP BY request_id) SELECT request_id, total, CAST(NULL AS STRING) AS reason FROM lines UNION ALL SELECT request_id, NULL, coalesce(reason, concat('unknown cost: ', replace(unknown_names, ',', ', '))) FROM batch_verdicts LEFT JOIN rejected ON run_id = request_id WHERE reason IS NOT NULL OR run_id IS NOT NULL",
    "stream_create_runs": "SELECT CAST(request_id AS STRING) AS request_id, CASE WHEN bad THEN NULL WHEN CAST(replace(org, 'org-', '') AS INTEGER) < 25 THEN replace(org, 'org-', '') ELSE concat('new-', org) END AS organization_id, CASE WHEN bad OR usr IS NULL THEN NULL WHEN u.id IS NOT NULL THEN CAST(u.id AS STRING) ELSE concat('new-', usr) END AS user_id, CASE WHEN reason IS NOT NULL THEN reason WHEN parent IS NOT NULL THEN concat('parentRunId ', parent, ' does not exist') END AS reason FROM (SELECT *, reason IS NOT NULL OR parent IS NOT NULL AS bad FROM judged) LEFT JOIN users u ON u.external_id = usr",
    "stream_own_cost": "SELECT run_id, own AS own_cost FROM own",
}
_BODIES["list_runs_stored"] = _BODIES["list_runs_filtered"]
_BODIES["read_price_list_json"] = _BODIES["read_price_list"]

ORACLE_SQL = {name: _ledger(CHAIN if name.endswith("_chain") else FOREST) + body for name, body in _BODIES.items()}


def _integrity() -> str:
    rows = []
    for name, columns in (("organizations", ("id", "external_id")), ("users", ("id", "external_id")), ("runs", ("id",))):
        rows += [f"SELECT '{name}.{c} unique' AS \"constraint\", (SELECT count(*) FROM (SELECT {c} FROM {name} WHERE {c} IS NOT NULL GROUP BY {c} HAVING count(*) > 1)) AS violations" for c in columns]
    required = {
        "organizations": ("id", "external_id"), "users": ("id", "external_id", "organization_id"),
        "runs": ("id", "organization_id", "app_id", "service_name", "task_name", "status", "started_at", "created_at"),
        "runs_costs": ("run_id", "cost_name", "quantity", "unit_cost_in_usd_cents", "total_cost_in_usd_cents"),
    }
    at = {"created_at": "started_at", "unit_cost_in_usd_cents": "unit_cost", "total_cost_in_usd_cents": "total"}
    real = {"runs_costs": "priced"}
    rows += [f"SELECT '{t}.{c} not null', (SELECT count(*) FROM {real.get(t, t)} WHERE {at.get(c, c)} IS NULL)" for t, cs in required.items() for c in cs]
    for t, c, o in (("users", "organization_id", "organizations"), ("runs", "organization_id", "organizations"), ("runs", "user_id", "users"), ("runs", "parent_run_id", "runs"), ("runs_costs", "run_id", "runs")):
        rows.append(f"SELECT '{t}.{c} in {o}', (SELECT count(*) FROM {real.get(t, t)} WHERE {c} IS NOT NULL AND {c} NOT IN (SELECT id FROM {o}))")
    rows.append("SELECT 'runs.parent_run_id same organization', (SELECT count(*) FROM runs a JOIN runs b ON a.parent_run_id = b.id WHERE a.organization_id <> b.organization_id)")
    return _ledger() + " UNION ALL ".join(rows)


ORACLE_SQL["integrity_report"] = _integrity()
