"""SQL text of the canonical views, for the side-by-side check."""

from __future__ import annotations

VIEWS: dict[str, tuple[str, str]] = {}


def view(name: str, needs: str, sql: str) -> None:
    VIEWS[name] = (needs, sql)


def with_views(names: list[str], body: str) -> str:
    order: list[str] = []

    def visit(n: str) -> None:
        for dep in VIEWS[n][0].split():
            visit(dep)
        if n not in order:
            order.append(n)

    for n in names:
        visit(n)
    body = body.strip()
    if not order:
        return body
    head = ",\n".join(f"{n} AS ({VIEWS[n][1].strip()})" for n in order)
    if body[:5].upper() == "WITH ":
        return f"WITH {head},\n{body[5:]}"
    return f"WITH {head}\n{body}"


view("v_ev", "", """SELECT event_id, user_id, event_type, value, ts, epoch_us(ts) AS us,
  CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events""")
view("v_txn", "v_ev", """SELECT CAST(event_id AS VARCHAR) AS transaction_id, ts, us, CAST(user_id AS VARCHAR) AS card_id,
  CAST(value AS DECIMAL(18,2)) AS amount, 'm' || (k % 20) AS merchant_name, event_type AS merchant_category, channel,
  CAST(user_id % 5 AS VARCHAR) AS cardholder_country, CAST(k % 5 AS VARCHAR) AS merchant_country,
  CASE WHEN channel = 'online' THEN 'd' || k ELSE '' END AS device_id,
  CASE WHEN channel = 'online' THEN '10.' || (k % 8) || '.' || k || '.1' ELSE '' END AS ip_address
  FROM (SELECT *, CASE WHEN event_type IN ('click','view','purchase') THEN 'online' ELSE 'in_person' END AS channel FROM v_ev)""")
view("v_fx_all", "", """SELECT base, target, CAST(rate AS DECIMAL(18,8)) AS rate, CAST(updated_at AS DATE) AS updated_at FROM (VALUES
  ('EUR','USD',1.1,'2024-01-02'),('EUR','USD',1.3,'2023-01-02'),('GBP','USD',1.27,'2024-01-02'),
  ('USD','EUR',0.91,'2024-01-02'),('GBP','EUR',1.15,'2024-01-02')) AS t(base, target, rate, updated_at)""")
view("v_fx", "v_fx_all", "SELECT base, target, arg_max(rate, updated_at) AS rate FROM v_fx_all GROUP BY base, target")
view("v_category", "", """SELECT 'cat-' || i AS slug,
  CASE WHEN i < 5 THEN 'revenue' WHEN i < 7 THEN 'cost-of-goods-sold' WHEN i < 11 THEN 'operations' END AS parent_slug,
  CASE WHEN i = 11 THEN TRUE WHEN i < 6 THEN FALSE END AS excluded,
  CAST(CASE WHEN i = 1 THEN 20.0 WHEN i = 8 THEN 10.0 END AS DECIMAL(10,2)) AS tax_rate,
  CASE WHEN i = 1 THEN 'vat' WHEN i = 8 THEN 'gst' END AS tax_type FROM range(12) t(i)""")
view("v_ledger", "", """SELECT concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey) AS id, CAST(l_shipdate AS DATE) AS date,
  CAST(CASE WHEN l_returnflag='R' THEN -1 ELSE 1 END * l_extendedprice AS DECIMAL(18,2)) AS amount,
  CASE n_regionkey WHEN 1 THEN 'EUR' WHEN 2 THEN 'GBP' WHEN 3 THEN 'CHF' ELSE 'USD' END AS currency,
  CASE WHEN l_partkey % 20 = 0 THEN 'USD' END AS base_currency,
  CASE WHEN l_partkey % 40 = 0 THEN CAST(CASE WHEN l_returnflag='R' THEN -1 ELSE 1 END * l_extendedprice * 2 AS DECIMAL(18,2)) END AS base_amount,
  CASE WHEN l_partkey % 13 <> 0 THEN 'cat-' || (l_partkey % 14) END AS category_slug,
  CASE WHEN l_linenumber % 3 <> 0 THEN CAST(l_tax * 100 AS DECIMAL(10,2)) END AS tax_rate,
  CASE WHEN l_linenumber % 5 = 0 THEN 'vat' END AS tax_type,
  l_linestatus = 'F' AS recurring,
  CASE WHEN l_linestatus = 'F' THEN CASE l_partkey % 3 WHEN 0 THEN 'weekly' WHEN 1 THEN 'monthly' ELSE 'annually' END END AS frequency,
  'n-' || (l_partkey % 50) AS name, 'v-' || (l_partkey % 97) AS merchant_name,
  CASE WHEN l_linenumber = 7 THEN 'excluded' ELSE 'posted' END AS status, l_quantity = 13 AS internal,
  CAST(l_suppkey AS VARCHAR) AS bank_account_id, n_regionkey AS team_id
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey""")
view("v_invoice", "", """SELECT o_orderkey AS id, o_custkey AS customer_id, CAST(o_totalprice AS DECIMAL(18,2)) AS amount,
  CASE o_custkey % 4 WHEN 0 THEN 'USD' WHEN 1 THEN 'EUR' WHEN 2 THEN 'GBP' ELSE 'CHF' END AS currency,
  CASE o_orderstatus WHEN 'F' THEN 'paid' WHEN 'O' THEN 'unpaid' ELSE 'draft' END AS status,
  CAST(o_orderdate AS DATE) AS issue_date, CAST(o_orderdate AS DATE) + 30 AS due_date,
  CASE WHEN o_orderstatus = 'F' THEN CAST(last_ship AS DATE) END AS paid_at,
  CASE WHEN o_custkey % 5 = 0 THEN 'r' || (o_custkey % 100) END AS invoice_recurring_id,
  'INV-' || lpad(CAST(o_orderkey AS VARCHAR), CAST(greatest(6, length(CAST(o_orderkey AS VARCHAR))) AS INT), '0') AS invoice_number,
  o_orderpriority AS priority
  FROM orders LEFT JOIN (SELECT l_orderkey, max(l_shipdate) AS last_ship FROM lineitem GROUP BY 1) s ON o_orderkey = l_orderkey""")
view("v_line_item", "", """SELECT l_orderkey AS invoice_id, CAST(CAST(floor(l_extendedprice * 100 / l_quantity) AS DECIMAL(16,0)) * 0.01 AS DECIMAL(18,2)) AS price,
  CAST(l_quantity AS DECIMAL(18,2)) AS quantity, CAST(l_tax * 100 AS DECIMAL(18,2)) AS tax_rate,
  CAST(l_discount AS DECIMAL(18,2)) AS discount, l_partkey AS product_id FROM lineitem""")
view("v_customer", "", """SELECT c_custkey AS id, c_name AS name, n_name AS country, n_regionkey AS team_id, c_mktsegment AS segment,
  DATE '1995-01-01' + CAST(c_custkey % 2400 AS INT) AS created_at FROM customer JOIN nation ON c_nationkey = n_nationkey""")
view("v_account", "", """SELECT CAST(s_suppkey AS VARCHAR) AS id, s_name AS name, n_regionkey AS team_id, CAST(s_acctbal AS DECIMAL(18,2)) AS balance,
  CASE s_suppkey % 4 WHEN 0 THEN 'depository' WHEN 1 THEN 'other_asset' WHEN 2 THEN 'credit' ELSE 'loan' END AS type,
  CASE s_suppkey % 3 + s_suppkey % 2 WHEN 0 THEN 'USD' WHEN 1 THEN 'EUR' WHEN 2 THEN 'GBP' ELSE 'CHF' END AS currency,
  CASE WHEN s_suppkey % 10 = 0 THEN 'USD' END AS base_currency,
  CASE WHEN s_suppkey % 10 = 0 THEN CAST(s_acctbal * 2 AS DECIMAL(18,2)) END AS base_balance, s_suppkey % 7 <> 0 AS enabled
  FROM supplier JOIN nation ON s_nationkey = n_nationkey""")
view("v_time_entry", "v_ev", """SELECT event_id AS id, user_id AS assigned_id, k AS project_id, CAST(ts AS DATE) AS date,
  CAST(floor(value * 60) AS BIGINT) AS duration, k % 3 = 0 AS billed FROM v_ev""")
view("v_project", "v_time_entry", """SELECT DISTINCT project_id AS id, 'Project ' || project_id AS name,
  CAST((project_id % 9 + 1) * 10 AS DECIMAL(10,2)) AS rate, CASE WHEN project_id % 2 = 0 THEN 'USD' ELSE 'EUR' END AS currency,
  project_id % 4 <> 0 AS billable, CAST(project_id * 7 + 1 AS BIGINT) AS customer_id,
  CASE WHEN project_id % 6 = 0 THEN 'completed' ELSE 'in_progress' END AS status FROM v_time_entry""")
view("v_inbox", "", """SELECT CAST(o_orderkey AS VARCHAR) AS inbox_id, c_nationkey % 5 AS team_id, c_name || ' Ltd' AS display_name,
  CAST(o_totalprice AS DECIMAL(18,2)) AS amount, CASE WHEN c_nationkey % 3 = 0 THEN 'EUR' ELSE 'USD' END AS currency,
  CAST(o_orderdate AS DATE) AS date, CASE WHEN o_orderkey % 2 = 0 THEN 'invoice' ELSE 'expense' END AS type,
  CAST(o_totalprice AS DECIMAL(18,2)) AS base_amount, 'USD' AS base_currency
  FROM orders JOIN customer ON o_custkey = c_custkey""")
view("v_payment", "", """SELECT 'p' || o_orderkey AS transaction_id, team_id, name, -a AS amount, currency, date, -a AS base_amount, 'USD' AS base_currency
  FROM (SELECT o_orderkey, c_nationkey % 5 AS team_id, upper(c_name) AS name,
    CAST(round(CAST(o_totalprice AS DECIMAL(18,2)) * CAST(100 + o_orderkey % 5 AS DECIMAL(5,0)) * 0.01, 2) AS DECIMAL(18,2)) AS a,
    CASE WHEN c_nationkey % 3 = 0 THEN 'EUR' ELSE 'USD' END AS currency,
    CAST(o_orderdate AS DATE) + CAST(o_orderkey % 9 AS INT) AS date
  FROM orders JOIN customer ON o_custkey = c_custkey)""")
view("v_review", "v_ev", """SELECT CAST(event_id AS VARCHAR) AS transaction_id,
  CASE event_id % 6 WHEN 0 THEN 'approve' WHEN 1 THEN 'dismiss' WHEN 2 THEN 'escalate' WHEN 3 THEN 'decline' ELSE 'block' END AS action,
  us AS created_us, event_id AS seq FROM v_ev WHERE event_id % 6 < 5""")
