"""Lists, imports and exports."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import views as v
from ..operators import linkage, lists, money
from ..sources import tables as st
from .q_linkage import grams, wsim
from .registry import query
from .views_sql import view

M = "CAST(substr(merchant_name, 3) AS INT)"
view(
    "v_flagged",
    "v_ledger",
    f"""SELECT *, has_attachment AS is_fulfilled, CASE WHEN status = 'excluded' THEN 'excluded' WHEN is_synced THEN 'exported' WHEN sync_failed THEN 'export_error' WHEN has_attachment THEN 'in_review' WHEN has_suggestion THEN 'receipt_match' ELSE 'blank' END AS workflow_status
  FROM (SELECT *, {M} % 3 = 0 AS has_attachment, {M} % 5 = 0 AS has_suggestion, {M} % 7 = 0 AS is_synced, {M} % 11 = 0 AS sync_failed FROM v_ledger)""",
)


def _m():
    return F.substring("merchant_name", 3, 10).cast("int")


def _side(spark, sf, mod):
    return v.ledger(spark, sf).filter(_m() % mod == 0).select("id")


def _sync(spark, sf):
    return _side(spark, sf, 7).withColumn("sync_status", F.lit("synced")).unionByName(_side(spark, sf, 11).withColumn("sync_status", F.lit("failed")))


def _flagged(spark, sf):
    return lists.workflow_status(v.ledger(spark, sf), _side(spark, sf, 3), _side(spark, sf, 5), _sync(spark, sf))


@query("list_workflow_status", "FLT-02 JON-05", "SELECT id, workflow_status, has_attachment, has_suggestion, is_synced, sync_failed FROM v_flagged", "v_flagged")
def list_workflow_status(spark, sf):
    return _flagged(spark, sf).select("id", "workflow_status", "has_attachment", "has_suggestion", "is_synced", "sync_failed")


@query("list_ready_for_export", "AGG-42", "SELECT team_id, count(*) AS ready FROM v_flagged WHERE status <> 'excluded' AND NOT is_synced AND is_fulfilled GROUP BY 1", "v_flagged")
def list_ready_for_export(spark, sf):
    return lists.ready_for_export(_flagged(spark, sf))


@query("list_unsynced", "JON-20", "SELECT id FROM v_flagged WHERE NOT is_synced", "v_flagged")
def list_unsynced(spark, sf):
    return lists.unsynced(v.ledger(spark, sf), _sync(spark, sf)).select("id")


@query(
    "list_transactions",
    "FLT-01 FLT-03 FLT-04",
    """SELECT id, amount, category_slug FROM v_flagged WHERE date BETWEEN DATE '1997-01-01' AND DATE '1999-12-31' AND workflow_status IN ('blank','in_review') AND NOT coalesce(recurring, FALSE) AND coalesce(base_amount, amount) < 0
    AND abs(coalesce(base_amount, amount)) BETWEEN 1000 AND 60000 AND (category_slug IS NULL OR category_slug = 'cat-3' OR category_slug IN (SELECT slug FROM v_category WHERE parent_slug = 'operations'))""",
    "v_flagged v_category",
)
def list_transactions(spark, sf):
    out = lists.list_transactions(
        _flagged(spark, sf), v.category(spark), "1997-01-01", "1999-12-31", ["blank", "in_review"], ["operations", "cat-3", "uncategorized"],
        lo=1000, hi=60000, kind="expense", recurring=False,
    )
    return out.select("id", "amount", "category_slug")


@query(
    "list_transactions_flags",
    "FLT-01",
    f"""SELECT id FROM v_flagged WHERE ({M} % 4 = 0 OR {M} % 9 = 0) AND {M} % 8 IN (0, 1, 2) AND NOT coalesce({M} % 10 = 0, FALSE) AND NOT is_synced AND status NOT IN ('exported', 'excluded', 'archived') AND NOT is_fulfilled""",
    "v_flagged",
)
def list_transactions_flags(spark, sf):
    """Tagged, assigned, not manual, not exported and not fulfilled."""
    rows = _flagged(spark, sf).withColumns({"assigned_id": F.concat(F.lit("u"), (_m() % 8).cast("string")), "manual": F.when(_m() % 10 == 0, True)})
    tagged = _side(spark, sf, 4).withColumn("tag_id", F.lit("t1")).unionByName(_side(spark, sf, 9).withColumn("tag_id", F.lit("t2"))).unionByName(_side(spark, sf, 2).withColumn("tag_id", F.lit("t3")))
    return lists.list_transactions(rows, tags=["t1", "t2"], tagged=tagged, assignees=["u0", "u1", "u2"], manual="exclude", exported=False, fulfilled=False).select("id")


@query("list_search_text", "FLT-05", "SELECT id FROM v_ledger WHERE concat_ws(' ', name, merchant_name) ILIKE '%v-1%'", "v_ledger")
def list_search_text(spark, sf):
    return v.ledger(spark, sf).filter(lists.search(["name", "merchant_name"], "v-1")).select("id")


@query(
    "list_search_near",
    "FLT-06",
    """SELECT id, amount FROM v_ledger WHERE abs(abs(amount) - 20000) <= 2000 OR abs(abs(coalesce(base_amount, 0)) - 20000) <= 2000 OR concat_ws(' ', name, merchant_name) ILIKE '%20000%'""",
    "v_ledger",
)
def list_search_near(spark, sf):
    return v.ledger(spark, sf).filter(lists.search_near(["name", "merchant_name"], "20000")).select("id", "amount")


@query("list_page_first", "SRT-04", "SELECT id, amount FROM v_ledger ORDER BY amount DESC NULLS LAST, id LIMIT 25", "v_ledger")
def list_page_first(spark, sf):
    return lists.page(v.ledger(spark, sf), "amount", "id", 25).select("id", "amount")


@query("list_page_next", "SRT-04 SRT-05", "SELECT id, date FROM v_ledger WHERE date > DATE '1996-05-01' OR (date = DATE '1996-05-01' AND id > '3') ORDER BY date NULLS FIRST, id LIMIT 25", "v_ledger")
def list_page_next(spark, sf):
    return lists.page(v.ledger(spark, sf), "date", "id", 25, False, ("1996-05-01", "3")).select("id", "date")


@query("list_page_nulls", "SRT-04", "SELECT id, base_amount FROM v_ledger WHERE base_amount < -150000 OR base_amount IS NULL OR (base_amount = -150000 AND id > '3') ORDER BY base_amount DESC NULLS LAST, id LIMIT 5000", "v_ledger")
def list_page_nulls(spark, sf):
    """A page that runs on into the rows without a value."""
    return lists.page(v.ledger(spark, sf), "base_amount", "id", 5000, True, ("-150000", "3")).select("id", "base_amount")


@query("list_page_null_cursor", "SRT-04", "SELECT id, base_amount FROM v_ledger WHERE (base_amount IS NULL AND id > '5') OR base_amount IS NOT NULL ORDER BY base_amount NULLS FIRST, id LIMIT 25", "v_ledger")
def list_page_null_cursor(spark, sf):
    return lists.page(v.ledger(spark, sf), "base_amount", "id", 25, False, (None, "5")).select("id", "base_amount")


@query("list_latest_per_merchant", "SRT-08", "SELECT merchant_name, id FROM (SELECT *, row_number() OVER (PARTITION BY merchant_name ORDER BY date DESC, id) AS rn FROM v_ledger) WHERE rn = 1", "v_ledger")
def list_latest_per_merchant(spark, sf):
    return lists.latest_per(v.ledger(spark, sf), "merchant_name", "date", "id").select("merchant_name", "id")


view(
    "v_items",
    "",
    """SELECT o_orderkey AS id, o_custkey % 5 AS team_id, CASE o_orderkey % 6 WHEN 0 THEN 'new' WHEN 1 THEN 'pending' WHEN 2 THEN 'analyzing' WHEN 3 THEN 'done' WHEN 4 THEN 'suggested_match' ELSE 'deleted' END AS status,
  CASE WHEN o_orderkey % 17 = 0 THEN o_orderkey + 1 END AS grouped_inbox_id, CASE WHEN o_custkey % 3 <> 0 THEN 'Shop' || (o_custkey % 40) || '.com' END AS website, 'a' || (o_custkey % 90) || '@x.io' AS sender_email,
  o_orderdate AS created_at, CASE WHEN o_orderkey % 8 = 0 THEN o_orderkey END AS transaction_id, CASE WHEN o_orderkey % 2 = 0 THEN 'invoice' ELSE 'expense' END AS type,
  CASE WHEN o_orderkey % 4 = 0 THEN 'N' || (o_custkey % 1000) END AS invoice_number, CAST(floor(o_totalprice / 20000) AS INT) AS amount, date_trunc('year', o_orderdate)::DATE AS date FROM orders""",
)


def _items(spark, sf):
    o = v.table(spark, sf, "orders")
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    s = ("new", "pending", "analyzing", "done", "suggested_match", "deleted")
    return o.select(
        k.alias("id"),
        (c % 5).alias("team_id"),
        F.element_at(F.array(*[F.lit(x) for x in s]), (k % 6 + 1).cast("int")).alias("status"),
        F.when(k % 17 == 0, k + 1).alias("grouped_inbox_id"),
        F.when(c % 3 != 0, F.concat(F.lit("Shop"), (c % 40).cast("string"), F.lit(".com"))).alias("website"),
        F.concat(F.lit("a"), (c % 90).cast("string"), F.lit("@x.io")).alias("sender_email"),
        F.col("o_orderdate").cast("timestamp").alias("created_at"),
        F.when(k % 8 == 0, k).alias("transaction_id"),
        F.when(k % 2 == 0, "invoice").otherwise("expense").alias("type"),
        F.when(k % 4 == 0, F.concat(F.lit("N"), (c % 1000).cast("string"))).alias("invoice_number"),
        F.floor(F.col("o_totalprice") / 20000).cast("int").alias("amount"),
        F.trunc("o_orderdate", "year").alias("date"),
    )


@query(
    "inbox_list",
    "FLT-07",
    """SELECT id, status FROM v_items WHERE status IN ('new','pending') AND grouped_inbox_id IS NULL AND (website IS NULL OR lower(website) NOT IN ('shop1.com','shop3.com')) AND sender_email NOT IN ('a7@x.io')""",
    "v_items",
)
def inbox_list(spark, sf):
    blocked = spark.sql("SELECT * FROM VALUES ('Shop1.com'), ('SHOP3.com'), ('A7@x.io') AS t(value)")
    return lists.inbox_list(_items(spark, sf), blocked, ["new", "pending"]).select("id", "status")


@query("inbox_stuck", "FLT-11", "SELECT id FROM v_items WHERE status = 'new' AND created_at < TIMESTAMP '1996-01-01' - INTERVAL 30 MINUTE", "v_items")
def inbox_stuck(spark, sf):
    return lists.stuck(_items(spark, sf), "1996-01-01 00:00:00", 30).select("id")


@query(
    "inbox_age_out",
    "FLT-12",
    "SELECT team_id, count(*) AS aged FROM v_items WHERE status = 'pending' AND transaction_id IS NULL AND created_at < TIMESTAMP '1999-01-01' - INTERVAL 90 DAY GROUP BY 1",
    "v_items",
)
def inbox_age_out(spark, sf):
    return lists.age_out(_items(spark, sf), "1999-01-01 00:00:00").filter("aged").groupBy("team_id").agg(F.count("*").alias("aged"))


@query(
    "inbox_stats",
    "AGG-41",
    """SELECT team_id, count(CASE WHEN status <> 'deleted' THEN 1 END) AS total, count(CASE WHEN status = 'new' THEN 1 END) AS new, count(CASE WHEN status = 'pending' THEN 1 END) AS pending, count(CASE WHEN status = 'analyzing' THEN 1 END) AS analyzing,
    count(CASE WHEN status = 'done' THEN 1 END) AS done, count(CASE WHEN status = 'suggested_match' THEN 1 END) + count(CASE WHEN id % 10 = 0 THEN 1 END) AS suggested FROM v_items GROUP BY 1""",
    "v_items",
)
def inbox_stats(spark, sf):
    i = _items(spark, sf)
    return lists.inbox_stats(i, i.filter(F.col("id") % 10 == 0))


@query(
    "inbox_related",
    "JON-12",
    """WITH live AS (SELECT *, CASE WHEN type = 'invoice' THEN 0 ELSE 1 END AS r FROM v_items WHERE status <> 'deleted'), a AS (SELECT id, first(id) OVER (PARTITION BY team_id, invoice_number ORDER BY r, created_at, id) AS primary_id, count(*) OVER (PARTITION BY team_id, invoice_number) AS n FROM live WHERE invoice_number IS NOT NULL)
    SELECT id, primary_id, 'invoice_number' AS rule FROM a WHERE n > 1 UNION ALL SELECT id, primary_id, 'website' FROM (SELECT id, first(id) OVER (PARTITION BY team_id, website, amount, date ORDER BY r, created_at, id) AS primary_id, min(type) OVER (PARTITION BY team_id, website, amount, date) <> max(type) OVER (PARTITION BY team_id, website, amount, date) AS two
    FROM live WHERE website IS NOT NULL AND amount IS NOT NULL AND id NOT IN (SELECT id FROM a WHERE n > 1)) WHERE two""",
    "v_items",
)
def inbox_related(spark, sf):
    return lists.related_documents(_items(spark, sf))


@query(
    "list_attachment_delta",
    "JON-19",
    """SELECT coalesce(h.id, n.id) AS id, array_to_string(list_sort(list_filter(coalesce(n.l, []), lambda x: NOT list_contains(coalesce(h.l, []), x))), ',') AS added, array_to_string(list_sort(list_filter(coalesce(h.l, []), lambda x: NOT list_contains(coalesce(n.l, []), x))), ',') AS removed
    FROM (SELECT l_orderkey AS id, list(DISTINCT 'f' || l_linenumber) AS l FROM lineitem WHERE l_linenumber <= 3 GROUP BY 1) h FULL JOIN (SELECT l_orderkey AS id, list(DISTINCT 'f' || l_linenumber) AS l FROM lineitem WHERE l_linenumber >= 2 GROUP BY 1) n ON h.id = n.id""",
)
def list_attachment_delta(spark, sf):
    li = v.table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("id"), F.concat(F.lit("f"), F.col("l_linenumber").cast("string")).alias("attachment_id"), "l_linenumber")
    had = li.filter("l_linenumber <= 3").groupBy("id").agg(F.map_from_entries(F.collect_set(F.struct("attachment_id", F.lit("remote").alias("r")))).alias("attachment_map"))
    out = lists.attachment_delta(had, li.filter("l_linenumber >= 2"))
    return out.select("id", F.array_join("added", ",").alias("added"), F.array_join("removed", ",").alias("removed"))


@query(
    "list_documents",
    "FLT-16",
    """SELECT p_partkey FROM part WHERE len(list_filter(regexp_split_to_array(lower(p_name), '[^\\p{L}\\p{N}]+'), lambda w: starts_with(w, 'wid'))) > 0 AND p_size > 10 OR p_name ILIKE '%wid%' AND p_size > 10""",
)
def list_documents(spark, sf):
    p = v.table(spark, sf, "part").withColumn("title", F.col("p_name")).withColumn("doc_id", F.col("p_partkey"))
    return lists.documents_list(p, "wid", p.filter("p_size > 10"), 0.99).select("p_partkey")


@query(
    "list_activities",
    "FLT-17",
    "SELECT event_id AS id, event_type AS status FROM v_ev WHERE event_type IN ('click','signup') AND k % 10 <= 3 AND ts > TIMESTAMP '2024-01-10' AND user_id = 7 ORDER BY ts DESC, event_id LIMIT 50",
    "v_ev",
)
def list_activities(spark, sf):
    e = v._events(spark, sf).select(
        F.col("event_id").alias("id"), F.col("event_type").alias("status"), (F.col("k") % 10).alias("priority"), F.col("ts").alias("created_at"), F.col("user_id").cast("string").alias("user_id")
    )
    return lists.activities(e, ["click", "signup"], "7", 3, "2024-01-10 00:00:00").select("id", "status")


@query("list_other_category", "FLT-18", "SELECT id FROM v_ledger WHERE id <> '1-1-1-1' AND (category_slug IS NULL OR category_slug <> 'cat-3')", "v_ledger")
def list_other_category(spark, sf):
    return lists.different_category(v.ledger(spark, sf), "1-1-1-1", "cat-3").select("id")


@query(
    "list_global_search",
    "SET-05",
    """SELECT * FROM (SELECT 'customer' AS source, CAST(c_custkey AS VARCHAR) AS id, c_name AS title, CASE WHEN lower(c_name) = 'customer#00000001' THEN 1.0 WHEN starts_with(lower(c_name), 'customer#00000001') THEN 0.8 ELSE 0.5 END AS score FROM customer WHERE contains(lower(c_name), 'customer#00000001') ORDER BY score DESC, title, id LIMIT 10)
    UNION ALL SELECT * FROM (SELECT 'supplier', CAST(s_suppkey AS VARCHAR), s_name, 0.5 FROM supplier WHERE contains(lower(s_name), 'customer#00000001') LIMIT 10)""",
)
def list_global_search(spark, sf):
    return lists.search_all({"customer": (v.table(spark, sf, "customer"), "c_custkey", "c_name"), "supplier": (v.table(spark, sf, "supplier"), "s_suppkey", "s_name")}, "Customer#00000001")


@query(
    "list_popular_products",
    "SRT-10",
    "SELECT product_id, usage, last_used FROM (SELECT l_partkey AS product_id, count(*) AS usage, max(l_shipdate)::DATE AS last_used FROM lineitem GROUP BY 1) ORDER BY usage DESC, last_used DESC, product_id LIMIT 20",
)
def list_popular_products(spark, sf):
    li = v.table(spark, sf, "lineitem")
    by = li.groupBy(F.col("l_partkey").alias("product_id")).agg(F.count("*").alias("usage"), F.to_date(F.max("l_shipdate")).alias("last_used"))
    return by.orderBy(F.desc("usage"), F.desc("last_used"), "product_id").limit(20)


_INST = """SELECT s_suppkey AS id, s_name || ' ' || n_name AS name, s_acctbal AS popularity FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
  WHERE s_suppkey % 10 <> 0 AND s_suppkey % 3 <> 1 AND r_name = 'ASIA'"""


def _institutions(spark, sf):
    n = v.table(spark, sf, "nation").join(F.broadcast(v.table(spark, sf, "region")), F.col("n_regionkey") == F.col("r_regionkey"))  # fixed tables
    s, k = v.table(spark, sf, "supplier"), F.col("s_suppkey")
    return s.join(F.broadcast(n), F.col("s_nationkey") == F.col("n_nationkey")).select(
        k.alias("id"), F.concat_ws(" ", "s_name", "n_name").alias("name"), F.array("n_name", "r_name").alias("countries"), F.col("s_acctbal").alias("popularity"),
        F.concat(F.lit("p"), (k % 3).cast("string")).alias("provider"), F.when(k % 10 == 0, "removed").otherwise("active").alias("status"),
    )


@query("list_institutions", "SRT-10", f"{_INST} ORDER BY popularity DESC, id LIMIT 50")
def list_institutions(spark, sf):
    return lists.institutions(_institutions(spark, sf), "ASIA", without_providers=("p1",)).select("id", "name", "popularity")


@query(
    "list_institutions_search",
    "SRT-10 FN-10",
    f"""SELECT id, name, popularity, round(fit, 6) AS fit FROM (SELECT *, {wsim('a', 'b')} AS fit FROM (SELECT *, list_distinct({grams("'supplier japan'")}) AS a, {grams('name')} AS b FROM ({_INST})))
    WHERE contains(lower(name), 'supplier japan') OR fit > 0.3 ORDER BY fit DESC, popularity DESC, id LIMIT 50""",
)
def list_institutions_search(spark, sf):
    out = lists.institutions(_institutions(spark, sf), "ASIA", "Supplier Japan", without_providers=("p1",))
    return out.select("id", "name", "popularity", F.round("fit", 6).alias("fit"))


@query(
    "list_rows_with_tags",
    "JON-06",
    "SELECT o_orderkey, coalesce(t, '') AS tags FROM orders LEFT JOIN (SELECT l_orderkey, string_agg(DISTINCT l_returnflag || ':' || l_linestatus, ',' ORDER BY l_returnflag || ':' || l_linestatus) AS t FROM lineitem GROUP BY 1) ON o_orderkey = l_orderkey",
)
def list_rows_with_tags(spark, sf):
    o = v.table(spark, sf, "orders").select("o_orderkey")
    parts = v.table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), F.col("l_returnflag").alias("name"), F.col("l_linestatus").alias("kind")).distinct()
    out = lists.nested(o, parts, "o_orderkey", ["name", "kind"], "items")
    return out.select("o_orderkey", F.array_join(F.transform("items", lambda x: F.concat_ws(":", x["name"], x["kind"])), ",").alias("tags"))


@query("list_similar_vendors", "JON-23")
def list_similar_vendors(spark, sf):
    t = v.ledger(spark, sf).withColumn("merchant_name", F.concat(F.translate("merchant_name", "-", ""), F.when(F.col("team_id") % 2 == 0, " Ltd").otherwise(" Store")))
    roots = lists.latest_per(t, "merchant_name", "date", "id")
    return lists.similar_vendors(t, roots)


@query("account_relink", "JON-11")
def account_relink(spark, sf):
    a = v.account(spark, sf)
    k = F.col("id").cast("long")
    stored = a.select("id", "team_id", "name", "currency", "type", F.when(k % 3 == 0, F.concat(F.lit("ref-"), "id")).alias("reference"), F.when(k % 2 == 0, F.concat(F.lit("iban-"), "id")).alias("iban"))
    api = a.select(F.concat(F.lit("api-"), "id").alias("id"), "team_id", F.upper("name").alias("name"), F.when(k % 5 == 0, "XXX").otherwise(F.col("currency")).alias("currency"), "type", F.concat(F.lit("ref-"), "id").alias("reference"), F.concat(F.lit("iban-"), "id").alias("iban"))
    return lists.relink_accounts(api, stored, linkage.assign_one_to_one)


# ---- sources


@query(
    "import_transform",
    "SRC-09 SRC-10 FN-07 FN-08",
    """SELECT 't1_' || substr(sha256(concat_ws('|', 'acc', CAST(d AS VARCHAR), CASE WHEN a = round(a, 0) THEN CAST(CAST(a AS BIGINT) AS VARCHAR) WHEN a = round(a, 1) THEN CAST(CAST(a AS DECIMAL(18,1)) AS VARCHAR) ELSE CAST(a AS VARCHAR) END, 'usd', lower(trim(o_orderpriority)), '')), 1, 24) AS internal_id, d AS date, a AS amount, CASE WHEN a > 0 THEN 'income' END AS category_slug
    FROM (SELECT CAST(o_orderdate AS DATE) AS d, CAST(CASE WHEN o_orderkey % 2 = 0 THEN -1 ELSE 1 END * o_totalprice AS DECIMAL(18,2)) AS a, o_orderpriority FROM orders)""",
)
def import_transform(spark, sf):
    o = v.table(spark, sf, "orders")
    k = F.col("o_orderkey")
    plain = v.dec("o_totalprice").cast("string")
    size = F.when(k % 3 == 0, F.replace(plain, F.lit("."), F.lit(","))).otherwise(plain)
    raw = o.select(
        F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm").alias("when"),
        F.when(k % 2 == 0, F.concat(F.lit("−"), size)).otherwise(size).alias("sum"),
        F.col("o_orderpriority").alias("text"),
        F.lit("").alias("party"),
    )
    rows = st.map_rows(raw, {"date": "when", "amount": "sum", "description": "text", "counterparty": "party"}, "usd", "t1", "acc")
    return st.import_transform(rows).select("internal_id", "date", "amount", "category_slug")


@query(
    "import_validation",
    "SRC-11",
    """SELECT 'valid' AS result, count(*) AS n FROM orders WHERE o_orderkey % 10 <> 0 UNION ALL SELECT 'amount', count(*) FROM orders WHERE o_orderkey % 10 = 0""",
)
def import_validation(spark, sf):
    o = v.table(spark, sf, "orders")
    rows = o.select(
        F.when(F.col("o_orderkey") % 10 != 0, F.col("o_totalprice")).alias("amount"), F.col("o_orderdate").alias("date"), F.lit("x").alias("name"), F.lit("USD").alias("currency"),
        F.lit("posted").alias("status"), F.lit("other").alias("method"),
    )
    good, bad = st.import_validate(rows)
    counts = good.agg(F.count("*").alias("n")).select(F.lit("valid").alias("result"), "n")
    return counts.unionByName(bad.groupBy(F.array_join("errors", ",").alias("result")).agg(F.count("*").alias("n")))


@query(
    "source_validation",
    "SRC-01 SRC-02",
    """SELECT 'duplicate_id' AS rule, count(*) AS n FROM (SELECT event_id % 9000 AS x FROM events GROUP BY 1 HAVING count(*) > 1) UNION ALL SELECT 'bad_amount', count(*) FROM events WHERE event_id % 100 = 0 OR value < 0 UNION ALL SELECT 'bad_timestamp', count(*) FROM events WHERE event_id % 250 = 1""",
)
def source_validation(spark, sf):
    e = v._events(spark, sf)
    k = F.col("event_id")
    raw = e.select(
        (k % 9000).cast("string").alias("transaction_id"),
        F.when(k % 250 == 1, "not a time").otherwise(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")).alias("timestamp"),
        F.col("user_id").cast("string").alias("card_id"),
        F.when(k % 100 == 0, "n/a").otherwise(F.col("value").cast("string")).alias("amount"),
        *[F.lit("x").alias(c) for c in st.TRANSACTION_COLUMNS[4:]],
    )
    return st.violations(raw).select("rule", "n")


@query(
    "source_normalize",
    "SRC-01",
    "SELECT CAST(event_id AS VARCHAR) AS transaction_id, us // 1000000 AS sec, CAST(value AS DECIMAL(18,2)) AS amount FROM v_ev",
    "v_ev",
)
def source_normalize(spark, sf):
    e = v._events(spark, sf)
    raw = e.select(F.col("event_id").cast("string").alias("transaction_id"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("timestamp"), F.col("user_id").cast("string").alias("card_id"), F.col("value").cast("string").alias("amount"), *[F.lit(None).cast("string").alias(c) for c in st.TRANSACTION_COLUMNS[4:]])
    return st.normalize_transactions(raw).select("transaction_id", F.floor(F.col("us") / 1_000_000).alias("sec"), "amount")


@query(
    "insert_absent",
    "SRC-19",
    "SELECT event_id AS seq, user_id AS key FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS rn FROM events) WHERE rn = 1 AND user_id NOT IN (SELECT user_id FROM events WHERE event_type = 'signup' AND user_id % 2 = 0)",
)
def insert_absent(spark, sf):
    e = v._events(spark, sf).select(F.col("user_id").alias("key"), F.col("event_id").alias("seq"), "event_type")
    have = e.filter((F.col("event_type") == "signup") & (F.col("key") % 2 == 0)).select("key").distinct()
    return st.insert_absent(have, e.select("key", "seq"), "key", "seq")


@query(
    "upsert_products",
    "SRC-20",
    """SELECT coalesce(a.id, b.id) AS id, CASE WHEN a.id IS NOT NULL AND b.id IS NOT NULL THEN a.n + 1 ELSE coalesce(a.n, b.n) END AS usage_count, CASE WHEN b.id IS NOT NULL AND a.id IS NOT NULL THEN b.price ELSE coalesce(a.price, b.price) END AS price
    FROM (SELECT l_partkey AS id, count(*) AS n, max(l_extendedprice) AS price FROM lineitem WHERE l_linenumber < 4 GROUP BY 1) a FULL JOIN (SELECT l_partkey AS id, 1 AS n, max(l_extendedprice) AS price FROM lineitem WHERE l_linenumber >= 4 GROUP BY 1) b ON a.id = b.id""",
)
def upsert_products(spark, sf):
    li = v.table(spark, sf, "lineitem")
    old = li.filter("l_linenumber < 4").groupBy(F.col("l_partkey").alias("id")).agg(F.count("*").alias("usage_count"), F.max("l_extendedprice").alias("price"))
    new = li.filter("l_linenumber >= 4").groupBy(F.col("l_partkey").alias("id")).agg(F.lit(1).cast("long").alias("usage_count"), F.max("l_extendedprice").alias("price"))
    return st.upsert(old, new, ["id"], {"usage_count": F.col("t_usage_count") + 1, "price": F.col("n_price")})


@query(
    "upsert_rates",
    "SRC-20",
    """SELECT coalesce(a.base, b.base) AS base, coalesce(a.target, b.target) AS target, coalesce(b.r.rate, a.r.rate) AS rate, coalesce(b.r.at, a.r.at) AS updated_at
    FROM (SELECT o_orderpriority AS base, CAST(o_custkey % 200 AS VARCHAR) AS target, max({'at': CAST(o_orderdate AS DATE), 'rate': o_totalprice}) AS r FROM orders WHERE CAST(o_orderdate AS DATE) < DATE '1996-01-01' GROUP BY 1, 2) a
    FULL JOIN (SELECT o_orderpriority AS base, CAST(o_custkey % 200 AS VARCHAR) AS target, max({'at': CAST(o_orderdate AS DATE), 'rate': o_totalprice}) AS r FROM orders WHERE CAST(o_orderdate AS DATE) >= DATE '1996-01-01' GROUP BY 1, 2) b ON a.base = b.base AND a.target = b.target""",
)
def upsert_rates(spark, sf):
    """The rates of the early orders put into an empty table, those of the later ones over them."""
    day = F.to_date("o_orderdate")
    feed = v.table(spark, sf, "orders").select(F.col("o_orderpriority").alias("base"), (F.col("o_custkey") % 200).cast("string").alias("target"), F.col("o_totalprice").alias("rate"), day.alias("updated_at"))
    early = F.col("updated_at") < F.lit("1996-01-01").cast("date")
    return st.upsert_rates(st.upsert_rates(feed.limit(0), feed.where(early)), feed.where(~early))


@query(
    "upsert_suggestions",
    "SRC-20",
    """SELECT coalesce(a.i, b.i) AS inbox_id, coalesce(a.t, b.t) AS transaction_id, CASE WHEN b.i IS NULL OR a.r.status IN ('confirmed', 'declined') THEN a.r.score ELSE b.r.score END AS confidence,
      CASE WHEN b.i IS NULL OR a.r.status IN ('confirmed', 'declined') THEN a.r.status ELSE b.r.status END AS status
    FROM (SELECT l_partkey AS i, l_suppkey AS t, max({'at': l_orderkey * 10 + l_linenumber, 'score': l_discount, 'status': ['confirmed', 'declined', 'pending', 'expired'][CAST(l_orderkey % 4 + 1 AS INT)]}) AS r FROM lineitem WHERE l_orderkey % 3 <> 0 GROUP BY 1, 2) a
    FULL JOIN (SELECT l_partkey AS i, l_suppkey AS t, max({'at': l_orderkey * 10 + l_linenumber, 'score': l_discount, 'status': CASE WHEN l_orderkey % 2 = 0 THEN 'unmatched' ELSE 'pending' END}) AS r FROM lineitem WHERE l_orderkey % 3 = 0 GROUP BY 1, 2) b ON a.i = b.i AND a.t = b.t""",
)
def upsert_suggestions(spark, sf):
    k = F.col("l_orderkey")
    rows = v.table(spark, sf, "lineitem").select(
        F.col("l_partkey").alias("inbox_id"), F.col("l_suppkey").alias("transaction_id"), F.col("l_discount").alias("confidence"), (k * 10 + F.col("l_linenumber")).alias("updated_at"), k
    )
    old = rows.where(k % 3 != 0).withColumn("status", F.element_at(F.array(*[F.lit(s) for s in ("confirmed", "declined", "pending", "expired")]), (k % 4 + 1).cast("int"))).drop("l_orderkey")
    new = rows.where(k % 3 == 0).withColumn("status", F.when(k % 2 == 0, "unmatched")).drop("l_orderkey")
    return st.upsert_suggestions(st.upsert_suggestions(old.limit(0), old), new).select("inbox_id", "transaction_id", "confidence", "status")


@query(
    "fx_feed_flatten",
    "SRC-18",
    "SELECT DISTINCT n_name AS base, r AS target, CAST(n_nationkey + length(r) AS DOUBLE) AS rate FROM nation, (SELECT r_name AS r FROM region) UNION ALL SELECT n_name, 'EXTRA', 1 FROM nation",
)
def fx_feed_flatten(spark, sf):
    r = v.table(spark, sf, "region").agg(F.collect_set("r_name").alias("_names"))
    n = v.table(spark, sf, "nation").join(F.broadcast(r))  # one row
    rates = F.map_concat(
        F.map_from_entries(F.transform("_names", lambda x: F.struct(x, (F.col("n_nationkey") + F.length(x)).cast("double")))),
        F.create_map(F.lit("EXTRA"), F.lit(1.0), F.col("n_name"), F.lit(1.0)),
    )
    return st.flatten_rates(n.select(F.col("n_name").alias("source"), F.lit("2024-01-01").alias("date"), rates.alias("rates"))).select("base", "target", "rate")


@query(
    "balance_primary",
    "SRC-16 SRC-17",
    """SELECT l_suppkey AS account_id, l_returnflag AS balance_type, l_extendedprice AS amount FROM (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY CASE l_returnflag WHEN 'A' THEN 0 WHEN 'R' THEN 1 ELSE 2 END, CASE WHEN l_linestatus = 'F' THEN 0 ELSE 1 END,
    CASE WHEN l_returnflag IN ('A','R') THEN -abs(l_extendedprice) ELSE 0 END, l_orderkey * 10 + l_linenumber, l_partkey) AS rn FROM lineitem) WHERE rn = 1""",
)
def balance_primary(spark, sf):
    li = v.table(spark, sf, "lineitem").select(
        F.col("l_suppkey").alias("account_id"), F.col("l_returnflag").alias("balance_type"), F.col("l_extendedprice").alias("amount"), F.when(F.col("l_linestatus") == "F", "usd").otherwise("eur").alias("currency"),
        F.struct((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("a"), F.col("l_partkey").alias("b")).alias("seq"),
    )
    return st.primary_balance(li, [["A"], ["R"]], "USD").select("account_id", "balance_type", "amount")


@query(
    "source_profile",
    "SRC-25",
    """SELECT 'total' AS metric, 'rows' AS key, CAST(count(*) AS DECIMAL(28,2)) AS value FROM v_txn UNION ALL SELECT 'total', 'cards', count(DISTINCT card_id) FROM v_txn UNION ALL SELECT 'total', 'merchants', count(DISTINCT merchant_name) FROM v_txn UNION ALL SELECT 'total', 'first_us', min(us) FROM v_txn
    UNION ALL SELECT 'total', 'last_us', max(us) FROM v_txn UNION ALL SELECT 'category_rows', merchant_category, count(*) FROM v_txn GROUP BY 2 UNION ALL SELECT 'channel_rows', channel, count(*) FROM v_txn GROUP BY 2 UNION ALL SELECT 'category_amount', merchant_category, sum(amount) FROM v_txn GROUP BY 2""",
    "v_txn",
)
def source_profile(spark, sf):
    return st.profile(v.txn(spark, sf))


@query(
    "source_arrival_gaps",
    "WIN-20 SRC-25",
    "SELECT gap_us, count(*) AS n FROM (SELECT us - lag(us) OVER (ORDER BY us) AS gap_us FROM v_txn) WHERE gap_us > 0 GROUP BY 1",
    "v_txn",
)
def source_arrival_gaps(spark, sf):
    return st.arrival_gaps(v.txn(spark, sf))


@query(
    "export_accounting",
    "SRC-24 FN-19 FN-31",
    """SELECT id, tax, CAST(round(CAST(tax * (base_amount / amount) AS DECIMAL(28,8)), 2) AS DECIMAL(18,2)) AS base_tax, tags, completed FROM (SELECT id, amount, base_amount, merchant_name AS tags, has_attachment AS completed,
    CAST(CASE WHEN tax_rate IS NOT NULL THEN (2 * CAST(abs(amount) * 100 AS HUGEINT) * CAST(tax_rate * 100 AS HUGEINT) + CAST((100 + tax_rate) * 100 AS HUGEINT)) // (2 * CAST((100 + tax_rate) * 100 AS HUGEINT)) END AS DECIMAL(18,2)) / 100 AS t0, CAST(t0 AS DECIMAL(18,2)) AS tax FROM v_flagged)""",
    "v_flagged",
)
def export_accounting(spark, sf):
    led = v.ledger(spark, sf)
    tags = led.select("id", F.col("merchant_name").alias("tag"))
    out = st.accounting_rows(led, tags, _side(spark, sf, 3), F.lit(None).cast("decimal(10,2)"))
    return out.select("id", "tax", "base_tax", "tags", "completed")


@query(
    "tax_net_gross",
    "FN-19",
    """SELECT id, CAST(CAST((2 * CAST(abs(amount) * 100 AS HUGEINT) * r + 10000 + r) // (2 * (10000 + r)) AS DECIMAL(18,2)) / 100 AS DECIMAL(18,2)) AS tax, CAST(CAST((2 * CAST(abs(amount) * 100 AS HUGEINT) * (10000 + r) + 10000) // 20000 AS DECIMAL(28,2)) / 100 AS DECIMAL(18,2)) AS gross
    FROM (SELECT id, amount, CAST(tax_rate * 100 AS HUGEINT) AS r FROM v_ledger WHERE tax_rate IS NOT NULL)""",
    "v_ledger",
)
def tax_net_gross(spark, sf):
    led = v.ledger(spark, sf).filter(F.col("tax_rate").isNotNull())
    a, r = F.abs("amount"), F.col("tax_rate")
    return led.select("id", money.tax_from_gross(a, r).alias("tax"), money.gross_from_net(a, r).alias("gross"))


@query(
    "base_currency_amounts",
    "FN-31 JON-03",
    "SELECT id, CAST(round(amount * CASE WHEN currency = 'USD' THEN 1 ELSE coalesce(rate, 1) END, 2) AS DECIMAL(18,2)) AS base FROM v_ledger LEFT JOIN (SELECT base AS b, rate FROM v_fx WHERE target = 'USD') ON currency = b",
    "v_ledger v_fx",
)
def base_currency_amounts(spark, sf):
    led = money.with_rate(v.ledger(spark, sf), v.fx(spark), "USD")
    return led.select("id", money.to_base(F.col("amount"), F.col("_rate"), F.col("currency") == "USD").alias("base"))


@query(
    "enrichment_merge",
    "FN-30",
    f"SELECT id, CASE WHEN {M} % 2 = 0 THEN upper(merchant_name) ELSE merchant_name END AS merchant_name, CASE WHEN category_slug IS NULL AND amount <= 0 THEN CASE WHEN {M} % 3 = 0 THEN 'meals' ELSE 'uncategorized' END ELSE category_slug END AS category_slug FROM v_ledger",
    "v_ledger",
)
def enrichment_merge(spark, sf):
    led = v.ledger(spark, sf)
    e = led.withColumn("new_merchant", F.upper("merchant_name")).withColumn("new_confidence", F.when(_m() % 2 == 0, 0.9).otherwise(0.2)).withColumn("new_category", F.when(_m() % 3 == 0, "meals"))
    return st.enrich_merge(e).select("id", "merchant_name", "category_slug")


# ---- bank feeds: JSON of each shape made from the ledger, read back to canonical rows

A = "struct<transaction_id:string,date:string,name:string,original_description:string,merchant_name:string,transaction_code:string,amount:double,iso_currency_code:string,unofficial_currency_code:string,category:struct<primary:string>,counterparties:array<struct<name:string>>,pending:boolean>"
B = "struct<internalTransactionId:string,bookingDate:string,creditorName:string,debtorName:string,additionalInformation:string,remittanceInformationUnstructuredArray:array<string>,remittanceInformationUnstructured:string,proprietaryBankTransactionCode:string,transactionAmount:struct<amount:string,currency:string>,balanceAfterTransaction:struct<amount:string>,currencyExchange:array<struct<exchangeRate:string,sourceCurrency:string>>>"
C = "struct<id:string,date:string,amount:string,description:string,type:string,running_balance:string,details:struct<category:string,counterparty:struct<name:string>>>"
D = "struct<entry_reference:string,booking_date:string,transaction_amount:struct<amount:string,currency:string>,credit_debit_indicator:string,remittance_information:array<string>,debtor:struct<name:string>,creditor:struct<name:string>,balance_after:struct<amount:string>,status:string>"


def _json(led, kind):
    amt, day, cur = F.col("amount"), F.col("date").cast("string"), F.col("currency")
    if kind == "a":
        s = F.struct(
            F.col("id").alias("transaction_id"), day.alias("date"), F.col("name").alias("name"), F.col("merchant_name").alias("merchant_name"), (-amt.cast("double")).alias("amount"), F.lower(cur).alias("iso_currency_code"),
            F.when(_m() % 2 == 0, "atm").otherwise("x").alias("transaction_code"), F.struct(F.when(_m() % 3 == 0, "GENERAL_MERCHANDISE").when(_m() % 3 == 1, "TRAVEL").alias("primary")).alias("category"), (_m() % 4 == 0).alias("pending"),
        )
    elif kind == "b":
        s = F.struct(F.col("id").alias("internalTransactionId"), day.alias("bookingDate"), F.when(_m() % 2 == 0, F.col("merchant_name")).alias("creditorName"), F.array(F.col("name")).alias("remittanceInformationUnstructuredArray"), F.lit("Transfer").alias("proprietaryBankTransactionCode"), F.struct(amt.cast("string").alias("amount"), cur.alias("currency")).alias("transactionAmount"))
    elif kind == "c":
        s = F.struct(F.col("id").alias("id"), day.alias("date"), amt.cast("string").alias("amount"), F.col("merchant_name").alias("description"), F.when(_m() % 5 == 0, "fee").otherwise("card_payment").alias("type"), F.struct(F.when(_m() % 2 == 0, "dining").alias("category")).alias("details"))
    else:
        s = F.struct(F.when(_m() % 2 == 0, F.col("id")).alias("entry_reference"), day.alias("booking_date"), F.struct(F.abs(amt).cast("string").alias("amount"), cur.alias("currency")).alias("transaction_amount"), F.when(amt > 0, "CRDT").otherwise("DBIT").alias("credit_debit_indicator"), F.array(F.col("name")).alias("remittance_information"), F.lit("BOOK").alias("status"))
    return F.to_json(s)


_FEEDS = {
    "a": ("SRC-12", st.feed_a, A, f"SELECT id, date, amount, currency, CASE WHEN amount > 0 THEN 'income' WHEN {M} % 3 = 0 THEN CASE WHEN abs(amount) < 500 THEN 'office-supplies' ELSE 'equipment' END WHEN {M} % 3 = 1 THEN 'travel' END AS category, CASE WHEN {M} % 2 = 0 THEN 'card_atm' ELSE 'other' END AS method, CASE WHEN {M} % 4 = 0 THEN 'pending' ELSE 'posted' END AS status FROM v_ledger"),
    "b": ("SRC-13", st.feed_b, B, "SELECT id, date, amount, currency, CASE WHEN amount > 0 THEN 'income' END AS category, 'transfer' AS method, 'posted' AS status FROM v_ledger"),
    "c": ("SRC-14", st.feed_c, C, f"SELECT id, date, CASE WHEN team_id = 2 THEN -amount ELSE amount END AS amount, 'USD' AS currency, CASE WHEN {M} % 5 = 0 THEN 'fees' WHEN CASE WHEN team_id = 2 THEN -amount ELSE amount END > 0 THEN 'income' WHEN {M} % 2 = 0 THEN 'meals' END AS category, CASE WHEN {M} % 5 = 0 THEN 'other' ELSE 'card_purchase' END AS method, 'posted' AS status FROM v_ledger"),
    "d": ("SRC-15", st.feed_d, D, f"SELECT CASE WHEN {M} % 2 = 0 THEN id ELSE md5(concat_ws('-', date, abs(amount), currency, CASE WHEN amount > 0 THEN 'CRDT' ELSE 'DBIT' END, name)) END AS id, date, amount, currency, CASE WHEN amount > 0 THEN 'income' END AS category, 'other' AS method, 'posted' AS status FROM v_ledger"),
}
for _k, (_id, _fn, _schema, _sql) in _FEEDS.items():

    @query(f"bank_feed_{_k}", _id, _sql, "v_ledger")
    def bank_feed(spark, sf, _k=_k, _fn=_fn, _schema=_schema):
        led = v.ledger(spark, sf)
        rows = led.select(_json(led, _k).alias("value"), F.when(F.col("team_id") == 2, "credit").otherwise("depository").alias("account_type"))
        out = _fn(rows.select(F.from_json("value", _schema).alias("r"), "account_type"))
        return out.select("id", "date", "amount", "currency", "category", "method", "status")
