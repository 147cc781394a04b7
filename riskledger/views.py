"""Canonical views: the driver tables read as transactions, ledger, invoices and so on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed parameters of the card view: its categories and amounts are not those of a card feed.
TXN_HIGH_RISK = ("purchase", "signup")
TXN_SMALL = 25
TXN_HIGH = 150


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def dec(c, scale: int = 2) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast(f"decimal(18,{scale})")


def _events(spark, sf) -> DataFrame:
    return table(spark, sf, "events").select(
        "event_id",
        "user_id",
        "event_type",
        "value",
        F.col("ts").cast("timestamp").alias("ts"),
        F.unix_micros(F.col("ts").cast("timestamp")).alias("us"),
        F.get_json_object("props", "$.k").cast("int").alias("k"),
    )


def txn(spark, sf) -> DataFrame:
    online = F.col("event_type").isin("click", "view", "purchase")
    k = F.col("k").cast("string")
    return _events(spark, sf).select(
        F.col("event_id").cast("string").alias("transaction_id"),
        "ts",
        "us",
        F.col("user_id").cast("string").alias("card_id"),
        dec("value").alias("amount"),
        F.concat(F.lit("m"), (F.col("k") % 20).cast("string")).alias("merchant_name"),
        F.col("event_type").alias("merchant_category"),
        F.when(online, "online").otherwise("in_person").alias("channel"),
        (F.col("user_id") % 5).cast("string").alias("cardholder_country"),
        (F.col("k") % 5).cast("string").alias("merchant_country"),
        F.when(online, F.concat(F.lit("d"), k)).otherwise("").alias("device_id"),
        F.when(online, F.concat(F.lit("10."), (F.col("k") % 8).cast("string"), F.lit("."), k, F.lit(".1")))
        .otherwise("")
        .alias("ip_address"),
    )


def fx(spark, sf=None) -> DataFrame:
    """The four fixed rates plus an older EUR->USD one."""
    return spark.sql(
        """SELECT base, target, CAST(rate AS DECIMAL(18,8)) AS rate, CAST(updated_at AS DATE) AS updated_at FROM VALUES
        ('EUR','USD',1.1,'2024-01-02'),('EUR','USD',1.3,'2023-01-02'),('GBP','USD',1.27,'2024-01-02'),
        ('USD','EUR',0.91,'2024-01-02'),('GBP','EUR',1.15,'2024-01-02') AS t(base, target, rate, updated_at)"""
    )


def category(spark, sf=None) -> DataFrame:
    """Twelve slugs: 0-4 income, 5-6 below cost of goods, 7-10 expense, 11 excluded."""
    i = F.col("id")
    return spark.range(12).select(
        F.concat(F.lit("cat-"), i.cast("string")).alias("slug"),
        F.when(i < 5, "revenue").when(i < 7, "cost-of-goods-sold").when(i < 11, "operations").alias("parent_slug"),
        F.when(i == 11, True).when(i < 6, False).cast("boolean").alias("excluded"),
        F.when(i == 1, 20.0).when(i == 8, 10.0).cast("decimal(10,2)").alias("tax_rate"),
        F.when(i == 1, "vat").when(i == 8, "gst").alias("tax_type"),
    )


def ledger(spark, sf) -> DataFrame:
    li = table(spark, sf, "lineitem")
    su = table(spark, sf, "supplier").select("s_suppkey", "s_nationkey")
    na = table(spark, sf, "nation").select("n_nationkey", "n_regionkey")
    sign = F.when(F.col("l_returnflag") == "R", -1).otherwise(1)
    currency = (
        F.when(F.col("n_regionkey") == 1, "EUR").when(F.col("n_regionkey") == 2, "GBP").when(F.col("n_regionkey") == 3, "CHF")
    )
    return (
        li.join(su, li.l_suppkey == su.s_suppkey)
        .join(F.broadcast(na), F.col("s_nationkey") == F.col("n_nationkey"))  # 25 rows
        .select(
            F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("id"),
            F.to_date("l_shipdate").alias("date"),
            dec(sign * F.col("l_extendedprice")).alias("amount"),
            F.coalesce(currency, F.lit("USD")).alias("currency"),
            # a twentieth of the foreign rows carry a USD base currency, half of those without a base amount
            F.when(F.col("l_partkey") % 20 == 0, "USD").alias("base_currency"),
            F.when(F.col("l_partkey") % 40 == 0, dec(sign * F.col("l_extendedprice") * 2)).alias("base_amount"),
            F.when(F.col("l_partkey") % 13 == 0, F.lit(None))
            .otherwise(F.concat(F.lit("cat-"), (F.col("l_partkey") % 14).cast("string")))
            .alias("category_slug"),
            F.when(F.col("l_linenumber") % 3 != 0, (F.col("l_tax") * 100).cast("decimal(10,2)")).alias("tax_rate"),
            F.when(F.col("l_linenumber") % 5 == 0, "vat").alias("tax_type"),
            (F.col("l_linestatus") == "F").alias("recurring"),
            F.when(F.col("l_linestatus") == "F", F.element_at(F.array(F.lit("weekly"), F.lit("monthly"), F.lit("annually")), (F.col("l_partkey") % 3 + 1).cast("int"))).alias("frequency"),
            F.concat(F.lit("n-"), (F.col("l_partkey") % 50).cast("string")).alias("name"),
            F.concat(F.lit("v-"), (F.col("l_partkey") % 97).cast("string")).alias("merchant_name"),
            F.when(F.col("l_linenumber") == 7, "excluded").otherwise("posted").alias("status"),
            (F.col("l_quantity") == 13).alias("internal"),
            F.col("l_suppkey").cast("string").alias("bank_account_id"),
            F.col("n_regionkey").alias("team_id"),
        )
    )


def invoice(spark, sf) -> DataFrame:
    paid = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.max("l_shipdate").alias("last_ship"))
    o = table(spark, sf, "orders")
    status = F.when(F.col("o_orderstatus") == "F", "paid").when(F.col("o_orderstatus") == "O", "unpaid").otherwise("draft")
    return o.join(paid, o.o_orderkey == paid.l_orderkey, "left").select(
        F.col("o_orderkey").alias("id"),
        F.col("o_custkey").alias("customer_id"),
        dec("o_totalprice").alias("amount"),
        F.element_at(F.array(F.lit("USD"), F.lit("EUR"), F.lit("GBP"), F.lit("CHF")), (F.col("o_custkey") % 4 + 1).cast("int")).alias("currency"),
        status.alias("status"),
        F.to_date("o_orderdate").alias("issue_date"),
        F.date_add(F.to_date("o_orderdate"), 30).alias("due_date"),
        F.when(status == "paid", F.to_date("last_ship")).alias("paid_at"),
        F.when(F.col("o_custkey") % 5 == 0, F.concat(F.lit("r"), (F.col("o_custkey") % 100).cast("string"))).alias("invoice_recurring_id"),
        F.concat(F.lit("INV-"), F.lpad(F.col("o_orderkey").cast("string"), F.greatest(F.lit(6), F.length(F.col("o_orderkey").cast("string"))), F.lit("0"))).alias("invoice_number"),
        F.col("o_orderpriority").alias("priority"),
    )


def line_item(spark, sf) -> DataFrame:
    return table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("invoice_id"),
        (F.floor(F.col("l_extendedprice") * 100 / F.col("l_quantity")).cast("decimal(16,0)") * F.lit("0.01").cast("decimal(3,2)")).cast("decimal(18,2)").alias("price"),
        dec("l_quantity").alias("quantity"),
        dec(F.col("l_tax") * 100).alias("tax_rate"),
        dec("l_discount").alias("discount"),
        F.col("l_partkey").alias("product_id"),
    )


def customer(spark, sf) -> DataFrame:
    na = table(spark, sf, "nation").select("n_nationkey", "n_name", "n_regionkey")
    return (
        table(spark, sf, "customer")
        .join(F.broadcast(na), F.col("c_nationkey") == F.col("n_nationkey"))  # 25 rows
        .select(
            F.col("c_custkey").alias("id"),
            F.col("c_name").alias("name"),
            F.col("n_name").alias("country"),
            F.col("n_regionkey").alias("team_id"),
            F.col("c_mktsegment").alias("segment"),
            F.date_add(F.lit("1995-01-01").cast("date"), (F.col("c_custkey") % 2400).cast("int")).alias("created_at"),
        )
    )


def account(spark, sf) -> DataFrame:
    na = table(spark, sf, "nation").select("n_nationkey", "n_regionkey")
    t = F.col("s_suppkey") % 4
    return (
        table(spark, sf, "supplier")
        .join(F.broadcast(na), F.col("s_nationkey") == F.col("n_nationkey"))  # 25 rows
        .select(
            F.col("s_suppkey").cast("string").alias("id"),
            F.col("s_name").alias("name"),
            F.col("n_regionkey").alias("team_id"),
            dec("s_acctbal").alias("balance"),
            F.when(t == 0, "depository").when(t == 1, "other_asset").when(t == 2, "credit").otherwise("loan").alias("type"),
            F.element_at(F.array(F.lit("USD"), F.lit("EUR"), F.lit("GBP"), F.lit("CHF")), (F.col("s_suppkey") % 3 + F.col("s_suppkey") % 2 + 1).cast("int")).alias("currency"),
            F.when(F.col("s_suppkey") % 10 == 0, "USD").alias("base_currency"),
            F.when(F.col("s_suppkey") % 10 == 0, dec(F.col("s_acctbal") * 2)).alias("base_balance"),
            (F.col("s_suppkey") % 7 != 0).alias("enabled"),
        )
    )


def time_entry(spark, sf) -> DataFrame:
    return _events(spark, sf).select(
        F.col("event_id").alias("id"),
        F.col("user_id").alias("assigned_id"),
        F.col("k").alias("project_id"),
        F.to_date("ts").alias("date"),
        F.floor(F.col("value") * 60).cast("long").alias("duration"),
        (F.col("k") % 3 == 0).alias("billed"),
    )


def project(spark, sf) -> DataFrame:
    """One project per distinct time-entry project id."""
    p = F.col("project_id")
    return time_entry(spark, sf).select("project_id").distinct().select(
        p.alias("id"),
        F.concat(F.lit("Project "), p.cast("string")).alias("name"),
        ((p % 9 + 1) * 10).cast("decimal(10,2)").alias("rate"),
        F.when(p % 2 == 0, "USD").otherwise("EUR").alias("currency"),
        (p % 4 != 0).alias("billable"),
        (p * 7 + 1).cast("long").alias("customer_id"),
        F.when(p % 6 == 0, "completed").otherwise("in_progress").alias("status"),
    )


def inbox(spark, sf) -> DataFrame:
    o = table(spark, sf, "orders")
    c = table(spark, sf, "customer").select("c_custkey", "c_name", "c_nationkey")
    return o.join(c, o.o_custkey == c.c_custkey).select(
        F.col("o_orderkey").cast("string").alias("inbox_id"),
        (F.col("c_nationkey") % 5).alias("team_id"),
        F.concat("c_name", F.lit(" Ltd")).alias("display_name"),
        dec("o_totalprice").alias("amount"),
        F.when(F.col("c_nationkey") % 3 == 0, "EUR").otherwise("USD").alias("currency"),
        F.to_date("o_orderdate").alias("date"),
        F.when(F.col("o_orderkey") % 2 == 0, "invoice").otherwise("expense").alias("type"),
        dec("o_totalprice").alias("base_amount"),
        F.lit("USD").alias("base_currency"),
    )


def payment(spark, sf) -> DataFrame:
    o = table(spark, sf, "orders")
    c = table(spark, sf, "customer").select("c_custkey", "c_name", "c_nationkey")
    off = F.col("o_orderkey") % 5
    amount = dec(dec("o_totalprice") * (100 + off) / 100)
    return o.join(c, o.o_custkey == c.c_custkey).select(
        F.concat(F.lit("p"), F.col("o_orderkey").cast("string")).alias("transaction_id"),
        (F.col("c_nationkey") % 5).alias("team_id"),
        F.upper("c_name").alias("name"),
        (-amount).alias("amount"),
        F.when(F.col("c_nationkey") % 3 == 0, "EUR").otherwise("USD").alias("currency"),
        F.date_add(F.to_date("o_orderdate"), (F.col("o_orderkey") % 9).cast("int")).alias("date"),
        (-amount).alias("base_amount"),
        F.lit("USD").alias("base_currency"),
    )


def review(spark, sf) -> DataFrame:
    """Reviewer decisions on all transactions but those still waiting, some taken back."""
    e = _events(spark, sf)
    n = F.col("event_id")
    action = F.element_at(F.array(*[F.lit(a) for a in ("approve", "dismiss", "escalate", "decline", "block", None)]), (n % 6 + 1).cast("int"))
    decisions = e.select(n.cast("string").alias("transaction_id"), action.alias("action"), F.col("us").alias("created_us"), n.alias("seq"))
    return decisions.filter(F.col("action").isNotNull())
