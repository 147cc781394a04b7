"""Readers, validators, import transforms and table writers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

TRANSACTION_COLUMNS = (
    "transaction_id", "timestamp", "card_id", "amount", "merchant_name", "merchant_category", "channel",
    "cardholder_country", "merchant_country", "device_id", "ip_address",
)
CSV_SCHEMA = T.StructType([T.StructField(c, T.StringType()) for c in TRANSACTION_COLUMNS])
AUDIT_SCHEMA = "transaction_id string, action string, from_status string, to_status string, reviewer string, reviewer_confidence double, note string, training_label string, created_at timestamp"


def read_raw_transactions(spark: SparkSession, path: str) -> DataFrame:
    """CSV as text columns, with empty, 'null' and 'None' read as null."""
    raw = spark.read.option("header", True).option("enforceSchema", False).schema(CSV_SCHEMA).csv(path)
    return raw.select(*[F.when(F.trim(c).isin("", "null", "None"), None).otherwise(F.col(c)).alias(c) for c in TRANSACTION_COLUMNS])


def normalize_transactions(raw: DataFrame) -> DataFrame:
    """Typed rows: decimal amount, parsed time, empty device and address for missing ones."""
    ts = F.try_to_timestamp("timestamp")
    return raw.select(
        "transaction_id",
        ts.alias("ts"),
        F.unix_micros(ts).alias("us"),
        "card_id",
        F.round(F.col("amount").try_cast("double").cast("decimal(28,6)"), 2).cast("decimal(18,2)").alias("amount"),
        "merchant_name", "merchant_category", "channel", "cardholder_country", "merchant_country",
        F.coalesce("device_id", F.lit("")).alias("device_id"),
        F.coalesce("ip_address", F.lit("")).alias("ip_address"),
    )


def violations(raw: DataFrame, samples: int = 5) -> DataFrame:
    """(rule, n, examples) of everything wrong with a transaction file; empty when fine."""
    missing = [c for c in TRANSACTION_COLUMNS if c not in raw.columns]
    spark = raw.sparkSession
    schema = "rule string, n long, examples string"
    if missing:
        return spark.createDataFrame([("missing_column", len(missing), ",".join(missing))], schema)
    amount = F.col("amount").try_cast("double")
    bad = F.array_compact(
        F.array(
            F.when(amount.isNull() | (amount < 0), "bad_amount"),
            F.when(F.try_to_timestamp("timestamp").isNull(), "bad_timestamp"),
        )
    )
    value = F.when(F.col("rule") == "bad_amount", F.col("transaction_id")).otherwise(F.col("timestamp"))
    rows = raw.withColumn("rule", F.explode(bad)).withColumn("_v", F.coalesce(value, F.lit("")))
    dup = raw.groupBy("transaction_id").agg(F.count("*").alias("_c")).filter(F.col("_c") > 1)
    all_ = rows.select("rule", "_v").unionByName(dup.select(F.lit("duplicate_id").alias("rule"), F.col("transaction_id").alias("_v")))
    # only the first few examples per rule are gathered
    from pyspark.sql import Window

    first = all_.withColumn("_rn", F.row_number().over(Window.partitionBy("rule").orderBy("_v"))).filter(F.col("_rn") <= samples)
    shown = first.groupBy("rule").agg(F.concat_ws(",", F.array_sort(F.collect_list("_v"))).alias("examples"))
    counts = all_.groupBy("rule").agg(F.count("*").alias("n"))
    empty = raw.agg(F.count("*").alias("n")).filter(F.col("n") == 0).select(F.lit("empty_file").alias("rule"), "n", F.lit("").alias("examples"))
    return counts.join(shown, "rule").select("rule", "n", "examples").unionByName(empty)


def read_audit(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(AUDIT_SCHEMA).json(path)


def append_audit(events: DataFrame, path: str) -> None:
    events.write.mode("append").json(path)


# ---- imports


def map_rows(rows: DataFrame, mapping: dict[str, str], currency: str, team: str, account: str) -> DataFrame:
    """Rename the mapped source columns and add the constants of an import."""
    out = rows.select(*[F.col(src).alias(dst) for dst, src in mapping.items()])
    return out.withColumn("currency", F.lit(currency)).withColumn("team_id", F.lit(team)).withColumn("bank_account_id", F.lit(account))


def parse_amount(c: Column, inverted: bool = False) -> Column:
    """Amount text: comma decimals with dot thousands, dot thousands, unicode minus."""
    s = F.replace(F.trim(c), F.lit("−"), F.lit("-"))
    value = (
        F.when(F.contains(s, F.lit(",")), F.regexp_replace(F.regexp_replace(s, "\\.", ""), ",", "."))
        .when(s.rlike("\\.\\d{2}$"), F.regexp_replace(s, "\\.(?=\\d{3})", ""))
        .otherwise(s)
    ).try_cast("decimal(18,2)")
    return -value if inverted else value


def parse_date(c: Column, formats: tuple[str, ...] = ("d/M/yyyy", "d.M.yyyy", "MMM d, yyyy", "d MMM yyyy")) -> Column:
    """ISO prefix with a calendar check, else the first format that fits."""
    s = F.trim(c)
    iso = F.regexp_extract(s, "^(\\d{4}-\\d{2}-\\d{2})", 1)
    other = F.coalesce(*[F.try_to_date(s, f) for f in formats])
    return F.when(iso != "", F.try_to_date(F.nullif(iso, F.lit("")), "yyyy-MM-dd")).otherwise(other)


def _plain(c: Column) -> Column:
    return F.regexp_replace(F.lower(F.trim(F.coalesce(c, F.lit("")))), "\\s+", " ")


def capital_case(c: Column) -> Column:
    return F.initcap(F.trim(F.regexp_replace(F.lower(c), "[^\\p{L}\\p{N}]+", " ")))


def import_transform(rows: DataFrame, inverted: bool = False) -> DataFrame:
    """Imported rows in canonical form with a fingerprint id."""
    amount, date = parse_amount(F.col("amount"), inverted), parse_date(F.col("date"))
    # plain number text: no trailing zeros after the point
    text = F.regexp_replace(F.regexp_replace(amount.cast("string"), "(\\.\\d*?)0+$", "$1"), "\\.$", "")
    print_ = F.concat_ws(
        "|", _plain(F.col("bank_account_id")), F.coalesce(date.cast("string"), F.lit("")), F.coalesce(text, F.lit("NaN")),
        _plain(F.col("currency")), _plain(F.col("description")), _plain(F.col("counterparty")),
    )
    name = F.coalesce(F.nullif(F.trim("description"), F.lit("")), F.nullif(F.trim("counterparty"), F.lit("")), F.lit("Transaction"))
    return rows.select(
        F.concat_ws("_", F.col("team_id").cast("string"), F.substring(F.sha2(print_, 256), 1, 24)).alias("internal_id"),
        "team_id",
        F.lit("posted").alias("status"),
        F.lit("other").alias("method"),
        date.alias("date"),
        amount.alias("amount"),
        capital_case(name).alias("name"),
        capital_case(F.nullif(F.trim("counterparty"), F.lit(""))).alias("counterparty_name"),
        F.when(amount > 0, "income").alias("category_slug"),
        "bank_account_id",
        F.upper("currency").alias("currency"),
    )


def import_validate(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(valid, invalid with the violated rules)."""
    errors = F.array_compact(
        F.array(
            F.when(F.col("amount").isNull(), "amount"),
            F.when(F.col("date").isNull(), "date"),
            F.when(F.col("name").isNull(), "name"),
            F.when(F.col("currency").isNull(), "currency"),
            F.when(~F.col("status").isin("posted", "pending"), "status"),
            F.when(~F.col("method").isin("card", "bank", "other"), "method"),
        )
    )
    checked = rows.withColumn("errors", errors)
    return checked.filter(F.size("errors") == 0).drop("errors"), checked.filter(F.size("errors") > 0)


def insert_absent(target: DataFrame, new: DataFrame, key: str, order: str) -> DataFrame:
    """Rows of ``new`` whose key the target lacks; the first per key by ``order``."""
    first = new.groupBy(key).agg(F.min_by(F.struct(*new.columns), order).alias("_r")).select("_r.*")
    return first.join(target.select(key), key, "left_anti")


def upsert(target: DataFrame, new: DataFrame, keys: list[str], update: dict[str, Column]) -> DataFrame:
    """New snapshot: rows of both sides; ``update`` gives each changed column of a matched
    row over ``t_`` (stored) and ``n_`` (new) columns. Others keep the stored value."""
    cols = [c for c in target.columns if c not in keys]
    t = target.select(*keys, *[F.col(c).alias(f"t_{c}") for c in cols], F.lit(True).alias("_t"))
    n = new.select(*keys, *[F.col(c).alias(f"n_{c}") for c in cols], F.lit(True).alias("_n"))
    both = F.col("_t").isNotNull() & F.col("_n").isNotNull()
    pick = [F.when(both, update.get(c, F.col(f"t_{c}"))).otherwise(F.coalesce(f"t_{c}", f"n_{c}")).alias(c) for c in cols]
    return t.join(n, keys, "full").select(*keys, *pick)


def _newest(rows: DataFrame, keys: list[str], at: str) -> DataFrame:
    """One row per key: the one with the greatest ``at``, of those the greatest row."""
    values = [c for c in rows.columns if c not in (*keys, at)]
    return rows.groupBy(*keys).agg(F.max(F.struct(at, *values)).alias("_r")).select(*keys, *[F.col(f"_r.{c}").alias(c) for c in (at, *values)]).select(*rows.columns)


def upsert_rates(target: DataFrame, new: DataFrame) -> DataFrame:
    """New snapshot of (base, target, rate, updated_at): a fed pair takes its newest rate, others stay."""
    keys = ["base", "target"]
    return upsert(target, _newest(new, keys, "updated_at"), keys, {c: F.col(f"n_{c}") for c in ("rate", "updated_at")})


def upsert_suggestions(target: DataFrame, new: DataFrame) -> DataFrame:
    """New snapshot of match suggestions by (inbox_id, transaction_id).

    A suggestion that a user confirmed or declined stays as it is; any other takes the newest scores. A new one without
    a status is pending.
    """
    keys = ["inbox_id", "transaction_id"]
    fresh = _newest(new, keys, "updated_at").withColumn("status", F.coalesce("status", F.lit("pending")))
    decided = F.coalesce(F.col("t_status").isin("confirmed", "declined"), F.lit(False))
    return upsert(target, fresh, keys, {c: F.when(decided, F.col(f"t_{c}")).otherwise(F.col(f"n_{c}")) for c in target.columns if c not in keys})


def flatten_rates(feed: DataFrame) -> DataFrame:
    """(source, date, rates map) to one row per target currency, the source itself left out."""
    out = feed.select(F.col("source").alias("base"), F.explode("rates").alias("target", "rate"), F.col("date").alias("updated_at"))
    return out.filter(F.col("base") != F.col("target"))


def primary_balance(balances: DataFrame, tiers: list[list[str]], preferred: str) -> DataFrame:
    """One balance per account: tier, then preferred currency, then largest size, then first."""
    from pyspark.sql import Window

    tier = F.lit(len(tiers))
    for i in reversed(range(len(tiers))):
        tier = F.when(F.col("balance_type").isin(*tiers[i]), i).otherwise(tier)
    match = F.when(F.upper("currency") == preferred.upper(), 0).otherwise(1)
    size = F.when(tier < len(tiers), -F.abs("amount")).otherwise(F.lit(0))
    w = Window.partitionBy("account_id").orderBy(tier, match, size, "seq")
    return balances.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") == 1).drop("_rn")


def normalize_balance(kind: Column, current: Column, available: Column) -> Column:
    """Credit accounts show what is owed as a positive number; cash accounts what is available."""
    return F.when(kind == "credit", F.abs(current)).otherwise(F.coalesce(available, current, F.lit(0)))


# ---- bank feeds (JSON rows of four shapes to one canonical transaction)

CANONICAL = ("id", "date", "name", "description", "method", "amount", "currency", "category", "counterparty_name", "merchant_name", "balance", "status")
PLAID_METHODS = {"bill payment": "payment", "atm": "card_atm", "transfer": "transfer", "interest": "interest", "bank charge": "fee"}
# Feed category to own category.
FEED_CATEGORIES = {
    "TRANSPORTATION": "travel", "TRAVEL": "travel", "BANK_FEES": "fees", "FOOD_AND_DRINK": "meals",
    "PROFESSIONAL_SERVICES": "professional-services-fees", "INSURANCE": "insurance", "MARKETING": "marketing",
    "HOME_IMPROVEMENT": "office-supplies", "ENTERTAINMENT": "activity", "TAX": "taxes", "MEDICAL": "benefits",
}


def _pick(col: Column, table: dict[str, str], default=None) -> Column:
    out = None
    for k, val in table.items():
        out = F.when(col == k, val) if out is None else out.when(col == k, val)
    return out.otherwise(default)


def feed_a(rows: DataFrame) -> DataFrame:
    """Outflow-positive feed with category objects (struct column ``r``)."""
    r = F.col
    amount = (-r("r.amount")).cast("decimal(18,2)")
    primary = r("r.category.primary")
    category = (
        F.when(amount > 0, "income")
        .when(primary == "GENERAL_MERCHANDISE", F.when(F.abs(amount) < 500, "office-supplies").otherwise("equipment"))
        .otherwise(_pick(primary, FEED_CATEGORIES))
    )
    name = capital_case(r("r.name"))
    description = (
        F.when(r("r.original_description").isNotNull() & (r("r.original_description") != name), capital_case(r("r.original_description")))
        .when(r("r.merchant_name").isNotNull() & (r("r.merchant_name") != name), r("r.merchant_name"))
    )
    return rows.select(
        r("r.transaction_id").alias("id"), F.to_date("r.date").alias("date"), r("r.name").alias("name"), description.alias("description"),
        _pick(r("r.transaction_code"), PLAID_METHODS, "other").alias("method"), amount.alias("amount"),
        F.coalesce(F.upper("r.iso_currency_code"), F.upper("r.unofficial_currency_code"), F.lit("USD")).alias("currency"),
        category.alias("category"), capital_case(F.get(r("r.counterparties"), F.lit(0))["name"]).alias("counterparty_name"),
        r("r.merchant_name").alias("merchant_name"), F.lit(None).cast("decimal(18,2)").alias("balance"),
        F.when(r("r.pending"), "pending").otherwise("posted").alias("status"),
    )


def feed_b(rows: DataFrame) -> DataFrame:
    """Signed feed with remittance text and an optional currency exchange."""
    r = F.col
    amount = r("r.transactionAmount.amount").cast("decimal(18,2)")
    name = F.coalesce(
        r("r.creditorName"), r("r.debtorName"), r("r.additionalInformation"), F.get(r("r.remittanceInformationUnstructuredArray"), F.lit(0)),
        r("r.remittanceInformationUnstructured"), r("r.proprietaryBankTransactionCode"), F.lit("No information"),
    )
    return rows.select(
        r("r.internalTransactionId").alias("id"), F.to_date("r.bookingDate").alias("date"), capital_case(name).alias("name"),
        F.array_join("r.remittanceInformationUnstructuredArray", " ").alias("description"),
        F.when(r("r.proprietaryBankTransactionCode") == "Transfer", "transfer").otherwise("other").alias("method"),
        amount.alias("amount"), F.upper("r.transactionAmount.currency").alias("currency"),
        F.when(amount > 0, "income").alias("category"), capital_case(F.coalesce(r("r.debtorName"), r("r.creditorName"))).alias("counterparty_name"),
        F.lit(None).cast("string").alias("merchant_name"), r("r.balanceAfterTransaction.amount").cast("decimal(18,2)").alias("balance"),
        F.lit("posted").alias("status"), F.get(r("r.currencyExchange"), F.lit(0))["exchangeRate"].cast("double").alias("currency_rate"),
        F.get(r("r.currencyExchange"), F.lit(0))["sourceCurrency"].alias("currency_source"),
    )


def feed_c(rows: DataFrame) -> DataFrame:
    """Feed whose credit accounts carry the opposite sign."""
    r = F.col
    raw = r("r.amount").cast("decimal(18,2)")
    amount = F.when(r("account_type") == "credit", -raw).otherwise(raw)
    table = {
        "bar": "travel", "dining": "meals", "transportation": "travel", "accommodation": "travel", "fuel": "travel", "insurance": "insurance",
        "office": "office-supplies", "phone": "internet-and-telephone", "software": "software", "entertainment": "activity", "sport": "activity", "advertising": "marketing", "tax": "taxes",
    }
    category = F.when(r("r.type") == "fee", "fees").when(amount > 0, "income").otherwise(_pick(r("r.details.category"), table))
    method = F.when(r("r.type").isin("payment", "bill_payment"), "payment").when(r("r.type") == "card_payment", "card_purchase").when(
        r("r.type").isin("transfer", "wire"), "transfer"
    ).when(r("r.type") == "atm", "card_atm").otherwise("other")
    return rows.select(
        r("r.id").alias("id"), F.to_date("r.date").alias("date"), capital_case(r("r.description")).alias("name"), F.lit(None).cast("string").alias("description"),
        method.alias("method"), amount.alias("amount"), F.lit("USD").alias("currency"), category.alias("category"),
        capital_case(r("r.details.counterparty.name")).alias("counterparty_name"), F.lit(None).cast("string").alias("merchant_name"),
        r("r.running_balance").cast("decimal(18,2)").alias("balance"), F.lit("posted").alias("status"),
    )


def feed_d(rows: DataFrame) -> DataFrame:
    """Unsigned feed with a debit / credit mark; without a reference the id is a hash."""
    r = F.col
    size = r("r.transaction_amount.amount").cast("decimal(18,2)")
    amount = F.when(r("r.credit_debit_indicator") == "CRDT", size).otherwise(-size)
    text = F.array_join("r.remittance_information", " ")
    ident = F.md5(
        F.concat_ws("-", *[F.coalesce(x.cast("string"), F.lit("")) for x in (r("r.booking_date"), size, r("r.transaction_amount.currency"), r("r.credit_debit_indicator"), text)])
    )
    party = F.when(r("r.credit_debit_indicator") == "CRDT", r("r.debtor.name")).otherwise(r("r.creditor.name"))
    return rows.select(
        F.coalesce("r.entry_reference", ident).alias("id"), F.to_date("r.booking_date").alias("date"),
        capital_case(F.coalesce(party, F.nullif(text, F.lit("")), F.lit("Transaction"))).alias("name"), text.alias("description"), F.lit("other").alias("method"),
        amount.alias("amount"), F.upper("r.transaction_amount.currency").alias("currency"), F.when(amount > 0, "income").alias("category"),
        capital_case(party).alias("counterparty_name"), F.lit(None).cast("string").alias("merchant_name"),
        r("r.balance_after.amount").cast("decimal(18,2)").alias("balance"), F.when(r("r.status") == "BOOK", "posted").otherwise("pending").alias("status"),
    )


def enrich_merge(rows: DataFrame) -> DataFrame:
    """Keep the merchant when confident; set a category only where none is and money left."""
    sure = F.coalesce(F.col("new_confidence") >= 0.7, F.lit(False))
    can = F.col("category_slug").isNull() & (F.col("amount") <= 0)
    return rows.withColumn("merchant_name", F.when(sure, F.coalesce("new_merchant", "merchant_name")).otherwise(F.col("merchant_name"))).withColumn(
        "category_slug", F.when(can, F.coalesce("new_category", F.lit("uncategorized"))).otherwise(F.col("category_slug"))
    )


# ---- exports and profile


def accounting_rows(txns: DataFrame, tags: DataFrame, attachments: DataFrame, rates: Column) -> DataFrame:
    """Export lines with resolved tax, tags and completion, oldest first."""
    from ..operators import money

    t = tags.groupBy("id").agg(F.array_join(F.array_sort(F.collect_set("tag")), ", ").alias("tags"))
    a = attachments.select("id").distinct().withColumn("_a", F.lit(True))
    tax = money.resolve_tax(F.col("amount"), F.lit(None).cast("decimal(18,2)"), F.col("tax_rate"), rates)
    share = F.when(F.col("base_amount").isNotNull() & (F.col("amount") != 0), F.col("base_amount") / F.col("amount"))
    return (
        txns.join(t, "id", "left")
        .join(a, "id", "left")
        .withColumn("tax", tax)
        .withColumn("base_tax", F.round(F.col("tax") * share, 2).cast("decimal(18,2)"))
        .withColumn("tags", F.coalesce("tags", F.lit("")))
        .withColumn("completed", F.coalesce("_a", F.lit(False)))
        .drop("_a")
        .orderBy("date", "id")
    )


_CSV = {"header": True, "escape": '"', "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}


def _flat(df: DataFrame) -> DataFrame:
    """Nested columns as JSON, a null as an empty field."""
    nested = (T.ArrayType, T.MapType, T.StructType)
    return df.select(*[(F.to_json(f.name).alias(f.name) if isinstance(f.dataType, nested) else F.col(f.name)) for f in df.schema.fields])


def export_tables(tables: dict[str, DataFrame], path: str, order: dict[str, list[Column]] | None = None, rows_per_file: int = 1_000_000) -> None:
    """Every table as CSV, one folder per team, in the order given for the table.

    Rows are dealt by ranges of team and order, so a team that holds most rows is written by many
    tasks; the files of a team, by name, follow its order and have at most ``rows_per_file`` rows. Nested
    values become JSON. Line ends inside a text are kept as \n. A null team has its own folder.
    """
    for name, df in tables.items():
        keys = [F.col("team_id"), *(order or {}).get(name, [])]
        dealt = _flat(df.repartitionByRange(*keys).sortWithinPartitions(*keys))
        dealt.write.mode("overwrite").options(**_CSV).option("maxRecordsPerFile", rows_per_file).partitionBy("team_id").csv(f"{path}/{name}")


def read_export(spark: SparkSession, path: str, name: str, schema: T.StructType) -> DataFrame:
    """An exported table; nested columns of ``schema`` are read back from their JSON."""
    nested = (T.ArrayType, T.MapType, T.StructType)
    plain = T.StructType([T.StructField(f.name, T.StringType() if isinstance(f.dataType, nested) else f.dataType) for f in schema.fields])
    rows = spark.read.options(**_CSV).option("multiLine", True).schema(plain).csv(f"{path}/{name}")
    return rows.select(*[(F.from_json(f.name, f.dataType).alias(f.name) if isinstance(f.dataType, nested) else F.col(f.name)) for f in schema.fields])


def profile(txns: DataFrame) -> DataFrame:
    """(metric, key, value) of a transaction source."""
    base = txns.agg(
        F.count("*").alias("rows"), F.countDistinct("card_id").alias("cards"), F.countDistinct("merchant_name").alias("merchants"),
        F.min("us").alias("first_us"), F.max("us").alias("last_us"),
    )
    head = base.select(F.expr("stack(5, 'rows', rows, 'cards', cards, 'merchants', merchants, 'first_us', first_us, 'last_us', last_us) AS (key, value)")).select(
        F.lit("total").alias("metric"), "key", F.col("value").cast("decimal(28,2)").alias("value")
    )
    per = txns.groupBy("merchant_category", "channel").agg(F.count("*").alias("n"), F.sum("amount").alias("a"))
    def line(metric, key, value):
        return F.struct(F.lit(metric).alias("m"), F.col(key).alias("k"), F.col(value).cast("decimal(28,2)").alias("v"))

    kinds = F.explode(
        F.array(line("category_rows", "merchant_category", "n"), line("channel_rows", "channel", "n"), line("category_amount", "merchant_category", "a"))
    )
    rest = per.select(kinds.alias("e")).groupBy("e.m", "e.k").agg(F.sum("e.v").cast("decimal(28,2)").alias("value"))
    return head.unionByName(rest.select(F.col("m").alias("metric"), F.col("k").alias("key"), "value"))


def arrival_gaps(txns: DataFrame, span: int = 86_400_000_000) -> DataFrame:
    """(gap_us, n): positive gaps between neighbouring timestamps of the whole source.

    Gaps are taken inside day buckets and stitched at the borders with one line per
    bucket, so the global order needs no single task over all rows.
    """
    from pyspark.sql import Window

    t = txns.select("us").distinct().withColumn("_b", F.floor(F.col("us") / F.lit(span)).cast("long"))
    inner = t.select((F.col("us") - F.lag("us").over(Window.partitionBy("_b").orderBy("us"))).alias("gap"))
    edges = t.groupBy("_b").agg(F.min("us").alias("_lo"), F.max("us").alias("_hi"))
    stitch = edges.select((F.col("_lo") - F.lag("_hi").over(Window.orderBy("_b"))).alias("gap"))
    return inner.unionByName(stitch).filter(F.col("gap") > 0).groupBy(F.col("gap").alias("gap_us")).agg(F.count("*").alias("n"))
