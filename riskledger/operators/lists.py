"""List, search, paging and workflow operators over business tables."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as tx
from .linkage import similar_names


def institutions(rows: DataFrame, country: str, search: str | None = None, limit: int = 50, without_providers: tuple[str, ...] = (), without_ids: tuple[str, ...] = ()) -> DataFrame:
    """Active institutions of a country: by fit to ``search``, then popularity, then id.

    With a search, those whose name holds it (any case) or fits it above 0.3; without one, or with ``*``, all.
    """
    out = rows.where((F.col("status") == "active") & F.array_contains("countries", country))
    if without_providers:
        out = out.where(~F.col("provider").isin(*without_providers))
    if without_ids:
        out = out.where(~F.col("id").isin(*without_ids))
    if not search or search == "*":
        return out.withColumn("fit", F.lit(0.0)).orderBy(F.desc("popularity"), "id").limit(limit)
    fits = out.withColumn("fit", tx.word_similarity(F.lit(search), F.col("name")))
    held = F.contains(F.lower("name"), F.lit(search.lower()))
    return fits.where(held | (F.col("fit") > 0.3)).orderBy(F.desc("fit"), F.desc("popularity"), "id").limit(limit)


def has_key(rows: DataFrame, other: DataFrame, key: str, name: str) -> DataFrame:
    """Add a flag whether the row's key occurs in ``other``."""
    marks = other.select(key).distinct().withColumn(name, F.lit(True))
    return rows.join(marks, key, "left").withColumn(name, F.coalesce(F.col(name), F.lit(False)))


def nested(rows: DataFrame, parts: DataFrame, key: str, columns: list[str], name: str) -> DataFrame:
    """Attach the parts of each row as a sorted array of structs (empty when none)."""
    lists = parts.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(*columns))).alias(name))
    empty = F.filter(F.array(F.struct(*[F.lit(None).cast(parts.schema[c].dataType).alias(c) for c in columns])), lambda x: F.lit(False))
    return rows.join(lists, key, "left").withColumn(name, F.coalesce(F.col(name), empty))


def workflow_status(txns: DataFrame, attachments: DataFrame, pending: DataFrame, sync: DataFrame) -> DataFrame:
    """Where a transaction stands: excluded, archived, exported, export_error, in_review, receipt_match, blank."""
    df = has_key(txns, attachments, "id", "has_attachment")
    df = has_key(df, pending, "id", "has_suggestion")
    df = has_key(df, sync.filter(F.col("sync_status") == "synced"), "id", "is_synced")
    df = has_key(df, sync.filter(F.col("sync_status").isin("failed", "partial")), "id", "sync_failed")
    fulfilled = F.col("has_attachment") | (F.col("status") == "completed")
    status = (
        F.when(F.col("status") == "excluded", "excluded")
        .when(F.col("status") == "archived", "archived")
        .when((F.col("status") == "exported") | F.col("is_synced"), "exported")
        .when(F.col("sync_failed"), "export_error")
        .when(fulfilled, "in_review")
        .when(F.col("has_suggestion"), "receipt_match")
        .otherwise("blank")
    )
    return df.withColumn("is_fulfilled", fulfilled).withColumn("workflow_status", status)


def ready_for_export(flagged: DataFrame) -> DataFrame:
    """Count per team of fulfilled rows that are neither exported nor synced."""
    open_ = ~F.col("status").isin("exported", "excluded", "archived") & ~F.col("is_synced") & F.col("is_fulfilled")
    return flagged.filter(open_).groupBy("team_id").agg(F.count("*").alias("ready"))


def unsynced(txns: DataFrame, sync: DataFrame) -> DataFrame:
    return txns.join(sync.filter(F.col("sync_status") == "synced").select("id"), "id", "left_anti")


def expand_categories(categories: DataFrame, slugs: list[str]) -> DataFrame:
    """The given slugs plus the children of those that are parents."""
    return categories.filter(F.col("slug").isin(*slugs) | F.col("parent_slug").isin(*slugs)).select(F.col("slug").alias("category_slug"))


def amount_between(lo: float | None, hi: float | None, kind: str | None = None) -> Column:
    """Range on the size of the base (else own) amount, on the side ``kind`` names."""
    a = F.coalesce("base_amount", "amount")
    ok = F.lit(True)
    if kind == "income":
        ok = a > 0
    elif kind == "expense":
        ok = a < 0
    if lo is not None:
        ok = ok & (F.abs(a) >= lo)
    if hi is not None:
        ok = ok & (F.abs(a) <= hi)
    return ok


def search(text_cols: list[str], q: str, amount: str = "amount") -> Column:
    """Numeric queries compare the amount, others match words or parts of the text."""
    try:
        return F.col(amount) == F.lit(str(float(q))).cast("decimal(18,2)")
    except ValueError:
        hay = F.concat_ws(" ", *text_cols)
        return tx.search_match(hay, q) | hay.ilike(f"%{q}%")


def search_near(text_cols: list[str], q: str, amount: str = "amount", base: str = "base_amount") -> Column:
    """Words or parts of the text; a numeric query also matches either amount within max(1, 10 %)."""
    hay = F.concat_ws(" ", *text_cols)
    hit = tx.search_match(hay, q) | hay.ilike(f"%{q}%")
    try:
        x = float(re.sub(r"[^\d.-]", "", q))
    except ValueError:
        return hit
    near = F.lit(str(max(1.0, 0.1 * abs(x)))).cast("decimal(18,4)")
    at = F.lit(str(x)).cast("decimal(18,2)")
    for c in (F.coalesce(amount, F.lit(0)), F.coalesce(base, F.lit(0))):
        hit = hit | (F.abs(F.abs(c) - at) <= near)
    return hit


def list_transactions(
    txns: DataFrame,
    categories: DataFrame | None = None,
    start: str | None = None,
    end: str | None = None,
    statuses: list[str] | None = None,
    slugs: list[str] | None = None,
    accounts: list[str] | None = None,
    lo: float | None = None,
    hi: float | None = None,
    kind: str | None = None,
    q: str | None = None,
    recurring: bool | None = None,
    tags: list[str] | None = None,
    tagged: DataFrame | None = None,
    assignees: list[str] | None = None,
    manual: str | None = None,
    exported: bool | None = None,
    fulfilled: bool | None = None,
) -> DataFrame:
    """The transaction list filters; ``uncategorized`` among ``slugs`` keeps null slugs.

    ``tagged``: id, tag_id. ``manual``: include or exclude. Not exported leaves out excluded and archived rows too.
    """
    out = txns
    if tags:
        out = out.join(tagged.filter(F.col("tag_id").isin(*tags)).select("id"), "id", "left_semi")
    if assignees:
        out = out.filter(F.col("assigned_id").isin(*assignees))
    if manual:
        out = out.filter(F.coalesce("manual", F.lit(False)) == (manual == "include"))
    if exported is not None:
        done = (F.col("status") == "exported") | F.col("is_synced")
        out = out.filter(done if exported else ~done & ~F.col("status").isin("excluded", "archived"))
    if fulfilled is not None:
        out = out.filter(F.col("is_fulfilled") == fulfilled)
    if start:
        out = out.filter(F.col("date") >= F.lit(start).cast("date"))
    if end:
        out = out.filter(F.col("date") <= F.lit(end).cast("date"))
    if statuses:
        out = out.filter(F.col("workflow_status").isin(*statuses))
    if accounts:
        out = out.filter(F.col("bank_account_id").isin(*accounts))
    if recurring is not None:
        out = out.filter(F.coalesce("recurring", F.lit(False)) == recurring)
    if lo is not None or hi is not None or kind:
        out = out.filter(amount_between(lo, hi, kind))
    if q:
        out = out.filter(search(["name", "merchant_name"], q))
    if slugs:
        named = [s for s in slugs if s != "uncategorized"]
        wanted = expand_categories(categories, named).withColumn("_hit", F.lit(True)).distinct()
        out = out.join(wanted, "category_slug", "left")
        keep = F.coalesce("_hit", F.lit(False))
        if "uncategorized" in slugs:
            keep = keep | F.col("category_slug").isNull()
        out = out.filter(keep).drop("_hit")
    return out


def page(rows: DataFrame, column: str, key: str, size: int, descending: bool = True, after: tuple | None = None) -> DataFrame:
    """One page in (column, key) order after the cursor; ties resolved by the key.

    Nulls come last in a descending list and first in an ascending one; a cursor may stand on a null. The
    cursor is a filter, so Spark prunes and keeps only the page (TakeOrdered).
    """
    c, k = F.col(column), F.col(key)
    out = rows
    if after is not None:
        last = F.lit(after[1])
        if after[0] is None:
            beyond = (c.isNull() & (k > last)) | (F.lit(not descending) & c.isNotNull())
        else:
            val = F.lit(after[0]).cast(rows.schema[column].dataType)
            beyond = (c == val) & (k > last) | ((c < val) | c.isNull() if descending else c > val)
        out = rows.filter(beyond)
    order = c.desc_nulls_last() if descending else c.asc_nulls_first()
    return out.orderBy(order, k.asc()).limit(size)


def latest_per(rows: DataFrame, key: str, date: str, tie: str) -> DataFrame:
    """One row per key: the latest by date."""
    w = Window.partitionBy(key).orderBy(F.desc(date), tie)
    return rows.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") == 1).drop("_rn")


def inbox_list(items: DataFrame, blocked: DataFrame, statuses: list[str] | None = None) -> DataFrame:
    """Items that are not deleted, not grouped and not from a blocked domain or address."""
    b = blocked.select(F.lower("value").alias("_v")).distinct()
    out = items.filter((F.col("status") != "deleted") & F.col("grouped_inbox_id").isNull())
    out = out.join(b, F.lower("website") == F.col("_v"), "left_anti").join(b, F.lower("sender_email") == F.col("_v"), "left_anti")
    return out.filter(F.col("status").isin(*statuses)) if statuses else out


def stuck(items: DataFrame, now: str, minutes: int) -> DataFrame:
    return items.filter(F.col("status").isin("processing", "new") & (F.col("created_at") < F.lit(now).cast("timestamp") - F.expr(f"INTERVAL {minutes} MINUTES")))


def age_out(items: DataFrame, now: str, days: int = 90) -> DataFrame:
    """Pending, unmatched items older than ``days`` become no_match."""
    old = (F.col("status") == "pending") & F.col("transaction_id").isNull() & (F.col("created_at") < F.lit(now).cast("timestamp") - F.expr(f"INTERVAL {days} DAYS"))
    return items.withColumn("aged", old).withColumn("status", F.when(old, "no_match").otherwise(F.col("status")))


def inbox_stats(items: DataFrame, pending: DataFrame) -> DataFrame:
    """Counts by status with pending suggestions, per team."""

    def n(s):
        return F.count(F.when(F.col("status") == s, 1))

    live = items.filter(F.col("status") != "deleted")
    s = live.groupBy("team_id").agg(
        F.count("*").alias("total"), n("new").alias("new"), n("pending").alias("pending"), n("analyzing").alias("analyzing"), n("done").alias("done"), n("suggested_match").alias("_s")
    )
    p = pending.groupBy("team_id").agg(F.count("*").alias("_p"))
    return s.join(p, "team_id", "left").withColumn("suggested", F.col("_s") + F.coalesce("_p", F.lit(0))).drop("_s", "_p")


def related_documents(items: DataFrame) -> DataFrame:
    """Group documents of one purchase: same invoice number, else same website, amount and date
    with the opposite type. Each line points at its group's primary (invoice, then oldest).

    Both rules are grouped on their key, so documents find their primary without pairs.
    """
    live = items.filter(F.col("status") != "deleted")
    rank = F.struct(F.when(F.col("type") == "invoice", 0).otherwise(1).alias("r"), F.col("created_at"), F.col("id"))
    numbered = live.filter(F.col("invoice_number").isNotNull())
    by_number = numbered.groupBy("team_id", "invoice_number").agg(F.min(rank).alias("_p"), F.count("*").alias("_n")).filter(F.col("_n") > 1)
    a = numbered.join(by_number, ["team_id", "invoice_number"]).select("id", F.col("_p.id").alias("primary_id"), F.lit("invoice_number").alias("rule"))
    rest = live.join(a.select("id"), "id", "left_anti").filter(F.col("website").isNotNull() & F.col("amount").isNotNull())
    keys = ["team_id", "website", "amount", "date"]
    by_site = rest.groupBy(*keys).agg(F.min(rank).alias("_p"), F.countDistinct("type").alias("_t")).filter(F.col("_t") > 1)
    b = rest.join(by_site, keys).select("id", F.col("_p.id").alias("primary_id"), F.lit("website").alias("rule"))
    return a.unionByName(b)


def attachment_delta(synced: DataFrame, current: DataFrame) -> DataFrame:
    """New and removed attachment ids of each transaction since its last sync."""
    now = current.groupBy("id").agg(F.array_sort(F.collect_set("attachment_id")).alias("_now"))
    j = synced.join(now, "id", "full")
    empty = F.array().cast("array<string>")
    had, has = F.coalesce(F.map_keys("attachment_map"), empty), F.coalesce("_now", empty)
    return j.select("id", F.array_sort(F.array_except(has, had)).alias("added"), F.array_sort(F.array_except(had, has)).alias("removed"))


def documents_list(docs: DataFrame, q: str, tags: DataFrame | None = None, threshold: float = 0.3) -> DataFrame:
    """Word-prefix, substring or trigram hits on the title, with an optional tag filter."""
    t = F.col("title")
    out = docs.filter(tx.search_match(t, q) | t.ilike(f"%{q}%") | (tx.similarity(t, F.lit(q)) > threshold))
    return out.join(tags.select("doc_id"), "doc_id", "left_semi") if tags is not None else out


def activities(rows: DataFrame, statuses: list[str], user: str | None, max_priority: int, after: str, size: int = 50) -> DataFrame:
    out = rows.filter(F.col("status").isin(*statuses) & (F.col("priority") <= max_priority) & (F.col("created_at") > F.lit(after).cast("timestamp")))
    if user:
        out = out.filter(F.col("user_id") == user)
    return out.orderBy(F.desc("created_at"), "id").limit(size)


def different_category(rows: DataFrame, ident: str, slug: str | None) -> DataFrame:
    """Other rows whose category is empty or differs."""
    return rows.filter((F.col("id") != ident) & (F.col("category_slug").isNull() | (F.col("category_slug") != F.lit(slug))))


def search_all(tables: dict[str, tuple[DataFrame, str, str]], q: str, per_table: int = 10) -> DataFrame:
    """Best hits over several tables: (table, id, title, score), ``per_table`` of each.

    Score 1 for an exact title, 0.8 when it starts with the query, 0.5 for a part.
    """
    out = None
    for name, (df, ident, title) in tables.items():
        t = F.lower(F.col(title))
        score = F.when(t == q.lower(), 1.0).when(t.startswith(q.lower()), 0.8).when(F.contains(t, F.lit(q.lower())), 0.5)
        hits = (
            df.select(F.lit(name).alias("source"), F.col(ident).cast("string").alias("id"), F.col(title).alias("title"), score.alias("score"))
            .filter(F.col("score").isNotNull())
            .orderBy(F.desc("score"), "title", "id")
            .limit(per_table)
        )
        out = hits if out is None else out.unionByName(hits)
    return out


def similar_vendors(txns: DataFrame, roots: DataFrame, limit: int = 200, floor: float = 0.6) -> DataFrame:
    """For each root (id, team_id, name, merchant_name): rows of other ids of the same vendor.

    A row is looked at if the root's name or merchant fits the row's name or merchant, and scored by the best of the four
    pairs, or 0.95 where the merchants are equal in any case. Similarity is worked out between distinct texts and
    scores between distinct (name, merchant); the rows join afterwards. A missing field fits nothing.
    """
    fields = ["name", "merchant_name"]
    mine, others = (df.select("team_id", *fields).distinct() for df in (roots, txns))

    def texts(df):
        return df.withColumn("_text", F.explode(F.array(*fields))).where("_text IS NOT NULL")

    def only_text(df):
        return texts(df).select("team_id", F.col("_text").alias("name")).distinct()

    close = similar_names(only_text(mine), only_text(others)).select("team_id", "needle", "text")
    m = texts(mine).select("team_id", F.col("name").alias("m_name"), F.col("merchant_name").alias("m_merchant"), F.col("_text").alias("needle"))
    o = texts(others).select("team_id", F.col("name").alias("o_name"), F.col("merchant_name").alias("o_merchant"), F.col("_text").alias("text"))
    pairs = m.join(close, ["team_id", "needle"]).join(o, ["team_id", "text"]).select("team_id", "m_name", "m_merchant", "o_name", "o_merchant").distinct()
    four = [
        F.when(F.col(x).isNotNull() & F.col(y).isNotNull(), tx.name_score(F.col(x), F.col(y))).otherwise(0.0)
        for x in ("m_name", "m_merchant")
        for y in ("o_name", "o_merchant")
    ]
    same = F.coalesce(F.lower("m_merchant") == F.lower("o_merchant"), F.lit(False))
    pairs = pairs.withColumn("score", F.when(same, 0.95).otherwise(F.round(F.greatest(*four), 6))).filter(F.col("score") >= floor)
    r = roots.select(F.col("id").alias("root_id"), "team_id", "name", "merchant_name")
    met = [F.col("r.team_id") == F.col("p.team_id"), F.col("r.name").eqNullSafe(F.col("p.m_name")), F.col("r.merchant_name").eqNullSafe(F.col("p.m_merchant"))]
    wanted = r.alias("r").join(pairs.alias("p"), reduce(lambda x, y: x & y, met)).select("root_id", "p.team_id", "o_name", "o_merchant", "score")
    rows = _first_rows(txns, limit + 1).select("team_id", "name", "merchant_name", "id", "date")
    met = [F.col("w.team_id") == F.col("t.team_id"), F.col("w.o_name").eqNullSafe(F.col("t.name")), F.col("w.o_merchant").eqNullSafe(F.col("t.merchant_name"))]
    hits = wanted.alias("w").join(rows.alias("t"), reduce(lambda x, y: x & y, met)).select("root_id", "id", "date", "score").filter(F.col("id") != F.col("root_id"))
    rank = F.row_number().over(Window.partitionBy("root_id").orderBy(F.desc("score"), F.desc("date"), "id"))
    return hits.withColumn("rank", rank).filter(F.col("rank") <= limit).select("root_id", "id", "score", "rank")


def _first_rows(txns: DataFrame, n: int) -> DataFrame:
    """Newest ``n`` rows per vendor: no list can need more of one vendor."""
    w = Window.partitionBy("team_id", "name", "merchant_name").orderBy(F.desc("date"), "id")
    return txns.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= n).drop("_rn")


def relink_accounts(api: DataFrame, existing: DataFrame, assign) -> DataFrame:
    """Match re-authorised accounts to stored ones, each side once.

    Tiers: same reference, same IBAN, same currency and type (XXX is unknown), a name match first within a
    tier. Each tier is an equi join: by reference, by IBAN, and by type and currency, where an unknown
    currency or type meets every one of the team. A pair counts under its best tier; ``assign`` takes the scored
    pairs one-to-one, so only pairs that some tier allows are ever made.
    """
    keyed = ["id", "team_id", "name", "currency", "type", "reference", "iban"]
    a = api.select(*keyed)
    e = existing.select([F.col(c).alias(f"e_{c}") for c in keyed])
    same_name = F.when(F.lower("name") == F.lower("e_name"), 0.1).otherwise(0.0)

    def tier(left: DataFrame, right: DataFrame, on: Column, value: float) -> DataFrame:
        joined = left.join(right, (F.col("team_id") == F.col("e_team_id")) & on)
        return joined.select(F.col("id").alias("api_id"), F.col("e_id").alias("db_id"), (value + same_name).alias("score"))

    # a currency is known if it is given and not XXX; what is unknown on one side meets all of the other
    known, e_known = F.coalesce(F.upper("currency") != "XXX", F.lit(False)), F.coalesce(F.upper("e_currency") != "XXX", F.lit(False))
    typed = F.col("e_type") == F.col("type")
    a_known, a_other, s_known, s_other = a.where(known), a.where(~known), e.where(e_known), e.where(~e_known)
    typed_e, free_e = F.col("e_type").isNotNull(), F.col("e_type").isNull()
    pairs = [
        tier(a, e, F.col("reference") == F.col("e_reference"), 3.0),
        tier(a, e, F.col("iban") == F.col("e_iban"), 2.0),
        tier(a_known, s_known.where(typed_e), (F.col("currency") == F.col("e_currency")) & typed, 1.0),
        tier(a_known, s_known.where(free_e), F.col("currency") == F.col("e_currency"), 1.0),
        tier(a_known, s_other.where(typed_e), typed, 1.0),
        tier(a_known, s_other.where(free_e), F.lit(True), 1.0),
        tier(a_other, e.where(typed_e), typed, 1.0),
        tier(a_other, e.where(free_e), F.lit(True), 1.0),
    ]
    best = reduce(lambda x, y: x.unionByName(y), pairs).groupBy("api_id", "db_id").agg(F.max("score").alias("score"))
    return assign(best, "api_id", "db_id", "score")
