"""Linkage of documents and payments, text similarity."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import views as v
from ..functions import match_scores as ms
from ..functions import text as tx
from ..operators import linkage, search
from ..session import checkpointed
from .registry import query
from .views_sql import view


def grams(c: str) -> str:
    words = f"list_filter(string_split(regexp_replace(lower({c}), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g'), ' '), lambda w: w <> '')"
    return f"flatten(list_transform({words}, lambda w: list_transform(range(1, length(w) + 2), lambda i: substr('  ' || w || ' ', i, 3))))"


def wsim(ga: str, gb: str) -> str:
    """Best similarity over all runs of gb."""
    hit = f"len(list_intersect({ga}, {gb}[i:j]))"
    n = f"len(list_distinct({gb}[i:j]))"
    return f"""coalesce(list_max(list_transform(range(1, len({gb}) + 1), lambda i: list_max(list_transform(range(i, len({gb}) + 1),
      lambda j: {hit}::DOUBLE / (len({ga}) + {n} - {hit}))))), 0)"""


@query(
    "text_similarity",
    "FN-09",
    f"""SELECT p_partkey, round(len(list_intersect(a, b))::DOUBLE / len(list_distinct(list_concat(a, b))), 6) AS similarity FROM
    (SELECT p_partkey, list_distinct({grams('p_name')}) AS a, list_distinct({grams('p_type')}) AS b FROM part)""",
)
def text_similarity(spark, sf):
    p = v.table(spark, sf, "part")
    return p.select("p_partkey", F.round(tx.similarity(F.col("p_name"), F.col("p_type")), 6).alias("similarity"))


@query(
    "text_word_similarity",
    "FN-10",
    f"""SELECT p_partkey, round({wsim('a', 'b')}, 6) AS forward, round({wsim('b2', 'a2')}, 6) AS backward FROM
    (SELECT p_partkey, list_distinct({grams('p_brand')}) AS a, {grams('p_name')} AS b, {grams('p_brand')} AS a2, list_distinct({grams('p_name')}) AS b2 FROM part)""",
)
def text_word_similarity(spark, sf):
    p = v.table(spark, sf, "part")
    a, b = F.col("p_brand"), F.col("p_name")
    return p.select("p_partkey", F.round(tx.word_similarity(a, b), 6).alias("forward"), F.round(tx.word_similarity(b, a), 6).alias("backward"))


_SUF = "(" + ", ".join(f"'{s}'" for s in tx.COMPANY_SUFFIXES) + ")"


def tokens(c: str) -> str:
    return f"list_filter(regexp_split_to_array(regexp_replace(lower(strip_accents({c})), '[.,\\-_''\"()&]', ' ', 'g'), '\\s+'), lambda t: t <> '' AND t NOT IN {_SUF})"


def name_sql(a: str, b: str) -> str:
    ja, jb, ca, cb = f"array_to_string({a}, ' ')", f"array_to_string({b}, ' ')", f"array_to_string({a}, '')", f"array_to_string({b}, '')"
    return f"""CASE WHEN len({a}) = 0 OR len({b}) = 0 THEN 0 ELSE greatest(len(list_intersect({a}, {b}))::DOUBLE / len(list_distinct(list_concat({a}, {b}))),
    CASE WHEN length({ja}) >= 3 AND length({jb}) >= 3 AND (contains({ja}, {jb}) OR contains({jb}, {ja})) THEN 0.85 ELSE 0 END,
    CASE WHEN length({a}[1]) >= 3 AND {a}[1] = {b}[1] THEN 0.6 ELSE 0 END,
    CASE WHEN length({ca}) >= 4 AND length({cb}) >= 4 THEN CASE WHEN {ca} = {cb} THEN 0.95 WHEN contains({ca}, {cb}) OR contains({cb}, {ca}) THEN 0.8 ELSE 0 END ELSE 0 END) END"""


@query(
    "text_name_score",
    "FN-11 SET-03",
    f"""SELECT inbox_id, transaction_id, round({name_sql('a', 'b')}, 6) AS name_score FROM (SELECT inbox_id, transaction_id, {tokens('display_name')} AS a, {tokens('name')} AS b
    FROM v_inbox JOIN v_payment ON transaction_id = 'p' || inbox_id)""",
    "v_inbox v_payment",
)
def text_name_score(spark, sf):
    i = v.inbox(spark, sf).select("inbox_id", "display_name")
    p = v.payment(spark, sf).select("transaction_id", "name")
    j = i.join(p, F.concat(F.lit("p"), "inbox_id") == F.col("transaction_id"))
    return j.select("inbox_id", "transaction_id", F.round(tx.name_score(F.col("display_name"), F.col("name")), 6).alias("name_score"))


_WORDS = "regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+')"


@query(
    "text_search",
    "FN-12 FLT-16",
    f"SELECT doc_id, source FROM (SELECT *, {_WORDS} AS w FROM documents) WHERE len(list_filter(w, lambda x: starts_with(x, 'de'))) > 0 AND len(list_filter(w, lambda x: starts_with(x, 'con'))) > 0",
)
def text_search(spark, sf):
    d = v.table(spark, sf, "documents")
    return d.filter(tx.search_match(F.col("text"), "De con")).select("doc_id", "source")


@query(
    "text_clean",
    "FN-29",
    r"""SELECT doc_id, md5(t) AS clean_md5, array_to_string(list_filter(regexp_split_to_array(t, '\s+'), lambda w: w <> '')[1:50], ' ') AS sample FROM (SELECT doc_id,
    trim(regexp_replace(regexp_replace(text, '[\x00-\x1F\x7F-\x{9F}]', '', 'g'), '[ \x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]+', ' ', 'g'), ' ') AS t FROM documents)""",
)
def text_clean(spark, sf):
    d = v.table(spark, sf, "documents").withColumn("t", tx.clean_text(F.col("text")))
    return d.select("doc_id", F.md5("t").alias("clean_md5"), tx.limit_words(F.col("t"), 50).alias("sample"))


@query(
    "text_root_domain",
    "FN-29",
    """SELECT page_id, CASE WHEN n >= 3 THEN CASE WHEN p[n-1] || '.' || p[n] IN ("""
    + "'co.uk', 'com.au', 'co.nz', 'co.za', 'com.br', 'com.mx', 'co.jp', 'com.cn'"
    + """) THEN p[n-2] || '.' || p[n-1] || '.' || p[n] ELSE p[n-1] || '.' || p[n] END ELSE array_to_string(p, '.') END AS domain
    FROM (SELECT page_id, p, len(p) AS n FROM (SELECT page_id, string_split(regexp_replace(lower(regexp_replace(regexp_replace(trim(url), '^[a-zA-Z]+://', ''), '[/?#:].*$', '')), '^www\\.', ''), '.') AS p FROM pages))""",
)
def text_root_domain(spark, sf):
    return v.table(spark, sf, "pages").select("page_id", tx.root_domain(F.col("url")).alias("domain"))


def amount_sql() -> str:
    vat = " OR ".join(f"abs(ratio - 1 - {r}::DOUBLE) <= 0.015::DOUBLE" for r in ms.VAT_RATES)
    return f"""CASE WHEN x = 0 OR y = 0 THEN 0.5 WHEN currency = t_currency THEN CASE WHEN diff = 0 THEN 1 WHEN diff <= 0.01 THEN 0.98 WHEN diff <= 0.02 THEN 0.95 WHEN diff <= 0.05 THEN 0.85
    WHEN diff <= 0.1 THEN 0.6 WHEN diff <= 0.2 THEN 0.3 WHEN {vat} THEN 0.88 ELSE 0 END WHEN base_currency = t_base_currency THEN CASE WHEN bdiff = 0 THEN 1 WHEN (b1 + b2) / 2 >= 5000 THEN
    CASE WHEN bdiff <= 0.015 THEN 0.95 WHEN bdiff <= 0.03 THEN 0.75 WHEN bdiff <= 0.05 THEN 0.5 WHEN bdiff <= 0.1 THEN 0.3 ELSE 0 END ELSE CASE WHEN bdiff <= 0.02 THEN 0.9 WHEN bdiff <= 0.05 THEN 0.8
    WHEN bdiff <= 0.1 THEN 0.65 WHEN bdiff <= 0.15 THEN 0.45 WHEN bdiff <= 0.25 THEN 0.25 ELSE 0 END END ELSE CASE WHEN ratio > 5 THEN 0.1 WHEN diff <= 0.05 THEN 0.7 WHEN diff <= 0.2 THEN 0.4 ELSE 0.1 END END"""


_NEAR = "CASE WHEN d = 0 THEN 1 WHEN d <= 1 THEN 0.95 WHEN d <= 3 THEN 0.85 WHEN d <= 7 THEN 0.75 WHEN d <= 14 THEN 0.6 WHEN d <= 30 THEN greatest(0.3, 1 - d / 30::DOUBLE * 0.7::DOUBLE) ELSE 0.1 END"
_DATE = f"""CASE WHEN type = 'invoice' THEN CASE WHEN s BETWEEN 24 AND 38 THEN 0.98 WHEN s BETWEEN 55 AND 68 THEN 0.96 WHEN s BETWEEN 85 AND 98 THEN 0.94 WHEN s BETWEEN 10 AND 20 THEN 0.95 WHEN s BETWEEN 3 AND 11 THEN 0.93
  WHEN s BETWEEN 1 AND 6 THEN 0.99 WHEN s BETWEEN 1 AND 123 THEN greatest(0.7, 0.9::DOUBLE - (s - 33) * 0.002::DOUBLE) WHEN s BETWEEN -10 AND 0 THEN 0.85 ELSE {_NEAR} END
  WHEN s < 0 AND d + 3 <= 4 THEN 0.99 WHEN s < 0 AND d + 3 <= 10 THEN 0.95 WHEN s < 0 AND d + 3 <= 33 THEN 0.9 WHEN s < 0 AND d + 3 <= 63 THEN 0.8 WHEN s < 0 AND d + 3 <= 93 THEN 0.7 WHEN s BETWEEN 0 AND 10 THEN 0.85 ELSE {_NEAR} END"""


def scored_sql(source: str, keep: str, alias: str = "0", penalty: str = "0", auto: str = "FALSE") -> str:
    return f"""SELECT {keep}, match_type FROM (SELECT *, CASE WHEN {auto} AND confidence >= 0.9 AND name_score >= 0.4 THEN 'auto_matched' WHEN confidence >= 0.72 THEN 'high_confidence' ELSE 'suggested' END AS match_type FROM (SELECT *, round(greatest(0, least(1, (greatest(
   (name_score * 10 + amount_score * wa + date_score * wd + currency_score * 5) / (wa + wd + 15), CASE WHEN exact AND name_score >= 0.5 AND date_score >= 0.7 THEN 0.92 WHEN exact AND name_score >= 0.3 AND date_score >= 0.5 THEN 0.85
   WHEN exact AND same AND date_score >= 0.6 THEN 0.78 ELSE 0 END::DOUBLE) + CASE WHEN NOT same AND name_score >= 0.5 AND amount_score >= 0.6 AND date_score >= 0.3 THEN 0.05 ELSE 0 END::DOUBLE)
   * CASE WHEN name_score = 0 THEN 0.55 ELSE 1 END::DOUBLE * CASE WHEN date_score < 0.2 THEN 0.65 ELSE 1 END::DOUBLE - {penalty}::DOUBLE)), 3) AS confidence
   FROM (SELECT *, CASE WHEN NOT same AND name_score >= 0.8 THEN 20 ELSE 30 END::DOUBLE AS wa, CASE WHEN NOT same AND name_score >= 0.8 THEN 25 ELSE 15 END::DOUBLE AS wd
    FROM (SELECT *, currency = t_currency AS same, abs(abs(amount) - abs(t_amount)) < 0.01 AS exact, CASE WHEN len(ta) = 0 THEN 0 ELSE greatest(CAST({name_sql('ta', 'tb')} AS DOUBLE), {alias}::DOUBLE) END AS name_score, CAST({amount_sql()} AS DOUBLE) AS amount_score,
     CAST(CASE WHEN currency = t_currency THEN 1 WHEN base_currency = t_base_currency THEN 0.7 ELSE 0.3 END AS DOUBLE) AS currency_score, CAST({_DATE} AS DOUBLE) AS date_score
     FROM (SELECT *, abs(x - y) / greatest(x, y) AS diff, greatest(x, y) / greatest(least(x, y), 1e-9) AS ratio, abs(b1 - b2) / greatest(b1, b2) AS bdiff FROM (SELECT *, abs(amount)::DOUBLE AS x, abs(t_amount)::DOUBLE AS y,
      abs(base_amount)::DOUBLE AS b1, abs(t_base_amount)::DOUBLE AS b2, t_date - date AS s, abs(t_date - date) AS d, {tokens('display_name')} AS ta, {tokens('t_name')} AS tb FROM ({source})))))))"""


_PAY = "SELECT transaction_id, team_id AS t_team, name AS t_name, amount AS t_amount, currency AS t_currency, date AS t_date, base_amount AS t_base_amount, base_currency AS t_base_currency FROM v_payment"
_KEEP = "inbox_id, transaction_id, round(name_score, 6) AS name_score, amount_score, currency_score, round(date_score, 6) AS date_score, confidence"


def _true_pairs(spark, sf):
    i, p = v.inbox(spark, sf), v.payment(spark, sf).drop("team_id")
    p = p.select([F.col(c).alias(f"t_{c}") if c != "transaction_id" else F.col(c) for c in p.columns])
    return i.join(p, F.concat(F.lit("p"), "inbox_id") == F.col("transaction_id"))


def _out(s):
    return s.select("inbox_id", "transaction_id", F.round("name_score", 6).alias("name_score"), "amount_score", "currency_score", F.round("date_score", 6).alias("date_score"), "confidence", "match_type")


@query(
    "link_pair_scores",
    "FN-13 FN-14 FN-15 FN-16 FN-17",
    scored_sql(f"SELECT * FROM v_inbox JOIN ({_PAY}) ON transaction_id = 'p' || inbox_id", _KEEP),
    "v_inbox v_payment",
)
def link_pair_scores(spark, sf):
    return _out(linkage.score_pairs(_true_pairs(spark, sf)))


@query(
    "link_cross_currency",
    "FN-14",
    """SELECT i.inbox_id, p.transaction_id, i.currency <> p.currency AND abs(abs(i.base_amount) - abs(p.base_amount))::DOUBLE < CASE WHEN g < 100 THEN greatest(10, g * 0.04::DOUBLE) WHEN g < 1000 THEN greatest(15, g * 0.02::DOUBLE) ELSE greatest(25, g * 0.015::DOUBLE) END AS cross_match
    FROM v_inbox i JOIN v_payment p ON i.team_id = p.team_id AND i.date = p.date, LATERAL (SELECT (abs(i.base_amount)::DOUBLE + abs(p.base_amount)::DOUBLE) / 2 AS g)""",
    "v_inbox v_payment",
)
def link_cross_currency(spark, sf):
    i, p = v.inbox(spark, sf).alias("i"), v.payment(spark, sf).alias("p")
    j = i.join(p, ["team_id", "date"])
    hit = ms.cross_currency_match(*[F.col(c) for c in ("i.currency", "i.base_amount", "i.base_currency", "p.currency", "p.base_amount", "p.base_currency")])
    return j.select("inbox_id", "transaction_id", hit.alias("cross_match"))


# The SQL of the candidate queries compares every pair of the date band and is too slow on
# whole tables; tests compare them with brute force on a small fixture.
_CANDS: dict = {}


def cands(spark, sf):
    key = (spark.sparkContext.applicationId, sf)
    if key not in _CANDS:
        _CANDS[key] = checkpointed(linkage.candidates(v.inbox(spark, sf), v.payment(spark, sf)))
    return _CANDS[key]


def _waiting(spark, sf):
    """Inbox items with a status; some are matched already."""
    k = F.col("inbox_id").cast("long")
    status = F.element_at(F.array(*[F.lit(x) for x in ("pending", "no_match", "done", "pending")]), (k % 4 + 1).cast("int"))
    return v.inbox(spark, sf).withColumns({"status": status, "attached_to": F.when(k % 9 == 0, F.concat(F.lit("p"), "inbox_id"))})


@query("link_candidates_reverse", "JON-09")
def link_candidates_reverse(spark, sf):
    return linkage.reverse_candidates(v.payment(spark, sf), _waiting(spark, sf)).select("transaction_id", "inbox_id", "rank", "name_similarity")


@query("link_candidates", "JON-08 FN-10")
def link_candidates(spark, sf):
    return cands(spark, sf).select("inbox_id", "transaction_id", "rank", "name_similarity")


@query("link_scored_candidates", "FN-16 FN-17 JON-08")
def link_scored_candidates(spark, sf):
    return _out(linkage.score_pairs(cands(spark, sf)))


@query("link_best_match", "SET-04 SRT-12")
def link_best_match(spark, sf):
    i = v.inbox(spark, sf).filter(F.col("inbox_id").cast("long") % 3 == 0)
    dismissed = i.select("inbox_id", F.concat(F.lit("p"), "inbox_id").alias("transaction_id"))
    return linkage.best_matches(linkage.score_pairs(cands(spark, sf)), 0.6, dismissed).select("inbox_id", "transaction_id", "confidence")


@query("link_assignment", "JON-13")
def link_assignment(spark, sf):
    s = linkage.score_pairs(cands(spark, sf)).filter(F.col("confidence") >= 0.6)
    return linkage.assign_one_to_one(s, "inbox_id", "transaction_id", "confidence")


def _search_text(k, name, amount):
    """What is typed: the start of a customer's number, an amount, or a word and the start of a number."""
    way = F.floor(k / 20) % 3
    number = F.lower(F.substring(name, 10, 8))
    return F.when(way == 0, number).when(way == 1, F.floor(F.abs(amount)).cast("string")).otherwise(F.concat(F.lit("cust "), F.substring(name, 10, 7)))


def _hits_sql(asking: str, items: str, keep: int) -> str:
    """team_id, text, item_id, place of text searches; ``items``: team_id, item_id, name, date, x, y."""
    return f"""SELECT team_id, text, item_id, place FROM (SELECT *, row_number() OVER (PARTITION BY team_id, text ORDER BY date DESC, item_id) AS place FROM (
      SELECT q.team_id, text, item_id, date FROM (SELECT DISTINCT q.team_id, text, name FROM (SELECT *, list_filter(string_split(lower(text), ' '), lambda t: t <> '') AS terms FROM (SELECT DISTINCT team_id, text FROM {asking})) q
        JOIN (SELECT DISTINCT team_id, name, list_filter(string_split_regex(lower(name), '[^a-z0-9]+'), lambda w: w <> '') AS ws FROM {items}) USING (team_id)
        WHERE contains(lower(name), lower(text)) OR len(list_filter(terms, lambda t: len(list_filter(ws, lambda w: starts_with(w, t))) > 0)) = len(terms)) q JOIN {items} i ON i.team_id = q.team_id AND i.name = q.name
      UNION SELECT q.team_id, text, item_id, date FROM (SELECT DISTINCT team_id, text, TRY_CAST(regexp_extract(regexp_replace(text, '[^0-9.-]', '', 'g'), '^-?([0-9]+([.][0-9]*)?|[.][0-9]+)') AS DOUBLE) AS v FROM {asking}) q
        JOIN {items} i ON i.team_id = q.team_id AND (abs(x - v) <= greatest(1, abs(v) * 0.1::DOUBLE) OR abs(y - v) <= greatest(1, abs(v) * 0.1::DOUBLE)))) WHERE place <= {keep}"""


def _typed_sql(k: str, name: str, amount: str) -> str:
    return f"CASE ({k} // 20) % 3 WHEN 0 THEN lower(substr({name}, 10, 8)) WHEN 1 THEN CAST(CAST(floor(abs({amount})) AS BIGINT) AS VARCHAR) ELSE 'cust ' || substr({name}, 10, 7) END"


view("v_receipt_search", "v_inbox", f"SELECT *, {_typed_sql('CAST(inbox_id AS BIGINT)', 'display_name', 'amount')} AS text FROM v_inbox WHERE CAST(inbox_id AS BIGINT) % 20 = 0")
view("v_found_item", "v_payment", "SELECT team_id, transaction_id AS item_id, name, date, abs(amount)::DOUBLE AS x, abs(base_amount)::DOUBLE AS y FROM v_payment")
view("v_payment_search", "v_payment", f"SELECT *, {_typed_sql('CAST(substr(transaction_id, 2) AS BIGINT)', 'name', 'amount')} AS text FROM v_payment WHERE CAST(substr(transaction_id, 2) AS BIGINT) % 20 = 0")
view("v_open_item", "v_inbox", "SELECT team_id, inbox_id AS item_id, display_name AS name, date, amount::DOUBLE AS x, amount::DOUBLE AS y FROM v_inbox WHERE CAST(inbox_id AS BIGINT) % 9 <> 0")
view("v_receipt_hit", "v_receipt_search v_found_item", _hits_sql("v_receipt_search", "v_found_item", 30))
view("v_payment_hit", "v_payment_search v_open_item", _hits_sql("v_payment_search", "v_open_item", 30))


@query(
    "link_rerank",
    "SRT-12 FLT-05 FLT-06",
    f"""SELECT inbox_id, transaction_id, confidence, matched, rank FROM (SELECT *, row_number() OVER (PARTITION BY inbox_id ORDER BY confidence DESC, matched, place) AS rank FROM ({scored_sql(
        f"SELECT r.* EXCLUDE (type), '' AS type, p.*, place, CAST(substr(transaction_id, 2) AS BIGINT) % 4 = 0 AS matched FROM v_receipt_search r JOIN v_receipt_hit h ON h.team_id = r.team_id AND h.text = r.text JOIN ({_PAY}) p ON transaction_id = item_id",
        "inbox_id, transaction_id, confidence, matched, place")})) WHERE rank <= 5""",
    "v_receipt_search v_receipt_hit v_payment",
)
def link_rerank(spark, sf):
    """The stated searches are those typed beside every receipt whose id is divisible by 20."""
    k = F.col("inbox_id").cast("long")
    receipts = v.inbox(spark, sf).where(k % 20 == 0).withColumn("text", _search_text(k, F.col("display_name"), F.col("amount")))
    payments = v.payment(spark, sf).withColumn("matched", F.substring("transaction_id", 2, 20).cast("long") % 4 == 0)
    return search.search_payments(receipts, payments, 5, include_matched=True).select("inbox_id", "transaction_id", "confidence", "matched", "rank")


@query(
    "link_rerank_receipts",
    "SRT-12 FLT-07",
    f"""SELECT transaction_id, inbox_id, confidence, rank FROM (SELECT *, row_number() OVER (PARTITION BY transaction_id ORDER BY confidence DESC, place) AS rank FROM ({scored_sql(
        f"SELECT i.*, p.transaction_id, name AS t_name, p.amount AS t_amount, p.currency AS t_currency, p.date AS t_date, p.base_amount AS t_base_amount, p.base_currency AS t_base_currency, place FROM v_payment_search p JOIN v_payment_hit h ON h.team_id = p.team_id AND h.text = p.text JOIN v_inbox i ON i.inbox_id = item_id",
        "inbox_id, transaction_id, confidence, place")})) WHERE rank <= 10""",
    "v_payment_search v_payment_hit v_inbox",
)
def link_rerank_receipts(spark, sf):
    """The stated searches are those typed beside every payment whose number is divisible by 20."""
    k = F.substring("transaction_id", 2, 20).cast("long")
    payments = v.payment(spark, sf).where(k % 20 == 0).withColumn("text", _search_text(k, F.col("name"), F.col("amount")))
    return search.search_receipts(payments, _waiting(spark, sf)).select("transaction_id", "inbox_id", "confidence", "rank")


def _suggestions(spark, sf):
    """Outcomes of earlier suggestions, read off the true pairs."""
    s = linkage.score_pairs(_true_pairs(spark, sf))
    k = F.col("inbox_id").cast("long")
    status = F.when(k % 4 == 1, "declined").when(k % 4 == 3, "unmatched").otherwise("confirmed")
    return s.select(
        "team_id",
        (F.lit("Vendor ").cast("string")).alias("_"),
        F.concat(F.lit("Vendor-"), (k % 40).cast("string"), F.lit(" Ltd.")).alias("inbox_name"),
        F.concat(F.lit("VENDOR "), (k % 40).cast("string")).alias("transaction_name"),
        status.alias("status"),
        F.col("confidence"),
        F.date_sub(F.lit("2001-06-30").cast("date"), (k % 170).cast("int")).alias("created"),
    ).drop("_")


view(
    "v_suggestions",
    "v_inbox v_payment",
    f"""SELECT team_id, 'Vendor-' || (k % 40) || ' Ltd.' AS inbox_name, 'VENDOR ' || (k % 40) AS transaction_name, CASE k % 4 WHEN 1 THEN 'declined' WHEN 3 THEN 'unmatched' ELSE 'confirmed' END AS status, confidence,
  DATE '2001-06-30' - CAST(k % 170 AS INT) AS created FROM (SELECT *, CAST(inbox_id AS BIGINT) AS k FROM ({scored_sql(f"SELECT * FROM v_inbox JOIN ({_PAY}) ON transaction_id = 'p' || inbox_id", "team_id, " + _KEEP)}))""",
)
_LEARN = "trim(regexp_replace(regexp_replace(lower({}), '[.,\\-_''\"()&]', ' ', 'g'), '\\s+', ' ', 'g'))"


view(
    "v_pair_history",
    "v_suggestions",
    f"""SELECT team_id, inbox_key, transaction_key, n, confirmed, negative, CASE WHEN confirmed >= 2 THEN 0.9 ELSE 0 END AS alias_score,
    n >= 3 AND confirmed >= 3 AND confirmed / n >= 0.9 AND negative <= 1 AND a >= 0.85 AS can_auto_match,
    CASE WHEN neg < 1.5 OR (rec >= 2 AND con >= neg) OR greatest(0, neg - con * 0.7::DOUBLE) <= 0.3 THEN 0 ELSE round(greatest(0, least(0.35, 0.08::DOUBLE + greatest(0, neg - con * 0.7::DOUBLE) * 0.08::DOUBLE)), 6) END AS decline_penalty
    FROM (SELECT team_id, {_LEARN.format('inbox_name')} AS inbox_key, {_LEARN.format('transaction_name')} AS transaction_key, count(*) AS n, count(CASE WHEN status = 'confirmed' THEN 1 END) AS confirmed, count(CASE WHEN status <> 'confirmed' THEN 1 END) AS negative,
     coalesce(avg(CASE WHEN status = 'confirmed' THEN confidence END), 0) AS a, coalesce(sum(CASE WHEN age < 90 AND status = 'declined' THEN exp(-age / 45.0::DOUBLE) END), 0) + coalesce(sum(CASE WHEN age < 90 AND status = 'unmatched' THEN exp(-age / 45.0::DOUBLE) END), 0) * 0.6::DOUBLE AS neg,
     coalesce(sum(CASE WHEN age < 90 AND status = 'confirmed' THEN exp(-age / 45.0::DOUBLE) END), 0) AS con, count(CASE WHEN age <= 45 AND status = 'confirmed' THEN 1 END) AS rec
     FROM (SELECT *, greatest(0, DATE '2001-06-30' - created) AS age FROM v_suggestions WHERE created > DATE '2001-06-30' - INTERVAL 6 MONTH) GROUP BY 1, 2, 3)""",
)


@query("link_pair_history", "AGG-46 JON-10", "SELECT * FROM v_pair_history", "v_pair_history")
def link_pair_history(spark, sf):
    return linkage.pair_history(_suggestions(spark, sf), "2001-06-30")


@query(
    "link_scored_with_history",
    "JON-10 FN-16 FN-17",
    scored_sql(
        f"""SELECT i.* EXCLUDE (display_name), 'Vendor-' || (CAST(inbox_id AS BIGINT) % 40) || ' Ltd.' AS display_name, p.* EXCLUDE (t_name), 'VENDOR ' || (CAST(inbox_id AS BIGINT) % 40) AS t_name, coalesce(alias_score, 0) AS alias, coalesce(decline_penalty, 0) AS penalty, coalesce(can_auto_match, FALSE) AS auto
        FROM v_inbox i JOIN ({_PAY}) p ON transaction_id = 'p' || inbox_id LEFT JOIN v_pair_history h ON h.team_id = i.team_id AND inbox_key = 'vendor ' || (CAST(inbox_id AS BIGINT) % 40) || ' ltd' AND transaction_key = 'vendor ' || (CAST(inbox_id AS BIGINT) % 40)""",
        _KEEP, "alias", "penalty", "auto"),
    "v_inbox v_payment v_pair_history",
)
def link_scored_with_history(spark, sf):
    """The true pairs under what was learned about their names, with automatic matches on."""
    history = linkage.pair_history(_suggestions(spark, sf), "2001-06-30")
    k = F.col("inbox_id").cast("long") % 40
    pairs = _true_pairs(spark, sf).withColumns({"display_name": F.concat(F.lit("Vendor-"), k.cast("string"), F.lit(" Ltd.")), "t_name": F.concat(F.lit("VENDOR "), k.cast("string"))})
    return _out(linkage.score_pairs(pairs, history, auto_enabled=True))


view(
    "v_sweep",
    "v_suggestions",
    """SELECT team_id, threshold, tp, fp, fn, CASE WHEN tp + fp > 0 THEN round(tp / (tp + fp), 6) ELSE 0 END AS precision, CASE WHEN tp + fn > 0 THEN round(tp / (tp + fn), 6) ELSE 0 END AS recall,
  CASE WHEN tp > 0 THEN round(2 * tp / (2 * tp + fp + fn), 6) ELSE 0 END AS f1 FROM (SELECT team_id, t / 100 AS threshold, CAST(sum(CASE WHEN confidence >= t / 100 AND status = 'confirmed' THEN 1 ELSE 0 END) AS BIGINT) AS tp,
  CAST(sum(CASE WHEN confidence >= t / 100 AND status <> 'confirmed' THEN 1 ELSE 0 END) AS BIGINT) AS fp, CAST(sum(CASE WHEN confidence < t / 100 AND status = 'confirmed' THEN 1 ELSE 0 END) AS BIGINT) AS fn FROM v_suggestions, range(25, 90) g(t) GROUP BY 1, 2)""",
)


@query("link_threshold_sweep", "AGG-51", "SELECT * FROM v_sweep", "v_sweep")
def link_threshold_sweep(spark, sf):
    return linkage.threshold_sweep(_suggestions(spark, sf).withColumn("is_match", F.col("status") == "confirmed"))


view(
    "v_best_t",
    "v_sweep",
    """SELECT team_id, threshold, sample_size FROM (SELECT *, row_number() OVER (PARTITION BY team_id ORDER BY f1 DESC, precision DESC, threshold) AS rn FROM v_sweep) JOIN (SELECT team_id, count(*) AS sample_size FROM v_suggestions GROUP BY 1
  HAVING count(*) >= 20 AND count(CASE WHEN status = 'confirmed' THEN 1 END) >= 5 AND count(CASE WHEN status <> 'confirmed' THEN 1 END) >= 5) USING (team_id) WHERE rn = 1""",
)


@query("link_best_threshold", "AGG-45", "SELECT * FROM v_best_t", "v_best_t")
def link_best_threshold(spark, sf):
    return linkage.best_threshold(_suggestions(spark, sf).withColumn("is_match", F.col("status") == "confirmed"))


@query(
    "link_calibration",
    "AGG-44",
    """SELECT team_id, total, confirmed, declined, unmatched, round(acc, 6) AS accuracy, CASE WHEN total < 5 THEN 0.6 ELSE round(t2, 6) END AS suggested_threshold, CASE WHEN total < 5 THEN 0.9 ELSE round(greatest(0.88, least(0.95, t2 + 0.24::DOUBLE)), 6) END AS auto_threshold
    FROM (SELECT *, CASE WHEN threshold IS NOT NULL THEN greatest(0.55, least(0.85, t1 * 0.35::DOUBLE + greatest(0.55, least(0.85, threshold)) * 0.65::DOUBLE)) ELSE t1 END AS t2 FROM (SELECT *,
      CASE WHEN ac > 0 AND an > 0 AND confirmed >= 3 AND ac - an > 0.2 THEN greatest(0.65, t0 - 0.025::DOUBLE) WHEN ac > 0 AND an > 0 AND confirmed >= 3 AND ac - an < 0.08 THEN least(0.82, t0 + 0.02::DOUBLE) ELSE t0 END AS t1
      FROM (SELECT *, CAST(CASE WHEN acc > 0.9 AND confirmed >= 8 THEN 0.65 WHEN acc > 0.8 AND confirmed >= 3 THEN 0.67 WHEN acc < 0.3 AND declined >= 3 THEN 0.63 ELSE 0.6 END AS DOUBLE) AS t0 FROM (SELECT team_id, count(*) AS total,
       count(CASE WHEN status = 'confirmed' THEN 1 END) AS confirmed, count(CASE WHEN status = 'declined' THEN 1 END) AS declined, count(CASE WHEN status = 'unmatched' THEN 1 END) AS unmatched, count(CASE WHEN status = 'confirmed' THEN 1 END) / count(*) AS acc,
       coalesce(avg(CASE WHEN status = 'confirmed' THEN confidence END), 0) AS ac, coalesce(avg(CASE WHEN status <> 'confirmed' THEN confidence END), 0) AS an FROM v_suggestions GROUP BY 1) LEFT JOIN v_best_t USING (team_id))))""",
    "v_suggestions v_best_t",
)
def link_calibration(spark, sf):
    return linkage.calibration(_suggestions(spark, sf))
