"""Card risk features."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import views as v
from ..operators import baselines, velocity
from .registry import query
from .views_sql import view

PARAMS = velocity.RiskParams(high_risk=v.TXN_HIGH_RISK, small_amount=v.TXN_SMALL, high_amount=v.TXN_HIGH)

view(
    "v_stats",
    "v_txn",
    """SELECT card_id, count(*) AS card_tx_count, median(a) AS med, median(la) AS med_log, median(abs(la - ml)) AS mad FROM (
  SELECT *, median(la) OVER (PARTITION BY card_id) AS ml FROM (
    SELECT card_id, CAST(amount AS DOUBLE) AS a, ln(1 + CAST(amount AS DOUBLE)) AS la FROM v_txn)) GROUP BY card_id""",
)
view(
    "v_amount",
    "v_stats v_txn",
    """SELECT transaction_id, card_tx_count, round(med, 4) AS card_median_amount, round(mad, 6) AS card_mad_log_amount,
  round(CAST(amount AS DOUBLE) / (med + 1e-9), 4) AS amount_ratio_to_card_median,
  round((ln(1 + CAST(amount AS DOUBLE)) - med_log) / (1.4826 * mad + 1e-9), 4) AS robust_z_log_amount
  FROM v_txn JOIN v_stats USING (card_id)""",
)
view(
    "v_novelty",
    "v_txn",
    """SELECT transaction_id, prior AS prior_card_tx_count,
  prior >= 3 AND n_cat = 0 AS category_is_new_for_card, prior >= 3 AND n_mer = 0 AS merchant_is_new_for_card,
  prior >= 3 AND n_dev = 0 AND device_id <> '' AS device_is_new_for_card,
  prior >= 3 AND n_ip = 0 AND ip_address <> '' AS ip_is_new_for_card,
  prior >= 8 AND n_ch * 10 <= prior AS channel_is_unusual_for_card,
  prior >= 8 AND n_co * 10 <= prior AS merchant_country_is_unusual_for_card,
  cardholder_country <> merchant_country AS country_mismatch
  FROM (SELECT *, row_number() OVER (PARTITION BY card_id ORDER BY us, transaction_id) - 1 AS prior,
    row_number() OVER (PARTITION BY card_id, merchant_category ORDER BY us, transaction_id) - 1 AS n_cat,
    row_number() OVER (PARTITION BY card_id, merchant_name ORDER BY us, transaction_id) - 1 AS n_mer,
    row_number() OVER (PARTITION BY card_id, device_id ORDER BY us, transaction_id) - 1 AS n_dev,
    row_number() OVER (PARTITION BY card_id, ip_address ORDER BY us, transaction_id) - 1 AS n_ip,
    row_number() OVER (PARTITION BY card_id, channel ORDER BY us, transaction_id) - 1 AS n_ch,
    row_number() OVER (PARTITION BY card_id, merchant_country ORDER BY us, transaction_id) - 1 AS n_co FROM v_txn)""",
)


def _nll(f: str) -> str:
    n = f"count(*) OVER (PARTITION BY card_id, {f})"
    return f"CASE WHEN {f} = '' THEN 0.0 ELSE -ln(({n} + 1.0) / (count(*) OVER (PARTITION BY card_id) + greatest(1, d_{f}))) END"


_F = baselines.SURPRISAL_FIELDS
view(
    "v_surprisal",
    "v_txn",
    "SELECT transaction_id, "
    + ", ".join(f"round(s_{f}, 4) AS {f}_card_surprisal" for f in _F)
    + ", round(s_combo, 4) AS category_channel_country_combo_surprisal, round(("
    + " + ".join(f"s_{f}" for f in _F)
    + " + s_combo) / ("
    + " + ".join(f"CASE WHEN {f} = '' THEN 0 ELSE 1 END" for f in _F)
    + " + 1), 4) AS categorical_surprisal_raw FROM (SELECT *, "
    + ", ".join(f"{_nll(f)} AS s_{f}" for f in (*_F, "combo"))
    + " FROM (SELECT *, concat_ws('|', merchant_category, channel, merchant_country) AS combo FROM v_txn) JOIN (SELECT card_id, "
    + ", ".join(f"count(DISTINCT CASE WHEN {f} <> '' THEN {f} END) AS d_{f}" for f in _F)
    + ", count(DISTINCT concat_ws('|', merchant_category, channel, merchant_country)) AS d_combo FROM v_txn GROUP BY card_id) USING (card_id))",
)


def _frame(keys: str, minutes: int, past: bool = False) -> str:
    end = "CURRENT ROW" if past else f"INTERVAL {minutes} MINUTE FOLLOWING"
    return f"OVER (PARTITION BY {keys} ORDER BY ts RANGE BETWEEN INTERVAL {minutes} MINUTE PRECEDING AND {end})"


_HR = "('" + "','".join(v.TXN_HIGH_RISK) + "')"


def _velocity_sql(past: bool) -> str:
    def f(k, m):
        return _frame(k, m, past)

    return f"""SELECT transaction_id, count(*) {f('card_id', 10)} AS card_tx_count_10m, count(*) {f('card_id', 60)} AS card_tx_count_60m,
  count(CASE WHEN channel = 'online' THEN 1 END) {f('card_id', 60)} AS card_online_tx_count_60m,
  count(CASE WHEN amount <= {v.TXN_SMALL} THEN 1 END) {f('card_id', 60)} AS card_small_tx_count_60m,
  count(CASE WHEN merchant_category IN {_HR} THEN 1 END) {f('card_id', 1440)} AS card_high_risk_tx_count_24h,
  count(CASE WHEN amount >= {v.TXN_HIGH} THEN 1 END) {f('card_id', 1440)} AS card_high_amount_tx_count_24h,
  count(*) {f('card_id, merchant_name', 60)} AS same_card_same_merchant_count_60m,
  CAST(sum(amount) {f('card_id, merchant_name', 60)} AS DECIMAL(28,2)) AS same_card_same_merchant_sum_60m,
  CASE WHEN device_id = '' THEN 0 ELSE count(*) {f('card_id, device_id', 1440)} END AS same_card_same_device_count_24h,
  count(*) {f('card_id, merchant_name, merchant_category', 60)} >= 3 AND (sum(amount) {f('card_id, merchant_name, merchant_category', 60)} >= 300
    OR count(*) {f('card_id, merchant_name, merchant_category', 60)} >= 8) AS split_purchase_suspect"""


view(
    "v_velocity",
    "v_txn",
    _velocity_sql(False)
    + f""", count(*) {_frame('merchant_name', 60)} AS merchant_tx_count_60m,
  count(DISTINCT card_id) {_frame('merchant_name', 60)} AS merchant_unique_cards_60m,
  CASE WHEN device_id = '' THEN 0 ELSE count(DISTINCT card_id) {_frame('device_id', 60)} END AS device_unique_cards_60m,
  CASE WHEN ip_address = '' THEN 0 ELSE count(DISTINCT card_id) {_frame('ip_address', 60)} END AS ip_unique_cards_60m FROM v_txn""",
)
view(
    "v_near_dup",
    "v_txn",
    """SELECT a.transaction_id, bool_or(b.transaction_id IS NOT NULL) AS same_card_same_amount_near_duplicate_24h
  FROM v_txn a LEFT JOIN v_txn b ON a.card_id = b.card_id AND a.merchant_name = b.merchant_name AND a.transaction_id <> b.transaction_id
   AND abs(a.us - b.us) <= 86400000000 AND abs(a.amount - b.amount) <= greatest(1.0, a.amount * 0.02) GROUP BY a.transaction_id""",
)


def _seen(key: str, minutes: int, agg: str) -> str:
    """Correlated count over rows that arrived up to the row itself."""
    return f"""(SELECT b.*, a.transaction_id AS aid FROM t a JOIN t b ON a.{key} = b.{key} AND b.us BETWEEN a.us - {minutes * 60_000_000} AND a.us
      AND (b.us < a.us OR b.transaction_id <= a.transaction_id) WHERE a.{key} <> '')"""


def _arrival(key: str, minutes: int, alias: str) -> str:
    return f"""LEFT JOIN (SELECT aid, count(DISTINCT card_id) AS d_{alias}, count(*) AS n_{alias} FROM {_seen(key, minutes, '')} GROUP BY aid) {alias}
    ON t.transaction_id = {alias}.aid"""


view(
    "v_collective",
    "v_txn",
    f"""WITH t AS (SELECT *, CASE WHEN ip_address = '' THEN '' ELSE split_part(ip_address, '.', 1) || '.' || split_part(ip_address, '.', 2) END AS ip_prefix FROM v_txn),
  f AS (SELECT t.*, d_m60, n_m60, d_m24, coalesce(d_d24, 0) AS d_d24, coalesce(d_i24, 0) AS d_i24, coalesce(d_p60, 0) AS d_p60, coalesce(n_p60, 0) AS n_p60,
    count(DISTINCT card_id) OVER (PARTITION BY merchant_name ORDER BY us, transaction_id ROWS UNBOUNDED PRECEDING) AS mt,
    CASE WHEN device_id = '' THEN 0 ELSE count(DISTINCT card_id) OVER (PARTITION BY device_id ORDER BY us, transaction_id ROWS UNBOUNDED PRECEDING) END AS dt,
    CASE WHEN ip_address = '' THEN 0 ELSE count(DISTINCT card_id) OVER (PARTITION BY ip_address ORDER BY us, transaction_id ROWS UNBOUNDED PRECEDING) END AS it,
    row_number() OVER (PARTITION BY merchant_name, merchant_category, merchant_country ORDER BY us, transaction_id) AS cl
    FROM t {_arrival('merchant_name', 60, 'm60')} {_arrival('merchant_name', 1440, 'm24')} {_arrival('device_id', 1440, 'd24')}
    {_arrival('ip_address', 1440, 'i24')} {_arrival('ip_prefix', 60, 'p60')})
  SELECT transaction_id, ip_prefix, d_m24 AS merchant_unique_cards_24h, d_d24 AS device_unique_cards_24h, d_i24 AS ip_unique_cards_24h,
    d_p60 AS ip_prefix_unique_cards_60m, n_p60 AS ip_prefix_tx_count_60m, mt AS merchant_unique_cards_total, dt AS device_unique_cards_total,
    it AS ip_unique_cards_total, cl AS merchant_category_country_cluster_count, cl <= 4 AS merchant_category_country_cluster_rarity,
    round(greatest(0.0, least(1.0, (d_m60 - 2.0) / 6.0::DOUBLE + (n_m60 - 3.0) / 18.0::DOUBLE)), 4) AS merchant_burst_score,
    dt > 1 AS shared_device_with_other_cards, it > 1 AS shared_ip_with_other_cards, d_m60 >= 5 AND n_m60 >= 5 AS unusual_merchant_hit_by_many_cards
  FROM f""",
)

BASE = ("transaction_id", "ts", "us", "card_id", "amount", "merchant_name", "merchant_category", "channel", "cardholder_country", "merchant_country", "device_id", "ip_address")


def _features_only(df):
    return df.select("transaction_id", *[c for c in df.columns if c not in BASE])


@query("risk_card_amount", "AGG-01 JON-01 FN-01", "SELECT * FROM v_amount", "v_amount")
def risk_card_amount(spark, sf):
    t = v.txn(spark, sf)
    return _features_only(baselines.amount_features(t, baselines.card_stats(t)))


@query("risk_card_novelty", "WIN-01 WIN-02 WIN-03", "SELECT * FROM v_novelty", "v_novelty")
def risk_card_novelty(spark, sf):
    return _features_only(baselines.novelty_features(v.txn(spark, sf)))


@query("risk_surprisal", "AGG-02 FN-02", "SELECT * FROM v_surprisal", "v_surprisal")
def risk_surprisal(spark, sf):
    return _features_only(baselines.surprisal_features(v.txn(spark, sf)))


@query("risk_velocity", "WIN-04 WIN-05 WIN-06 WIN-07", "SELECT * FROM v_velocity", "v_velocity")
def risk_velocity(spark, sf):
    return _features_only(velocity.velocity_features(v.txn(spark, sf), PARAMS))


@query(
    "risk_velocity_past",
    "WIN-04 WIN-06 WIN-07",
    _velocity_sql(True) + " FROM v_txn",
    "v_txn",
)
def risk_velocity_past(spark, sf):
    out = _features_only(velocity.velocity_features(v.txn(spark, sf), PARAMS, past_only=True))
    return out.drop("merchant_tx_count_60m", "merchant_unique_cards_60m", "device_unique_cards_60m", "ip_unique_cards_60m")


@query("risk_near_duplicates", "JON-16", "SELECT * FROM v_near_dup", "v_near_dup")
def risk_near_duplicates(spark, sf):
    return _features_only(velocity.near_duplicates(v.txn(spark, sf)))


@query("risk_collective", "WIN-08 WIN-09 WIN-10 WIN-11 FN-06", "SELECT * FROM v_collective", "v_collective")
def risk_collective(spark, sf):
    return _features_only(velocity.collective_features(v.txn(spark, sf)))
