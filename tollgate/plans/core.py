"""Queries over the adapter views, each beside DuckDB SQL for the same rows."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..contract import TYPOLOGIES
from ..functions import columns as C
from ..operators import alerts, diagnostics, drift, history, labeling, leaks, nulls, order, replay, splits
from ..sources import adapters, files, transfers
from ..storage import Scope, materialize, shared_dir

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

CUT, BUDGETS, SMALL, BOUNDARY = "2024-01-16", (10, 25, 50), (1, 5, 10), "1996-01-01"
T, E = f"WITH t AS ({adapters.TXNS})", f"WITH t AS ({adapters.evts_sql('duckdb')})"
_SIDES = "(SELECT event_date AS day, sender_id AS acct, * FROM t UNION ALL SELECT event_date, receiver_id, * FROM t)"
AD = f", ad AS (SELECT day, acct, max(score) AS score, max(is_laundering) AS y, max(CASE WHEN ring_id IS NULL THEN score END) AS other_max FROM {_SIDES} GROUP BY 1, 2)"
MEM = f", mem AS (SELECT DISTINCT day, acct, ring_id FROM {_SIDES} WHERE ring_id IS NOT NULL)"
RK = """, rk AS (SELECT *, row_number() OVER (PARTITION BY day ORDER BY score DESC, acct) AS r1, rank() OVER (PARTITION BY day ORDER BY score DESC) AS r2,
  count(*) OVER (PARTITION BY day ORDER BY score DESC RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS r3 FROM ad)"""


def ks(budgets: tuple[int, ...]) -> str:
    return f", ks AS (SELECT CAST(unnest({list(budgets)}) AS INTEGER) AS k)"


def r9(*parts: str) -> str:
    """``expr AS name`` items with their doubles rounded to nine places."""
    return ", ".join("round({}, 9) AS {}".format(*p.rsplit(" AS ", 1)) for p in parts)


def rounded(df: DataFrame, places: int = 9) -> DataFrame:
    return df.select(*[F.round(c, places).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


#: Added before rounding, so that exact halves, which engines round differently, do not occur.
NUDGE = 2.5e-8


def steady(df: DataFrame) -> DataFrame:
    """Doubles to six places, clear of halves."""
    return df.select(*[F.round(F.col(c) + NUDGE, 6).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def query(oracle: str | None = None, name: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        key = name or f.__name__
        QUERIES[key] = lambda spark, sf_dir: rounded(f(spark, sf_dir))
        if oracle:
            ORACLES[key] = oracle
        return f

    return add


txns, evts = adapters.txns, adapters.evts

# Ingest


@query(T + """ SELECT count(*) AS rows, CAST(sum(is_laundering) AS BIGINT) AS positives, round(round(100.0 * sum(is_laundering) / count(*), 4), 9) AS prevalence_pct,
  min(event_time) AS min_event_time, max(event_time) AS max_event_time, count(DISTINCT event_date) AS days, count(DISTINCT sender_id) AS distinct_senders,
  count(DISTINCT txn_id) = count(*) AND min(txn_id) = 1 AND max(txn_id) = count(*) AS txn_id_contiguous FROM t""")
def ingest_identity_stats(s, d):
    return diagnostics.ingest_stats(txns(s, d))


def _raw(s: SparkSession, d: str) -> DataFrame:
    e = evts(s, d)
    acct = lambda c: F.substr(F.col(c), F.instr(F.col(c), "_") + 1)
    return e.select(
        F.date_format("event_time", "yyyy/MM/dd HH:mm"), "sender_bank", acct("sender_id").alias("sa"), "receiver_bank", acct("receiver_id").alias("ra"), "amount_received", "receiving_currency",
        "amount_paid", "payment_currency", "payment_format", "is_laundering", "ring_id", "typology", "txn_id", "event_time",
    )


@query(E + """ SELECT row_number() OVER (ORDER BY txn_id) AS txn_id, event_time, event_date, sender_id, receiver_id, round(amount_paid, 9) AS amount_paid,
  CAST(is_laundering AS TINYINT) AS is_laundering FROM t""")
def csv_identity(s, d):
    """Write the events as a raw CSV and read it back with its file-order identity."""
    raw = _raw(s, d)
    lines = order.positions(raw, "txn_id").select("position", F.concat_ws(",", *[F.col(c).cast("string") for c in raw.columns[:11]]).alias("value"))
    # A file for every so many rows, each under the header, in name order.
    lines = lines.withColumn("part", F.lpad(F.floor(F.col("position") / 50_000).cast("string"), 9, "0"))
    heads = lines.select("part").distinct().select(F.lit(-1).cast("long").alias("position"), F.lit(transfers.HEADER).alias("value"), "part")
    path = f"{shared_dir(s)}/tollgate-raw-{uuid.uuid4().hex}"
    lines.unionByName(heads).repartition("part").sortWithinPartitions("part", "position").select("value", "part").write.partitionBy("part").text(path)
    path += "/*"
    return transfers.normalize(transfers.read_raw(s, path)).select("txn_id", "event_time", "event_date", "sender_id", "receiver_id", "amount_paid", "is_laundering")


@query(E + """, r AS (SELECT dense_rank() OVER (ORDER BY ring_id) - 1 AS rid, * FROM t WHERE ring_id IS NOT NULL),
  a AS (SELECT rid, count(DISTINCT x) AS n FROM (SELECT rid, sender_id AS x FROM r UNION ALL SELECT rid, receiver_id FROM r) GROUP BY 1)
  SELECT r.rid AS ring_id, min(typology) AS typology, 'all' AS subtitle, count(*) AS n_txns, min(a.n) AS n_accounts, min(event_time) AS start_time, max(event_time) AS end_time,
  round(epoch(max(event_time) - min(event_time)) / 86400.0, 4) AS duration_days FROM r JOIN a ON a.rid = r.rid GROUP BY 1""")
def pattern_rings(s, d):
    """Write the rings as a pattern file and parse it."""
    rows = _raw(s, d).where("ring_id is not null")
    body = rows.select("ring_id", F.lit(1).alias("kind"), "txn_id", F.concat_ws(",", *[F.col(c).cast("string") for c in rows.columns[:11]]).alias("value"))
    rings = rows.groupBy("ring_id").agg(F.min("typology").alias("typology"))
    none = F.lit(0).cast("long").alias("txn_id")
    begin = rings.select("ring_id", F.lit(0).alias("kind"), none, F.concat(F.lit(f"{transfers.BEGIN} - "), "typology", F.lit(": all")).alias("value"))
    end = rings.select("ring_id", F.lit(2).alias("kind"), none, F.lit(transfers.END).alias("value"))
    path = f"{shared_dir(s)}/tollgate-patterns-{uuid.uuid4().hex}"
    body.unionByName(begin).unionByName(end).orderBy("ring_id", "kind", "txn_id").select("value").write.text(path)
    return transfers.ring_tables(transfers.read_patterns(s, path))["rings"]


@query(E + """, a AS (SELECT sender_id AS account_id FROM t UNION SELECT receiver_id FROM t) SELECT account_id, row_number() OVER (ORDER BY account_id) AS code FROM a""")
def dense_account_codes(s, d):
    return order.account_codes(evts(s, d))


# Labels

_KEYED = """, rt AS (SELECT * FROM t WHERE ring_id IS NOT NULL), k AS (SELECT event_time, sender_id, receiver_id, payment_format, round(amount_paid, 2) AS amt, min(ring_id) AS ring_id,
  min(typology) AS typology, count(DISTINCT ring_id) AS n FROM rt GROUP BY 1, 2, 3, 4, 5),
  l AS (SELECT t.* EXCLUDE (ring_id, typology), k.ring_id, k.typology FROM t LEFT JOIN k ON t.event_time = k.event_time AND t.sender_id = k.sender_id
  AND t.receiver_id = k.receiver_id AND t.payment_format = k.payment_format AND round(t.amount_paid, 2) = k.amt)"""


@query(E + _KEYED + " SELECT txn_id, event_time, sender_id, receiver_id, is_laundering, ring_id, typology FROM l")
def label_content_key_join(s, d):
    e = evts(s, d)
    return labeling.attach_rings(e, e.where("ring_id is not null")).select("txn_id", "event_time", "sender_id", "receiver_id", "is_laundering", "ring_id", "typology")


@query(E + _KEYED + """ SELECT count(*) AS rows, count(*) FILTER (WHERE is_laundering = 1) AS flagged_txns, (SELECT count(*) FROM rt) AS ring_txns_in_patterns_file,
  count(*) FILTER (WHERE is_laundering = 1 AND ring_id IS NOT NULL) AS flagged_with_ring, count(*) FILTER (WHERE is_laundering = 1 AND ring_id IS NULL) AS flagged_without_ring,
  round(100.0 * count(*) FILTER (WHERE is_laundering = 1 AND ring_id IS NOT NULL) / count(*) FILTER (WHERE is_laundering = 1), 2) AS typology_coverage_pct,
  count(*) FILTER (WHERE is_laundering = 0 AND ring_id IS NOT NULL) AS unflagged_but_in_a_ring, (SELECT count(*) FROM rt) - count(ring_id) AS ring_txns_not_found_in_trans,
  (SELECT count(*) FROM k WHERE n > 1) AS ambiguous_content_keys FROM l""")
def label_reconcile_matrix(s, d):
    e = evts(s, d)
    rt = e.where("ring_id is not null")
    return labeling.reconcile(labeling.attach_rings(e, rt), rt)


# Features

_EV = """, ev AS (SELECT txn_id, 's' AS side, sender_id AS a, receiver_id AS cp, event_time AS ts, amount_paid, 1 AS is_out, is_laundering FROM t
  UNION ALL SELECT txn_id, 'r', receiver_id, sender_id, event_time, amount_paid, 0, is_laundering FROM t)"""
_HIST = _EV + f""", f AS (SELECT *, max(ts) OVER (PARTITION BY a, cp ORDER BY ts RANGE BETWEEN UNBOUNDED PRECEDING AND INTERVAL 1 MINUTE PRECEDING) AS pcp FROM ev),
  g AS (SELECT *, CASE WHEN pcp IS NULL THEN 1 ELSE 0 END AS nw FROM f),
  h AS (SELECT txn_id, side, count(*) OVER d1 AS n_1d, count(*) OVER d7 AS n_7d, count(*) OVER d30 AS n_30d, round(avg(amount_paid) OVER d7 + {NUDGE}, 6) AS mean_amt_7d,
   round(stddev_pop(amount_paid) OVER d7 + {NUDGE}, 6) AS std_amt_7d, max(amount_paid) OVER d30 AS max_amt_30d, CAST(coalesce(sum(is_out) OVER d7, 0) AS BIGINT) AS n_out_7d,
   CAST(epoch(ts - max(ts) OVER d30) AS BIGINT) AS secs_since_prev, CAST(epoch(ts - pcp) AS BIGINT) AS secs_since_prev_cp,
   CAST(coalesce(count(*) OVER d7 - sum(is_out) OVER d7, 0) AS BIGINT) AS n_in_7d, round(sum(is_out) OVER d7 / nullif(count(*) OVER d7, 0)::DOUBLE + {NUDGE}, 6) AS out_share_7d,
   CAST(coalesce(sum(nw) OVER d7, 0) AS BIGINT) AS n_new_cp_7d, round(sum(nw) OVER d7 / nullif(count(*) OVER d7, 0)::DOUBLE + {NUDGE}, 6) AS new_cp_rate_7d,
   CAST(coalesce(sum(nw) OVER ever, 0) AS BIGINT) AS n_distinct_cp_ever, avg(amount_paid) OVER d7 AS raw_mean FROM g
   WINDOW d1 AS (PARTITION BY a ORDER BY ts RANGE BETWEEN INTERVAL 1 DAY PRECEDING AND INTERVAL 1 MINUTE PRECEDING),
   d7 AS (PARTITION BY a ORDER BY ts RANGE BETWEEN INTERVAL 7 DAY PRECEDING AND INTERVAL 1 MINUTE PRECEDING),
   d30 AS (PARTITION BY a ORDER BY ts RANGE BETWEEN INTERVAL 30 DAY PRECEDING AND INTERVAL 1 MINUTE PRECEDING),
   ever AS (PARTITION BY a ORDER BY ts RANGE BETWEEN UNBOUNDED PRECEDING AND INTERVAL 1 MINUTE PRECEDING))"""
_CODE = "CAST('0x' || substr(md5({}), 1, 8) AS BIGINT) % 1000"
_TXF = f"""round(ln(1 + amount_paid) + {NUDGE}, 6) AS log_amount_paid, round(ln(1 + amount_received) + {NUDGE}, 6) AS log_amount_received, round(amount_received / nullif(amount_paid, 0) + {NUDGE}, 6) AS fx_ratio,
  CAST(payment_currency <> receiving_currency AS TINYINT) AS currency_mismatch,
  CASE WHEN amount_paid = round(amount_paid, -3) THEN 3 WHEN amount_paid = round(amount_paid, -2) THEN 2 WHEN amount_paid = round(amount_paid, 0) THEN 1 ELSE 0 END AS amount_roundness,
  CAST(hour(event_time) AS INTEGER) AS hour, CAST(dayofweek(event_time) AS INTEGER) AS dayofweek, CAST(dayofweek(event_time) IN (0, 6) AS TINYINT) AS is_weekend,
  CAST(sender_id = receiver_id AS TINYINT) AS is_self_transfer, CAST(sender_bank <> receiver_bank AS TINYINT) AS is_cross_bank,
  {_CODE.format("payment_format")} AS payment_format_code, {_CODE.format("payment_currency")} AS payment_currency_code"""
_BASE = ("n_1d", "n_7d", "n_30d", "mean_amt_7d", "std_amt_7d", "max_amt_30d", "n_out_7d", "secs_since_prev")
_GRAPH = ("n_in_7d", "out_share_7d", "n_new_cp_7d", "new_cp_rate_7d", "n_distinct_cp_ever")


def _hist(s, d, names):
    return steady(history.history(evts(s, d)).select("txn_id", "side", *names))


@query(E + " SELECT txn_id, " + _TXF + " FROM t")
def features_txn_level(s, d):
    e = evts(s, d)
    return steady(e.select("txn_id", *history.transaction_features(e)))


@query(E + _HIST + f" SELECT txn_id, side, {', '.join(_BASE)} FROM h")
def features_history_1d_7d_30d(s, d):
    return _hist(s, d, _BASE)


@query(E + _HIST + " SELECT txn_id, side, secs_since_prev_cp, n_new_cp_7d FROM h")
def features_counterparty(s, d):
    return _hist(s, d, ("secs_since_prev_cp", "n_new_cp_7d"))


@query(E + _HIST + f" SELECT txn_id, side, {', '.join(_GRAPH)} FROM h")
def features_graph(s, d):
    return _hist(s, d, _GRAPH)


_ALL = (*_BASE, "secs_since_prev_cp", *_GRAPH)
_FULL = E + _HIST + f""" SELECT t.txn_id, event_time, event_date, sender_id, receiver_id, is_laundering, ring_id, typology, {_TXF},
  {', '.join(f'h{x}.{c} AS {x}_{c}' for x in 'sr' for c in _ALL)}, round(amount_paid / nullif(hs.raw_mean, 0) + {NUDGE}, 6) AS s_amt_vs_hist, round(amount_paid / nullif(hr.raw_mean, 0) + {NUDGE}, 6) AS r_amt_vs_hist
  FROM t LEFT JOIN h hs ON hs.txn_id = t.txn_id AND hs.side = 's' LEFT JOIN h hr ON hr.txn_id = t.txn_id AND hr.side = 'r'"""


@query(_FULL)
def features_full_row(s, d):
    return steady(history.feature_table(evts(s, d)))


@query(_FULL, "features_hub_chunks")
def _features_hub(s, d):
    """The same table with accounts of more than 100 events cut into time chunks, as those of very long histories are."""
    return steady(history.feature_table(evts(s, d), 30, 100))


# Splits

_R = """, rings AS (SELECT ring_id, min(typology) AS typology, min(event_time) AS st, max(event_time) AS en FROM t WHERE ring_id IS NOT NULL GROUP BY 1),
  ra AS (SELECT DISTINCT ring_id, sender_id AS acct FROM t WHERE ring_id IS NOT NULL UNION SELECT ring_id, receiver_id FROM t WHERE ring_id IS NOT NULL)"""
_SETS = _R + f""", sd AS (SELECT *, st < TIMESTAMP '{CUT}' AS train FROM rings), ta AS (SELECT DISTINCT acct FROM ra JOIN sd USING (ring_id) WHERE train),
  ov AS (SELECT acct FROM ta INTERSECT SELECT acct FROM ra JOIN sd USING (ring_id) WHERE NOT train),
  dr AS (SELECT DISTINCT ring_id FROM ra JOIN sd USING (ring_id) WHERE NOT train AND acct IN (SELECT acct FROM ov))"""


#: Draws of the registered resampling queries.
DRAWS = 1000


def _split(e):
    rings, accounts = splits.rings_of(e), splits.ring_accounts_of(e)
    return e, rings, accounts, splits.ring_sides(rings, accounts, CUT)


@query(E + _SETS + """ SELECT count(*) FILTER (WHERE train) AS train_rings, count(*) FILTER (WHERE NOT train) AS test_rings_raw, (SELECT count(*) FROM dr) AS dropped_rings,
  count(*) FILTER (WHERE NOT train) - (SELECT count(*) FROM dr) AS test_rings, (SELECT count(*) FROM ov) AS overlap_accounts FROM sd""")
def split_ring_sets(s, d):
    _, rings, accounts, _ = _split(evts(s, d))
    return splits.split_sets(rings, accounts, CUT)


@query(E + _SETS + f""" SELECT p AS protocol, part, count(*) AS rows, CAST(sum(is_laundering) AS BIGINT) AS positives, count(DISTINCT ring_id) AS rings FROM (
  SELECT p, CASE WHEN event_time < TIMESTAMP '{CUT}' THEN 'train' ELSE 'test' END AS part, is_laundering, ring_id FROM t, (VALUES ('naive'), ('ring-aware')) v(p)
  WHERE event_time < TIMESTAMP '{CUT}' OR p = 'naive' OR ring_id IS NULL OR ring_id IN (SELECT ring_id FROM sd WHERE NOT train AND ring_id NOT IN (SELECT ring_id FROM dr))) GROUP BY 1, 2""")
def split_naive_vs_ring(s, d):
    e, _, _, sides = _split(evts(s, d))
    both = [splits.split_rows(e, sides, CUT, p).withColumn("protocol", F.lit(p)) for p in splits.PROTOCOLS]
    parts = both[0].unionByName(both[1]).groupBy("protocol", "part")
    return parts.agg(F.count("*").alias("rows"), F.sum("is_laundering").cast("long").alias("positives"), F.count_distinct("ring_id").alias("rings"))


_SWEEP = _R + """, b AS (SELECT min(st) AS lo, datediff('day', min(st), max(st)) - CASE WHEN max(st) - to_days(CAST(datediff('day', min(st), max(st)) AS INTEGER)) < min(st) THEN 1 ELSE 0 END AS days,
   count(DISTINCT typology) AS nt FROM rings),
  c AS (SELECT f AS frac, strftime(lo + to_microseconds(CAST(days * f * 86400000000 AS BIGINT)), '%Y-%m-%d') AS cut FROM b, (VALUES (0.3::DOUBLE), (0.4::DOUBLE), (0.5::DOUBLE), (0.6::DOUBLE), (0.7::DOUBLE), (0.8::DOUBLE)) v(f)),
  x AS (SELECT frac, cut, r.ring_id, st < CAST(cut AS TIMESTAMP) AS train, st < CAST(cut AS TIMESTAMP) AND en >= CAST(cut AS TIMESTAMP) AS strad FROM c, rings r),
  ov AS (SELECT frac, acct FROM x JOIN ra USING (ring_id) GROUP BY 1, 2 HAVING bool_or(train) AND bool_or(NOT train)),
  dr AS (SELECT x.frac, count(DISTINCT x.ring_id) AS n FROM x JOIN ra USING (ring_id) JOIN ov ON ov.frac = x.frac AND ov.acct = ra.acct WHERE NOT train GROUP BY 1)
  SELECT x.frac, x.cut, count(*) FILTER (WHERE train) AS train_rings, count(*) FILTER (WHERE NOT train) AS test_rings_raw, count(*) FILTER (WHERE strad) AS straddling,
  coalesce((SELECT count(*) FROM ov WHERE ov.frac = x.frac), 0) AS overlap_accounts, coalesce((SELECT n FROM dr WHERE dr.frac = x.frac), 0) AS dropped,
  count(*) FILTER (WHERE NOT train) - coalesce((SELECT n FROM dr WHERE dr.frac = x.frac), 0) AS test_rings_kept,
  CAST(round_even((count(*) FILTER (WHERE NOT train) - coalesce((SELECT n FROM dr WHERE dr.frac = x.frac), 0)) / (SELECT nt FROM b), 0) AS BIGINT) AS per_typology FROM x GROUP BY 1, 2"""


@query(E + _SWEEP)
def split_sweep(s, d):
    _, rings, accounts, _ = _split(evts(s, d))
    return splits.sweep(rings, accounts)


@query(E + _SETS + f""", te AS (SELECT * FROM t WHERE event_time >= TIMESTAMP '{CUT}' AND (ring_id IS NULL OR ring_id IN (SELECT ring_id FROM sd WHERE NOT train AND ring_id NOT IN (SELECT ring_id FROM dr)))),
  g AS (SELECT acct, d, max(y) AS y, max(u) AS u FROM (SELECT sender_id AS acct, event_date AS d, is_laundering AS y, CASE WHEN ring_id IS NULL THEN 1 ELSE 0 END AS u FROM te
  UNION ALL SELECT receiver_id, event_date, is_laundering, CASE WHEN ring_id IS NULL THEN 1 ELSE 0 END FROM te) GROUP BY 1, 2)
  SELECT count(*) AS test_total_account_days, count(*) FILTER (WHERE y = 1) AS test_positive_account_days,
  count(*) FILTER (WHERE y = 1 AND u = 1 AND acct IN (SELECT acct FROM ta)) AS unlabeled_positive_acct_days_touching_train_rings FROM g""")
def split_optb_sensitivity(s, d):
    e, _, accounts, sides = _split(evts(s, d))
    return splits.option_b(splits.split_rows(e, sides, CUT).where("part = 'test'"), accounts, sides)


_B = "CAST('0x' || substr(md5(CAST({} AS VARCHAR)), 1, 8) AS BIGINT) % 10000"


@query(E + f" SELECT txn_id, ring_id FROM t WHERE event_time < TIMESTAMP '{CUT}' AND CASE WHEN ring_id IS NULL THEN {_B.format('txn_id')} ELSE {_B.format('ring_id')} END < 2500")
def split_ring_aware_sample(s, d):
    return splits.train_sample(evts(s, d).where(f"event_time < timestamp_ntz'{CUT}'"), 0.25).select("txn_id", "ring_id")


# Alerts and metrics

@query(T + AD + f" SELECT day, acct, {r9('score AS score')}, y, {r9('other_max AS other_max')} FROM ad")
def account_days(s, d):
    return alerts.account_days(txns(s, d))


@query(T + MEM + " SELECT * FROM mem")
def ring_membership(s, d):
    return alerts.membership(txns(s, d))


@query(T + AD + RK + " SELECT day, acct, CAST(r1 AS INTEGER) AS rank_first, CAST(r2 AS INTEGER) AS rank_min, r3 AS rank_max FROM rk")
def ranks_three_ties(s, d):
    return alerts.ranked(alerts.account_days(txns(s, d))).select("day", "acct", "rank_first", "rank_min", "rank_max")


_METRICS = RK + """, p AS (SELECT day, sum(y) AS p FROM ad GROUP BY 1), tot AS (SELECT k, CAST(sum(p) AS BIGINT) AS total_pos, CAST(sum(least(p, k)) AS BIGINT) AS ceiling_count FROM p, ks GROUP BY 1),
  m AS (SELECT k, count(*) FILTER (WHERE r1 <= k) AS n_alerts, count(*) FILTER (WHERE r1 <= k AND y = 1) AS caught, count(*) FILTER (WHERE r2 <= k AND r3 > k) AS tied_at_boundary,
  count(*) FILTER (WHERE r2 <= k AND y = 1) AS opt, count(*) FILTER (WHERE r3 <= k AND y = 1) AS pess FROM rk, ks GROUP BY 1)"""


@query(T + AD + ks(SMALL) + _METRICS + " SELECT k, n_alerts, caught, total_pos, ceiling_count, " + r9(
    "caught / total_pos::DOUBLE AS recall", "ceiling_count / total_pos::DOUBLE AS recall_ceiling", "caught / ceiling_count::DOUBLE AS recall_efficiency", "caught / n_alerts::DOUBLE AS precision",
    "n_alerts / nullif(caught, 0)::DOUBLE AS alerts_per_true_positive", "opt / total_pos::DOUBLE AS recall_tie_optimistic", "pess / total_pos::DOUBLE AS recall_tie_pessimistic",
) + ", tied_at_boundary FROM m JOIN tot USING (k)")
def budget_metrics(s, d):
    return alerts.budget_metrics(alerts.account_days(txns(s, d)), SMALL)


@query(T + AD + " SELECT day, n, positives, least(positives, 5) AS attainable FROM (SELECT day, count(*) AS n, CAST(sum(y) AS BIGINT) AS positives FROM ad GROUP BY 1)")
def recall_ceiling_by_day(s, d):
    return alerts.per_day(alerts.account_days(txns(s, d))).withColumn("attainable", F.least("positives", F.lit(5).cast("long")))


# Coarse scores, so that ties straddle the budgets.
_COARSE = "WITH t AS (SELECT * REPLACE (floor(score / 20000) AS score) FROM (" + adapters.TXNS + "))"


@query(_COARSE + AD + ks(SMALL) + _METRICS + " SELECT k, tied_at_boundary, " + r9("opt / total_pos::DOUBLE AS recall_tie_optimistic", "caught / total_pos::DOUBLE AS recall", "pess / total_pos::DOUBLE AS recall_tie_pessimistic") + " FROM m JOIN tot USING (k)")
def tie_bracket(s, d):
    coarse = txns(s, d).withColumn("score", F.floor(F.col("score") / 20000).cast("double"))
    return alerts.budget_metrics(alerts.account_days(coarse), SMALL).select("k", "tied_at_boundary", "recall_tie_optimistic", "recall", "recall_tie_pessimistic")


_RING = MEM + RK + """, mr AS (SELECT k, mem.ring_id, mem.day, mem.acct, CASE WHEN r1 <= k THEN 1 ELSE 0 END AS hit FROM mem JOIN rk ON rk.day = mem.day AND rk.acct = mem.acct, ks),
  rg AS (SELECT k, ring_id, max(hit) AS hit, count(*) AS size FROM mr GROUP BY 1, 2), un AS (SELECT k, count(*) AS n, avg(hit) AS er FROM (SELECT DISTINCT k, day, acct, hit FROM mr) GROUP BY 1)"""


_POOLED = "avg(1 - pow(1 - rec, size))"
_RING_ROWS = f"""SELECT k, un.n AS n_ring_account_days, er AS ring_eligible_recall, count(*) AS n_rings, avg(hit) AS ring_recall, quantile_cont(size, 0.5) AS ring_size_median, quantile_cont(size, 0.9) AS ring_size_p90,
  avg(1 - pow(1 - er, size)) AS ring_recall_null_analytic, {_POOLED} AS ring_recall_null_analytic_pooled, round(avg(hit) / nullif({_POOLED}, 0), 3) AS ring_recall_lift_analytic_pooled
  FROM rg JOIN un USING (k) JOIN (SELECT k, caught / total_pos::DOUBLE AS rec FROM m JOIN tot USING (k)) USING (k) GROUP BY 1, 2, 3"""


@query(T + AD + ks(SMALL) + _METRICS.replace(RK, _RING) + f", rr AS ({_RING_ROWS}) SELECT * REPLACE (" + ", ".join(
    f"round({c}, 9) AS {c}" for c in ("ring_eligible_recall", "ring_recall", "ring_size_p90", "ring_recall_null_analytic", "ring_recall_null_analytic_pooled")) + ") FROM rr")
def ring_recall(s, d):
    t = txns(s, d)
    return alerts.ring_recall(alerts.account_days(t), alerts.membership(t), SMALL)


@query(T + AD + ks((5,)) + _RING + """, ty AS (SELECT ring_id, min(typology) AS typology FROM t WHERE ring_id IS NOT NULL GROUP BY 1)
  SELECT typology, count(*) AS n_rings, round(avg(hit), 9) AS ring_recall FROM rg JOIN ty USING (ring_id) GROUP BY 1""")
def ring_recall_by_typology(s, d):
    t = txns(s, d)
    return alerts.ring_recall_by_typology(t, alerts.account_days(t), 5)


_STEP = """, hs AS (SELECT {g}score, count(*) AS n, sum(is_laundering) AS p FROM {t} GROUP BY ALL),
  c AS (SELECT {g}n, p, sum(n) OVER w AS cn, sum(p) OVER w AS cp, sum(p) OVER ({all}) AS tp, sum(n) OVER ({all}) AS tn FROM hs WINDOW w AS ({part}ORDER BY score DESC ROWS UNBOUNDED PRECEDING))"""
_ONE = _STEP.format(g="", t="t", part="", all="")


@query(T + _ONE + " SELECT round(sum(p / tp::DOUBLE * (cp / cn::DOUBLE)), 9) AS average_precision__txn FROM c")
def average_precision(s, d):
    return alerts.average_precision(txns(s, d)).select("average_precision__txn")


@query(T + _ONE + " SELECT round(sum((n - p)::DOUBLE * (cp - p + p / 2.0::DOUBLE) / (tp::DOUBLE * (tn - tp))), 9) AS roc_auc_footnote_only__txn FROM c")
def roc_auc(s, d):
    return alerts.average_precision(txns(s, d)).select("roc_auc_footnote_only__txn")


@query(T + AD + MEM + """ SELECT round((SELECT 100.0 * avg(CASE WHEN NOT EXISTS (SELECT 1 FROM mem WHERE mem.day = ad.day AND mem.acct = ad.acct) THEN 1 ELSE 0 END) FROM ad WHERE y = 1), 2) AS pct_positive_acct_days_without_ring,
  round((SELECT 100.0 * avg(CASE WHEN ring_id IS NULL THEN 0 ELSE 1 END) FROM t WHERE is_laundering = 1), 2) AS typology_coverage_pct__txn""")
def coverage(s, d):
    t = txns(s, d)
    return alerts.coverage(t, alerts.account_days(t))


def _long(table: str, unit: str, k: str = "NULL", **cells: str) -> list[str]:
    return [f"SELECT '{n}' AS metric, CAST({k} AS INTEGER) AS k, round(CAST({e} AS DOUBLE), 9) AS value, '{unit}' AS alert_unit FROM {table}" for n, e in cells.items()]


_same = lambda *names: {n: n for n in names}
_EVAL = [
    *_long("ad", "account-day", n_account_days="count(*)", n_positive_account_days="sum(y)"),
    *_long("c", "transaction", average_precision__txn="sum(p / tp::DOUBLE * (cp / cn::DOUBLE))", roc_auc_footnote_only__txn="sum((n - p)::DOUBLE * (cp - p + p / 2.0::DOUBLE) / (tp::DOUBLE * (tn - tp)))"),
    *_long("ad", "mixed", pct_positive_acct_days_without_ring="round(100.0 * avg(CASE WHEN y = 1 THEN CASE WHEN NOT EXISTS (SELECT 1 FROM mem WHERE mem.day = ad.day AND mem.acct = ad.acct) THEN 1 ELSE 0 END END), 2)"),
    *_long("t", "mixed", typology_coverage_pct__txn="round(100.0 * avg(CASE WHEN is_laundering = 1 THEN CASE WHEN ring_id IS NULL THEN 0 ELSE 1 END END), 2)"),
    *_long("m JOIN tot USING (k)", "account-day", "k", **_same("n_alerts", "caught", "total_pos", "ceiling_count", "tied_at_boundary"), recall="caught / total_pos::DOUBLE", recall_ceiling="ceiling_count / total_pos::DOUBLE",
           recall_efficiency="caught / ceiling_count::DOUBLE", precision="caught / n_alerts::DOUBLE", alerts_per_true_positive="n_alerts / nullif(caught, 0)::DOUBLE", recall_tie_optimistic="opt / total_pos::DOUBLE",
           recall_tie_pessimistic="pess / total_pos::DOUBLE"),
    *_long("rr", "ring", "k", **_same("n_ring_account_days", "ring_eligible_recall", "n_rings", "ring_recall", "ring_size_median", "ring_size_p90", "ring_recall_null_analytic", "ring_recall_null_analytic_pooled", "ring_recall_lift_analytic_pooled")),
]


@query(T + AD + ks(SMALL) + _METRICS.replace(RK, _RING) + f", rr AS ({_RING_ROWS})" + _ONE + " " + " UNION ALL ".join(_EVAL))
def evaluation(s, d):
    return alerts.evaluation(txns(s, d), SMALL)


# Nulls

_POP = T + AD + ", p AS (SELECT day, sum(y) AS p, count(*) AS n FROM ad GROUP BY 1), pop AS (SELECT day, p AS n_positive, greatest(p, n - n // 4) AS lo, n AS hi, day < DATE '" + BOUNDARY + "' AS head FROM p)"


def _pop(s, d):
    per = alerts.per_day(alerts.account_days(txns(s, d)))
    return per.select("day", F.col("positives").alias("n_positive"), F.greatest(F.col("positives"), F.col("n") - F.floor(F.col("n") / 4)).alias("n_d_low"), F.col("n").alias("n_d_high"))


def _bound(tag: str, col: str) -> str:
    cell = lambda on, label: f"round(sum(CASE WHEN {on} THEN least(k, {col}) * (n_positive / {col}::DOUBLE) END) / sum(CASE WHEN {on} THEN least(k, {col}) END), 5) AS null_precision_{tag}{label}"
    q = f"least(greatest(n_positive / {col}::DOUBLE, 0), 1)"
    sd = f"round(sqrt(sum(least(k, {col}) * {q} * (1 - {q}) * CASE WHEN {col} > 1 THEN ({col} - least(k, {col})) / ({col} - 1)::DOUBLE ELSE 0 END)) / sum(least(k, {col})), 6) AS null_precision_{tag}_sd"
    return ", ".join([cell("true", ""), cell("head", "_head"), cell("NOT head", "_tail"), sd])


@query(_POP + ks((5, 25)) + f""" SELECT k, count(*) AS days, count(*) FILTER (WHERE head) AS head_days, {_bound('high', 'lo')}, {_bound('low', 'hi')}, CAST(sum(least(k, hi)) AS BIGINT) AS alert_slots,
  CAST(sum(least(k, n_positive)) AS BIGINT) AS ceiling_count, CAST(sum(CASE WHEN n_positive > k THEN k ELSE 0 END) AS BIGINT) AS ceiling_budget_limited,
  CAST(sum(CASE WHEN n_positive <= k THEN n_positive ELSE 0 END) AS BIGINT) AS ceiling_positive_limited, count(*) FILTER (WHERE hi <= k) AS nonbinding_days FROM pop, ks GROUP BY 1""")
def hypergeom_null(s, d):
    return nulls.hypergeometric(_pop(s, d), BOUNDARY, (5, 25))


_BUNDLE = AD + MEM + RK + ", top AS (SELECT rk.day, rk.acct, score, other_max, y, CAST(r1 AS INTEGER) AS rank FROM rk LEFT JOIN (SELECT DISTINCT day, acct FROM mem) m ON m.day = rk.day AND m.acct = rk.acct WHERE r1 <= {cap} OR m.acct IS NOT NULL), pos AS (SELECT day, count(*) AS n FROM ad WHERE y = 1 GROUP BY 1)"


def _bundle(s, d, cap):
    return replay.build(txns(s, d), cap)


@query(T + _BUNDLE.format(cap=30) + ks((5, 25)) + """, mx AS (SELECT top.day, max(rank) AS mx, max(coalesce(pos.n, 0)) AS p FROM top LEFT JOIN pos USING (day) GROUP BY 1),
  al AS (SELECT k, count(*) AS alerts FROM top, ks WHERE rank <= k GROUP BY 1)
  SELECT k, count(*) AS n_days, count(*) FILTER (WHERE mx <= k) AS nonbinding_days, count(*) FILTER (WHERE mx < 30) AS days_provably_written_in_full, count(*) FILTER (WHERE mx >= 30) AS days_truncated_at_the_cap,
  round(count(*) FILTER (WHERE mx <= k) / count(*)::DOUBLE, 5) AS nonbinding_day_share, round(coalesce(sum(mx) FILTER (WHERE mx <= k), 0) / min(alerts)::DOUBLE, 5) AS nonbinding_alert_share,
  round(coalesce(sum(p) FILTER (WHERE mx <= k), 0) / sum(p)::DOUBLE, 5) AS nonbinding_positive_share FROM mx, ks JOIN al USING (k) GROUP BY 1""")
def nonbinding_days(s, d):
    b = _bundle(s, d, 30)
    return nulls.nonbinding(b["account_days_topk"], b["per_day_positives"].withColumnRenamed("positive_account_days", "n_positive"), 30, (5, 25, 50))


@query(T + _BUNDLE.format(cap=20) + f""", mx AS (SELECT day, max(rank) AS mx FROM top GROUP BY 1), raw AS (SELECT day, count(*) AS raw FROM ad GROUP BY 1)
  SELECT mx.day, coalesce(pos.n, 0) AS n_positive, CAST(CASE WHEN mx < 20 THEN mx ELSE greatest(mx, coalesce(pos.n, 0), raw - raw % 5) END AS BIGINT) AS n_d_low,
  CAST(CASE WHEN mx < 20 THEN mx ELSE raw END AS BIGINT) AS n_d_high, mx < 20 AS exact FROM mx LEFT JOIN pos USING (day) JOIN raw USING (day)""")
def population_bounds(s, d):
    b, raw = _bundle(s, d, 20), diagnostics.raw_account_days(txns(s, d))
    removed = raw.select("day", (F.col("raw") % 5).alias("removed"))
    return nulls.population_bounds(b["account_days_topk"], b["per_day_positives"].withColumnRenamed("positive_account_days", "n_positive"), raw, removed, 20)


_CLUSTER = AD + MEM + """, pm AS (SELECT 'a:' || strftime(mem.day, '%Y-%m-%d') || '|' || mem.acct AS n, mem.day, mem.acct, ring_id FROM mem JOIN ad ON ad.day = mem.day AND ad.acct = mem.acct WHERE y = 1),
  reach AS (SELECT DISTINCT ring_id AS a, ring_id AS b FROM pm UNION SELECT r.a, q.ring_id FROM reach r JOIN pm p ON p.ring_id = r.b JOIN pm q ON q.n = p.n),
  lab AS (SELECT r.a AS ring_id, min(p.n) AS cluster FROM reach r JOIN pm p ON p.ring_id = r.b GROUP BY 1),
  cl AS (SELECT ad.day, ad.acct, coalesce(min(lab.cluster), 'a:' || strftime(ad.day, '%Y-%m-%d') || '|' || ad.acct) AS cluster FROM ad LEFT JOIN pm ON pm.day = ad.day AND pm.acct = ad.acct LEFT JOIN lab ON lab.ring_id = pm.ring_id
   WHERE y = 1 GROUP BY ad.day, ad.acct)"""
_E_R = E.replace("WITH", "WITH RECURSIVE", 1)


@query(_E_R + _CLUSTER + " SELECT day, acct, cluster FROM cl")
def ring_components(s, d):
    e = evts(s, d)
    return nulls.clusters(alerts.account_days(e), alerts.membership(e))


_POISSON = " + ".join(f"CASE WHEN u >= {c} THEN 1 ELSE 0 END" for c in nulls.POISSON)
_BOOT = _CLUSTER + ks(BUDGETS) + RK + f""", tb AS (SELECT cluster, k, count(*) AS total, count(*) FILTER (WHERE r1 <= k) AS caught FROM cl JOIN rk ON rk.day = cl.day AND rk.acct = cl.acct, ks GROUP BY 1, 2),
  w AS (SELECT draw, k, total, caught, {_POISSON} AS w FROM (SELECT *, CAST('0x' || substr(md5('0|' || draw || '|' || cluster), 1, 8) AS BIGINT) % 100000000 / 100000000.0::DOUBLE AS u FROM tb, (SELECT unnest(range(1, {DRAWS + 1})) AS draw))),
  bs AS (SELECT draw, k, sum(w * caught) / nullif(sum(w * total), 0)::DOUBLE AS recall FROM w GROUP BY 1, 2)"""


@query(_E_R + _BOOT + " SELECT k, round(quantile_cont(recall, 0.025), 9) AS ci_lo, round(quantile_cont(recall, 0.975), 9) AS ci_hi, count(*) AS n_bootstrap FROM bs GROUP BY 1")
def bootstrap_ci(s, d):
    e = evts(s, d)
    return nulls.bootstrap_ci(alerts.account_days(e), alerts.membership(e), BUDGETS, DRAWS)


_PERM = (
    E + AD + MEM + ks(BUDGETS) + f""", tx AS (SELECT event_date AS day, txn_id AS rt, score, row_number() OVER (PARTITION BY event_date ORDER BY txn_id) AS place FROM t WHERE ring_id IS NOT NULL),
  mx AS (SELECT draw, day, rt, row_number() OVER (PARTITION BY draw, day ORDER BY md5('0|' || draw || '|' || rt), rt) AS place FROM tx, (SELECT unnest(range(1, {DRAWS + 1})) AS draw)),
  de AS (SELECT mx.draw, mx.day, mx.rt, tx.score FROM mx JOIN tx ON tx.day = mx.day AND tx.place = mx.place UNION ALL SELECT 0, day, rt, score FROM tx),
  ep AS (SELECT DISTINCT event_date AS day, sender_id AS acct, txn_id AS rt FROM t WHERE ring_id IS NOT NULL UNION SELECT event_date, receiver_id, txn_id FROM t WHERE ring_id IS NOT NULL),
  el AS (SELECT draw, ep.day, ep.acct, max(de.score) AS s FROM ep JOIN de ON de.day = ep.day AND de.rt = ep.rt GROUP BY 1, 2, 3),
  al AS (SELECT el.draw, el.day, el.acct, greatest(el.s, coalesce(ad.other_max, el.s)) AS score FROM el JOIN ad ON ad.day = el.day AND ad.acct = el.acct
   UNION ALL SELECT dr.draw, ad.day, ad.acct, ad.score FROM ad, (SELECT unnest(range(0, {DRAWS + 1})) AS draw) dr WHERE NOT EXISTS (SELECT 1 FROM ep WHERE ep.day = ad.day AND ep.acct = ad.acct)),
  rr AS (SELECT draw, day, acct, rank() OVER (PARTITION BY draw, day ORDER BY score DESC) AS r FROM al),
  br AS (SELECT draw, ring_id, min(r) AS r FROM rr JOIN mem ON mem.day = rr.day AND mem.acct = rr.acct GROUP BY 1, 2),
  pd AS (SELECT CAST(draw AS INTEGER) AS draw, k, avg(CASE WHEN r <= k THEN 1 ELSE 0 END) AS ring_recall FROM br, ks GROUP BY 1, 2)"""
)


def _alone(s, make, tag):
    """The few rows of ``make()``, written; the tables on their way are deleted, so that no later query finds them on the disk."""
    with Scope(s) as scope:
        out = materialize(make(), tag)
    scope.release(out.inputFiles())
    return out


def _draws(s, d):
    return _alone(s, lambda: nulls.permutation_draws(evts(s, d), BUDGETS, DRAWS), "draws")


@query(_PERM + " SELECT draw, k, round(ring_recall, 9) AS ring_recall FROM pd")
def permutation_null(s, d):
    return _draws(s, d)


@query(_PERM + """, o AS (SELECT k, ring_recall AS seen FROM pd WHERE draw = 0),
  g AS (SELECT k, seen, avg(ring_recall) AS m, quantile_cont(ring_recall, 0.025) AS lo, quantile_cont(ring_recall, 0.975) AS hi, count(*) AS b, count(*) FILTER (WHERE ring_recall >= seen) AS up, count(*) FILTER (WHERE ring_recall <= seen) AS dn
   FROM pd JOIN o USING (k) WHERE draw > 0 GROUP BY 1, 2)
  SELECT k, round(seen, 9) AS ring_recall_minrank, round(m, 9) AS ring_recall_null, round(lo, 9) AS null_lo, round(hi, 9) AS null_hi, round(seen / nullif(m, 0), 3) AS lift, round(seen / nullif(m, 0), 3) AS ring_coverage_concentration,
  round((up + 1) / (b + 1)::DOUBLE, 9) AS p, round((dn + 1) / (b + 1)::DOUBLE, 9) AS p_lower, round(least(1, 2 * least((up + 1) / (b + 1)::DOUBLE, (dn + 1) / (b + 1)::DOUBLE)), 9) AS p_two_sided, b AS permutations, round(1 / (b + 1)::DOUBLE, 9) AS p_resolution FROM g""")
def permutation_summary(s, d):
    return nulls.permutation_summary(_draws(s, d))


@query(_PERM + """, ty AS (SELECT ring_id, min(typology) AS typology FROM t WHERE ring_id IS NOT NULL GROUP BY 1), q AS (SELECT draw, typology, avg(CASE WHEN r <= 25 THEN 1 ELSE 0 END) AS x FROM br JOIN ty USING (ring_id) GROUP BY 1, 2)
  SELECT CAST(draw AS INTEGER) AS draw, round(max(x) - min(x), 9) AS spread FROM q GROUP BY 1""")
def typology_spread_null(s, d):
    return _alone(s, lambda: nulls.typology_spread(evts(s, d), 25, DRAWS), "spread")


_RATES = """, ty AS (SELECT ring_id, min(typology) AS typology FROM t WHERE ring_id IS NOT NULL GROUP BY 1), ra_ AS (SELECT draw, typology, avg(CASE WHEN r <= 25 THEN 1 ELSE 0 END) AS x FROM br JOIN ty USING (ring_id) GROUP BY 1, 2),
  sh AS (SELECT typology, x AS obs FROM ra_ WHERE draw = 0), nl AS (SELECT typology, avg(x) AS nul, quantile_cont(x, 0.025) AS lo, quantile_cont(x, 0.975) AS hi, count(*) AS b FROM ra_ WHERE draw > 0 GROUP BY 1),
  fr AS (SELECT ra_.typology, count(*) FILTER (WHERE abs(x / nullif(nul, 0) - 1) >= abs(obs / nullif(nul, 0) - 1)) AS far FROM ra_ JOIN sh USING (typology) JOIN nl USING (typology) WHERE draw > 0 GROUP BY 1),
  sp AS (SELECT typology, obs, nul, lo, hi, b, far, (1 + far) / (b + 1)::DOUBLE AS p FROM sh JOIN nl USING (typology) JOIN fr USING (typology)),
  hm AS (SELECT typology, least(1.0, max((m - i + 1) * p) OVER (ORDER BY i)) AS p_holm FROM (SELECT *, row_number() OVER (ORDER BY p, typology) AS i, count(*) OVER () AS m FROM sp))"""


def _rates(s, d):
    return _alone(s, lambda: nulls.typology_rates(evts(s, d), 25, DRAWS), "rates")


@query(_PERM + _RATES + """, q AS (SELECT draw, max(x) / nullif(min(x), 0)::DOUBLE AS r FROM ra_ GROUP BY 1), o AS (SELECT r AS seen FROM q WHERE draw = 0)
  SELECT round(seen, 9) AS observed_spread, round(quantile_cont(r, 0.5), 9) AS null_spread_median, round(quantile_cont(r, 0.95), 9) AS null_spread_p95, count(*) AS draws,
  round((1 + count(*) FILTER (WHERE r IS NULL OR r >= seen)) / (count(*) + 1)::DOUBLE, 9) AS p_value, round(100.0 * count(*) FILTER (WHERE r < seen) / count(*)::DOUBLE, 9) AS observed_percentile FROM q, o WHERE draw > 0 GROUP BY seen""")
def typology_spread_ratio(s, d):
    return nulls.typology_spread_ratio(_rates(s, d))


@query(_PERM + _RATES + """ SELECT typology, round(obs, 9) AS observed, round(nul, 9) AS null, round(obs / nullif(nul, 0), 9) AS concentration, round(obs / nullif(hi, 0), 9) AS ci_lo, round(obs / nullif(lo, 0), 9) AS ci_hi,
  obs / nullif(hi, 0) > 1 OR obs / nullif(lo, 0) < 1 AS ci95_excludes_1, round(p, 9) AS p, far AS n_draws_at_or_beyond, round(sqrt(p * (1 - p) / b), 9) AS p_mc_se, b AS draws, round(p_holm, 9) AS p_holm FROM sp JOIN hm USING (typology)""")
def typology_concentration(s, d):
    return nulls.typology_concentration(_rates(s, d))


@query(_PERM + _RATES + """, g AS (SELECT count(*) AS n_tests, min(p) AS p, max(b) AS b, min(p_holm) AS ph, count(*) FILTER (WHERE p_holm < 0.05) AS n_significant FROM sp JOIN hm USING (typology)),
  h AS (SELECT *, greatest(0, least(1, (p - 1.96 * sqrt(p * (1 - p) / b)) * n_tests)) AS lo, greatest(0, least(1, (p + 1.96 * sqrt(p * (1 - p) / b)) * n_tests)) AS hi, 0.05::DOUBLE / n_tests - p AS gap FROM g)
  SELECT n_tests, n_significant, round(ph, 9) AS smallest_p_holm, round(lo, 9) AS mc_lo, round(hi, 9) AS mc_hi, round(n_tests / (b + 1)::DOUBLE, 9) AS smallest_p_holm_attainable, hi < 0.05 OR lo > 0.05 AS resolved,
  CASE WHEN NOT (hi < 0.05 OR lo > 0.05) AND gap > 0 THEN CAST(floor(1.96 * 1.96 * p * (1 - p) / (gap * gap)) AS BIGINT) + 1 END AS draws_needed FROM h""")
def holm_resolution(s, d):
    return nulls.holm_resolution(nulls.typology_concentration(_rates(s, d)))


_P8 = ", ".join(f"('{n}', {p})" for n, p in (("a", 0.01), ("b", 0.04), ("c", 0.03), ("d", 0.005), ("e", 0.6), ("f", 0.04), ("g", 0.9), ("h", 0.2)))


@query(f"""WITH p(name, p) AS (VALUES {_P8}), q AS (SELECT name, CAST(p AS DOUBLE) AS p, row_number() OVER (ORDER BY p, name) AS i, count(*) OVER () AS m FROM p)
  SELECT name, p, round(least(1.0, max((m - i + 1) * p) OVER (ORDER BY i)), 9) AS p_holm FROM q""")
def holm_adjust(s, d):
    return nulls.holm(s.sql(f"SELECT name, CAST(p AS DOUBLE) AS p FROM VALUES {_P8} AS v(name, p)"))


@query(E + """ SELECT count(*) FILTER (WHERE score >= 700 AND NOT amount_paid >= 50) AS only_a, count(*) FILTER (WHERE NOT score >= 700 AND amount_paid >= 50) AS only_b,
  count(*) FILTER (WHERE score >= 700 AND amount_paid >= 50) AS both, count(*) FILTER (WHERE NOT score >= 700 AND NOT amount_paid >= 50) AS neither FROM t WHERE is_laundering = 1""")
def mcnemar_discordant(s, d):
    return nulls.discordant(evts(s, d), F.col("score") >= 700, F.col("amount_paid") >= 50)


_TYPE = "payment_format"


@query(E + """, c AS (SELECT payment_format AS a, is_laundering AS b, count(*) AS n FROM t GROUP BY 1, 2), g AS (SELECT sum(n) AS n FROM c), ra AS (SELECT a, sum(n) AS r FROM c GROUP BY 1), cb AS (SELECT b, sum(n) AS r FROM c GROUP BY 1),
  x AS (SELECT sum(pow(coalesce(c.n, 0) - ra.r * cb.r / g.n::DOUBLE, 2) / (ra.r * cb.r / g.n::DOUBLE)) AS chi2 FROM ra, cb, g LEFT JOIN c ON c.a = ra.a AND c.b = cb.b)
  SELECT round(chi2, 6) AS chi2, round(sqrt(chi2 / ((SELECT n FROM g) * (least((SELECT count(*) FROM ra), (SELECT count(*) FROM cb)) - 1))), 9) AS cramers_v FROM x""")
def cramers_v(s, d):
    c = evts(s, d).groupBy(F.col("payment_format").alias("a"), F.col("is_laundering").alias("b")).agg(F.count("*").alias("n"))
    rows, cols = c.groupBy("a").agg(F.sum("n").alias("ra")), c.groupBy("b").agg(F.sum("n").alias("cb"))
    total = c.agg(F.sum("n").alias("total"))
    grid = rows.crossJoin(cols).crossJoin(total).join(c, ["a", "b"], "left").na.fill(0, ["n"])  # formats x 2
    want = F.col("ra") * F.col("cb") / F.col("total")
    got = grid.agg(F.sum(F.pow(F.col("n") - want, 2) / want).alias("chi2"), F.max("total").alias("total"), F.count_distinct("a").alias("na"), F.count_distinct("b").alias("nb"))
    return got.select(F.round("chi2", 6).alias("chi2"), F.sqrt(F.col("chi2") / (F.col("total") * (F.least("na", "nb") - 1))).alias("cramers_v"))


_CF = E + """, kept AS (SELECT txn_id, is_laundering, score FROM t WHERE event_id_ok), ex AS (SELECT txn_id, is_laundering, score FROM t WHERE NOT event_id_ok AND is_laundering = 1)"""
_CF = _CF.replace("event_id_ok", "(ring_id IS NULL OR ring_id % 2 = 0)") + """, kp AS (SELECT row_number() OVER (ORDER BY md5(CAST(txn_id AS VARCHAR)), txn_id) - 1 AS at, score AS new FROM kept WHERE is_laundering = 1), n AS (SELECT count(*) AS n FROM kp),
  mv AS (SELECT draw, txn_id, CAST('0x' || substr(md5('0|' || draw || '|' || txn_id), 1, 8) AS BIGINT) % n AS pick FROM ex, n, (SELECT unnest(range(1, DRAWS_END)) AS draw)),
  al AS (SELECT draw, is_laundering, score FROM kept, (SELECT unnest(range(0, DRAWS_END)) AS draw) UNION ALL SELECT mv.draw, 1, kp.new FROM mv JOIN kp ON kp.at = mv.pick UNION ALL SELECT 0, 1, score FROM ex)""" + _STEP.format(g="draw, ", t="al", part="PARTITION BY draw ", all="PARTITION BY draw")
_CF = _CF.replace("DRAWS_END", str(DRAWS + 1))


@query(_CF + " SELECT CAST(draw AS INTEGER) AS draw, round(sum(p / tp::DOUBLE * (cp / cn::DOUBLE)), 9) AS ap FROM c GROUP BY 1")
def counterfactual_ap(s, d):
    e = evts(s, d).select("txn_id", "is_laundering", "score", "ring_id")
    ok = F.col("ring_id").isNull() | (F.col("ring_id") % 2 == 0)
    return nulls.counterfactual(e.where(~ok), e.where(ok), DRAWS)


@query(_CF + """, ap AS (SELECT draw, sum(p / tp::DOUBLE * (cp / cn::DOUBLE)) AS ap FROM c GROUP BY 1), ro AS (SELECT score, count(*) AS n, sum(is_laundering) AS p FROM kept GROUP BY 1),
  rc AS (SELECT p, sum(n) OVER w AS cn, sum(p) OVER w AS cp, sum(p) OVER () AS tp FROM ro WINDOW w AS (ORDER BY score DESC ROWS UNBOUNDED PRECEDING)),
  f AS (SELECT (SELECT sum(p / tp::DOUBLE * (cp / cn::DOUBLE)) FROM rc) AS ring, max(ap) FILTER (WHERE draw = 0) AS naive, avg(ap) FILTER (WHERE draw > 0) AS cf, quantile_cont(ap, 0.025) FILTER (WHERE draw > 0) AS lo,
   quantile_cont(ap, 0.975) FILTER (WHERE draw > 0) AS hi, count(*) FILTER (WHERE draw > 0) AS draws, (SELECT count(*) FROM t WHERE NOT (ring_id IS NULL OR ring_id % 2 = 0)) AS nx FROM ap)
  SELECT round(ring, 9) AS ap_ring_aware, round(naive, 9) AS ap_naive_actual, round(cf, 9) AS ap_naive_counterfactual_mean, round(lo, 9) AS ap_naive_counterfactual_lo, round(hi, 9) AS ap_naive_counterfactual_hi, draws, nx AS n_excluded,
  (SELECT count(*) FROM ex) AS n_excluded_positives, (SELECT count(*) FROM kp) AS n_retained_positives, round(naive - ring, 9) AS total_gap, round(cf - ring, 9) AS composition_contrast, round(naive - cf, 9) AS score_distribution_contrast,
  round((cf - ring) / nullif(naive - ring, 0), 9) AS composition_share, round((naive - cf) / nullif(naive - ring, 0), 9) AS score_distribution_share, nx = (SELECT count(*) FROM ex) AS excluded_all_positive FROM f""")
def counterfactual_contrasts(s, d):
    e = evts(s, d).select("txn_id", "is_laundering", "score", "ring_id")
    ok = F.col("ring_id").isNull() | (F.col("ring_id") % 2 == 0)
    return nulls.contrasts(e.where(~ok), e.where(ok), DRAWS)


#: Three rankings of the events' account-days: by the score, by the amount, and by the score from below.
_ARMS = {"amount": "amount_paid", "reversed": "1000 - score", "score": "score"}


@query(E + "".join(f", a_{n} AS (SELECT '{n}' AS arm, day, acct, max({e}) AS s, max(is_laundering) AS y FROM {_SIDES} GROUP BY 2, 3)" for n, e in _ARMS.items()) + f""",
  al AS ({' UNION ALL '.join(f'SELECT * FROM a_{n}' for n in _ARMS)}), r AS (SELECT arm, day, acct, y, row_number() OVER (PARTITION BY arm, day ORDER BY s DESC, acct) AS r FROM al){ks((5, 25))},
  h AS (SELECT arm, k, day, acct, r <= k AS hit FROM r, ks WHERE y = 1 AND day < DATE '{CUT}')
  SELECT x.k, x.arm AS arm_x, y.arm AS arm_y, x.day, count(*) FILTER (WHERE x.hit AND NOT y.hit) AS only_x, count(*) FILTER (WHERE y.hit AND NOT x.hit) AS only_y
  FROM h x JOIN h y ON x.k = y.k AND x.day = y.day AND x.acct = y.acct AND x.arm < y.arm GROUP BY 1, 2, 3, 4""")
def paired_head_counts(s, d):
    return nulls.paired_counts(paired_arms(s, d))


def paired_arms(s, d):
    """(arm, k, day, acct, hit) of the positives before the cut, for each ranking."""
    e, out = evts(s, d), None
    for name, score in _ARMS.items():
        ranks = alerts.ranked(alerts.account_days(e.withColumn("score", F.expr(score).cast("double"))))
        rows = ranks.where((F.col("y") == 1) & (F.col("day") < F.lit(CUT).cast("date"))).select(F.lit(name).alias("arm"), "day", "acct", "rank_first", alerts._budgets((5, 25)))
        rows = rows.select("arm", "k", "day", "acct", (F.col("rank_first") <= F.col("k")).alias("hit"))
        out = rows if out is None else out.unionByName(rows)
    return out


@query(E + """, top AS (SELECT min(score) AS thr FROM (SELECT score FROM t ORDER BY score DESC, txn_id LIMIT 500)) SELECT coalesce(ring_id % 2 = 1, false) AS excluded, count(*) AS n, CAST(sum(is_laundering) AS BIGINT) AS positives,
  count(*) FILTER (WHERE score >= thr) AS alerted, count(*) FILTER (WHERE score >= thr AND is_laundering = 1) AS caught, max(thr) AS threshold FROM t, top GROUP BY 1""")
def global_threshold_partition(s, d):
    return nulls.global_threshold(evts(s, d), F.coalesce(F.col("ring_id") % 2 == 1, F.lit(False)), 500)


# Leaks

def _sides(columns: tuple[str, ...], inner: str) -> str:
    pick = ", ".join(f"max(CASE WHEN side = '{x}' THEN {c} END) AS {x}_{c}" for x in "sr" for c in columns)
    return E + _EV + f", l AS ({inner}) SELECT txn_id, {pick} FROM l GROUP BY 1"


_AHEAD = "PARTITION BY a ORDER BY ts RANGE BETWEEN INTERVAL 1 MINUTE FOLLOWING AND INTERVAL {} DAY FOLLOWING"


@query(_sides(leaks.COLUMNS["reversed_window"], f"""SELECT txn_id, side, count(*) OVER ({_AHEAD.format(1)}) AS n_next_1d, count(*) OVER ({_AHEAD.format(7)}) AS n_next_7d,
  max(amount_paid) OVER ({_AHEAD.format(7)}) AS max_amt_next_7d FROM ev"""))
def leak_reversed_window(s, d):
    return leaks.plant(evts(s, d), "reversed_window")


_WITH = "PARTITION BY a, cp ORDER BY ts RANGE BETWEEN INTERVAL 1 MINUTE FOLLOWING AND UNBOUNDED FOLLOWING"


@query(_sides(leaks.COLUMNS["future_counterparty"], f"SELECT txn_id, side, CAST(epoch(min(ts) OVER ({_WITH}) - ts) AS BIGINT) AS secs_until_next_cp, count(*) OVER ({_WITH}) AS n_future_with_cp FROM ev"))
def leak_future_counterparty(s, d):
    return leaks.plant(evts(s, d), "future_counterparty")


@query(_sides(leaks.COLUMNS["target"], "SELECT txn_id, side, max(is_laundering) OVER (PARTITION BY a) AS account_ever_laundered, round(avg(is_laundering) OVER (PARTITION BY a), 9) AS account_laundering_rate FROM ev"))
def leak_target(s, d):
    return leaks.plant(evts(s, d), "target")


@query(E + f""", l AS (SELECT txn_id, amount_paid AS x, amount_received AS y, CASE WHEN event_time < TIMESTAMP '{CUT}' THEN 'train' ELSE 'test' END || '|' || strftime(event_date, '%Y-%m-%d') AS st FROM t),
  a AS (SELECT txn_id, st, row_number() OVER (PARTITION BY st ORDER BY txn_id) AS i FROM l), b AS (SELECT st, x, y, row_number() OVER (PARTITION BY st ORDER BY md5('7|' || txn_id), txn_id) AS i FROM l)
  SELECT a.txn_id, b.x, b.y FROM a JOIN b ON a.st = b.st AND a.i = b.i""")
def placebo_permutation(s, d):
    e = evts(s, d)
    part = F.when(F.col("event_time") < F.lit(CUT).cast("timestamp_ntz"), "train").otherwise("test")
    strata = e.select("txn_id", leaks.stratum(part, F.col("event_date")).alias("stratum"))
    return leaks.permute(e.select("txn_id", F.col("amount_paid").alias("x"), F.col("amount_received").alias("y")), strata, ("x", "y"), 7)


# Drift

def _quota(per: int, name: str = "q", magnitude: float = 1.0) -> str:
    """(bucket, place of the shape, shape, instances, first instance id) by largest remainder, from the shares' definition alone."""
    shapes = ", ".join(f"({i}, '{t}', {drift.TARGET[t]}::DOUBLE)" for i, t in enumerate(TYPOLOGIES))
    ramp = ", ".join(f"({b}, {h}::DOUBLE)" for b, h in enumerate(drift.RAMP))
    return f"""{name}_v AS (SELECT b, i, t, 0.125::DOUBLE + {magnitude}::DOUBLE * h * (g - 0.125::DOUBLE) AS v FROM (VALUES {shapes}) s(i, t, g), (VALUES {ramp}) r(b, h)),
  {name}_r AS (SELECT *, v / sum(v) OVER (PARTITION BY b) * {per} AS raw FROM {name}_v),
  {name}_l AS (SELECT *, floor(raw) AS f, {per} - sum(floor(raw)) OVER (PARTITION BY b) AS spare, row_number() OVER (PARTITION BY b ORDER BY round(raw - floor(raw), 9) DESC, i) AS k FROM {name}_r),
  {name}_n AS (SELECT b, i, t, CAST(f + CASE WHEN k <= spare THEN 1 ELSE 0 END AS BIGINT) AS n FROM {name}_l),
  {name} AS (SELECT *, CAST(coalesce(sum(n) OVER (ORDER BY b, i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS first FROM {name}_n)"""


@query("WITH " + _quota(100) + " SELECT CAST(b AS INTEGER) AS bucket, t AS typology, CAST(n AS INTEGER) AS instances FROM q")
def drift_schedule_mix(s, d):
    rows = [(b, t, n) for b, _, t, n, _ in drift.quotas(4, 1.0, 100)]
    return s.createDataFrame(rows, "bucket int, typology string, instances int")


_POOLS = _R + """, o AS (SELECT *, row_number() OVER (PARTITION BY typology ORDER BY md5('0|' || ring_id), ring_id) - 1 AS i, count(*) OVER (PARTITION BY typology) AS n FROM rings),
  pl AS (SELECT *, CAST(CASE WHEN i < n % 4 * (n // 4 + 1) THEN i // (n // 4 + 1) ELSE n % 4 + (i - n % 4 * (n // 4 + 1)) // greatest(n // 4, 1) END AS INTEGER) AS bucket FROM o)"""


@query(E + _POOLS + " SELECT typology, bucket, CAST(row_number() OVER (PARTITION BY typology, bucket ORDER BY i) - 1 AS INTEGER) AS slot, ring_id, count(*) OVER (PARTITION BY typology, bucket) AS size FROM pl")
def drift_pools(s, d):
    return drift.pools(splits.rings_of(evts(s, d)), 4).select("typology", "bucket", "slot", "ring_id", "size")


def _instances(s, d):
    return drift.instances(splits.rings_of(evts(s, d)), 4, 1.0, per_bucket=24)


_HEX = "CAST('0x' || substr(md5({}), 1, 8) AS BIGINT)"
_INSTANCES = E + _POOLS + ", " + _quota(24) + f""", sl AS (SELECT *, row_number() OVER (PARTITION BY typology, bucket ORDER BY i) - 1 AS slot, count(*) OVER (PARTITION BY typology, bucket) AS size FROM pl),
  dom AS (SELECT min(st) AS t0, epoch_us(max(st) - min(st)) / 4.0::DOUBLE AS span FROM rings),
  w AS (SELECT b, t, first + unnest(range(n)) AS id, unnest(range(n)) AS j FROM q WHERE n > 0),
  z AS (SELECT w.*, dom.t0, dom.span, sl.ring_id, sl.st, sl.en, greatest(CAST(floor(dom.span / 86400000000.0) AS BIGINT), 1) AS days
   FROM w JOIN sl ON sl.typology = w.t AND sl.bucket = w.b AND sl.slot = CASE WHEN w.j < sl.size THEN w.j ELSE {_HEX.format("'0|slot|' || w.id")} % (1 << 30) % sl.size END, dom),
  ins AS (SELECT id AS instance_id, ring_id AS source_ring_id, CASE WHEN b < 2 THEN 'train' ELSE 'test' END AS side, t AS typology, b AS bucket,
   datediff('day', CAST(st AS DATE), CAST(t0 + to_microseconds(CAST(b * span AS BIGINT)) AS DATE) + CAST({_HEX.format("'0|day|' || id")} % days AS INTEGER)) AS shift_days, st, en FROM z),
  itx AS (SELECT instance_id, ins.typology, bucket, event_time + to_days(CAST(shift_days AS INTEGER)) AS event_time, sender_id || '#' || instance_id AS sender_id, receiver_id || '#' || instance_id AS receiver_id,
   amount_paid, amount_received, payment_format, payment_currency, receiving_currency, row_number() OVER (ORDER BY instance_id, txn_id) - 1 AS drift_txn_seq FROM ins JOIN t ON t.ring_id = ins.source_ring_id)"""


@query(_INSTANCES + " SELECT CAST(bucket AS INTEGER) AS bucket, typology, count(*) AS n FROM ins GROUP BY 1, 2")
def drift_instances_mix(s, d):
    return _instances(s, d).groupBy("bucket", "typology").agg(F.count("*").alias("n"))


@query(_INSTANCES + """ SELECT CAST(instance_id AS INTEGER) AS instance_id, source_ring_id, side, typology, CAST(bucket AS INTEGER) AS bucket, CAST(shift_days AS INTEGER) AS shift_days,
  st + to_days(CAST(shift_days AS INTEGER)) AS start_time, en + to_days(CAST(shift_days AS INTEGER)) AS end_time FROM ins""")
def drift_instances(s, d):
    return _instances(s, d)


@query(_INSTANCES + " SELECT * REPLACE (CAST(instance_id AS INTEGER) AS instance_id, CAST(bucket AS INTEGER) AS bucket, round(amount_paid, 9) AS amount_paid, round(amount_received, 9) AS amount_received) FROM itx")
def drift_instance_txns(s, d):
    return drift.instance_txns(_instances(s, d), evts(s, d).where("ring_id is not null"))


@query(E + """, x AS (SELECT a, count(*) AS n FROM (SELECT sender_id AS a FROM t WHERE is_laundering = 0 UNION ALL SELECT receiver_id FROM t WHERE is_laundering = 0) GROUP BY 1)
  SELECT a, n, CAST(least((row_number() OVER (ORDER BY n, a) - 1) * 10 // count(*) OVER (), 9) AS INTEGER) AS bin FROM x""")
def activity_decile_bins(s, d):
    return drift.deciles(evts(s, d))


@query(_INSTANCES + f""", bg AS (SELECT event_date FROM ({adapters.TXNS}) WHERE is_laundering = 0), sy AS (SELECT sender_id AS a FROM itx UNION SELECT receiver_id FROM itx)
  SELECT (SELECT count(*) FROM bg) + (SELECT count(*) FROM itx) AS rows, (SELECT count(*) FROM bg) + (SELECT count(*) FROM itx) AS distinct_ids, (SELECT count(*) FROM itx) AS positives, (SELECT count(DISTINCT instance_id) FROM itx) AS ring_instances,
  0::BIGINT AS positives_with_no_ring, (SELECT count(*) FROM (SELECT event_date FROM bg UNION SELECT CAST(event_time AS DATE) FROM itx)) AS days, (SELECT count(*) FROM sy) AS laundering_accounts,
  (SELECT count(*) FROM sy) AS laundering_accounts_also_in_background, 0::BIGINT AS accounts_in_several_rings""")
def drift_splice_checks(s, d):
    """All instances in orders and lineitem, as the 150 accounts of the events cannot host them."""
    made = drift.instance_txns(_instances(s, d), evts(s, d).where("ring_id is not null"))
    back = txns(s, d)
    own = [c for c in back.columns if c != "txn_id"]
    return drift.splice_checks(drift.splice(order.positions(back, *own, name="txn_id"), made))  # ids of the view repeat


@query(E + " SELECT txn_id, CAST(least(greatest(floor(epoch(event_time - TIMESTAMP '2024-01-03') / (86400.0 * 6.5)), 0), 3) AS INTEGER) AS bucket FROM t")
def drift_time_buckets(s, d):
    return drift.time_buckets(evts(s, d), "2024-01-03", 6.5, 4).select("txn_id", "bucket")


@query(E + """, c AS (SELECT typology, count(*) AS n FROM t WHERE typology IS NOT NULL GROUP BY 1) SELECT txn_id, round(coalesce((SELECT avg(n) FROM c) / c.n, 1), 9) AS weight FROM t LEFT JOIN c ON c.typology = t.typology""")
def typology_weights(s, d):
    return drift.typology_weights(evts(s, d)).select("txn_id", "weight")


# Replay and diagnostics

@query(T + _BUNDLE.format(cap=5) + " SELECT day, acct, round(score, 9) AS score, round(other_max, 9) AS other_max, y, rank FROM top")
def replay_bundle_topk(s, d):
    return _bundle(s, d, 5)["account_days_topk"]


@query(T + AD + ks((1, 5)) + _METRICS.replace(RK, _RING) + """ SELECT k, round(caught / total_pos::DOUBLE, 9) AS recall, round(ceiling_count / total_pos::DOUBLE, 9) AS recall_ceiling, round(caught / ceiling_count::DOUBLE, 9) AS recall_efficiency,
  round(caught / n_alerts::DOUBLE, 9) AS precision, round((SELECT avg(hit) FROM rg WHERE rg.k = m.k), 9) AS ring_recall, (SELECT count(*) FROM rg WHERE rg.k = m.k) AS n_rings FROM m JOIN tot USING (k)""")
def replay_recompute(s, d):
    return replay.recompute(_bundle(s, d, 5), 5, (1, 5))


@query(T + _BUNDLE.format(cap=30) + ks((5, 25)) + f""", x AS (SELECT k, count(*) FILTER (WHERE rank <= k) AS al, count(*) FILTER (WHERE rank <= k AND h) AS ah, count(*) FILTER (WHERE rank <= k AND NOT h) AS a_t,
   count(*) FILTER (WHERE rank <= k AND h AND y = 1) AS th, count(*) FILTER (WHERE rank <= k AND NOT h AND y = 1) AS tt FROM (SELECT *, day < DATE '{BOUNDARY}' AS h FROM top), ks GROUP BY 1),
  z AS (SELECT k, CAST(coalesce(sum(least(n, k)) FILTER (WHERE day < DATE '{BOUNDARY}'), 0) AS BIGINT) AS ch, CAST(coalesce(sum(least(n, k)) FILTER (WHERE day >= DATE '{BOUNDARY}'), 0) AS BIGINT) AS ct FROM pos, ks GROUP BY 1)
  SELECT k, ah AS alerts_head, a_t AS alerts_tail, th AS true_positives_head, tt AS true_positives_tail, ch AS ceiling_count_head, ct AS ceiling_count_tail, round(tt / (th + tt)::DOUBLE, 5) AS true_positive_share_tail,
  round(ct / (ch + ct)::DOUBLE, 5) AS ceiling_share_tail, round(th / ah::DOUBLE, 5) AS precision_head, round(tt / a_t::DOUBLE, 5) AS precision_tail, round((th + tt) / al::DOUBLE, 5) AS precision_pooled FROM x JOIN z USING (k)""")
def window_decomposition(s, d):
    b = _bundle(s, d, 30)
    return diagnostics.window_decomposition(b["account_days_topk"], b["per_day_positives"], BOUNDARY, (5, 25))


_ENDS = T + _BUNDLE.format(cap=30) + """, ty AS (SELECT ring_id, min(typology) AS typology FROM t WHERE ring_id IS NOT NULL GROUP BY 1),
  en AS (SELECT mem.ring_id, max(mem.day) AS e, max(CASE WHEN rank <= 5 THEN 1 ELSE 0 END) AS hit FROM mem LEFT JOIN top ON top.day = mem.day AND top.acct = mem.acct GROUP BY 1)"""


def _ends(s, d):
    t, b = txns(s, d), _bundle(s, d, 30)
    return diagnostics.ring_ends(b["ring_membership"], splits.rings_of(t), b["account_days_topk"], 5), b["account_days_topk"]


@query(_ENDS + """ SELECT typology, count(*) AS n_rings, count(*) FILTER (WHERE e >= DATE '1998-06-01') AS n_after, round(count(*) FILTER (WHERE e >= DATE '1998-06-01') / count(*)::DOUBLE, 4) AS share_after,
  round(avg(hit) FILTER (WHERE e < DATE '1998-06-01'), 5) AS head_rate, round(avg(hit) FILTER (WHERE e >= DATE '1998-06-01'), 5) AS tail_rate, round(avg(hit), 5) AS rate FROM en JOIN ty USING (ring_id) GROUP BY 1""")
def segment_detection_rates(s, d):
    return diagnostics.segment_rates(_ends(s, d)[0], "1998-06-01")


@query(_ENDS + """, g AS (SELECT round(avg(hit), 5) AS rate, count(*) AS n, count(*) FILTER (WHERE e >= DATE '1998-06-01') AS na FROM en JOIN ty USING (ring_id) GROUP BY typology),
  o AS (SELECT sum(na) / sum(n)::DOUBLE AS sh, sum(n * rate) / sum(n)::DOUBLE AS po FROM g)
  SELECT round(sh, 5) AS after_share, round(po, 5) AS pooled_rate, round(least(1.0, po / nullif(sh, 0)), 5) AS max_feasible_tail_rate, round(greatest(0.0, (po - (1 - sh)) / nullif(sh, 0)), 5) AS min_feasible_tail_rate FROM o""")
def feasible_tail(s, d):
    return diagnostics.feasible_tail(diagnostics.segment_rates(_ends(s, d)[0], "1998-06-01"))


@query(_ENDS + """, nb AS (SELECT day FROM top GROUP BY 1 HAVING max(rank) <= 25)
  SELECT typology, count(*) AS n_rings, count(nb.day) AS n_on_nonbinding_days, round(count(nb.day) / count(*)::DOUBLE, 4) AS share FROM en JOIN ty USING (ring_id) LEFT JOIN nb ON nb.day = en.e GROUP BY 1""")
def nonbinding_rings(s, d):
    return diagnostics.nonbinding_rings(*_ends(s, d), 30, 25)


@query(T + """, v AS (SELECT event_date AS day, count(*) AS transactions, CAST(sum(is_laundering) AS BIGINT) AS laundering FROM t GROUP BY 1)
  SELECT day, transactions, laundering, round(laundering / transactions::DOUBLE, 6) AS prevalence, transactions < 0.01 * (SELECT median(transactions) FROM v) AS thin FROM v""")
def volume_profile(s, d):
    return diagnostics.volume(txns(s, d))


_COUPLE = E + _BUNDLE.format(cap=30) + ks((10, 25)) + """, tp AS (SELECT k, day, acct, score, y FROM top, ks WHERE rank <= k), ti AS (SELECT k, day, score, count(*) AS n, min(y) AS lo, max(y) AS hi FROM tp GROUP BY 1, 2, 3),
  ep AS (SELECT DISTINCT event_date AS day, sender_id AS acct, txn_id AS rt, score AS ts FROM t WHERE ring_id IS NOT NULL UNION SELECT event_date, receiver_id, txn_id, score FROM t WHERE ring_id IS NOT NULL),
  fo AS (SELECT k, ep.day, ep.acct, rt, tp.score, ts = tp.score AS src FROM ep JOIN tp ON tp.day = ep.day AND tp.acct = ep.acct), so AS (SELECT * FROM fo WHERE src),
  a AS (SELECT k, CAST(sum(n) AS BIGINT) AS alerted_account_days, count(*) AS tie_groups, count(*) FILTER (WHERE lo <> hi) AS tie_label_discordant_groups, round(avg(hi), 5) AS precision_per_tie_group, round(avg(n), 4) AS tie_account_days_per_group FROM ti GROUP BY 1),
  b AS (SELECT k, round(avg(y), 5) AS precision_per_account_day FROM tp GROUP BY 1), c AS (SELECT k, count(*) AS ring_endpoints_in_alerted, count(*) FILTER (WHERE src) AS ring_endpoints_attributable FROM fo GROUP BY 1),
  e AS (SELECT k, count(*) AS alerting_ring_txns, count(*) FILTER (WHERE n = 2) AS alerting_ring_txns_with_both_endpoints FROM (SELECT k, day, rt, count(*) AS n FROM so GROUP BY 1, 2, 3) GROUP BY 1),
  f AS (SELECT k, count(*) FILTER (WHERE n > 1) AS ring_account_days_with_tied_max, count(*) AS ring_account_days_attributed FROM (SELECT k, day, acct, count(DISTINCT rt) AS n FROM so GROUP BY 1, 2, 3) GROUP BY 1),
  g AS (SELECT k, count(*) AS ring_score_groups, count(*) FILTER (WHERE n > 1) AS ring_score_groups_spanning_multiple_txns FROM (SELECT k, day, score, count(DISTINCT rt) AS n FROM so GROUP BY 1, 2, 3) GROUP BY 1)
  SELECT *, round(alerting_ring_txns_with_both_endpoints / alerting_ring_txns::DOUBLE, 4) AS both_endpoint_share FROM a JOIN b USING (k) LEFT JOIN c USING (k) LEFT JOIN e USING (k) LEFT JOIN f USING (k) LEFT JOIN g USING (k)"""


@query(_COUPLE)
def alert_unit_coupling(s, d):
    b = replay.build(evts(s, d), 30)
    return diagnostics.alert_unit_coupling(b["account_days_topk"], b["ring_endpoints"], b["ring_transactions"], (10, 25))


@query(E + _BUNDLE.format(cap=30) + " SELECT size, count(*) AS groups FROM (SELECT day, score, count(*) AS size FROM top WHERE rank <= 25 GROUP BY 1, 2) GROUP BY 1")
def tie_group_histogram(s, d):
    return diagnostics.tie_histogram(replay.build(evts(s, d), 30)["account_days_topk"], 25)


@query(E + """ SELECT payment_format AS format, count(*) AS rows, CAST(sum(is_laundering) AS BIGINT) AS positives, round(100.0 * sum(is_laundering) / count(*), 4) AS laundering_rate_pct,
  round(100.0 * count(*) / sum(count(*)) OVER (), 2) AS share_of_rows_pct, round(100.0 * sum(is_laundering) / sum(sum(is_laundering)) OVER (), 2) AS share_of_positives_pct FROM t GROUP BY 1""")
def format_facts(s, d):
    return diagnostics.format_facts(evts(s, d))


@query(T + " SELECT day, count(*) AS raw FROM (SELECT DISTINCT event_date AS day, sender_id AS a FROM t UNION SELECT event_date, receiver_id FROM t) GROUP BY 1")
def raw_account_days(s, d):
    return diagnostics.raw_account_days(txns(s, d))


@query(E + " SELECT is_laundering, count(*) AS n, round((SELECT count(*) FROM t) / (2.0::DOUBLE * count(*)), 9) AS weight FROM t GROUP BY 1")
def class_weights(s, d):
    from . import models

    return models.class_weights(evts(s, d))


def _digest(units: str) -> str:
    return f"CAST(sum(CAST(CAST('0x' || substr(md5(txn_id || '|' || CAST({units} AS DECIMAL(38, 0))), 1, 15) AS BIGINT) AS DECIMAL(38, 0))) AS VARCHAR)"


@query(E + f" SELECT count(*) AS rows, {_digest('floor(score * 1099511627776.0::DOUBLE)')} AS digest, {_digest('round(score * 1000000 + 2.5e-2, 0)')} AS digest_rounded FROM t")
def score_digest(s, d):
    return diagnostics.digest(evts(s, d).select("txn_id", "score"))


@query()
def portable_buckets(s, d):
    e = evts(s, d)
    return e.select("txn_id", C.bucket(F.col("txn_id"), 10_000).alias("bucket"))


ORACLES["portable_buckets"] = E + f" SELECT txn_id, {_B.format('txn_id')} AS bucket FROM t"
