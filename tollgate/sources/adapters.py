"""The driver's tables seen as transfers, with the same SQL text in both engines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: Orders and their lines as day-grain transfers; ids repeat, so nothing may key on them.
TXNS = """
SELECT l_orderkey * 8 + l_linenumber AS txn_id, o_orderdate AS event_time, CAST(o_orderdate AS DATE) AS event_date,
  concat('C_', CAST(o_custkey AS STRING)) AS sender_id, concat('S_', CAST(l_suppkey AS STRING)) AS receiver_id, l_extendedprice AS amount_paid,
  CASE WHEN l_returnflag = 'R' AND l_quantity > 40 THEN 1 ELSE 0 END AS is_laundering,
  CASE WHEN l_returnflag = 'R' AND l_quantity > 40 AND l_partkey % 3 = 0 THEN l_partkey % 97 END AS ring_id,
  CASE WHEN l_returnflag = 'R' AND l_quantity > 40 AND l_partkey % 3 = 0 THEN concat('T', CAST(l_partkey % 97 % 8 AS STRING)) END AS typology,
  l_extendedprice * (1 - l_discount) AS score
FROM lineitem JOIN orders ON l_orderkey = o_orderkey"""

#: Events as minute-grain transfers between 150 accounts of 5 banks, with unique ids, rings, and a score.
EVTS = """
SELECT event_id AS txn_id, CAST(date_trunc('minute', ts) AS {ntz}) AS event_time, CAST(ts AS DATE) AS event_date,
  concat(concat('0', CAST(user_id % 5 AS STRING)), concat('_U', CAST(user_id AS STRING))) AS sender_id,
  concat(concat('0', CAST((user_id * 7 + event_id) % 150 % 5 AS STRING)), concat('_U', CAST((user_id * 7 + event_id) % 150 AS STRING))) AS receiver_id,
  concat('0', CAST(user_id % 5 AS STRING)) AS sender_bank, concat('0', CAST((user_id * 7 + event_id) % 150 % 5 AS STRING)) AS receiver_bank,
  round(value, 2) AS amount_paid, CASE WHEN event_id % 4 = 0 THEN round(value, 2) * 0.5 ELSE round(value, 2) END AS amount_received,
  event_type AS payment_format, CASE WHEN event_id % 3 = 0 THEN 'Euro' ELSE 'US Dollar' END AS payment_currency,
  CASE WHEN event_id % 4 = 0 THEN 'Yen' WHEN event_id % 3 = 0 THEN 'Euro' ELSE 'US Dollar' END AS receiving_currency,
  CASE WHEN event_id % 11 = 0 THEN 1 ELSE 0 END AS is_laundering,
  CASE WHEN event_id % 11 = 0 AND event_id % 3 <> 0 THEN event_id % 1243 END AS ring_id,
  CASE WHEN event_id % 11 = 0 AND event_id % 3 <> 0 THEN
    CASE event_id % 1243 % 8 WHEN 0 THEN 'FAN-OUT' WHEN 1 THEN 'FAN-IN' WHEN 2 THEN 'GATHER-SCATTER' WHEN 3 THEN 'SCATTER-GATHER'
      WHEN 4 THEN 'CYCLE' WHEN 5 THEN 'RANDOM' WHEN 6 THEN 'BIPARTITE' ELSE 'STACK' END END AS typology,
  CAST((event_id * 7919) % 997 + CASE WHEN event_id % 11 = 0 THEN 400 ELSE 0 END AS DOUBLE) AS score
FROM events"""


def evts_sql(engine: str) -> str:
    return EVTS.format(ntz="TIMESTAMP_NTZ" if engine == "spark" else "TIMESTAMP")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def txns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Day-grain transfers from orders and lineitem."""
    text = TXNS.replace("FROM lineitem JOIN orders", "FROM {lineitem} JOIN {orders}")
    return spark.sql(text, lineitem=table(spark, sf_dir, "lineitem"), orders=table(spark, sf_dir, "orders"))


def evts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Minute-grain transfers from events."""
    return spark.sql(evts_sql("spark").replace("FROM events", "FROM {events}"), events=table(spark, sf_dir, "events"))


def register(spark: SparkSession, sf_dir: str) -> None:
    """Temp views ``txns`` and ``evts`` for this session's SQL."""
    txns(spark, sf_dir).createOrReplaceTempView("txns")
    evts(spark, sf_dir).createOrReplaceTempView("evts")
