"""Driver tables -> engine inputs (FIXTURES.md part B).

The derivations are written once as SQL with ``{table}`` placeholders.  Spark
runs them through ``spark.sql(text, table=DataFrame)`` (no global temp views,
so several scale factors can share one session); the DuckDB oracle formats the
same text with plain view names.  Column pruning and filter pushdown reach the
Parquet scans as usual.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from merchlens.session import prepare, setting

TABLES = [
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem",
    "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
]

# Transactions with planted dirt; merchant = supplier.  tb1..tb3 are
# tie-breakers only (dedupe order: ingested_at, ts, tb1, tb2, tb3 all DESC).
RAW_TXN_SQL = """
SELECT CAST(l_orderkey AS VARCHAR(20)) || '-' || CAST(l_linenumber AS VARCHAR(20)) AS transaction_id,
       CAST(s_suppkey AS VARCHAR(20)) AS merchant_id,
       CASE WHEN s_suppkey % 10 = 0 THEN '  ' || s_name || ' ' ELSE s_name END AS merchant_name,
       CASE WHEN l_orderkey % 97 = 0 THEN CAST(0 AS DOUBLE)
            WHEN l_orderkey % 101 = 0 THEN CAST(100000 AS DOUBLE)
            WHEN s_suppkey % 25 = 3 THEN CAST(CAST(CAST(l_extendedprice / 125 AS DECIMAL(28,8)) AS DECIMAL(18,2)) AS DOUBLE)
            ELSE CAST(CAST(CAST(l_extendedprice / 500 AS DECIMAL(28,8)) AS DECIMAL(18,2)) AS DOUBLE) END AS transaction_amount,
       CASE s_suppkey % 6 WHEN 0 THEN '5812' WHEN 1 THEN '5813' WHEN 2 THEN '5814' WHEN 3 THEN '5411' WHEN 4 THEN '7011' ELSE '742' END AS mcc_code,
       CASE s_suppkey % 6 WHEN 0 THEN 'Eating Places, Restaurants' WHEN 1 THEN 'Drinking Places' WHEN 2 THEN 'Fast Food Restaurants'
            WHEN 3 THEN 'Grocery Stores, Supermarkets' WHEN 4 THEN 'Hotels' ELSE 'General Retail' END AS mcc_description,
       CASE WHEN l_orderkey % 89 = 0 THEN NULL ELSE n_name END AS city,
       lower(r_name) AS state,
       CASE WHEN s_suppkey % 4 = 0 THEN NULL WHEN s_suppkey % 4 = 1 THEN '  ' ELSE 'Zone ' || CAST(s_suppkey % 7 AS VARCHAR(5)) END AS neighborhood,
       CAST(40 + s_suppkey % 10 AS DOUBLE) AS latitude,
       CAST(-90 + s_suppkey % 10 AS DOUBLE) AS longitude,
       CASE WHEN s_suppkey % 15 = 4 AND l_linenumber % 2 = 0 THEN CAST('2000-11-15 00:00:00' AS TIMESTAMP) ELSE CAST(l_shipdate AS TIMESTAMP) END AS ts,
       CASE WHEN l_orderkey % 103 = 0 THEN 'wire'
            WHEN o_orderpriority = '1-URGENT' THEN 'CHIP' WHEN o_orderpriority = '2-HIGH' THEN 'contactless'
            WHEN o_orderpriority = '3-MEDIUM' THEN 'Online' WHEN o_orderpriority = '4-NOT SPECIFIED' THEN 'swipe'
            WHEN l_linenumber % 2 = 0 THEN 'mobile_pay' ELSE 'keyed' END AS acceptance_method,
       CASE WHEN s_suppkey % 13 = 0 THEN NULL WHEN s_suppkey % 50 = 7 THEN CAST(1 AS DOUBLE)
            ELSE CAST(35 + s_suppkey % 14 AS DOUBLE) / 10 END AS stars,
       CAST(s_suppkey * 31 % 5000 AS INTEGER) AS review_count,
       CASE WHEN s_suppkey % 17 = 5 THEN NULL WHEN s_suppkey % 20 = 0 THEN CAST(400 + s_suppkey % 9 AS INTEGER)
            ELSE CAST(s_suppkey * 37 % 120 AS INTEGER) END AS review_velocity_30d,
       CASE s_suppkey % 6 WHEN 0 THEN 'Pizza, Italian, Restaurants' WHEN 1 THEN 'Cocktail Bars, Bars' WHEN 2 THEN 'Hot Dogs, Fast Food'
            WHEN 3 THEN 'Grocery, Food' WHEN 4 THEN 'Hotels, Bars' ELSE 'Coffee & Tea, Cafes' END AS categories,
       CASE WHEN s_suppkey % 9 = 0 THEN 0 ELSE 1 END AS is_open,
       CASE WHEN s_suppkey % 11 = 0 THEN NULL ELSE CAST(1 + s_suppkey % 4 AS INTEGER) END AS price_range,
       CAST(o_orderdate AS TIMESTAMP) AS ingested_at,
       l_partkey AS tb1, l_suppkey AS tb2, l_extendedprice AS tb3
FROM {lineitem}
JOIN {orders} ON l_orderkey = o_orderkey
JOIN {supplier} ON l_suppkey = s_suppkey
JOIN {nation} ON s_nationkey = n_nationkey
JOIN {region} ON n_regionkey = r_regionkey
"""

# Event-time transactions for the streaming jobs.
STREAM_TXN_SQL = """
SELECT CAST(event_id AS VARCHAR(20)) AS transaction_id,
       CAST(user_id AS VARCHAR(20)) AS merchant_id,
       value AS transaction_amount,
       CASE event_type WHEN 'view' THEN 'chip' WHEN 'click' THEN 'contactless' WHEN 'purchase' THEN 'online'
            WHEN 'signup' THEN 'swipe' ELSE 'mobile_pay' END AS acceptance_method,
       CAST(ts AS TIMESTAMP) AS ts
FROM {events}
"""

# A fixed batch of questions (the reference's example questions plus ledger pins).
QUESTIONS_SQL = """
SELECT * FROM (VALUES
  (1, 'pizza in chicago', CAST(NULL AS VARCHAR(20)), CAST(NULL AS VARCHAR(8)), CAST(NULL AS VARCHAR(8))),
  (2, 'best restaurant for group dinner', NULL, NULL, NULL),
  (3, 'cocktail bar with good drinks', NULL, NULL, NULL),
  (4, 'cheap budget lunch spots', NULL, NULL, NULL),
  (5, 'luxury upscale fine dining experience', NULL, NULL, NULL),
  (6, 'any food', 'New York', '5411', 'mid'),
  (7, 'fast food near me', NULL, NULL, NULL),
  (8, 'cola bottles in nyc', NULL, NULL, NULL),
  (9, 'hotels open now', NULL, NULL, NULL),
  (10, 'cola bottles', NULL, NULL, NULL),
  (11, 'coffee', 'NATION_7', NULL, NULL),
  (12, 'zzz unknown words', NULL, NULL, NULL)
) AS q(query_id, query, city_filter, mcc_filter, value_tier)
"""

# Conversation turns paired user -> next assistant turn.
TURN_PAIRS_SQL = """
SELECT u.conv_id AS session_id, u.turn AS turn_no, u.text AS human, a.text AS ai
FROM {conversations} u JOIN {conversations} a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1
WHERE u.role = 'user' AND a.role = 'assistant'
"""

_PLACEHOLDER = re.compile(r"\{([a-z_]+)\}")


def as_duckdb(sql: str) -> str:
    """The same fixture text with plain view names (for the oracle)."""
    return _PLACEHOLDER.sub(lambda m: m.group(1), sql)


# Fact tables whose rows carry per-row work (join probes, regex, text): spread
# them when the scan yields fewer splits than there are cores.  Tables that
# only build a join side (orders, dimensions) are read as they are.
FACT_TABLES = {"lineitem", "events", "documents", "embeddings", "pages", "conversations"}


# Session setting of ``spread``: partitions to fan a fact-table scan out to; unset, scans stay as they are.
SPREAD_CONF = "spark.merchlens.fixture.partitions"


def spread(df: DataFrame) -> DataFrame:
    """Fan a scan out to a stated number of partitions (one Parquet row group is
    one task, however large; the test tables have one).  Stated by the session
    (``SPREAD_CONF``, set by ``local_session``), never derived from the
    data: on a cluster it stays unset and no shuffle is added.  Filters and column
    pruning still reach the scan through the round-robin repartition."""
    n = df.sparkSession.conf.get(SPREAD_CONF, None)
    return df.repartition(int(n)) if n else df


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
    return spread(df) if name in FACT_TABLES else df


def input_mb(spark: SparkSession, sf_dir: str, *names: str) -> int:
    """Size of the given tables' files in MB, rounded up: what numbers of files and buckets follow."""
    paths = [spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{sf_dir.rstrip('/')}/{n}.parquet") for n in names]
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    return 1 + sum(p.getFileSystem(conf).getContentSummary(p).getLength() for p in paths) // 1_000_000


#: MB of transactions and orders (as given) for each partition of their shuffles, which carry some six times as much.
PARTITION_MB = 4


@contextmanager
def partitions_by_size(spark: SparkSession, sf_dir: str, slices: int = 1) -> Iterator[None]:
    """For the length of a block, shuffles begin with a number of partitions that follows the size of the given
    transactions, or of one of their slices (the session's number at least), so that a task sorts its rows in memory; adaptive execution
    merges small partitions as before."""
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), input_mb(spark, sf_dir, "lineitem", "orders") // PARTITION_MB)
    with setting(spark, "spark.sql.shuffle.partitions", str(-(-n // slices))):
        yield


#: MB of transactions and orders (as given) for each slice of their keys, and slices at most: each reads the tables again.
SLICE_MB, MAX_SLICES = 64, 4


def slices_by_size(spark: SparkSession, sf_dir: str) -> int:
    """Slices in which jobs shuffle the given transactions one after another, so that a part of them is on disk at a time."""
    return min(MAX_SLICES, 1 + input_mb(spark, sf_dir, "lineitem", "orders") // SLICE_MB)


def raw_slices(spark: SparkSession, sf_dir: str) -> Iterator[DataFrame]:
    """The raw transactions, a slice of their ids at a time."""
    n = slices_by_size(spark, sf_dir)
    for i in range(n):
        raw = raw_txn(spark, sf_dir)
        yield raw.where(F.pmod(F.xxhash64("transaction_id"), F.lit(n)) == i) if n > 1 else raw


def run_fixture(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    prepare(spark)
    names = sorted(set(_PLACEHOLDER.findall(sql)))
    return spark.sql(sql, **{n: table(spark, sf_dir, n) for n in names})


def raw_txn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run_fixture(spark, sf_dir, RAW_TXN_SQL)


def stream_txn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run_fixture(spark, sf_dir, STREAM_TXN_SQL)


def questions(spark: SparkSession, sf_dir: str | None = None) -> DataFrame:
    prepare(spark)
    return spark.sql(QUESTIONS_SQL)


def turn_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run_fixture(spark, sf_dir, TURN_PAIRS_SQL)


DEDUPE_TIEBREAK = ["ts", "tb1", "tb2", "tb3"]

# Business records (nested in JSON form) derived from suppliers: planted text
# prices ('two', '0'), null prices / stars / velocity, categories with and
# without a known MCC (first known category wins), missing neighborhoods.
BUSINESSES_SQL = """
SELECT 'biz_' || CAST(s_suppkey AS VARCHAR(20)) AS business_id,
       s_name AS name,
       CAST(s_suppkey AS VARCHAR(20)) || ' Main St' AS address,
       n_name AS city,
       r_name AS state,
       CAST(10000 + s_suppkey % 90000 AS VARCHAR(10)) AS postal_code,
       CAST(40 + s_suppkey % 10 AS DOUBLE) AS latitude,
       CAST(-90 + s_suppkey % 10 AS DOUBLE) AS longitude,
       CASE WHEN s_suppkey % 13 = 0 THEN NULL ELSE CAST(35 + s_suppkey % 14 AS DOUBLE) / 10 END AS stars,
       CAST(s_suppkey * 31 % 5000 AS INTEGER) AS review_count,
       CASE WHEN s_suppkey % 9 = 0 THEN 0 ELSE 1 END AS is_open,
       CASE s_suppkey % 7 WHEN 0 THEN 'Pizza, Italian, Restaurants' WHEN 1 THEN 'Cocktail Bars, Bars'
            WHEN 2 THEN 'Hot Dogs, Fast Food, Restaurants' WHEN 3 THEN 'Grocery, Food'
            WHEN 4 THEN 'Gyms, Hotels, Bars' WHEN 5 THEN 'Coffee & Tea, Cafes'
            ELSE 'Bookstores, Shopping, Arts, Music Venues, Books, Mags' END AS categories,
       CASE WHEN s_suppkey % 4 = 0 THEN NULL ELSE 'Zone ' || CAST(s_suppkey % 7 AS VARCHAR(5)) END AS neighborhood,
       CASE WHEN s_suppkey % 8 = 0 THEN NULL ELSE CAST(s_suppkey * 7 % 120 AS INTEGER) END AS review_velocity_30d,
       CASE s_suppkey % 6 WHEN 0 THEN NULL WHEN 1 THEN 'two' WHEN 2 THEN '0'
            ELSE CAST(1 + s_suppkey % 4 AS VARCHAR(2)) END AS price_attr,
       CASE WHEN s_suppkey % 2 = 0 THEN 'free' ELSE 'no' END AS wifi,
       s_suppkey % 3 = 0 AS parking_street
FROM {supplier}
JOIN {nation} ON s_nationkey = n_nationkey
JOIN {region} ON n_regionkey = r_regionkey
"""


def businesses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run_fixture(spark, sf_dir, BUSINESSES_SQL)
