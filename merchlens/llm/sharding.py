"""Sharding by jump consistent hashing.

Built-in DataFrame functions only.

A row's shard is a function of its id and the number of shards alone.  The id seeds a 64-bit
linear congruential generator; a row jumps from bucket to bucket, each jump drawn from
the generator, and stays in the last bucket before the number of shards.  There is no ring
table to keep or to broadcast, shards differ in size only by chance, and with one more shard a
row either stays or moves into the new one: one in ``shards + 1`` rows moves.

The expected number of jumps is the logarithm of the number of shards.  A loop of
``_SHORT`` jumps serves nearly every row; the rest go on in a loop as long as the
number of shards, which no row can exceed, so the result is exact for every id.

Slots number the rows of a shard from 0 without gaps, in the order of (id, size, checksum).  No
shard is gathered in a task: narrow rows are range-sorted by (shard, id, ..., row number), so
that rows which are equal in everything still spread over tasks, and a row's slot is its
rank in its task plus the rows of its shard in the tasks before - one narrow shuffle, no
text in it.

Defined cases: a null id counts as id 0 for its shard (and sorts before all others); a null
text counts as empty (size 8, checksum 0).  Repeated rows are rows of their own with their own
slots, all in one shard; rows equal in id, size and checksum are interchangeable.  Very
long texts only cost their reading.  An empty table gives an empty result.  Only the named
columns are read, so extra columns may have any name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from merchlens.llm.common import text_or_empty
from merchlens.session import materialize

#: Multiplier of the published generator, its 32-bit halves.
MULTIPLIER = 2862933555777941757
_MUL_HIGH, _MUL_LOW = MULTIPLIER >> 32, MULTIPLIER & 0xFFFFFFFF
#: Jumps of the short loop.
_SHORT = 24
#: Bytes counted for a row beside its text.
ROW_BYTES = 8


def _times(a: Column, b: int) -> Column:
    """a * b modulo 2^32 for 32-bit a and b, by 16-bit halves of b: no product passes 2^48."""
    high = (a * F.lit(b >> 16)).bitwiseAND(0xFFFF) * F.lit(65536)
    return (a * F.lit(b & 0xFFFF) + high).bitwiseAND(0xFFFFFFFF)


def _next(s: Column) -> Column:
    """One step of the generator, then one jump: state (b, j, hi, lo) with bucket b, next bucket j."""
    p0 = s["lo"] * F.lit(_MUL_LOW & 0xFFFF)
    p1 = s["lo"] * F.lit(_MUL_LOW >> 16)
    low = p0 + p1.bitwiseAND(0xFFFF) * F.lit(65536) + F.lit(1)
    carry = F.shiftright(low, 32) + F.shiftright(p1, 16)
    hi = (carry + _times(s["hi"], _MUL_LOW) + _times(s["lo"], _MUL_HIGH)).bitwiseAND(0xFFFFFFFF)
    draw = F.shiftright(hi, 1) + F.lit(1)  # the generator's upper 31 bits, from 1
    jump = F.floor((s["j"] + F.lit(1)).cast("double") * (F.lit(2147483648.0) / draw.cast("double"))).cast("long")
    return F.struct(s["j"].alias("b"), jump.alias("j"), hi.alias("hi"), low.bitwiseAND(0xFFFFFFFF).alias("lo"))


def jump_hash(key: Column, shards: int) -> Column:
    """Shard (int, 0 to shards - 1) of a 64-bit key; a null key counts as 0."""
    if shards < 1:
        raise ValueError("at least one shard")
    k = F.coalesce(key.cast("long"), F.lit(0).cast("long"))
    zero = F.lit(0).cast("long")
    start = F.struct(zero.alias("b"), zero.alias("j"), F.shiftrightunsigned(k, 32).alias("hi"),
                     k.bitwiseAND(0xFFFFFFFF).alias("lo"))

    def run(state: Column, steps: int) -> Column:
        return F.aggregate(F.sequence(F.lit(1), F.lit(steps)), state,
                           lambda s, _: F.when(s["j"] < F.lit(shards), _next(s)).otherwise(s))

    end = run(start, min(shards, _SHORT))
    if shards > _SHORT:
        end = F.when(end["j"] < F.lit(shards), run(end, shards)).otherwise(end)
    return end["b"].cast("int")


def assign(docs: DataFrame, shards: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, size, text_crc32, law, shard, slot, grown_shard) of every row: size is the text's UTF-8
    bytes plus 8, grown_shard the shard if there were one more."""
    text = F.encode(text_or_empty(text_col), "UTF-8")
    key = F.col(id_col)
    rows = docs.select(
        key.alias("id"), (F.octet_length(text) + ROW_BYTES).cast("long").alias("size"), F.crc32(text).alias("crc"),
        jump_hash(key, shards).alias("shard"), jump_hash(key, shards + 1).alias("grown"), F.monotonically_increasing_id().alias("row"))
    # written: the row numbers that split ties stay what they are when a task runs again
    rows = materialize(rows, "shard-rows")
    # partition number and rank in the partition, in the order of the sort
    at = F.monotonically_increasing_id()
    rows = materialize(rows.orderBy("shard", "id", "size", "crc", "row").drop("row").withColumn("at", at), "shard-order")
    part = F.shiftright("at", 33)
    runs = rows.groupBy("shard", part.alias("part")).agg(F.min("at").alias("from"), F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("shard").orderBy("part")) - F.col("n")
    runs = runs.select("shard", "part", (before - F.col("from")).alias("shift"))
    out = rows.withColumn("part", part).join(runs, ["shard", "part"])
    return out.select(F.col("id").alias(id_col), "size", F.col("crc").alias("text_crc32"), F.lit("key").alias("law"), "shard",
                      (F.col("at") + F.col("shift")).alias("slot"), F.col("grown").alias("grown_shard"))


def write_shards(docs: DataFrame, path: str, shards: int, id_col: str = "doc_id") -> None:
    """All rows and columns of ``docs`` as one Parquet folder per shard (``shard=<n>``).

    Rows stay in their tasks: a task writes a file per shard it meets, nothing is
    shuffled.  ``docs`` must not have a column ``shard`` of its own (any spelling)."""
    if "shard" in {c.lower() for c in docs.columns}:
        raise ValueError("a column named shard is taken")
    docs.withColumn("shard", jump_hash(F.col(id_col), shards)).write.partitionBy("shard").parquet(path)


#: DuckDB SQL over a table with doc_id, text, for any number of shards.  The jumps are a recursive
#: query in 128-bit arithmetic; the checksum folds the text's bytes over a table made from its polynomial.
SHARDING_SQL = r"""
WITH RECURSIVE bits AS (SELECT i AS byte, i::BIGINT AS c, 0 AS k FROM range(256) r(i)
  UNION ALL SELECT byte, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k + 1 FROM bits WHERE k < 8),
fold AS (SELECT list(c ORDER BY byte) AS t FROM bits WHERE k = 8),
d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM {src}),
j AS (SELECT r, coalesce(doc_id, 0)::HUGEINT & 18446744073709551615 AS key, 0::BIGINT AS b, 0::BIGINT AS nxt FROM d
  UNION ALL
  SELECT r, key2, nxt, CAST(floor((nxt + 1)::DOUBLE * (2147483648.0::DOUBLE / ((key2 >> 33) + 1)::DOUBLE)) AS BIGINT)
  FROM (SELECT r, nxt, CAST((key::UHUGEINT * 2862933555777941757 + 1) & 18446744073709551615 AS HUGEINT) AS key2
        FROM j WHERE nxt <= {shards}) s),
s AS (SELECT r, max(b) FILTER (WHERE b < {shards}) AS shard, max(b) FILTER (WHERE b <= {shards}) AS grown FROM j GROUP BY r),
h AS (SELECT r, doc_id, strlen(text) + 8 AS size, xor(list_reduce(
        list_prepend(4294967295::BIGINT, list_transform(regexp_extract_all(hex(encode(text)), '..'), lambda x: CAST('0x' || x AS BIGINT))),
        lambda a, x: xor(a >> 8, t[(xor(a, x) & 255) + 1])), 4294967295) AS crc FROM d, fold)
SELECT doc_id, CAST(size AS BIGINT) AS size, CAST(crc AS BIGINT) AS text_crc32, 'key' AS law, CAST(shard AS INTEGER) AS shard,
  row_number() OVER (PARTITION BY shard ORDER BY doc_id NULLS FIRST, size, crc) - 1 AS slot, CAST(grown AS INTEGER) AS grown_shard
FROM h JOIN s ON s.r = h.r
"""
