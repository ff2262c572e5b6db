"""Sharding by a keyed permutation of global row numbers.

Every row gets a global row number; a Feistel network over Z_a x Z_b, walked until it lands
inside the table, permutes the numbers. Shard and slot are the remainder and the quotient of the
permuted number, so shard sizes differ by one row at most, the order looks shuffled, the same
table gives the same layout again, and a row's place can be computed (and inverted) from its number.

The row number needs no total sort: rows hash into a fixed number of buckets, the buckets' counts
(a table of fixed size) give offsets, and the rank inside the bucket does the rest.
"""

from __future__ import annotations

import math
from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import durable, text_of

#: Three hex digits of a digest; the number of buckets, and of rows broadcast, is 16 ** 3.
BUCKET_DIGITS = 3
ROUNDS = 4
SEED = "shuffle-1"


def _round(value: Column, key: str, modulus: int) -> Column:
    """48 bits of a digest of the value under the round's key."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{key}:"), value.cast("string"))), 1, 12), 16, 10).cast("long") % F.lit(modulus)


def sides(n: int) -> tuple[int, int]:
    """Sides of the smallest near-square grid that holds n numbers."""
    a = max(1, math.isqrt(max(0, n - 1)) + 1)
    return a, max(1, -(-n // a))


def permute(x: Column, n: int, seed: str = SEED, rounds: int = ROUNDS) -> Column:
    """One pass of the network over the grid that holds [0, n)."""
    a, b = sides(n)
    left, right = F.floor(x / F.lit(b)).cast("long") if n > 2**50 else (x - x % F.lit(b)) / F.lit(b), x % F.lit(b)
    left = left.cast("long")
    for k in range(rounds):
        if k % 2 == 0:
            left = (left + _round(right, f"{seed}:{k}", a)) % F.lit(a)
        else:
            right = (right + _round(left, f"{seed}:{k}", b)) % F.lit(b)
    return left * F.lit(b) + right


def permuted(df: DataFrame, number: str, n: int, out: str, seed: str = SEED, rounds: int = ROUNDS) -> DataFrame:
    """Adds ``out``, the permuted ``number``; numbers and results are those of [0, n).

    A result beyond the table is permuted again. A walk meets each of the a * b - n outside numbers
    once at most before it is back inside, so the bound below is always enough.
    """
    a, b = sides(n)
    first = df.withColumn(out, permute(F.col(number), n, seed, rounds))
    if a * b <= n:
        return first
    steps = F.when(F.col(out) < n, F.array().cast("array<int>")).otherwise(F.sequence(F.lit(1), F.lit(a * b - n + 1)))
    return first.withColumn(out, F.aggregate(steps, F.col(out), lambda at, _: F.when(at < n, at).otherwise(permute(at, n, seed, rounds))))


def shard(docs: DataFrame, n_shards: int = 8, seed: str = SEED) -> DataFrame:
    """Places every row of ``docs`` (doc_id, text) in a shard and a slot.

    Returns doc_id, size (UTF-8 bytes + 1), text_crc32, law ('rows'), shard, slot (0 .. rows of the
    shard - 1), grown_shard (null: this law keeps no row in place when shards are added).

    Null texts have no bytes: size 1, checksum 0. A null doc_id is a value like any other. Rows
    repeated with the same id and text are separate rows with places of their own. An empty table
    gives an empty result; other columns are not read.
    """
    raw = F.encode(text_of(), "UTF-8")
    rows = docs.select(F.col("doc_id").alias("doc_id"), (F.octet_length(text_of()) + F.lit(1)).cast("long").alias("size"), F.crc32(raw).alias("text_crc32"))
    digest = F.md5(F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.col("text_crc32").cast("string"), F.col("size").cast("string")))
    rows = durable(rows.withColumn("_bucket", F.conv(F.substring(digest, 1, BUCKET_DIGITS), 16, 10).cast("int")))

    counts = sorted((r["_bucket"], r["n"]) for r in rows.groupBy("_bucket").agg(F.count("*").alias("n")).collect())  # 16 ** 3 rows at most
    total = sum(c for _, c in counts)
    offsets = [(bucket, before) for (bucket, _), before in zip(counts, accumulate((c for _, c in counts), initial=0), strict=False)]
    offset = docs.sparkSession.createDataFrame(offsets, "_bucket int, _before long")

    within = Window.partitionBy("_bucket").orderBy("doc_id", "text_crc32", "size")
    numbered = rows.withColumn("_rank", F.row_number().over(within) - 1).join(F.broadcast(offset), "_bucket")
    placed = permuted(numbered.withColumn("_number", F.col("_before") + F.col("_rank")), "_number", total, "_place", seed)
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"),
        (F.col("_place") % n_shards).cast("int").alias("shard"),
        ((F.col("_place") - F.col("_place") % n_shards) / n_shards).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )


def _permute_sql(x: str, seed: str = SEED, rounds: int = ROUNDS) -> str:
    part = lambda value, k, side: f"(CAST('0x' || substr(md5('{seed}:{k}:' || CAST({value} AS VARCHAR)), 1, 12) AS BIGINT) % {side})"
    left, right = f"({x} // b)", f"({x} % b)"
    for k in range(rounds):
        if k % 2 == 0:
            left = f"(({left} + {part(right, k, 'a')}) % a)"
        else:
            right = f"(({right} + {part(left, k, 'b')}) % b)"
    return f"({left} * b + {right})"


#: The checksum's table follows from its polynomial; DuckDB has no function for it.
ORACLE_SQL = f"""
WITH RECURSIVE crc_table AS (
  SELECT list(c ORDER BY i) AS t FROM (
    SELECT i, list_reduce(list_prepend(i, [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]),
      lambda c, z: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END) AS c
    FROM (SELECT unnest(range(256)) AS i))
), bytes AS (
  SELECT doc_id, octet_length(encode(coalesce(text, ''))) + 1 AS size, hex(encode(coalesce(text, ''))) AS h FROM documents
), summed AS (
  SELECT doc_id, size, xor(4294967295::BIGINT, list_reduce(list_prepend(4294967295::BIGINT,
      list_transform(range(0, length(h), 2), lambda i: CAST('0x' || substr(h, i + 1, 2) AS BIGINT))),
      lambda c, z: xor(c // 256, t[xor(c % 256, z) + 1]))) AS text_crc32
  FROM bytes, crc_table
), numbered AS (
  SELECT *, row_number() OVER (ORDER BY substr(md5(concat_ws(':', coalesce(CAST(doc_id AS VARCHAR), 'null'), CAST(text_crc32 AS VARCHAR), CAST(size AS VARCHAR))), 1, {BUCKET_DIGITS}),
    doc_id, text_crc32, size) - 1 AS number, count(*) OVER () AS n FROM summed
), grid AS (
  SELECT *, CAST(ceil(n / CAST(a AS DOUBLE)) AS BIGINT) AS b FROM (SELECT *, CAST(ceil(sqrt(n)) AS BIGINT) AS a FROM numbered)
), walk AS (
  SELECT *, {_permute_sql("number")} AS place FROM grid
  UNION ALL
  SELECT doc_id, size, text_crc32, number, n, a, b, {_permute_sql("place")} FROM walk WHERE place >= n
)
SELECT doc_id, CAST(size AS BIGINT) AS size, CAST(text_crc32 AS BIGINT) AS text_crc32, 'rows' AS law, CAST(place % 8 AS INTEGER) AS shard,
  CAST(place // 8 AS BIGINT) AS slot, CAST(NULL AS INTEGER) AS grown_shard
FROM walk WHERE place < n
"""
