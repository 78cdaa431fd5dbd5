"""Sharding by proportional stratified interleaving, in DataFrame functions only.

Rows of each source are put in a seeded random order and given the fractional rank
(r + u) / n of their source, with u in [0, 1) from the row's seeded hash. Sorted by that
fraction, every source is spread evenly over the whole sequence, so each of the equal cuts
holds the mixture of the corpus: of any stretch a source has its share, to within two rows.
A fixed u would give all rows of one-row sources the same fraction, hence one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagelattice.operators.ranking import bucket_count, bucketed_rank
from pagelattice.runtime import materialize

SHARDS = 24
SEED = "shard-1"


def shard_rows(
    docs: DataFrame,
    shards: int = SHARDS,
    seed: str = SEED,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
) -> DataFrame:
    """Deal every row into ``shards`` shards whose row counts differ by one at most.

    Returns ``doc_id, size, text_crc32, law, shard, slot, grown_shard, source,
    position``; ``law`` is ``rows`` and ``grown_shard`` null. A null text counts as
    empty; a null source is one stratum with the empty source; null ids hash as the
    empty string, with the text's checksum and size, so rows without ids spread over all
    buckets. Repeated rows are kept, each in a slot of its own; rows equal in id,
    text and source are interchangeable, so ties cannot change the result. An empty
    table gives no rows. Other columns of ``docs`` are ignored.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    narrow = materialize(
        docs.select(
            F.col(id_col).alias("doc_id"),
            (F.octet_length(text) + F.lit(8)).cast("long").alias("size"),
            F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"),
            F.coalesce(F.col(source_col).cast("string"), F.lit("")).alias("source"),
        ).withColumn("h", F.md5(F.concat_ws(":", F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "text_crc32", "size"))),
        "shard",
    )
    total = narrow.count()
    buckets = bucket_count(total)
    head, tail = (F.conv(F.substring("h", at, 8), 16, 10).cast("long") for at in (1, 9))
    rows = narrow.withColumn("b", F.shiftright(head * F.lit(buckets), 32).cast("int"))
    ranked = bucketed_rank(rows, ["source"], "b", ["h", "doc_id", "text_crc32", "size"], "r")
    sizes = narrow.groupBy("source").agg(F.count(F.lit(1)).alias("n"))
    parts = (
        ranked.join(sizes, "source")
        .withColumn("frac", (F.col("r") + tail / F.lit(float(1 << 32))) / F.col("n"))
        .withColumn("b", F.least(F.floor(F.col("frac") * F.lit(buckets)), F.lit(buckets - 1)).cast("int"))
    )
    placed = bucketed_rank(parts, [], "b", ["frac", "source", "h", "doc_id", "text_crc32", "size"], "position")
    shard = F.expr(f"(position * {shards}L) div {max(total, 1)}L")
    return placed.withColumn("shard", shard).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        F.col("shard").cast("int").alias("shard"),
        (F.col("position") - F.expr(f"(shard * {total}L + {shards - 1}L) div {shards}L")).alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
        "source",
        "position",
    )


def op3_sharding(spark, sf_dir: str) -> DataFrame:
    return shard_rows(spark.read.parquet(f"{sf_dir}/documents.parquet"))


#: CRC-32 is folded byte by byte over the hexadecimal form of the text's UTF-8 bytes.
OP3_SQL = f"""
WITH crc_table AS (
  SELECT list(c ORDER BY i) AS t FROM (
    SELECT i, list_reduce(list_concat([i], range(8)), lambda c, k:
      CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END) AS c
    FROM (SELECT unnest(range(256)) AS i))),
base AS (
  SELECT doc_id, coalesce(source, '') AS source, hex(encode(coalesce(text, ''))) AS hx
  FROM documents),
sized AS (
  SELECT doc_id, source, CAST(length(hx) // 2 + 8 AS BIGINT) AS size,
    xor(list_reduce(list_concat([4294967295], list_transform(regexp_extract_all(hx, '..'), lambda x: CAST('0x' || x AS BIGINT))),
      lambda c, b: xor(c // 256, t[xor(c, b) % 256 + 1])), 4294967295) AS text_crc32
  FROM base, crc_table),
hashed AS (
  SELECT *, md5('{SEED}:' || coalesce(CAST(doc_id AS VARCHAR), '') || ':' || text_crc32 || ':' || size) AS h FROM sized),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY source ORDER BY h, doc_id, text_crc32, size) - 1 AS r,
         count(*) OVER (PARTITION BY source) AS n, count(*) OVER () AS total FROM hashed),
placed AS (
  SELECT *, row_number() OVER (ORDER BY (r + CAST(CAST('0x' || substr(h, 9, 8) AS BIGINT) AS DOUBLE) / 4294967296) / n, source, h, doc_id, text_crc32, size) - 1 AS position FROM ranked)
SELECT doc_id, size, text_crc32, 'rows' AS law, CAST((position * {SHARDS}) // total AS INTEGER) AS shard,
  position - (((position * {SHARDS}) // total) * total + {SHARDS - 1}) // {SHARDS} AS slot,
  CAST(NULL AS INTEGER) AS grown_shard, source, position
FROM placed
"""
