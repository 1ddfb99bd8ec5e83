"""Two-pass external shuffle into shards; DataFrame functions only.

Pass one scatters records uniformly into buckets by a seeded hash; there are
as many buckets as keep each near BUCKET_BYTES (and BUCKET_ROWS), and each is a
partition of that number.  Pass two shuffles each bucket in memory with the
engine's Fisher-Yates array shuffle, seeded by the bucket.
The shuffled buckets, one after the other, are one random order of all records;
record number p of it goes to shard p mod n and is record p div n there.  So
shard sizes differ by one row at most (the law "rows") and slots have no gaps.

Records that are equal in all columns are numbered before scattering, so that a
row repeated many times is spread over the buckets like any other; nothing is
ever dropped.  Bucket sizes are summed up in two levels, within blocks of
BLOCK buckets and over the blocks, so that no task meets them all.

The order follows from the seed, the records, bucket_bytes and bucket_rows, not from the
number of shuffle partitions; the shuffled order is kept in the shared folder before positions
are read from it, so a lost executor cannot mix two orders.

Defined results: null ids and texts are records like others (a null text has no
bytes); equal texts are told apart by their ids, and equal rows are
interchangeable; with fewer records than shards the last shards are empty; a
text longer than BUCKET_BYTES is one record of one bucket; an empty table gives
an empty table; further columns are kept whatever their names, but for shard and slot.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.llm.common import BROADCAST_ROWS, cut

BUCKET_BYTES = 32 << 20
BUCKET_ROWS = 10_000
#: Buckets whose sizes meet in one task.
BLOCK = 4096
SEED = 20240229


def _spread(records: DataFrame) -> DataFrame:
    """records with a column __copy that tells equal rows apart; only rows whose hash repeats are dealt by their columns."""
    names = records.columns
    hashed = records.withColumn("__hash", F.xxhash64(*names))
    repeated = cut(hashed.groupBy("__hash").count().where("count > 1").select("__hash"))
    n = repeated.count()
    if not n:
        return records.withColumn("__copy", F.lit(1))
    right = F.broadcast(repeated) if n <= BROADCAST_ROWS else repeated
    once = hashed.join(right, "__hash", "left_anti").select(*names, F.lit(1).alias("__copy"))
    counted = hashed.join(right, "__hash", "left_semi").groupBy(*names).agg(F.count("*").alias("__copies"))
    return once.unionByName(counted.withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__copies").cast("int")))).drop("__copies"))


def shuffle_into_shards(records: DataFrame, shards: int, size: Column, seed: int = SEED, bucket_bytes: int = BUCKET_BYTES, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """records with shard (0 to shards - 1) and slot (0 on, within the shard).

    size is the bytes of a record, an expression over its columns.  Input columns named shard or slot are replaced.
    """
    records = records.drop("shard", "slot")
    names = records.columns
    total = records.agg(F.coalesce(F.sum(size), F.lit(0)).alias("b"), F.count("*").alias("n")).first()
    buckets = max(1, -(-total["b"] // bucket_bytes), -(-total["n"] // bucket_rows))
    scattered = _spread(records).withColumn("__bucket", F.pmod(F.xxhash64(F.lit(seed), *names, "__copy"), F.lit(buckets)).cast("int"))
    # A bucket is a partition: one that held many would keep all their texts in memory at once, and the engine seeds by partition.
    dealt = scattered.repartitionById(buckets, F.col("__bucket"))
    grouped = dealt.groupBy("__bucket").agg(F.sort_array(F.collect_list(F.struct("__copy", *names))).alias("__rows"))
    # Rows stand in a defined order before the engine's generator runs over them.
    shuffled = grouped.withColumn("__rows", F.shuffle("__rows", F.lit(seed)))
    placed = cut(shuffled.select("__bucket", F.posexplode("__rows").alias("__at", "__row")))
    before = cut(_before(placed.groupBy("__bucket").agg(F.count("*").alias("__n"))))
    joined = placed.join(F.broadcast(before) if buckets <= BROADCAST_ROWS else before, "__bucket")
    position = F.col("__before") + F.col("__at")
    return joined.select("__row.*", position.alias("__p")).drop("__copy").select(*names, (F.col("__p") % shards).cast("int").alias("shard"), F.floor(F.col("__p") / shards).cast("long").alias("slot"))


def _before(sizes: DataFrame) -> DataFrame:
    """(__bucket, __before): the records of all buckets before each, of (__bucket, __n)."""
    blocked = sizes.withColumn("__block", F.floor(F.col("__bucket") / BLOCK).cast("int"))
    earlier = Window.rowsBetween(Window.unboundedPreceding, -1)
    # One row a block, which stands for BLOCK buckets of records each.
    blocks = blocked.groupBy("__block").agg(F.sum("__n").alias("__total")).withColumn("__base", F.coalesce(F.sum("__total").over(earlier.orderBy("__block")), F.lit(0)))
    inside = F.coalesce(F.sum("__n").over(earlier.partitionBy("__block").orderBy("__bucket")), F.lit(0))
    return blocked.withColumn("__inside", inside).join(blocks, "__block").select("__bucket", (F.col("__base") + F.col("__inside")).alias("__before"))


def write_shards(sharded: DataFrame, path: str) -> None:
    """One folder per shard, rows in slot order within each file; a hot shard spreads over as many files as it needs."""
    names = [c for c in sharded.columns if c != "shard"]
    # Slots are dense, so ranges of them are even pieces of a shard.
    sharded.repartitionByRange(F.col("shard"), F.col("slot")).sortWithinPartitions("shard", "slot").select("shard", *names).write.partitionBy("shard").parquet(path)


def digests(docs: DataFrame, shards: int = 24, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document row: the key, size, text_crc32, law, shard, slot and grown_shard, read from the records as placed.

    Whole records go through both passes; the shuffled buckets are kept in the shared folder.
    """
    body = F.coalesce(F.col("text"), F.lit(""))
    size = (F.octet_length(body) + 8).cast("long")
    placed = shuffle_into_shards(docs.select(F.col(key).alias("key"), F.col(text).alias("text")), shards, size)
    return placed.select(F.col("key").alias(key), size.alias("size"), F.crc32(body.cast("binary")).alias("text_crc32"), F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
