"""Exact deduplication with streaming state on disk.

A stream of fingerprints (digest, id, locator, length) runs through a keyed aggregation
whose state lives in RocksDB and never expires. Per digest it keeps which row stays, where that row's
text is found, and how many rows there are. A second step goes back to the texts and
compares the full bytes of every hit with the row that stays.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from trackspark.llm.shared import SPACES, new_path, write_table

ROCKSDB = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
}

KEYS_PER_STORE = 500_000
STATE = "digest string, stays struct<n_points:int,known:boolean,low:bigint,id:bigint,locator:string>, n bigint"


def normalised(text: Column | str) -> Column:
    """The text without the characters `[\\x20\\x09-\\x0D]`; null counts as empty."""
    c = F.col(text) if isinstance(text, str) else text
    return F.translate(F.coalesce(c, F.lit("")), SPACES, "")


def sha256(text: Column) -> Column:
    return F.sha2(text, 256)


def fingerprints(docs: DataFrame, id_col="doc_id", text_col="text", digest=sha256) -> DataFrame:
    """``digest, id, locator, n_points``: the locator names the file a row was read from ('' for none)."""
    return docs.select(
        digest(normalised(text_col)).alias("digest"),
        F.col(id_col).alias("id"),
        F.input_file_name().alias("locator"),
        F.length(F.coalesce(F.col(text_col), F.lit(""))).alias("n_points"),
    )


@contextmanager
def _rocksdb(spark: SparkSession, partitions: int | None) -> Iterator[None]:
    wanted = ROCKSDB | ({"spark.sql.streaming.internal.stateStore.partitions": str(partitions)} if partitions else {})
    before = {k: spark.conf.get(k, None) for k in wanted}
    for k, v in wanted.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def track(prints: DataFrame, state: str, out: str, partitions: int | None = None) -> StreamingQuery:
    """Run a stream of :func:`fingerprints` through the keyed state in folder ``state``.

    Every micro-batch writes its changed digests to ``out/batch=N`` (a repeated batch overwrites
    its own folder). Started again on the same folders, it goes on where it ended, with
    everything seen before still in the state.
    """
    # The bitwise complement reverses the order of ids without overflow; null ids come last.
    order = F.struct(
        "n_points", F.col("id").isNotNull().alias("known"), F.bitwise_not("id").alias("low"), "id", "locator"
    )
    state_rows = prints.groupBy("digest").agg(F.max(order).alias("stays"), F.count("*").alias("n"))

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")

    with _rocksdb(prints.sparkSession, partitions):
        return (
            state_rows.writeStream.outputMode("update")
            .foreachBatch(write)
            .option("checkpointLocation", state)
            .trigger(availableNow=True)
            .start()
        )


def tracked(spark: SparkSession, out: str) -> DataFrame:
    """Latest state per digest: ``digest, keep_id, locator, group_size``."""
    rows = spark.read.schema(f"{STATE}, batch bigint").parquet(out)
    last = rows.groupBy("digest").agg(F.max_by(F.struct("stays", "n"), "batch").alias("s"))
    return last.select(
        "digest", F.col("s.stays.id").alias("keep_id"), F.col("s.stays.locator").alias("locator"), F.col("s.n").alias("group_size")
    )


def _texts(docs: DataFrame, id_col: str, text_col: str, digest) -> DataFrame:
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.length(text).alias("n_points"), normalised(text_col).alias("bytes"))
    return rows.withColumn("digest", F.coalesce(digest(F.col("bytes")), F.lit("")))


def _with_texts(texts: DataFrame, keepers: DataFrame) -> DataFrame:
    """``keepers`` with the bytes of the row that stays, where a group has more than one row.

    The id is compared in a form that is no join key, so that this join and the next one read one and the same
    exchange of the texts by digest. The few rows found are dealt out anew before they are
    grouped, which leaves Spark free to split a digest that many rows share.
    """
    is_keeper = F.size(F.array_distinct(F.array("doc_id", "keep_id"))) == 1
    found = texts.join(keepers.where("group_size > 1").select("digest", "keep_id"), "digest").where(is_keeper)
    found = found.select("digest", "n_points", "bytes").repartition("digest")
    found = found.groupBy("digest").agg(F.max_by("bytes", "n_points").alias("kept_bytes"))
    return keepers.select("digest", "keep_id", "group_size").join(found, "digest", "left")


def _keepers(docs: DataFrame, id_col: str, text_col: str, digest) -> DataFrame:
    """What the stream's state says of every digest, as a table."""
    spark = docs.sparkSession
    prints = write_table(fingerprints(docs, id_col, text_col, digest), "prints")
    out = new_path(spark, "tracked")
    spark.createDataFrame([], STATE).write.parquet(f"{out}/batch=-1")
    if files := prints.inputFiles():
        stores = max(spark.sparkContext.defaultParallelism, -(-prints.count() // KEYS_PER_STORE))
        stream = spark.readStream.schema(prints.schema).parquet(files[0].rpartition("/")[0])
        track(stream, new_path(spark, "state"), out, stores).awaitTermination()
    return write_table(tracked(spark, out), "keepers")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest=sha256) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, keep_id, group_size, kept, text_sha256``.

    Of equal texts the one with the most code points before normalising stays, then the
    smallest id; null ids come last. Rows that repeat an id and a text are all one group, and each row
    with the keeper's id and text counts as kept. Null and empty texts are equal. An empty table gives no
    rows. Other columns are ignored. Texts that share a digest but differ in bytes are told
    apart and grouped by their bytes.

    Only fingerprints go through the stream and its shuffle; texts are shuffled once, by
    digest, and a digest that many rows share is split by Spark's skew handling, since
    it meets one keeper.
    """
    keepers = _keepers(docs, id_col, text_col, digest)
    texts = _texts(docs, id_col, text_col, digest)
    checked = texts.join(_with_texts(texts, keepers), "digest")
    same = F.coalesce(F.col("bytes") == F.col("kept_bytes"), F.lit(True))
    rows = write_table(
        checked.select(
            "doc_id", "n_points", "keep_id", "group_size", "digest",
            same.alias("same"), F.when(~same, F.col("bytes")).alias("other"),
            sha256(F.when(~same, F.col("bytes"))).alias("other_sha256") if digest is not sha256 else F.lit(None).cast("string").alias("other_sha256"),
            F.col("digest").alias("text_sha256") if digest is sha256 else sha256(F.col("bytes")).alias("text_sha256"),
        ),
        "checked",
    )
    out_cols = ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
    kept = F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept")
    if rows.where("not same").isEmpty():
        return rows.select("doc_id", "keep_id", "group_size", kept, "text_sha256")
    sizes = rows.where("same").groupBy("digest").agg(F.count("*").alias("true_size"))
    plain = rows.where("same").join(sizes, "digest").select("doc_id", "keep_id", F.col("true_size").alias("group_size"), "text_sha256")
    odd = rows.where("not same")
    order = F.struct("n_points", F.col("doc_id").isNotNull(), F.bitwise_not("doc_id"))
    groups = odd.groupBy("digest", "other").agg(F.max_by("doc_id", order).alias("k"), F.count("*").alias("n"))
    apart = odd.join(groups, ["digest", "other"]).select("doc_id", F.col("k").alias("keep_id"), F.col("n").alias("group_size"), "text_sha256")
    return plain.unionByName(apart).withColumn("kept", kept).select(*out_cols)


def without_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, with all their columns, that :func:`exact_dedup` keeps.

    A row that shares a keeper's digest but not its bytes stays. The texts are shuffled once here too.
    """
    keepers = _keepers(docs, id_col, text_col, sha256)
    row = F.col("row")
    digest = F.coalesce(sha256(normalised(text_col)), F.lit(""))
    texts = docs.select(digest.alias("digest"), F.struct("*").alias("row"))  # whatever the columns are called
    text = row[text_col]
    is_keeper = F.size(F.array_distinct(F.array(row[id_col], "keep_id"))) == 1
    found = texts.join(keepers.where("group_size > 1").select("digest", "keep_id"), "digest").where(is_keeper)
    found = found.select("digest", F.length(F.coalesce(text, F.lit(""))).alias("n"), normalised(text).alias("b"))
    found = found.repartition("digest").groupBy("digest").agg(F.max_by("b", "n").alias("kept_bytes"))
    told = texts.join(keepers.select("digest", "keep_id", "group_size").join(found, "digest", "left"), "digest")
    stays = is_keeper | F.coalesce(normalised(text) != F.col("kept_bytes"), F.lit(False))
    return told.where(stays).select("row.*")
