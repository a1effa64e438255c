"""Feature extraction over a growing folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from trackspark import schema as S
from trackspark.operators import signals
from trackspark.plans.extract import extract_listed, opens_files
from trackspark.session import materialise, releasing
from trackspark.sources.catalog import name_filter

_FILE = "path string, modificationTime timestamp, length bigint, content binary"


def file_stream(
    spark: SparkSession,
    directory: str,
    suffixes=S.AUDIO_SUFFIXES,
    files_per_batch: int = S.SAVE_EVERY,
) -> DataFrame:
    """New audio files below ``directory``, at most ``files_per_batch`` at a time."""
    return (
        spark.readStream.format("binaryFile")
        .schema(_FILE)
        .option("recursiveFileLookup", True)
        .option("pathGlobFilter", name_filter(suffixes))
        .option("maxFilesPerTrigger", files_per_batch)
        .load(directory)
    )


def start_extraction(
    spark: SparkSession,
    directory: str,
    output: str,
    checkpoint: str,
    suffixes=S.AUDIO_SUFFIXES,
    files_per_batch: int = S.SAVE_EVERY,
    sr: int = S.SAMPLE_RATE,
    chunk: int = signals.CHUNK_SAMPLES,
    trigger: dict | None = None,
    reader: str = "auto",
) -> StreamingQuery:
    """Append the features of new files to ``output``; failures go beside them.

    Results are saved per micro-batch. Each batch owns the folder ``batch_id=N`` and
    overwrites it, so a batch repeated after a failure leaves no duplicates. Read the
    tables with :func:`extracted` and :func:`failures`.
    """

    ranged = opens_files(spark, directory, reader)
    files = file_stream(spark, directory, suffixes, files_per_batch)
    files = files.select("path", "length") if ranged else files  # a batch holds what its stream selects

    def save(batch: DataFrame, batch_id: int) -> None:
        with releasing():
            rows = materialise(extract_listed(batch, ranged, sr, chunk))
            good, bad = rows.where("error is null").drop("error"), rows.where("error is not null")
            good.write.mode("overwrite").parquet(f"{output}/features/batch_id={batch_id}")
            bad.select("file_path", "error").write.mode("overwrite").parquet(
                f"{output}/failed/batch_id={batch_id}"
            )

    return (
        files.writeStream.foreachBatch(save)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )


def extracted(spark: SparkSession, output: str) -> DataFrame:
    return spark.read.schema(S.FEATURE_SCHEMA).parquet(f"{output}/features").select(*S.FEATURE_SCHEMA.names)


def failures(spark: SparkSession, output: str) -> DataFrame:
    return spark.read.schema("file_path string, error string").parquet(f"{output}/failed").select(
        F.col("file_path"), "error"
    )
