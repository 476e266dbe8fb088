"""Results that arrive as files, appended once per id."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from corpusloom.schema import RECORD


def arriving(spark: SparkSession, folder: str, files_per_trigger: int = 64) -> DataFrame:
    """New JSON Lines files of a folder."""
    return spark.readStream.schema(RECORD).option("maxFilesPerTrigger", files_per_trigger).json(folder)


def first_by_id(stream: DataFrame, time_col: str, delay: str = "90 days") -> DataFrame:
    """The first record of each id, where records have an event time.

    State is dropped after `delay`; records later than that are dropped too.
    Without such a bound use `ingest`, which keeps no state.
    """
    return stream.where("id is not null").withWatermark(time_col, delay).dropDuplicatesWithinWatermark(["id"])


def _known(spark: SparkSession, folder: str) -> DataFrame | None:
    try:
        return spark.read.parquet(folder)
    except Exception as e:  # nothing stored yet
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return None


def ingest(stream: DataFrame, target: str, state: str) -> StreamingQuery:
    """Appends records whose id is not stored yet to JSON Lines and stops when all files present are read.

    Records without an id are left out. A micro-batch is held against the ids
    stored by the others, a Parquet table beside the target, so nothing is kept
    in memory between batches and no record is too late. Each batch writes a
    folder of its own, so a batch that is run again after a loss replaces what
    it wrote before.
    """

    def store(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        fresh = batch.where("id is not null").dropDuplicates(["id"])
        known = _known(spark, f"{target}.ids")
        if known is not None:
            fresh = fresh.join(known.where(f"batch <> {number}").select("id"), "id", "left_anti").select(*batch.columns)
        fresh.write.mode("overwrite").json(f"{target}/batch={number}", ignoreNullFields=False)
        spark.read.schema(batch.schema).json(f"{target}/batch={number}").select("id").write.mode("overwrite").parquet(f"{target}.ids/batch={number}")

    return stream.writeStream.foreachBatch(store).option("checkpointLocation", state).trigger(availableNow=True).start()
