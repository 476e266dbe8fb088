"""Pending requests: the map of ids to labels, and a batch service as a data source."""

from __future__ import annotations

import importlib
import json
import os
import time
from collections.abc import Iterator
from typing import Protocol

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from corpusloom.operators import bookkeeping
from corpusloom.schema import META, RECORD
from corpusloom.sources import corpora


def read_pending(spark: SparkSession, path: str) -> DataFrame:
    """JSON objects id -> labels, one per line, as rows; broken lines give none."""
    return explode_pending(spark.read.text(path), "value")


def explode_pending(df: DataFrame, column: str) -> DataFrame:
    """id and label columns of a JSON map column; broken or null maps give no rows."""
    meta = T.StructType([f for f in META.fields if f.name != "id"])
    pairs = F.explode(F.from_json(column, T.MapType(T.StringType(), meta)))
    return df.select(pairs.alias("id", "meta")).select("id", "meta.*")


def write_pending(df: DataFrame, path: str) -> None:
    """The map as JSON objects of one id each, one per line; read_pending reads them all."""
    names = [f.name for f in META.fields if f.name != "id"]
    entry = F.map_from_arrays(F.array("id"), F.array(F.struct(*names)))
    df.select(F.to_json(entry).alias("value")).write.mode("overwrite").text(path)


def describe_pending(batches: DataFrame) -> DataFrame:
    """Arm, rows, ids of the pending table by the `arm` of its JSON labels; {} and null have none."""
    arm = F.get_json_object("meta", "$.arm")
    return batches.groupBy(arm.alias("arm")).agg(F.count("*").alias("rows"), F.count_distinct("id").alias("ids"))


class Provider(Protocol):
    """What a batch service must offer; tests inject one without a network."""

    def submit(self, folder: str) -> str: ...

    def status(self, batch: str) -> dict: ...

    def parts(self, batch: str) -> list[str]: ...

    def results(self, batch: str, part: str) -> Iterator[dict]: ...


class _Part(InputPartition):
    def __init__(self, batch: str, part: str):
        self.batch, self.part = batch, part


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        module, name = options["provider"].split(":")
        self.target, self.batch, self.arguments = (module, name), options["batch"], json.loads(options.get("arguments", "{}"))

    def _provider(self) -> Provider:
        return getattr(importlib.import_module(self.target[0]), self.target[1])(**self.arguments)

    def partitions(self) -> list[_Part]:
        return [_Part(self.batch, p) for p in self._provider().parts(self.batch)]

    def read(self, partition: _Part) -> Iterator[tuple]:
        for r in self._provider().results(partition.batch, partition.part):
            yield (r.get("custom_id"), r.get("content") or [], r.get("stop_reason"), (r.get("input_tokens"), r.get("output_tokens")))


class FolderService:
    """A service without a network, for tests: a batch is a folder of request files, each answered line by line."""

    def __init__(self, root: str):
        self.root = root.removeprefix("file:").replace("///", "/")

    def submit(self, folder: str) -> str:
        batch = f"batch-{abs(hash(folder)) % 10**8:08d}"
        os.makedirs(self.root, exist_ok=True)
        with open(f"{self.root}/{batch}", "w") as f:
            f.write(folder.removeprefix("file:").replace("///", "/"))
        return batch

    def status(self, batch: str) -> dict:
        return {"state": "ended", "parts": len(self.parts(batch))}

    def parts(self, batch: str) -> list[str]:
        with open(f"{self.root}/{batch}") as f:
            folder = f.read()
        return sorted(f"{folder}/{n}" for n in os.listdir(folder) if n.startswith("part-"))

    def results(self, batch: str, part: str) -> Iterator[dict]:
        with open(part) as f:
            for line in f:
                asked = json.loads(line)
                prompt = json.loads(asked["params"])["messages"][0]["content"]
                yield {"custom_id": asked["custom_id"], "content": [{"type": "text", "text": f" {prompt} "}, {"type": "aside", "text": "x"}], "stop_reason": "end_turn", "input_tokens": len(prompt), "output_tokens": 1}


class BatchResults(DataSource):
    """Results of a finished batch; options `provider` ("module:class"), `batch`, `arguments` (JSON).

    One partition per part of the batch, read where it runs.
    """

    @classmethod
    def name(cls) -> str:
        return "corpusloom_batch"

    def schema(self) -> str:
        return "custom_id string, content array<struct<type:string,text:string>>, stop_reason string, usage struct<input_tokens:bigint,output_tokens:bigint>"

    def reader(self, schema: T.StructType) -> _Reader:
        return _Reader(self.options)


# --------------------------------------------------------------------------
# one round: submit, wait, collect


def _read_if_there(spark: SparkSession, path: str) -> list[str]:
    try:
        return [r["value"] for r in spark.read.text(path).limit(2).collect()]
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return []


def submit(grid: DataFrame, service: Provider, folder: str, model: str, max_tokens: int) -> str:
    """Sends the grid's rows (id, labels, prompt) as one batch and returns its id.

    Requests and the map of pending ids are written by the executors; the
    service is told their folder. A batch that is not collected yet is refused.
    """
    spark = grid.sparkSession
    if _read_if_there(spark, f"{folder}/batch"):
        raise ValueError("a batch is not collected yet")
    requests = bookkeeping.requests(grid, model, max_tokens)
    requests.write.mode("overwrite").json(f"{folder}/requests")
    labels = [F.lit(None).cast(f.dataType).alias(f.name) if f.name not in grid.columns else F.col(f.name) for f in META.fields]
    write_pending(grid.select(*labels), f"{folder}/pending")
    batch = service.submit(f"{folder}/requests")
    spark.createDataFrame([(batch,)], "value string").coalesce(1).write.mode("overwrite").text(f"{folder}/batch")
    return batch


def poll(service: Provider, batch: str, seconds: float = 60, most: int | None = None) -> dict:
    """Waits until the batch has ended and returns its status; after `most` looks it raises."""
    looks = 0
    while True:
        status = service.status(batch)
        if status.get("state") == "ended":
            return status
        looks += 1
        if most is not None and looks >= most:
            raise TimeoutError(f"{batch} has not ended: {status}")
        time.sleep(seconds)


def collect(spark: SparkSession, folder: str, provider: str, arguments: dict, target: str) -> DataFrame:
    """The batch's results with their labels, appended to `target` unless their id is stored, and read back.

    Results without a pending id are dropped. The batch counts as collected afterwards.
    """
    spark.dataSource.register(BatchResults)
    batch = _read_if_there(spark, f"{folder}/batch")[0]
    results = spark.read.format(BatchResults.name()).option("provider", provider).option("batch", batch).option("arguments", json.dumps(arguments)).load()
    answers = results.select("custom_id", bookkeeping.flatten_response("content").alias("proof"), "stop_reason", "usage")
    rows = bookkeeping.attach_meta(answers, read_pending(spark, f"{folder}/pending"))
    fields = [F.col(f.name) if f.name in rows.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in RECORD.fields]
    corpora.append_new(rows.select(*fields), target)
    spark.createDataFrame([], "value string").write.mode("overwrite").text(f"{folder}/batch")
    return corpora.read_jsonl(spark, target)
