"""Small helpers that the corpus operators share."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Rows in one Arrow batch. Texts are long, so the default of 10,000 rows would hold too much at once.
BATCH_ROWS = 500
#: A group with at least this share of the rows is hot; at most 1/SUPPORT groups are.
SUPPORT = 1 / 2000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def prepare(spark: SparkSession) -> SparkSession:
    """Small Arrow batches, and the checkpoint folder that the session names in spark.checkpoint.dir. Where it names none, a session
    on this machine alone gets a folder here, and a cluster an error."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        shared = context.getConf().get("spark.checkpoint.dir")
        if not shared and not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(shared or os.path.join(tempfile.gettempdir(), "corpus-lineage"))
    return spark


def stored(df: DataFrame) -> DataFrame:
    """The rows, written once as Parquet in the shared folder and read from there: lost executors cost nothing that has been written."""
    path = f"{df.sparkSession.sparkContext.getCheckpointDir()}/table-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.parquet(path)


#: Keys up to so many are sent to all executors; numbers, so some megabytes at most.
MOST_KEYS = 200_000


def only(rows: DataFrame, keys: DataFrame, column: str) -> DataFrame:
    """The rows whose number in the column is among the keys, a table of few columns that has been written. Keys up to MOST_KEYS, by their count, are
    broadcast, so that rows stay where they are."""
    keys = keys.select(column)
    return rows.join(F.broadcast(keys) if keys.count() <= MOST_KEYS else keys, column, "left_semi")


#: Sums of tasks are added up in so many groups before they reach the driver.
SLOTS = 32


def summed(rows: DataFrame, work: Callable[[pa.RecordBatch], np.ndarray], length: int, whole: bool = False) -> np.ndarray:
    """work's arrays of one length, whole numbers or doubles, added up over the batches of a task, over tasks, and on the driver over SLOTS groups of
    tasks."""
    kind, item, schema = (np.int64, pa.int64(), "sums array<long>") if whole else (np.float64, pa.float64(), "sums array<double>")

    def table(total: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([total], pa.list_(item))], ["sums"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(length, kind)
        for batch in batches:
            if batch.num_rows:
                total += work(batch)
        yield table(total)

    def merge(parts: pa.Table) -> pa.Table:
        return pa.Table.from_batches([table(np.sum(np.stack(parts.column("sums").to_numpy()), axis=0))])

    each = rows.mapInArrow(add, schema).withColumn("slot", F.spark_partition_id() % SLOTS)
    merged = each.groupBy("slot").applyInArrow(merge, schema).collect()
    return np.sum([np.array(r["sums"], kind) for r in merged], axis=0) if merged else np.zeros(length, kind)


def unused(df: DataFrame, *names: str) -> list[str]:
    """The names, longer by underscores where df has such a column."""
    taken, found = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        found.append(name)
    return found


def ascii_lower(text: Column) -> Column:
    """A-Z to a-z and nothing else; null becomes the empty text."""
    return F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)


def join_groups(rows: DataFrame, groups: DataFrame, keys: list[str], size: str, support: float = SUPPORT) -> DataFrame:
    """rows, left-joined with a table of groups that has one row for some keys and the group's number of rows in `size`.

    Hot groups, at most 1/support, are broadcast, so that their rows are joined where they lie; the others are shuffled. Rows are
    read more than once: hand in a checkpoint or a plain scan.
    """
    least = max(1, rows.count()) * support
    hot = groups.filter(F.col(size) >= least).checkpoint()
    light = groups.filter(F.col(size) < least)
    if hot.isEmpty():
        return rows.join(light, keys, "left")
    cold = rows.join(F.broadcast(hot.select(*keys)), keys, "left_anti").join(light, keys, "left")
    return rows.join(F.broadcast(hot), keys).unionByName(cold)


def as_text(value: str | None) -> str:
    return value or ""
