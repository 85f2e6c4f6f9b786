"""What the operators of this package share: the shared folder, staged tables, Arrow batch sizes and deterministic folds."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.plans.cut import going_with_the_driver, shared_folder

#: Rows of one Arrow batch sent to a Python worker. Texts may be long, so batches are short.
BATCH_ROWS = 128
BATCH_BYTES = 16 << 20
#: Bytes that a task gathers of a staged table before it writes them; Parquet's own default is 128 MB.
ROW_GROUP = 16 << 20

def staged(df: DataFrame, label: str) -> DataFrame:
    """df written once as Parquet to the shared folder and read again: it cuts lineage, survives lost executors and lets AQE see sizes.
    The files go when no step reads them any more (dropped()), at the latest with the driver."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.option("parquet.block.size", ROW_GROUP).parquet(path)
    going_with_the_driver(spark, path)
    out = spark.read.schema(df.schema).parquet(path)
    out._cairn_path = path
    return out


def grown(table: DataFrame | None, df: DataFrame, label: str) -> DataFrame:
    """A staged table with the rows of df added to it; a new one if there is none yet."""
    if table is None:
        return staged(df, label)
    df.write.mode("append").option("parquet.block.size", ROW_GROUP).parquet(table._cairn_path)
    out = df.sparkSession.read.schema(df.schema).parquet(table._cairn_path)
    out._cairn_path = table._cairn_path
    return out


def dropped(*tables: DataFrame) -> None:
    """Delete the files of staged tables that no later step reads."""
    for df in tables:
        if path := getattr(df, "_cairn_path", None):
            spark = df.sparkSession
            hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
            hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop, True)


def without(docs: DataFrame, id_col: str, ids: DataFrame) -> DataFrame:
    """The rows of docs whose id isn't among ids (one column), whatever the names of their columns."""
    name = "gone"
    while name.lower() in {c.lower() for c in docs.columns}:
        name += "_"
    return docs.join(ids.toDF(name), F.col(f"`{id_col}`").cast("long") == F.col(name), "left_anti")


def small_batches(spark: SparkSession) -> None:
    """Bound what one Arrow batch holds, for this session."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def fold(id_col: str, folds: int) -> Column:
    """crc32 of the id as text, modulo folds; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % folds


def hash_number(id_col: str) -> Column:
    """A fixed pseudo-random number from 0 up to 1 for each row, by a hash of its id."""
    return F.pmod(F.xxhash64(F.col(id_col), F.lit(17)), F.lit(1 << 20)) / (1 << 20)


def texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Only doc_id and text, the text as UTF-8 bytes."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").cast("binary").alias("text"))


def labelled_sample(docs: DataFrame, labels: DataFrame, label_col: str, rows: int, where: Column) -> tuple[DataFrame | None, float]:
    """At most about `rows` labelled texts of each class (doc_id, text, label), chosen by a hash of doc_id alone; and the share of class 1.

    `where` (on doc_id) is the learning fold; of several labels of an id the largest counts. None without any label. Only the chosen
    ids travel, to where the texts are: there are about 2 * rows of them, whatever the tables hold.
    """
    known = labels.where(where & F.col(label_col).isNotNull()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg((F.max(label_col) >= 1).cast("int").alias("label"))
    counts = {r["label"]: r["count"] for r in known.groupBy("label").count().collect()}
    if not counts:
        return None, 0.0
    chosen = F.lit(False)
    for label, count in counts.items():
        chosen = chosen | ((F.col("label") == label) & (hash_number("doc_id") < rows / count))
    found = texts(docs, "doc_id", "text").join(F.broadcast(known.where(chosen)), "doc_id").select("doc_id", "text", "label")
    return found, counts.get(1, 0) / sum(counts.values())


def batches_by_key(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[tuple, pa.Table]]:
    """Groups of rows with equal integer keys from batches sorted by them; only one group is held at a time."""
    held: list[pa.RecordBatch] = []
    now: tuple | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [np.asarray(batch.column(batch.schema.get_field_index(k))) for k in keys]
        change = reduce(np.logical_or, [c[1:] != c[:-1] for c in columns])
        starts = [0, *(np.flatnonzero(change) + 1).tolist(), batch.num_rows]
        for a, b in zip(starts, starts[1:]):
            key = tuple(int(c[a]) for c in columns)
            if key != now:
                if held:
                    yield now, pa.Table.from_batches(held)
                held, now = [], key
            held.append(batch.slice(a, b - a))
    if held:
        yield now, pa.Table.from_batches(held)


def map_groups(df: DataFrame, keys: list[str], f: Callable[[tuple, pa.Table], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """f over every group of equal integer keys, streamed out of sorted partitions."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, table in batches_by_key(batches, keys):
            yield from f(key, table)

    return df.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, schema)


def lists_of(values: np.ndarray, counts: np.ndarray | list[int], kind: pa.DataType) -> pa.Array:
    """A list column out of flat values and the length of each list."""
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32()), pa.array(values, kind))
