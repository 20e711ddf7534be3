"""Helpers shared by the corpus operators: inputs, shared storage, Arrow batches, row blocks."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Workers give memory back after each batch; Arrow's own pool would keep it.
pa.set_memory_pool(pa.system_memory_pool())

#: Texts that one slice of an Arrow batch holds at most: rows and bytes.
SLICE_ROWS, SLICE_BYTES = 256, 1 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``; where it is unset, one of our own, in local mode only."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
        if held.isDefined():
            return held.get()
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="tidemark-"))
        return spark.sparkContext._jsc.sc().getCheckpointDir().get()
    return found


def work_dir(spark: SparkSession) -> str:
    """This application's folder in the shared one."""
    return f"{shared_dir(spark)}/tidemark-{spark.sparkContext.applicationId}"


def discard(spark: SparkSession) -> None:
    """Delete what ``stored`` wrote in this application; frames that were read from there end with it."""
    path = spark._jvm.org.apache.hadoop.fs.Path(work_dir(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def stored(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write ``df`` as Parquet to the shared folder and read it back."""
    path = f"{work_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def sliced(batches: Iterator[pa.RecordBatch], column: int = 1) -> Iterator[pa.RecordBatch]:
    """Re-cut Arrow batches so that a slice holds a bounded amount of text (one row at least)."""
    for batch in batches:
        if batch.num_rows <= 64 and batch.nbytes <= SLICE_BYTES:
            if batch.num_rows:
                yield batch
            continue
        lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()
        start = held = 0
        for i, n in enumerate(lengths):
            if i > start and (held + n > SLICE_BYTES or i - start >= SLICE_ROWS):
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += n
        if start < batch.num_rows:
            yield batch.slice(start)


def texts(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of each text; null is empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def map_texts(df: DataFrame, columns: list[str], each: Callable, schema: str, column: int = 1) -> DataFrame:
    """``each(batch)`` over slices of ``df.select(columns)``; ``column`` is the place of the text."""

    def run(batches):
        for batch in sliced(batches, column):
            out = each(batch)
            if out is not None and out.num_rows:
                yield out

    return df.select(*columns).mapInArrow(run, schema)


def block_of(blocks: int, *columns: str) -> Column:
    """A stable block number of a row: rows of one hot value fall in many blocks by the other columns."""
    return F.pmod(F.xxhash64(*columns), F.lit(blocks)).cast("int")


def release(spark: SparkSession) -> None:
    """Let Spark drop the shuffle files of frames that are no longer held."""
    import gc

    gc.collect()
    spark.sparkContext._jvm.System.gc()


def fresh(df: DataFrame, name: str) -> str:
    """A column name that ``df`` does not use, whatever the case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def own_columns(df: DataFrame) -> list[Column]:
    """All columns of ``df`` by quoted name, dots and all."""
    return [F.col("`" + c.replace("`", "``") + "`") for c in df.columns]


def map_whole(df: DataFrame, columns: list[str], run: Callable) -> DataFrame:
    """``df.mapInArrow`` giving the first of its columns back as ``columns``; names with dots, which it cannot resolve, come through."""
    fields = [T.StructField(f"c{k}", f.dataType) for k, f in enumerate(df.schema)]
    safe = df.toDF(*(f.name for f in fields))
    return safe.mapInArrow(run, T.StructType(fields[: len(columns)])).toDF(*columns)


def with_texts(batch: pa.RecordBatch, at: int, found: list[str | None], columns: int) -> pa.RecordBatch:
    """The first columns of a batch, with other texts."""
    arrays = [pa.array(found, pa.string()) if k == at else batch.column(k) for k in range(columns)]
    return pa.RecordBatch.from_arrays(arrays, names=batch.schema.names[:columns])


def counted(done: DataFrame, docs: DataFrame) -> DataFrame:
    """``n_chars`` brought to the text as it is now, where the documents have it."""
    return done.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else done
