"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


#: Rows of an Arrow batch where the session has Spark's default of 10,000: rows hold whole texts, and both sides hold batches.
BATCH_ROWS = 1000


def small_batches(spark: SparkSession) -> None:
    """Lower the default rows of an Arrow batch; a number that the session has set stays."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(key) == "10000":
        spark.conf.set(key, str(BATCH_ROWS))


def shared_root(spark: SparkSession) -> str:
    """The folder that driver and executors share, named by ``spark.checkpoint.dir``.

    Where the session names none, a local master gets a temporary folder; a cluster gets an error,
    for its executors would each write to a disk of their own.
    """
    small_batches(spark)
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        context = spark.sparkContext
        current = context._jsc.sc().getCheckpointDir()
        if not current.isDefined() and not context.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        root = current.get() if current.isDefined() else f"file://{tempfile.mkdtemp(prefix='spark-')}"
        if not current.isDefined():
            context.setCheckpointDir(root)
    return root.rstrip("/")


def _run_folder(spark: SparkSession) -> str:
    return f"{shared_root(spark)}/cliploom/{spark.sparkContext.applicationId}"


def clear(spark: SparkSession) -> None:
    """Delete all intermediate tables of this application; results that are still lazy read them."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(_run_folder(spark))
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


_CLEARED: set[str] = set()


def _at_exit(spark: SparkSession) -> None:
    if spark.sparkContext._jsc is not None:
        clear(spark)


def scratch(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder; the application's folder there goes when the driver's Python ends."""
    if (application := spark.sparkContext.applicationId) not in _CLEARED:
        _CLEARED.add(application)
        atexit.register(_at_exit, spark)
    return f"{_run_folder(spark)}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str, partition_by: str | None = None) -> DataFrame:
    """Write a table once to the shared folder and read it back: cuts lineage, survives executors."""
    path = scratch(df.sparkSession, name)
    writer = df.write.partitionBy(partition_by) if partition_by else df.write
    writer.parquet(path)
    schema = df.schema
    return df.sparkSession.read.schema(schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def computed_once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """Add a column that is evaluated once per row.

    The optimizer copies a projected expression to every place that uses it, also into lambdas and
    filters, where a text would be split again for each word.  It does not look through a generator.
    """
    return df.withColumn(name, F.explode(F.array(value)))


def packed(docs: DataFrame) -> DataFrame:
    """(row, doc_id, text): the whole row in one column, so that no extra column can clash."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("doc_id"), F.col("text"))


def unpacked(rows: DataFrame, docs: DataFrame, **changed: Column) -> DataFrame:
    """The columns of ``docs`` again, some of them with new values."""
    return rows.select(*[changed[c].alias(c) if c in changed else F.col("row").getField(c).alias(c) for c in docs.columns])


#: Bits of the sketches below: 1 MB of bits, whatever the input.
SKETCH_BITS = 1 << 23


def _slot(key: str) -> str:
    return f"pmod(xxhash64({key}), {SKETCH_BITS})"


def sketch(keys: DataFrame, key: str) -> DataFrame:
    """A Bloom-like bit sketch of ``key`` as (word, bits): at most SKETCH_BITS / 64 rows."""
    return (
        keys.select(F.expr(f"cast({_slot(key)} div 64 as int)").alias("word"), F.expr(f"shiftleft(1L, cast(pmod({_slot(key)}, 64) as int))").alias("bit"))
        .groupBy("word").agg(F.bit_or("bit").alias("bits"))
    )


def noted(df: DataFrame, key: str, words: DataFrame) -> DataFrame:
    """Add ``noted``: false where ``key`` is surely not among the sketched keys.

    A cheap cut before an exact join: with few keys almost nothing else passes; with very many the
    sketch fills up and the join does all the work, so results never depend on it.
    """
    hit = F.expr(f"coalesce((bits & shiftleft(1L, cast(pmod({_slot(key)}, 64) as int))) <> 0, false)")
    marked = df.withColumn("word", F.expr(f"cast({_slot(key)} div 64 as int)")).join(F.broadcast(words), "word", "left")
    return marked.withColumn("noted", hit).drop("word", "bits")


def text_or_empty(column: str | Column) -> Column:
    column = F.col(column) if isinstance(column, str) else column
    return F.coalesce(column, F.lit(""))


def held_out(doc_id: str, modulus: int, remainder: int) -> Column:
    """True where crc32(doc_id as text) mod ``modulus`` is ``remainder``; a null id counts as ''."""
    return F.crc32(text_or_empty(F.col(doc_id).cast("string"))) % modulus == remainder


#: Bytes of text that a task turns into Python objects at a time, one row at least.
SLICE_BYTES = 1 << 20


def _cuts(sizes: np.ndarray) -> Iterator[tuple[int, int]]:
    """Runs (start, end) of rows that hold about SLICE_BYTES each."""
    part = np.cumsum(sizes) // SLICE_BYTES
    starts = np.flatnonzero(np.diff(part, prepend=-1))
    yield from zip(starts.tolist(), [*starts[1:].tolist(), len(sizes)])


def text_frames(frame: pd.DataFrame, text: str = "text") -> Iterator[pd.DataFrame]:
    """A batch in pieces of bounded text, so that a run of very long texts does not fill a task."""
    for start, end in _cuts(frame[text].str.len().fillna(0).to_numpy(np.int64)):
        yield frame.iloc[start:end]


def with_made(docs: DataFrame, text: str, fields: list[T.StructField], maker: Callable[[], Callable[[list], list]]) -> DataFrame:
    """Every row with new columns made from its whole text, in Python but without a shuffle.

    ``maker`` is called once per task and returns a function from the texts of a slice to one list
    per new column.  All other columns pass through as Arrow buffers and never become Python objects;
    a new column replaces one of its name.
    """
    small_batches(docs.sparkSession)
    made = [f.name for f in fields]
    keep = [c for c in docs.columns if c not in made]
    names = [f"c{i}" for i in range(len(keep))]
    source = docs.select(*[F.col(f"`{c}`").alias(n) for c, n in zip(keep, names)])
    place = keep.index(text)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        import pyarrow.compute as pc
        from pyspark.sql.pandas.types import to_arrow_type

        kinds, make = [to_arrow_type(f.dataType) for f in fields], maker()
        for batch in batches:
            sizes = pc.binary_length(batch.column(place)).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
            for start, end in _cuts(sizes):
                part = batch.slice(start, end - start)
                columns = [pa.array(values, kind) for values, kind in zip(make(part.column(place).to_pylist()), kinds)]
                yield pa.RecordBatch.from_arrays([*part.columns, *columns], names=[*names, *made])

    schema = T.StructType([*[T.StructField(n, docs.schema[c].dataType, True) for c, n in zip(keep, names)], *fields])
    out = source.mapInArrow(run, schema)
    return out.select(*[F.col(n).alias(c) for c, n in zip(keep, names)], *made)
