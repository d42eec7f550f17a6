"""Small helpers shared by the corpus operators: row-preserving Arrow maps, work
folders, and rows of a fixed session setting."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator, Sequence
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

PIECE_BYTES = 1 << 20


def documents(spark: SparkSession, sf_dir: str, table: str = "documents") -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def id_crc(col: str = "doc_id") -> F.Column:
    """crc32 of an id written as decimal text."""
    return F.crc32(F.col(col).cast("string").cast("binary"))


def as_bytes(column: pa.Array) -> list[bytes | None]:
    """The UTF-8 bytes of a string column, null for null."""
    if pa.types.is_null(column.type):
        return [None] * len(column)
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return column.cast(kind).to_pylist()


def pieces(batch: pa.RecordBatch, column: str, budget: int = PIECE_BYTES) -> Iterator[pa.RecordBatch]:
    """Zero-copy runs of rows whose texts together hold about `budget` bytes; a longer text is a run alone."""
    if batch.num_rows == 0:
        return
    sizes = [len(x) if x is not None else 0 for x in as_bytes(batch.column(column))]
    start, held = 0, 0
    for i, n in enumerate(sizes):
        if i > start and held + n > budget:
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += n
    yield batch.slice(start)


def append_columns(
    df: DataFrame,
    text: str,
    fields: Sequence[T.StructField],
    compute: Callable[[pa.RecordBatch], list[pa.Array]],
    drop: Sequence[str] = (),
    budget: int = PIECE_BYTES,
) -> DataFrame:
    """Every row of `df` with the columns that `compute` makes of a run of rows.

    Rows are neither merged nor reordered, so repeated rows and null ids are safe. A column of
    `df` that has the name of a new one is replaced; those named in `drop` are read but not carried on.
    """
    new = [f.name for f in fields]
    carried = [f for f in df.schema.fields if f.name not in new and f.name not in drop]
    names = [f.name for f in carried]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch, text, budget):
                old = [piece.column(piece.schema.get_field_index(n)) for n in names]
                yield pa.RecordBatch.from_arrays([*old, *compute(piece)], names=[*names, *new])

    return df.mapInArrow(run, T.StructType([*carried, *fields]))


def workdir(spark: SparkSession) -> str:
    """The folder all executors share, from spark.checkpoint.dir; a local session that has none uses /tmp/checkpoints."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found and not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return (found or "file:///tmp/checkpoints").rstrip("/")


#: With this on, Spark removes a query's shuffle files when it ends instead of when the driver collects garbage.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def freed(spark: SparkSession) -> Iterator[None]:
    """Queries that end in here leave no shuffle files behind."""
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.unset(_CLEANUP) if before is None else spark.conf.set(_CLEANUP, before)


def saved(df: DataFrame, label: str, folder: str | None = None) -> DataFrame:
    """`df` written as Parquet to the shared folder and read again: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{folder or workdir(spark)}/{label}-{uuid.uuid4().hex}"
    with freed(spark):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


class Scratch:
    """Saved tables of one computation, removed when its result has been saved."""

    def __init__(self, spark: SparkSession):
        self.spark, self.folder = spark, f"{workdir(spark)}/scratch-{uuid.uuid4().hex}"

    def saved(self, df: DataFrame, label: str) -> DataFrame:
        return saved(df, label, self.folder)

    def remove(self) -> None:
        context = self.spark.sparkContext
        path = context._jvm.org.apache.hadoop.fs.Path(self.folder)
        path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


def one_of_each(df: DataFrame, kept: str, repeated: str, key: Sequence[str], any_repeated: bool) -> DataFrame:
    """Rows whose `kept` is true; where several rows tie as the kept one (`repeated`), one of them.

    `any_repeated` is false in a corpus without repeated ids, and then nothing is shuffled.
    """
    stay = df.filter(F.col(kept))
    if not any_repeated:
        return stay
    return stay.filter(~F.col(repeated)).unionByName(stay.filter(F.col(repeated)).dropDuplicates(list(key)))
