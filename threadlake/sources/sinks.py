"""Writers (K01-K04): idempotent append, replacement of a rotated file's rows, late values, dumps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def new_rows(batch: DataFrame, target: DataFrame | None, key: list[str], seq: str) -> DataFrame:
    """Rows of a batch whose key the target lacks, the first of each key; rows with a null in the key all pass."""
    known = F.lit(True)
    for k in key:
        known = known & F.col(k).isNotNull()
    first = batch.filter(known).groupBy(*(F.col(k).alias(f"_{k}") for k in key)).agg(F.min_by(F.struct(*batch.columns), seq).alias("_r")).select("_r.*")
    fresh = first if target is None else first.join(target.select(*key), key, "left_anti").select(*batch.columns)
    return fresh.unionByName(batch.filter(~known))


def replaced(target: DataFrame, batch: DataFrame, file: str = "source_file") -> DataFrame:
    """The target without the rows of the batch's files, and the batch."""
    return target.join(batch.select(file).distinct(), file, "left_anti").unionByName(batch, allowMissingColumns=True)


def filled(target: DataFrame, values: DataFrame, key: str, column: str) -> DataFrame:
    """Null cells of a column take a value that came later, the greatest of several."""
    late = values.groupBy(key).agg(F.max(column).alias("_late"))
    return target.join(late, key, "left").withColumn(column, F.coalesce(F.col(column), F.col("_late"))).drop("_late")


def dump(rows: DataFrame, path: str, form: str = "json", kind: str | None = None, cwd: str | None = None, source: str | None = None) -> None:
    """Rows in order of time as JSON lines or Markdown, of one kind, folder or source if given."""
    for column, value in (("kind", kind), ("cwd", cwd), ("source", source)):
        rows = rows if value is None else rows.filter(F.col(column) == value)
    ordered = rows.orderBy(F.col("ts").asc_nulls_first(), "seq")
    if form == "json":
        ordered.write.mode("overwrite").json(path)
    else:
        line = F.concat(F.lit("## "), F.coalesce("role", F.lit("?")), F.lit(" "), F.coalesce(F.col("ts").cast("string"), F.lit("")), F.lit("\n\n"), F.coalesce("text", F.lit("")), F.lit("\n"))
        ordered.select(line.alias("value")).write.mode("overwrite").text(path)
