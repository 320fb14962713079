"""Reading texts: any Spark source, narrowed to the key and text columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FORMATS = ("parquet", "orc", "json", "csv", "text")


def read_texts(
    spark: SparkSession,
    path: str | Sequence[str],
    *,
    id_cols: Sequence[str] = (),
    text_col: str = "text",
    keep: Sequence[str] = (),
    fmt: str = "parquet",
    schema: str | None = None,
    spread: int | None = None,
    **options: str,
) -> DataFrame:
    """The named columns of a source, so that the scan reads no others.

    Plain text files give one row per line, or per file with ``wholetext=True``; their key is the
    file name.  ``spread`` redistributes the rows by key over that many partitions: only for small
    inputs that arrive in fewer partitions than there are cores.
    """
    if fmt not in FORMATS:
        raise ValueError(f"format must be one of {FORMATS}")
    reader = spark.read.format(fmt).options(**options)
    if schema:
        reader = reader.schema(schema)
    df = reader.load(path if isinstance(path, str) else list(path))
    if fmt == "text":
        df = df.select(
            F.col("_metadata.file_path").alias("path"), F.col("value").alias(text_col)
        )
        id_cols = ("path",)
    df = df.select(*id_cols, text_col, *keep)
    return df.repartition(spread, *(id_cols or [text_col])) if spread else df
