"""Readers for delimited and columnar tables with declared schemas."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_SEPARATORS = {"csv": ",", "tsv": "\t"}

# Fixed value: how delimited files spell a missing cell (an empty cell is missing too).
NULL_TEXT = "NA"


def read_table(spark: SparkSession, path: str | Sequence[str], schema: T.StructType | str | None = None,
               fmt: str = "csv", header: bool = True, date_format: str = "yyyy-MM-dd", line_breaks: bool = True) -> DataFrame:
    """Read a csv, tsv or parquet table. Delimited files need a schema, so no pass is spent on
    inference; cells that do not parse become NULL, and so do empty and ``NA`` cells (a quoted empty
    text stays). Without a header columns take schema order. Quoted cells may hold line breaks, so a file
    is read as a whole by one task; ``line_breaks=False`` lets large files without any be split."""
    if fmt == "parquet":
        reader = spark.read.schema(schema) if schema is not None else spark.read
        return reader.parquet(*([path] if isinstance(path, str) else path))
    if fmt not in _SEPARATORS:
        raise ValueError("fmt must be csv, tsv or parquet")
    if schema is None:
        raise ValueError("delimited files need a schema")
    return (spark.read.schema(schema).option("header", header).option("sep", _SEPARATORS[fmt])
            .option("quote", '"').option("escape", '"').option("multiLine", line_breaks)
            .option("dateFormat", date_format).option("mode", "PERMISSIVE").option("nullValue", NULL_TEXT)
            .csv(path if isinstance(path, str) else list(path)))


def read_glob(spark: SparkSession, folder: str, schema: T.StructType | str, pattern: str = "*.{tsv,txt}",
              fmt: str = "tsv", header: bool = True, names: Sequence[str] | None = None,
              source_col: str = "source_file", line_breaks: bool = True) -> DataFrame:
    """Read every file of a folder tree whose name fits the pattern and record which file a row is
    from; ``names`` keeps only the listed files."""
    if fmt not in _SEPARATORS:
        raise ValueError("fmt must be csv or tsv")
    df = (spark.read.schema(schema).option("header", header).option("sep", _SEPARATORS[fmt])
          .option("quote", '"').option("escape", '"').option("nullValue", NULL_TEXT)
          .option("multiLine", line_breaks).option("pathGlobFilter", pattern)
          .option("recursiveFileLookup", True).csv(folder)
          .select("*", F.col("_metadata.file_name").alias(source_col)))
    return df.where(F.col(source_col).isin(list(names))) if names is not None else df
