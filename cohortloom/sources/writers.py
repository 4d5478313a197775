"""Writers for result tables, partitioned results and region files."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortloom.sources.readers import NULL_TEXT


def write_table(df: DataFrame, path: str, fmt: str = "parquet", partition_by: Sequence[str] = (),
                header: bool = True, mode: str = "errorifexists") -> None:
    """Write a csv, tsv or parquet result; ``partition_by`` gives one folder per value."""
    writer = df.write.mode(mode)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    if fmt == "parquet":
        writer.parquet(path)
    elif fmt in ("csv", "tsv"):
        (writer.option("header", header).option("sep", "," if fmt == "csv" else "\t")
         .option("quote", '"').option("escape", '"').option("emptyValue", '""').option("nullValue", NULL_TEXT).csv(path))
    else:
        raise ValueError("fmt must be csv, tsv or parquet")


def bed_rows(df: DataFrame, chrom: str = "chrom", start: str = "start", end: str = "end",
             name: str = "region_id") -> DataFrame:
    """The four region columns in file order. Starts count from 0 and ends are exclusive, so a
    closed 1-based interval keeps its end and moves its start down by one."""
    return df.select(F.col(chrom).alias("chrom"), (F.col(start) - 1).alias("start"), F.col(end).alias("end"),
                     F.col(name).alias("name"))


def export_bed(df: DataFrame, path: str, mode: str = "errorifexists", **columns: str) -> None:
    """Write regions as tab-separated text without a header."""
    write_table(bed_rows(df, **columns), path, "tsv", header=False, mode=mode)
