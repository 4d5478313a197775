"""Files written and read back."""

import os

import pytest

from cohortloom.session import materialise, scratch_path, shared_folder
from cohortloom.sources.readers import read_glob, read_table
from cohortloom.sources.writers import export_bed, write_table

SCHEMA = "id int, name string, score double, day date"


@pytest.fixture()
def table(spark):
    return spark.sql("""SELECT * FROM VALUES (1, 'plain', 1.5D, DATE'2016-01-02'), (2, 'with "quotes", and commas', 2.5D, NULL),
        (3, '', NULL, DATE'1999-12-31'), (4, NULL, -1D, NULL), (5, 'tab\there', 0D, NULL) AS t(id, name, score, day)""")


def _rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.mark.parametrize("fmt", ["csv", "tsv", "parquet"])
def test_round_trip_keeps_missing_and_empty_apart(spark, table, fmt):
    path = scratch_path(spark, fmt)
    write_table(table, path, fmt)
    assert _rows(read_table(spark, path, SCHEMA, fmt)) == _rows(table)


def test_cells_that_do_not_parse_become_missing(spark):
    path = scratch_path(spark, "raw")
    spark.createDataFrame([("7\tx\tnot a number\t2016-13-45",)], "value string").write.text(path)
    assert _rows(read_table(spark, path, SCHEMA, "tsv", header=False)) == [(7, "x", None, None)]
    with pytest.raises(ValueError):
        read_table(spark, path, None, "tsv")


def test_files_by_pattern_with_their_names(spark, tmp_path):
    for name, line in (("a.tsv", "1\tu"), ("b.txt", "2\tv"), ("c.csv", "3\tw")):
        (tmp_path / name).write_text("id\tname\n" + line + "\n")
    got = read_glob(spark, str(tmp_path), "id int, name string")
    assert _rows(got) == [(1, "u", "a.tsv"), (2, "v", "b.txt")]
    assert _rows(read_glob(spark, str(tmp_path), "id int, name string", names=["b.txt"])) == [(2, "v", "b.txt")]


def test_one_folder_per_value_and_no_silent_overwrite(spark, table):
    path = scratch_path(spark, "parts")
    write_table(table, path, partition_by=["id"])
    assert {d for d in os.listdir(path) if d.startswith("id=")} == {f"id={i}" for i in range(1, 6)}
    with pytest.raises(Exception):
        write_table(table, path)


def test_region_file(spark):
    path = scratch_path(spark, "bed")
    regions = spark.createDataFrame([("chr1", 11, 20, "r1")], "chrom string, start int, end int, region_id string")
    export_bed(regions, path)
    assert [r[0] for r in spark.read.text(path).collect()] == ["chr1\t10\t20\tr1"]


def test_stages_go_to_the_shared_folder(spark, table):
    stage = materialise(table, "check")
    assert shared_folder(spark) in stage.inputFiles()[0]
    assert _rows(stage) == _rows(table)
