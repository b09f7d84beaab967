"""Splittable multi-line CSV against Spark's one-task-a-file reader."""

import csv
import random

import pytest

from sievekit.sources.csv_split import ends_inside, read_csv_records
from sievekit.sources.io import LABELLED_SCHEMA, read_labelled_csv, write_csv


@pytest.fixture
def small_ranges(spark):
    """Byte ranges of 300 bytes, a task each."""
    keys = {"spark.sql.files.maxPartitionBytes": "300", "spark.sql.files.openCostInBytes": "300"}
    for k, v in keys.items():
        spark.conf.set(k, v)
    yield
    for k in keys:
        spark.conf.unset(k)


def _multi_line(spark, path):
    return (spark.read.schema(LABELLED_SCHEMA).option("header", True).option("multiLine", True).option("quote", '"').option("escape", '"').csv(path))


def _rows(seed, n):
    rnd = random.Random(seed)
    bits = ["a", "b,", '"', '""', "\n", "\n\n", "' OR 1=1 --", '","', '"\n"', "é", " ", "<script>\nalert(\"x\")\n</script>", "x" * 400]
    return [("".join(rnd.choice(bits) for _ in range(rnd.randint(1, 7))), i, rnd.choice(["XSS", 'SQ"Li', "Nor\nmal"]), i * 7) for i in range(n)]


def _write(path, rows, **fmt):
    with open(path, "w", newline="", encoding="utf-8") as f:
        w = csv.writer(f, **fmt)
        w.writerow(LABELLED_SCHEMA.names)
        w.writerows(rows)


def _same(spark, path):
    got = sorted(map(tuple, read_csv_records(spark, path, LABELLED_SCHEMA).collect()), key=str)
    assert got == sorted(map(tuple, _multi_line(spark, path).collect()), key=str)
    return got


@pytest.mark.parametrize("ending", ["\n", "\r\n"])
def test_equals_multi_line_reader(spark, tmp_path, small_ranges, ending):
    rows = _rows(1, 150) + [("long\n" * 500 + '"end"', 150, "XSS", 1)]  # one record over many ranges
    path = str(tmp_path / "one.csv")
    _write(path, rows, lineterminator=ending, quoting=csv.QUOTE_MINIMAL)
    got = _same(spark, path)
    assert len(got) == 151
    if ending == "\n":
        assert sorted(got, key=str) == sorted(rows, key=str)
    assert read_csv_records(spark, path, LABELLED_SCHEMA).rdd.getNumPartitions() > 20  # one file, many tasks


def test_folder_of_files_and_sink(spark, tmp_path, small_ranges):
    rows = _rows(2, 120)
    path = str(tmp_path / "many")
    write_csv(spark.createDataFrame(rows, LABELLED_SCHEMA).repartition(4), path)
    assert sorted(_same(spark, path), key=str) == sorted(rows, key=str)


def test_header_only_multi_line_header_and_quotes_inside_plain_fields(spark, tmp_path, small_ranges):
    path = tmp_path / "h.csv"
    path.write_text("Payload,Label,text_label,ID\n")
    assert read_csv_records(spark, str(path), LABELLED_SCHEMA).count() == 0
    path = tmp_path / "m.csv"
    path.write_text('"Pay\n' + "load\n" * 100 + '",Label,text_label,ID\nx,1,"a ""b""\nc",2\n\n5" disk,3,it"s,4\n,,,\n"",,,9\n')
    got = _same(spark, str(path))
    assert ("5\" disk", 3, 'it"s', 4) in got and ("x", 1, 'a "b"\nc', 2) in got


def test_na_tokens(spark, tmp_path):
    path = str(tmp_path / "na.csv")
    _write(path, [("NULL", 1, "x", 2), ("nan\n", 2, "N/A", 3)])
    assert sorted(map(tuple, read_labelled_csv(spark, path).collect()), key=str) == [("nan\n", 2, None, 3), (None, 1, "x", 2)]


def test_line_states():
    assert ends_inside('a,"b', False) and not ends_inside('b",c', True) and ends_inside("no quote", True)
    assert not ends_inside('a"b,c"d', False) and ends_inside('"a""', False) and not ends_inside('"a"""', False)
    assert ends_inside('x","y', True) and not ends_inside("", False)
