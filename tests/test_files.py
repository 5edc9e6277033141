"""CSV files cut anywhere, and the account of what is lost in reading them."""

import csv
from contextlib import contextmanager

import pytest
from pyspark.sql import Observation

from cohortmill.sources.files import ROW, coercion_report, csv_records, read_table, stage, with_numbers

TEXTS = ["plain", 'a "quoted" word', "two\nlines", "\n\n", 'ends with "', '"', "comma, and\r\nother break", "é ü ß", "", '""\n""', "last"]


@pytest.fixture
def splits_of(spark):
    """Files are read in splits of a size while the table is set up, which reads them; what it stages is read as ever."""

    @contextmanager
    def cut(size):
        names = {"spark.sql.files.maxPartitionBytes": str(size), "spark.sql.files.openCostInBytes": "0", "spark.sql.files.minPartitionNum": "1"}
        for k, v in names.items():
            spark.conf.set(k, v)
        try:
            yield
        finally:
            for k in names:
                spark.conf.unset(k)

    return cut


def write(path, rows, encoding="utf-8"):
    with open(path, "w", newline="", encoding=encoding) as f:
        out = csv.writer(f, quoting=csv.QUOTE_ALL)
        out.writerow(["id", "text", "n"])
        out.writerows(rows)


ROWS = [(k, t, k * 1.5) for k, t in enumerate(TEXTS)]


@pytest.mark.parametrize(("encoding", "cut"), [("UTF-8", 40), ("ISO-8859-1", 97), ("UTF-8", 1000)])
def test_records_come_whole_wherever_the_file_is_cut(spark, splits_of, tmp_path, encoding, cut):
    path = str(tmp_path / "x.csv")
    write(path, ROWS, encoding)
    with splits_of(cut):
        got = read_table(spark, path, "id int, text string, n double", encoding, multiline=True, row_order=True)
    assert [(r["id"], r["text"], r["n"]) for r in got.orderBy(ROW).collect()] == ROWS


def test_a_cut_at_every_byte(spark, splits_of, tmp_path):
    path = str(tmp_path / "x.csv")
    with open(path, "w") as f:
        f.write('id,t\n1,"a\n"""\n2,b')
    with splits_of(1):
        got = read_table(spark, path, "id int, t string", multiline=True)
    assert sorted((r["id"], r["t"]) for r in got.collect()) == [(1, 'a\n"'), (2, "b")]


def test_several_files_and_their_headers(spark, splits_of, tmp_path):
    for k in range(3):
        write(str(tmp_path / f"{k}.csv"), [(10 * k + i, t, n) for i, t, n in ROWS])
    with splits_of(50):
        got = read_table(spark, str(tmp_path), "id int, text string", multiline=True, row_order=True)
    assert [(r["id"], r["text"]) for r in got.orderBy(ROW).collect()] == [(10 * k + i, t) for k in range(3) for i, t, _ in ROWS]
    lines = csv_records(spark, str(tmp_path))
    assert lines.where("__first").count() == 3 and lines.count() == 36
    with open(tmp_path / "3.csv", "w") as f:
        f.write("id,other,n\n1,x,2\n")
    with pytest.raises(Exception, match="has another header"):
        read_table(spark, str(tmp_path), "id int, text string", multiline=True).collect()


def test_a_file_is_read_in_several_tasks(spark, splits_of, tmp_path):
    path = str(tmp_path / "x.csv")
    write(path, [(k, f"line {k}\nand one more", 0) for k in range(2000)])
    with splits_of(5500):
        assert spark.read.option("lineSep", "\n").text(path).rdd.getNumPartitions() > 10
        got = read_table(spark, path, "id int, text string", multiline=True)
    assert got.where("text = concat('line ', id, '\n', 'and one more')").count() == 2000


@pytest.mark.parametrize("multiline", [False, True])
def test_lost_values_are_counted_in_the_same_pass(spark, tmp_path, multiline):
    path = str(tmp_path / "x.csv")
    with open(path, "w") as f:
        f.write("id,x,n\n1,2.5,7\n2,none,8\n3,NA,\n4,,9\n5,1e3,x\n6,0x1F,12\nseven,1,1\n8,3\n9,4,5,6\n")
    rejected = Observation()
    got = read_table(spark, path, "id int, x double, n int", rejected=rejected, multiline=multiline)
    assert got.columns == ["id", "x", "n"]
    stage(got)
    report = {r["field"]: (r["n_rows"], r["n_rejected"]) for r in coercion_report(spark, rejected).collect()}
    assert report == {None: (9, 2), "id": (9, 1), "x": (9, 1), "n": (9, 1)}


def test_numbers_of_a_table_with_an_account(spark):
    rejected = Observation()
    df = spark.createDataFrame([("1", "a"), ("x", "b"), (None, "c"), ("NA", "d"), ("NaN", "e")], "v string, w string")
    assert [r["v"] for r in with_numbers(df, ["v"], rejected).collect()] == [1.0, None, None, None, None]
    assert {r["field"]: r["n_rejected"] for r in coercion_report(spark, rejected).collect()} == {"v": 2}
    assert [r["v"] for r in with_numbers(df, ["v"]).collect()] == [1.0, None, None, None, None]
