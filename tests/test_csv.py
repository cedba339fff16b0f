"""CSV files cut into splits at any byte, against the standard library's reader."""

import csv
import io
import random

import pytest

from basketry.sources import readers


def table(rng, rows):
    def field():
        return "".join(rng.choice(["a", "é", '"', "\n", ",", " ", "\r\n", "x" * 9]) for _ in range(rng.randint(0, 12)))

    return [[str(k), field(), field()] for k in range(rows)]


@pytest.mark.parametrize("size, encoding", [("1m", "utf-8"), ("97b", "utf-8"), ("41b", "latin-1"), ("9b", "utf-8")])
def test_splits_within_quotes(spark, tmp_path, size, encoding):
    rng = random.Random(size)
    names = ["id", "one", "two"]
    want = []
    for k in range(3):
        rows = table(rng, 60)
        if k == 1:
            rows[7][1] = "long\n" * 200  # a field over many splits
        text = io.StringIO()
        writer = csv.writer(text, lineterminator="\n" if k else "\r\n")
        writer.writerows([names, *rows])
        (tmp_path / f"{k}.csv").write_bytes(text.getvalue().encode(encoding))
        want += rows
    keys = {"spark.sql.files.maxPartitionBytes": size, "spark.sql.files.openCostInBytes": "0"}
    before = {k: spark.conf.get(k) for k in keys}
    for k, v in keys.items():
        spark.conf.set(k, v)
    try:
        read = readers.read_raw_csv(spark, str(tmp_path))
        got = [[x or "" for x in row[:3]] for row in read.collect()]
        tasks = readers.quoted_lines(spark, str(tmp_path)).select("path", "split").distinct().count()
        bad = readers.corrupt_rows(read).first()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    plain = lambda rows: sorted([[x.replace("\r\n", "\n") for x in r] for r in rows])
    assert plain(got) == plain(want)
    assert tasks > (3 if size != "1m" else 2) and (bad.rows, bad.corrupt) == (180, 0)


def test_lines_that_do_not_fit(spark, tmp_path):
    (tmp_path / "x.csv").write_text("a,b\n1,2\n\n3\n4,5,6\n")
    rows = readers.read_raw_csv(spark, str(tmp_path)).collect()
    assert len(rows) == 3 and sum(r._corrupt_record is not None for r in rows) == 2
