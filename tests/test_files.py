"""File hashes, artifact lookup, value maps and sampled dates."""

import datetime
import hashlib

import pytest
from pyspark.sql import functions as F

from tidewind.functions.exprs import mapped
from tidewind.operators.quality import sampled_dates
from tidewind.queries import queries
from tidewind.sources.files import file_hashes, find_artifact


def test_hash_is_that_of_the_content(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "a.csv").write_bytes(b"x,y\n1,2\n")
    (tmp_path / "sub" / "b.csv").write_bytes(b"z")
    (tmp_path / "sub" / "empty.csv").write_bytes(b"")
    got = {r["path"].rsplit("/", 1)[-1]: r for r in file_hashes(spark, str(tmp_path), "*.csv").collect()}
    assert {n: r["sha256"] for n, r in got.items()} == {n: hashlib.sha256(c).hexdigest() for n, c in (("a.csv", b"x,y\n1,2\n"), ("b.csv", b"z"), ("empty.csv", b""))}
    assert got["b.csv"]["length"] == 1 and got["empty.csv"]["length"] == 0


def test_hash_of_a_file_above_two_gigabytes(spark, tmp_path):
    with open(tmp_path / "large.bin", "wb") as file:
        file.truncate(3 << 30)
        file.seek(3 << 30)
        file.write(b"end")
    want = hashlib.sha256()
    for _ in range(3 << 4):
        want.update(bytes(1 << 26))
    want.update(b"end")
    (tmp_path / "small.bin").write_bytes(b"s")
    got = {r["path"].rsplit("/", 1)[-1]: (r["length"], r["sha256"]) for r in file_hashes(spark, f"file:{tmp_path}").collect()}
    assert got == {"large.bin": ((3 << 30) + 3, want.hexdigest()), "small.bin": (1, hashlib.sha256(b"s").hexdigest())}


def test_hashes_of_no_files_and_of_one(spark, tmp_path):
    assert file_hashes(spark, str(tmp_path)).count() == 0
    (tmp_path / "a").write_bytes(b"1")
    assert [r["path"] for r in file_hashes(spark, str(tmp_path / "a")).collect()] == [str(tmp_path / "a")]
    with pytest.raises(Exception, match="FileNotFoundError"):
        file_hashes(spark, str(tmp_path / "none")).collect()


def test_table_hashes(spark, sf_dir):
    got = {r["file"]: r["sha256"] for r in queries()["table_hashes"](spark, sf_dir).collect()}
    assert got == {n: hashlib.sha256(open(f"{sf_dir}/{n}", "rb").read()).hexdigest() for n in ("region.parquet", "nation.parquet")}


def test_artifact_is_found_at_its_place_or_below(spark, tmp_path):
    (tmp_path / "deep" / "er").mkdir(parents=True)
    (tmp_path / "deep" / "er" / "one.json").write_text("{}")
    assert find_artifact(spark, str(tmp_path), "results/one.json").endswith("/deep/er/one.json")
    (tmp_path / "one.json").write_text("{}")
    assert find_artifact(spark, str(tmp_path), "one.json").endswith(f"{tmp_path.name}/one.json")
    with pytest.raises(FileNotFoundError):
        find_artifact(spark, str(tmp_path), "results/one.json")
    with pytest.raises(FileNotFoundError):
        find_artifact(spark, str(tmp_path / "none"), "one.json")


def test_unknown_values_map_to_null(spark):
    rows = spark.createDataFrame([(1, "a"), (2, "b"), (3, None)], "i int, v string")
    assert [r[0] for r in rows.orderBy("i").select(mapped(F.col("v"), {"a": "first"})).collect()] == ["first", None, None]


def test_sampled_dates_repeat_themselves(spark):
    days = [(datetime.date(2020, 1, 1) + datetime.timedelta(i),) for i in range(200)]
    table = spark.createDataFrame(days + days[:50] + [(None,)], "Date date")
    got = [r[0] for r in sampled_dates(table).collect()]
    assert len(set(got)) == 12 and got == [r[0] for r in sampled_dates(table.repartition(7)).collect()]
    assert got != [r[0] for r in sampled_dates(table, seed=1).collect()]
    assert sampled_dates(table.limit(0)).count() == 0 and sampled_dates(table, k=1000).count() == 200
