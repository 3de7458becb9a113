"""Profiles by bitmaps and typed values, and copies by tasks."""

import datetime
import hashlib

import pytest
from pyspark.sql import functions as F

from tillage.operators import profile
from tillage.sources import tables


def rows_of(df):
    return {r.column_name: (r.missing, r.missing_ratio, r.distinct_values) for r in df.collect()}


def test_a_million_integers_go_as_bitmaps(spark):
    df = spark.range(-400_000, 600_000, 1, 8).union(spark.range(0, 1000)).select(
        F.col("id").alias("near"),
        (F.col("id") * 4_000_000_007).alias("far"),
        F.when(F.col("id") % 4 != 0, F.col("id").cast("int")).alias("some"),
        F.date_add(F.lit("2000-01-01").cast("date"), (F.col("id") % 300).cast("int")).alias("day"),
        (F.col("id") % 2 == 0).alias("even"),
    )
    found = profile.column_profile(df, df.columns)
    want = {c: (r[0], r[0] / 1_001_000, r[1]) for c, r in ((c, df.agg(F.count_if(F.col(c).isNull()), F.count_distinct(c)).first()) for c in df.columns)}
    assert rows_of(found) == want and want["near"][2] == 1_000_000
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "bitmap_construct_agg" in plan and "near" in profile._dense(df, {"near": F.col("near"), "far": F.col("far")}) and "far" not in profile._dense(df, {"far": F.col("far")})


def test_types_and_odd_values(spark):
    nan, day = float("nan"), datetime.date(1900, 1, 1)
    rows = [(0.0, "", b"\xff", day, True, 2**63 - 1), (-0.0, None, b"\xfe", None, None, -(2**63)), (nan, "NaN", None, day, False, None), (nan, "", b"\xff", None, True, 0)]
    df = spark.createDataFrame(rows, "d double, s string, b binary, t date, f boolean, n long")
    want = {"d": (0, 0.0, 2), "s": (1, 0.25, 2), "b": (1, 0.25, 2), "t": (2, 0.5, 1), "f": (1, 0.25, 2), "n": (1, 0.25, 3)}
    assert rows_of(profile.column_profile(df, df.columns)) == want
    assert rows_of(profile.column_profile(df.limit(0), df.columns)) == dict.fromkeys(df.columns, (0, None, 0))


def test_copy_of_folders_and_files(spark, tmp_path):
    source = tmp_path / "a b"
    (source / "inner").mkdir(parents=True)
    contents = {"one": b"", "inner/two": b"x" * (9 << 20), "inner/th ree": bytes(range(256))}
    for name, data in contents.items():
        (source / name).write_bytes(data)
    got = tables.copy_raw(spark, str(source), str(tmp_path / "copy"))
    assert {(r.name, r.bytes, r.sha256) for r in got.collect()} == {(k, len(v), hashlib.sha256(v).hexdigest()) for k, v in contents.items()}
    assert {str(p.relative_to(tmp_path / "copy")): p.read_bytes() for p in (tmp_path / "copy").rglob("*") if p.is_file()} == contents
    tables.copy_raw(spark, str(source / "inner/two"), str(tmp_path / "alone"))
    assert (tmp_path / "alone").read_bytes() == contents["inner/two"]
    (tmp_path / "empty").mkdir()
    assert tables.copy_raw(spark, str(tmp_path / "empty"), str(tmp_path / "nothing")).count() == 0 and (tmp_path / "nothing").is_dir()
    with pytest.raises(FileNotFoundError):
        tables.copy_raw(spark, str(tmp_path / "absent"), str(tmp_path / "no"))
