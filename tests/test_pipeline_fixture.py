"""The hand-checked micro table: cleaning, dedupe, null-safe join, lag, split and summary."""

import numpy as np
import pytest

from tillage import schemas as S
from tillage.operators import metrics, models, relational as R
from tillage.plans import crop
from tillage.sources import tables

CROP = """State_Name,District_Name,Crop_Year,Season,Crop,Area,Production,yield
  S1 ,D1,1996,Kharif,Rice,10,20,2.0
S1,D1,1997,Kharif ,Rice,10,30,3.0
S1,D1,1998,Kharif,Rice,10,30,3.0
S1,D1,1998,Kharif,Rice,10,30,3.0
S1,D1,1998,Kharif,Rice,20,90,4.5
S1,D  1,2010,Kharif,Rice,10,50,5.0
S1,D1,2011,Kharif,Rice,10,60,6.0
S1,D1,2012,Kharif,Rice,10,,7.0
S1,D1,2013,Kharif,Rice,10,80,abc
S1,D1,2014,Kharif,Rice,10,80,8.0
S1,D1,2015,Kharif,Rice,10,90,9.0
NA,D2,2000,Rabi,Wheat,5,5,1.0
NA,D2,2001,Rabi,Wheat,5,10,2.0
S3,D3,1999,Rabi,Wheat,5,15,3.0
S3,D3,xx,Rabi,Wheat,5,15,3.0
"""
RAIN = [("S1", "D1", 1996, 96), ("S1", "D1", 1997, 97), ("S1", "D1", 1998, 98), ("S1", "D1", 1998, 998), ("S1", "D1", 2011, 111), ("S1", "D1", 2012, "bad"),
        ("S1", "D1", 2013, 113), ("S1", "D1", 2014, 114), ("S1", "D1", 2015, 115), ("S1", "D 1", 2010, 110), ("NA", "D2", 2000, 200), ("NA", "D2", 2001, 201)]


@pytest.fixture(scope="module")
def prepared(spark, tmp_path_factory):
    d = tmp_path_factory.mktemp("in")
    (d / "crop.csv").write_text(CROP)
    lines = [",".join([*S.JOIN_KEYS, *S.WEATHER_COLUMNS])]
    for state, district, year, rain in RAIN:
        season, crop_name = ("Rabi", "Wheat") if district == "D2" else ("Kharif", "Rice")
        lines.append(",".join(map(str, [state, district, year, season, crop_name, rain, *range(len(S.WEATHER_COLUMNS) - 1)])))
    (d / "weather.csv").write_text("\n".join(lines) + "\n")
    return crop.load(spark, [str(d / "absent.csv"), str(d / "crop.csv")], str(d / "weather.csv"))


def test_final(prepared):
    got = sorted([tuple(r) for r in prepared.final.select("State_Name", "District_Name", "Crop_Year", "Area", "yield", "rain_sum_mm", "lag_yield").collect()], key=str)
    assert got == sorted([
        ("S1", "D 1", 2010, 10, 5.0, 110, None), ("S1", "D1", 1997, 10, 3.0, 97, None), ("S1", "D1", 1998, 10, 3.0, 98, 3.0), ("S1", "D1", 1998, 20, 4.5, 98, 3.0),
        ("S1", "D1", 2011, 10, 6.0, 111, 4.5), ("S1", "D1", 2014, 10, 8.0, 114, 6.0), (None, "D2", 2000, 5, 1.0, 200, None), (None, "D2", 2001, 5, 2.0, 201, 1.0),
    ], key=str)


def test_summary_and_write(spark, prepared, tmp_path):
    s = crop.summary(prepared)
    assert (s["observations"][0], s["features"][0], s["joined"], s["final"]) == (12, 11, (12, 22), (8, 23))
    assert (s["train"][0], s["validation"][0], s["test"][0]) == (6, 1, 1)
    assert s["missing_feature_ratio"] == pytest.approx(1 / 6) and s["years"] == (1997, 2014) and s["coordinates"] is None
    assert "train: 6 x 23" in crop.summary_text(s)
    crop.write(prepared, str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out/final")).where("split = 'test'").count() == 1
    tables.write_csv(prepared.final, str(tmp_path / "csv"), single_file=True)
    assert tables.versioned(spark, str(tmp_path / "csv"), "1") and not tables.exists(spark, str(tmp_path / "csv"))
    assert tables.versioned(spark, str(tmp_path / "csv"), "1") is None


def test_guards(spark):
    df = spark.createDataFrame([(1, "a"), (1, "b")], "k int, v string")
    with pytest.raises(ValueError):
        R.require_columns(df, ["k", "absent"])
    with pytest.raises(ValueError):
        R.join_features(df, df, ["k"], validate=True)
    with pytest.raises(FileNotFoundError):
        tables.require_paths(spark, ["/nowhere/x"])


def test_numbers(spark):
    from pyspark.sql import functions as F

    from tillage.functions.cleaning import exact_to_int, to_number

    cases = {"1,000": None, "0x10": None, "1e3": 1000.0, " 12 ": 12.0, "1.": 1.0, "NaN": None, "1d": None, "2F": None, "": None, "-": None, "inf": float("inf")}
    df = spark.createDataFrame([(k,) for k in cases], "s string")
    assert {r.s: r.v for r in df.select("s", to_number(F.col("s")).alias("v")).collect()} == cases
    with pytest.raises(Exception, match="not an integer"):
        spark.createDataFrame([(2001.7,)], "x double").select(exact_to_int(F.col("x"))).collect()


def test_ridge_is_the_closed_form(spark):
    rng = np.random.default_rng(0)
    x, c = rng.normal(5, 3, (300, 2)), rng.integers(0, 3, 300)
    y = x @ [2.0, -1.0] + c + rng.normal(0, 0.1, 300)
    df = spark.createDataFrame([(float(a), float(b), "abc"[k], float(v)) for (a, b), k, v in zip(x, c, y)], "a double, b double, k string, y double")
    prep = models.Preprocessor(["a", "b"], ["k"]).fit(df)
    fitted = prep.transform(df)
    got = np.array([r[0] for r in models.fit_ridge(fitted, "y", 1.0).transform(fitted).select("prediction").collect()])
    z = np.hstack([(x - x.mean(0)) / x.std(0), np.eye(3)[c]])
    zc = z - z.mean(0)
    w = np.linalg.solve(zc.T @ zc + np.eye(5), zc.T @ (y - y.mean()))
    assert np.allclose(got, zc @ w + y.mean(), atol=1e-5)
    unseen = prep.transform(spark.createDataFrame([(1.0, None, "new", 0.0)], df.schema)).first()["features"]
    assert list(unseen.toArray()[2:]) == [0, 0, 0]


def test_metrics_of_a_constant(spark):
    df = spark.createDataFrame([(1.0, 1.0), (1.0, 1.0), (None, 2.0)], "y double, p double")
    row = metrics.regression_metrics(df, "m", "y", "p").first()
    assert (row.mae, row.rmse, row.r2) == (0, 0, 1)


def test_stream(spark, tmp_path):
    from tillage.streaming.incremental import clean_new_files

    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.csv").write_text(CROP)
    clean_new_files(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 13
