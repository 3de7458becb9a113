"""The feature pipeline: clean, dedupe, join, restrict, lag, split."""

from __future__ import annotations

from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from tillage import schemas as S
from tillage.functions.cleaning import clean_text, exact_to_int, missing_to_null, to_number, truncate_to_int
from tillage.operators import ordered, profile, relational as R
from tillage.sources import tables

ORDINAL = "_ordinal"


@dataclass
class Executed:
    joined: DataFrame
    final: DataFrame
    found: dict[str, Any]


@dataclass
class Prepared:
    observations: DataFrame
    features: DataFrame
    joined: DataFrame
    final: DataFrame
    coordinates: DataFrame | None
    ordered: DataFrame
    executed: Executed | None = None

    def split(self, name: str) -> DataFrame:
        low, high = next((lo, hi) for n, lo, hi in S.SPLITS if n == name)
        return R.within(self.final, S.YEAR, low, high)


def _clean(df: DataFrame, names: list[str]) -> DataFrame:
    return df.withColumns({c: clean_text(missing_to_null(F.col(c))) for c in R.existing(df, names)})


def clean_observations(raw: DataFrame) -> DataFrame:
    """Row by row: clean texts, parse numbers, drop rows without year or target."""
    df = R.require_columns(_clean(raw, S.ENTITY_COLUMNS), S.CROP_COLUMNS, "observations")
    df = df.select(*S.CROP_COLUMNS, *R.existing(df, [ORDINAL])).withColumns({c: to_number(F.col(c)) for c in [S.YEAR, "Area", "Production", S.TARGET]})
    return R.drop_missing(df, [S.YEAR, S.TARGET]).withColumn(S.YEAR, truncate_to_int(F.col(S.YEAR)))


def clean_features(raw: DataFrame) -> DataFrame:
    df = R.require_columns(_clean(raw, S.ENTITY_COLUMNS), [*S.JOIN_KEYS, *S.WEATHER_COLUMNS], "features")
    df = df.select(*S.JOIN_KEYS, *S.WEATHER_COLUMNS, *R.existing(df, [ORDINAL])).withColumns({c: to_number(F.col(c)) for c in [S.YEAR, *S.WEATHER_COLUMNS]})
    return R.drop_missing(df, [S.YEAR]).withColumn(S.YEAR, exact_to_int(F.col(S.YEAR)))


def coordinates(raw: DataFrame) -> DataFrame | None:
    """Distinct places with both coordinates, or None if the table has none."""
    if not R.has_columns(raw, S.COORD_COLUMNS):
        return None
    df = R.distinct_rows(_clean(raw, S.ENTITY_COLUMNS).select(*S.COORD_COLUMNS))
    df = df.withColumns({c: to_number(F.col(c)) for c in ("latitude", "longitude")})
    return R.drop_missing(df, ["latitude", "longitude"])


def _joined(observations: DataFrame, features: DataFrame) -> DataFrame:
    return R.join_features(observations, features, S.JOIN_KEYS)


def _final(joined: DataFrame, spread: bool = False) -> DataFrame:
    years = [y for _, lo, hi in S.SPLITS for y in (lo, hi)]
    complete = R.drop_missing(R.within(R.drop_missing(joined, ["rain_sum_mm"]), S.YEAR, min(years), max(years)), [S.TARGET])
    lagged = (ordered.add_lag if spread else R.add_lag)(complete, S.TARGET, S.ENTITY_COLUMNS, [S.YEAR, ORDINAL], S.LAG)
    return lagged.drop("latitude", "longitude", ORDINAL)


def prepare(raw_observations: DataFrame, raw_features: DataFrame) -> Prepared:
    """One lazy plan. Both inputs need the ordinal column that read_text_table adds."""
    observations = R.distinct_rows(clean_observations(raw_observations), ORDINAL)
    features = R.first_by_key(clean_features(raw_features), S.JOIN_KEYS, [ORDINAL]).drop(ORDINAL)
    joined = _joined(observations, features)
    return Prepared(observations.drop(ORDINAL), features, joined.drop(ORDINAL), _final(joined), coordinates(raw_observations), observations)


def load(spark: SparkSession, observation_paths: list[str], feature_path: str) -> Prepared:
    """Prefer the first observation file that exists; features are mandatory."""
    tables.require_paths(spark, [feature_path])
    source = tables.first_existing(spark, observation_paths)
    return prepare(tables.read_text_table(spark, source, ORDINAL), tables.read_text_table(spark, feature_path, ORDINAL))


def _counted(df: DataFrame, **metrics: Column) -> tuple[DataFrame, dict[str, Any]]:
    """df written, and metrics of its rows that were taken on the way; `rows` is among them. They are observed in the
    stage that writes, whose tasks count once however often they are tried."""
    seen = Observation()
    kept = tables.cut(df.observe(seen, F.count(F.lit(1)).alias("rows"), *[c.alias(n) for n, c in metrics.items()]))
    return kept, seen.get


def execute(p: Prepared, spread: bool = True) -> Executed:
    """The plan's tables, each computed and written once from the one before, and the summary: shapes, missing ratio, year
    bounds and counts as observed while writing. p remembers them. spread: the lag is taken along ranges, for groups of
    any size."""
    if p.executed is None:
        observations, seen = _counted(p.ordered)
        features, seen_features = _counted(p.features)
        joined, seen_joined = _counted(_joined(observations, features), missing=F.avg(F.col("rain_sum_mm").isNull().cast("double")))
        if seen_joined["rows"] != seen["rows"]:
            raise ValueError(f"the join made {seen_joined['rows']} rows of {seen['rows']}")
        years = range(min(lo for _, lo, _ in S.SPLITS), max(hi for _, _, hi in S.SPLITS) + 1)
        final, seen_final = _counted(_final(joined, spread), **{f"y{y}": F.count_if(F.col(S.YEAR) == y) for y in years})
        by_year = {y: seen_final[f"y{y}"] for y in years if seen_final[f"y{y}"]}
        width = len(final.columns)
        found = {
            "observations": (seen["rows"], len(p.observations.columns)),
            "features": (seen_features["rows"], len(features.columns)),
            "joined": (seen_joined["rows"], len(p.joined.columns)),
            "final": (seen_final["rows"], width),
            **{name: (sum(n for y, n in by_year.items() if lo <= y <= hi), width) for name, lo, hi in S.SPLITS},
            "missing_feature_ratio": seen_joined["missing"],
            "years": (min(by_year), max(by_year)) if by_year else None,
            "coordinates": None if p.coordinates is None else profile.shape(p.coordinates),
            "year_counts": by_year,
        }
        tables.release(observations)
        tables.release(features)
        p.executed = Executed(joined.drop(ORDINAL), final, found)
    return p.executed


def write(p: Prepared, target: str, stamp: str | None = None) -> str | None:
    """All outputs as Parquet; the final table by split, so that reading one split prunes the others.

    They are put in a folder beside the target, which takes the target's place when all are whole; a failure before that
    leaves the old output as it was. With a stamp the old output is kept under a new name, which is returned.
    """
    done, spark = execute(p), p.joined.sparkSession
    with tables.staged(spark, target, stamp) as out:
        tables.write_table(done.joined, f"{out.path}/joined")
        tables.write_table(done.final.withColumn("split", R.split_label(F.col(S.YEAR), S.SPLITS)), f"{out.path}/final", ["split"])
        if p.coordinates is not None:
            tables.write_table(p.coordinates, f"{out.path}/coordinates")
    return out.aside


def write_csv(p: Prepared, target: str) -> None:
    """The same outputs as CSV without an index: coordinates, joined, final and each split."""
    done = execute(p)
    tables.write_csv(done.joined, f"{target}/joined")
    tables.write_csv(done.final, f"{target}/final")
    for name, low, high in S.SPLITS:
        tables.write_csv(R.within(done.final, S.YEAR, low, high), f"{target}/{name}")
    if p.coordinates is not None:
        tables.write_csv(p.coordinates, f"{target}/coordinates")


def write_report(p: Prepared, path: str) -> None:
    """The summary as a text file."""
    tables.write_text(p.joined.sparkSession, path, summary_text(summary(p)))


def summary(p: Prepared) -> dict[str, Any]:
    """Shapes, missing ratio, year bounds and counts, of the same execution that write() puts out."""
    return execute(p).found


def summary_text(found: dict[str, Any]) -> str:
    """The summary as a text report, a line for each entry."""
    return "".join(f"{k}: {' x '.join(map(str, v)) if isinstance(v, tuple) else v}\n" for k, v in found.items())
