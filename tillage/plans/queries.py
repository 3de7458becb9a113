"""The registered queries on the star-schema tables, and the same results as DuckDB SQL.

orders are the observations (entity: customer and priority; year of the order date; target: total price), lineitem
summed by order is the feature table, events are the daily series.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tillage.functions.cleaning import SPACE, clean_text, to_number
from tillage.operators import daily, models, profile, relational as R
from tillage.operators.metrics import metrics_table
from tillage.plans import benchmark
from tillage.sources.tables import cut, read_table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}

SPLITS = [("train", 1995, 1999), ("validation", 2000, 2000), ("test", 2001, 2001)]
GROUP = ["o_custkey", "o_orderpriority"]


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql is not None:
            ORACLE[name] = sql
        return f

    return add


def orders(spark: SparkSession, d: str) -> DataFrame:
    return read_table(spark, d, "orders").withColumn("o_year", F.year("o_orderdate"))


def dated(df: DataFrame, low: int, high: int) -> DataFrame:
    """Orders of the years low..high: the range is put on the stored column, so that it is a pushed filter of the scan."""
    first, past = (F.lit(f"{y}-01-01").cast("timestamp_ntz") for y in (low, high + 1))
    return df.where((F.col("o_orderdate") >= first) & (F.col("o_orderdate") < past))


def line_features(spark: SparkSession, d: str) -> DataFrame:
    lines = read_table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey"))
    return lines.agg(F.sum(F.col("l_quantity").cast("decimal(18,2)")).cast("double").alias("quantity_sum"), F.count(F.lit(1)).alias("lines"), F.max("l_discount").alias("discount_max"))


def observations(spark: SparkSession, d: str) -> DataFrame:
    """Joined, complete, restricted to the years and with the lag: the final table of the pipeline."""
    joined = R.join_features(dated(orders(spark, d), 1995, 2001), line_features(spark, d), ["o_orderkey"])
    complete = R.drop_missing(joined, ["quantity_sum", "o_totalprice"])
    lagged = R.add_lag(complete, "o_totalprice", GROUP, ["o_year", "o_orderkey"], "lag_price")
    return lagged.select("o_orderkey", *GROUP, "o_year", "o_totalprice", "quantity_sum", "lines", "discount_max", "lag_price")


def split(df: DataFrame, name: str) -> DataFrame:
    return R.within(df, "o_year", *next(s[1:] for s in SPLITS if s[0] == name))


FEATURES_SQL = """feats as (select l_orderkey as o_orderkey, cast(sum(cast(l_quantity as decimal(18,2))) as double) as quantity_sum,
  count(*) as lines, max(l_discount) as discount_max from lineitem group by l_orderkey)"""
FINAL_SQL = f"""{FEATURES_SQL}, obs as (select o.o_orderkey, o_custkey, o_orderpriority, cast(year(o_orderdate) as int) as o_year,
  o_totalprice, quantity_sum, lines, discount_max from orders o join feats f on o.o_orderkey = f.o_orderkey
  where year(o_orderdate) between 1995 and 2001 and o_totalprice is not null and quantity_sum is not null),
final as (select *, lag(o_totalprice) over (partition by o_custkey, o_orderpriority order by o_year, o_orderkey) as lag_price from obs)"""
NUMERIC = ["o_year", "quantity_sum", "lines", "discount_max", "lag_price"]


@query("final_table", f"with {FINAL_SQL} select * from final")
def _(spark, d):
    return observations(spark, d)


def _sql_clean(c: str) -> str:
    return f"regexp_replace(regexp_replace({c}, '{SPACE}', ' ', 'g'), '^ | $', '', 'g')"


@query("clean_text", f"select p_partkey, {_sql_clean("concat('  ', p_name, chr(9), ' ', chr(160), p_type, ' ')")} as cleaned from part")
def _(spark, d):
    dirty = F.concat(F.lit("  "), "p_name", F.lit("\t  "), "p_type", F.lit(" "))
    return read_table(spark, d, "part").select("p_partkey", clean_text(dirty).alias("cleaned"))


@query("clean_documents", f"select doc_id, {_sql_clean('text')} as cleaned from documents")
def _(spark, d):
    return read_table(spark, d, "documents").select("doc_id", clean_text(F.col("text")).alias("cleaned"))


@query("to_number", "select p_partkey, try_cast(substr(p_brand, 7) as double) as brand_number, try_cast(substr(p_name, 1, 3) as double) as name_number from part")
def _(spark, d):
    part = read_table(spark, d, "part")
    return part.select("p_partkey", to_number(F.substr("p_brand", F.lit(7))).alias("brand_number"), to_number(F.substr("p_name", F.lit(1), F.lit(3))).alias("name_number"))


@query("require_project", "select c_custkey, c_name, c_nationkey from customer")
def _(spark, d):
    return R.project(read_table(spark, d, "customer"), ["c_custkey", "c_name", "c_nationkey"]).drop("latitude", "longitude")


@query("drop_missing", "select * from (select c_custkey, nullif(c_nationkey, 3) as nation, nullif(c_mktsegment, 'BUILDING') as segment from customer) where nation is not null and segment is not null")
def _(spark, d):
    df = read_table(spark, d, "customer").select("c_custkey", F.nullif("c_nationkey", F.lit(3)).alias("nation"), F.nullif("c_mktsegment", F.lit("BUILDING")).alias("segment"))
    return R.drop_missing(df, ["nation", "segment"])


@query("between_years", "select o_orderkey, cast(year(o_orderdate) as int) as o_year from orders where year(o_orderdate) between 1995 and 1999")
def _(spark, d):
    raw = dated(read_table(spark, d, "orders"), 1995, 1999)
    return raw.select("o_orderkey", F.year("o_orderdate").alias("o_year"))


@query("distinct_rows", "select distinct c_nationkey, c_mktsegment from customer")
def _(spark, d):
    return R.distinct_rows(read_table(spark, d, "customer").select("c_nationkey", "c_mktsegment"))


@query(
    "first_by_key",
    """select l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice from (select *, row_number() over (partition by l_orderkey, l_linenumber
  order by l_partkey, l_suppkey, l_extendedprice, l_quantity) as rn from lineitem) where rn = 1""",
)
def _(spark, d):
    lines = read_table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity")
    return R.first_by_key(lines, ["l_orderkey", "l_linenumber"], ["l_partkey", "l_suppkey", "l_extendedprice", "l_quantity"]).drop("l_quantity")


@query("duplicate_count", "select count(*) - (select count(*) from (select distinct text from documents)) as duplicate_rows from documents")
def _(spark, d):
    return R.duplicate_count(read_table(spark, d, "documents").select("text"))


@query("pair_count", "select count(*) as n from (select distinct lang, source from documents)")
def _(spark, d):
    return R.distinct_tuples(read_table(spark, d, "documents"), ["lang", "source"])


@query("left_join_features", f"with {FEATURES_SQL} select o.o_orderkey, o_custkey, o_totalprice, quantity_sum, lines, discount_max from orders o left join feats f on o.o_orderkey = f.o_orderkey")
def _(spark, d):
    joined = R.join_features(orders(spark, d), line_features(spark, d), ["o_orderkey"])
    return joined.select("o_orderkey", "o_custkey", "o_totalprice", "quantity_sum", "lines", "discount_max")


@query(
    "nullsafe_join",
    """select c_custkey, k, n_name from (select c_custkey, nullif(c_nationkey, 3) as k from customer) c
  left join (select nullif(n_nationkey, 3) as nk, n_name from nation) n on c.k is not distinct from n.nk""",
)
def _(spark, d):
    left = read_table(spark, d, "customer").select("c_custkey", F.nullif("c_nationkey", F.lit(3)).alias("k"))
    right = read_table(spark, d, "nation").select(F.nullif("n_nationkey", F.lit(3)).alias("k"), "n_name")
    return R.join_features(left, right, ["k"], validate=True)


@query(
    "missing_ratio",
    f"""with {FEATURES_SQL} select count(*) as joined_rows, count(case when quantity_sum is null then 1 end) as missing_rows,
  avg(case when quantity_sum is null then 1.0::double else 0.0::double end) as missing_ratio from orders o left join feats f on o.o_orderkey = f.o_orderkey""",
)
def _(spark, d):
    joined = R.join_features(orders(spark, d), line_features(spark, d), ["o_orderkey"])
    missing = F.col("quantity_sum").isNull()
    return joined.agg(F.count(F.lit(1)).alias("joined_rows"), F.count_if(missing).alias("missing_rows"), F.avg(missing.cast("double")).alias("missing_ratio"))


@query("repeated_keys", "select l_orderkey, l_linenumber, count(*) as n from lineitem group by all having count(*) > 1")
def _(spark, d):
    return R.repeated_keys(read_table(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"])


_PROFILED = ["c_nationkey", "c_mktsegment", "c_name"]


@query(
    "column_profile",
    " union all ".join(
        f"select '{c}' as column_name, cast(count(*) - count({e}) as bigint) as missing, (count(*) - count({e})) / count(*)::double as missing_ratio, count(distinct {e}) as distinct_values from customer"
        for c, e in [(c, "nullif(c_mktsegment, 'BUILDING')" if c == "c_mktsegment" else c) for c in _PROFILED]
    ),
)
def _(spark, d):
    df = read_table(spark, d, "customer").withColumn("c_mktsegment", F.nullif("c_mktsegment", F.lit("BUILDING")))
    return profile.column_profile(df, _PROFILED)


@query(
    "describe",
    """select count(o_totalprice) as n, round(avg(o_totalprice), 6) as mean, round(stddev_samp(o_totalprice), 4) as std, min(o_totalprice) as min,
  round(quantile_cont(o_totalprice, 0.25), 6) as q25, round(quantile_cont(o_totalprice, 0.5), 6) as q50, round(quantile_cont(o_totalprice, 0.75), 6) as q75, max(o_totalprice) as max from orders""",
)
def _(spark, d):
    found = profile.describe(read_table(spark, d, "orders"), "o_totalprice")
    places = {"mean": 6, "std": 4, "q25": 6, "q50": 6, "q75": 6}
    return found.select(*[F.round(c, places[c]).alias(c) if c in places else F.col(c) for c in found.columns])


@query("value_counts", "select cast(year(o_orderdate) as int) as o_year, count(*) as n from orders group by 1 order by 1")
def _(spark, d):
    return profile.value_counts(orders(spark, d), "o_year")


@query("year_bounds", "select min(cast(year(o_orderdate) as int)) as low, max(cast(year(o_orderdate) as int)) as high, count(*) as n from orders")
def _(spark, d):
    return orders(spark, d).agg(F.min("o_year").alias("low"), F.max("o_year").alias("high"), F.count(F.lit(1)).alias("n"))


@query("lag_target", f"with {FINAL_SQL} select o_orderkey, o_year, o_totalprice, lag_price from final")
def _(spark, d):
    return observations(spark, d).select("o_orderkey", "o_year", "o_totalprice", "lag_price")


@query("head", "select o_orderkey, o_custkey, o_totalprice from orders order by o_custkey, o_orderkey limit 5")
def _(spark, d):
    return R.head(read_table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_totalprice"), ["o_custkey", "o_orderkey"])


@query(
    "chronological_split",
    f"""with {FINAL_SQL} select case when o_year between 1995 and 1999 then 'train' when o_year = 2000 then 'validation' when o_year = 2001 then 'test' end as split,
  count(*) as n, min(o_year) as low, max(o_year) as high from final group by 1""",
)
def _(spark, d):
    labelled = observations(spark, d).withColumn("split", R.split_label(F.col("o_year"), SPLITS))
    return profile.group_bounds(labelled, "split", "o_year")


_METRICS_SQL = """select '{0}' as model, round(avg(abs(y - p)), 4) as mae, round(sqrt(avg((y - p) * (y - p))), 4) as rmse,
  round(1 - avg((y - p) * (y - p)) / var_pop(y), 8) as r2 from (select o_totalprice as y, {1} as p from final, stats where o_year = 2000)"""
_STATS_SQL = "stats as (select avg(o_totalprice) as m, median(o_totalprice) as md from final where o_year between 1995 and 1999)"


def _rounded(metrics: DataFrame) -> DataFrame:
    return metrics.select("model", F.round("mae", 4).alias("mae"), F.round("rmse", 4).alias("rmse"), F.round("r2", 8).alias("r2"))


@query("baselines", f"with {FINAL_SQL}, {_STATS_SQL} " + " union all ".join(_METRICS_SQL.format(*x) for x in [("train_mean", "m"), ("train_median", "md"), ("historical", "coalesce(lag_price, md)")]))
def _(spark, d):
    final = cut(observations(spark, d))  # the join and the lag once, for the constants and for the scores
    return _rounded(benchmark.baselines(split(final, "train"), split(final, "validation"), "o_totalprice", "lag_price"))


@query("median_impute", f"with {FINAL_SQL}, {_STATS_SQL}, lm as (select median(lag_price) as lmd from final where o_year between 1995 and 1999) select o_orderkey, coalesce(lag_price, lmd) as lag_price from final, lm")
def _(spark, d):
    final = observations(spark, d)
    return models.impute(final, models.medians(split(final, "train"), ["lag_price"]), ["lag_price"]).select("o_orderkey", "lag_price")


@query(
    "scale",
    f"""with {FINAL_SQL}, s as (select coalesce(nullif(stddev_pop(quantity_sum), 0), 1) as a, coalesce(nullif(stddev_pop(lines), 0), 1) as b from final where o_year between 1995 and 1999)
  select o_orderkey, round(quantity_sum / a, 8) as quantity_sum, round(lines / b, 8) as lines from final, s where o_year = 2000""",
)
def _(spark, d):
    final, columns = observations(spark, d), ["quantity_sum", "lines"]
    scaled = models.scale(split(final, "validation"), models.population_scales(split(final, "train"), columns), columns)
    return scaled.select("o_orderkey", *[F.round(c, 8).alias(c) for c in columns])


@query(
    "mode_impute",
    """with c as (select c_custkey, nullif(c_mktsegment, 'BUILDING') as segment from customer),
  m as (select segment as mode from c where segment is not null group by segment order by count(*) desc, segment limit 1)
  select c_custkey, coalesce(segment, mode) as segment from c, m""",
)
def _(spark, d):
    df = read_table(spark, d, "customer").select("c_custkey", F.nullif("c_mktsegment", F.lit("BUILDING")).alias("segment"))
    return models.impute(df, models.most_frequent(df, "segment"), ["segment"])


_GRAM = [(a, b) for i, a in enumerate(NUMERIC[:4]) for b in NUMERIC[i:4]]


@query("gram_matrix", f"with {FINAL_SQL} " + " union all ".join(f"select '{a}' as a, '{b}' as b, round(avg({a}::double * {b}::double), 4) as moment from final" for a, b in _GRAM))
def _(spark, d):
    sums = observations(spark, d).agg(*[F.avg(F.col(a).cast("double") * F.col(b).cast("double")).alias(f"m{i}") for i, (a, b) in enumerate(_GRAM)])
    rows = F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.round(f"m{i}", 4).alias("moment")) for i, (a, b) in enumerate(_GRAM)]))
    return sums.select(rows.alias("x")).select("x.*")


@query(
    "season_features",
    """select user_id, round(sum(value), 6) as value_sum, round(avg(value), 6) as value_mean, count(case when value >= 50 then 1 end) as high_days
  from (select user_id, cast(ts as date) as day, sum(value) as value from events group by all) group by user_id""",
)
def _(spark, d):
    by_day = read_table(spark, d, "events").groupBy("user_id", F.col("ts").cast("date").alias("day")).agg(F.sum("value").alias("value"))
    found = daily.season_features(by_day, ["user_id"], ["value"], ["value"], {"high_days": F.col("value") >= 50})
    return found.select("user_id", F.round("value_sum", 6).alias("value_sum"), F.round("value_mean", 6).alias("value_mean"), "high_days")


@query(
    "longest_spell",
    """with days as (select user_id, cast(ts as date) as day, bool_or(coalesce(value >= 50, false)) as hit from events group by all),
  runs as (select user_id, count(*) as n from (select user_id, day - cast(row_number() over (partition by user_id order by day) as int) as island from days where hit) group by user_id, island)
  select d.user_id, cast(coalesce(max(n), 0) as bigint) as longest_spell from (select distinct user_id from days) d left join runs r on d.user_id = r.user_id group by d.user_id""",
)
def _(spark, d):
    events = read_table(spark, d, "events").select("user_id", F.col("ts").cast("date").alias("day"), "value")
    return daily.longest_spell(events, ["user_id"], "day", F.col("value") >= 50)


@query("metrics_table", f"with {FINAL_SQL}, stats as (select 1) " + " union all ".join(_METRICS_SQL.format(*x) for x in [("quantity", "quantity_sum"), ("zero", "0.0::double")]))
def _(spark, d):
    held = split(observations(spark, d), "validation")
    return _rounded(metrics_table(held, "o_totalprice", {"quantity": "quantity_sum", "zero": F.lit(0.0)}))


@query("model_benchmark")
def _(spark, d):
    final = cut(observations(spark, d))
    return benchmark.run(split(final, "train"), split(final, "validation"), "o_totalprice", "lag_price", NUMERIC, ["o_orderpriority"])
