"""Registered queries on sources, sinks, edge rows and fitted models; each with the same result as DuckDB SQL."""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from tillage import schemas as S
from tillage.functions.cleaning import exact_to_int, to_number, truncate_to_int
from tillage.operators import daily, models, ordered, profile, relational as R
from tillage.plans import benchmark, crop
from tillage.plans.queries import FINAL_SQL, NUMERIC, dated, line_features, observations, orders, query, split
from tillage.sources import tables
from tillage.sources.tables import cut, read_table

# -- sources and sinks: written below spark.checkpoint.dir and read back


@query("csv_scan", "select p_partkey, p_name, p_size, p_retailprice, cast(null as varchar) as note from part")
def _(spark, d):
    """The preferred file is absent, the second is read: header, quotes, commas and line ends in texts, missing tokens."""
    at = tables.scratch(spark)
    part = read_table(spark, d, "part").select("p_partkey", F.concat(F.lit('"'), "p_name", F.lit('", x')).alias("p_name"), "p_size", "p_retailprice", F.lit("N/A").alias("note"))
    tables.write_csv(part, f"{at}/part")
    tables.require_paths(spark, [f"{at}/part"])
    back = tables.read_text_table(spark, tables.first_existing(spark, [f"{at}/absent", f"{at}/part"]))
    name = F.regexp_replace("p_name", '^"|", x$', "")
    return back.select(exact_to_int(to_number(F.col("p_partkey"))).cast("long").alias("p_partkey"), name.alias("p_name"), exact_to_int(to_number(F.col("p_size"))).alias("p_size"), to_number(F.col("p_retailprice")).alias("p_retailprice"), "note")


@query("csv_first_by_ordinal", "select o_custkey, min(o_orderkey) as o_orderkey from orders group by o_custkey")
def _(spark, d):
    """First row of each key by file order, from the places that the scan gives its rows."""
    at = tables.scratch(spark)
    rows = read_table(spark, d, "orders").select("o_custkey", "o_orderkey").repartitionByRange(4, "o_orderkey").sortWithinPartitions("o_orderkey")
    tables.write_csv(rows, f"{at}/orders")
    back = tables.read_text_table(spark, f"{at}/orders", crop.ORDINAL).withColumns({c: to_number(F.col(c)).cast("long") for c in ("o_custkey", "o_orderkey")})
    return R.first_by_key(back, ["o_custkey"], [crop.ORDINAL]).select("o_custkey", "o_orderkey")


@query("raw_copy", "select * from region")
def _(spark, d):
    at = tables.scratch(spark)
    tables.copy_raw(spark, f"{d}/region.parquet", f"{at}/region.parquet")
    return read_table(spark, at, "region")


@query("raw_copy_folder", "select o_orderkey, o_custkey, o_totalprice from orders")
def _(spark, d):
    """Many files below folders, copied by tasks; a file is as long as it was, and has its checksum."""
    at = tables.scratch(spark)
    tables.write_table(read_table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_totalprice").repartition(12), f"{at}/a/orders.parquet")
    copied = tables.copy_raw(spark, f"{at}/a", f"{at}/b")
    if not copied.where("bytes > 0 and length(sha256) = 64 and endswith(name, '.parquet')").count() >= 1:
        raise OSError("nothing was copied")
    return read_table(spark, f"{at}/b", "orders")


_LINES = ["l_orderkey", "l_partkey", "l_linenumber", "l_quantity", "l_returnflag", "spread"]


@query(
    "column_profile_dense",
    " union all ".join(
        f"select '{c}' as column_name, cast(count(*) - count({e}) as bigint) as missing, (count(*) - count({e})) / count(*)::double as missing_ratio, count(distinct {e}) as distinct_values from lineitem"
        for c, e in [(c, {"l_partkey": "nullif(l_partkey, 7)", "spread": "(l_partkey * 1000000007 - 5)"}.get(c, c)) for c in _LINES]
    ),
)
def _(spark, d):
    """Keys close together go as bitmaps, others by their values."""
    df = read_table(spark, d, "lineitem").withColumn("spread", F.col("l_partkey").cast("long") * 1000000007 - 5).withColumn("l_partkey", F.nullif("l_partkey", F.lit(7)))
    return profile.column_profile(df, _LINES)


@query("versioned_output", "select 'aside' as output, count(*) as n from nation union all select 'current', count(*) from region")
def _(spark, d):
    at = tables.scratch(spark)
    tables.write_table(read_table(spark, d, "nation"), f"{at}/out")
    aside = tables.versioned(spark, f"{at}/out", "first")
    tables.write_table(read_table(spark, d, "region"), f"{at}/out")
    counts = [spark.read.parquet(path).agg(F.lit(name).alias("output"), F.count(F.lit(1)).alias("n")) for name, path in (("aside", aside), ("current", f"{at}/out"))]
    return counts[0].unionByName(counts[1])


#: orders and the sums of their lines under the names of the data model, as text; every fifth district has no features.
_CROP_SQL = """obs as (select o_orderpriority as state, 'd' || o_custkey % 40 as district, (year(o_orderdate) - 1995) * 3 + 1996 as y, 's' || o_custkey % 2 as season, 'c' || o_custkey % 3 as crop, o_orderkey, o_totalprice,
    o_custkey % 40 as place from orders),
  feats as (select state, district, y, season, crop from obs join lineitem on l_orderkey = o_orderkey where place % 5 <> 0 group by all),
  joined as (select obs.*, f.y is not null as has from obs left join feats f using (state, district, y, season, crop)),
  final as (select * from joined where has and y between 1997 and 2014)"""


def _crop_tables(spark, d) -> crop.Prepared:
    """The data model's two raw tables, written as CSV and loaded as the pipeline does."""
    at = tables.scratch(spark)
    place = F.col("o_custkey") % 40
    obs = read_table(spark, d, "orders").select(
        F.concat(F.lit("  "), "o_orderpriority").alias("State_Name"), F.concat(F.lit("d"), place).alias("District_Name"), ((F.year("o_orderdate") - 1995) * 3 + 1996).alias("Crop_Year"), F.concat(F.lit("s"), F.col("o_custkey") % 2, F.lit(" ")).alias("Season"),
        F.concat(F.lit("c"), F.col("o_custkey") % 3).alias("Crop"), F.lit(1.5).alias("Area"), F.col("o_orderkey").alias("Production"), F.col("o_totalprice").alias("yield"), place.alias("place"),
    )
    lines = read_table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("Production")).agg(F.sum(F.col("l_quantity").cast("decimal(18,2)")).alias("q"))
    rain = obs.where("place % 5 <> 0").join(lines, "Production").groupBy(*S.JOIN_KEYS).agg(F.sum("q").alias("rain_sum_mm"))
    rain = rain.select(*S.JOIN_KEYS, "rain_sum_mm", *[F.lit(k).alias(c) for k, c in enumerate(S.WEATHER_COLUMNS[1:])])
    tables.write_csv(obs.orderBy("Production").drop("place"), f"{at}/observations")  # so that the file order is that of keys
    tables.write_csv(rain, f"{at}/features")
    return crop.load(spark, [f"{at}/absent", f"{at}/observations"], f"{at}/features")


@query(
    "summary_report",
    f"""with {_CROP_SQL}
  select 'observations: ' || count(*) || ' x 8' as line from obs union all select 'features: ' || count(*) || ' x 19' from feats union all select 'joined: ' || count(*) || ' x 22' from joined
  union all select 'final: ' || count(*) || ' x 23' from final union all select 'train: ' || count_if(y <= 2010) || ' x 23' from final
  union all select 'validation: ' || count_if(y between 2011 and 2012) || ' x 23' from final union all select 'test: ' || count_if(y >= 2013) || ' x 23' from final
  union all select 'missing per mille: ' || cast(floor(avg(case when has then 0.0::double else 1.0::double end) * 1000) as int) from joined
  union all select 'years: ' || min(y) || ' x ' || max(y) from final union all select 'coordinates: None'
  union all select 'year_counts: {{' || string_agg(y || ': ' || n, ', ' order by y) || '}}' from (select y, count(*) as n from final group by y)""",
)
def _(spark, d):
    """The whole pipeline: raw tables as CSV, outputs published, the summary observed while they were written, as a text
    file that is read back."""
    at, prepared = tables.scratch(spark), _crop_tables(spark, d)
    crop.write(prepared, f"{at}/out")
    crop.write_report(prepared, f"{at}/summary.txt")
    line = F.col("value")
    ratio = F.concat(F.lit("missing per mille: "), F.floor(F.regexp_extract(line, "([0-9.eE-]+)$", 1).try_cast("double") * 1000))
    return spark.read.text(f"{at}/summary.txt").select(F.when(line.startswith("missing"), ratio).otherwise(line).alias("line"))


@query("published_final", f"with {_CROP_SQL} select case when y <= 2010 then 'train' when y <= 2012 then 'validation' else 'test' end as split, o_orderkey, lag(o_totalprice) over (partition by state, district, season, crop order by y, o_orderkey) as lag_yield from final")
def _(spark, d):
    """What the pipeline published, the lag along ranges: the rows before it in the file are those of smaller keys."""
    at, prepared = tables.scratch(spark), _crop_tables(spark, d)
    crop.write(prepared, f"{at}/out")
    return spark.read.parquet(f"{at}/out/final").select("split", F.col("Production").cast("long").alias("o_orderkey"), "lag_yield")


@query("staged_output", "select 'after an error' as moment, count(*) as n from nation union all select 'after a crash', count(*) from region union all select 'kept aside', count(*) from nation")
def _(spark, d):
    """A failing write leaves the old output; a crash between the two renames is mended before the next reader."""
    at, counts = f"{tables.scratch(spark)}/out", []
    nation, region = read_table(spark, d, "nation"), read_table(spark, d, "region")
    with tables.staged(spark, at) as out:
        tables.write_table(nation, out.path)
    try:
        with tables.staged(spark, at) as out:
            tables.write_table(region.withColumn("bad", F.assert_true(F.col("r_regionkey") < 0)), out.path)
    except Exception as error:  # noqa: BLE001 - Spark's own, of the failing rows
        if "USER_RAISED" not in str(error) and "is not true" not in str(error):
            raise
    count = lambda path, moment: spark.read.parquet(path).agg(F.lit(moment).alias("moment"), F.count(F.lit(1)).alias("n"))
    counts.append(tables.cut(count(at, "after an error")))
    crashed = tables.staged(spark, at, "first")
    tables.write_table(region, crashed.path)
    tables.write_text(spark, f"{crashed.path}/_STAGED", "")
    aside = tables.versioned(spark, at, "first")  # and here it ends
    tables.recover(spark, at)
    counts += [count(at, "after a crash"), count(aside, "kept aside")]
    return counts[0].unionByName(counts[1]).unionByName(counts[2])


@query("results_sink", f"with {FINAL_SQL} select 'zero' as model, cast(round(avg(abs(o_totalprice)), 2) as double) as mae from final where o_year = 2000")
def _(spark, d):
    """The benchmark's results table as CSV without an index."""
    held = split(observations(spark, d), "validation")
    found = benchmark.metrics_table(held, "o_totalprice", {"zero": F.lit(0.0)})
    path = f"{tables.scratch(spark)}/results"
    tables.write_csv(found, path, single_file=True)
    return tables.read_text_table(spark, path).select("model", F.round(to_number(F.col("mae")), 2).alias("mae"))


# -- projections and functions


@query("has_columns", "select c_custkey, c_name, true as all_present, false as with_coordinates, null::double as latitude from customer")
def _(spark, d):
    """An optional branch: coordinates are taken where the table has them."""
    customer = read_table(spark, d, "customer")
    with_coordinates = R.has_columns(customer, ["c_custkey", "latitude"])
    latitude = F.col("latitude") if with_coordinates else F.lit(None)
    return customer.select("c_custkey", "c_name", F.lit(R.has_columns(customer, ["c_custkey", "c_name"])).alias("all_present"), F.lit(with_coordinates).alias("with_coordinates"), latitude.cast("double").alias("latitude"))


@query("feature_columns", f"with {FINAL_SQL} select o_year as \"Crop_Year\", lines as \"Area\", lag_price as lag_yield, quantity_sum as rain_sum_mm, o_custkey as \"State_Name\", o_orderpriority as \"Crop\", o_totalprice as target from final")
def _(spark, d):
    """The features that a table of the data model has, with the target: never Production."""
    names = {"o_orderkey": "Production", "o_custkey": "State_Name", "o_year": "Crop_Year", "o_totalprice": "yield", "quantity_sum": "rain_sum_mm", "lag_price": "lag_yield", "lines": "Area", "o_orderpriority": "Crop"}
    df = observations(spark, d).withColumnsRenamed(names)
    numeric, categorical = benchmark.feature_columns(df)
    x, y = benchmark.separate(df, [*numeric, *categorical], S.TARGET)
    return df.select(*x.columns, *[F.col(c).alias("target") for c in y.columns])


@query("integer_casts", "select o_orderkey, cast(trunc(o_totalprice / -7) as int) as truncated, cast(o_custkey as int) as whole from orders")
def _(spark, d):
    raw = read_table(spark, d, "orders")
    return raw.select("o_orderkey", truncate_to_int(F.col("o_totalprice") / -7).alias("truncated"), exact_to_int(F.col("o_custkey").cast("double")).alias("whole"))


@query("flags", "select event_id, case when nullif(event_type, 'click') is null then null when value >= 50 then 1.0::double else 0.0::double end as high from events")
def _(spark, d):
    known = F.nullif("event_type", F.lit("click")).isNotNull()
    return read_table(spark, d, "events").select("event_id", daily.flag(F.when(known, F.col("value") >= 50)).alias("high"))


@query("sort_nulls_last", "select c_custkey, cast(row_number() over (order by nullif(c_nationkey, 3) asc nulls last, nullif(c_mktsegment, 'BUILDING') asc nulls last, c_custkey) as int) as place from customer")
def _(spark, d):
    """Places of a sort by several keys with nulls; the window is global only to show them, the operator is a range sort."""
    df = read_table(spark, d, "customer").select("c_custkey", F.nullif("c_nationkey", F.lit(3)).alias("nation"), F.nullif("c_mktsegment", F.lit("BUILDING")).alias("segment"))
    return ordered.places(df, ["nation", "segment", "c_custkey"]).select("c_custkey", F.col("place").cast("int").alias("place"))


# -- edge rows


@query("empty_bounds", "select count(*) as n, min(cast(year(o_orderdate) as int)) as low, max(cast(year(o_orderdate) as int)) as high from orders where o_orderkey < 0")
def _(spark, d):
    return orders(spark, d).where("o_orderkey < 0").agg(F.count(F.lit(1)).alias("n"), F.min("o_year").alias("low"), F.max("o_year").alias("high"))


@query(
    "column_profile_edges",
    """select 'zero' as column_name, cast(count_if(v is null) as bigint) as missing, count_if(v is null) / count(*)::double as missing_ratio, cast(count(distinct v) as bigint) as distinct_values
  from (select case when c_custkey % 5 = 0 then null else 0.0::double end as v from customer)
  union all select 'none', count(*), 1.0, 0 from customer""",
)
def _(spark, d):
    """0.0 and -0.0 are one value; a column may have none."""
    zero = F.when(F.col("c_custkey") % 5 == 0, None).when(F.col("c_custkey") % 2 == 0, F.lit(0.0)).otherwise(F.lit(-0.0))
    return profile.column_profile(read_table(spark, d, "customer").select(zero.alias("zero"), F.lit(None).cast("string").alias("none")), ["zero", "none"])


@query("column_profile_empty", "select * from (values ('c_name', 0::bigint, null::double, 0::bigint), ('c_acctbal', 0, null, 0)) t(column_name, missing, missing_ratio, distinct_values)")
def _(spark, d):
    return profile.column_profile(read_table(spark, d, "customer").where("c_custkey < 0"), ["c_name", "c_acctbal"])


@query("quantiles_by_rank", "select round(quantile_cont(l_extendedprice, 0.25), 6) as q25, round(quantile_cont(l_extendedprice, 0.5), 6) as q50, round(quantile_cont(l_extendedprice, 0.75), 6) as q75 from lineitem")
def _(spark, d):
    """Ranks found by running sums over the values in the brackets, as for columns of very many values."""
    found = profile.describe(read_table(spark, d, "lineitem"), "l_extendedprice", few=0)
    return found.select(*[F.round(c, 6).alias(c) for c in ("q25", "q50", "q75")])


_DESCRIBED = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@query(
    "describe_columns",
    " union all ".join(
        f"select '{c}' as column_name, count({c}) as n, round(avg({c}), 6) as mean, round(stddev_samp({c}), 4) as std, cast(min({c}) as double) as min, "
        f"round(quantile_cont({c}, 0.25), 6) as q25, round(quantile_cont({c}, 0.5), 6) as q50, round(quantile_cont({c}, 0.75), 6) as q75, cast(max({c}) as double) as max from lineitem"
        for c in _DESCRIBED
    ),
)
def _(spark, d):
    """Two passes over the table for all columns."""
    found = profile.describe_columns(read_table(spark, d, "lineitem"), _DESCRIBED)
    places = {"mean": 6, "std": 4, "q25": 6, "q50": 6, "q75": 6}
    return found.select(*[F.round(c, places[c]).alias(c) if c in places else F.col(c) for c in found.columns])


_HOT = "case when o_orderkey % 2 = 0 then 0 else o_custkey end"


@query("lag_hot_group", f"select o_orderkey, g, lag(o_totalprice) over (partition by g order by o_orderdate, o_orderkey) as lag_price, cast(sum(cast(o_totalprice as decimal(18, 2))) over (partition by g order by o_orderdate, o_orderkey) as double) as spent from (select *, {_HOT} as g from orders)")
def _(spark, d):
    """Lag and running sum where one group has half of all rows: it is spread over ranges, each of one task."""
    hot = read_table(spark, d, "orders").select("o_orderkey", F.expr(f"cast({_HOT} as bigint)").alias("g"), "o_orderdate", "o_totalprice")
    found = ordered.along(hot, ["g"], ["o_orderdate", "o_orderkey"], sums={"spent": F.col("o_totalprice").cast("decimal(18,2)")}, lags={"lag_price": "o_totalprice"})
    return found.select("o_orderkey", "g", "lag_price", F.col("spent").cast("double").alias("spent"))


@query(
    "longest_spell_nulls",
    """with e as (select nullif(user_id % 50, 7) as user_key, case when event_id % 11 = 0 then null else cast(ts as date) end as day, value from events),
  days as (select user_key, day, bool_or(coalesce(value >= 50, false)) as hit from e group by all),
  runs as (select user_key, count(*) as n from (select user_key, day - cast(row_number() over (partition by user_key order by day) as int) as island from days where hit and day is not null) group by user_key, island)
  select k.user_key, cast(coalesce(max(n), 0) as bigint) as longest_spell from (select distinct user_key from e) k left join runs r on k.user_key is not distinct from r.user_key group by k.user_key""",
)
def _(spark, d):
    day = F.when(F.col("event_id") % 11 == 0, None).otherwise(F.col("ts").cast("date"))
    events = read_table(spark, d, "events").select(F.nullif(F.col("user_id") % 50, F.lit(7)).alias("user_key"), day.alias("day"), "value")
    return daily.longest_spell(events, ["user_key"], "day", F.col("value") >= 50)


@query(
    "longest_spell_one_series",
    """with days as (select cast(ts as date) as day, bool_or(coalesce(value >= 99, false)) as hit, count(*) as n from events group by 1),
  runs as (select count(*) as n from (select day - cast(row_number() over (order by day) as int) as island from days where hit) group by island)
  select 'all' as series, cast((select coalesce(max(n), 0) from runs) as bigint) as longest_spell""",
)
def _(spark, d):
    """All rows are one series, which is worked on range by range."""
    events = read_table(spark, d, "events").select(F.lit("all").alias("series"), F.col("ts").cast("date").alias("day"), "value")
    return daily.longest_spell(events, ["series"], "day", F.col("value") >= 99, spread=True)


@query("validated_join", "select l_orderkey, l_linenumber, o_orderpriority from lineitem left join (select * from orders where o_orderkey % 3 = 0) on o_orderkey = case when l_orderkey % 2 = 0 then 6 else l_orderkey end")
def _(spark, d):
    """Many to one, checked in the join's own run; half of the left rows have one key."""
    left = read_table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.when(F.col("l_orderkey") % 2 == 0, 6).otherwise(F.col("l_orderkey")).cast("long").alias("o_orderkey"))
    right = read_table(spark, d, "orders").where("o_orderkey % 3 = 0").select(F.col("o_orderkey").cast("long").alias("o_orderkey"), "o_orderpriority")
    return R.join_features(left, right, ["o_orderkey"], validate="in run").drop("o_orderkey")


# -- fitted models


@query(
    "preprocessed",
    f"""with {FINAL_SQL}, t as (select * from final where o_year between 1995 and 1999), md as (select median(lag_price) as m from t),
  s as (select stddev_pop(quantity_sum) as q, stddev_pop(coalesce(lag_price, m)) as l from t, md), c as (select distinct o_orderpriority as level from t),
  v as (select * from final where o_year = 2000)
  select o_orderkey, 0 as place, round(quantity_sum / q, 6) as value from v, s union all select o_orderkey, 1, round(coalesce(lag_price, m) / l, 6) from v, s, md
  union all select o_orderkey, cast(1 + (select count(*) from c c2 where c2.level <= c.level) as int), case when o_orderpriority = level then 1.0::double else 0.0::double end from v, c""",
)
def _(spark, d):
    """Imputed, scaled and one-hot features of the validation rows, fitted on the train rows, an entry a row."""
    final = cut(observations(spark, d))
    prep = models.Preprocessor(["quantity_sum", "lag_price"], ["o_orderpriority"]).fit(split(final, "train"))
    rows = prep.transform(split(final, "validation")).select("o_orderkey", F.posexplode(vector_to_array("features")).alias("place", "value"))
    return rows.select("o_orderkey", "place", F.round("value", 6).alias("value"))


@query(
    "ridge",
    f"""with {FINAL_SQL}, t as (select o_totalprice as y, quantity_sum as a, lines::double as b from final where o_year between 1995 and 1999),
  s as (select stddev_pop(a) as sa, stddev_pop(b) as sb, avg(y) as my, avg(a) as ma, avg(b) as mb, count(*) as n,
    count(*) * var_pop(a) as aa, count(*) * var_pop(b) as bb, count(*) * covar_pop(a, b) as ab, count(*) * covar_pop(a, y) as ay, count(*) * covar_pop(b, y) as yb from t),
  z as (select *, aa / (sa * sa) + 1 as p, bb / (sb * sb) + 1 as q, ab / (sa * sb) as r, ay / sa as u, yb / sb as v from s),
  w as (select *, (u * q - v * r) / (p * q - r * r) as wa, (v * p - u * r) / (p * q - r * r) as wb from z)
  select o_orderkey, round(my + wa * (quantity_sum - ma) / sa + wb * (lines - mb) / sb, 4) as prediction from final, w where o_year = 2000""",
)
def _(spark, d):
    """Ridge with two scaled features against the normal equations."""
    final = cut(observations(spark, d))
    prep = models.Preprocessor(["quantity_sum", "lines"], []).fit(split(final, "train"))
    model = models.fit_ridge(prep.transform(split(final, "train")), "o_totalprice")
    return model.transform(prep.transform(split(final, "validation"))).select("o_orderkey", F.round("prediction", 4).alias("prediction"))


@query(
    "tree_stump",
    f"""with {FINAL_SQL}, t as (select o_totalprice as y, lines as x from final where o_year between 1995 and 1999),
  cuts as (select distinct x as c from t), sse as (select c, sum(case when x <= c then y end) as sl, sum(case when x > c then y end) as sr, count_if(x <= c) as nl, count_if(x > c) as nr from t, cuts group by c),
  best as (select c, sl / nl as l, sr / nr as r from sse where nl >= 20 and nr >= 20 order by sl * sl / nl + sr * sr / nr desc limit 1)
  select o_orderkey, round(case when lines <= c then l else r end, 4) as prediction from final, best where o_year = 2000""",
)
def _(spark, d):
    """A tree of depth 1 against the search for its one threshold."""
    final = cut(observations(spark, d))
    prep = models.Preprocessor(["lines"], []).fit(split(final, "train"))
    model = models.fit_tree(prep.transform(split(final, "train")), "o_totalprice", depth=1)
    return model.transform(prep.transform(split(final, "validation"))).select("o_orderkey", F.round("prediction", 4).alias("prediction"))


#: Rows with their node, level by level: cells of (node, feature, value), sums up to each, the best threshold of a node.
_TREE_SQL = f"""with recursive {FINAL_SQL}, base as materialized (select o_orderkey, o_year, case when o_year < 2000 then o_totalprice end as y, quantity_sum as a, coalesce(lag_price, (select median(lag_price) from final where o_year between 1995 and 1999)) as b,
    case when o_orderpriority = '1-URGENT' then 1.0::double else 0.0::double end as c from final where o_year between 1995 and 2000),
  m as materialized (select avg(y) as m, count(y) * var_pop(y) as total from base),
  t as (select 0 as level, 1::bigint as node, o_orderkey, o_year, y - m as y, a, b, c from base, m
  union all
  select level + 1, case when g.f is null then t.node else t.node * 2 + case when (case g.f when 0 then a when 1 then b else c end) > g.x then 1 else 0 end end, o_orderkey, o_year, t.y, a, b, c
  from t left join (
    select node, arg_max(f, {{'gain': gain, 'f': -f, 'x': -x}}) as f, arg_max(x, {{'gain': gain, 'f': -f, 'x': -x}}) as x from (
      select node, f, (x + before) / 2 as x, round((sl * sl / nl + (s - sl) * (s - sl) / (n - nl) - s * s / n) / total, 12) as gain from (
        select *, lag(x) over w as before, sum(cn) over w - cn as nl, sum(cs) over w - cs as sl, sum(cn) over g as n, sum(cs) over g as s, sum(cq) over g as q from (
          select node, f, x, count(*) as cn, sum(y) as cs, sum(y * y) as cq from (select node, y, unnest([0, 1, 2]) as f, unnest([a, b, c]) as x from t where y is not null) group by all)
        window w as (partition by node, f order by x), g as (partition by node, f)), m
      where before is not null and nl >= 20 and n - nl >= 20 and q - s * s / n > 1e-12 * q)
    group by node) g on t.node = g.node and t.node >= power(2, t.level) where t.level < 12),
  last as (select * from t where level = 12)
  select o_orderkey, round(m + mean + 1.234e-6, 3) as prediction from last join (select node, avg(y) as mean from last where y is not null group by node) using (node), m where o_year = 2000"""


@query("tree", _TREE_SQL)
def _(spark, d):
    """A tree of depth 12, at least 20 rows a leaf, over columns of thousands of values: every midpoint is tried."""
    final = cut(observations(spark, d)).withColumn("urgent", F.when(F.col("o_orderpriority") == "1-URGENT", 1.0).otherwise(0.0))
    middle = models.medians(split(final, "train"), ["lag_price"])
    rows = models.impute(final, middle, ["lag_price"])
    values = F.array(*[F.struct(F.lit(k).cast("long").alias("i"), F.col(c).cast("double").alias("x")) for k, c in enumerate(["quantity_sum", "lag_price", "urgent"])])
    rows = rows.select("o_orderkey", "o_year", "o_totalprice", values.alias("entries"))
    model = models.fit_tree(split(rows, "train"), "o_totalprice")
    # means of cents can lie between two roundings; the shift moves all of them alike
    return model.transform(split(rows, "validation")).select("o_orderkey", F.round(F.col("prediction") + 1.234e-6, 3).alias("prediction"))


@query("dated_scan", "select o_orderkey, o_orderpriority from orders where o_orderdate >= '1997-01-01' and o_orderdate < '1999-01-01'")
def _(spark, d):
    return R.project(dated(read_table(spark, d, "orders"), 1997, 1998), ["o_orderkey", "o_orderpriority"])
