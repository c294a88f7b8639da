"""Queries of feature preparation, folds and metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voltweave.operators import learn, overlay, preprocess
from voltweave.plans.layers import layer, with_layers
from voltweave.plans.queries_join import _LEN, clip_sql
from voltweave.plans.registry import query


def _customers(spark: SparkSession, d: str) -> DataFrame:
    return layer(spark, d, "v_pts")


@query(with_layers("v_pts") + ", q as (select quantile_cont(y, [0.125, 0.25, 0.375, 0.5, 0.625, 0.75, 0.875]) as c from v_pts) select id, cast(len(list_filter(c, lambda t: y >= t)) as integer) as fold from v_pts, q")
def spatial_folds(spark: SparkSession, d: str) -> DataFrame:
    """Eight strips of equal count by latitude."""
    return learn.strip_folds(_customers(spark, d), "y", 8).select("id", "fold")


@query("with l as (select c_custkey as id, cast(c_acctbal > 5000 as integer) as label, (cast(c_custkey as bigint) * 2654435761) % 4294967296 as h from customer) select id, label, cast((row_number() over (partition by label order by h, id) - 1) % 8 as integer) as fold from l")
def strat_folds(spark: SparkSession, d: str) -> DataFrame:
    rows = spark.read.parquet(f"{d}/customer.parquet").select(F.col("c_custkey").alias("id"), (F.col("c_acctbal") > 5000).cast("int").alias("label"))
    return learn.stratified_folds(rows, "label", "id", 8)


def _scored(spark: SparkSession, d: str) -> DataFrame:
    rows = spark.read.parquet(f"{d}/lineitem.parquet")
    return rows.select((F.col("l_returnflag") == "R").cast("int").alias("y"), ((F.col("l_quantity") * 7 + F.col("l_linenumber") * 3) % 101 / 101).alias("s"))


_SC = "with sc as (select cast(l_returnflag = 'R' as integer) as y, (l_quantity * 7 + l_linenumber * 3) % 101 / 101 as s from lineitem), g as (select s, sum(y) as pos, count(*) as n from sc group by s)"


@query(_SC + ", r as (select pos, n, coalesce(sum(n - pos) over (order by s rows between unbounded preceding and 1 preceding), 0) as below from g) select round(sum(pos * (below + (n - pos) / 2.0)) / (sum(pos)::double * sum(n - pos)), 8) as auc from r")
def roc_auc_exact(spark: SparkSession, d: str) -> DataFrame:
    return learn.roc_auc(_scored(spark, d), "s", "y").select(F.round("auc", 8).alias("auc"))


@query(_SC + ", r as (select pos, sum(pos) over (order by s desc) as tp, sum(n) over (order by s desc) as k from g) select round(sum(pos * tp / k::double) / sum(pos), 8) as ap from r")
def avg_precision(spark: SparkSession, d: str) -> DataFrame:
    return learn.average_precision(_scored(spark, d), "s", "y").select(F.round("ap", 8).alias("ap"))


_GRID = [round(0.2 + 0.02 * i, 2) for i in range(31)]


@query(_SC + f", t as (select unnest({_GRID}::double[]) as t), f as (select t, 2.0 * count(*) filter (where y = 1 and s >= t) / (2 * count(*) filter (where y = 1 and s >= t) + count(*) filter (where y = 0 and s >= t) + count(*) filter (where y = 1 and s < t)) as f1 from sc, t group by t) select t as threshold, round(f1, 8) as f1 from f order by f1 desc, t limit 1")
def best_f1_threshold(spark: SparkSession, d: str) -> DataFrame:
    return learn.best_threshold(_scored(spark, d), "s", "y", _GRID).select("threshold", F.round("f1", 8).alias("f1"))


_NUM = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def _holed(spark: SparkSession, d: str) -> DataFrame:
    """Line items with gaps: every seventh discount and every eleventh price is null."""
    rows = spark.read.parquet(f"{d}/lineitem.parquet").select("l_orderkey", "l_linenumber", "l_returnflag", *_NUM)
    return rows.withColumns({"l_discount": F.when(F.col("l_orderkey") % 7 != 0, F.col("l_discount")), "l_extendedprice": F.when(F.col("l_orderkey") % 11 != 0, F.col("l_extendedprice"))})


_HOLED = "h as (select l_orderkey, l_linenumber, l_returnflag, l_quantity, case when l_orderkey % 11 <> 0 then l_extendedprice end as l_extendedprice, case when l_orderkey % 7 <> 0 then l_discount end as l_discount, l_tax from lineitem)"


@query(f"with {_HOLED} select name, nulls from (" + " union all ".join(f"select '{c}' as name, count(*) filter (where {c} is null) as nulls from h" for c in _NUM) + ")")
def nan_report(spark: SparkSession, d: str) -> DataFrame:
    return preprocess.null_report(_holed(spark, d), _NUM)


@query(f"with {_HOLED}, y as (select *, cast(l_returnflag = 'R' as double) as y from h) select name, round(corr, 8) as corr from (" + " union all ".join(f"select '{c}' as name, abs(corr({c}, y)) as corr from y" for c in _NUM) + ") order by corr desc limit 3")
def corr_topk(spark: SparkSession, d: str) -> DataFrame:
    rows = _holed(spark, d).withColumn("y", (F.col("l_returnflag") == "R").cast("double"))
    return preprocess.correlation_report(rows, _NUM, "y", 3).select("name", F.round("corr", 8).alias("corr"))


def _scaled_sql() -> str:
    filled = ", ".join(f"coalesce({c}, 0) as {c}" for c in _NUM)
    q = ", ".join(f"quantile_cont({c}, [0.001, 0.999]) as {c}" for c in _NUM)
    logged = ", ".join(f"ln(1 + greatest(0, least(greatest(f.{c}, q.{c}[1]), q.{c}[2]))) as {c}" for c in _NUM)
    stats = ", ".join(f"quantile_cont({c}, [0.25, 0.5, 0.75]) as {c}" for c in _NUM)
    out = ", ".join(f"round((l.{c} - s.{c}[2]) / coalesce(nullif(s.{c}[3] - s.{c}[1], 0), 1), 6) as {c}" for c in _NUM)
    return f"with {_HOLED}, f as (select l_orderkey, l_linenumber, {filled} from h), q as (select {q} from f), l as (select l_orderkey, l_linenumber, {logged} from f, q), s as (select {stats} from l) select l_orderkey, l_linenumber, {out} from l, s"


@query(_scaled_sql())
def clip_log_robust_scale(spark: SparkSession, d: str) -> DataFrame:
    """Fill, clip at quantiles, log, and scale by median and interquartile range."""
    rows = _holed(spark, d)
    fitted = preprocess.Scaling.fit(rows, _NUM)
    out = fitted.apply(rows, ["l_orderkey", "l_linenumber"])
    return out.select("l_orderkey", "l_linenumber", *[F.round(c, 6).alias(c) for c in _NUM])


@query(f"with {_HOLED}, b as (select l_quantity, l_tax, cast(l_linenumber = 1 as integer) as is_first, l_discount as discount_pct from h) select * from (select 'is_first' as name, 'binary' as kind union all select 'discount_pct', 'pct' union all select 'l_quantity', 'continuous' union all select 'l_tax', 'continuous')")
def class_binary_pct_cont(spark: SparkSession, d: str) -> DataFrame:
    rows = _holed(spark, d).select("l_quantity", "l_tax", (F.col("l_linenumber") == 1).cast("int").alias("is_first"), F.col("l_discount").alias("discount_pct"))
    kinds = preprocess.column_classes(rows, rows.columns)
    return spark.createDataFrame(sorted(kinds.items()), "name string, kind string")


@query(f"with {_HOLED} select l_orderkey, l_linenumber, coalesce(l_extendedprice, l_quantity, 0) as price from h where coalesce(l_returnflag not in ('A'), true)")
def fallback_fill(spark: SparkSession, d: str) -> DataFrame:
    """A missing price falls back to the quantity; rows of one flag are left out."""
    rows = preprocess.excluded(_holed(spark, d), "l_returnflag", ["A"])
    return rows.select("l_orderkey", "l_linenumber", preprocess.filled(["l_extendedprice"], {"l_extendedprice": "l_quantity"})["l_extendedprice"].alias("price"))


@query("with p as (select l_suppkey as id, l_discount as y_proba from lineitem where l_linenumber = 1) select s_suppkey as id, round(coalesce(avg(y_proba), 0), 6) as road_prob from supplier left join p on s_suppkey = p.id group by s_suppkey")
def stack_road_prob(spark: SparkSession, d: str) -> DataFrame:
    """Another unit's predictions, averaged per key, as a feature; 0 where there is none."""
    predictions = spark.read.parquet(f"{d}/lineitem.parquet").where("l_linenumber = 1").select(F.col("l_suppkey").alias("id"), F.col("l_discount").alias("y_proba"))
    target = spark.read.parquet(f"{d}/supplier.parquet").select(F.col("s_suppkey").alias("id"))
    return learn.stacked(target, "id", predictions, "road_prob").select("id", F.round("road_prob", 6).alias("road_prob"))


_LO, _HI = clip_sql("s", "t")


@query(
    with_layers("v_segs")
    + f""", g as (select unnest(range(-1, 41)) as k), t as (select a.k as i, b.k as j, a.k * 500.0::double as minx, b.k * 500.0::double as miny, a.k * 500.0::double + 500 as maxx, b.k * 500.0::double + 500 as maxy, ((a.k * 31 + b.k * 17) % 100) / 100.0::double as p from g a, g b),
    c as (select s.id, t.p, ({_HI} - {_LO}) * {_LEN} as len from v_segs s join t on least(s.x1, s.x2) <= t.maxx and greatest(s.x1, s.x2) >= t.minx and least(s.y1, s.y2) <= t.maxy and greatest(s.y1, s.y2) >= t.miny where {_HI} > {_LO})
    select s.id, round(coalesce(sum(p * len) / sum(len), 0), 6) as tiles_prob from v_segs s left join (select * from c where len > 0) c using (id) group by s.id"""
)
def stack_tile_prob(spark: SparkSession, d: str) -> DataFrame:
    """Length-weighted mean of the tiles' values along each segment."""
    clips = overlay.tile_clips(layer(spark, d, "v_segs"), 500.0)
    p = (F.col("i") * 31 + F.col("j") * 17) % 100 / 100.0
    mean = clips.withColumn("p", p).groupBy("id").agg((F.sum(F.col("p") * F.col("len")) / F.sum("len")).alias("m"))
    return layer(spark, d, "v_segs").join(mean, "id", "left").select("id", F.round(F.coalesce("m", F.lit(0.0)), 6).alias("tiles_prob"))


@query()
def gbt_oof(spark: SparkSession, d: str) -> DataFrame:
    """Boosted trees over line items by order, scored out of fold."""
    rows = spark.read.parquet(f"{d}/orders.parquet").select("o_orderkey", F.col("o_totalprice").alias("price"), (F.col("o_custkey") % 97).cast("double").alias("c97"), F.month("o_orderdate").cast("double").alias("month"), (F.col("o_orderstatus") == "F").cast("int").alias("label0"))
    folds = learn.stratified_folds(rows, "label0", "o_orderkey", 2)
    return learn.out_of_fold(folds, ["price", "c97", "month"], "label0", "fold", "o_orderkey", lambda: learn.boosted_trees(4, 3, 0.1, 0.8, 1.0, 5))


@query()
def kmeans_folds(spark: SparkSession, d: str) -> DataFrame:
    """Five spatial folds by k-means on coordinates."""
    rows, _ = learn.center_folds(_customers(spark, d).select("id", "x", "y"), 5)
    return rows.select("id", "fold")
