"""Queries of the reference operators: name -> callable(spark, sf_dir), and their SQL."""

from __future__ import annotations

import tempfile
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .features import creators, encoders, imputers, scalers, selectors
from .features.pipeline import Pipeline, load_pipeline
from .functions import distributions
from .models import cluster, decomposition, linear, metrics, split, tree
from .operators import agg, join, missing, order, reshape, select, window
from .rows import ROW
from .session import scratch_path
from .sources import csv, frames, json
from .stats import correlation, descriptive, hypothesis
from .streaming import windows

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query, with its SQL if there is one."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _row(spark: SparkSession, ddl: str, *values) -> DataFrame:
    return spark.createDataFrame([values], ddl)


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with their dense ids as positions."""
    return table(spark, sf_dir, "events").withColumn(ROW, F.col("event_id"))


def _gaps(spark: SparkSession, sf_dir: str, *rests: int) -> DataFrame:
    """``event_id`` and ``v``, the value, null where the id leaves one of the rests by 7."""
    e = table(spark, sf_dir, "events")
    return e.select("event_id", F.when(~(F.col("event_id") % 7).isin(*rests), F.col("value")).alias("v"))


# --- the flagship ---------------------------------------------------------

_FLAGSHIP = """
    SELECT c_mktsegment, o_orderpriority, sum(o_totalprice) AS o_totalprice_sum, avg(o_totalprice) AS o_totalprice_mean,
        stddev_samp(o_totalprice) AS o_totalprice_std, median(o_totalprice) AS o_totalprice_median, count(o_orderkey) AS o_orderkey_count
    FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderstatus = 'F' GROUP BY 1, 2
"""


@query(_FLAGSHIP)
def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = select.filter_rows(table(spark, sf_dir, "orders"), F.col("o_orderstatus") == "F")
    joined = join.merge(orders, table(spark, sf_dir, "customer"), "inner", ["o_custkey"], ["c_custkey"])
    grouped = agg.group_by(joined, "c_mktsegment", "o_orderpriority").agg_multiple({"o_totalprice": ["sum", "mean", "std", "median"], "o_orderkey": ["count"]})
    return order.sort_multi(grouped, ["c_mktsegment", "o_totalprice_sum"], [True, False])


# --- sources --------------------------------------------------------------


@query("SELECT c_custkey, c_name, c_nationkey::BIGINT AS c_nationkey, c_acctbal, c_mktsegment FROM customer")
def io_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "csv")
    csv.write_csv(table(spark, sf_dir, "customer"), path)
    return csv.read_csv(spark, path)


@query("SELECT page_id, url, html FROM pages")
def io_csv_multiline(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "csv")
    csv.write_csv(table(spark, sf_dir, "pages"), path, delimiter=";")
    return csv.read_csv(spark, path, delimiter=";", multi_line=True, dtypes={"page_id": "long", "url": "string", "html": "string"})


@query("SELECT c_name FROM customer")
def io_csv_column(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "csv")
    csv.write_csv(table(spark, sf_dir, "customer"), path)
    return csv.read_csv_column(spark, path, "c_name")


@query("SELECT event_id, CASE WHEN event_id % 7 <> 0 THEN value END AS v FROM events")
def io_json_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "json")
    json.write_json(_gaps(spark, sf_dir, 0), path, lines=True)
    return json.read_json(spark, path, lines=True)


@query("SELECT n_nationkey::BIGINT AS n_nationkey, n_name, n_regionkey::BIGINT AS n_regionkey FROM nation")
def io_json_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "json")
    json.write_json(table(spark, sf_dir, "nation"), path)
    return json.read_json(spark, path)


@query("SELECT n_nationkey::DOUBLE AS n_nationkey, n_name FROM nation")
def io_json_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "json")
    json.write_json(table(spark, sf_dir, "nation").select("n_nationkey", "n_name"), path, orient="columns")
    return json.read_json(spark, path, orient="columns", numbers_as_double=True)


@query("SELECT * FROM (VALUES (1, 'a', 1.5), (2, NULL, NULL), (3, 'c', 2.0)) t(k, s, x)".replace("(1,", "(1::BIGINT,").replace("1.5)", "1.5::DOUBLE)"))
def io_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frames.from_records(spark, [{"k": 1, "s": "a", "x": 1.5}, {"k": 2}, {"k": 3, "s": "c", "x": 2}])


@query("SELECT r_regionkey, r_name FROM region")
def io_parquet(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "parquet")
    frames.write_parquet(table(spark, sf_dir, "region"), path)
    return frames.read_parquet(spark, path)


# --- selection and derived columns ----------------------------------------


@query("SELECT l_orderkey, l_quantity, l_extendedprice FROM lineitem")
def select_drop(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = select.select(table(spark, sf_dir, "lineitem"), "l_orderkey", "l_quantity", "no_such_column", "l_extendedprice", "l_tax")
    return select.drop(kept, "l_tax", "no_such_column")


@query("SELECT * FROM orders WHERE o_totalprice > 100000 AND o_orderstatus = 'F'")
def filter_pred(spark: SparkSession, sf_dir: str) -> DataFrame:
    return select.filter_rows(table(spark, sf_dir, "orders"), (F.col("o_totalprice") > 100000) & (F.col("o_orderstatus") == "F"))


@query("SELECT c.* FROM customer c JOIN (VALUES (5),(1),(42),(5)) t(k) ON c.c_custkey = t.k")
def loc_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return select.loc(table(spark, sf_dir, "customer"), [5, 1, 42, 5], "c_custkey")


@query("SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (ORDER BY event_id) - 1 AS rn FROM events) WHERE rn IN (0, 7, 99)")
def iloc_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return select.iloc(table(spark, sf_dir, "events"), [99, 0, 7], order_by="event_id")


@query("SELECT * FROM orders ORDER BY o_orderkey LIMIT 100 OFFSET 50")
def slice_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return select.slice_rows(table(spark, sf_dir, "orders"), 50, 150, order_by="o_orderkey")


@query("SELECT * FROM (SELECT * FROM orders ORDER BY o_orderkey LIMIT 10) UNION ALL SELECT * FROM (SELECT * FROM orders ORDER BY o_orderkey DESC LIMIT 5)")
def head_tail(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    return select.head(o, 10, "o_orderkey").unionAll(select.tail(o, 5, "o_orderkey"))


@query("SELECT value FROM events WHERE value > 50")
def series_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return select.series_filter(table(spark, sf_dir, "events"), "value", F.col("value") > 50)


@query("SELECT event_id, CASE WHEN event_id = 3 THEN -1.0 ELSE value END AS value, 100 + 2 * event_id AS label FROM events")
def index_and_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _events(spark, sf_dir).select("event_id", "value", ROW)
    return select.range_index(select.set_value(e, "value", 3, -1.0), 100, 2, "label").drop(ROW)


@query("SELECT l_orderkey, l_linenumber, l_extendedprice * (1 - l_discount) AS net FROM lineitem")
def apply_row(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = select.apply(table(spark, sf_dir, "lineitem"), F.col("l_extendedprice") * (1 - F.col("l_discount")), "net")
    return made.select("l_orderkey", "l_linenumber", "net")


@query("SELECT event_id, CASE WHEN event_id % 7 <> 0 THEN value * 2 END AS v FROM events")
def apply_column(spark: SparkSession, sf_dir: str) -> DataFrame:
    return select.apply_column(_gaps(spark, sf_dir, 0), "v", lambda c: c * 2)


@query("SELECT event_id, CASE WHEN event_id % 7 <> 0 THEN value * 2 END AS v FROM events")
def apply_pandas(spark: SparkSession, sf_dir: str) -> DataFrame:
    return select.apply_column(_gaps(spark, sf_dir, 0), "v", _twice, kind="double")


def _twice(v):
    return v * 2


@query("SELECT o_orderkey, o_totalprice * 2 AS double_price, upper(o_orderstatus) AS status FROM orders")
def apply_element(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = select.apply_element(table(spark, sf_dir, "orders"), lambda p, s: {"double_price": p * 2, "status": F.upper(s)}, ["o_totalprice", "o_orderstatus"])
    return made.select("o_orderkey", "double_price", "status")


@query("SELECT (l_quantity + 1) AS l_quantity, (l_tax + 1) AS l_tax FROM lineitem")
def map_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return select.map_columns(table(spark, sf_dir, "lineitem").select("l_quantity", "l_tax"), lambda c: c + 1)


@query("SELECT n_nationkey AS nation_id, n_name AS name, n_regionkey * 10 AS region10 FROM nation")
def rename_withcolumn(spark: SparkSession, sf_dir: str) -> DataFrame:
    renamed = select.rename(table(spark, sf_dir, "nation"), {"n_nationkey": "nation_id", "n_name": "name", "no_such": "x"})
    return select.drop(select.with_column(renamed, "region10", F.col("n_regionkey") * 10), "n_regionkey")


# --- aggregates -----------------------------------------------------------


@query(
    "SELECT sum(l_quantity) AS sum_q, avg(l_quantity) AS mean_q, median(l_quantity) AS median_q, stddev_samp(l_quantity) AS std_q, var_samp(l_quantity) AS var_q,"
    " min(l_quantity) AS min_q, max(l_quantity) AS max_q, count(l_quantity) AS count_q FROM lineitem"
)
def frame_agg(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = table(spark, sf_dir, "lineitem").select("l_quantity")
    made = {"sum": agg.frame_sum, "mean": agg.frame_mean, "median": agg.frame_median, "std": agg.frame_std, "var": agg.frame_var, "min": agg.frame_min, "max": agg.frame_max, "count": agg.frame_count}
    return _beside([f(x, "l_quantity").withColumnRenamed("l_quantity", f"{k}_q") for k, f in made.items()])


def _beside(frames_of_one_row: list[DataFrame]) -> DataFrame:
    out = frames_of_one_row[0]
    for more in frames_of_one_row[1:]:
        out = out.crossJoin(more)  # one row each
    return out


@query("SELECT coalesce(sum(v), 0) AS v_sum, avg(v) AS v_mean, quantile_cont(v, 0.9) AS v_q90, min(v) AS v_min, max(v) AS v_max, count(v) AS v_count, stddev_samp(v) AS v_std FROM (SELECT CASE WHEN event_id % 7 <> 0 THEN value END AS v FROM events)")
def frame_agg_each(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = _gaps(spark, sf_dir, 0).select("v")
    parts = [(agg.frame_sum, "sum"), (agg.frame_mean, "mean"), (lambda d, c: agg.quantile(d, 0.9, c), "q90"), (agg.frame_min, "min"), (agg.frame_max, "max"), (agg.frame_count, "count"), (agg.frame_std, "std")]
    return _beside([f(x, "v").withColumnRenamed("v", f"v_{n}") for f, n in parts])


@query(
    """SELECT 'o_totalprice' AS "column", count(o_totalprice)::DOUBLE AS count, avg(o_totalprice) AS mean, stddev_samp(o_totalprice) AS std, min(o_totalprice) AS min,
    quantile_cont(o_totalprice,0.25) AS p25, median(o_totalprice) AS p50, quantile_cont(o_totalprice,0.75) AS p75, max(o_totalprice) AS max FROM orders"""
)
def describe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return agg.describe(table(spark, sf_dir, "orders"), "o_totalprice")


@query(
    "SELECT l_returnflag, l_linestatus, sum(l_quantity) AS l_quantity_sum, avg(l_quantity) AS l_quantity_mean, median(l_quantity) AS l_quantity_median,"
    " stddev_samp(l_quantity) AS l_quantity_std, var_samp(l_quantity) AS l_quantity_var, min(l_quantity) AS l_quantity_min, max(l_quantity) AS l_quantity_max,"
    " count(l_quantity) AS l_quantity_count, count(*) AS l_quantity_size FROM lineitem GROUP BY 1, 2"
)
def groupby_11(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = ["sum", "mean", "median", "std", "var", "min", "max", "count", "size"]
    return agg.group_by(table(spark, sf_dir, "lineitem"), "l_returnflag", "l_linestatus").agg_multiple({"l_quantity": names})


@query("SELECT event_type, arg_min(value, event_id) AS value_first, arg_max(value, event_id) AS value_last FROM events GROUP BY 1")
def groupby_first_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    return agg.group_by(table(spark, sf_dir, "events"), "event_type").agg_multiple({"value": ["first", "last"]}, order_by="event_id")


@query("SELECT nullif(event_type, 'error') AS k, count(*) AS size, sum(value) AS value_sum FROM events GROUP BY 1")
def groupby_null_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").withColumn("k", F.nullif("event_type", F.lit("error")))
    return agg.group_by(e, "k").agg_multiple({"value": ["size", "sum"]}).withColumnRenamed("value_size", "size")


@query("SELECT event_type, count(*) AS size FROM events GROUP BY 1")
def groupby_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    return agg.group_by(table(spark, sf_dir, "events"), "event_type").size()


@query("SELECT user_id, count(event_id) AS event_id, count(v) AS v FROM (SELECT user_id, event_id, CASE WHEN event_id % 7 <> 0 THEN value END AS v FROM events) GROUP BY 1")
def groupby_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("user_id", "event_id", F.when(F.col("event_id") % 7 != 0, F.col("value")).alias("v"))
    return agg.group_by(e, "user_id").count()


@query("SELECT o_orderstatus, avg(o_totalprice) AS o_totalprice, max(o_orderkey) AS o_orderkey FROM orders GROUP BY 1")
def groupby_agg(spark: SparkSession, sf_dir: str) -> DataFrame:
    return agg.group_by(table(spark, sf_dir, "orders"), "o_orderstatus").agg({"o_totalprice": "mean", "o_orderkey": "max"})


@query("SELECT user_id, max(value) - min(value) AS result FROM events GROUP BY 1")
def groupby_apply(spark: SparkSession, sf_dir: str) -> DataFrame:
    return agg.group_by(table(spark, sf_dir, "events"), "user_id").apply(F.max("value") - F.min("value"))


@query("SELECT user_id, max(value) - min(value) AS result FROM events GROUP BY 1")
def groupby_apply_pandas(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("user_id", "value")
    return agg.group_by(e, "user_id").apply(_spread)


def _spread(frame) -> float:
    return float(frame["value"].max() - frame["value"].min())


# --- joins ----------------------------------------------------------------


@query("SELECT o.o_orderkey, o.o_totalprice, c.c_name FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey")
def join_inner(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join.merge(table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer"), "inner", ["o_custkey"], ["c_custkey"]).select("o_orderkey", "o_totalprice", "c_name")


@query("SELECT c.c_custkey, o.o_orderkey FROM customer c LEFT JOIN orders o ON c.c_custkey = o.o_custkey")
def join_left(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join.merge(table(spark, sf_dir, "customer"), table(spark, sf_dir, "orders"), "left", ["c_custkey"], ["o_custkey"]).select("c_custkey", "o_orderkey")


@query("SELECT o.o_orderkey, c.c_custkey FROM orders o RIGHT JOIN customer c ON c.c_custkey = o.o_custkey")
def join_right(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join.merge(table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer"), "right", ["o_custkey"], ["c_custkey"]).select("o_orderkey", "c_custkey")


@query(
    "SELECT coalesce(d.doc_id, l.doc_id) AS doc_id, l.quality, CASE WHEN l.doc_id IS NULL THEN 'left_only' WHEN d.doc_id IS NULL THEN 'right_only' ELSE 'both' END AS _merge"
    " FROM documents d FULL JOIN labels l ON d.doc_id = l.doc_id"
)
def join_outer_indicator(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join.join(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), "outer", "doc_id", indicator="_merge").select("doc_id", "quality", "_merge")


@query("SELECT r.r_name, n.n_name FROM region r CROSS JOIN nation n")
def join_cross(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join.merge(table(spark, sf_dir, "region"), table(spark, sf_dir, "nation"), "cross").select("r_name", "n_name")


@query(
    "SELECT a.l_orderkey, a.l_linenumber, a.l_quantity AS l_quantity_left, b.l_quantity AS l_quantity_right FROM lineitem a JOIN lineitem b"
    " ON a.l_orderkey = b.l_orderkey AND a.l_linenumber = b.l_linenumber"
)
def join_multi_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity")
    keys = ["l_orderkey", "l_linenumber"]
    return join.merge(x, x, "inner", keys, keys)


@query("SELECT a.event_id, b.r_name FROM (SELECT event_id, CASE WHEN event_id % 7 = 0 THEN NULL ELSE (event_id % 9)::INT END AS k FROM events) a LEFT JOIN region b ON a.k = b.r_regionkey")
def join_null_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("event_id", F.when(F.col("event_id") % 7 != 0, (F.col("event_id") % 9).cast("int")).alias("k"))
    return join.merge(e, table(spark, sf_dir, "region"), "left", ["k"], ["r_regionkey"]).select("event_id", "r_name")


@query("SELECT c_custkey, c_name FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 400000) UNION ALL SELECT c_custkey, 'none' FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
def join_semi_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_name")
    o = table(spark, sf_dir, "orders").withColumnRenamed("o_custkey", "c_custkey")
    with_large = join.semi_join(c, o.filter("o_totalprice > 400000"), ["c_custkey"])
    return with_large.unionAll(join.anti_join(c, o, ["c_custkey"]).withColumn("c_name", F.lit("none")))


# --- windows --------------------------------------------------------------


@query("SELECT event_id, CASE WHEN count(value) OVER w >= 3 THEN avg(value) OVER w END AS value_mean FROM events WINDOW w AS (ORDER BY event_id ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)")
def rolling_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return window.rolling(_events(spark, sf_dir), 3).mean("value").select("event_id", "value_mean")


@query("SELECT event_id, CASE WHEN count(value) OVER w >= 2 THEN stddev_samp(value) OVER w END AS value_std FROM events WINDOW w AS (ORDER BY event_id ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)")
def rolling_std_centered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return window.rolling(_events(spark, sf_dir), 5, min_periods=2, center=True).std("value").select("event_id", "value_std")


@query("SELECT event_id, min(value) OVER w AS value_min, max(value) OVER w AS value_max FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)")
def rolling_min_max(spark: SparkSession, sf_dir: str) -> DataFrame:
    options = {"min_periods": 1, "order_by": "event_id", "partition_by": ["user_id"]}
    low = window.rolling(table(spark, sf_dir, "events"), 5, **options).min("value")
    return window.rolling(low, 5, **options).max("value").select("event_id", "value_min", "value_max")


@query("SELECT event_id, CASE WHEN count(v) OVER w >= 2 THEN sum(v) OVER w END AS v_sum FROM (SELECT event_id, CASE WHEN event_id % 7 NOT IN (0, 1) THEN value END AS v FROM events) WINDOW w AS (ORDER BY event_id ROWS BETWEEN 3 PRECEDING AND CURRENT ROW)")
def rolling_sum_nulls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return window.rolling(_gaps(spark, sf_dir, 0, 1), 4, min_periods=2, order_by="event_id").sum("v").select("event_id", "v_sum")


@query("SELECT event_id, sum(value) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS value_sum FROM events")
def expanding_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    return window.expanding(table(spark, sf_dir, "events"), order_by="event_id", partition_by=["user_id"]).sum("value").select("event_id", "value_sum")


@query("SELECT event_id, CASE WHEN count(v) OVER w >= 2 THEN stddev_samp(v) OVER w END AS v_std, CASE WHEN count(v) OVER w >= 2 THEN max(v) OVER w END AS v_max FROM (SELECT event_id, CASE WHEN event_id % 7 NOT IN (0, 1) THEN value END AS v FROM events) WINDOW w AS (ORDER BY event_id ROWS UNBOUNDED PRECEDING)")
def expanding_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _gaps(spark, sf_dir, 0, 1).withColumn(ROW, F.col("event_id"))
    return window.expanding(window.expanding(e, 2).std("v"), 2).max("v").select("event_id", "v_std", "v_max")


_EWM = "SELECT event_id, list_reduce(list(value) OVER ({}ORDER BY event_id ROWS UNBOUNDED PRECEDING), lambda a, x: {} * x + {} * a) AS value_mean FROM {}"


@query(_EWM.format("PARTITION BY user_id ", "0.3", "0.7", "events"))
def ewm_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return window.ewm(table(spark, sf_dir, "events"), 0.3, order_by="event_id", partition_by=["user_id"]).mean("value").select("event_id", "value_mean")


# A value 100 rows back weighs 0.4^100, far below the last digit: so many rows give what all do.
@query(_EWM.replace("UNBOUNDED PRECEDING", "BETWEEN 100 PRECEDING AND CURRENT ROW").format("", "0.6", "0.4", "events"))
def ewm_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    return window.ewm(_events(spark, sf_dir), 0.6).mean("value").select("event_id", "value_mean")


# --- order ----------------------------------------------------------------


@query("SELECT o_orderkey, o_orderpriority, o_totalprice FROM orders ORDER BY o_orderpriority ASC NULLS LAST, o_totalprice DESC NULLS LAST, o_orderkey LIMIT 50")
def sort_multi_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority", "o_totalprice")
    return order.top_k(o, 50, ["o_orderpriority", "o_totalprice", "o_orderkey"], [True, False, True])


@query("SELECT row_number() OVER (ORDER BY value DESC NULLS LAST, event_id) - 1 AS rank, event_id FROM events")
def argsort(spark: SparkSession, sf_dir: str) -> DataFrame:
    return order.argsort(_events(spark, sf_dir), "value", ascending=False).withColumnRenamed("position", "event_id")


@query("SELECT event_id, v FROM (SELECT event_id, CASE WHEN event_id % 7 <> 0 THEN value END AS v FROM events) ORDER BY v DESC NULLS LAST, event_id")
def sort_nulls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return order.sort_multi(_gaps(spark, sf_dir, 0), ["v", "event_id"], [False, True])


# --- missing values -------------------------------------------------------


@query("SELECT event_id, v FROM (SELECT event_id, CASE WHEN event_id % 7 = 0 THEN NULL ELSE value END AS v FROM events) WHERE v IS NOT NULL")
def dropna(spark: SparkSession, sf_dir: str) -> DataFrame:
    return missing.dropna(_gaps(spark, sf_dir, 0))


@query("SELECT * FROM (SELECT event_id, CASE WHEN event_id % 7 <> 0 THEN value END AS v, CASE WHEN event_id % 3 <> 0 THEN user_id END AS u FROM events) WHERE (v IS NOT NULL)::INT + (u IS NOT NULL)::INT >= 1")
def dropna_thresh(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    x = e.select("event_id", F.when(F.col("event_id") % 7 != 0, F.col("value")).alias("v"), F.when(F.col("event_id") % 3 != 0, F.col("user_id")).alias("u"))
    return missing.dropna(x, thresh=1, subset=["v", "u"])


@query("SELECT event_id, coalesce(CASE WHEN event_id % 7 = 0 THEN NULL ELSE value END, -1.0) AS v FROM events")
def fillna(spark: SparkSession, sf_dir: str) -> DataFrame:
    return missing.fillna(_gaps(spark, sf_dir, 0), -1.0)


@query("SELECT event_id, coalesce(nullif(event_type, 'error'), 'none') AS k, coalesce(CASE WHEN event_id % 7 <> 0 THEN value END, 0.5) AS v FROM events")
def fillna_dict(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    x = e.select("event_id", F.nullif("event_type", F.lit("error")).alias("k"), F.when(F.col("event_id") % 7 != 0, F.col("value")).alias("v"))
    return missing.fillna_column(missing.fillna_dict(x, {"k": "none", "no_such": 1}), "v", 0.5)


_GAPS = "(SELECT event_id, CASE WHEN event_id % 7 IN (0, 1) THEN NULL ELSE value END AS v FROM events)"


@query(f"SELECT event_id, last_value(v IGNORE NULLS) OVER (ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS v FROM {_GAPS}")
def ffill(spark: SparkSession, sf_dir: str) -> DataFrame:
    return missing.interpolate(_gaps(spark, sf_dir, 0, 1), "ffill", columns=["v"], order_by="event_id")


@query(f"SELECT event_id, first_value(v IGNORE NULLS) OVER (ORDER BY event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS v FROM {_GAPS}")
def bfill(spark: SparkSession, sf_dir: str) -> DataFrame:
    return missing.interpolate(_gaps(spark, sf_dir, 0, 1), "bfill", columns=["v"], order_by="event_id")


@query(f"SELECT event_id, coalesce(v, CASE WHEN event_id % 7 = 0 THEN lag(v, 1) OVER (ORDER BY event_id) END) AS v FROM {_GAPS}")
def ffill_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return missing.interpolate(_gaps(spark, sf_dir, 0, 1), "ffill", limit=1, columns=["v"], order_by="event_id")


@query(
    f"""WITH s AS (SELECT event_id, row_number() OVER (ORDER BY event_id) AS p, v FROM {_GAPS}), t AS (SELECT *,
    last_value(CASE WHEN v IS NOT NULL THEN p END IGNORE NULLS) OVER a AS p0, last_value(v IGNORE NULLS) OVER a AS v0,
    first_value(CASE WHEN v IS NOT NULL THEN p END IGNORE NULLS) OVER b AS p1, first_value(v IGNORE NULLS) OVER b AS v1 FROM s
    WINDOW a AS (ORDER BY p ROWS UNBOUNDED PRECEDING), b AS (ORDER BY p ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
    SELECT event_id, coalesce(v, v0 + (p - p0)::DOUBLE / (p1 - p0) * (v1 - v0)) AS v FROM t"""
)
def interpolate_linear(spark: SparkSession, sf_dir: str) -> DataFrame:
    return missing.interpolate(_gaps(spark, sf_dir, 0, 1), columns=["v"], order_by="event_id")


@query("SELECT (event_id IS NULL) AS event_id, (event_id % 7 = 0) AS v FROM events")
def isna(spark: SparkSession, sf_dir: str) -> DataFrame:
    return missing.isna(_gaps(spark, sf_dir, 0))


@query("SELECT (event_id IS NOT NULL) AS event_id, (event_id % 7 <> 0) AS v FROM events")
def notna(spark: SparkSession, sf_dir: str) -> DataFrame:
    return missing.notna(_gaps(spark, sf_dir, 0))


@query("SELECT 0::BIGINT AS event_id, count(*) FILTER (event_id % 7 = 0) AS v FROM events")
def null_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return missing.null_count(_gaps(spark, sf_dir, 0))


# --- reshape --------------------------------------------------------------


@query("""SELECT user_id, arg_max(value, event_id) FILTER (event_type = 'click') AS click, arg_max(value, event_id) FILTER (event_type = 'view') AS "view" FROM events GROUP BY 1""")
def pivot_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reshape.pivot(table(spark, sf_dir, "events"), "user_id", "event_type", "value", ["click", "view"], order_by="event_id")


@query("SELECT l_orderkey, l_linenumber, 'l_discount' AS variable, l_discount AS value FROM lineitem UNION ALL SELECT l_orderkey, l_linenumber, 'l_tax', l_tax FROM lineitem")
def melt(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reshape.melt(table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"], ["l_discount", "l_tax"])


@query("""SELECT r_regionkey::BIGINT AS "row", 'r_regionkey' AS "column", r_regionkey::VARCHAR AS value FROM region UNION ALL SELECT r_regionkey, 'r_name', r_name FROM region""")
def stack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reshape.stack(table(spark, sf_dir, "region"), order_by="r_regionkey")


@query("""SELECT "row", r_name FROM (SELECT r_regionkey::BIGINT AS "row", r_name FROM region)""")
def unstack(spark: SparkSession, sf_dir: str) -> DataFrame:
    long = stack(spark, sf_dir)
    return reshape.unstack(long, "row", "column", "value", ["r_name"], order_by="row")


@query("""PIVOT (SELECT 'r_name' AS "column", r_regionkey, r_name FROM region) ON r_regionkey IN (0, 1, 2, 3, 4) USING first(r_name) GROUP BY "column" """)
def transpose(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reshape.transpose(table(spark, sf_dir, "region").select("r_name", F.col("r_regionkey").cast("long").alias(ROW)))


# --- features -------------------------------------------------------------


def _event_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", "value")


def _event_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", "event_type")


@query("SELECT event_id, (value - avg(value) OVER ()) / stddev_samp(value) OVER () AS value FROM events")
def standard_scaler(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scalers.StandardScaler(["value"]).fit_transform(_event_values(spark, sf_dir))


@query("SELECT event_id, (value - min(value) OVER ()) / (max(value) OVER () - min(value) OVER ()) AS value FROM events")
def minmax_scaler(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scalers.MinMaxScaler(["value"]).fit_transform(_event_values(spark, sf_dir))


@query("SELECT event_id, (value - (SELECT median(value) FROM events)) / (SELECT quantile_cont(value, 0.75) - quantile_cont(value, 0.25) FROM events) AS value FROM events")
def robust_scaler(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scalers.RobustScaler(["value"]).fit_transform(_event_values(spark, sf_dir))


@query("SELECT c_custkey, c_acctbal / (SELECT max(abs(c_acctbal)) FROM customer) AS c_acctbal FROM customer")
def maxabs_scaler(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scalers.MaxAbsScaler(["c_acctbal"]).fit_transform(table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal"))


_TYPES = ["click", "view", "error", "signup", "purchase"]


@query("SELECT event_id, " + ", ".join(f"(event_type = '{t}')::BIGINT AS event_type_{t}" for t in _TYPES) + " FROM events")
def onehot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encoders.OneHotEncoder(["event_type"]).fit_transform(_event_types(spark, sf_dir))


@query("WITH m AS (SELECT event_type, row_number() OVER (ORDER BY min(event_id)) - 1 AS code FROM events GROUP BY 1) SELECT e.event_id, m.code AS event_type FROM events e JOIN m USING (event_type)")
def label_encoder(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encoders.LabelEncoder("event_type", order_by=["event_id"]).fit_transform(_event_types(spark, sf_dir))


@query("SELECT event_id, event_type FROM events")
def label_inverse(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = encoders.LabelEncoder("event_type")
    return e.inverse_transform(e.fit_transform(_event_types(spark, sf_dir)))


@query("SELECT event_id, list_position(" + str(_TYPES) + ", event_type)::BIGINT - 1 AS event_type FROM events")
def ordinal_encoder(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encoders.OrdinalEncoder("event_type", _TYPES).fit_transform(_event_types(spark, sf_dir))


@query(
    "WITH g AS (SELECT avg(value) AS gm FROM events), m AS (SELECT event_type, (sum(value) + gm) / (count(value) + 1.0) AS enc FROM events, g GROUP BY event_type, gm)"
    " SELECT e.event_id, m.enc AS event_type FROM events e JOIN m USING (event_type)"
)
def target_encoder(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("event_id", "event_type", "value")
    return encoders.TargetEncoder(["event_type"]).fit_transform(e, "value").select("event_id", "event_type")


@query("SELECT event_id, count(*) OVER (PARTITION BY event_type)::DOUBLE AS event_type FROM events")
def frequency_encoder(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encoders.FrequencyEncoder(["event_type"]).fit_transform(_event_types(spark, sf_dir))


@query("SELECT event_id, coalesce(v, avg(v) OVER ()) AS v FROM (SELECT event_id, CASE WHEN event_id % 7 = 0 THEN NULL ELSE value END AS v FROM events)")
def simple_imputer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return imputers.SimpleImputer(["v"]).fit_transform(_gaps(spark, sf_dir, 0))


@query("SELECT event_id, coalesce(v, (SELECT median(value) FROM events WHERE event_id % 7 <> 0)) AS v FROM (SELECT event_id, CASE WHEN event_id % 7 <> 0 THEN value END AS v FROM events)")
def simple_imputer_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    return imputers.SimpleImputer(["v"], "median").fit_transform(_gaps(spark, sf_dir, 0))


@query(
    "WITH x AS (SELECT c_custkey, CASE WHEN c_custkey % 7 <> 0 THEN c_acctbal END AS bal, c_nationkey FROM customer), k AS (SELECT DISTINCT c_nationkey FROM x),"
    " r AS (SELECT k.c_nationkey, x.bal, row_number() OVER (PARTITION BY k.c_nationkey ORDER BY abs(k.c_nationkey - x.c_nationkey), x.bal) AS p FROM k, x WHERE x.bal IS NOT NULL),"
    " m AS (SELECT c_nationkey, avg(bal) AS near FROM r WHERE p <= 3 GROUP BY 1) SELECT c_custkey, coalesce(bal, near) AS bal, c_nationkey::DOUBLE AS c_nationkey FROM x JOIN m USING (c_nationkey)"
)
def knn_imputer(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = table(spark, sf_dir, "customer").select("c_custkey", F.when(F.col("c_custkey") % 7 != 0, F.col("c_acctbal")).alias("bal"), "c_nationkey")
    return imputers.KNNImputer(3, ["bal", "c_nationkey"]).fit_transform(x)


@query(
    "WITH x AS (SELECT l_orderkey, l_linenumber, l_quantity, CASE WHEN l_orderkey % 7 <> 0 THEN l_extendedprice END AS p FROM lineitem)"
    " SELECT l_orderkey, l_linenumber, l_quantity, coalesce(p, (SELECT regr_intercept(p, l_quantity) FROM x) + (SELECT regr_slope(p, l_quantity) FROM x) * l_quantity) AS p FROM x"
)
def iterative_imputer(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = table(spark, sf_dir, "lineitem")
    gaps = x.select("l_orderkey", "l_linenumber", "l_quantity", F.when(F.col("l_orderkey") % 7 != 0, F.col("l_extendedprice")).alias("p"))
    return imputers.IterativeImputer(["l_quantity", "p"]).fit_transform(gaps)


@query("WITH e AS (SELECT min(value) AS lo, (max(value) - min(value)) / 5 AS w FROM events) SELECT event_id, CASE WHEN value < lo + 1 * w THEN 0 WHEN value < lo + 2 * w THEN 1 WHEN value < lo + 3 * w THEN 2 WHEN value < lo + 4 * w THEN 3 ELSE 4 END::BIGINT AS value FROM events, e")
def bin_uniform(spark: SparkSession, sf_dir: str) -> DataFrame:
    return creators.BinDiscretizer(["value"], 5).fit_transform(_event_values(spark, sf_dir))


@query("WITH e AS (SELECT quantile_cont(value, 0.25) AS a, quantile_cont(value, 0.5) AS b, quantile_cont(value, 0.75) AS c FROM events) SELECT event_id, (value < a)::BIGINT AS value_bin0, (value >= a AND value < b)::BIGINT AS value_bin1, (value >= b AND value < c)::BIGINT AS value_bin2, (value >= c)::BIGINT AS value_bin3 FROM events, e")
def bin_quantile_onehot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return creators.BinDiscretizer(["value"], 4, "quantile", "onehot").fit_transform(_event_values(spark, sf_dir))


@query("""SELECT l_orderkey, l_linenumber, l_quantity, l_discount, 1.0::DOUBLE AS bias, l_quantity * l_quantity AS "l_quantity^2", l_discount * l_discount AS "l_discount^2", l_quantity * l_discount AS "l_quantity*l_discount" FROM lineitem""")
def polynomial(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_discount")
    return creators.PolynomialFeatures(2, include_bias=True, columns=["l_quantity", "l_discount"]).fit_transform(x)


@query("""SELECT l_quantity, l_discount, l_tax, l_quantity * l_discount AS "l_quantity*l_discount", l_quantity * l_tax AS "l_quantity*l_tax", l_discount * l_tax AS "l_discount*l_tax" FROM lineitem""")
def interaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = table(spark, sf_dir, "lineitem").select("l_quantity", "l_discount", "l_tax")
    return creators.InteractionFeatures(["l_quantity", "l_discount", "l_tax"]).fit_transform(x)


_LINE = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def _target(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items with a target that leans on the quantity."""
    return table(spark, sf_dir, "lineitem").select(*_LINE).withColumn("y", F.col("l_quantity") * 2 + F.col("l_discount") * 10)


@query("SELECT l_quantity, l_extendedprice FROM lineitem")
def variance_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return selectors.VarianceThreshold(1.0).fit_transform(table(spark, sf_dir, "lineitem").select(*_LINE, "l_returnflag"))


@query("SELECT l_quantity FROM lineitem")
def select_k_best(spark: SparkSession, sf_dir: str) -> DataFrame:
    return selectors.SelectKBest(1).fit_transform(_target(spark, sf_dir), "y")


@query("SELECT l_quantity FROM lineitem")
def select_percentile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return selectors.SelectPercentile(25).fit_transform(_target(spark, sf_dir), "y")


@query("SELECT l_quantity FROM lineitem")
def rfe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return selectors.RFE(1).fit_transform(_target(spark, sf_dir), "y")


# --- statistics -----------------------------------------------------------


@query("SELECT count(value) AS count, avg(value) AS mean, stddev_samp(value) AS std, min(value) AS min, quantile_cont(value, 0.25) AS q25, median(value) AS median, quantile_cont(value, 0.75) AS q75, max(value) AS max, skewness(value) AS skewness, kurtosis(value) AS kurtosis FROM events")
def stats_describe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return descriptive.describe(table(spark, sf_dir, "events"), "value")


@query("SELECT p_size AS value, count(*) AS frequency FROM part GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 1")
def stats_mode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return descriptive.mode_count(table(spark, sf_dir, "part"), "p_size")


@query("SELECT max(value) - min(value) AS range, quantile_cont(value, 0.75) - quantile_cont(value, 0.25) AS iqr, quantile_cont(value, 0.9) AS p90, var_samp(value) AS var FROM events")
def stats_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, v = table(spark, sf_dir, "events"), F.col("value")
    rest = _row(spark, "iqr double, p90 double", descriptive.iqr_of(e, "value"), descriptive.percentile_of(e, "value", 90))
    return _beside([e.agg(descriptive.value_range(v).alias("range"), descriptive.var(v).alias("var")), rest])


_CORR = ["l_quantity", "l_extendedprice", "l_discount"]


@query(" UNION ALL ".join(f"""SELECT '{a}' AS "column", {", ".join(("1.0::DOUBLE" if a == b else f"corr({a}, {b})") + f" AS {b}" for b in _CORR)} FROM lineitem""" for a in _CORR))
def corr_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return correlation.corr_matrix(table(spark, sf_dir, "lineitem"), _CORR)


@query(" UNION ALL ".join(f"""SELECT '{a}' AS "column", {", ".join(f"covar_samp({a}, {b}) AS {b}" for b in _CORR)} FROM lineitem""" for a in _CORR))
def cov_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return correlation.cov_matrix(table(spark, sf_dir, "lineitem"), _CORR)


@query("WITH r AS (SELECT rank() OVER (ORDER BY l_quantity) + (count(*) OVER (PARTITION BY l_quantity) - 1) / 2.0 AS rx, rank() OVER (ORDER BY l_extendedprice) + (count(*) OVER (PARTITION BY l_extendedprice) - 1) / 2.0 AS ry FROM lineitem) SELECT corr(rx, ry) AS rho FROM r")
def spearman(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _row(spark, "rho double", correlation.spearman(table(spark, sf_dir, "lineitem"), "l_quantity", "l_extendedprice"))


@query("SELECT sum(sign(b.p_size - a.p_size) * sign(b.p_retailprice - a.p_retailprice))::DOUBLE / count(*) AS tau FROM part a JOIN part b ON a.p_partkey < b.p_partkey")
def kendall(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _row(spark, "tau double", correlation.kendall(table(spark, sf_dir, "part"), "p_size", "p_retailprice"))


@query("SELECT (avg(value) - 50) / (stddev_samp(value) / sqrt(count(value))) AS statistic, (count(value) - 1)::BIGINT AS df FROM events")
def ttest_1samp(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = hypothesis.ttest(table(spark, sf_dir, "events"), "value", 50)
    return _row(spark, "statistic double, df long", r.statistic, r.df)


@query(
    "WITH g AS (SELECT avg(value) FILTER (event_type = 'click') AS m1, var_samp(value) FILTER (event_type = 'click') AS v1, (count(*) FILTER (event_type = 'click'))::DOUBLE AS n1,"
    " avg(value) FILTER (event_type = 'view') AS m2, var_samp(value) FILTER (event_type = 'view') AS v2, (count(*) FILTER (event_type = 'view'))::DOUBLE AS n2 FROM events)"
    " SELECT (m1 - m2) / sqrt(v1 / n1 + v2 / n2) AS welch, trunc((v1 / n1 + v2 / n2) ** 2 / ((v1 / n1) ** 2 / (n1 - 1) + (v2 / n2) ** 2 / (n2 - 1)))::BIGINT AS df,"
    " (m1 - m2) / sqrt(((n1 - 1) * v1 + (n2 - 1) * v2) / (n1 + n2 - 2) * (1 / n1 + 1 / n2)) AS pooled FROM g"
)
def ttest_2samp(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    a, b = e.filter("event_type = 'click'"), e.filter("event_type = 'view'")
    w, p = hypothesis.ttest_2sample(a, "value", b, "value", equal_var=False), hypothesis.ttest_2sample(a, "value", b, "value")
    return _row(spark, "welch double, df long, pooled double", w.statistic, w.df, p.statistic)


@query("SELECT avg(l_tax - l_discount) / (stddev_samp(l_tax - l_discount) / sqrt(count(*))) AS statistic, (count(*) - 1)::BIGINT AS df FROM lineitem")
def ttest_paired(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = hypothesis.ttest_paired(table(spark, sf_dir, "lineitem"), "l_tax", "l_discount")
    return _row(spark, "statistic double, df long", r.statistic, r.df)


@query(
    "WITH g AS (SELECT event_type, count(*) AS n, avg(value) AS m, var_samp(value) AS v FROM events GROUP BY 1), t AS (SELECT avg(value) AS gm, count(*) AS nn FROM events)"
    " SELECT (sum(n * (m - gm) ** 2) / (count(*) - 1)) / (sum((n - 1) * v) / (max(nn) - count(*))) AS f_statistic, (count(*) - 1)::BIGINT AS df_between, (max(nn) - count(*))::BIGINT AS df_within FROM g, t"
)
def anova(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = hypothesis.one_way_anova(table(spark, sf_dir, "events"), "event_type", "value")
    return _row(spark, "f_statistic double, df_between long, df_within long", r.f_statistic, r.df_between, r.df_within)


@query(
    "WITH o AS (SELECT l_returnflag AS r, l_linestatus AS c, count(*) AS o FROM lineitem GROUP BY ALL), m AS (SELECT r.r, c.c, coalesce(o.o, 0) AS o FROM (SELECT DISTINCT r FROM o) r CROSS JOIN (SELECT DISTINCT c FROM o) c LEFT JOIN o USING (r, c)),"
    " e AS (SELECT o, sum(o) OVER (PARTITION BY r)::DOUBLE * sum(o) OVER (PARTITION BY c) / sum(o) OVER () AS e FROM m) SELECT sum((o - e) ** 2 / e) AS statistic FROM e"
)
def chi2_independence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _row(spark, "statistic double", hypothesis.chi_square_independence(table(spark, sf_dir, "lineitem"), "l_returnflag", "l_linestatus").statistic)


@query("SELECT event_id, exp(0 - ((value - 50) / 20) ** 2 / 2) / (20 * sqrt(2 * pi())) AS density FROM events")
def normal_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", distributions.Normal(50, 20).pdf_column(F.col("value")).alias("density"))


@query()
def normal_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return distributions.Normal(5, 2).sample(spark, 1000, seed=3)


# --- models ---------------------------------------------------------------


@query("SELECT regr_slope(o_totalprice, o_custkey) AS coef, regr_intercept(o_totalprice, o_custkey) AS intercept, regr_r2(o_totalprice, o_custkey) AS r2 FROM orders")
def ols_simple(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select("o_custkey", "o_totalprice")
    m = linear.LinearRegression().fit(o, "o_totalprice")
    return _row(spark, "coef double, intercept double, r2 double", m.coef["o_custkey"], m.intercept, m.score(o, "o_totalprice"))


@query(
    "WITH m AS (SELECT covar_pop(l_extendedprice, l_quantity) * count(*) / (var_pop(l_quantity) * count(*) + 10) AS b, avg(l_extendedprice) AS my, avg(l_quantity) AS mx FROM lineitem) SELECT b AS coef, my - b * mx AS intercept FROM m"
)
def ridge_simple(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = linear.Ridge(10).fit(table(spark, sf_dir, "lineitem").select("l_quantity", "l_extendedprice"), "l_extendedprice")
    return _row(spark, "coef double, intercept double", m.coef["l_quantity"], m.intercept)


@query(
    "WITH m AS (SELECT covar_pop(l_extendedprice, l_quantity) * count(*) / stddev_pop(l_quantity) AS rho, count(*) AS n, stddev_pop(l_quantity) AS s FROM lineitem) SELECT sign(rho) * greatest(abs(rho) - 1000000, 0) / n / s AS coef FROM m"
)
def lasso_simple(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = linear.Lasso(1_000_000).fit(table(spark, sf_dir, "lineitem").select("l_quantity", "l_extendedprice"), "l_extendedprice")
    return _row(spark, "coef double", m.coef["l_quantity"])


def _priced(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = table(spark, sf_dir, "lineitem").select("l_quantity", "l_discount", "l_extendedprice")
    return x.withColumn("dear", F.when(F.col("l_extendedprice") > 40000, "yes").otherwise("no"))


@query()
def logistic(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = _priced(spark, sf_dir)
    return linear.LogisticRegression(features=["l_quantity", "l_discount"]).fit(x, "dear").predict(x).groupBy("dear", "prediction").count()


@query()
def decision_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = _priced(spark, sf_dir)
    return tree.DecisionTreeClassifier(4, features=["l_quantity", "l_discount"]).fit(x, "dear").predict(x).groupBy("dear", "prediction").count()


@query()
def regression_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = _priced(spark, sf_dir)
    found = tree.DecisionTreeRegressor(4, features=["l_quantity", "l_discount"]).fit(x, "l_extendedprice").predict(x)
    return metrics.regression_metrics(found, "l_extendedprice", "prediction")


def _vectors(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, list[str]]:
    """The embeddings with a column for each element, and the columns' names."""
    x = table(spark, sf_dir, "embeddings")
    names = [f"e{i}" for i in range(x.agg(F.max(F.size("embedding"))).first()[0] or 0)]
    return x.select("vec_id", *[F.get("embedding", F.lit(i)).cast("double").alias(n) for i, n in enumerate(names)]), names


@query()
def kmeans(spark: SparkSession, sf_dir: str) -> DataFrame:
    x, names = _vectors(spark, sf_dir)
    return cluster.KMeans(4, features=names).fit(x).predict(x).select("vec_id", "prediction")


@query()
def pca(spark: SparkSession, sf_dir: str) -> DataFrame:
    x, names = _vectors(spark, sf_dir)
    return decomposition.PCA(2, features=names).fit_transform(x).select("vec_id", "PC1", "PC2")


@query(
    "WITH p AS (SELECT quality AS t, toxic AS y FROM labels), l AS (SELECT DISTINCT t AS k FROM p) SELECT (SELECT avg((t = y)::INT) FROM p) AS accuracy,"
    " avg(coalesce((SELECT count(*) FROM p WHERE t = k AND y = k)::DOUBLE / nullif((SELECT count(*) FROM p WHERE y = k), 0), 0)) AS precision_macro,"
    " avg((SELECT count(*) FROM p WHERE t = k AND y = k)::DOUBLE / (SELECT count(*) FROM p WHERE t = k)) AS recall_macro FROM l"
)
def metrics_classification(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = table(spark, sf_dir, "labels")
    values = metrics.accuracy(x, "quality", "toxic"), metrics.precision(x, "quality", "toxic"), metrics.recall(x, "quality", "toxic")
    return _row(spark, "accuracy double, precision_macro double, recall_macro double", *values)


@query("""SELECT quality::VARCHAR AS label, count(*) FILTER (toxic = 0) AS "0", count(*) FILTER (toxic = 1) AS "1" FROM labels GROUP BY 1""")
def metrics_confusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.confusion_matrix(table(spark, sf_dir, "labels"), "quality", "toxic")


@query(
    "WITH k AS (SELECT unnest([0, 1]) AS k), c AS (SELECT k, (count(*) FILTER (quality = k AND toxic = k))::DOUBLE AS hit, (count(*) FILTER (toxic = k))::DOUBLE AS said, count(*) FILTER (quality = k) AS support FROM labels, k GROUP BY k),"
    " r AS (SELECT k::VARCHAR AS label, coalesce(hit / nullif(said, 0), 0) AS precision, coalesce(hit / nullif(support, 0), 0) AS recall, support FROM c)"
    " SELECT label, precision, recall, coalesce(2 * precision * recall / nullif(precision + recall, 0), 0) AS f1, support FROM r"
)
def metrics_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.classification_report(table(spark, sf_dir, "labels"), "quality", "toxic")


@query("SELECT avg((l_tax - l_discount) ** 2) AS mse, sqrt(avg((l_tax - l_discount) ** 2)) AS rmse, avg(abs(l_tax - l_discount)) AS mae FROM lineitem")
def metrics_regression(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.regression_metrics(table(spark, sf_dir, "lineitem"), "l_tax", "l_discount")


@query("WITH m AS (SELECT avg(l_tax) AS m FROM lineitem) SELECT 1 - sum((l_tax - l_discount) ** 2) / sum((l_tax - m) ** 2) AS r2 FROM lineitem, m")
def metrics_r2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _row(spark, "r2 double", metrics.r2_score(table(spark, sf_dir, "lineitem"), "l_tax", "l_discount"))


@query("WITH n AS (SELECT count(*) AS n FROM orders), r AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS p FROM orders) SELECT CASE WHEN p < (n % 5) * (n // 5 + 1) THEN p // (n // 5 + 1) ELSE n % 5 + (p - (n % 5) * (n // 5 + 1)) // (n // 5) END AS fold, o_orderkey FROM r, n")
def kfold_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split.kfold_assign(table(spark, sf_dir, "orders"), 5, order_by="o_orderkey").select("fold", "o_orderkey")


@query("SELECT o_orderkey, (row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_orderkey) - 1) % 3 AS fold FROM orders")
def stratified_kfold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split.stratified_kfold_assign(table(spark, sf_dir, "orders"), "o_orderstatus", 3, order_by="o_orderkey").select("o_orderkey", "fold")


@query("SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) > count(*) OVER () - (count(*) OVER () * 0.2)::INT AS test FROM orders")
def train_test_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    train, test = split.train_test_split(table(spark, sf_dir, "orders").select("o_orderkey"), 0.2, shuffle=False, order_by="o_orderkey")
    return train.withColumn("test", F.lit(False)).unionAll(test.withColumn("test", F.lit(True)))


# --- streams --------------------------------------------------------------


@query("SELECT time_bucket(INTERVAL 1 hour, ts) AS window_start, time_bucket(INTERVAL 1 hour, ts) + INTERVAL 1 hour AS window_end, event_type, count(*) AS n, sum(value) AS total FROM events GROUP BY ALL")
def tumbling_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.time_windows(table(spark, sf_dir, "events"), "ts", "1 hour", F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"), keys=("event_type",))


@query("SELECT time_bucket(INTERVAL 1 hour, ts) AS window_start, time_bucket(INTERVAL 1 hour, ts) + INTERVAL 1 hour AS window_end, event_type, count(*) AS n FROM events GROUP BY ALL")
def streamed_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same over a stream, with a watermark; windows still open at the end included."""
    events = table(spark, sf_dir, "events")
    path = scratch_path(spark, "events")
    events.write.parquet(path)
    stream = spark.readStream.schema(events.schema).parquet(path)
    counted = windows.time_windows(stream, "ts", "1 hour", F.count(F.lit(1)).alias("n"), keys=("event_type",), late="10 minutes")
    return windows.run_to_end(counted, keys=("window_start", "window_end", "event_type"))


# --- operators that the queries above do not reach ------------------------


@query("SELECT NULL::DOUBLE AS v, sum(event_id)::DOUBLE AS event_id FROM events")
def frame_sum_with_nulls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return agg.frame_sum(_gaps(spark, sf_dir, 0), "v", "event_id", skipna=False)


@query("SELECT count(*) AS n_rows, 8::BIGINT AS n_columns FROM (SELECT * FROM lineitem)".replace("8::BIGINT", "(SELECT count(*) FROM (DESCRIBE lineitem))"))
def frame_shape(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _row(spark, "n_rows long, n_columns long", *select.shape(table(spark, sf_dir, "lineitem")))


@query("SELECT value FROM events")
def frame_column(spark: SparkSession, sf_dir: str) -> DataFrame:
    return select.column(table(spark, sf_dir, "events"), "value")


@query("SELECT * FROM region WHERE r_name IN ('ASIA', 'EUROPE')")
def loc_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return select.loc(table(spark, sf_dir, "region"), ["EUROPE", "ASIA"], "r_name")


@query("SELECT * FROM events WHERE ts IN (SELECT min(ts) FROM events UNION SELECT max(ts) FROM events)")
def loc_timestamps(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return select.loc(e, list(e.agg(F.max("ts"), F.min("ts")).first()), "ts")


@query("SELECT r_name, ['v', 'w', 'x', 'y', 'z'][r_regionkey + 1] AS label FROM region")
def set_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return select.set_index(table(spark, sf_dir, "region"), list("vwxyz"), "label", order_by="r_regionkey").select("r_name", "label")


@query("SELECT event_id, CASE WHEN event_id % 7 <> 0 THEN value END AS v FROM events ORDER BY v NULLS FIRST, event_id LIMIT 2000")
def sort_nulls_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    return order.top_k(_gaps(spark, sf_dir, 0), 2000, ["v", "event_id"], [True, True], nulls_first=True)


@query("SELECT o_orderkey, o_totalprice FROM orders")
def sort_one_column(spark: SparkSession, sf_dir: str) -> DataFrame:
    return order.sort(table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice"), "o_totalprice", ascending=False)


@query("SELECT r_name FROM region")
def sort_by_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return order.sort_index(table(spark, sf_dir, "region"), "r_name", ascending=False).select("r_name")


@query("SELECT * FROM (VALUES (1::BIGINT, 'a', 0.5::DOUBLE, true), (2, NULL, NULL, false)) t(k, s, x, b)")
def io_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frames.from_columns(spark, {"k": [1, 2], "s": ["a", None], "x": [0.5, None], "b": [True, False]})


@query("SELECT unnest([1, NULL, 3])::BIGINT AS v")
def io_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frames.series(spark, "v", [1, 2, 3], [False, True, False])


@query("SELECT n_nationkey::VARCHAR AS col_0, n_name AS col_1, CASE WHEN n_regionkey <> 3 THEN n_regionkey::DOUBLE END AS col_2 FROM nation")
def io_csv_options(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "csv")
    csv.write_csv(table(spark, sf_dir, "nation"), path, delimiter="|", header=False)
    return csv.read_csv(spark, path, delimiter="|", header=False, na_values=["", "3"], dtypes={"col_0": "string", "col_2": "double"}).select(
        F.coalesce("col_0", F.lit("3")).alias("col_0"), "col_1", "col_2"
    )


_PREPARED = """
    WITH g AS (SELECT event_id, CASE WHEN event_id % 7 <> 0 THEN value END AS v, event_type FROM events),
    f AS (SELECT event_id, coalesce(v, 10.0) AS v, dense_rank() OVER (ORDER BY event_type) - 1 AS event_type FROM g)
    SELECT event_id, (v - avg(v) OVER ()) / stddev_samp(v) OVER () AS v, event_type FROM f
"""


def _pipeline() -> Pipeline:
    return Pipeline().add("fill", imputers.SimpleImputer(["v"], "constant", 10.0)).add("scale", scalers.StandardScaler(["v"])).add("code", encoders.LabelEncoder("event_type"))


def _raw_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", F.when(F.col("event_id") % 7 != 0, F.col("value")).alias("v"), "event_type")


@query(_PREPARED)
def pipeline_fit_transform(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pipeline().fit_transform(_raw_events(spark, sf_dir))


@query(_PREPARED)
def pipeline_saved(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = _raw_events(spark, sf_dir)
    with tempfile.TemporaryDirectory() as folder:  # a file of the driver's
        _pipeline().fit(x).save(f"{folder}/pipeline.json")
        return load_pipeline(f"{folder}/pipeline.json").transform(x)


@query(
    "WITH n AS (SELECT count(*) AS n FROM orders), r AS (SELECT o_custkey AS x, o_totalprice AS y, row_number() OVER (ORDER BY o_orderkey) - 1 AS p FROM orders),"
    " f AS (SELECT x, y, CASE WHEN p < (n % 5) * (n // 5 + 1) THEN p // (n // 5 + 1) ELSE n % 5 + (p - (n % 5) * (n // 5 + 1)) // (n // 5) END AS fold FROM r, n),"
    " m AS (SELECT k.fold, regr_slope(f.y, f.x) AS b, regr_intercept(f.y, f.x) AS a FROM f JOIN (SELECT DISTINCT fold FROM f) k ON f.fold <> k.fold GROUP BY 1),"
    " t AS (SELECT fold, avg(y) AS my FROM f GROUP BY 1) SELECT fold::BIGINT AS fold, 1 - sum((y - a - b * x) ** 2) / sum((y - my) ** 2) AS score FROM f JOIN m USING (fold) JOIN t USING (fold) GROUP BY 1"
)
def cross_val_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    scores = split.cross_val_score(lambda: linear.LinearRegression(features=["o_custkey"]), o, "o_totalprice", metrics.r2_score, n=5, order_by="o_orderkey")
    return spark.createDataFrame(list(enumerate(scores)), "fold long, score double")


@query(
    "SELECT o_orderkey, row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_orderkey) > count(*) OVER (PARTITION BY o_orderstatus) - floor(count(*) OVER (PARTITION BY o_orderstatus) * 0.2) AS test FROM orders"
)
def stratified_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus")
    train, test = split.train_test_split(o, 0.2, shuffle=False, stratify="o_orderstatus", order_by="o_orderkey")
    return train.select("o_orderkey", F.lit(False).alias("test")).unionAll(test.select("o_orderkey", F.lit(True).alias("test")))


@query(
    "WITH k AS (SELECT unnest([0, 1]) AS k), c AS (SELECT k, (count(*) FILTER (quality = k AND toxic = k))::DOUBLE AS hit, (count(*) FILTER (toxic = k))::DOUBLE AS said, (count(*) FILTER (quality = k))::DOUBLE AS there FROM labels, k GROUP BY 1),"
    " m AS (SELECT avg(coalesce(hit / nullif(said, 0), 0)) AS p, avg(coalesce(hit / nullif(there, 0), 0)) AS r FROM c) SELECT 2 * p * r / (p + r) AS f1_macro FROM m"
)
def metrics_f1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _row(spark, "f1_macro double", metrics.f1_score(table(spark, sf_dir, "labels"), "quality", "toxic"))


@query(
    "WITH m AS (SELECT avg(l_tax) AS m, count(*) AS n FROM lineitem), r AS (SELECT 1 - sum((l_tax - l_discount) ** 2) / sum((l_tax - m) ** 2) AS r2, max(n) AS n FROM lineitem, m)"
    " SELECT 1 - (1 - r2) * (n - 1) / (n - 3 - 1) AS adjusted FROM r"
)
def metrics_adjusted_r2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _row(spark, "adjusted double", metrics.adjusted_r2(table(spark, sf_dir, "lineitem"), "l_tax", "l_discount", 3))


@query("SELECT covar_samp(l_quantity, l_extendedprice) AS covariance FROM lineitem")
def covariance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _row(spark, "covariance double", correlation.covariance(table(spark, sf_dir, "lineitem"), "l_quantity", "l_extendedprice"))


@query(
    "WITH c AS (SELECT count(*)::DOUBLE AS o FROM events GROUP BY event_type), e AS (SELECT o, sum(o) OVER () / count(*) OVER () AS e FROM c), s AS (SELECT sum((o - e) ** 2 / e) AS x FROM e)"
    " SELECT x AS statistic, exp(0 - x / 2) * (1 + x / 2) AS p_value, 4::BIGINT AS df FROM s"
)
def chi2_goodness(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = [float(r["size"]) for r in agg.group_by(table(spark, sf_dir, "events"), "event_type").size().collect()]
    r = hypothesis.chi_square_gof(counts, [sum(counts) / len(counts)] * len(counts))
    return _row(spark, "statistic double, p_value double, df long", r.statistic, r.p_value, r.df)


_FLAGS = [(r, c) for r in "ANR" for c in "FO"]


@query(
    "WITH o AS (SELECT r, c, (SELECT count(*) FROM lineitem WHERE l_returnflag = r AND l_linestatus = c)::DOUBLE AS o FROM (SELECT unnest(['A', 'N', 'R']) AS r), (SELECT unnest(['F', 'O']) AS c)),"
    " s AS (SELECT sum((o - n / 6) ** 2 / (n / 6)) AS x FROM o, (SELECT sum(o) AS n FROM o)) SELECT x AS statistic, exp(0 - x / 2) AS p_value FROM s"
)
def chi2_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = {(r["l_returnflag"], r["l_linestatus"]): r["size"] for r in agg.group_by(table(spark, sf_dir, "lineitem"), "l_returnflag", "l_linestatus").size().collect()}
    cells = [float(found.get(k, 0)) for k in _FLAGS]
    even = [[sum(cells) / 6] * 2 for _ in range(3)]
    r = hypothesis.chi_square([cells[0:2], cells[2:4], cells[4:6]], even)
    return _row(spark, "statistic double, p_value double", r.statistic, r.p_value)


@query(
    "WITH g AS (SELECT avg(value) AS m FROM events GROUP BY event_type), s AS (SELECT (avg(m) - 50) / (stddev_samp(m) / sqrt(count(*))) AS t FROM g)"
    " SELECT t AS statistic, 1 - abs(t) / sqrt(4 + t * t) * (1 + 2 / (4 + t * t)) AS p_value FROM s"
)
def ttest_p_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of five means, so of four degrees of freedom, for which the probability has a closed form."""
    means = agg.group_by(table(spark, sf_dir, "events"), "event_type").agg({"value": "mean"})
    r = hypothesis.ttest(means, "value", 50)
    return _row(spark, "statistic double, p_value double", r.statistic, r.p_value)


@query(
    "WITH g AS (SELECT l_returnflag, count(*) AS n, avg(l_quantity) AS m, var_samp(l_quantity) AS v FROM lineitem GROUP BY 1), t AS (SELECT avg(l_quantity) AS gm, count(*) AS nn FROM lineitem),"
    " f AS (SELECT (sum(n * (m - gm) ** 2) / 2) / (sum((n - 1) * v) / (max(nn) - 3)) AS f, max(nn) - 3 AS d FROM g, t) SELECT f AS f_statistic, (1 + 2 * f / d) ** (0 - d / 2.0) AS p_value FROM f"
)
def anova_p_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of three groups, so of two degrees of freedom between them, for which the probability has a closed form."""
    r = hypothesis.one_way_anova(table(spark, sf_dir, "lineitem"), "l_returnflag", "l_quantity")
    return _row(spark, "f_statistic double, p_value double", r.f_statistic, r.p_value)


@query("SELECT event_id, CASE WHEN value BETWEEN 20 AND 60 THEN 1 / 40.0 ELSE 0.0 END::DOUBLE AS density, least(1.0, greatest(0.0, (value - 20) / 40)) AS share, 20 + (event_id % 10) / 10.0::DOUBLE * 40 AS quantile FROM events")
def uniform_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    u, v = distributions.Uniform(20, 60), F.col("value")
    return table(spark, sf_dir, "events").select("event_id", u.pdf_column(v).alias("density"), u.cdf_column(v).alias("share"), u.ppf_column((F.col("event_id") % 10) / F.lit(10.0)).alias("quantile"))


@query(
    "WITH k AS (SELECT unnest(range(13)) AS k), p AS (SELECT k, CASE WHEN k <= 10 THEN exp(lgamma(11) - lgamma(k + 1) - lgamma(11 - k)) * 0.3 ** k * 0.7 ** (10 - k) ELSE 0 END AS p FROM k),"
    " c AS (SELECT k, p, sum(p) OVER (ORDER BY k) AS c FROM p) SELECT event_id, p AS probability, c AS share FROM events JOIN c ON event_id % 13 = k".replace("lgamma(11 - k)", "lgamma(greatest(11 - k, 1))")
)
def binomial_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    b, k = distributions.Binomial(10, 0.3), F.col("event_id") % 13
    return table(spark, sf_dir, "events").select("event_id", b.pmf_column(k).alias("probability"), b.cdf_column(k).alias("share"))


@query(
    "WITH c AS (SELECT l_quantity AS x, count(*)::DOUBLE AS n, sum(l_extendedprice) AS s FROM lineitem GROUP BY 1),"
    " w AS (SELECT x, sum(n) OVER a AS n, sum(s) OVER a AS s, lead(x) OVER (ORDER BY x) AS next, sum(n) OVER () AS nn, sum(s) OVER () AS ss FROM c WINDOW a AS (ORDER BY x)),"
    " b AS (SELECT arg_max((x + next) / 2, s * s / n + (ss - s) ** 2 / (nn - n)) AS t FROM w WHERE next IS NOT NULL)"
    " SELECT avg(l_extendedprice) AS prediction, count(*) AS n FROM lineitem, b GROUP BY l_quantity <= t"
)
def regression_stump(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = table(spark, sf_dir, "lineitem").select("l_quantity", "l_extendedprice")
    found = tree.DecisionTreeRegressor(1, features=["l_quantity"]).fit(x, "l_extendedprice").predict(x)
    return found.groupBy("prediction").agg(F.count(F.lit(1)).alias("n"))
