"""Selection, aggregates, groups, joins, order, missing values, reshaping on small literal frames."""

import pytest
from pyspark.sql import functions as F

from loomframe import errors
from loomframe.operators import agg, join, missing, order, reshape, select
from loomframe.rows import ROW, with_row_id
from loomframe.sources import frames


def rows(df, *names):
    return [tuple(r) for r in df.select(*names).collect()] if names else [tuple(r) for r in df.collect()]


@pytest.fixture(scope="module")
def sales(make):
    return make(
        product_id=[7, 8, 7, 9, 9, 8, 7, 9], category=list("PQQPPQPQ"), amount=[40.0, 75.0, 55.0, 90.0, 20.0, 65.0, 85.0, 10.0],
        quantity=[4, 7, 5, 9, 2, 6, 8, 1], at=list(range(8)),
    )


def test_row_ids_are_dense_in_order(spark):
    df = spark.range(1000).select((F.lit(999) - F.col("id")).alias("k")).repartition(7)
    got = with_row_id(df, "k").orderBy("k").collect()
    assert [r[ROW] for r in got] == list(range(1000)) == [r["k"] for r in got]
    assert with_row_id(df.limit(0), "k").count() == 0


def test_select_and_drop_pass_over_unknown_names(sales):
    assert select.select(sales, "amount", "nope", "category").columns == ["amount", "category"]
    assert select.drop(sales, "amount", "nope").columns == ["product_id", "category", "quantity", "at"]


def test_filter_by_column_and_by_pandas(sales):
    assert select.filter_rows(sales, F.col("amount") > 70).count() == 3
    assert select.filter_rows(sales, lambda f: f.amount > 70).count() == 3


def test_loc_keeps_the_order_of_labels(sales):
    assert [r[4] for r in select.loc(sales, [5, 1, 5], "at").collect()] == [5, 1, 5]
    assert select.loc(sales, [], "at").count() == 0
    with pytest.raises(errors.KeyNotFound):
        select.loc(sales, [5, 99], "at")


def test_iloc_and_slices(sales):
    assert rows(select.iloc(sales, [7, 0, 0], order_by="at"), "at") == [(7,), (0,), (0,)]
    with pytest.raises(errors.IndexOutOfBounds):
        select.iloc(sales, [8], order_by="at")
    assert sorted(rows(select.slice_rows(sales, 2, 4, "at"), "at")) == [(2,), (3,)]
    assert select.slice_rows(sales, 5, 2, "at").count() == 0
    assert rows(select.tail(sales, 2, "at"), "at") == [(6,), (7,)]
    with pytest.raises(errors.InvalidArgument):
        select.iloc(sales, [0])


def test_derived_columns(sales):
    assert select.apply(sales, F.col("amount") * 2, "amount").agg(F.sum("amount")).first()[0] == 880.0
    assert "x" in select.with_column(sales, "x", [1] * 8, order_by="at").columns
    with pytest.raises(errors.InvalidShape):
        select.with_column(sales, "x", [1], order_by="at")
    with pytest.raises(errors.DuplicateColumn):
        select.rename(sales, {"amount": "category"})
    text = select.show_text(frames.from_records(sales.sparkSession, [{"a": None, "b": 1}]))
    assert text == "a\tb\n<null>\t1"


def test_frame_aggregates(make):
    df = make(a=[10, 20, None, 40, None], b=[None] * 5)
    assert agg.frame_sum(df, "a").first()[0] == 70.0
    assert agg.frame_count(df).first().asDict() == {"a": 3, "b": 0}
    assert agg.frame_mean(df, "a", skipna=False).first()[0] is None
    assert agg.frame_median(df, "a").first()[0] == 20.0
    assert agg.quantile(df, 0.25, "a").first()[0] == 15.0
    with pytest.raises(errors.ColumnNotFound):
        agg.frame_sum(df, "c")
    with pytest.raises(errors.InvalidArgument):
        agg.frame_sum(df, "b")
    d = agg.describe(df).collect()
    assert [r["column"] for r in d] == ["a"] and d[0]["p50"] == 20.0 and d[0]["count"] == 3


def test_groups(sales, make):
    by = agg.group_by(sales, "product_id")
    got = {r["product_id"]: r for r in by.agg_multiple({"amount": ["sum", "mean", "std"], "quantity": ["min", "max"]}).collect()}
    assert got[7]["amount_sum"] == 180.0 and got[7]["quantity_max"] == 8 and len(got) == 3
    nulls = make(key=[3, None, 3, None, 4], val=[2.0, 1.0, 5.0, 6.0, 9.0])
    assert {tuple(r) for r in agg.group_by(nulls, "key").agg({"val": "sum"}).collect()} == {(3, 7.0), (None, 7.0), (4, 9.0)}
    firsts = make(k=[1, 1, 1], v=[None, 5, 7], at=[0, 1, 2])
    assert rows(agg.group_by(firsts, "k").agg_multiple({"v": ["first", "last", "count"]}, order_by="at")) == [(1, 5, 7, 2)]
    assert agg.group_by(make(k=[1], v=make and [None]), "k").agg({"v": "count"}).first()[1] == 0
    with pytest.raises(errors.InvalidArgument):
        by.agg({"amount": "product"})
    with pytest.raises(errors.InvalidArgument):
        agg.group_by(sales)
    assert sorted(rows(by.size())) == [(7, 3), (8, 2), (9, 3)]
    assert sorted(rows(by.apply(F.max("amount") - F.min("amount")))) == [(7, 45.0), (8, 10.0), (9, 80.0)]
    assert sorted(rows(agg.group_by(sales, "product_id").apply(lambda f: float(f.amount.max() - f.amount.min())))) == [(7, 45.0), (8, 10.0), (9, 80.0)]


def test_joins(make):
    left, right = make(id=[5, None, 6], val=["a", "b", "c"]), make(id=[5, None, 9], data=["x", "y", "z"])
    assert join.join(left, right, "inner", "id").count() == 1
    got = {tuple(r) for r in join.join(left, right, "outer", "id", indicator="m").collect()}
    assert got == {(5, "a", "x", "both"), (None, "b", None, "left_only"), (6, "c", None, "left_only"), (None, None, "y", "right_only"), (9, None, "z", "right_only")}
    many = make(key=[4, 4, 4, 6])
    assert join.join(many, many, "inner", "key").count() == 10
    assert join.merge(make(a=[1, 2]), make(b=[1, 2, 3]), "cross").count() == 6
    both = join.merge(make(k=[1], v=[1]), make(j=[1], v=[2]), "right", ["k"], ["j"], suffixes=("_x", "_y"))
    assert both.columns == ["k", "v_x", "j", "v_y"] and rows(both) == [(1, 1, 1, 2)]
    with pytest.raises(errors.InvalidArgument):
        join.merge(left, right, "inner", ["id"], [])
    with pytest.raises(errors.ColumnNotFound):
        join.join(left, right, "inner", "nope")
    with pytest.raises(errors.InvalidArgument):
        join.join(left, right, "sideways", "id")


def test_sorting_puts_nulls_last(make):
    df = make(v=[2, None, 1], at=[0, 1, 2])
    assert rows(order.sort(df, "v"), "v") == [(1,), (2,), (None,)]
    assert rows(order.sort(df, "v", ascending=False), "v") == [(2,), (1,), (None,)]
    assert rows(order.sort(df, "v", nulls_first=True), "v") == [(None,), (1,), (2,)]
    assert sorted(rows(order.argsort(df, "v", order_by="at"))) == [(0, 2), (1, 0), (2, 1)]
    with pytest.raises(errors.ColumnNotFound):
        order.sort(df, "x")


def test_missing_values(make):
    df = make(a=[1.0, None, None, 4.0, None], s=["x", None, "y", None, None], at=list(range(5)))
    assert missing.dropna(df).count() == 1
    assert missing.dropna(df, how="all", subset=["a", "s"]).count() == 3
    assert missing.dropna(df, thresh=2, subset=["a", "s"]).count() == 1
    with pytest.raises(errors.ColumnNotFound):
        missing.dropna(df, subset=["b"])
    assert missing.fillna(df, 0).agg(F.sum("a"), F.count("s")).first()[:] == (5.0, 2)
    fill = lambda m, limit=None: [r[0] for r in missing.interpolate(df, m, limit, ["a"], order_by="at").orderBy("at").select("a").collect()]
    assert fill("linear") == [1, 2, 3, 4, None]
    assert fill("linear", 1) == [1, None, None, 4, None]
    assert fill("ffill") == [1, 1, 1, 4, 4]
    assert fill("ffill", 1) == [1, 1, None, 4, 4]
    assert fill("bfill") == [1, 4, 4, 4, None]
    assert fill("bfill", 1) == [1, None, 4, 4, None]
    with pytest.raises(errors.InvalidArgument):
        fill("cubic")
    within = missing.interpolate(df.withColumn("p", F.lit(1)), "ffill", columns=["a"], order_by="at", partition_by=["p"])
    assert [r[0] for r in within.orderBy("at").select("a").collect()] == [1, 1, 1, 4, 4]


def test_reshaping(sales, make):
    p = reshape.pivot(sales, "product_id", "category", "amount", order_by="at")
    assert p.columns == ["product_id", "P", "Q"] and p.count() == 3
    assert {tuple(r) for r in p.collect()} == {(7, 85.0, 55.0), (8, None, 65.0), (9, 20.0, 10.0)}
    again = make(i=[1, 1, 1, None], c=["x", "x", None, "x"], v=[1, None, 3, 4], at=[0, 1, 2, 3])
    assert rows(reshape.pivot(again, "i", "c", "v", order_by="at")) == [(1, 1)]
    with pytest.raises(errors.DuplicateColumn):
        reshape.pivot(make(i=[1], c=["i"], v=[1], at=[0]), "i", "c", "v", order_by="at")
    long = reshape.melt(make(id=[1, 2], a=[1, 2], b=["x", "y"]), ["id"])
    assert sorted(rows(long)) == [(1, "a", "1"), (1, "b", "x"), (2, "a", "2"), (2, "b", "y")]
    t = reshape.transpose(make(a=[1, 2], b=[3, 4]), order_by="a")
    assert rows(t) == [("a", 1, 2), ("b", 3, 4)]
    back = reshape.unstack(reshape.stack(make(a=[1, 2], b=[3, 4]), order_by="a"), "row", "column", "value", order_by="row")
    assert sorted(rows(back)) == [(0, 1, 3), (1, 2, 4)]
