"""Operators against the same thing computed by hand, past the sizes at which they change how they work."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomframe import features as ft
from loomframe import models as md
from loomframe.features import imputers
from loomframe.operators import agg, order, window
from loomframe.plans import quantiles
from loomframe.rows import with_row_id


def filled_by_neighbours(rows, k, by_distance):
    out = []
    for x in rows:
        y = list(x)
        for j in [j for j, v in enumerate(x) if v is None]:
            near = []
            for r in rows:
                both = [(a - b) ** 2 for a, b in zip(x, r, strict=True) if a is not None and b is not None]
                if both and r[j] is not None:
                    near.append((sum(both) ** 0.5, r[j]))
            near = sorted(near)[:k]
            if near:
                w = [1 / d if by_distance and d else 1.0 for d, _ in near]
                y[j] = sum(a * v for a, (_, v) in zip(w, near, strict=True)) / sum(w)
        out.append(y)
    return out


@pytest.mark.parametrize("by_distance", [False, True])
@pytest.mark.parametrize("held", [10_000, 10])
def test_every_fitted_row_can_be_a_neighbour(spark, monkeypatch, held, by_distance):
    for name, value in (("IN_STATE", held), ("BLOCK", 40), ("ASKING", 7), ("MERGED", 3)):
        monkeypatch.setattr(imputers, name, value)
    r = random.Random(1)
    rows = [[r.choice([None, float(r.randint(0, 6))]) if r.random() < 0.3 else r.uniform(0, 9) for _ in range(3)] for _ in range(300)]
    rows += [[1.0, 2.0, 3.0]] * 20 + [[None, 2.0, 3.0]] * 3 + [[None, None, None]]
    df = spark.createDataFrame([(i, *x, "kept") for i, x in enumerate(rows)], "i int, a double, b double, c double, _knn string").repartition(3)
    got = ft.KNNImputer(4, ["a", "b", "c"], "distance" if by_distance else "uniform").fit_transform(df)
    assert got.columns == df.columns
    found = [list(x) for x in got.orderBy("i").select("a", "b", "c").collect()]
    for g, w in zip(found, filled_by_neighbours(rows, 4, by_distance), strict=True):
        assert g == [None if v is None else pytest.approx(v) for v in w]


def test_all_rounds_of_the_iterative_imputer_are_replayed(spark):
    """Gaps in two columns that lean on one another, against the same rounds in numpy."""
    r = np.random.default_rng(2)
    a = r.normal(size=400)
    b = 2 * a + 0.1 * r.normal(size=400)
    c = a - b + 0.1 * r.normal(size=400)
    x = np.stack([a, b, c], axis=1)
    x[r.random(400) < 0.3, 0] = np.nan
    x[r.random(400) < 0.3, 1] = np.nan
    df = spark.createDataFrame([(i, *[None if v != v else float(v) for v in row], 7) for i, row in enumerate(x)], "i int, a double, b double, c double, x0 int")
    fitted = ft.IterativeImputer(["a", "b", "c"], max_iter=12, tolerance=0).fit(df)
    gap, f = np.isnan(x), np.where(np.isnan(x), np.nanmean(x, axis=0), x)
    for _ in range(12):
        for i in (0, 1):
            rest = [j for j in range(3) if j != i]
            design = np.c_[np.ones(400), f[:, rest]]
            beta = np.linalg.lstsq(design[~gap[:, i]], x[~gap[:, i], i], rcond=None)[0]
            f[gap[:, i], i] = (design @ beta)[gap[:, i]]
    assert len(fitted.state["rounds"]) == 12
    out = fitted.transform(df)
    assert out.columns == df.columns
    assert np.allclose(np.array([list(v) for v in out.orderBy("i").select("a", "b", "c").collect()]), f, atol=1e-6)


def cart(x, y, depth, least):
    """Predictions of the tree that takes, of all midpoints, the split that leaves the smallest gini."""

    def gini(v):
        _, n = np.unique(v, return_counts=True)
        return 1 - ((n / len(v)) ** 2).sum()

    def label(v):
        values, n = np.unique(v, return_counts=True)
        return values[n.argmax()]

    out = np.empty(len(y), object)

    def grow(at, d):
        best = None
        if d < depth and len(at) >= least and gini(y[at]) > 0:
            for j in range(x.shape[1]):
                values = np.unique(x[at, j])
                for t in (values[1:] + values[:-1]) / 2:
                    go = x[at, j] <= t
                    left = (go.sum() * gini(y[at[go]]) + (~go).sum() * gini(y[at[~go]])) / len(at)
                    if best is None or left < best[0] - 1e-12:
                        best = left, j, t
        if best is None or best[0] >= gini(y[at]) - 1e-12:
            out[at] = label(y[at])
        else:
            go = x[at, best[1]] <= best[2]
            grow(at[go], d + 1)
            grow(at[~go], d + 1)

    grow(np.arange(len(y)), 0)
    return out


@pytest.mark.parametrize(("depth", "least"), [(3, 2), (6, 40), (4, 401)])
def test_trees_look_at_every_midpoint(spark, depth, least):
    r = np.random.default_rng(3)
    x = r.normal(size=(400, 2))  # 400 values a feature, more than any default number of bins
    y = np.where(x[:, 0] + 0.5 * x[:, 1] + 0.5 * r.normal(size=400) > 0.2, "p", "n")
    df = spark.createDataFrame([(i, float(a), float(b), str(c)) for i, (a, b, c) in enumerate(zip(x[:, 0], x[:, 1], y, strict=True))], "i int, a double, b double, y string")
    tree = md.DecisionTreeClassifier(depth, least, features=["a", "b"]).fit(df, "y")
    got = [v["prediction"] for v in tree.predict(df).orderBy("i").collect()]
    assert np.mean(np.array(got) == cart(x, y, depth, least)) == 1
    assert sum(tree.feature_importances.values()) == pytest.approx(0 if least > 400 else 1)


def test_medians_of_groups_by_counting(spark, monkeypatch):
    rows = [(None if i % 10 == 0 else "hot" if i % 3 else f"k{i % 4}", None if i % 7 == 0 else float(i * 37 % 101)) for i in range(900)]
    df = spark.createDataFrame(rows, "k string, v double")
    plain = agg.group_by(df, "k").agg_multiple({"v": ["sum", "median", "count"]}).orderBy("k").collect()
    monkeypatch.setattr(quantiles, "MODERATE_BYTES", 0)
    made = agg.group_by(df, "k").agg_multiple({"v": ["sum", "median", "count"]})
    assert "percentile" not in made._jdf.queryExecution().optimizedPlan().toString() and "median" not in made._jdf.queryExecution().optimizedPlan().toString().replace("v_median", "")
    assert made.orderBy("k").collect() == plain
    assert agg.group_by(df, "k").agg({"v": "median"}).orderBy("k").collect() == [(r["k"], r["v_median"]) for r in plain]


def test_positions_stay_though_rows_tie(spark):
    df = spark.range(1000).selectExpr("id", "id % 3 AS t").repartition(5)
    placed = with_row_id(df, "t")
    a, b = ({r["id"]: r["_row"] for r in placed.collect()} for _ in range(2))
    assert a == b and sorted(a.values()) == list(range(1000))


def test_helper_columns_do_not_clash(spark):
    df = spark.range(50).selectExpr("id AS _row", "CAST(id AS double) AS v", "'a' AS _bucket", "'b' AS _x0", "'c' AS _group", "'d' AS _s0")
    rolled, total = window.rolling(df, 3, min_periods=1).mean("v"), window.expanding(df).sum("v")
    for out, name in ((rolled, "v_mean"), (total, "v_sum")):
        assert set(out.columns) == {*df.columns, name} and {(r["_bucket"], r["_x0"], r["_group"], r["_s0"]) for r in out.collect()} == {("a", "b", "c", "d")}


def test_logistic_regression_minimises_its_loss(spark):
    r = np.random.default_rng(4)
    x = r.normal(size=(300, 2))
    y = (x @ [1.5, -1.0] + 0.5 + r.logistic(size=300) > 0).astype(int)
    df = spark.createDataFrame([(float(a), float(b), int(c)) for (a, b), c in zip(x, y, strict=True)], "a double, b double, y int")
    m = md.LogisticRegression(penalty="none", max_iter=200).fit(df, "y")
    w = np.zeros(3)
    design = np.c_[np.ones(300), x]
    for _ in range(50):  # Newton's method
        p = 1 / (1 + np.exp(-design @ w))
        w -= np.linalg.solve(design.T @ (design * (p * (1 - p))[:, None]), design.T @ (p - y))
    assert [m.intercept, m.coef["a"], m.coef["b"]] == pytest.approx(w.tolist(), abs=1e-3)


def test_components_are_those_of_the_covariance(spark):
    r = np.random.default_rng(5)
    x = r.normal(size=(200, 6)) @ r.normal(size=(6, 6))
    names = [f"f{j}" for j in range(6)]
    df = spark.createDataFrame([(i, *map(float, v)) for i, v in enumerate(x)], "i int, " + ", ".join(f"{n} double" for n in names))
    p = md.PCA(3, features=names)
    got = np.array([[v["PC1"], v["PC2"], v["PC3"]] for v in p.fit_transform(df).orderBy("i").collect()])
    centred = x - x.mean(axis=0)
    _, s, v = np.linalg.svd(centred, full_matrices=False)
    want = centred @ v[:3].T
    assert np.allclose(np.abs(got), np.abs(want), atol=1e-6)
    assert list(p.explained_variance_ratio) == pytest.approx((s**2 / (s**2).sum())[:3].tolist())


def test_clusters_are_those_of_the_points(spark):
    r = np.random.default_rng(6)
    centres = np.array([[0, 0, 0], [20, 0, 0], [0, 20, 0], [0, 0, 20]], float)
    x = np.concatenate([c + r.normal(size=(40, 3)) for c in centres])
    df = spark.createDataFrame([(i, *map(float, v)) for i, v in enumerate(x)], "i int, a double, b double, c double")
    got = [v["prediction"] for v in md.KMeans(4, features=["a", "b", "c"]).fit(df).predict(df).orderBy("i").collect()]
    parts = [set(got[k * 40 : k * 40 + 40]) for k in range(4)]
    assert all(len(p) == 1 for p in parts) and len(set.union(*parts)) == 4


def test_sorting_puts_nulls_where_asked(spark):
    df = spark.createDataFrame([(2, "b"), (None, "a"), (1, None)], "x int, s string")
    for first, up in itertools.product((True, False), (True, False)):
        got = [r["x"] for r in order.sort(df, "x", up, nulls_first=first).collect()]
        known = [1, 2] if up else [2, 1]
        assert got == ([None, *known] if first else [*known, None])
    assert [r["s"] for r in order.sort_index(df.filter(F.col("s").isNotNull()), "s", False).collect()] == ["b", "a"]


def test_many_categories_are_kept_as_a_table(spark, monkeypatch):
    from loomframe.features import encoders

    rows = [(i, f"c{i * i % 37}", float(i)) for i in range(400)] + [(400, None, 1.0)]
    df = spark.createDataFrame(rows, "i int, c string, y double")
    other = df.unionAll(spark.createDataFrame([(401, "new", 0.0)], df.schema))
    made = []
    for most in (100_000, 5):
        monkeypatch.setattr(encoders, "MAX_CATEGORIES", most)
        label = ft.LabelEncoder("c", order_by=["i"])
        coded = label.fit_transform(df)
        back = label.inverse_transform(coded).orderBy("i").collect()
        assert [r["c"] for r in back] == [c for _, c, _ in rows]
        frames = [coded, ft.FrequencyEncoder(["c"], normalize=True).fit(df).transform(other), ft.TargetEncoder(["c"]).fit(df, "y").transform(other)]
        made.append([sorted(map(str, f.collect())) for f in frames])
        assert isinstance(label.state["mapping"], dict) == (most > 5)
    assert made[0] == made[1]
    with pytest.raises(Exception, match="too many"):
        label.mapping  # noqa: B018


def test_json_texts_have_a_bound(spark, tmp_path, monkeypatch):
    from loomframe.sources import json

    df = spark.range(100)
    monkeypatch.setattr(json, "MAX_TEXT", 10)
    with pytest.raises(Exception, match="write lines"):
        json.write_json(df, str(tmp_path / "a"))
    json.write_json(df, str(tmp_path / "b"), lines=True)
    assert json.read_json(spark, str(tmp_path / "b"), lines=True).count() == 100


def test_distribution_columns_are_their_functions(spark):
    from loomframe.functions.distributions import Binomial, Normal, Uniform

    x = [-1.0, 0.0, 0.25, 0.5, 0.75, 1.0, 2.0, None]
    df = spark.createDataFrame([(v,) for v in x], "x double")
    for d, names in ((Normal(0.5, 2), ("pdf", "cdf")), (Uniform(0, 2), ("pdf", "cdf")), (Binomial(2, 0.25), ("pmf", "cdf"))):
        for name in names:
            c = F.floor("x").cast("double") if isinstance(d, Binomial) else F.col("x")
            got = [r[0] for r in df.select(getattr(d, f"{name}_column")(c)).collect()]
            f = getattr(d, name)
            assert got == [None if v is None else pytest.approx(f(int(np.floor(v)) if isinstance(d, Binomial) else v)) for v in x]
    shares = spark.createDataFrame([(0.1,), (0.5,), (0.9,)], "p double")
    for d in (Normal(3, 2), Uniform(1, 5)):
        assert [r[0] for r in shares.select(d.ppf_column(F.col("p"))).collect()] == pytest.approx([d.ppf(p) for p in (0.1, 0.5, 0.9)])


def test_rates_over_a_whole_frame_are_the_recursion(spark, monkeypatch):
    from loomframe.plans import halo

    monkeypatch.setattr(halo, "BUCKET", 50)
    r = random.Random(7)
    v = [r.uniform(0, 100) for _ in range(700)]
    df = spark.createDataFrame(list(enumerate(v)), "_row long, v double")
    got = [x["v_mean"] for x in window.ewm(df, 0.3).mean("v").orderBy("_row").collect()]
    want, now = [], None
    for x in v:
        now = x if now is None else 0.3 * x + 0.7 * now
        want.append(now)
    assert got == pytest.approx(want, rel=1e-9)
