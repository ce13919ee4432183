"""Features, models, statistics on small literal frames and closed forms."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomframe import errors
from loomframe import features as ft
from loomframe import models as md
from loomframe.functions import distributions as dist
from loomframe.functions.special import chi2_upper, f_upper, t_two_sided
from loomframe.models import metrics, split
from loomframe.stats import correlation, descriptive, hypothesis


def values(df, name, by=None):
    return [r[0] for r in (df.orderBy(by) if by else df).select(F.col(f"`{name}`")).collect()]


def test_scalers(make):
    df = make(a=[1.0, 2.0, 3.0, 4.0, 5.0], c=[5.0] * 5, n=[1.0, None, 3.0, 4.0, 5.0], s=list("abcde"))
    s = ft.StandardScaler().fit(df)
    assert s.means["a"] == 3 and abs(s.stds["a"] - math.sqrt(2.5)) < 1e-12 and s.means["n"] == 3.25 and s.stds["c"] == 0
    out = s.transform(df)
    assert abs(values(out, "a")[0] + 2 / math.sqrt(2.5)) < 1e-12 and values(out, "c") == [5.0] * 5 and values(out, "n")[1] is None
    assert values(ft.StandardScaler(["a"], with_mean=False).fit_transform(df), "a")[0] == pytest.approx(1 / math.sqrt(2.5))
    assert values(ft.MinMaxScaler(["a"], -1, 1).fit_transform(df), "a") == [-1, -0.5, 0, 0.5, 1]
    assert values(ft.RobustScaler(["a"]).fit_transform(df), "a") == [-1, -0.5, 0, 0.5, 1]
    assert values(ft.MaxAbsScaler(["a"]).fit_transform(df), "a") == [0.2, 0.4, 0.6, 0.8, 1]
    with pytest.raises(errors.InvalidArgument):
        ft.StandardScaler(["s"]).fit(df)
    with pytest.raises(errors.NotFitted):
        ft.StandardScaler(["a"]).transform(df)


def test_encoders(make):
    df = make(c=["b", "a", None, "b"], y=[1.0, 0.0, 1.0, 0.0], at=[0, 1, 2, 3])
    other = make(c=["z", "a", None], at=[0, 1, 2])
    hot = ft.OneHotEncoder(["c"], order_by=["at"]).fit(df)
    assert hot.categories == {"c": ["b", "a"]}
    assert [tuple(r) for r in hot.transform(other).orderBy("at").select("c_b", "c_a").collect()] == [(0, 0), (0, 1), (0, 0)]
    assert "c_b" not in ft.OneHotEncoder(["c"], drop_first=True, order_by=["at"]).fit_transform(df).columns
    with pytest.raises(Exception, match="unknown category"):
        ft.OneHotEncoder(["c"], handle_unknown="error").fit(df).transform(other).collect()
    lab = ft.LabelEncoder("c", order_by=["at"]).fit(df)
    assert values(lab.transform(df), "c", "at") == [0, 1, None, 0]
    assert values(lab.inverse_transform(lab.transform(df)), "c", "at") == ["b", "a", None, "b"]
    with pytest.raises(Exception, match="unknown category"):
        lab.transform(other).collect()
    assert values(ft.OrdinalEncoder("c", ["a", "b"]).fit_transform(df), "c", "at") == [1, 0, None, 1]
    te = ft.TargetEncoder(["c"]).fit(df, "y")
    assert values(te.transform(other), "c", "at") == [0.5, pytest.approx(0.25), None]
    with pytest.raises(errors.InvalidArgument):
        ft.TargetEncoder(["c"]).fit(df)
    assert values(ft.FrequencyEncoder(["c"], normalize=True).fit(df).transform(other), "c", "at") == [0, pytest.approx(1 / 3), None]


def test_imputers(make):
    df = make(a=[1.0, None, 3.0, None, 5.0], b=[2.0, 4.0, 6.0, 8.0, 10.0], s=["A", None, "B", "A", "A"], at=list(range(5)))
    assert values(ft.SimpleImputer(["a"]).fit_transform(df), "a", "at") == [1, 3, 3, 3, 5]
    assert values(ft.SimpleImputer(["s"], "most_frequent").fit_transform(df), "s", "at")[1] == "A"
    assert values(ft.SimpleImputer(["a"], "constant", 999).fit_transform(df), "a", "at")[1] == 999
    with pytest.raises(errors.InvalidArgument):
        ft.SimpleImputer(["a"], "guess").fit(df)
    assert ft.SimpleImputer(["b"], "guess").fit(df).stats == {}
    assert values(ft.KNNImputer(2, ["a", "b"]).fit_transform(df), "a", "at") == [1, 2, 3, 4, 5]
    assert values(ft.KNNImputer(1, ["a", "b"], "distance").fit_transform(df), "a", "at")[1] in (1, 3)
    assert values(ft.IterativeImputer(["a", "b"]).fit_transform(df), "a", "at") == pytest.approx([1, 2, 3, 4, 5])


def test_selectors_and_creators(make):
    df = make(x=[1.0, 2.0, 3.0, 4.0], z=[4.0, 1.0, 3.0, 2.0], c=[1.0] * 4, y=[2.0, 4.0, 6.0, 8.1], s=list("abcd"))
    assert ft.VarianceThreshold(0).fit(df).selected == ["x", "z", "y"]
    assert ft.SelectKBest(1).fit(df, "y").selected == ["x"]
    assert ft.SelectPercentile(50).fit(df, "y").selected == ["x", "c"] or ft.SelectPercentile(50).fit(df, "y").selected[0] == "x"
    assert ft.RFE(1).fit(df, "y").selected == ["x"]
    poly = ft.PolynomialFeatures(3, include_bias=True, columns=["x", "z"]).fit_transform(df)
    assert {"bias", "x^2", "z^2", "x*z", "x^3", "x^2*z", "z^2*x"} <= set(poly.columns)
    assert values(poly, "x*z") == [4, 2, 9, 8]
    assert values(ft.InteractionFeatures(["x", "z"]).fit_transform(df), "x*z") == [4, 2, 9, 8]
    assert values(ft.BinDiscretizer(["x"], 3).fit_transform(df), "x") == [0, 1, 2, 2]
    assert values(ft.BinDiscretizer(["x"], 2, "quantile", "onehot").fit_transform(df), "x_bin1") == [0, 0, 1, 1]
    with pytest.raises(errors.InvalidArgument):
        ft.BinDiscretizer(["x"], 1)


def test_pipelines_keep_what_they_learned(make, tmp_path):
    df = make(age=[25.0, None, 35.0, 45.0, 55.0], income=[1.0, 2.0, 3.0, 4.0, 5.0], c=["a", "b", "a", "b", "a"], y=[1.0, 0.0, 1.0, 0.0, 1.0], at=list(range(5)))
    p = ft.Pipeline().add("impute", ft.SimpleImputer(["age"])).add("scale", ft.StandardScaler(["age", "income"])).add("label", ft.LabelEncoder("c"))
    assert not p.is_fitted and len(p) == 3
    with pytest.raises(errors.NotFitted):
        p.transform(df)
    want = [tuple(r) for r in p.fit_transform(df).orderBy("at").collect()]
    p.save(str(tmp_path / "p.json"))
    p.save_metadata(str(tmp_path / "m.json"))
    again = ft.load_pipeline(str(tmp_path / "p.json"))
    assert again.is_fitted and [tuple(r) for r in again.transform(df).orderBy("at").collect()] == want
    with pytest.raises(errors.InvalidArgument):
        ft.Pipeline().fit(df)
    with pytest.raises(errors.FrameError, match="step 0 \\(bad\\)"):
        ft.Pipeline([("bad", ft.StandardScaler(["c"]))]).fit(df)
    with pytest.raises(errors.KeyNotFound):
        p.step("nope")
    num = df.select("age", "income", "y")
    for t in (
        ft.MinMaxScaler(["income"]), ft.RobustScaler(["income"]), ft.MaxAbsScaler(["income"]), ft.KNNImputer(2), ft.IterativeImputer(), ft.SelectKBest(1),
        ft.SelectPercentile(50), ft.RFE(1), ft.VarianceThreshold(), ft.PolynomialFeatures(), ft.InteractionFeatures(["age", "income"]), ft.BinDiscretizer(["income"]),
    ):
        q = ft.Pipeline([("t", t)]).fit(num, "y")
        q.save(str(tmp_path / "q.json"))
        assert [tuple(r) for r in ft.load_pipeline(str(tmp_path / "q.json")).transform(num).collect()] == [tuple(r) for r in q.transform(num).collect()]


def test_linear_models(make):
    df = make(x=[0.0, 1.0, 2.0, 4.0, 6.0], y=[-2.0, 1.0, 4.0, 10.0, 16.0])
    m = md.LinearRegression().fit(df, "y")
    assert m.coef["x"] == pytest.approx(3) and m.intercept == pytest.approx(-2) and m.score(df, "y") == pytest.approx(1)
    assert values(m.predict(make(x=[5.0, 9.0])), "prediction") == pytest.approx([13, 25])
    with pytest.raises(errors.InvalidArgument):
        md.LinearRegression().fit(df.withColumn("z", F.col("x") * 2), "y")
    assert md.Ridge(0).fit(df, "y").coef["x"] == pytest.approx(3)
    assert md.Ridge(10).fit(df, "y").coef["x"] == pytest.approx(3 * 23.2 / (23.2 + 10))  # 23.2: squares of x about its mean
    rng = np.random.default_rng(0)
    x = rng.normal(size=(60, 3))
    y = 3 * x[:, 0] + 0.01 * rng.normal(size=60)
    f = make(a=x[:, 0].tolist(), b=x[:, 1].tolist(), c=x[:, 2].tolist(), y=y.tolist())
    lasso = md.Lasso(20).fit(f, "y")
    assert lasso.coef["a"] > 2 and lasso.coef["b"] == lasso.coef["c"] == 0
    with pytest.raises(errors.InvalidArgument):
        md.LinearRegression().fit(make(x=[1.0, 2.0], y=[1.0, None]), "y")
    with pytest.raises(errors.NotFitted):
        md.LinearRegression().predict(df)


def test_classifiers(make):
    df = make(x=[1.0, 2.0, 3.0, 4.0, 5.0, 6.0, 7.0, 8.0], y=["n"] * 4 + ["p"] * 4)
    m = md.LogisticRegression(C=100).fit(df, "y")
    assert metrics.accuracy(m.predict(df), "y", "prediction") == 1 and m.classes == ["n", "p"]
    p = m.predict_proba(df).select(F.max(F.abs(F.col("probability_0") + F.col("probability_1") - 1))).first()[0]
    assert p < 1e-12
    with pytest.raises(errors.InvalidArgument):
        md.LogisticRegression().fit(make(x=[1.0, 2.0, 3.0], y=["a", "b", "c"]), "y")
    t = md.DecisionTreeClassifier().fit(df, "y")
    assert metrics.accuracy(t.predict(df), "y", "prediction") == 1 and t.feature_importances == {"x": 1.0}
    r = md.DecisionTreeRegressor().fit(make(x=[1.0, 2.0, 3.0, 4.0], y=[1.0, 1.0, 5.0, 5.0]), "y")
    assert values(r.predict(make(x=[1.5, 3.5])), "prediction") == [1, 5]


def test_clusters_and_components(make):
    df = make(x=[1.0, 1.5, 1.2, 10.0, 10.5, 10.2], y=[1.0, 1.2, 0.8, 10.0, 9.8, 10.1])
    got = values(md.KMeans(2).fit_predict(df), "prediction")
    assert len(set(got[:3])) == len(set(got[3:])) == 1 and got[0] != got[3]
    with pytest.raises(errors.InvalidArgument):
        md.KMeans(7).fit(df)
    assert md.KMeans(1).fit(df).inertia > 0
    p = md.PCA(2).fit(make(x=[1.0, 2.0, 3.0, 4.0], y=[2.0, 4.0, 6.0, 8.0]))
    assert p.explained_variance_ratio[0] > 0.999 and np.allclose(np.linalg.norm(p.components, axis=1), 1)
    assert values(p.transform(make(x=[2.5], y=[5.0])), "PC1") == pytest.approx([0])


def test_splits(make):
    df = make(k=list(range(103)), y=["a"] * 60 + ["b"] * 43)
    train, test = split.train_test_split(df, 0.2, seed=3, order_by="k")
    assert (train.count(), test.count()) == (83, 20) and train.intersect(test).count() == 0
    train, test = split.train_test_split(df, 0.2, stratify="y", order_by="k")
    assert sorted(map(tuple, test.groupBy("y").count().collect())) == [("a", 12), ("b", 8)]
    sizes = sorted(r["count"] for r in split.kfold_assign(df, 5, shuffle=True, order_by="k").groupBy("fold").count().collect())
    assert sizes == [20, 20, 21, 21, 21]
    parts = list(split.folds(split.kfold_assign(df, 5, order_by="k"), 5))
    assert sum(a.count() for a, _ in parts) == 412 and sum(b.count() for _, b in parts) == 103
    strata = split.stratified_kfold_assign(df, "y", 4, order_by="k").groupBy("y", "fold").count().collect()
    assert all(r["count"] in (15, 10, 11) for r in strata) and len(strata) == 8
    line = make(x=[float(i) for i in range(20)], y=[2.0 * i for i in range(20)])
    scores = split.cross_val_score(md.LinearRegression, line, "y", metrics.r2_score, 4, order_by="x")
    assert min(scores) > 0.999


def test_metrics(make):
    df = make(t=list("xxyyxyyxx"), p=list("xyyyxxyxx"))
    assert metrics.accuracy(df, "t", "p") == 7 / 9
    assert metrics.precision(df, "t", "p") == pytest.approx((4 / 5 + 3 / 4) / 2)
    assert metrics.recall(df, "t", "p", "binary") == pytest.approx(3 / 4)
    assert metrics.precision(df, "t", "p", "micro") == 7 / 9
    assert 0 < metrics.f1_score(df, "t", "p", "weighted") < 1
    assert [tuple(r) for r in metrics.confusion_matrix(df, "t", "p").collect()] == [("x", 4, 1), ("y", 1, 3)]
    assert metrics.classification_report(df, "t", "p").count() == 2
    r = make(t=[2.0, 4.0, 6.0, 8.0], p=[2.5, 4.0, 5.0, 8.5])
    assert metrics.mse(r, "t", "p") == pytest.approx(0.375) and metrics.mae(r, "t", "p") == pytest.approx(0.5) and metrics.r2_score(r, "t", "p") == pytest.approx(0.925)
    assert metrics.adjusted_r2(r, "t", "p", 1) == pytest.approx(1 - 0.075 * 3 / 2) and math.isnan(metrics.adjusted_r2(r, "t", "p", 3))


def test_statistics(make):
    df = make(v=[2.0, 4.0, 4.0, 4.0, 5.0, 5.0, 7.0, 9.0], w=[1.0, 3.0, 2.0, 5.0, 4.0, 7.0, 6.0, 8.0])
    d = descriptive.describe(df, "v").first()
    assert d["std"] == pytest.approx(2.13809, abs=1e-5) and d["median"] == 4.5
    assert tuple(descriptive.mode_count(df, "v").first()) == (4.0, 3)
    assert df.agg(descriptive.std(F.col("v"))).first()[0] == d["std"]
    assert make(v=[1.0]).agg(descriptive.std(F.col("v")), descriptive.skew(F.col("v")), descriptive.kurtosis(F.col("v"))).first()[:] == (0, 0, 0)
    v, w = np.array(values(df, "v")), np.array(values(df, "w"))
    assert correlation.pearson(df, "v", "w") == pytest.approx(np.corrcoef(v, w)[0, 1])
    rank = lambda x: np.array([(x < a).sum() + ((x == a).sum() + 1) / 2 for a in x])
    assert correlation.spearman(df, "v", "w") == pytest.approx(np.corrcoef(rank(v), rank(w))[0, 1])
    tau = sum(np.sign(v[j] - v[i]) * np.sign(w[j] - w[i]) for i in range(8) for j in range(i + 1, 8)) / 28
    assert correlation.kendall(df, "v", "w") == pytest.approx(tau)
    assert correlation.covariance(df, "v", "w") == pytest.approx(np.cov(v, w)[0, 1])
    m = correlation.corr_matrix(df.withColumn("c", F.lit(1.0)), ["v", "c"]).collect()
    assert m[0]["v"] == 1 and m[0]["c"] is None and m[1]["c"] == 1
    assert correlation.cov_matrix(df).count() == 2
    with pytest.raises(errors.InvalidArgument):
        correlation.pearson(df.withColumn("c", F.lit(1.0)), "v", "c")


def test_hypothesis_tests(make):
    assert t_two_sided(2, 9) == pytest.approx(0.0765528, abs=1e-6)
    assert f_upper(4, 2, 9) == pytest.approx(0.0571572, abs=1e-6)
    assert chi2_upper(4, 3) == pytest.approx(0.2614641, abs=1e-6)
    df = make(v=[2.0, 4.0, 4.0, 6.0], w=[1.0, 3.0, 4.0, 4.0])
    assert hypothesis.ttest(df, "v", 4).p_value == 1
    assert hypothesis.ttest_paired(df, "v", "w").statistic == pytest.approx(2.449489742783178)
    assert hypothesis.ttest_2sample(df, "v", df, "w").df == 6
    assert hypothesis.ttest(make(v=[1.0]), "v").df == 0
    assert hypothesis.chi_square_gof([10, 20, 30], [20, 20, 20]).statistic == 10
    assert hypothesis.chi_square([[10, 20], [20, 10]], [[15, 15], [15, 15]]).df == 1
    table = make(r=["a"] * 3 + ["b"] * 3, c=["x", "x", "y", "y", "y", "x"])
    assert hypothesis.chi_square_independence(table, "r", "c").statistic == pytest.approx(2 / 3)
    groups = make(g=list("aaabbbccc"), v=[1.0, 2.0, 3.0, 2.0, 3.0, 4.0, 5.0, 6.0, 7.0])
    a, b = hypothesis.one_way_anova(groups, "g", "v"), hypothesis.anova([1, 2, 3], [2, 3, 4], [5, 6, 7])
    assert a.f_statistic == pytest.approx(b.f_statistic) == pytest.approx(13) and a.df_within == 6


def test_distributions(spark):
    n = dist.Normal(0, -1)
    assert n.sigma == 1 and n.cdf(1.959963984540054) == pytest.approx(0.975) and n.ppf(0.975) == pytest.approx(1.959963984540054)
    u = dist.Uniform(2, 1)
    assert (u.low, u.high, u.cdf(2.5), u.pdf(5), u.ppf(0.5), u.variance()) == (2, 3, 0.5, 0, 2.5, 1 / 12)
    b = dist.Binomial(10, 0.3)
    assert sum(b.pmf(k) for k in range(11)) == pytest.approx(1) and b.cdf(3) == pytest.approx(sum(b.pmf(k) for k in range(4))) and b.mean() == 3
    m, v = b.sample(spark, 4000, 1).selectExpr("avg(value)", "var_samp(value)").first()
    assert abs(m - 3) < 0.15 and abs(v - 2.1) < 0.3
    m, s = n.sample(spark, 4000, 1).selectExpr("avg(value)", "stddev_samp(value)").first()
    assert abs(m) < 0.1 and abs(s - 1) < 0.1
    assert dist.standard_normal().pdf(0) == pytest.approx(0.3989422804)


def test_quantiles_by_counting(make, monkeypatch):
    import random

    from loomframe.plans import quantiles as q

    monkeypatch.setattr(q, "FEW", 8)
    monkeypatch.setattr(q, "BINS", 64)
    r = random.Random(3)
    data = {
        "wide": [r.choice([-1, 1]) * 10 ** r.uniform(-300, 300) for _ in range(300)],
        "ties": [float(r.randint(0, 3)) for _ in range(300)],
        "near": [1.0 + r.randint(0, 40) * 2**-52 for _ in range(300)],
        "gaps": [None if r.random() < 0.5 else r.gauss(0, 1) for _ in range(300)],
    }
    df = make(**data).coalesce(1).cache()
    qs = [0, 0.3, 1]
    got, want = q.quantiles(df, list(data), qs, moderate=10), q.quantiles(df, list(data), qs)
    df.unpersist()
    for n in data:
        assert got[n] == pytest.approx(want[n], rel=1e-12), n
    assert q.quantiles(df.limit(0), ["ties"], [0.5], moderate=-1) == {"ties": [None]}


def test_vector_queries_use_every_element(spark, tmp_path):
    from loomframe import queries

    r = np.random.default_rng(4)
    x = r.normal(0, 0.01, (40, 12))
    x[:, 11] += np.repeat([0.0, 10.0, 20.0, 40.0], 10)
    spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    first = [row["PC1"] for row in queries.pca(spark, str(tmp_path)).orderBy("vec_id").collect()]
    assert first == pytest.approx(list(x[:, 11] - x[:, 11].mean()), abs=0.2)
    found = [row["prediction"] for row in queries.kmeans(spark, str(tmp_path)).orderBy("vec_id").collect()]
    assert all(len(set(found[k : k + 10])) == 1 for k in range(0, 40, 10)) and len(set(found)) > 1


def test_kendall_counts_any_number_of_rows(spark):
    r = np.random.default_rng(5)
    v, w = r.integers(0, 60, 700).astype(float), r.normal(0, 1, 700).round(1)
    v[:200] = 7.0
    df = spark.createDataFrame(list(zip(v.tolist(), w.tolist(), strict=True)), "v double, w double")
    tau = (np.sign(v[:, None] - v) * np.sign(w[:, None] - w)).sum() / (700 * 699)
    for bucket in (40, 1000):
        assert correlation.kendall(df, "v", "w", bucket) == pytest.approx(tau, abs=1e-12)
    many = spark.range(20_001).selectExpr("double(id) AS v", "-double(id) AS w")
    assert correlation.corr_matrix(many, ["v", "w"], "kendall").first()["w"] == -1
