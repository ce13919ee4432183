"""Windows over partitions and over whole frames agree with their definitions."""

import math
import random

import pytest

from loomframe import errors
from loomframe.operators import window
from loomframe.plans import halo


@pytest.fixture(scope="module")
def values():
    random.seed(1)
    return [None if random.random() < 0.2 else random.uniform(-5, 5) for _ in range(500)]


@pytest.fixture(scope="module")
def df(make, values):
    return make(at=list(range(500)), v=values).repartition(5)


def _stat(f, xs):
    n = len(xs)
    if f == "std":
        m = sum(xs) / n if n else 0
        return math.sqrt(sum((x - m) ** 2 for x in xs) / (n - 1)) if n > 1 else None
    return {"mean": lambda: sum(xs) / n, "sum": lambda: sum(xs), "min": lambda: min(xs), "max": lambda: max(xs)}[f]() if n else None


def _same(got, want):
    assert len(got) == len(want)
    for g, w in zip(got, want, strict=True):
        assert (g is None) == (w is None) and (g is None or abs(g - w) < 1e-9), (g, w)


def _get(frame, name):
    return [r[0] for r in frame.orderBy("at").select(name).collect()]


@pytest.mark.parametrize("f", ["mean", "sum", "std", "min", "max"])
def test_rolling_and_expanding(df, values, f, monkeypatch):
    monkeypatch.setattr(halo, "BUCKET", 64)
    monkeypatch.setattr(halo.from_start, "__defaults__", (False, 64, 3))
    for center in (False, True):
        want = []
        for i in range(500):
            a, b = (i - 2, i + 2) if center else (i - 4, i)
            xs = [x for x in values[max(a, 0) : b + 1] if x is not None]
            want.append(_stat(f, xs) if len(xs) >= 2 else None)
        _same(_get(getattr(window.rolling(df, 5, 2, center, order_by="at"), f)("v"), f"v_{f}"), want)
    want = [_stat(f, [x for x in values[: i + 1] if x is not None]) for i in range(500)]
    _same(_get(getattr(window.expanding(df, order_by="at"), f)("v"), f"v_{f}"), want)


def test_ewm_follows_the_recursion(df, values, monkeypatch):
    monkeypatch.setattr(halo.from_start, "__defaults__", (False, 64, 3))
    want, y = [], None
    for x in values:
        if x is not None:
            y = x if y is None else 0.4 * x + 0.6 * y
        want.append(y)
    _same(_get(window.ewm(df, 0.4, order_by="at").mean("v"), "v_mean"), want)
    one = df.selectExpr("*", "1 AS p")
    _same(_get(window.ewm(one, 0.4, order_by="at", partition_by=["p"]).mean("v"), "v_mean"), want)


def test_windows_need_an_order_and_a_size(df):
    with pytest.raises(errors.InvalidArgument):
        window.rolling(df, 3).mean("v")
    with pytest.raises(errors.InvalidArgument):
        window.rolling(df, 0, order_by="at")
    with pytest.raises(errors.ColumnNotFound):
        window.rolling(df, 3, order_by="at").mean("w")
