"""What transformers share: parameters, learned state, and their JSON form."""

from __future__ import annotations

import inspect
from typing import Any

from pyspark.sql import DataFrame

from ..errors import NotFitted

REGISTRY: dict[str, type[Transformer]] = {}


class Transformer:
    """Parameters are the arguments of ``__init__``, under the same names; what is learned is in ``state``, plain values only."""

    state: dict[str, Any] | None = None

    def __init_subclass__(cls, **kwargs) -> None:
        super().__init_subclass__(**kwargs)
        REGISTRY[cls.__name__] = cls

    def fit(self, df: DataFrame, target: str | None = None) -> Transformer:
        self.state = self._fit(df, target)
        return self

    def transform(self, df: DataFrame) -> DataFrame:
        if self.state is None:
            raise NotFitted(f"{type(self).__name__} is not fitted")
        return self._transform(df)

    def fit_transform(self, df: DataFrame, target: str | None = None) -> DataFrame:
        return self.fit(df, target).transform(df)

    @property
    def is_fitted(self) -> bool:
        return self.state is not None

    def _fit(self, df: DataFrame, target: str | None) -> dict[str, Any]:
        raise NotImplementedError

    def _transform(self, df: DataFrame) -> DataFrame:
        raise NotImplementedError

    def params(self) -> dict[str, Any]:
        return {n: getattr(self, n) for n in inspect.signature(type(self).__init__).parameters if n != "self"}

    def to_dict(self) -> dict[str, Any]:
        return {"type": type(self).__name__, "params": self.params(), "state": self.state}

    @staticmethod
    def from_dict(data: dict[str, Any]) -> Transformer:
        made = REGISTRY[data["type"]](**data["params"])
        made.state = data["state"]
        return made
