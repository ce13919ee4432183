"""Transformers in a row, saved and loaded with what they learned."""

from __future__ import annotations

import json
import time
from pathlib import Path

from pyspark.sql import DataFrame

from ..errors import FrameError, IndexOutOfBounds, InvalidArgument, KeyNotFound, NotFitted
from .base import Transformer

VERSION = "1.0"


class PipelineError(FrameError):
    """A step failed; its name and position are in the message."""


class Pipeline:
    def __init__(self, steps: list[tuple[str, Transformer]] | None = None) -> None:
        self.steps = list(steps or [])

    def add(self, name: str, step: Transformer) -> Pipeline:
        self.steps.append((name, step))
        return self

    def fit(self, df: DataFrame, target: str | None = None) -> Pipeline:
        """Each step is fitted on what the steps before it make; one job or few for each step."""
        if not self.steps:
            raise InvalidArgument("the pipeline has no steps")
        self._through(df, target)
        return self

    def fit_transform(self, df: DataFrame, target: str | None = None) -> DataFrame:
        if not self.steps:
            raise InvalidArgument("the pipeline has no steps")
        return self._through(df, target)

    def _through(self, df: DataFrame, target: str | None) -> DataFrame:
        for i, (name, step) in enumerate(self.steps):
            try:
                df = step.fit_transform(df, target)
            except FrameError as e:
                raise PipelineError(f"step {i} ({name}): {e}") from e
        return df

    def transform(self, df: DataFrame) -> DataFrame:
        for i, (name, step) in enumerate(self.steps):
            if not step.is_fitted:
                raise NotFitted(f"step {i} ({name}) is not fitted")
            df = step.transform(df)
        return df

    @property
    def is_fitted(self) -> bool:
        return bool(self.steps) and all(s.is_fitted for _, s in self.steps)

    def __len__(self) -> int:
        return len(self.steps)

    def step(self, at: int | str) -> Transformer:
        """By position or by name."""
        if isinstance(at, int):
            if not 0 <= at < len(self.steps):
                raise IndexOutOfBounds(f"no step {at}; there are {len(self.steps)}")
            return self.steps[at][1]
        for name, s in self.steps:
            if name == at:
                return s
        raise KeyNotFound(f"no step {at!r}")

    def save(self, path: str) -> None:
        """Parameters and learned state as JSON."""
        whole = {"version": VERSION, "steps": [{"name": n, **s.to_dict()} for n, s in self.steps]}
        Path(path).write_text(json.dumps(whole, indent=1))

    def save_metadata(self, path: str) -> None:
        whole = {"version": VERSION, "created": time.strftime("%Y-%m-%dT%H:%M:%SZ", time.gmtime()), "steps": [[n, type(s).__name__] for n, s in self.steps]}
        Path(path).write_text(json.dumps(whole, indent=1))


def load_pipeline(path: str) -> Pipeline:
    whole = json.loads(Path(path).read_text())
    if whole.get("version") != VERSION:
        raise InvalidArgument(f"the file has version {whole.get('version')!r}, not {VERSION}")
    return Pipeline([(s["name"], Transformer.from_dict(s)) for s in whole["steps"]])
