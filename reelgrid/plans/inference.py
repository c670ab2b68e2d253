"""The boundary to decoders and models: any Python callable over frames, with one frame's failure kept to it."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence
from dataclasses import dataclass
from functools import partial

import pandas as pd
from pyspark.sql import DataFrame

from reelgrid import schemas


@dataclass(frozen=True)
class Model:
    """A column that a model adds: build() is called once a worker and gives a function of a batch of rows -> one value a row."""

    column: str
    type: str
    build: Callable[[], Callable[[pd.DataFrame], list]]


def with_models(frames: DataFrame, models: Sequence[Model], batch: int | None = None, drop: Sequence[str] = ()) -> DataFrame:
    """Adds the models' columns in one pass and, where one raised, `error` as `TypeName: message` (an earlier error stays); then leaves out `drop`.

    A batch has at most `batch` rows (none: an Arrow batch); one that raises is done again row
    by row. Each model sees the rows with the columns of those before it. Spark moves no filter
    through it: frames that need no model are to be left out before.
    """
    added = [m.column for m in models]
    kept = [c for c in frames.columns if c not in (*added, "error", *drop)]
    types = dict(frames.dtypes)
    fields = [f"`{c}` {types[c]}" for c in kept] + [f"`{m.column}` {m.type}" for m in models]
    had = "error" in frames.columns

    def values_of(model: Callable[[pd.DataFrame], list], b: pd.DataFrame, errors: list) -> list:
        """The model's value of each row, a part of the batch at a time; of a part that raises, row by row."""
        out, size = [], batch or max(1, len(b))
        for at in range(0, len(b), size):
            part = b.iloc[at : at + size]
            try:
                values = list(model(part))
                if len(values) != len(part):
                    raise ValueError("a value for each row is needed")
            except Exception:
                values = []
                for i in range(at, at + len(part)):
                    try:
                        values.append(model(b.iloc[i : i + 1])[0])
                    except Exception as e:
                        values.append(None)
                        errors[i] = errors[i] if isinstance(errors[i], str) else f"{type(e).__name__}: {e}"
            out += values
        return out

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        built = [(m.column, m.build()) for m in models]
        for b in batches:
            errors = list(b["error"]) if had else [None] * len(b)
            for column, model in built:
                b[column] = pd.Series(values_of(model, b, errors), index=b.index, dtype=object)
            done = b[[*kept, *added]].copy()
            done["error"] = pd.Series(errors, index=b.index, dtype=object)
            yield done

    return frames.mapInPandas(run, ", ".join([*fields, "error string"]))


def with_model(frames: DataFrame, build: Callable[[], Callable[[pd.DataFrame], list]], out: str, out_type: str, batch: int | None = None) -> DataFrame:
    """with_models of one model."""
    return with_models(frames, [Model(out, out_type, build)], batch)


#: What each kind of weights of a profile gives.
KINDS = {
    "court": ("keypoints", "array<struct<x:double,y:double,v:int>>"),
    "detector": ("players", f"array<{schemas.DETECTION}>"),
    "ball": ("balls", f"array<{schemas.DETECTION}>"),
}


def models_of(weights: Mapping[str, str | None], builders: Mapping[str, Callable[[str, str | None], Callable[[pd.DataFrame], list]]], device: str | None = None) -> list[Model]:
    """The models of a profile's weights (court, detector, ball): builders[kind](weights, device) runs once a worker. A kind without weights has no model, and its column stays null."""
    for kind in weights:
        if kind not in KINDS:
            raise KeyError(f"unknown weights {kind}; choose from {sorted(KINDS)}")
    return [Model(*KINDS[kind], partial(builders[kind], weights[kind], device)) for kind in KINDS if weights.get(kind) is not None]


class IncompatibleModel(ValueError):
    pass


def check_model_points(shape: tuple[int, ...] | None, expected: int) -> None:
    """A model may prefill labels only if it was trained on as many keypoints as the schema has."""
    if not shape or int(shape[0]) != expected:
        raise IncompatibleModel(f"the model has keypoint shape {shape}, the schema {expected} keypoints")
