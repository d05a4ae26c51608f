"""Batch scoring of pairs with a one-step model, and forward passes of two small network families."""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trajspark.functions.hashing import unit_hash
from trajspark.operators.normalize import Manifest
from trajspark.spec import TrajectorySpec

CHUNK = 4096
Predict = Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray]


def score(pairs: DataFrame, predict: Predict, chunk: int = CHUNK) -> DataFrame:
    """``pairs`` with ``y_pred``: ``predict(y [B, S], dt [B], g [B, G]) -> [B, S]`` in physical units.

    Rows are scored where they are, in chunks of at most ``chunk``; the function travels with the tasks.
    """
    import pyarrow as pa
    from pyspark.sql import types as T

    schema = T.StructType([*pairs.schema.fields, T.StructField("y_pred", T.ArrayType(T.DoubleType()))])

    def matrix(column) -> np.ndarray:
        return column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(column), -1)

    def run(batches):
        for batch in batches:
            for k in range(0, batch.num_rows, chunk):
                part = batch.slice(k, chunk)
                y, g = (matrix(part.column(part.schema.get_field_index(c))) for c in ("y_i", "g"))
                out = np.asarray(predict(y, part.column(part.schema.get_field_index("dt")).to_numpy(zero_copy_only=False).astype(float), g), float)
                if out.shape != y.shape:
                    raise ValueError(f"the model returned {out.shape} for {y.shape}")
                made = pa.ListArray.from_arrays(pa.array(np.arange(len(out) + 1, dtype=np.int32) * out.shape[1]), pa.array(out.ravel()))
                yield pa.RecordBatch.from_arrays([*part.columns, made], [*part.schema.names, "y_pred"])

    return pairs.mapInArrow(run, schema)


def persistence(y: np.ndarray, dt: np.ndarray, g: np.ndarray) -> np.ndarray:
    """Nothing changes."""
    return y


ACTIVATIONS: dict[str, Callable[[np.ndarray], np.ndarray]] = {
    "relu": lambda x: np.maximum(x, 0),
    "tanh": np.tanh,
    "silu": lambda x: x / (1 + np.exp(-x)),
    "gelu": lambda x: 0.5 * x * (1 + np.tanh(np.sqrt(2 / np.pi) * (x + 0.044715 * x**3))),
    "elu": lambda x: np.where(x > 0, x, np.expm1(np.minimum(x, 0))),
    "leaky_relu": lambda x: np.where(x > 0, x, 0.01 * x),
}


@dataclass
class Dense:
    """Linear layers with an activation between them; with ``skips`` each hidden layer adds its input."""

    weights: list[np.ndarray]
    biases: list[np.ndarray]
    activation: str = "silu"
    skips: list[np.ndarray | None] | None = None

    def __call__(self, x: np.ndarray) -> np.ndarray:
        f = ACTIVATIONS[self.activation]
        for k, (w, b) in enumerate(zip(self.weights[:-1], self.biases[:-1], strict=True)):
            h = f(x @ w.T + b)
            if self.skips is not None:
                p = self.skips[k]
                h = h + (x if p is None else x @ p.T)
            x = h
        return x @ self.weights[-1].T + self.biases[-1]


@dataclass
class NormalizedModel:
    """A network on normalized values as a function of physical ones.

    ``direct``: one network on ``[y, dt, g]``. With ``encoder`` and ``decoder`` the step is made in latent
    space on ``[z, dt, g]``. ``residual`` adds the input state (or latent state) to the step.
    """

    manifest: Manifest
    spec: TrajectorySpec
    step: Dense
    encoder: Dense | None = None
    decoder: Dense | None = None
    residual: bool = False

    def _affine(self, key: str) -> tuple[bool, float, float]:
        from trajspark.functions.transforms import checked

        method = self.manifest.methods[key]
        return method.startswith("log-"), *checked(key, method, self.manifest.stats[key])

    def _normalize(self, x: np.ndarray, keys: tuple[str, ...]) -> np.ndarray:
        out = np.empty_like(x)
        for k, key in enumerate(keys):
            log, offset, scale = self._affine(key)
            if log and not (np.isfinite(x[:, k]) & (x[:, k] > 0)).all():
                raise ValueError(f"{key}: values that are not finite and positive")
            out[:, k] = ((np.log10(x[:, k]) if log else x[:, k]) - offset) / scale
        return out

    def __call__(self, y: np.ndarray, dt: np.ndarray, g: np.ndarray) -> np.ndarray:
        low, high = self.manifest.dt["log_min"], self.manifest.dt["log_max"]
        d = (np.log10(dt) - low) / (high - low)
        if not ((d >= -1e-12) & (d <= 1 + 1e-12)).all():
            raise ValueError("a time gap is outside the trained range")
        z, rest = self._normalize(y, self.spec.species), np.c_[d, self._normalize(g, self.spec.globals)]
        state = self.encoder(z) if self.encoder else z
        step = self.step(np.c_[state, rest])
        state = state + step if self.residual else step
        out = self.decoder(state) if self.decoder else state
        for k, key in enumerate(self.spec.species):
            log, offset, scale = self._affine(key)
            out[:, k] = out[:, k] * scale + offset
            out[:, k] = 10.0 ** out[:, k] if log else out[:, k]
        return out


def probe_inputs(spark, n: int, spec: TrajectorySpec, typical: dict[str, float], dt_range: tuple[float, float], seed: int = 1, floor: float = 1e-35) -> DataFrame:
    """Inputs near typical values, with time gaps spread evenly in log space. All draws are hashes of the row's
    number and the variable: normal ones by the polar form of two even ones."""

    def even(key: str, which: str):
        return unit_hash(seed, F.concat_ws(":", F.col("id").cast("string"), F.lit(key), F.lit(which)))

    def near(key: str):
        normal = F.sqrt(-2 * F.log(1 - even(key, "radius"))) * F.cos(2 * F.lit(math.pi) * even(key, "angle"))
        return F.greatest(F.lit(floor), F.lit(typical[key]) * (1 + 0.01 * normal))

    low, high = (float(np.log10(x)) for x in dt_range)
    y = F.array(*[near(s) for s in spec.species])
    g = F.array(*[near(s) for s in spec.globals]).cast("array<double>")
    dt = F.pow(F.lit(10.0), F.lit(low) + even("dt", "even") * F.lit(high - low))
    return spark.range(n).select("id", y.alias("y_i"), dt.alias("dt"), g.alias("g"))
