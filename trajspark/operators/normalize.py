"""Values in normalized space and back, with a collected manifest (a few numbers a variable)."""

from __future__ import annotations

import json
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trajspark.functions.scalars import is_finite, strict_log10
from trajspark.functions.transforms import denormalize_value, log10_to_z, normalize_value, z_to_log10
from trajspark.spec import TrajectorySpec


@dataclass
class Manifest:
    methods: dict[str, str]
    stats: dict[str, dict[str, float]]
    dt: dict[str, float] = field(default_factory=dict)
    meta: dict = field(default_factory=dict)

    @classmethod
    def collect(cls, manifest: DataFrame, dt: DataFrame | None = None, meta: dict | None = None) -> Manifest:
        out = cls({}, {}, meta=meta or {})
        for r in manifest.collect():  # some rows a variable
            out.methods[r["key"]] = r["method"]
            out.stats.setdefault(r["key"], {})[r["stat"]] = r["value"]
        if dt is not None:
            out.dt = dt.first().asDict()
        return out

    def to_json(self, spec: TrajectorySpec) -> str:
        body = {
            "per_key_stats": {k: self.stats[k] for k in spec.keys if k in self.stats},
            "normalization_methods": {k: spec.method(k) for k in spec.keys},
            "epsilon": spec.epsilon,
            "min_std": spec.min_std,
            "dt": {"method": spec.dt_method, **self.dt},
            "meta": self.meta,
        }
        return json.dumps(body, indent=2)

    @classmethod
    def from_json(cls, text: str) -> Manifest:
        body = json.loads(text)
        dt = {k: v for k, v in body["dt"].items() if k != "method"}
        return cls(body["normalization_methods"], body["per_key_stats"], dt, body.get("meta", {}))

    def normalize(self, x: Column, key: str) -> Column:
        return normalize_value(x, key, self.methods[key], self.stats[key])

    def denormalize(self, z: Column, key: str) -> Column:
        return denormalize_value(z, key, self.methods[key], self.stats[key])

    def z_to_log10(self, z: Column, key: str) -> Column:
        return z_to_log10(z, key, self.methods[key], self.stats[key])

    def log10_to_z(self, x: Column, key: str) -> Column:
        return log10_to_z(x, key, self.methods[key], self.stats[key])

    def normalize_dt(self, dt: Column) -> Column:
        low, high = self.dt["log_min"], self.dt["log_max"]
        return (strict_log10(dt, "time gap") - F.lit(low)) / F.lit(high - low)

    def denormalize_dt(self, z: Column) -> Column:
        low, high = self.dt["log_min"], self.dt["log_max"]
        inside = F.when(is_finite(z) & (z >= 0) & (z <= 1), z).otherwise(F.raise_error(F.lit("a normalized gap is outside [0, 1]")).cast("double"))
        return F.pow(F.lit(10.0), F.lit(low) + inside * F.lit(high - low))


def normalized(traj: DataFrame, spec: TrajectorySpec, manifest: Manifest) -> DataFrame:
    """Packed trajectories with normalized species and globals; row-local."""

    def of(key: str):
        return F.transform(key, lambda x: manifest.normalize(x, key))

    arrays = {s: of(s) for s in spec.species}
    return traj.withColumns(arrays | {g: manifest.normalize(F.col(g), g) for g in spec.globals})


def denormalized(traj: DataFrame, spec: TrajectorySpec, manifest: Manifest) -> DataFrame:
    def of(key: str):
        return F.transform(key, lambda z: manifest.denormalize(z, key))

    arrays = {s: of(s) for s in spec.species}
    return traj.withColumns(arrays | {g: manifest.denormalize(F.col(g), g) for g in spec.globals})


def quantized(traj: DataFrame, value_type: str, time_type: str, spec: TrajectorySpec) -> DataFrame:
    """Arrays as they are stored."""
    return traj.withColumns({s: F.col(s).cast(f"array<{value_type}>") for s in spec.species} | {spec.time: F.col(spec.time).cast(f"array<{time_type}>")})
