"""What a set of trajectories consists of, and how it is prepared. Wrong settings are errors at once."""

from __future__ import annotations

from dataclasses import dataclass, field, fields

from pyspark.sql import types as T

METHODS = ("standard", "min-max", "log-standard", "log-min-max")
DTYPES = {"float32": "float", "fp32": "float", "float64": "double", "fp64": "double"}


@dataclass(frozen=True)
class TrajectorySpec:
    """Names in their order, methods by name, and the settings of filters, split, steps and storage."""

    species: tuple[str, ...]
    globals: tuple[str, ...] = ()
    time: str = "time"
    default_method: str = "log-standard"
    methods: dict[str, str] = field(default_factory=dict)
    seed: int = 42
    val_fraction: float = 0.1
    test_fraction: float = 0.1
    use_fraction: float = 1.0
    min_value_threshold: float = 1e-30
    skip_first_step: bool = False
    min_steps: int = 1
    max_steps: int | None = None
    min_std: float = 1e-10
    epsilon: float = 1e-30
    value_dtype: str = "float32"
    time_dtype: str = "float64"
    dt_method: str = "log-min-max"
    trajectories_per_shard: int = 65536

    def __post_init__(self) -> None:
        def check(ok: bool, what: str) -> None:
            if not ok:
                raise ValueError(what)

        check(bool(self.species), "at least one species is needed")
        names = [*self.species, *self.globals, self.time, "file_id", "group_id"]
        check(len({n.lower() for n in names}) == len(names), "names must differ, upper and lower case apart")
        check(self.val_fraction > 0 and self.test_fraction > 0, "validation and test fractions must be above 0")
        check(self.val_fraction + self.test_fraction < 1, "validation and test fractions must leave a training split")
        check(0 < self.use_fraction <= 1, "use_fraction must be above 0 and at most 1")
        check(self.min_steps >= 1, "min_steps must be at least 1")
        check(self.max_steps is None or self.max_steps >= self.min_steps, "max_steps must be at least min_steps")
        check(self.min_std > 0 and self.epsilon > 0, "min_std and epsilon must be above 0")
        check(self.trajectories_per_shard >= 1, "trajectories_per_shard must be at least 1")
        check(self.dt_method == "log-min-max", "time gaps are normalized by log-min-max only")
        check(self.value_dtype in DTYPES and self.time_dtype in DTYPES, f"dtypes are {', '.join(DTYPES)}")
        known = {*self.species, *self.globals, self.time}
        check(not (stray := sorted(set(self.methods) - known)), f"methods for unknown names: {stray}")
        wrong = sorted({m for m in (self.default_method, *self.methods.values()) if m not in METHODS})
        check(not wrong, f"unknown methods: {wrong}")

    @classmethod
    def from_settings(cls, settings: dict) -> TrajectorySpec:
        """From plain values, as JSON has them; settings that there are not, or not any more, are an error."""
        unknown = sorted(set(settings) - {f.name for f in fields(cls)})
        if unknown:
            raise ValueError(f"unknown settings: {unknown}")
        return cls(**{k: tuple(v) if isinstance(v, list) else v for k, v in settings.items()})

    @property
    def keys(self) -> list[str]:
        """Species, globals, time, each once."""
        return list(dict.fromkeys([*self.species, *self.globals, self.time]))

    def method(self, key: str) -> str:
        return self.methods.get(key, self.default_method)

    @property
    def schema(self) -> T.StructType:
        """Packed rows: one trajectory each."""
        array = T.ArrayType(T.DoubleType())
        return T.StructType(
            [
                T.StructField("file_id", T.StringType()),
                T.StructField("group_id", T.StringType()),
                T.StructField(self.time, array),
                *(T.StructField(s, array) for s in self.species),
                *(T.StructField(g, T.DoubleType()) for g in self.globals),
            ]
        )
