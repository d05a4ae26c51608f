"""Element totals of species, ratios against solar ones, and the report on them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trajspark.functions.names import C_TO_O, METALLICITY, SOLAR, canonical_name, formula, scale_of
from trajspark.functions.scalars import NAN, is_finite, safe_divide, safe_log10, safe_pow10, safe_ratio


def element_composition(species: DataFrame, column: str = "species") -> DataFrame:
    """One row a species and element with its count; a species that is no formula has one row without element."""
    return species.select(column, F.explode_outer(formula(F.col(column))).alias("element", "n_atoms"))


def solar_table(spark) -> DataFrame:
    return spark.createDataFrame(list(SOLAR.items()), "element string, log_eps double")


def solar_references(composition: DataFrame) -> DataFrame:
    """Solar C/O, solar metals over hydrogen for the distinct metals present, and metals without a solar value."""
    spark = composition.sparkSession
    metals = composition.select("element").where("element is not null and element not in ('H', 'He')").distinct()
    solar = solar_table(spark).withColumn("ratio", F.pow(F.lit(10.0), F.col("log_eps") - 12.0))
    found = metals.join(F.broadcast(solar), "element", "left")
    c_to_o = F.lit(10.0 ** (SOLAR["C"] - 12.0) / 10.0 ** (SOLAR["O"] - 12.0))
    return found.agg(
        F.sum("ratio").alias("m_to_h"), F.array_sort(F.collect_set("element")).alias("elements"), F.array_sort(F.collect_set(F.when(F.col("ratio").isNull(), F.col("element")))).alias("missing")
    ).select(c_to_o.alias("c_to_o"), "m_to_h", "elements", "missing")


def coefficients(spark, species: Sequence[str]) -> dict[str, list[float]]:
    """For C, O, H and metals, each species' number of atoms; a missing kind or solar value is an error."""
    rows = element_composition(spark.createDataFrame([(s,) for s in species], "species string")).collect()  # a few a species
    out = {k: [0.0] * len(species) for k in ("C", "O", "H", "metal")}
    for r in rows:
        if r["element"] is None:
            continue
        k = list(species).index(r["species"])
        if r["element"] in ("C", "O", "H"):
            out[r["element"]][k] += r["n_atoms"]
        if r["element"] not in ("H", "He"):
            out["metal"][k] += r["n_atoms"]
            if r["element"] not in SOLAR:
                raise ValueError(f"no solar abundance of {r['element']}")
    for e in ("C", "O", "H"):
        if not any(out[e]):
            raise ValueError(f"no species has {e}")
    return out


def _dot(values: Column, atoms: list[float]) -> Column:
    return sum((F.get(values, F.lit(k)) * F.lit(a) for k, a in enumerate(atoms) if a), F.lit(0.0))


def element_ratios(values: Column, atoms: dict[str, list[float]]) -> tuple[Column, Column]:
    """C/O and metals over hydrogen of an array of abundances; NaN where they make no sense."""
    total = {k: _dot(values, a) for k, a in atoms.items()}
    return safe_ratio(total["C"], total["O"]), safe_ratio(total["metal"], total["H"])


def find_alias(names: DataFrame, aliases: Sequence[str], name_col: str = "name", position_col: str = "position") -> DataFrame:
    """The first name whose canonical form is one of the aliases; null without any."""
    hit = names.where(canonical_name(F.col(name_col)).isin(list(aliases)))
    return hit.agg(F.min_by(name_col, position_col).alias("name"))


def finite_stats(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Per column: rows, finite ones and their share, mean, standard deviation, min and max; null without any."""
    long = df.select(*[F.col(c).cast("double").alias(c) for c in columns]).unpivot([], list(columns), "quantity", "value")
    x = F.when(is_finite(F.col("value")), F.col("value"))
    return long.groupBy("quantity").agg(
        F.count(F.lit(1)).alias("n_total"),
        F.count(x).alias("n_valid"),
        (F.count(F.lit(1)) - F.count(x)).alias("n_invalid"),
        (F.count(x) / F.count(F.lit(1))).alias("valid_fraction"),
        F.avg(x).alias("mean"),
        F.stddev_pop(x).alias("std"),
        F.min(x).alias("min"),
        F.max(x).alias("max"),
    )


def chemistry_quantities(scored: DataFrame, atoms: dict[str, list[float]], c_to_o_sun: float, m_to_h_sun: float, metallicity: tuple[Column, str] | None = None, c_to_o: tuple[Column, str] | None = None, rel_eps: float = 1e-30) -> DataFrame:
    """One row a pair with all derived quantities of truth, prediction, their errors and the globals.

    The globals are given as (column, scale) with the scale of ``scale_of``.
    """
    out: dict[str, Column] = {}
    for side, values in (("true", F.col("y_j")), ("pred", F.col("y_pred"))):
        co, mh = element_ratios(values, atoms)
        out[f"{side}_co_solar"], out[f"{side}_mh_solar"] = safe_divide(co, c_to_o_sun), safe_divide(mh, m_to_h_sun)
    rows = scored.withColumns(out)
    more: dict[str, Column] = {}
    for side in ("true", "pred"):
        for q in ("co", "mh"):
            more[f"{side}_{q}_bracket"] = safe_log10(F.col(f"{side}_{q}_solar"))
    rows = rows.withColumns(more)
    errors: dict[str, Column] = {}
    for q in ("co", "mh"):
        gap = F.abs(F.col(f"pred_{q}_solar") - F.col(f"true_{q}_solar"))
        errors[f"{q}_solar_abs_err"] = gap
        errors[f"{q}_bracket_abs_err"] = F.abs(F.col(f"pred_{q}_bracket") - F.col(f"true_{q}_bracket"))
        errors[f"{q}_solar_rel_err"] = gap / (F.abs(f"true_{q}_solar") + F.lit(rel_eps))
    if metallicity is not None:
        x, scale = metallicity
        solar = safe_pow10(x) if scale == "log10_dex_like" else safe_divide(x, m_to_h_sun)
        errors |= {"global_mh_raw": x, "global_mh_solar": solar, "global_mh_bracket": x if scale == "log10_dex_like" else safe_log10(solar)}
    if c_to_o is not None:
        x, scale = c_to_o
        solar = safe_divide(safe_pow10(x) if scale == "log10_ratio" else x, c_to_o_sun)
        errors |= {"global_co_raw": x, "global_co_solar": solar, "global_co_bracket": safe_log10(solar)}
    keep = [*out, *more, *errors]
    return rows.withColumns(errors).select("y_j", "y_pred", *keep)


def chemistry_report(quantities: DataFrame) -> DataFrame:
    """``finite_stats`` of every quantity, and of the log10 error of all species' values."""
    columns = [c for c in quantities.columns if c not in ("y_j", "y_pred")]
    pair = F.explode(F.arrays_zip("y_j", "y_pred")).alias("p")
    t, p = F.col("p.y_j"), F.col("p.y_pred")
    ok = is_finite(t) & is_finite(p) & (t > 0) & (p > 0)
    species = quantities.select(pair).select(F.when(ok, F.abs(F.log10(p) - F.log10(t))).otherwise(F.lit(NAN)).alias("species_log10_abs_err"))
    return finite_stats(quantities, columns).union(finite_stats(species, ["species_log10_abs_err"]))


def global_scales(names: DataFrame, name_col: str = "name") -> DataFrame:
    """What each global's name speaks of: whether it is a metallicity or a C/O, and on which scale."""
    c = canonical_name(F.col(name_col))
    return names.select(
        name_col, c.alias("canonical"), c.isin(METALLICITY).alias("is_metallicity"), scale_of(F.col(name_col), "metallicity").alias("metallicity_scale"), c.isin(C_TO_O).alias("is_c_to_o"), scale_of(F.col(name_col), "c_to_o").alias("c_to_o_scale")
    )
