"""Names of species and of global quantities."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Canonical names of metallicity and of the carbon to oxygen ratio, and those on a log scale.
METALLICITY = ["metallicity", "logmetallicity", "log10metallicity", "metallicitydex", "mh", "logmh", "moverh", "zmetal"]
METALLICITY_LOG = ["logmetallicity", "log10metallicity", "metallicitydex", "mh", "logmh", "moverh"]
C_TO_O = ["co", "logco", "log10co", "coratio", "logcoratio", "cratio", "carbonoxygen", "carbonoxygenratio", "cto", "ctoratio", "logcto", "log10cto", "logctoratio", "log10coratio"]
C_TO_O_LOG = ["logco", "log10co", "logcoratio", "log10coratio", "logcto", "log10cto", "logctoratio"]
#: Solar photospheric abundances, 12 + log10 of the number relative to hydrogen (Asplund et al. 2009).
SOLAR = {
    "H": 12.00, "He": 10.93, "C": 8.43, "N": 7.83, "O": 8.69, "Na": 6.24, "Mg": 7.60, "Al": 6.45, "Si": 7.51, "P": 5.41,
    "S": 7.12, "Cl": 5.50, "K": 5.03, "Ca": 6.34, "Ti": 4.95, "Cr": 5.64, "Mn": 5.43, "Fe": 7.50, "Ni": 6.22,
}


def label(name: Column) -> Column:
    """A species' name without the ending of its variable."""
    return F.regexp_replace(name, "_evolution$", "")


def canonical_name(name: Column) -> Column:
    return F.regexp_replace(F.lower(name), "[^a-z0-9]+", "")


def scale_of(name: Column, quantity: str) -> Column:
    """Which scale a global's name speaks of; ``unknown`` without a name."""
    c = canonical_name(name)
    if quantity == "metallicity":
        return F.when(name.isNull(), "unknown").when(c.isin(METALLICITY_LOG) | c.startswith("log"), "log10_dex_like").otherwise("linear_ratio_like")
    if quantity == "c_to_o":
        return F.when(name.isNull(), "unknown").when(c.isin(C_TO_O_LOG) | c.startswith("log"), "log10_ratio").otherwise("linear_ratio")
    return F.lit("unknown")


def formula(name: Column) -> Column:
    """Elements and their counts of a species' name, as a map; null where it is no formula.

    The text before the first underscore counts, without spaces, charges and parentheses. A name with a count of
    more than 15 digits is no formula.
    """
    text = F.regexp_replace(F.substring_index(name, "_", 1), r"[ +\-()]", "")
    tokens = F.regexp_extract_all(text, F.lit("([A-Z][a-z]?[0-9]*)"), F.lit(1))
    pairs = F.transform(
        tokens,
        lambda t: F.struct(
            F.regexp_extract(t, "^([A-Z][a-z]?)", 1).alias("e"),
            F.coalesce(F.nullif(F.regexp_extract(t, "([0-9]+)$", 1), F.lit("")), F.lit("1")).alias("n"),
        ),
    )
    pairs = F.transform(pairs, lambda p: F.struct(p["e"].alias("e"), F.when(F.length(p["n"]) <= 15, p["n"]).try_cast("bigint").alias("n")))
    elements = F.array_distinct(F.transform(pairs, lambda p: p["e"]))
    totals = F.transform(
        elements, lambda e: F.aggregate(pairs, F.lit(0).cast("bigint"), lambda acc, p: acc + F.when(p["e"] == e, p["n"]).otherwise(F.lit(0).cast("bigint")))
    )
    ok = text.rlike("^([A-Z][a-z]?[0-9]*)+$") & F.forall(pairs, lambda p: F.coalesce(p["n"] > 0, F.lit(False)))
    return F.when(ok, F.map_from_arrays(elements, totals))
