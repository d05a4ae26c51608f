"""SQL for DuckDB that gives the rows of the queries in ``registry``."""

from __future__ import annotations

import hashlib

ORACLES: dict[str, str] = {}
#: Fixed values, written out here once more so that a wrong entry of the library shows: names on each scale, and solar
#: abundances.
METALLICITY = ["metallicity", "logmetallicity", "log10metallicity", "metallicitydex", "mh", "logmh", "moverh", "zmetal"]
METALLICITY_LOG = ["logmetallicity", "log10metallicity", "metallicitydex", "mh", "logmh", "moverh"]
C_TO_O = ["co", "logco", "log10co", "coratio", "logcoratio", "cratio", "carbonoxygen", "carbonoxygenratio", "cto", "ctoratio", "logcto", "log10cto", "logctoratio", "log10coratio"]
C_TO_O_LOG = ["logco", "log10co", "logcoratio", "log10coratio", "logcto", "log10cto", "logctoratio"]
SOLAR = {
    "H": 12.00, "He": 10.93, "C": 8.43, "N": 7.83, "O": 8.69, "Na": 6.24, "Mg": 7.60, "Al": 6.45, "Si": 7.51, "P": 5.41,
    "S": 7.12, "Cl": 5.50, "K": 5.03, "Ca": 6.34, "Ti": 4.95, "Cr": 5.64, "Mn": 5.43, "Fe": 7.50, "Ni": 6.22,
}


def r(x: str, digits: int) -> str:
    """Rounded, without a negative zero."""
    return f"(round({x}, {digits}) + 0.0::DOUBLE)"


def u(text: str, seed: int = 42) -> str:
    return f"(('0x' || substr(sha256('{seed}:' || {text}), 1, 16))::UBIGINT::DOUBLE / 18446744073709551616.0::DOUBLE)"


def key_hash(purpose: str) -> str:
    return u(f"file_id || ':' || group_id || ':{purpose}'")


def split_of(purpose: str = "split") -> str:
    x = key_hash(purpose)
    return f"CASE WHEN {x} < 0.1 THEN 'test' WHEN {x} < 0.1::DOUBLE + 0.1::DOUBLE THEN 'validation' ELSE 'train' END"


def quoted(values: list[str]) -> str:
    return ", ".join(f"'{v}'" for v in values)


SPECIES = ["CH4_evolution", "CO_evolution", "H2O_evolution", "HCN_evolution"]
LABELS = [s.removesuffix("_evolution") for s in SPECIES]
S = range(4)

# v: trajectories; vs: their points; vk: those kept, with split; vt: points of those kept.
V = f"""
v AS (SELECT 'label_' || label AS file_id, vec_id::VARCHAR AS group_id, 1.0::DOUBLE + label AS p,
    300.0::DOUBLE + (vec_id * 37) % 2701 AS t, embedding AS e FROM embeddings),
vs AS (SELECT file_id, group_id, p, t, k::INTEGER AS step, CASE WHEN k = 0 THEN 0.0::DOUBLE ELSE pow(2.0::DOUBLE, k - 1) END AS time,
    {", ".join(f"abs(e[4 * k + {n + 1}]::DOUBLE) AS s{n}" for n in S)} FROM v, (SELECT unnest(range(16)) AS k)),
vk AS (SELECT v.file_id, v.group_id, v.p, v.t, {split_of().replace("file_id", "v.file_id").replace("group_id", "v.group_id")} AS split FROM v
    JOIN (SELECT file_id, group_id, min(least(s0, s1, s2, s3)) AS low FROM vs GROUP BY ALL) m ON v.file_id = m.file_id AND v.group_id = m.group_id WHERE low >= 0.001),
vt AS (SELECT vs.*, vk.split FROM vs JOIN vk ON vs.file_id = vk.file_id AND vs.group_id = vk.group_id)
"""
# mw: the manifest in one row; z(n, x): normalized; back(n, z): the inverse; logz(n, z): log10 of the physical value.
MW = f"""{V},
mw AS (SELECT avg(log10(s0)) AS a0, greatest(stddev_pop(log10(s0)), 1e-10) AS b0, min(s1) AS a1, max(s1) AS c1, min(log10(s2)) AS a2, max(log10(s2)) AS c2,
    avg(s3) AS a3, greatest(stddev_pop(s3), 1e-10) AS b3, min(log10(s0)) AS l0, max(log10(s0)) AS h0, min(log10(s1)) AS l1, max(log10(s1)) AS h1,
    min(log10(s2)) AS l2, max(log10(s2)) AS h2, min(log10(s3)) AS l3, max(log10(s3)) AS h3 FROM vt WHERE split = 'train'),
mg AS (SELECT min(log10(p)) AS pa, max(log10(p)) AS pc, avg(t) AS ta, greatest(stddev_pop(t), 1e-10) AS tb FROM vk WHERE split = 'train'),
md AS (SELECT log10(1.0::DOUBLE) AS lo, log10(16384.0::DOUBLE - 64.0::DOUBLE) AS hi)
"""


def z(n: int, x: str) -> str:
    return [f"((log10({x}) - a0) / b0)", f"(({x} - a1) / (c1 - a1))", f"((log10({x}) - a2) / (c2 - a2))", f"(({x} - a3) / b3)"][n]


def logz(n: int, x: str) -> str:
    return [f"({x} * b0 + a0)", f"log10({x} * (c1 - a1) + a1)", f"({x} * (c2 - a2) + a2)", f"log10({x} * b3 + a3)"][n]


def zlog(n: int, x: str) -> str:
    return [f"(({x} - a0) / b0)", f"((pow(10.0::DOUBLE, {x}) - a1) / (c1 - a1))", f"(({x} - a2) / (c2 - a2))", f"((pow(10.0::DOUBLE, {x}) - a3) / b3)"][n]


def by_species(rows: str, one, labels: list[str] | None = None) -> str:
    """A union over the species of ``one(n)``, a list of columns, from ``rows``."""
    return " UNION ALL ".join(f"SELECT '{(labels or SPECIES)[n]}' AS species, {one(n)} FROM {rows}" for n in S)


# Steps of 1 to 8 from the 8 anchors.
PAIRS = f"""
pr AS (SELECT a.file_id, a.group_id, a.p, a.t, a.split, a.step AS i, b.step AS j, b.time - a.time AS dt, {", ".join(f"a.s{n} AS i{n}, b.s{n} AS j{n}" for n in S)}
    FROM vt a JOIN vt b ON a.file_id = b.file_id AND a.group_id = b.group_id AND b.step BETWEEN a.step + 1 AND a.step + 8 WHERE a.step <= 7)
"""
R = f"""{MW}, {PAIRS},
r0 AS (SELECT pr.*, (log10(dt) - lo) / (hi - lo) AS d FROM pr, md WHERE split = 'test'),
r AS (SELECT *, {", ".join(f"i{n} * (1 + 0.1::DOUBLE * d) AS q{n}" for n in S)} FROM r0),
pts AS ({by_species("r", lambda n: f"file_id, group_id, i, j, j{n} AS y, q{n} AS q", LABELS)})
"""

# o: trajectories with their defects; oc: classified.
O = """
lines AS (SELECT l_orderkey AS k, l_linenumber::DOUBLE AS t, l_quantity, l_extendedprice, l_discount, l_tax,
    row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_shipdate, l_extendedprice) AS n,
    l_linenumber::DOUBLE - lag(l_linenumber::DOUBLE) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_shipdate, l_extendedprice) AS dt FROM lineitem),
agg AS (SELECT k, count(*) AS n, min(dt) AS min_dt, max(dt) AS max_dt, min(least(l_quantity, l_extendedprice, l_discount, l_tax)) AS low, min(t) AS first_t,
    max_by(l_quantity, lines.n) AS last_quantity, sum(l_extendedprice) AS total_price, string_agg(t::INTEGER::VARCHAR, ',' ORDER BY lines.n) AS grid FROM lines GROUP BY k),
o AS (SELECT o_orderpriority AS file_id, o_orderkey::VARCHAR AS group_id, o_orderkey, o_totalprice, c_acctbal FROM orders JOIN customer ON o_custkey = c_custkey),
oc AS (SELECT o.*, agg.*, CASE WHEN k IS NULL THEN 'missing_time' WHEN n < 2 THEN 'nan_time' WHEN min_dt <= 0 THEN 'nonpositive_dt'
        WHEN low IS NULL THEN 'missing_species' WHEN o_totalprice IS NULL OR c_acctbal IS NULL THEN 'missing_globals' ELSE 'valid' END AS reason
    FROM o LEFT JOIN agg ON o_orderkey = k)
"""
O4 = f"""{O},
o4p AS (SELECT k, min(least(l_quantity, l_extendedprice, l_discount, l_tax)) FILTER (n - 1 IN (0, (m - 1) // 3, 2 * (m - 1) // 3, m - 1)) AS low4
    FROM (SELECT *, count(*) OVER (PARTITION BY k) AS m FROM lines) GROUP BY k),
o4 AS (SELECT oc.*, CASE WHEN {key_hash("use")} >= 0.8 THEN 'unused' WHEN low4 < 0.001 THEN 'below' ELSE 'kept' END AS fate FROM oc JOIN o4p ON oc.k = o4p.k),
o4k AS (SELECT file_id, group_id, {split_of()} AS split FROM o4 WHERE fate = 'kept'),
o4n AS (SELECT *, (row_number() OVER (PARTITION BY split ORDER BY {key_hash("order")}, file_id, group_id) - 1) // 100 AS shard FROM o4k)
"""
SCAN = """count(*) AS n_total, count(*) FILTER (reason = 'missing_time') AS n_missing_time, count(*) FILTER (reason = 'nan_time') AS n_nan_time,
    count(*) FILTER (reason = 'nonpositive_dt') AS n_nonpositive_dt, count(*) FILTER (reason = 'missing_species') AS n_missing_species, count(*) FILTER (reason = 'missing_globals') AS n_missing_globals, count(*) FILTER (reason = 'valid') AS n_valid,
    min(CASE WHEN reason = 'valid' THEN min_dt END) AS min_forward_dt, max(CASE WHEN reason = 'valid' THEN max_dt END) AS max_forward_dt"""

_STATS = {
    ("CH4_evolution", "log-standard"): {"log_mean": "avg(log10(s0))", "log_std": "stddev_pop(log10(s0))", "log_min": "min(log10(s0))", "log_max": "max(log10(s0))"},
    ("CO_evolution", "min-max"): {"min": "min(s1)", "max": "max(s1)"},
    ("H2O_evolution", "log-min-max"): {"log_mean": "avg(log10(s2))", "log_std": "stddev_pop(log10(s2))", "log_min": "min(log10(s2))", "log_max": "max(log10(s2))"},
    ("HCN_evolution", "standard"): {"mean": "avg(s3)", "std": "stddev_pop(s3)"},
    ("P", "log-min-max"): {"log_mean": "avg(log10(p))", "log_std": "stddev_pop(log10(p))", "log_min": "min(log10(p))", "log_max": "max(log10(p))"},
    ("T", "standard"): {"mean": "avg(t)", "std": "stddev_pop(t)"},
    ("time", "min-max"): {"min": "min(time)", "max": "max(time)"},
}
ORACLES["norm_manifest"] = f"WITH {V} " + " UNION ALL ".join(
    f"SELECT '{key}' AS key, '{method}' AS method, '{stat}' AS stat, {r(x, 9)} AS value FROM {'vk' if key in 'PT' else 'vt'} WHERE split = 'train'"
    for (key, method), found in _STATS.items()
    for stat, x in found.items()
)
ORACLES["scan_report"] = f"WITH {O} SELECT file_id, {SCAN} FROM oc GROUP BY file_id"
ORACLES["scan_overall"] = f"WITH {O} SELECT file_id, {SCAN} FROM oc GROUP BY file_id UNION ALL SELECT NULL, {SCAN} FROM oc"
ORACLES["scan_skip_first"] = f"""WITH {O},
late AS (SELECT k AS k2, count(*) AS n2, min(CASE WHEN lines.n > 2 THEN dt END) AS lo2, max(CASE WHEN lines.n > 2 THEN dt END) AS hi2 FROM lines WHERE n > 1 GROUP BY k),
os AS (SELECT o.file_id, lo2 AS min_dt, hi2 AS max_dt, CASE WHEN k IS NULL THEN 'missing_time' WHEN coalesce(n2, 0) < 2 THEN 'nan_time' WHEN lo2 <= 0 THEN 'nonpositive_dt' ELSE 'valid' END AS reason
    FROM o LEFT JOIN agg ON o_orderkey = k LEFT JOIN late ON o_orderkey = k2)
SELECT file_id, {SCAN} FROM os GROUP BY file_id"""
ORACLES["packed_points"] = f"WITH {O} SELECT file_id, group_id, n, first_t, last_quantity, {r('total_price', 2)} AS total_price FROM oc WHERE k IS NOT NULL"
ORACLES["forward_dt"] = f"""WITH e AS (SELECT user_id::VARCHAR AS group_id, epoch_us(ts) / 1e6::DOUBLE AS t FROM events),
d AS (SELECT group_id, lead(t) OVER (PARTITION BY group_id ORDER BY t) - t AS dt FROM e)
SELECT 'events' AS file_id, group_id, count(dt) AS n, {r('min(dt)', 3)} AS min_dt, {r('max(dt)', 3)} AS max_dt, {r('avg(dt)', 3)} AS mean_dt FROM d GROUP BY group_id"""
ORACLES["grid_census"] = f"WITH {O} SELECT grid, count(*) AS n FROM oc WHERE reason = 'valid' GROUP BY grid"
ORACLES["dt_spec"] = f"WITH {V}, g AS (SELECT DISTINCT step, time FROM vs), d AS (SELECT a.step AS i, b.step - a.step AS k, b.time - a.time AS dt FROM g a JOIN g b ON b.step > a.step) SELECT {r('log10(min(dt) FILTER (k = 1))', 10)} AS log_min, {r('log10(max(dt) FILTER (k = 8))', 10)} AS log_max, min(dt) FILTER (k = 1) AS k1_min, max(dt) FILTER (k = 1) AS k1_max FROM d"
ORACLES["dt_norm_table"] = f"WITH {MW}, {PAIRS} SELECT i, j, dt, count(*) AS n, {r('(log10(dt) - lo) / (hi - lo)', 10)} AS dt_norm, {r('dt', 6)} AS dt_back FROM pr, md GROUP BY i, j, dt, lo, hi"
ORACLES["dt_norm_range"] = f"WITH {MW}, {PAIRS} SELECT min((log10(dt) - lo) / (hi - lo)) AS min, max((log10(dt) - lo) / (hi - lo)) AS max, count(*) FILTER (NOT coalesce((log10(dt) - lo) / (hi - lo) BETWEEN 0 AND 1, false)) AS n_bad FROM pr, md"
ORACLES["split_assignment"] = f"""WITH {V}, h AS (SELECT *, sha256('42:' || group_id) AS d FROM vk)
SELECT file_id, group_id, split, {r(key_hash('split'), 12)} AS u, ('0x' || substr(d, 7, 2) || substr(d, 5, 2) || substr(d, 3, 2) || substr(d, 1, 2))::BIGINT AS seed FROM h"""
_THREE = "(SELECT unnest(['train', 'validation', 'test']) AS split)"
ORACLES["split_counts"] = f"WITH {V} SELECT s.split, count(vk.split) AS n FROM {_THREE} s LEFT JOIN vk ON s.split = vk.split GROUP BY s.split"
ORACLES["split_counts_orders"] = f"WITH {O4} SELECT s.split, count(o4k.split) AS n FROM {_THREE} s LEFT JOIN o4k ON s.split = o4k.split GROUP BY s.split"
# d: trajectories with defects; dc: classified; df: their fate.
D = f"""{V},
low AS (SELECT file_id, group_id, min(least(s0, s1, s2, s3)) AS low, min(CASE WHEN step < 15 THEN s0 END) AS low0, min(least(s1, s2, s3)) AS low123, bool_and(isfinite(s0) AND isfinite(s1) AND isfinite(s2) AND isfinite(s3)) AS fin FROM vs GROUP BY ALL),
d AS (SELECT v.file_id, v.group_id, v.group_id::BIGINT AS n, v.p, v.t, least(CASE WHEN n % 7 = 2 THEN low0 ELSE low END, low123) AS low,
    fin AND n % 11 <> 3 AND n % 13 <> 5 AS finite, n % 31 = 8 AS no_time, n % 29 = 6 AS nan_time, n % 37 = 2 AS equal_times, n % 17 = 7 AS no_species, n % 19 = 4 AS no_global, n % 23 = 9 AS inf_global
    FROM v JOIN low ON v.file_id = low.file_id AND v.group_id = low.group_id),
dc AS (SELECT *, CASE WHEN no_time THEN 'missing_time' WHEN nan_time THEN 'nan_time' WHEN equal_times THEN 'nonpositive_dt' WHEN no_species THEN 'missing_species' WHEN no_global THEN 'missing_globals' ELSE 'valid' END AS reason,
    1.0::DOUBLE AS min_dt, 8192.0::DOUBLE AS max_dt FROM d),
df AS (SELECT *, CASE WHEN reason <> 'valid' THEN NULL WHEN NOT finite THEN 'nonfinite' WHEN low < 0.001 THEN 'below_threshold' WHEN inf_global THEN 'nonfinite_global' ELSE 'kept' END AS fate FROM dc)
"""
SCAN_D = SCAN.replace("CASE WHEN reason = 'valid'", "CASE WHEN reason NOT IN ('missing_time', 'nan_time', 'nonpositive_dt')")
DROPS = """count(*) AS n_total, count(*) FILTER (fate = 'kept') AS n_valid, count(*) FILTER (fate IS NULL OR fate <> 'kept') AS n_dropped,
    count(*) FILTER (reason = 'nan_time' OR fate IN ('nonfinite', 'nonfinite_global')) AS n_nan, count(*) FILTER (fate = 'below_threshold') AS n_below_threshold, count(*) FILTER (fate = 'unused') AS n_unused"""
ORACLES["scan_defects"] = f"WITH {D} SELECT file_id, {SCAN_D} FROM dc GROUP BY file_id"
ORACLES["trajectories_read"] = f"""WITH {D}, tr AS (SELECT * REPLACE (CASE WHEN reason IN ('missing_globals', 'valid') AND (p >= 6 OR inf_global) THEN 'missing_species' ELSE reason END AS reason) FROM dc)
SELECT file_id, {SCAN_D} FROM tr GROUP BY file_id"""
ORACLES["drop_report"] = f"""WITH {V}, f AS (SELECT CASE WHEN NOT bool_and(isfinite(s0) AND isfinite(s1) AND isfinite(s2) AND isfinite(s3)) THEN 'nonfinite' WHEN min(least(s0, s1, s2, s3)) < 0.001 THEN 'below_threshold' ELSE 'kept' END AS fate,
    'valid' AS reason FROM vs GROUP BY file_id, group_id) SELECT {DROPS} FROM f"""
ORACLES["drop_report_defects"] = f"WITH {D} SELECT {DROPS} FROM df"
ORACLES["fates"] = f"WITH {D} SELECT fate, count(*) AS n FROM df WHERE reason = 'valid' GROUP BY fate"
ORACLES["length_report"] = f"""WITH {D} SELECT s.species, count(*) FILTER (d.n % 7 = 2 AND NOT no_time AND s.species = 'CH4_evolution') AS n_bad FROM d, (SELECT unnest([{quoted(SPECIES)}]) AS species) s GROUP BY s.species"""
ORACLES["log_time_report"] = f"""WITH {D}, x AS (SELECT count(*) AS n, count(*) FILTER (NOT no_time) AS k FROM d)
SELECT 'all' AS steps, n, k AS n_not_positive FROM x UNION ALL SELECT 'later', n, 0::BIGINT FROM x"""
ORACLES["drop_report_orders"] = f"""WITH {O}, f AS (SELECT *, CASE WHEN reason <> 'valid' THEN NULL WHEN {key_hash("use")} >= 0.8 THEN 'unused' WHEN low < 0.001 THEN 'below_threshold' ELSE 'kept' END AS fate FROM oc)
SELECT {DROPS} FROM f"""
ORACLES["size_estimate"] = f"WITH {V} SELECT count(*) AS n, 16::INTEGER AS t, 8 * 16 + count(*) * 16 * 4 * 4 AS bytes FROM vk"
ORACLES["shard_index"] = f"WITH {O4} SELECT split, shard, count(*) AS n_trajectories FROM o4n GROUP BY split, shard"
ORACLES["shard_members"] = f"WITH {O4} SELECT file_id, group_id, split, shard FROM o4n"
ORACLES["shard_files"] = f"WITH {O4} SELECT split, shard, format('shard_{{}}_{{:05d}}', split, shard) AS name, count(*) AS n_trajectories FROM o4n GROUP BY split, shard"
ORACLES["shards_read"] = f"""WITH {O4}, q AS (SELECT k, min_by(l_quantity, n)::FLOAT::DOUBLE AS first_quantity, max_by(l_quantity, n)::FLOAT::DOUBLE AS last_quantity FROM lines GROUP BY k)
SELECT file_id, group_id, split, shard, first_quantity, last_quantity FROM o4n JOIN q ON o4n.group_id = q.k::VARCHAR"""
ORACLES["write_policy"] = f"""WITH {V}, c AS (SELECT split, count(*) AS n FROM vk GROUP BY split)
SELECT 'first' AS step, split, n FROM c UNION ALL SELECT 'refused', split, n FROM c UNION ALL SELECT 'replaced', split, n FROM c WHERE split = 'test'"""
ORACLES["dense_shards"] = f"WITH {V} SELECT file_id, group_id, 16::BIGINT AS n_steps, {r('s2::FLOAT::DOUBLE', 7)} AS y_3_2, t::FLOAT::DOUBLE AS g_1 FROM vt WHERE step = 3"
ORACLES["quantization"] = f"WITH {V} SELECT count(DISTINCT file_id || ':' || group_id) AS n, {r('max(abs(s0 - s0::FLOAT::DOUBLE))', 9)} AS largest_gap FROM vt"
ORACLES["partial_stats_merge"] = f"WITH {V} " + " UNION ALL ".join(
    f"SELECT '{SPECIES[n]}' AS key, count(*) AS n, {r(f'avg(s{n})', 9)} AS mean, {r(f'var_pop(s{n}) * count(*)', 9)} AS m2, {r(f'min(s{n})', 9)} AS min, {r(f'max(s{n})', 9)} AS max, {r(f'stddev_pop(s{n})', 9)} AS std FROM vt WHERE split = 'train'"
    for n in S
)
ORACLES["positive_report"] = " UNION ALL ".join(f"SELECT '{c}' AS key, count(*) FILTER ({c} <= 0) AS n_bad FROM lineitem JOIN orders ON l_orderkey = o_orderkey" for c in ("l_quantity", "l_extendedprice", "l_discount", "l_tax"))

ORACLES["normalize_species"] = f"WITH {MW} " + by_species("vt, mw", lambda n: f"file_id, group_id, step, {r(z(n, f's{n}'), 8)} AS value")
ORACLES["denormalize_roundtrip"] = f"WITH {V}, n AS (SELECT count(*) AS n FROM vt) " + " UNION ALL ".join(f"SELECT '{k}' AS key, n AS n_close, n FROM n" for k in (*SPECIES, "P", "T"))
ORACLES["normalize_globals"] = f"WITH {MW} SELECT file_id, group_id, {r('(log10(p) - pa) / (pc - pa)', 8)} AS p_norm, {r('(t - ta) / tb', 8)} AS t_norm FROM vk, mg"
ORACLES["normalize_by_join"] = f"WITH {MW} " + by_species(
    "vt, mw GROUP BY step", lambda n: f"step, count(*) AS n, {r(f'avg({z(n, f's{n}')})', 8)} AS mean_z, {r(f'min({z(n, f's{n}')})', 8)} AS min_z, {r(f'max({z(n, f's{n}')})', 8)} AS max_z"
)
ORACLES["z_to_log10"] = f"WITH {MW} " + by_species("vt, mw", lambda n: f"count(*) AS n, {r(f'avg(log10(s{n}))', 8)} AS mean_log10, count(*) AS n_inverse")
ORACLES["head_residual_log"] = f"WITH {R}, x AS (SELECT * FROM r, mw), y AS ({by_species('x', lambda n: zlog(n, f'(log10(j{n}) + 0.05::DOUBLE)') + ' AS z')}) SELECT species, {r('avg(z)', 8)} AS mean_z, {r('min(z)', 8)} AS min_z, {r('max(z)', 8)} AS max_z FROM y GROUP BY species"
ORACLES["head_residual"] = f"WITH {R}, x AS (SELECT * FROM r, mw) " + " UNION ALL ".join(f"SELECT {n}::INTEGER AS k, {r(f'avg({z(n, f'j{n}')} + 0.1::DOUBLE * {z(n, f'q{n}')})', 8)} AS mean_z, count(*) AS n FROM x" for n in S)
_SOFT = f"x AS (SELECT {', '.join(f'exp({z(n, f'q{n}')}) AS e{n}' for n in S)} FROM r, mw)"
ORACLES["head_simplex"] = f"WITH {R}, {_SOFT} " + " UNION ALL ".join(f"SELECT {n}::INTEGER AS k, {r(f'avg(log10(e{n} / (e0 + e1 + e2 + e3)))', 8)} AS mean_log10, {r(f'avg(e{n} / (e0 + e1 + e2 + e3))', 8)} AS mean_share FROM x" for n in S)
_W = f"w AS (SELECT {', '.join(f'sqrt(h{n} - l{n}) AS w{n}' for n in S)} FROM mw)"
ORACLES["species_weights"] = f"WITH {MW}, {_W} " + " UNION ALL ".join(f"SELECT '{SPECIES[n]}' AS key, {r(f'w{n} / ((w0 + w1 + w2 + w3) / 4)', 9)} AS weight FROM w" for n in S)
ORACLES["representative_values"] = f"""WITH {MW}, g AS (SELECT min(time) AS a, max(time) AS c FROM vs)
SELECT 'CH4_evolution' AS key, 'log-standard' AS method, {r('pow(10.0::DOUBLE, a0)', 8)} AS value FROM mw
UNION ALL SELECT 'CO_evolution', 'min-max', {r('0.5::DOUBLE * (a1 + c1)', 8)} FROM mw UNION ALL SELECT 'H2O_evolution', 'log-min-max', {r('pow(10.0::DOUBLE, 0.5::DOUBLE * (a2 + c2))', 8)} FROM mw
UNION ALL SELECT 'HCN_evolution', 'standard', {r('a3', 8)} FROM mw UNION ALL SELECT 'P', 'log-min-max', {r('pow(10.0::DOUBLE, 0.5::DOUBLE * (pa + pc))', 8)} FROM mg
UNION ALL SELECT 'T', 'standard', {r('ta', 8)} FROM mg UNION ALL SELECT 'time', 'min-max', {r('0.5::DOUBLE * (a + c)', 8)} FROM g"""
ORACLES["pairs_all"] = f"WITH {V}, {PAIRS} SELECT file_id, group_id, i, j, dt, {r('i0', 8)} AS ch4_i, {r('j3', 8)} AS hcn_j, p FROM pr"
_DRAW = u("file_id || ':' || group_id || ':3:' || draw || ':anchor'")
_TARGET = u("file_id || ':' || group_id || ':3:' || draw || ':' || target")
ORACLES["pairs_sampled"] = f"""WITH {V}, dr AS (SELECT vk.file_id, vk.group_id, draw, target, least(7, floor({_DRAW} * 8)::INTEGER) AS i, least(8, 1 + floor({_TARGET} * 8)::INTEGER) AS off
    FROM vk, (SELECT unnest(range(4))::INTEGER AS draw), (SELECT unnest(range(2))::INTEGER AS target))
SELECT dr.file_id, dr.group_id, draw, target, i, i + off AS j, b.time - a.time AS dt, {r('b.s1', 8)} AS co_j FROM dr
    JOIN vt a ON a.file_id = dr.file_id AND a.group_id = dr.group_id AND a.step = i JOIN vt b ON b.file_id = dr.file_id AND b.group_id = dr.group_id AND b.step = i + off"""
ORACLES["query_points"] = f"""WITH {V}, qi AS (SELECT q::INTEGER AS q, CASE WHEN q = 5 THEN 15 ELSE round_even(1.0::DOUBLE + q * (14.0::DOUBLE / 5), 0)::INTEGER END AS j FROM (SELECT unnest(range(6)) AS q))
SELECT file_id, group_id, q, j, pow(2.0::DOUBLE, j - 1) AS dt FROM vk, qi"""

ORACLES["score_persistence"] = f"WITH {R} " + by_species("r GROUP BY i, j", lambda n: f"i, j, count(*) AS n, {r(f'avg(abs(i{n} - j{n}))', 9)} AS mae", LABELS)
ORACLES["alignment"] = f"WITH {R} SELECT 'prediction' AS side, count(*) AS n_alone FROM r WHERE i < 6 AND j <= 2 UNION ALL SELECT 'truth', count(*) FROM r WHERE i >= 6 AND j > 2"


def summary(floor: str, quantiles: list[tuple[str, str]]) -> str:
    return f"""errs AS (SELECT *, q - y AS e, 100 * abs(q - y) / (abs(y) + 1e-20) AS pct, log10(greatest(q, 5e-20)) - log10(greatest(y, 5e-20)) AS l FROM pts),
both_ AS (SELECT *, 'all' AS bucket FROM errs UNION ALL SELECT *, 'large' FROM errs WHERE y > {floor}),
s AS (SELECT bucket, count(*) AS n, {r('avg(pct)', 7)} AS mean_percent, {r('avg(abs(e))', 7)} AS mae, {r('sqrt(avg(e * e))', 7)} AS rmse, {r('avg(abs(l))', 7)} AS log_mae,
    {r('sqrt(avg(l * l))', 7)} AS log_rmse, {r('avg(l)', 7)} AS log_bias, {r('max(pct)', 7)} AS max_percent,
    {", ".join(f"{r(f'quantile_cont(pct, {x})', 7)} AS {n}" for n, x in quantiles)} FROM both_ GROUP BY bucket)"""


ORACLES["error_summary"] = f"WITH {R}, {summary('0.5', [('p50', '0.5'), ('p90', '0.9'), ('p95', '0.95'), ('p99', '0.99'), ('p99_9', '0.999')])} SELECT * FROM s"
ORACLES["error_percentiles"] = f"WITH {R}, {summary('0.1', [('p25', '0.25'), ('p50', '0.5'), ('p75', '0.75')])} SELECT bucket, n, p25, p50, p75 FROM s".replace("FROM pts)", "FROM pts WHERE species IN ('CO', 'HCN'))", 1)
ORACLES["relative_error"] = f"WITH {R} SELECT species, {r('avg(abs(q - y) / (abs(y) + 1e-12))', 7)} AS mean_relative, {r('max(abs(q - y) / (abs(y) + 1e-12))', 7)} AS max_relative FROM pts GROUP BY species"
_LOSS = f"""x AS (SELECT r.*, {", ".join(f"{z(n, f'j{n}')} AS zt{n}, {z(n, f'q{n}')} AS zp{n}, abs(log10(q{n}) - log10(j{n})) AS g{n}" for n in S)} FROM r, mw),
ws AS (SELECT {", ".join(f"(h{n} - l{n}) / (((h0 - l0) + (h1 - l1) + (h2 - l2) + (h3 - l3)) / 4) AS w{n}" for n in S)} FROM mw),
y AS (SELECT file_id, i, j, {" + ".join(f"g{n}" for n in S)} AS g, {" + ".join(f"g{n} * w{n}" for n in S)} AS gw, {" + ".join(f"(zp{n} - zt{n}) * (zp{n} - zt{n})" for n in S)} AS zz FROM x, ws)"""
_PARTS = "avg({g}) / 4 AS phys, 0.1::DOUBLE * avg(zz) / 4 AS zt, avg(g) / 4 AS m"
_EXPM1 = r("exp(ln(10.0::DOUBLE) * m) - 1", 8)
ORACLES["loss_components"] = f"WITH {R}, {_LOSS}, c AS (SELECT {_PARTS.format(g='gw')} FROM y) SELECT {r('phys + zt', 8)} AS total, {r('phys', 8)} AS phys, {r('zt', 8)} AS z, {r('m', 8)} AS mean_abs_log10, {_EXPM1} AS mult_err_proxy FROM c"
ORACLES["loss_by_step"] = f"WITH {R}, {_LOSS}, c AS (SELECT j - i AS steps, {_PARTS.format(g='g')} FROM y GROUP BY j - i) SELECT steps, {r('phys + zt', 8)} AS total, {_EXPM1} AS mult_err_proxy FROM c"
ORACLES["epoch_means"] = f"WITH {R}, {_LOSS}, c AS (SELECT {_PARTS.format(g='g')} FROM y) SELECT {r('phys + zt', 8)} AS total, {r('zt', 8)} AS z FROM c"
_PEAK = "pk AS (SELECT file_id, group_id, coalesce(max(CASE WHEN y > 1e-15 THEN abs(log10(greatest(q, 1e-35)) - log10(greatest(y, 1e-35))) END), 0) AS peak FROM pts GROUP BY file_id, group_id)"
ORACLES["trajectory_peak_error"] = f"WITH {R}, {_PEAK} SELECT file_id, group_id, {r('peak', 8)} AS peak FROM pk"
ORACLES["worst_trajectories"] = f"WITH {R}, {_PEAK} SELECT file_id, group_id, {r('peak', 8)} AS peak, rank::INTEGER AS rank FROM (SELECT *, row_number() OVER (ORDER BY peak DESC, file_id, group_id) AS rank FROM pk) WHERE rank <= 4"
ORACLES["peak_error_distribution"] = f"WITH {R}, {_PEAK} SELECT {r('quantile_cont(peak, 0.5)', 8)} AS p50, {r('quantile_cont(peak, 0.9)', 8)} AS p90, {r('quantile_cont(peak, 0.99)', 8)} AS p99, {r('max(peak)', 8)} AS max FROM pk"
ORACLES["sampled_trajectories"] = f"WITH {V} SELECT file_id, group_id FROM vk ORDER BY {key_hash('sample')}, file_id, group_id LIMIT 84"
ORACLES["quadrant_picks"] = f"""WITH {V}, m AS (SELECT quantile_cont(log10(p), 0.5) AS mp, quantile_cont(t, 0.5) AS mt FROM vk),
c AS (SELECT file_id, group_id, {key_hash('pick')} AS u, CASE WHEN log10(p) < mp THEN 'low' ELSE 'high' END || '_' || CASE WHEN t < mt THEN 'low' ELSE 'high' END AS quadrant FROM vk, m),
n AS (SELECT *, row_number() OVER (PARTITION BY quadrant ORDER BY u, file_id, group_id) AS k FROM c)
SELECT quadrant, file_id, group_id FROM n WHERE k = 1"""
ORACLES["species_peak_order"] = f"WITH {V} " + by_species("vt WHERE time BETWEEN 0.001 AND 4096", lambda n: f"{r(f'max(s{n})', 8)} AS peak", LABELS)
ORACLES["count_breakdown"] = f"""WITH {R}, c AS (SELECT count(*) AS k, count(DISTINCT j) AS d FROM r GROUP BY file_id, group_id)
SELECT count(*) AS n_trajectories, median(k)::DOUBLE AS median_targets, min(k) AS min_targets, max(k) AS max_targets, median(d)::DOUBLE AS median_distinct, sum(k - d)::BIGINT AS n_repeated,
    sum(k)::BIGINT AS n_pairs, sum(4 * k)::BIGINT AS n_points, (SELECT count(*) FILTER (isfinite(y) AND isfinite(q)) FROM pts) AS n_finite FROM c"""
_POINT = u("file_id || ':' || group_id || ':' || i || ':' || j || ':' || species")
ORACLES["strided_sample"] = f"""WITH {R}, n AS (SELECT file_id, group_id, i::VARCHAR AS i, j::VARCHAR AS j, species, row_number() OVER (ORDER BY {_POINT}, file_id, group_id, i::VARCHAR, j::VARCHAR, species) - 1 AS n FROM pts WHERE y > 0.2),
k AS (SELECT greatest(1, ceil(count(*) / 500.0::DOUBLE)) AS stride FROM n)
SELECT file_id, group_id, i, j, species FROM n, k WHERE n % stride = 0 AND n / stride < 500"""

WORDS = "ws AS (SELECT DISTINCT unnest(regexp_split_to_array(text, '\\s+')) AS species FROM documents)"
_CLEAN = "regexp_replace(split_part(species, '_', 1), '[ +()\\-]', '', 'g')"
FORMULAS = f"""{WORDS}, cl AS (SELECT species, {_CLEAN} AS f FROM ws),
tk AS (SELECT species, unnest(regexp_extract_all(f, '[A-Z][a-z]?[0-9]*')) AS tok FROM cl WHERE regexp_full_match(f, '([A-Z][a-z]?[0-9]*)+')),
el AS (SELECT species, regexp_extract(tok, '^([A-Z][a-z]?)', 1) AS element, try_cast(coalesce(nullif(regexp_extract(tok, '([0-9]+)$', 1), ''), '1') AS BIGINT) AS n FROM tk),
ok AS (SELECT species FROM el GROUP BY species HAVING min(n) > 0 AND max(n) < 1000000000000000 AND count(*) = count(n)),
comp AS (SELECT el.species, element, sum(n)::BIGINT AS n_atoms FROM el JOIN ok ON el.species = ok.species GROUP BY el.species, element),
allc AS (SELECT ws.species, element, n_atoms FROM ws LEFT JOIN comp ON ws.species = comp.species)
"""
ORACLES["element_composition"] = f"WITH {FORMULAS} SELECT element, count(*) AS n_names, sum(n_atoms)::BIGINT AS n_atoms FROM allc GROUP BY element"
_SUN = ", ".join(f"('{e}', {x}::DOUBLE)" for e, x in SOLAR.items())
ORACLES["solar_reference"] = f"""WITH {FORMULAS}, sun(element, eps) AS (VALUES {_SUN}),
m AS (SELECT DISTINCT element FROM comp WHERE element NOT IN ('H', 'He')), f AS (SELECT m.element, pow(10.0::DOUBLE, eps - 12) AS ratio FROM m LEFT JOIN sun ON m.element = sun.element)
SELECT {r('pow(10.0::DOUBLE, 8.43::DOUBLE - 12) / pow(10.0::DOUBLE, 8.69::DOUBLE - 12)', 9)} AS c_to_o, {r('sum(ratio)', 12)} AS m_to_h, string_agg(element, ',' ORDER BY element) AS elements,
    coalesce(string_agg(element, ',' ORDER BY element) FILTER (ratio IS NULL), '') AS missing FROM f"""
ORACLES["global_scale"] = f"""WITH {WORDS}, c AS (SELECT regexp_replace(lower(species), '[^a-z0-9]+', '', 'g') AS c FROM ws),
k AS (SELECT c, c IN ({quoted(METALLICITY)}) AS is_metallicity, CASE WHEN c IN ({quoted(METALLICITY_LOG)}) OR starts_with(c, 'log') THEN 'log10_dex_like' ELSE 'linear_ratio_like' END AS metallicity_scale,
    c IN ({quoted(C_TO_O)}) AS is_c_to_o, CASE WHEN c IN ({quoted(C_TO_O_LOG)}) OR starts_with(c, 'log') THEN 'log10_ratio' ELSE 'linear_ratio' END AS c_to_o_scale FROM c)
SELECT is_metallicity, metallicity_scale, is_c_to_o, c_to_o_scale, count(*) AS n, count(DISTINCT c) AS n_canonical FROM k GROUP BY ALL"""

# Of each species' atoms: C in CH4, CO, HCN; O in CO, H2O; H: 4 in CH4, 2 in H2O, 1 in HCN; metals: all but H.
_CO = "(({0}0 + {0}1 + {0}3) / ({0}1 + {0}2))"
_MH = "(({0}0 + 2 * {0}1 + {0}2 + 2 * {0}3) / (4 * {0}0 + 2 * {0}2 + {0}3))"
ORACLES["species_ratios"] = f"WITH {R} SELECT file_id, count(*) AS n, {r(f'avg({_CO.format('j')})', 8)} AS c_to_o, {r(f'avg({_MH.format('j')})', 8)} AS m_to_h, {r(f'max(log10({_CO.format('j')}))', 8)} AS max_log_c_to_o FROM r GROUP BY file_id"
_CS, _MS = 10.0 ** (8.43 - 12) / 10.0 ** (8.69 - 12), sum(10.0 ** (SOLAR[e] - 12.0) for e in ("C", "O", "N"))
_CHEM = f"""q0 AS (SELECT {_CO.format('j')} / {_CS!r}::DOUBLE AS true_co_solar, {_MH.format('j')} / {_MS!r}::DOUBLE AS true_mh_solar, {_CO.format('q')} / {_CS!r}::DOUBLE AS pred_co_solar, {_MH.format('q')} / {_MS!r}::DOUBLE AS pred_mh_solar,
    p AS global_mh_raw, p / {_MS!r}::DOUBLE AS global_mh_solar, t AS global_co_raw, t / {_CS!r}::DOUBLE AS global_co_solar FROM r),
q1 AS (SELECT *, log10(true_co_solar) AS true_co_bracket, log10(true_mh_solar) AS true_mh_bracket, log10(pred_co_solar) AS pred_co_bracket, log10(pred_mh_solar) AS pred_mh_bracket,
    log10(global_mh_solar) AS global_mh_bracket, log10(global_co_solar) AS global_co_bracket FROM q0),
q2 AS (SELECT *, {", ".join(f"abs(pred_{k}_solar - true_{k}_solar) AS {k}_solar_abs_err, abs(pred_{k}_bracket - true_{k}_bracket) AS {k}_bracket_abs_err, abs(pred_{k}_solar - true_{k}_solar) / (abs(true_{k}_solar) + 1e-30) AS {k}_solar_rel_err" for k in ("co", "mh"))} FROM q1),
lg AS (SELECT abs(log10(q) - log10(y)) AS species_log10_abs_err FROM pts)"""
_QUANTITIES = [f"{s}_{k}_{w}" for s in ("true", "pred", "global") for k in ("co", "mh") for w in ("solar", "bracket")] + ["global_co_raw", "global_mh_raw"] + [f"{k}_{e}_err" for k in ("co", "mh") for e in ("solar_abs", "bracket_abs", "solar_rel")]
ORACLES["chemistry_report"] = f"WITH {R}, {_CHEM} " + " UNION ALL ".join(
    f"SELECT '{c}' AS quantity, count(*) AS n_total, count(*) FILTER (isfinite({c})) AS n_valid, count(*) - count(*) FILTER (isfinite({c})) AS n_invalid, count(*) FILTER (isfinite({c})) / count(*)::DOUBLE AS valid_fraction, {r(f'avg({c})', 6)} AS mean, {r(f'stddev_pop({c})', 6)} AS std, {r(f'min({c})', 6)} AS min, {r(f'max({c})', 6)} AS max FROM {t}"
    for t, cs in (("q2", _QUANTITIES), ("lg", ["species_log10_abs_err"]))
    for c in cs
)

ORACLES["schema_diff"] = """WITH c AS (SELECT user_id % 2 AS side, event_type AS name, count(*) AS n FROM events GROUP BY ALL),
l AS (SELECT *, row_number() OVER (PARTITION BY side ORDER BY n DESC, name)::INTEGER AS position FROM c), a AS (SELECT * FROM l WHERE side = 0), b AS (SELECT * FROM l WHERE side = 1)
SELECT coalesce(a.position, b.position) AS position, a.name AS configured, b.name AS found, coalesce(a.name = b.name, false) AS same FROM a FULL JOIN b ON a.position = b.position"""
ORACLES["name_sets"] = """WITH f AS (SELECT user_id, event_type, min(event_id) AS first FROM events GROUP BY ALL), k AS (SELECT DISTINCT event_type FROM events WHERE user_id % 5 = 0)
SELECT user_id, string_agg(f.event_type, ',' ORDER BY first) AS "union", coalesce(string_agg(f.event_type, ',' ORDER BY f.event_type) FILTER (k.event_type IS NULL), '') AS unknown
FROM f LEFT JOIN k ON f.event_type = k.event_type GROUP BY user_id"""
LOG = "l AS (SELECT event_type AS run_id, user_id AS epoch, event_id AS seq, value AS val_loss, value - 5.0::DOUBLE AS train_loss, row_number() OVER (PARTITION BY event_type, user_id ORDER BY event_id DESC) AS k FROM events), m AS (SELECT run_id, epoch, seq, val_loss, train_loss FROM l WHERE k = 1)"
ORACLES["metrics_last_per_epoch"] = f"WITH {LOG} SELECT * FROM m"
ORACLES["metrics_best_so_far"] = f"""WITH {LOG} SELECT *, min(val_loss) OVER (PARTITION BY run_id ORDER BY epoch) AS best,
    coalesce(val_loss < min(val_loss) OVER (PARTITION BY run_id ORDER BY epoch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), val_loss < 'inf'::DOUBLE) AS improved FROM m"""
ORACLES["metrics_curve"] = f"WITH {LOG} SELECT run_id, epoch + 1 AS epoch, train_loss, CASE WHEN val_loss > 0 THEN val_loss END AS val_loss FROM m WHERE train_loss > 0"
ORACLES["metrics_log_read"] = """WITH l AS (SELECT event_type AS run_id, user_id AS epoch, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS seq, value - 5.0::DOUBLE AS train_loss,
    CASE WHEN event_id % 3 <> 0 THEN value END AS val_loss, row_number() OVER (PARTITION BY event_type, user_id ORDER BY event_id DESC) AS k FROM events)
SELECT run_id, epoch, seq, train_loss, val_loss FROM l WHERE k = 1"""

EVENTS = "e AS (SELECT user_id::VARCHAR AS group_id, epoch_us(ts) / 1e6::DOUBLE AS t, value, row_number() OVER (PARTITION BY user_id ORDER BY ts) - 1 AS step FROM events)"
ORACLES["window_pairs"] = f"WITH {EVENTS} SELECT a.group_id, a.t AS t_i, b.t AS t_j, a.value AS value_i, b.value AS value_j FROM e a JOIN e b ON a.group_id = b.group_id AND b.t > a.t AND b.t <= a.t + 172800"
ORACLES["ragged_pairs"] = """WITH l AS (SELECT o_orderpriority AS file_id, o_orderkey::VARCHAR AS group_id, l_linenumber::DOUBLE AS t, l_quantity::DOUBLE AS q, count(*) OVER (PARTITION BY o_orderkey) AS m,
    row_number() OVER (PARTITION BY o_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_shipdate, l_extendedprice) - 1 AS step
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey)
SELECT a.file_id, a.group_id, a.step AS step_i, a.q AS quantity_i, b.step AS step_j, b.q AS quantity_j, b.t - a.t AS dt
FROM l a JOIN l b ON a.file_id = b.file_id AND a.group_id = b.group_id AND b.step - a.step BETWEEN 1 AND 2 WHERE a.m > 1 AND a.step <= a.m - 1 - least(2, a.m - 1)"""
ORACLES["ragged_dt_spec"] = f"""WITH {EVENTS}, d AS (SELECT group_id, max(step) OVER (PARTITION BY group_id) AS m, t - lag(t, 1) OVER w AS d1, t - lag(t, 2) OVER w AS d2, t - lag(t, 60) OVER w AS d60,
    max(t) OVER (PARTITION BY group_id) - min(t) OVER (PARTITION BY group_id) AS whole FROM e WINDOW w AS (PARTITION BY group_id ORDER BY t))
SELECT {r('log10(least(min(d2), min(whole) FILTER (m BETWEEN 1 AND 2)))', 9)} AS log_min, {r('log10(greatest(max(d60), max(whole) FILTER (m BETWEEN 1 AND 60)))', 9)} AS log_max, {r('min(d1)', 9)} AS k1_min, {r('max(d1)', 9)} AS k1_max FROM d"""

_LOW = "lo AS (SELECT file_id, group_id, p, min(least(s0, s1, s2, s3)) AS low FROM vs GROUP BY ALL)"
ORACLES["reuse_outcomes"] = f"WITH {V}, {_LOW} " + " UNION ALL ".join(
    f"SELECT '{step}' AS step, '{outcome}' AS outcome, count(*) AS n FROM lo WHERE low >= {least} AND p <= {most}"
    for step, outcome, least, most in (
        ("first", "made", 0.001, 8), ("again", "exists", 0.001, 8), ("reuse", "reused", 0.001, 8), ("other setting", "setting", 0.001, 8), ("more input", "input", 0.001, 8),
        ("overwrite", "replaced", 0.001, 10), ("other setting overwritten", "replaced", 0.002, 10), ("half", "unfinished", 0.002, 10),
    )
)
ORACLES["prepared_globals"] = ORACLES["normalize_globals"]
ORACLES["stored_statistics"] = f"WITH {V} " + " UNION ALL ".join(
    f"SELECT '{step}' AS step, '{SPECIES[n]}' AS key, count(*) AS n, {r(f'avg(s{n})', 9)} AS mean, {r(f'min(s{n})', 9)} AS min, {r(f'max(s{n})', 9)} AS max, {r(f'stddev_pop(s{n})', 9)} AS std FROM vt WHERE split = 'train' AND ({where})"
    for step, where in (("first", "p <= 7"), ("same", "p <= 7"), ("added", "true"), ("changed", "p <= 5 OR p > 7"), ("removed", "p = 5 OR p > 7"))
    for n in S
)


ORACLES["bottom_sample"] = f"""WITH {R}, n AS (SELECT file_id, group_id, i::VARCHAR AS i, j::VARCHAR AS j, species, row_number() OVER (PARTITION BY species ORDER BY {_POINT}, file_id, group_id, i::VARCHAR, j::VARCHAR, species) AS n FROM pts WHERE y > 0.2)
SELECT file_id, group_id, i, j, species FROM n WHERE n <= 60"""
ORACLES["alignment_bucketed"] = f"WITH {R} SELECT file_id, group_id, i, j, {r('j0', 8)} AS truth, {r('q0', 8)} AS prediction FROM r WHERE i < 6 AND j > 2"
ORACLES["distinct_grids"] = f"""WITH {O}, p AS (SELECT k, list(l_extendedprice ORDER BY lines.n) AS prices FROM lines GROUP BY k),
g AS (SELECT file_id, grid, prices FROM oc LEFT JOIN p ON oc.k = p.k)
SELECT file_id, count(DISTINCT grid) AS n_grids, count(DISTINCT prices) AS n_prices, true AS grids_close, true AS prices_close FROM g GROUP BY ROLLUP (file_id)"""


def place_of(x: str, n: str, tag: str, seed: int = 42, rounds: int = 48) -> str:
    """The keyed place of number ``x`` of [0, ``n``)."""
    keys = [int(hashlib.sha256(f"{seed}:{tag}:{k}".encode()).hexdigest()[:15], 16) for k in range(rounds)]
    other = f"((k - a) % ({n}) + ({n})) % ({n})"
    return f"list_reduce(list_prepend(({x})::BIGINT, {keys}::BIGINT[]), lambda a, k: CASE WHEN substr(md5(k::VARCHAR || ':' || greatest(a, {other})::VARCHAR), 1, 1) < '8' THEN {other} ELSE a END)"


def _epoch(epoch: int) -> str:
    return f"""{V}, en AS (SELECT file_id, group_id, split, row_number() OVER (PARTITION BY split ORDER BY {key_hash("order")}, file_id, group_id) - 1 AS i FROM vk),
es AS (SELECT split, i // 40 AS shard, 8 * count(*) AS n FROM en GROUP BY ALL), ek AS (SELECT *, count(*) OVER (PARTITION BY split) AS k FROM es),
et AS (SELECT *, {place_of("shard", "n_shards", f"shards:{epoch}")} AS turn FROM (SELECT *, k AS n_shards FROM ek)),
eb AS (SELECT split, shard, n AS n_units, sum(n) OVER (PARTITION BY split ORDER BY turn) - n AS begin FROM et),
ep AS (SELECT file_id, group_id, en.split, shard, unit::INTEGER AS unit, (begin + {place_of("(i % 40) * 8 + unit", "n_units", f"units:{epoch}")})::BIGINT AS place
    FROM en JOIN eb ON en.split = eb.split AND en.i // 40 = eb.shard, (SELECT unnest(range(8)) AS unit))"""


ORACLES["epoch_places"] = f"WITH {_epoch(3)} SELECT file_id, group_id, split, unit, place FROM ep"
ORACLES["places_read"] = f"WITH {_epoch(4)} SELECT file_id, group_id, shard, unit, place FROM ep WHERE split = 'train' AND place >= 700 AND place < 1100"


def _near(key: str, typical: str) -> str:
    """A value near a typical one: a normal draw from two even ones, each a hash of the row's number."""
    radius, angle = (u(f"id || ':{key}:{w}'", 1) for w in ("radius", "angle"))
    return f"greatest(1e-35::DOUBLE, ({typical}) * (1 + 0.01::DOUBLE * (sqrt(-2 * ln(1 - {radius})) * cos(2 * pi() * {angle}))))"


_PROBES = [("CH4_evolution", "pow(10.0::DOUBLE, a0)"), ("CO_evolution", "0.5::DOUBLE * (a1 + c1)"), ("H2O_evolution", "pow(10.0::DOUBLE, 0.5::DOUBLE * (a2 + c2))"), ("HCN_evolution", "a3")]
ORACLES["probe_inputs"] = f"""WITH {MW}, ids AS (SELECT unnest(range(10 * (SELECT count(*) FROM vk WHERE split = 'train'))) AS id)
SELECT id, {", ".join(f"{r(_near(key, x), 8)} AS y{k}" for k, (key, x) in enumerate(_PROBES))}, {r(f"pow(10.0::DOUBLE, lo + {u("id || ':dt:even'", 1)} * (hi - lo))", 6)} AS dt,
    {r(_near("P", "pow(10.0::DOUBLE, 0.5::DOUBLE * (pa + pc))"), 8)} AS p, {r(_near("T", "ta"), 6)} AS t FROM ids, mw, mg, md"""
