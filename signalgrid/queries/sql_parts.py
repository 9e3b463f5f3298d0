"""SQL fragments shared by the checking statements."""

from __future__ import annotations

from itertools import combinations_with_replacement

# Digital rays in closed form, joined to the raster and counted.
BASE_MAPS = """
ray_start AS (SELECT *, greatest(0, least(CAST(round_even(tx_x, 0) AS INT), width - 1)) AS x0,
                        greatest(0, least(CAST(round_even(tx_y, 0) AS INT), height - 1)) AS y0 FROM cells WHERE valid),
ray_span AS (SELECT *, abs(x - x0) AS dx, abs(y - y0) AS dy FROM ray_start),
ray_step AS (SELECT sample_id, y, x, x0, y0, dx, dy, unnest(range(0, greatest(dx, dy) + 1)) AS i FROM ray_span),
ray_cell AS (SELECT sample_id, y, x, greatest(dx, dy) + 1 AS n,
    x0 + CASE WHEN x >= x0 THEN 1 ELSE -1 END * CASE WHEN dx >= dy THEN i ELSE (2 * i * dx + dy) // greatest(2 * dy, 1) END AS rx,
    y0 + CASE WHEN y >= y0 THEN 1 ELSE -1 END * CASE WHEN dx >= dy THEN (2 * i * dy + dx) // greatest(2 * dx, 1) ELSE i END AS ry
    FROM ray_step),
ray_sum AS (SELECT r.sample_id, r.y, r.x, max(r.n) AS n,
    count(*) FILTER (c.material > 0) AS wall_count,
    count(*) FILTER (c.material = 1) AS mat_1_count,
    count(*) FILTER (c.material = 2) AS mat_2_count,
    count(*) FILTER (c.material = 3) AS mat_3_count,
    coalesce(sum(c.transmittance), 0) AS transmittance_sum, coalesce(sum(c.reflectance), 0) AS reflectance_sum
    FROM ray_cell r LEFT JOIN cells c ON c.sample_id = r.sample_id AND c.x = r.rx AND c.y = r.ry GROUP BY 1, 2, 3),
base_maps AS (SELECT s.*, c.scene_id, c.path_loss, c.wall, c.height, c.width, c.frequency_hz, c.resolution_m,
    greatest(sqrt((c.x - c.tx_x) * (c.x - c.tx_x) + (c.y - c.tx_y) * (c.y - c.tx_y)) * c.resolution_m, 25e-2) AS distance_m,
    CASE WHEN s.wall_count = 0 THEN 1 ELSE 0 END AS los, s.wall_count / CAST(s.n AS DOUBLE) AS wall_fraction
    FROM ray_sum s JOIN cells c USING (sample_id, y, x)),
maps AS (SELECT *, 20 * log10(distance_m) + 20 * log10(frequency_hz) - 147.55e0 AS fspl_db, 10 * log10(distance_m) AS log_d
    FROM base_maps)
"""


def hash_sql(*parts: str) -> str:
    return f"CAST(('0x' || substr(sha256(concat_ws('::', {', '.join(parts)})), 9, 8)) AS UBIGINT)"


def mixed(source: str, word: str, name: str) -> str:
    """`source` with a column that mixes the bits of a 32-bit word."""
    step = "(xor({0}, {0} >> 16) * 73244475) & 4294967295"
    return (f"(SELECT * EXCLUDE (m0, m1, m2), xor(m2, m2 >> 16) AS {name} FROM (SELECT *, {step.format('m1')} AS m2 FROM ("
            f"SELECT *, {step.format('m0')} AS m1 FROM (SELECT *, CAST({word} AS BIGINT) & 4294967295 AS m0 FROM {source}))))")


def bootstrap_draws(sizes: str, iterations: int, seed: int, keys: tuple[str, ...]) -> str:
    """One row per draw (keys, n, b, d, pos) of every group of `sizes` (keys and n), for groups of one block."""
    salted = mixed(sizes, hash_sql(f"'{seed}'", *keys), "salt")
    replicates = f"(SELECT s.*, r.b FROM {salted} s CROSS JOIN (SELECT range AS b FROM range({iterations})) r)"
    words = mixed(mixed(replicates, "b + salt", "first"), "xor(first, 2654435761)", "second")
    draws = f"(SELECT *, unnest(range(0, n)) AS d FROM {words})"
    last = mixed(mixed(draws, "d + first", "inward"), "xor(inward, second)", "word")
    return f"SELECT {', '.join(keys)}, n, b, d, word % n AS pos FROM {last}"


def anchors(rate: str, seeds: tuple[int, ...], min_points: int = 4, source: str = "maps", name: str = "anchors") -> str:
    """Anchor cells of one rate; the rate is given as its text."""
    values = ", ".join(f"({s})" for s in seeds)
    h = hash_sql("'anchor'", "b.sample_id", f"'{rate}'", "CAST(s.seed AS VARCHAR)", "CAST(b.y AS VARCHAR)", "CAST(b.x AS VARCHAR)")
    return f"""
{name}_ranked AS (SELECT b.*, CAST({rate} AS DOUBLE) AS rate, s.seed,
    row_number() OVER (PARTITION BY b.sample_id, s.seed ORDER BY {h}, b.y, b.x) AS rn,
    count(*) OVER (PARTITION BY b.sample_id, s.seed) AS n_valid FROM {source} b CROSS JOIN (VALUES {values}) s(seed)),
{name} AS (SELECT * EXCLUDE (rn) FROM {name}_ranked
    WHERE rn <= least(n_valid, greatest({min_points}, CAST(ceil(n_valid * CAST({rate} AS DOUBLE)) AS BIGINT))))
"""


LOG_FITS = """
log_stats AS (SELECT sample_id, rate, seed, count(*) AS n, avg(log_d) AS mx, avg(path_loss) AS my,
    var_pop(log_d) AS vxx, covar_pop(log_d, path_loss) AS vxy FROM anchors WHERE path_loss IS NOT NULL GROUP BY 1, 2, 3),
log_fits AS (SELECT sample_id, rate, seed, n AS anchor_count,
    CASE WHEN n >= 2 THEN 'log_distance' ELSE 'log_distance_fallback_anchor_mean' END AS status,
    CASE WHEN n >= 2 THEN n * vxy / (n * vxx + 1e-6) ELSE 0 END AS slope,
    my - CASE WHEN n >= 2 THEN n * vxy / (n * vxx + 1e-6) ELSE 0 END * mx AS intercept FROM log_stats)
"""


def ridge(name: str, source: str, keys: tuple[str, ...], features: tuple[str, ...], target: str, alpha: str,
          where: str = "TRUE") -> str:
    """Ridge on centred moments, solved by elimination, one table expression per pivot.

    Ends with table `name`(keys, n, w0..wk, intercept).
    """
    k = len(features)
    key_list = ", ".join(keys)
    lead = key_list + ", " if keys else ""
    by = f"GROUP BY {key_list}" if keys else ""
    cov = [f"count(*) * covar_pop({features[i]}, {features[j]})" + (f" + {alpha}" if i == j else "") + f" AS a{i}_{j}"
           for i, j in combinations_with_replacement(range(k), 2)]
    rhs = [f"count(*) * covar_pop({features[i]}, {target}) AS b{i}" for i in range(k)]
    means = [f"avg({f}) AS m{i}" for i, f in enumerate(features)]
    out = [f"{name}_0 AS (SELECT {lead}count(*) AS n, avg({target}) AS my, {', '.join(cov + rhs + means)} FROM {source} WHERE {where} {by})"]
    for p in range(k):
        cols = []
        for i, j in combinations_with_replacement(range(k), 2):
            if i > p:
                cols.append(f"a{i}_{j} - a{p}_{i} * a{p}_{j} / nullif(a{p}_{p}, 0) AS a{i}_{j}")
            else:
                cols.append(f"a{i}_{j}")
        cols += [f"b{i} - a{p}_{i} * b{p} / nullif(a{p}_{p}, 0) AS b{i}" if i > p else f"b{i}" for i in range(k)]
        keep = ", ".join(f"m{i}" for i in range(k))
        out.append(f"{name}_{p + 1} AS (SELECT {lead}n, my, {keep}, {', '.join(cols)} FROM {name}_{p})")
    src = f"{name}_{k}"
    for p in reversed(range(k)):
        done = "".join(f" - a{p}_{j} * w{j}" for j in range(p + 1, k))
        out.append(f"{name}_s{p} AS (SELECT *, (b{p}{done}) / nullif(a{p}_{p}, 0) AS w{p} FROM {src})")
        src = f"{name}_s{p}"
    weights = ", ".join(f"w{i}" for i in range(k))
    dot = "".join(f" - w{i} * m{i}" for i in range(k))
    out.append(f"{name} AS (SELECT {lead}n, {weights}, my{dot} AS intercept FROM {src})")
    return ",\n".join(out)


MULTI_WALL = ridge("wall_full", "anchors", ("sample_id", "rate", "seed"), ("log_d", "mat_1_count", "mat_2_count", "mat_3_count"),
                   "path_loss", "1e-6", "path_loss IS NOT NULL")

FITS = LOG_FITS + "," + MULTI_WALL + """,
wall_fits AS (SELECT l.sample_id, l.rate, l.seed, l.anchor_count,
    CASE WHEN w.n >= 4 THEN 'multi_wall' ELSE 'multi_wall_fallback_log_distance' END AS status,
    CASE WHEN w.n >= 4 THEN w.w0 ELSE l.slope END AS w0, CASE WHEN w.n >= 4 THEN w.w1 ELSE 0 END AS w1,
    CASE WHEN w.n >= 4 THEN w.w2 ELSE 0 END AS w2, CASE WHEN w.n >= 4 THEN w.w3 ELSE 0 END AS w3,
    CASE WHEN w.n >= 4 THEN w.intercept ELSE l.intercept END AS intercept, l.slope AS ld_slope, l.intercept AS ld_intercept
    FROM log_fits l JOIN wall_full w USING (sample_id, rate, seed))
"""


def predictions(seeds: tuple[int, ...], rate: str) -> str:
    values = ", ".join(f"({s})" for s in seeds)
    return f"""
preds AS (SELECT b.*, CAST({rate} AS DOUBLE) AS rate, s.seed,
    fspl_db AS fspl_pred_db, coalesce(f.ld_intercept + f.ld_slope * b.log_d, 0) AS log_distance_pred_db,
    coalesce(f.intercept + f.w0 * b.log_d + f.w1 * b.mat_1_count + f.w2 * b.mat_2_count + f.w3 * b.mat_3_count, 0) AS multi_wall_pred_db
    FROM maps b CROSS JOIN (VALUES {values}) s(seed)
    LEFT JOIN wall_fits f ON f.sample_id = b.sample_id AND f.seed = s.seed)
"""


# Anchors with the residual over the multi-wall prediction.
KNOWN = """
known AS (SELECT a.sample_id, a.rate, a.seed, a.y, a.x, a.path_loss, a.path_loss - p.multi_wall_pred_db AS residual
    FROM anchors a JOIN preds p USING (sample_id, seed, y, x) WHERE a.path_loss IS NOT NULL)
"""

# All pairs, reduced per query cell: weighted means, exact hits and the four nearest.
IDW = """
idw_pairs AS (SELECT q.sample_id, q.seed, q.y, q.x, k.path_loss, k.residual, k.y AS ay, k.x AS ax,
    (q.x - k.x) * (q.x - k.x) + (q.y - k.y) * (q.y - k.y) AS d2
    FROM preds q JOIN known k ON k.sample_id = q.sample_id AND k.seed = q.seed),
idw AS (SELECT sample_id, seed, y, x,
    coalesce(min(path_loss) FILTER (d2 = 0), sum(path_loss / greatest(d2, 1e-12)) / greatest(sum(1 / greatest(d2, 1e-12)), 1e-6)) AS idw_path_loss,
    coalesce(min(residual) FILTER (d2 = 0), sum(residual / greatest(d2, 1e-12)) / greatest(sum(1 / greatest(d2, 1e-12)), 1e-6)) AS idw_residual,
    count(*) FILTER (d2 = 0) > 0 AS exact_hit
    FROM idw_pairs GROUP BY 1, 2, 3, 4)
"""

KNN = """
near_ranked AS (SELECT *, row_number() OVER (PARTITION BY sample_id, seed, y, x ORDER BY d2, ay, ax) AS r FROM idw_pairs),
near AS (SELECT sample_id, seed, y, x,
    max(residual) FILTER (r = 1) AS v1, max(residual) FILTER (r = 2) AS v2, max(residual) FILTER (r = 3) AS v3, max(residual) FILTER (r = 4) AS v4,
    max(sqrt(d2)) FILTER (r = 1) AS d1, max(sqrt(d2)) FILTER (r = 2) AS d2, max(sqrt(d2)) FILTER (r = 3) AS d3, max(sqrt(d2)) FILTER (r = 4) AS d4
    FROM near_ranked WHERE r <= 4 GROUP BY 1, 2, 3, 4),
near_far AS (SELECT sample_id, seed, max(greatest(d1, d2, d3, d4)) AS far FROM near GROUP BY 1, 2)
"""


def chain(*parts: str) -> str:
    return "WITH " + ",\n".join(p.strip().strip(",") for p in parts) + "\n"


def core_metrics(pred: str, target: str, std: str = "stddev_samp") -> str:
    """Select list of the core error metrics over rows with a target."""
    e = f"({pred} - {target})"
    return f"""round(sqrt(avg({e} * {e})), 6) AS rmse, round(avg(abs({e})), 6) AS mae,
    round(quantile_cont(abs({e}), 0.5), 6) AS median_ae, round(quantile_cont(abs({e}), 0.9), 6) AS p90_ae,
    round(quantile_cont(abs({e}), 0.95), 6) AS p95_ae, round(avg({e}), 6) AS bias_db,
    round({std}({e}), 6) AS std_error_db, count({e}) AS "count\""""
