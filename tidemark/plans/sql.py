"""DuckDB SQL of the registered queries, on the same tables."""

from __future__ import annotations

EV = """ev AS (SELECT {key} AS series, event_id AS seq, user_id, (epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01')) / 8.64e10 AS t, value FROM events)"""
TYPE, USER = EV.format(key="event_type"), EV.format(key="CAST(user_id AS VARCHAR)")
SERIES = "dim AS (SELECT DISTINCT series FROM ev)"
SEG = """seg AS (SELECT dim.series, j, j * 3.0::DOUBLE AS tau_l, (j + 1) * 3.0::DOUBLE AS tau_r, 3.0::DOUBLE AS length, count(ev.t) AS r
  FROM dim CROSS JOIN (SELECT unnest(range(10)) AS j) x LEFT JOIN ev ON ev.series = dim.series AND ev.t >= j * 3.0 AND ev.t < (j + 1) * 3.0 GROUP BY ALL)"""
VSEG = "vseg AS (SELECT series, CAST(floor(t / 3) AS BIGINT) AS j, count(*) AS n, sum(value) AS s, sum(value * value) AS ss FROM ev GROUP BY ALL)"
PT = """pt AS (SELECT series, user_id * 100 + CAST(floor(t / 3) AS BIGINT) AS particle, list_sort(list(t - floor(t / 3) * 3)) AS theta FROM ev GROUP BY ALL),
 pp AS (SELECT *, len(theta) AS k, -(particle % 7) / 7.0::DOUBLE AS log_w FROM pt)"""
BINS = "bn AS (SELECT *, list_transform(theta, lambda v: CAST(floor(v / 0.5) AS INT)) AS bins FROM pp)"
OCC = """occ AS (SELECT series, bin, count(*) AS n FROM (SELECT series, unnest(list_distinct(bins)) AS bin FROM bn) GROUP BY ALL),
 occp AS (SELECT series, bin, n, n / (SELECT count(*) FROM bn b WHERE b.series = occ.series)::DOUBLE AS p FROM occ)"""
HIST = "hist AS (SELECT series, bins, count(*) AS n FROM bn GROUP BY ALL)"
WT = """wt AS (SELECT *, exp(log_w - max(log_w) OVER (PARTITION BY series)) AS e FROM pp), wn AS (SELECT *, e / sum(e) OVER (PARTITION BY series) AS w FROM wt)"""
PSEG = """ends AS (SELECT series, particle, w, list_concat([0.0::DOUBLE], theta, [3.0::DOUBLE]) AS e, k FROM wn),
 ps AS (SELECT series, particle, w, j, e[j + 1] AS tau_l, e[j + 2] AS tau_r, (j + 1) / 2.0::DOUBLE AS mean FROM (SELECT *, unnest(range(k + 1)) AS j FROM ends))"""
WIN = """win AS (SELECT dim.series, win, count(ev.t) AS r FROM dim CROSS JOIN (SELECT unnest(range(30)) AS win) x LEFT JOIN ev ON ev.series = dim.series AND floor(ev.t) = win GROUP BY ALL)"""
GRID = """gr AS (SELECT *, (g + 1) * 0.25::DOUBLE AS t FROM (SELECT *, unnest(range(CAST(floor(tau_l / 0.25) AS BIGINT), CAST(floor(tau_r / 0.25) AS BIGINT))) AS g FROM ps)),
 pr AS (SELECT *, (1 - exp(-0.5 * t)) / 0.5 AS mu, sqrt(greatest(2 * (1 - exp(-0.5 * t) * (1 + 0.5 * t)) / 0.25 - ((1 - exp(-0.5 * t)) / 0.5) ^ 2, 0)) AS sd FROM gr)"""
WAIT = """wa AS (SELECT series, seq, t, t - coalesce(lag(t) OVER w, 0) AS gap, row_number() OVER w AS n FROM ev WINDOW w AS (PARTITION BY series ORDER BY t, seq)),
 wp AS (SELECT series, seq, CAST(floor(t / 3) AS BIGINT) AS win, gap, exp((1.0 + n - 1) * (ln(1.0 + t - gap) - ln(1.0 + t - gap + gap))) AS p FROM wa)"""


def ll(r: str, length: str, a: str = "0.1", b: str = "0.1") -> str:
    """Log marginal likelihood of a Poisson segment."""
    return f"CASE WHEN {length} <= 0 THEN 0 ELSE {a} * ln({b}) + CASE WHEN {r} > 0 THEN lgamma({a} + {r}) - lgamma({a}) ELSE 0 END - ({a} + {r}) * ln({b} + {length}) END"


def season_height(t: str) -> str:
    f = f"({t} - CASE WHEN {t} > 1 THEN floor({t}) ELSE 0 END)"
    return f"CASE WHEN {f} >= 0.765 THEN 4.1 WHEN {f} >= 0.3314 THEN 5.2 ELSE 1.0 END"


def season_integral(t: str) -> str:
    n = f"CASE WHEN {t} > 1 THEN floor({t}) ELSE 0 END"
    f = f"({t} - {n})"
    total = "(0.3314 * 1.0 + (0.765 - 0.3314) * 5.2 + (1 - 0.765) * 4.1)::DOUBLE"
    return f"(({n}) * {total} + CASE WHEN {f} >= 0.765 THEN 0.3314 + (0.765 - 0.3314) * 5.2 + ({f} - 0.765) * 4.1 WHEN {f} >= 0.3314 THEN 0.3314 + ({f} - 0.3314) * 5.2 ELSE {f} END)"


def lgp(x: str, a: str, b: str) -> str:
    return f"({a} * ln({b}) - lgamma({a}) + ({a} - 1) * ln({x}) - {b} * {x})"


def q(*parts: str, body: str) -> str:
    return f"WITH {', '.join(parts)} {body}"




def phi(n: str) -> str:
    """n (log n - psi(n)); psi of an integer by the shifted asymptotic series."""
    x = f"({n} + 8.0::DOUBLE)"
    shift = " + ".join(f"1.0::DOUBLE / ({n} + {i})" for i in range(8))
    return f"CASE WHEN {n} <= 0 THEN 0 ELSE {n} * (ln({n}) - (ln({x}) - 1 / (2 * {x}) - 1 / (12 * {x} * {x}) + 1 / (120 * pow({x}, 4)) - 1 / (252 * pow({x}, 6)) + 1 / (240 * pow({x}, 8)) - ({shift}))) END"


#: One and how often a series is seen in each quarter of a day, and in each ten days.
PROFILE = "pf AS (SELECT d.series, k, 1.0::DOUBLE + count(ev.t) AS height FROM (SELECT DISTINCT series FROM ev) d CROSS JOIN (SELECT unnest(range(4)) AS k) LEFT JOIN ev ON ev.series = d.series AND floor((t - floor(t)) * 4) = k GROUP BY ALL)"
TRENDS = "tr AS (SELECT d.series, k, 1.0::DOUBLE + count(ev.t) AS height FROM (SELECT DISTINCT series FROM ev) d CROSS JOIN (SELECT unnest(range(3)) AS k) LEFT JOIN ev ON ev.series = d.series AND floor(t / 10) = k GROUP BY ALL)"


def combined(op: str) -> str:
    return q(USER, PROFILE, TRENDS, body=f"SELECT pf.series, i / 4.0::DOUBLE AS knot, round(tr.height {op} pf.height, 6) AS height FROM pf JOIN tr ON tr.series = pf.series JOIN (SELECT unnest(range(120)) AS i) ON i % 4 = pf.k AND i // 40 = tr.k")


SCORES = "sc AS (SELECT series AS process, row_number() OVER (PARTITION BY series ORDER BY t, seq) - 1 AS step, value AS score FROM ev)"
GAUSS = "(ss - s * s / (0.1 + n))"
ENT = "ln(sum(n)) - sum(n * ln(n)) / sum(n)"

SQL = {
    "distinct_values": q(TYPE, body="SELECT series, count(DISTINCT value) AS n_values, round(min(t), 6) AS t_min, round(max(t), 6) AS t_max FROM ev GROUP BY series"),
    "prefix_sum": q(TYPE, body="SELECT series, seq, round(sum(value) OVER w, 4) AS s, round(sum(value * value) OVER w, 4) AS ss FROM ev WINDOW w AS (PARTITION BY series ORDER BY t, seq ROWS UNBOUNDED PRECEDING)"),
    "undo_prefix_sum": q(TYPE, body="SELECT series, seq, 1::BIGINT AS x, row_number() OVER (PARTITION BY series ORDER BY t, seq) AS s FROM ev"),
    "suffix_sum": q(TYPE, body="SELECT series, seq, round(sum(value) OVER (PARTITION BY series ORDER BY t, seq ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 3) AS s FROM ev"),
    "modulo_fold": q(TYPE, body="SELECT series, seq, CAST(floor(t) AS BIGINT) AS turn, round(t - floor(t), 6) AS folded, round(t, 6) AS unfolded FROM ev"),
    "season_label": q(TYPE, body="SELECT series, seq, ((t - floor(t) > 0)::BIGINT + (t - floor(t) > 0.3314)::BIGINT + (t - floor(t) > 0.765)::BIGINT) AS season FROM ev"),
    "season_partition": q(TYPE, body="SELECT series, season, count(*) AS n, round(min(f), 6) AS first, round(max(f), 6) AS last FROM (SELECT series, t - floor(t) AS f, ((t - floor(t) > 0)::BIGINT + (t - floor(t) > 0.3314)::BIGINT + (t - floor(t) > 0.765)::BIGINT) AS season FROM ev) GROUP BY ALL"),
    "collapse_to_seasons": q(TYPE, body="SELECT series, seq, round(t - floor(t), 6) AS t, row_number() OVER (PARTITION BY series ORDER BY t - floor(t), seq) - 1 AS rank FROM ev"),
    "argsort": q(TYPE, body="SELECT series, seq, row_number() OVER (PARTITION BY series ORDER BY t, seq) - 1 AS rank FROM ev"),
    "lower_bound_index": q(USER, SERIES, body="SELECT dim.series, round(p, 6) AS t, count(ev.t) AS idx FROM dim CROSS JOIN (SELECT unnest(range(21)) * 1.5::DOUBLE AS p) x LEFT JOIN ev ON ev.series = dim.series AND ev.t < p GROUP BY dim.series, p"),
    "upper_bound_index": q(TYPE, body="SELECT series, seq, count(*) OVER (PARTITION BY series ORDER BY t RANGE UNBOUNDED PRECEDING) AS idx FROM ev"),
    "segment_counts": q(USER, SERIES, SEG, body="SELECT series, j, tau_l, tau_r, r, length FROM seg"),
    "sliding_windows": q(USER, body="SELECT series, win AS \"window\", count(*) AS n, round(sum(value), 3) AS s FROM (SELECT *, row_number() OVER (PARTITION BY series ORDER BY t, seq) - 1 AS i FROM ev) r JOIN (SELECT unnest(range(20000)) AS win) w ON i >= win * 10 AND i < win * 10 + 20 GROUP BY series, win"),
    "column_subset": q(USER, body="SELECT series, i AS seq, round(t, 6) AS t FROM (SELECT *, row_number() OVER (PARTITION BY series ORDER BY t, seq) - 1 AS i FROM ev) WHERE i < 50 AND i % 7 = 0"),
    "first_argmax": q(TYPE, body="SELECT series, arg_max(seq, (value, -seq)) AS seq, round(max(value), 6) AS value FROM ev GROUP BY series"),
    "step_value": q(TYPE, body=f"SELECT series, seq, ({season_height('t')})::DOUBLE AS height FROM ev"),
    "step_integral": q(TYPE, body=f"SELECT series, seq, round({season_integral('t')}, 6) AS whole, round({season_integral('t')} - {season_integral('(t / 2)')}, 6) AS part FROM ev"),
    "step_prefix": q(USER, PROFILE, body="SELECT series, k / 4.0::DOUBLE AS knot, height, round(coalesce(sum(height) OVER (PARTITION BY series ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) / 4, 6) AS integral FROM pf"),
    "step_product": combined("*"),
    "step_sum": combined("+"),
    "step_standardise": q(TYPE, body=f"SELECT series, seq, round(({season_height('t')})::DOUBLE / (0.3314 + (0.765 - 0.3314) * 5.2 + (1 - 0.765) * 4.1), 6) AS height FROM ev"),
    "decay_integral": q(TYPE, body="SELECT series, seq, round(exp(-0.1 * t), 6) AS value, round((1 - exp(-0.1 * t)) / 0.1, 6) AS whole, round((exp(-0.1 * t / 2) - exp(-0.1 * t)) / 0.1, 6) AS part FROM ev"),
    "pp_loglik": q(USER, SERIES, SEG, body=f"SELECT series, j, r, round({ll('r', 'length')}, 6) AS loglik FROM seg"),
    "pp_posterior": q(TYPE, SERIES, SEG, body=f"SELECT series, j, tau_l, tau_r, r, length, round({ll('r', 'length')}, 6) AS loglik, round(0.1 + r, 6)::DOUBLE AS post_shape, round(0.1 + length, 6)::DOUBLE AS post_rate, round((0.1 + r) / (0.1 + length), 6) AS post_mean, round((0.1 + r) / (0.1 + length) ^ 2, 6) AS post_var FROM seg"),
    "pp_loglik_season": q(TYPE, SERIES, SEG, f"sc AS (SELECT *, {season_integral('tau_r')} - {season_integral('tau_l')} AS scaled FROM seg)", body=f"SELECT series, j, round(scaled, 6) AS scaled, round({ll('r', 'scaled')} + 0.01 * r * tau_l, 6) AS loglik FROM sc"),
    "regime_loglik": q(TYPE, SERIES, SEG, "g AS (SELECT series, j % 3 AS regime, CAST(sum(r) AS BIGINT) AS r, sum(length) AS length FROM seg GROUP BY ALL)", body=f"SELECT series, regime, r, round({ll('r', 'length')}, 6) AS loglik FROM g"),
    "pregression_loglik": f"WITH g AS (SELECT o_orderstatus AS series, CAST(floor((CAST(o_orderdate AS DATE) - DATE '1970-01-01') / 100) AS BIGINT) AS j, count(*) AS r FROM orders GROUP BY ALL) SELECT series, j, r, round({ll('r', '100.0')}, 6) AS loglik FROM g",
    "ur_loglik": q(TYPE, VSEG, body=f"SELECT series, j, n, round(-0.5 * ln(10.0) + 2 * ln(2.0) - lgamma(2.0) - 0.5 * ln(0.1 + n) - n / 2.0 * ln(pi()) + lgamma(n / 2.0 + 2) - (n / 2.0 + 2) * ln(2.0 + 0.5 * {GAUSS}), 5) AS loglik FROM vseg"),
    "ur_posterior": q(TYPE, VSEG, body=f"SELECT series, j, n, round(s / (0.1 + n), 5) AS post_mean, round((2.0 + 0.5 * {GAUSS}) / (2 + n / 2.0 - 1), 5) AS post_var FROM vseg"),
    "sncp_loglik": q(TYPE, SERIES, SEG, body="SELECT series, j, round(-((j + 1) / 2.0 / 0.01) * (1 - exp(-0.01 * length)) + r * ln((j + 1) / 2.0) + 0.01 * r * tau_l, 6) AS loglik FROM seg"),
    "empirical_prior": q(USER, body="SELECT series, greatest(count(*) FILTER (t < 3.0), 1)::DOUBLE AS alpha, 3.0::DOUBLE AS beta FROM ev GROUP BY series"),
    "adaptive_prior": q(USER, SERIES, body="SELECT series, tau, round(CASE WHEN tau <= 0 THEN 4.5 ELSE l * l / 5 END, 6)::DOUBLE AS alpha, round(CASE WHEN tau <= 0 THEN 1.5 ELSE l / 5 END, 6)::DOUBLE AS beta FROM (SELECT dim.series, p AS tau, (count(ev.t) + 0.01) / (p + 0.1) AS l FROM dim CROSS JOIN (SELECT unnest(range(11)) * 3.0::DOUBLE AS p) x LEFT JOIN ev ON ev.series = dim.series AND ev.t < p GROUP BY dim.series, p)"),
    "alternate_loglik": q(TYPE, SERIES, SEG, body="SELECT series, j, round(r * ln((j + 1) / 2.0) - (j + 1) / 2.0 * length, 6) AS loglik FROM seg"),
    "importance_logweight": q(TYPE, PT, WT, PSEG, body=f"SELECT series, particle, round(sum({lgp('mean', 'a', 'b')} - {lgp('mean', '0.1', '0.1')}), 6) AS log_weight FROM (SELECT *, CASE WHEN j = 0 THEN 4.5 ELSE j / 2.0 * j / 2.0 / 5 END AS a, CASE WHEN j = 0 THEN 1.5 ELSE j / 2.0 / 5 END AS b FROM ps) GROUP BY series, particle"),
    "single_cp": q(USER, "r AS (SELECT *, row_number() OVER (PARTITION BY series ORDER BY t, seq) - 1 AS i, count(*) OVER (PARTITION BY series) AS n FROM ev)", body=f"SELECT series, seq, round({ll('i', 't')} + {ll('(n - i)', '(30 - t)')}, 6) AS before, round({ll('(i + 1)', 't')} + {ll('(n - i - 1)', '(30 - t)')}, 6) AS after FROM r"),
    "single_cp_map": q(USER, "r AS (SELECT *, row_number() OVER (PARTITION BY series ORDER BY t, seq) - 1 AS i, count(*) OVER (PARTITION BY series) AS n FROM ev)", f"c AS (SELECT series, n, greatest({ll('i', 't')} + {ll('(n - i)', '(30 - t)')}, {ll('(i + 1)', 't')} + {ll('(n - i - 1)', '(30 - t)')}) AS b FROM r)", body=f"SELECT series, n, round(max(b), 6) AS best, round({ll('n', '30.0')}, 6) AS none, round(greatest(max(b), {ll('n', '30.0')}), 6) AS l_max FROM c GROUP BY series, n"),
    "nb_predictive_pmf": q(TYPE, SERIES, SEG, body="SELECT series, j, round(lgamma(5.0 + r) - lgamma(5.0) - lgamma(r + 1) + 5.0 * (ln(0.2) - ln(3.2)) + r * (ln(3.0) - ln(3.2)), 6) AS log_pmf FROM seg"),
    "nb_predictive_tail": q(USER, SERIES, SEG, "pm AS (SELECT x, exp(lgamma(4.0 + x) - lgamma(4.0) - lgamma(x + 1) + 4.0 * (ln(2.0) - ln(5.0)) + x * (ln(3.0) - ln(5.0))) AS p FROM (SELECT unnest(range(2000)) AS x))", "tl AS (SELECT series, j, r, (SELECT sum(p) FROM pm WHERE x < r) AS b, (SELECT p FROM pm WHERE x = r) AS a FROM seg)", body="SELECT series, j, r, round(coalesce(b, 0) + a / 2, 6) AS p_lower, round(greatest(0, 1 - coalesce(b, 0) - a / 2), 6) AS p_upper, round(least(1, 2 * least(coalesce(b, 0) + a / 2, greatest(0, 1 - coalesce(b, 0) - a / 2))), 6) AS p_two FROM tl"),
    "sequential_pvalues": q(USER, SERIES, WIN, "kn AS (SELECT series, win, r, (1 + coalesce(sum(r) OVER (PARTITION BY series ORDER BY win ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE AS shape, (1 + win)::DOUBLE AS rate FROM win)", "tl AS (SELECT *, list_transform(range(r + 1), lambda x: exp(lgamma(shape + x) - lgamma(shape) - lgamma(x + 1.0) + shape * (ln(rate) - ln(rate + 1)) + x * (0 - ln(rate + 1)))) AS p FROM kn)", body="SELECT series, win, r, shape, rate, round(list_sum(p) - p[r + 1] / 2, 6) AS p_lower, round(greatest(0, 1 - (list_sum(p) - p[r + 1] / 2)), 6) AS p_upper FROM tl"),
    "waiting_time_pvalues": q(USER, WAIT, body="SELECT series, seq, win, round(gap, 6) AS gap, round(p, 6) AS p FROM wp"),
    "fisher_combined": q(USER, WAIT, "f AS (SELECT series, win, count(*) AS n, -2 * sum(ln(p)) AS x, min(p) AS p1 FROM wp GROUP BY ALL)", body="SELECT series, win, n, round(CASE WHEN n = 1 THEN p1 WHEN x <= 0 THEN 1 ELSE least(1, list_sum(list_transform(range(n), lambda i: exp(-x / 2 + i * ln(x / 2) - lgamma(i + 1.0))))) END, 6) AS combined FROM f"),
    "hist_transdim": q(TYPE, PT, BINS, HIST, body="SELECT series, array_to_string(bins, ',') AS bins, n FROM hist"),
    "hist_max_gap": q(TYPE, PT, "e AS (SELECT series, list_concat([0.0::DOUBLE], theta, [3.0::DOUBLE]) AS e FROM pp)", "g AS (SELECT series, list_max(list_transform(range(1, len(e)), lambda i: e[i + 1] - e[i])) AS g FROM e)", body="SELECT series, CAST(CAST(floor(g / 0.5) AS INT) AS VARCHAR) AS bins, count(*) AS n FROM g GROUP BY ALL"),
    "hist_weighted": q(TYPE, PT, BINS, body="SELECT series, array_to_string([bins[1], bins[-1]], ',') AS bins, round(sum(exp(log_w)), 6) AS n FROM bn GROUP BY ALL"),
    "hist_unbounded": q(TYPE, body="SELECT series, CAST(CASE WHEN t < 5 THEN 0 WHEN t >= 25 THEN 11 ELSE floor((t - 5) / 2) + 1 END AS BIGINT) AS bin, count(*) AS n FROM ev GROUP BY ALL"),
    "hist_1d": q(TYPE, PT, BINS, OCC, body="SELECT series, bin::BIGINT AS bin, n, round(p, 6) AS p FROM occp"),
    "hist_marginal": q(TYPE, PT, BINS, body="SELECT series, bins[2]::BIGINT AS bin, count(*) AS n FROM bn WHERE k = 2 GROUP BY ALL"),
    "hist_merge": q(TYPE, PT, BINS, HIST, body="SELECT series, array_to_string(bins, ',') AS bins, n FROM hist"),
    "hist_normalised": q(TYPE, PT, BINS, HIST, body="SELECT series, array_to_string(bins, ',') AS bins, n, round(n / sum(n) OVER (PARTITION BY series), 6) AS p, round(n / sum(n) OVER (PARTITION BY series) / 0.5, 6) AS density FROM hist"),
    "hist_draw": q(TYPE, PT, BINS, OCC, body="SELECT series, min(bin)::BIGINT AS bin FROM (SELECT series, bin, sum(n) OVER (PARTITION BY series ORDER BY bin) AS c, sum(n) OVER (PARTITION BY series) AS s FROM occ) WHERE c >= 0.4 * s GROUP BY series"),
    "shannon_entropy": q(TYPE, PT, BINS, HIST, body=f"SELECT series, round({ENT}, 6) AS entropy, sum(n)::DOUBLE AS total, count(*) AS n_bins FROM hist GROUP BY series"),
    "cross_entropy": q(TYPE, PT, BINS, OCC, "nn AS (SELECT series, n / sum(n) OVER w AS p, (n + bin + 1) / sum(n + bin + 1) OVER w AS q FROM occ WINDOW w AS (PARTITION BY series))", body="SELECT series, round(-sum(p * ln(q)), 6) AS cross_entropy FROM nn GROUP BY series"),
    "jsd": q(TYPE, PT, BINS, "hr AS (SELECT series, particle % 3 AS run, bins, count(*) AS n FROM bn GROUP BY ALL)", "en AS (SELECT series, run, ln(sum(n)) - sum(n * ln(n)) / sum(n) AS h FROM hr GROUP BY ALL)", "pr AS (SELECT series, bins, n / sum(n) OVER (PARTITION BY series, run) AS p FROM hr)", "mx AS (SELECT series, sum(p) AS n FROM pr GROUP BY series, bins)", f"hm AS (SELECT series, {ENT} AS h FROM mx GROUP BY series)", body="SELECT hm.series, round(hm.h - (SELECT avg(en.h) FROM en WHERE en.series = hm.series), 6) AS jsd FROM hm"),
    "repeat_probability": q(TYPE, PT, "fb AS (SELECT series, particle, CAST(floor(theta[1] / 0.5) AS INT) AS b FROM pp)", "ob AS (SELECT series, avg(same) AS observed FROM (SELECT series, (b = lag(b) OVER (PARTITION BY series ORDER BY particle))::INT AS same FROM fb) GROUP BY series)", "ch AS (SELECT series, sum(p * p) AS chance FROM (SELECT series, count(*) / sum(count(*)) OVER (PARTITION BY series) AS p FROM fb GROUP BY series, b) GROUP BY series)", body="SELECT series, round(observed, 6) AS observed, round(chance, 6) AS chance, round(CASE WHEN chance >= 1 THEN 0 ELSE greatest(0, (observed - chance) / (1 - chance)) END, 6) AS repeat FROM ob JOIN ch USING (series)"),
    "difference_softmax": q(TYPE, PT, BINS, OCC, "df AS (SELECT series, bin, n / 50.0::DOUBLE AS n, n / 50.0::DOUBLE - coalesce(lag(n) OVER (PARTITION BY series ORDER BY bin) / 50.0::DOUBLE, 0) AS d FROM occ)", body="SELECT series, bin::BIGINT AS bin, round(n, 6) AS n, round(exp(d - max(d) OVER (PARTITION BY series)) / sum(exp(d)) OVER (PARTITION BY series) * exp(max(d) OVER (PARTITION BY series)), 6) AS p FROM df"),
    "true_marginal": q(USER, "mv AS (SELECT series, avg(value) / 100 AS m FROM ev GROUP BY series)", body="SELECT series, bin, round(exp(-bin * 0.5 / m) - exp(-(bin + 1) * 0.5 / m), 6) AS p FROM mv, (SELECT unnest(range(6)) AS bin)"),
    "phi_table": f"WITH {USER}, {SERIES}, {SEG} SELECT n, round({phi('n')}, 6) AS phi, round({phi('(n + 1)')} - {phi('n')}, 6) AS phi1, round({phi('(n + 2)')} - 2 * {phi('(n + 1)')} + {phi('n')}, 6) AS phi2 FROM (SELECT DISTINCT r AS n FROM seg WHERE r > 0)",
    "divergence_scores": q(TYPE, PT, BINS, HIST, f"ft AS (SELECT m, {phi('m')} AS f, {phi('(m + 1)')} - 2 * {phi('m')} + {phi('(m - 1)')} AS d2 FROM (SELECT unnest(range(1, 20000)) AS m))", "fc AS (SELECT m, f, sum(CASE WHEN m = 1 THEN 0 ELSE m * d2 END) OVER (ORDER BY m) AS c FROM ft)", body=f"SELECT series, round(sum(f) / sum(n), 6) AS bias_minimax, round(-sum(c) / sum(n) / (sum(n) + 1), 6) AS bias_average, round({ENT}, 6) AS entropy_score, round(exp(2 * ({ENT})) / sum(n), 6) AS extent_score, count(*) AS n_bins, sum(n)::DOUBLE AS total FROM hist JOIN fc ON m = n GROUP BY series"),
    "divergence_jackknife": q(TYPE, PT, BINS, HIST, "hh AS (SELECT series, particle % 2 AS odd, count(*) AS n FROM bn GROUP BY series, odd, bins)", f"eh AS (SELECT series, sum(h) AS h FROM (SELECT series, odd, {ENT} AS h FROM hh GROUP BY series, odd) GROUP BY series)", f"ew AS (SELECT series, {ENT} AS h FROM hist GROUP BY series)", body="SELECT series, round(ew.h - 0.5 * eh.h, 6) AS score FROM ew JOIN eh USING (series)"),
    "dimension_distribution": q(TYPE, PT, body="SELECT series, k, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY series), 6) AS p FROM pp GROUP BY series, k"),
    "map_per_dimension": q(TYPE, PT, body="SELECT series, k, particle, round(v, 6) AS log_post, n FROM (SELECT series, k, particle, log_w - k AS v, row_number() OVER (PARTITION BY series, k ORDER BY log_w - k DESC, particle) AS i, count(*) OVER (PARTITION BY series, k) AS n FROM pp) WHERE i = 1"),
    "grid_summary": q(TYPE, PT, WT, PSEG, GRID, body="SELECT series, g, t, round(sum(w * mean) / sum(w), 6) AS intensity, round(sum(w * (t - tau_l)) / sum(w), 6) AS since_mean, round(sum(w * ((t - tau_l) < mu)::INT) / sum(w), 6) AS p_below, round(sum(w * (t - tau_l) * (t - tau_l)) / sum(w) - (sum(w * (t - tau_l)) / sum(w)) ^ 2, 6) AS since_var, round((sum(w * (t - tau_l)) / sum(w) - any_value(mu)) / any_value(sd), 6) AS since_std FROM pr GROUP BY series, g, t"),
    "grid_capped": q(TYPE, PT, WT, PSEG, GRID, body="SELECT series, g, round(sum(w * mean * exp(-0.2 * (t - tau_l))) / sum(w), 6) AS intensity, round(sum(w * least(t - tau_l, 0.4)) / sum(w), 6) AS since_mean, round(sum(w * (least(t - tau_l, 0.4) < mu)::INT) / sum(w), 6) AS p_below FROM pr GROUP BY series, g"),
    "last_distance": q(TYPE, PT, WT, body="SELECT series, round(sum(w * (3 - theta[-1])) / sum(w), 6) AS mean_distance, round(min(theta[-1]), 6) AS min_last FROM wn GROUP BY series"),
    "probability_variance": q(TYPE, PT, BINS, OCC, body="SELECT series, round(avg(p * (1 - p) / 499), 9) AS variance FROM occp GROUP BY series"),
    "total_variance": q(TYPE, PT, body="SELECT series, round(avg(v) + var_pop(m), 6) AS variance FROM (SELECT series, particle % 4 AS chain, var_pop(k) AS v, avg(k) AS m FROM pp GROUP BY ALL) GROUP BY series"),
    "normalised_weights": q(TYPE, PT, WT, body="SELECT series, particle, round(w, 9) AS w FROM wn"),
    "ess": q(TYPE, PT, WT, body="SELECT series, round(sum(w) ^ 2 / sum(w * w), 4) AS ess, count(*) AS n, count(*) FILTER (w = 0) AS zero_weights FROM wn GROUP BY series"),
    "systematic_resample": q(TYPE, PT, WT, "cu AS (SELECT series, particle, least(sum(w) OVER o, 1.0) AS c, lead(w) OVER (PARTITION BY series ORDER BY particle) IS NULL AS last FROM wn WINDOW o AS (PARTITION BY series ORDER BY particle))", "hi AS (SELECT series, particle, ceil(1000 * CASE WHEN last THEN 1.0 ELSE c END - 0.37) AS h FROM cu)", body="SELECT series, particle, CAST(h - coalesce(lag(h) OVER (PARTITION BY series ORDER BY particle), 0) AS BIGINT) AS offspring FROM hi"),
    "particle_edits": q(TYPE, PT, body="""SELECT series, particle, round(list_reduce(list_concat([0.0::DOUBLE], [theta[1]], [0.5::DOUBLE], theta[2:]), lambda s, x: s * 2 + x), 6) AS inserted,
        round(list_reduce(list_concat([0.0::DOUBLE], theta[2:]), lambda s, x: s * 2 + x), 6) AS deleted, round(list_reduce(list_concat([0.0::DOUBLE], [0.25::DOUBLE], theta[2:]), lambda s, x: s * 2 + x), 6) AS changed FROM pp"""),
    "particle_join": q(TYPE, PT, "a AS (SELECT series, particle, k, log_w, row_number() OVER (PARTITION BY series ORDER BY particle) - 1 AS i, count(*) OVER (PARTITION BY series) AS n FROM pp WHERE particle % 2 = 0)", "b AS (SELECT series, particle, k, log_w, row_number() OVER (PARTITION BY series ORDER BY particle) - 1 AS i, count(*) OVER (PARTITION BY series) AS n FROM pp WHERE particle % 2 = 1)", "sz AS (SELECT DISTINCT a.series, a.n AS na, b.n AS nb FROM a JOIN b USING (series))", "sl AS (SELECT *, unnest(range(greatest(na, nb))) AS slot FROM sz)", body="SELECT sl.series, slot, a.particle, b.particle AS b_particle, a.k + b.k AS k, round(a.log_w + b.log_w - 0.5 - 0.25, 6) AS log_w FROM sl JOIN a ON a.series = sl.series AND a.i = slot % na JOIN b ON b.series = sl.series AND b.i = slot % nb"),
    "greedy_allocation": q(USER, SCORES, "lo AS (SELECT process, step, min(score) OVER (PARTITION BY process ORDER BY step) AS low FROM sc)", "ch AS (SELECT process FROM lo ORDER BY low DESC, process, step LIMIT 500)", body="SELECT process, (SELECT count(*) FROM ch WHERE ch.process = p.process) AS extensions FROM (SELECT DISTINCT process FROM sc) p"),
    "greedy_duplication": q(TYPE, PT, WT, "ga AS (SELECT series, particle, m, 2 * ln(w) - ln(m) - ln(m + 1) AS gain FROM wn CROSS JOIN (SELECT unnest(range(1, 21)) AS m) x)", "tk AS (SELECT series, particle FROM (SELECT *, row_number() OVER (PARTITION BY series ORDER BY round(gain, 9) DESC, particle, m) AS i FROM ga) WHERE i <= 20)", body="SELECT series, particle, 1 + (SELECT count(*) FROM tk WHERE tk.series = wn.series AND tk.particle = wn.particle) AS copies FROM wn"),
}

#: Mid-p tails of a negative binomial count r with shape, rate and time t.
TAILS = """tl AS (SELECT *, list_transform(range(r + 1), lambda x: exp(lgamma(shape + x) - lgamma(shape) - lgamma(x + 1.0) + shape * (ln(rate) - ln(rate + t)) + x * (ln(t) - ln(rate + t)))) AS p FROM kn),
 mp AS (SELECT *, list_sum(p) - p[r + 1] / 2 AS lo FROM tl)"""
MEAN = "(0.1 + r) / (0.1 + length)"


def primary(n: int, value: str) -> str:
    """Weighted mean and variance of a value at the primary points of [0, 3]."""
    points = f"(i + 1) / {n + 1}.0::DOUBLE" if n < 20 else f"i / {n - 1}.0::DOUBLE"
    return q(
        TYPE, PT, WT, PSEG, f"pts AS (SELECT i, 3.0::DOUBLE * ({points}) AS t FROM (SELECT unnest(range({n})) AS i))",
        f"fv AS (SELECT series, w, i, t, {value} AS f FROM ps JOIN pts ON t <= tau_r AND (t > tau_l OR (t = 0 AND tau_l = 0)))",
        body="SELECT series, i, round(t, 6) AS t, round(sum(w * f) / sum(w), 6) AS mean, round(sum(w * f * f) / sum(w) - (sum(w * f) / sum(w)) ^ 2, 6) AS variance FROM fv GROUP BY series, i, t",
    )


def by_interval(own: str) -> str:
    return q(TYPE, PT, WT, PSEG, GRID, body=f"SELECT series, particle % 3 AS interval, g, round(sum(w * mean) / sum(w), 6) AS intensity, round(sum(w * (t - tau_l)) / sum(w), 6) AS since_mean, round(sum(w * ((t - tau_l) < mu)::INT) / sum(w), 6) AS p_below FROM pr WHERE {own} GROUP BY series, particle % 3, g")


#: Gaps between events and ends of windows of three days, with the survival of each.
GAPS = """wm AS (SELECT dim.series, x.j AS seq, (x.j + 1) * 3.0::DOUBLE AS t, 0 AS ev FROM dim CROSS JOIN (SELECT unnest(range(10)) AS j) x UNION ALL SELECT series, seq, t, 1 FROM ev WHERE t >= 0 AND t < 30),
 wg AS (SELECT *, coalesce(lag(t) OVER o, 0) AS since, sum(ev) OVER (o ROWS UNBOUNDED PRECEDING) - ev AS before FROM wm WINDOW o AS (PARTITION BY series ORDER BY t, ev, seq)),
 wv AS (SELECT series, CASE WHEN ev = 1 THEN floor(t / 3)::BIGINT ELSE seq END AS win, exp((1 + before) * (ln(1 + since) - ln(1 + t))) / CASE WHEN ev = 1 THEN 1 ELSE 2 END AS p FROM wg WHERE ev = 1 OR t > since),
 wf AS (SELECT series, win, count(*) AS n, -2 * sum(ln(p)) AS xu, -2 * sum(ln(1 - p)) AS xl, min(p) AS p1 FROM wv GROUP BY ALL)"""


def chi2_upper(x: str) -> str:
    return f"CASE WHEN {x} <= 0 THEN 1 ELSE least(1, list_sum(list_transform(range(n), lambda i: exp(-{x} / 2 + i * ln({x} / 2) - lgamma(i + 1.0))))) END"


MORE: dict[str, str] = {
    "window_given_history": q(USER, SERIES, SEG, "kn AS (SELECT series, j, r, lag(r) OVER (PARTITION BY series ORDER BY j) AS rb, 1.0::DOUBLE + lag(r) OVER (PARTITION BY series ORDER BY j) AS shape, 4.0::DOUBLE AS rate, 3.0::DOUBLE AS t FROM seg QUALIFY rb IS NOT NULL)", TAILS, body="SELECT series, j, rb AS r_before, r, round(lo, 6) AS p_lower, round(greatest(0, 1 - lo), 6) AS p_upper, round(least(1, 2 * least(lo, greatest(0, 1 - lo))), 6) AS p_two FROM mp"),
    "window_count_pvalues": q(
        USER, SERIES, "wn AS (SELECT dim.series, win, count(ev.t) AS r, [0.0, 0.5, 0.25, 0.25][(win % 4 + 1)::INT]::DOUBLE AS tt FROM dim CROSS JOIN (SELECT unnest(range(120)) AS win) x LEFT JOIN ev ON ev.series = dim.series AND floor(ev.t / 0.25) = win GROUP BY ALL)",
        "kn AS (SELECT series, win, r, tt, CASE WHEN tt > 0 THEN tt ELSE 1 END AS t, (1 + coalesce(sum(r) OVER b, 0))::DOUBLE AS shape, 1 + coalesce(sum(tt) OVER b, 0) AS rate FROM wn WINDOW b AS (PARTITION BY series ORDER BY win ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))", TAILS,
        body="SELECT series, win, r, tt AS t, (tt > 0)::BIGINT AS observable, round(CASE WHEN tt > 0 THEN lo ELSE 0.5 END, 6) AS p_lower, round(CASE WHEN tt > 0 THEN greatest(0, 1 - lo) ELSE 0.5 END, 6) AS p_upper, round(CASE WHEN tt > 0 THEN least(1, 2 * least(lo, greatest(0, 1 - lo))) ELSE 1 END, 6) AS p_two FROM mp",
    ),
    "window_waiting_pvalues": q(USER, SERIES, GAPS, f"wc AS (SELECT series, win, n, CASE WHEN n = 1 THEN p1 ELSE {chi2_upper('xu')} END AS u, CASE WHEN n = 1 THEN 1 - p1 ELSE {chi2_upper('xl')} END AS l FROM wf)", body="SELECT series, win, n, round(u, 6) AS p_upper, round(l, 6) AS p_lower, round(2 * least(u, 1 - u), 6) AS p_two FROM wc"),
    "grid_sequential": by_interval("true"),
    "grid_filtering": by_interval("g // 4 = particle % 3"),
    "primary_mean": primary(25, "mean * exp(-0.2 * (t - tau_l))"),
    "primary_nearest": primary(9, "least(t - tau_l, tau_r - t)"),
    "primary_since": primary(9, "t - tau_l"),
    "time_scale": q(TYPE, body=f"SELECT series, seq, round(({season_height('t')}) * CASE WHEN t >= 20 THEN 0.75 WHEN t >= 10 THEN 1.5 ELSE 1.0 END, 6)::DOUBLE AS factor, ({season_height('t')})::DOUBLE AS season FROM ev"),
    "thinned_sample": q(TYPE, PT, body="SELECT series, particle, k, round(log_w, 6) AS log_w FROM pp WHERE particle > 1000 AND (particle - 1000) % 7 = 0"),
    "window_lines": q(USER, SERIES, WIN, body="SELECT series, string_agg(CAST(r AS VARCHAR), ' ' ORDER BY win) AS line FROM win GROUP BY series"),
    "step_of_means": q(USER, SERIES, SEG, f"mm AS (SELECT series, tau_l, length, {MEAN} AS mean FROM seg)", body="SELECT series, tau_l AS knot, round(mean, 6) AS height, round(mean / sum(mean * length) OVER (PARTITION BY series), 6) AS share FROM mm"),
    "particle_concat": q(
        TYPE, PT, "za AS (SELECT *, row_number() OVER (PARTITION BY series ORDER BY particle) - 1 AS i, count(*) OVER (PARTITION BY series) AS c FROM pp WHERE particle % 2 = 0), zb AS (SELECT *, row_number() OVER (PARTITION BY series ORDER BY particle) - 1 AS i, count(*) OVER (PARTITION BY series) AS c FROM pp WHERE particle % 2 = 1)",
        "zs AS (SELECT series, unnest(range(greatest(ca, cb))) AS slot, ca, cb FROM (SELECT series, any_value(c) AS ca FROM za GROUP BY series) JOIN (SELECT series, any_value(c) AS cb FROM zb GROUP BY series) USING (series))",
        "zz AS (SELECT zs.series, slot, za.particle, zb.particle AS b_particle, list_concat(za.theta, list_transform(zb.theta, lambda x: x + 3)) AS theta, za.log_w + zb.log_w AS log_w FROM zs JOIN za ON za.series = zs.series AND za.i = slot % ca JOIN zb ON zb.series = zs.series AND zb.i = slot % cb)",
        body="SELECT series, slot, particle, b_particle, len(theta) AS k, round(log_w, 6) AS log_w, round(list_reduce(list_concat([0.0::DOUBLE], theta), lambda s, x: s / 2 + x), 6) AS folded FROM zz",
    ),
    "particle_exists": q(TYPE, PT, BINS, body="SELECT series, particle, k FROM bn a WHERE particle % 2 = 0 AND EXISTS (SELECT 1 FROM bn b WHERE b.series = a.series AND b.bins = a.bins AND b.particle % 2 = 1)"),
    "monotone_particles": q(USER, SERIES, SEG, f"mm AS (SELECT series, list({MEAN} ORDER BY j) AS v FROM seg WHERE j < 3 GROUP BY series)", body="SELECT series, round(v[1], 6) AS first, round(v[3], 6) AS last FROM mm WHERE v[2] >= v[1] * exp(-0.05 * 3) AND v[3] >= v[2] * exp(-0.05 * 3)"),
    "importance_weights": q(TYPE, PT, WT, PSEG, "iw AS (SELECT series, particle, sum(ln(1 + mean) - tau_l) AS x FROM ps GROUP BY ALL)", "il AS (SELECT series, particle, x + log_w AS l FROM iw JOIN pp USING (series, particle))", "ie AS (SELECT series, particle, exp(l - max(l) OVER (PARTITION BY series)) AS e FROM il)", body="SELECT series, particle, round(e / sum(e) OVER (PARTITION BY series), 9) AS w FROM ie"),
    "bounded_histogram": q(TYPE, PT, "bf AS (SELECT series, list_transform(list_filter(theta, lambda v: v >= 0.5 AND v < 2.5), lambda v: CAST(floor((v - 0.5) / 0.5) AS INT)) AS bins FROM pp)", body="SELECT series, array_to_string(bins, ',') AS bins, count(*) AS n FROM bf GROUP BY series, bins"),
    "hist_draws": q(TYPE, PT, BINS, OCC, "cu AS (SELECT series, bin, sum(n) OVER (PARTITION BY series ORDER BY bin) AS c, sum(n) OVER (PARTITION BY series) AS s FROM occ)", body="SELECT series, draw, min(bin)::BIGINT AS bin FROM cu JOIN (SELECT unnest(range(40)) AS draw) ON c >= (draw + 0.37::DOUBLE) / 40 * s GROUP BY series, draw"),
    "difference_density": q(TYPE, PT, BINS, OCC, "df AS (SELECT series, bin, n / 50.0::DOUBLE - lag(n) OVER (PARTITION BY series ORDER BY bin) / 50.0::DOUBLE AS d, count(*) OVER (PARTITION BY series) - 1 AS cells FROM occ QUALIFY d IS NOT NULL)", "ds AS (SELECT *, max(d) OVER (PARTITION BY series) AS top FROM df)", "dz AS (SELECT *, ln(sum(exp(d - top)) OVER (PARTITION BY series)) + top AS z FROM ds)", body="SELECT series, bin::BIGINT - 1 AS cell, round(exp(d - z), 6) AS p, round(d - z - ln(0.5 * (cells + 1) / cells), 6) AS log_density FROM dz"),
    "stream_pvalues": q(TYPE, "wn AS (SELECT series, floor(t)::BIGINT AS win, count(*) AS r FROM ev GROUP BY ALL)", "kn AS (SELECT series, win, r, 1.0::DOUBLE AS t, (1 + coalesce(sum(r) OVER (PARTITION BY series ORDER BY win ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE AS shape, (1 + win)::DOUBLE AS rate FROM wn)", TAILS, body="SELECT series, win, r, t, shape, rate, round(lo, 6) AS p_lower, round(greatest(0, 1 - lo), 6) AS p_upper, round(least(1, 2 * least(lo, greatest(0, 1 - lo))), 6) AS p_two FROM mp"),
    "divergence_function": q(TYPE, PT, body="SELECT series, round(var_pop(k) / count(*), 9) AS divergence FROM pp GROUP BY series"),
}

#: Ends of the interval of the two-sided p-value, by sums over all numbers that matter.
MASSES = """pm AS (SELECT x, exp(lgamma(4.0 + x) - lgamma(4.0) - lgamma(x + 1) + 4.0 * (ln(2.0) - ln(5.0)) + x * (ln(3.0) - ln(5.0))) AS p FROM (SELECT unnest(range(1500)) AS x)),
 gs AS (SELECT x, p, least(sum(p) OVER (ORDER BY x), sum(p) OVER (ORDER BY x DESC)) AS g FROM pm),
 gm AS (SELECT a.x, sum(b.p) FILTER (WHERE b.g < a.g * (1 - 1e-10)) AS less, sum(b.p) FILTER (WHERE b.g <= a.g * (1 + 1e-10)) AS most FROM gs a, gs b WHERE a.x IN (SELECT r FROM seg) GROUP BY a.x),
 ts AS (SELECT series, j, r, coalesce(less, 0) AS less, most FROM seg JOIN gm ON x = r)"""

SQL |= MORE | {
    "two_sided_pvalues": q(USER, SERIES, SEG, MASSES, body="SELECT series, j, r, round(less, 6) AS p_less, round(most, 6) AS p_most, round((less + most) / 2, 6) AS p_mid FROM ts"),
    "monte_carlo_pvalues": q(
        USER, SERIES, SEG, MASSES, "dr AS (SELECT series, d, round(round(less, 12), 6) AS a, round(round(most, 12), 6) AS b, (('0x' || substr(md5('1:' || series || ':' || j || ':' || d), 1, 13))::BIGINT + 0.5::DOUBLE) / 4503599627370496 AS u FROM ts, (SELECT unnest(range(20)) AS d))",
        "dx AS (SELECT series, d, count(*) AS n, -2 * sum(ln(a + u * (b - a))) AS x FROM dr GROUP BY ALL)", body=f"SELECT series, any_value(n) AS n, round(avg({chi2_upper('x')}), 6) AS combined FROM dx GROUP BY series",
    ),
    "profile_integral": q(
        USER, "pr AS (SELECT series, list(coalesce(c, 0) + 1.0::DOUBLE ORDER BY k) AS h FROM (SELECT DISTINCT series FROM ev) CROSS JOIN (SELECT unnest(range(4)) AS k) LEFT JOIN (SELECT series, floor((t - floor(t)) * 4)::BIGINT AS k, count(*) AS c FROM ev GROUP BY ALL) USING (series, k) GROUP BY series)",
        "fo AS (SELECT series, seq, t, h, CASE WHEN t > 1 THEN floor(t) ELSE 0 END AS n FROM ev JOIN pr USING (series))",
        body="SELECT series, seq, round(t, 6) AS t, round(n * list_sum(h) / 4 + list_sum(list_transform(range(4), lambda i: h[i + 1] * greatest(0, least(0.25, t - n - i / 4.0::DOUBLE)))), 6) AS scaled FROM fo",
    ),
    "pregression_exposure": f"""WITH o AS (SELECT o_orderstatus AS series, CAST(o_orderdate AS DATE) - DATE '1970-01-01' AS seq, count(*) AS n FROM orders GROUP BY ALL), e AS (SELECT seq, sum(n) AS m FROM o GROUP BY seq),
 g AS (SELECT s.series, CAST(floor(e.seq / 100) AS BIGINT) AS j, coalesce(sum(n), 0)::BIGINT AS r, sum(m) / 100.0::DOUBLE AS length FROM (SELECT DISTINCT series FROM o) s CROSS JOIN e LEFT JOIN o ON o.series = s.series AND o.seq = e.seq GROUP BY ALL)
 SELECT series, j, r, round(length, 6) AS length, round({ll('r', 'length')}, 6) AS loglik FROM g""",
}


def settled(sql: str) -> str:
    """Roundings go over more digits: what is a tie but for the last bits rounds as the tie does."""
    out, at, first = "", 0, {"6": 12}
    while (start := sql.find("round(", at)) >= 0:
        depth, i, comma = 1, start + 6, -1
        while depth:
            c = sql[i]
            depth += (c in "([") - (c in ")]")
            if c == "," and depth == 1:
                comma = i
            i += 1
        inner = settled(sql[start + 6 : comma if comma > 0 else i - 1])
        rest = sql[comma:i] if comma > 0 else ")"
        digits = rest.strip(" ,)")
        out += sql[at:start] + (f"round(round({inner}, {first[digits]}), {digits})" if digits in first else f"round({inner}{rest}")
        at = i
    return out + sql[at:]


SQL = {name: settled(text) for name, text in SQL.items()}
