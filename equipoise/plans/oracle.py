"""The query catalogue in plain SQL, as an independent check of every query.

The SQL takes its own way wherever it can: it compares all pairs, measures costs around the
means in a second pass, ranks instead of looking for a threshold.
"""

from __future__ import annotations

from collections.abc import Sequence

from equipoise.functions.hashing import HASH_PRIME, SketchParams
from equipoise.operators.kmeans import OVERSAMPLING
from equipoise.plans import views
from equipoise.plans.catalog import (
    CENTERS,
    CM,
    CM_LARGE,
    CS,
    CS_EVEN,
    CS_LARGE,
    FAIR_ROUNDS,
    TRAINED_CLUSTERS,
    TRAINING_ROUNDS,
)

TOKENS = (
    "CASE WHEN text = '' THEN [''] WHEN rtrim(text, ' ') = '' THEN [] "
    "ELSE string_split(rtrim(text, ' '), ' ') END"
)
LINES = (
    r"CASE WHEN text = '' THEN [] ELSE regexp_split_to_array("
    r"regexp_replace(text, '(\r\n|\n|\r)$', ''), '\r\n|\n|\r') END"
)


def _word_counts(source: str = "documents") -> str:
    return f"SELECT word, count(*) AS n FROM (SELECT unnest({TOKENS}) AS word FROM {source}) GROUP BY word"


def _points(foreign: bool = False, shift: float = 0.0) -> str:
    pending = "WHEN o_orderstatus = 'P' THEN 'C' " if foreign else ""
    away = f" + CAST({shift} AS DOUBLE)" if shift else ""
    return f"""points AS (
        SELECT o_orderkey AS point_id,
               o_totalprice / CAST(10000 AS DOUBLE)
                   + CAST(CASE WHEN o_orderstatus = 'F' THEN 0 ELSE 20 END AS DOUBLE){away} AS x,
               CAST(o_custkey % 50 AS DOUBLE){away} AS y,
               CASE WHEN o_orderstatus = 'F' THEN 'A' {pending}ELSE 'B' END AS grp
        FROM orders)"""


def _centers(centers: Sequence[Sequence[float]], name: str = "centers") -> str:
    rows = ", ".join(f"({i}, CAST({x} AS DOUBLE), CAST({y} AS DOUBLE))" for i, (x, y) in enumerate(centers))
    return f"{name} AS (SELECT * FROM (VALUES {rows}) AS t(center_id, cx, cy))"


def _near(centers: str = "centers", name: str = "near") -> str:
    return f"""{name} AS (
        SELECT point_id, grp, x, y, center_id AS cluster, dist FROM (
            SELECT *, row_number() OVER (PARTITION BY point_id ORDER BY dist, center_id) AS r FROM (
                SELECT p.*, center_id, (x - cx) * (x - cx) + (y - cy) * (y - cy) AS dist
                FROM points p CROSS JOIN {centers}))
        WHERE r = 1)"""


def _given(select: str, foreign: bool = False) -> str:
    return f"WITH {_points(foreign)}, {_centers(CENTERS)}, {_near()} {select}"


def _fair_round(centers: str, tag: str) -> str:
    """One round as a chain of views, ending in ``next_<tag>`` (center_id, cx, cy)."""
    return f"""{_near(centers, f"near_{tag}")},
    raw_{tag} AS (
        SELECT center_id, cx, cy,
               count(*) FILTER (WHERE grp = 'A') AS n_a, count(*) FILTER (WHERE grp = 'B') AS n_b,
               avg(x) FILTER (WHERE grp = 'A') AS ax, avg(y) FILTER (WHERE grp = 'A') AS ay,
               avg(x) FILTER (WHERE grp = 'B') AS bx, avg(y) FILTER (WHERE grp = 'B') AS by_
        FROM {centers} LEFT JOIN near_{tag} ON cluster = center_id GROUP BY center_id, cx, cy),
    means_{tag} AS (
        SELECT center_id, n_a, n_b,
               coalesce(ax, bx, cx) AS ax, coalesce(ay, by_, cy) AS ay,
               coalesce(bx, ax, cx) AS bx, coalesce(by_, ay, cy) AS by_
        FROM raw_{tag}),
    sizes_{tag} AS (SELECT sum(n_a) AS size_a, sum(n_b) AS size_b FROM means_{tag}),
    fixed_{tag} AS (
        SELECT sum(CASE WHEN grp = 'A' THEN (x - ax) * (x - ax) + (y - ay) * (y - ay) ELSE 0 END)
                   / max(size_a) AS fixed_a,
               sum(CASE WHEN grp = 'B' THEN (x - bx) * (x - bx) + (y - by_) * (y - by_) ELSE 0 END)
                   / max(size_b) AS fixed_b
        FROM near_{tag} JOIN means_{tag} ON cluster = center_id CROSS JOIN sizes_{tag}),
    shares_{tag} AS (
        SELECT center_id, ax, ay, bx, by_, CAST(n_a AS DOUBLE) / size_a AS alpha,
               CAST(n_b AS DOUBLE) / size_b AS beta,
               sqrt((ax - bx) * (ax - bx) + (ay - by_) * (ay - by_)) AS ell
        FROM means_{tag} CROSS JOIN sizes_{tag}),
    search_{tag} AS (
        SELECT 1 AS t, CAST(0.5 AS DOUBLE) AS gamma, CAST(0.25 AS DOUBLE) AS step
        UNION ALL
        SELECT t + 1, gamma + sign(gap) * step, step / 2 FROM (
            SELECT t, gamma, step,
                   max(fixed_a) + sum(alpha * x * x) - max(fixed_b) - sum(beta * (ell - x) * (ell - x)) AS gap
            FROM (SELECT s.*, h.*, f.*,
                         coalesce((1 - gamma) * beta * ell
                             / nullif(gamma * alpha + (1 - gamma) * beta, 0), 0) AS x
                  FROM search_{tag} s CROSS JOIN shares_{tag} h CROSS JOIN fixed_{tag} f)
            GROUP BY t, gamma, step)
        WHERE t < 10),
    found_{tag} AS (
        SELECT h.*, coalesce((1 - gamma) * beta * ell / nullif(gamma * alpha + (1 - gamma) * beta, 0), 0) AS x
        FROM shares_{tag} h CROSS JOIN search_{tag} WHERE t = 10),
    next_{tag} AS (
        SELECT center_id,
               CASE WHEN ell = 0 THEN ax ELSE (ell - x) / ell * ax + x / ell * bx END AS cx,
               CASE WHEN ell = 0 THEN ay ELSE (ell - x) / ell * ay + x / ell * by_ END AS cy
        FROM found_{tag})"""


def _fair_rounds(start: str, rounds: int) -> str:
    return ", ".join(_fair_round(start if r == 1 else f"next_r{r - 1}", f"r{r}") for r in range(1, rounds + 1))


def _fair(
    select: str, rounds: int = 1, centers: Sequence[Sequence[float]] = CENTERS, shift: float = 0.0
) -> str:
    return f"""WITH RECURSIVE {_points(shift=shift)}, {_centers(centers)},
        {_fair_rounds("centers", rounds)} {select}"""


def _lloyd_rounds(start: str, rounds: int) -> str:
    """Rounds of standard Lloyd, ending in ``next_s<rounds>`` (center_id, cx, cy)."""
    steps = []
    for r in range(1, rounds + 1):
        centers = start if r == 1 else f"next_s{r - 1}"
        steps.append(
            f"""{_near(centers, f"near_s{r}")},
    next_s{r} AS (
        SELECT center_id, coalesce(avg(x), cx) AS cx, coalesce(avg(y), cy) AS cy
        FROM {centers} LEFT JOIN near_s{r} ON cluster = center_id GROUP BY center_id, cx, cy)"""
        )
    return ", ".join(steps)


_KEY = f"CAST('0x' || substr(md5('{views.START_SEED}:' || point_id), 1, 15) AS BIGINT)"


def _sampled_start(k: int) -> str:
    """``start`` (center_id, cx, cy): candidates in hash order, weighted, reduced one by one."""
    first = f"""candidates AS (
        SELECT row_number() OVER (ORDER BY key) - 1 AS center_id, x AS cx, y AS cy FROM (
            SELECT x, y, {_KEY} AS key FROM points ORDER BY key LIMIT {OVERSAMPLING * k})),
    {_near("candidates", "near_candidate")},
    weighted AS (
        SELECT center_id, cx, cy, count(point_id) AS w
        FROM candidates LEFT JOIN near_candidate ON cluster = center_id GROUP BY center_id, cx, cy),
    pick_1 AS (SELECT 0 AS n, cx, cy FROM weighted ORDER BY w DESC, weighted.center_id LIMIT 1)"""
    picks = [
        f"""pick_{i} AS (
        SELECT {i - 1} AS n, cx, cy FROM (
            SELECT c.center_id, c.cx, c.cy, any_value(w) * min((c.cx - p.cx) * (c.cx - p.cx) + (c.cy - p.cy) * (c.cy - p.cy)) AS worth
            FROM weighted c CROSS JOIN ({" UNION ALL ".join(f"SELECT * FROM pick_{j}" for j in range(1, i))}) p
            GROUP BY c.center_id, c.cx, c.cy)
        ORDER BY worth DESC, center_id LIMIT 1)"""
        for i in range(2, k + 1)
    ]
    start = " UNION ALL ".join(f"SELECT n AS center_id, cx, cy FROM pick_{j}" for j in range(1, k + 1))
    return f"{first}, {', '.join(picks)}, start AS ({start})"


def _trained(rounds: str, select: str, foreign: bool = False) -> str:
    return f"WITH RECURSIVE {_points(foreign)}, {_sampled_start(TRAINED_CLUSTERS)}, {rounds} {select}"


_CENTER_ROWS = "SELECT center_id AS cluster, round(cx, 6) AS cx, round(cy, 6) AS cy FROM {0}"


_WIDE = """WITH coords AS (
        SELECT vec_id, label, unnest(CAST(embedding AS DOUBLE[])) AS v,
               unnest(range(len(embedding))) AS j FROM embeddings),
    means AS (SELECT label AS center_id, j, avg(v) AS c FROM coords GROUP BY label, j),
    dists AS (
        SELECT vec_id, any_value(label) AS label, center_id, sum((v - c) * (v - c)) AS dist
        FROM coords JOIN means USING (j) GROUP BY vec_id, center_id),
    near AS (
        SELECT * FROM (
            SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY dist, center_id) AS r FROM dists)
        WHERE r = 1)"""

_ITEMS = "items AS (SELECT event_id AS seq, CAST(user_id * 104729 + 1500000000 AS INTEGER) AS item FROM events)"

_PREFIX = f"""all_{_ITEMS},
    items AS (
        SELECT seq, item FROM (SELECT *, row_number() OVER (ORDER BY seq) AS r FROM all_items)
        WHERE r <= (SELECT greatest(1, count(*) // 2) FROM all_items))"""

_FREQ = "freq AS (SELECT item, count(*) AS freq FROM items GROUP BY item)"


def _hash(a: str, b: str) -> str:
    return f"((((CAST({a} AS BIGINT) * item + {b}) + 2147483648) & 4294967295) - 2147483648) % {HASH_PRIME}"


def _hits(params: SketchParams, tag: str) -> str:
    """``hits_<tag>`` (item, d, col, sign, w): every item in every row of a sketch; needs ``freq``."""
    rows = ", ".join(str((d, *row)) for d, row in enumerate(params.rows))
    width = params.width
    return f"""rows_{tag} AS (SELECT * FROM (VALUES {rows}) AS t(d, a, b, a_sign, b_sign)),
    hits_{tag} AS (
        SELECT item, d, CAST(CASE WHEN h < 0 THEN h + {width} ELSE h END AS INTEGER) AS col,
               CASE WHEN s % 2 = 0 THEN 1 ELSE -1 END AS sign, freq
        FROM (SELECT item, freq, d, ({_hash("a", "b")}) % {width} AS h, {_hash("a_sign", "b_sign")} AS s
              FROM freq CROSS JOIN rows_{tag}))"""


def _cm_table(params: SketchParams) -> str:
    return f"""{_hits(params, "cm")},
    cm AS (SELECT d, col, CAST(sum(freq) AS BIGINT) AS counter FROM hits_cm GROUP BY d, col)"""


def _cs_table(params: SketchParams) -> str:
    return f"""{_hits(params, "cs")},
    cs AS (SELECT d, col, CAST(sum(sign * freq) AS BIGINT) AS counter FROM hits_cs GROUP BY d, col)"""


_CM_EST = """cm_est AS (
        SELECT item, min(counter) AS est FROM hits_cm JOIN cm USING (d, col) GROUP BY item)"""


def _cs_est(params: SketchParams) -> str:
    half = params.depth // 2
    median = f"v[{half + 1}]" if params.depth % 2 else f"(v[{half}] + v[{half + 1}]) // 2"
    return f"""cs_est AS (
        SELECT item, {median} AS est FROM (
            SELECT item, list_sort(list(sign * counter)) AS v FROM hits_cs JOIN cs USING (d, col) GROUP BY item))"""


_RANKED = f"""hh AS (
        SELECT item, freq FROM (SELECT *, rank() OVER (ORDER BY freq DESC) AS r FROM freq)
        WHERE r <= {views.TOP_K})"""


def _errors(items: str) -> str:
    return f"""WITH {items}, {_FREQ}, {_cm_table(CM)}, {_cs_table(CS)}, {_CM_EST}, {_cs_est(CS)}, {_RANKED}
    SELECT (SELECT CAST(sum(freq) AS BIGINT) FROM freq) AS processed,
           (SELECT count(*) FROM freq) AS distinct_items,
           count(*) AS hh,
           round(avg(CAST(abs(freq - m.est) AS DOUBLE) / freq), 6) AS cm_err,
           round(avg(CAST(abs(freq - s.est) AS DOUBLE) / freq), 6) AS cs_err
    FROM hh JOIN cm_est m USING (item) JOIN cs_est s USING (item)"""


_SKETCH_ROWS = """SELECT 'count_min' AS kind, d, col AS {key}, counter FROM cm
    UNION ALL SELECT 'count' AS kind, d, col AS {key}, counter FROM cs"""

_COUNTS = """SELECT center_id AS cluster, count(*) FILTER (WHERE grp = 'A') AS na,
    count(*) FILTER (WHERE grp = 'B') AS nb
    FROM centers LEFT JOIN near ON cluster = center_id GROUP BY center_id"""

_PHI = """coalesce(avg(CASE WHEN grp = 'A' THEN dist END), 0) AS mean_a,
    coalesce(avg(CASE WHEN grp = 'B' THEN dist END), 0) AS mean_b"""


_THREE_DECIMALS = "CAST(round(CAST(CAST({0} AS VARCHAR) AS DECIMAL(30, 18)), 3) AS VARCHAR)"

ORACLE: dict[str, str] = {
    "wc_num_docs": "SELECT count(*) AS num_docs FROM documents",
    "wc_direct": _word_counts(),
    "wc_salted": _word_counts(),
    "wc_partition": _word_counts(),
    "wc_by_line": _word_counts(f"(SELECT unnest({LINES}) AS text FROM documents)"),
    "wc_num_lines": f"SELECT CAST(sum(len({LINES})) AS BIGINT) AS num_docs FROM documents",
    "wc_distinct_words": f"SELECT count(*) AS num_words FROM ({_word_counts()})",
    "wc_avg_word_length": f"SELECT round(avg(length(word)), 6) AS avg_len FROM ({_word_counts()})",
    "wc_report": f"""SELECT (SELECT count(*) FROM documents) AS num_docs, count(*) AS num_words,
        round(avg(length(word)), 6) AS avg_len FROM ({_word_counts()})""",
    "points_parse_strict": f"WITH {_points()} SELECT point_id, round(x, 6) AS x, round(y, 6) AS y, grp FROM points",
    "points_parse_cluster_id": f"WITH {_points()} SELECT point_id, round(x, 6) AS x, round(y, 6) AS y, grp FROM points",
    "points_parse_tolerant": f"""WITH {_points()} SELECT point_id,
        CASE WHEN point_id % 11 <> 0 THEN round(x, 6) END AS x, round(y, 6) AS y, grp,
        CASE point_id % 4 WHEN 0 THEN 1 WHEN 1 THEN 12 END AS cluster,
        CASE WHEN point_id % 11 = 0 THEN 'x is not a finite number'
        WHEN point_id % 4 > 1 THEN 'cluster is not an integer' END AS reason FROM points""",
    "group_counts": f"""WITH {_points(foreign=True)} SELECT count(*) AS n,
        count(*) FILTER (WHERE grp = 'A') AS na, count(*) FILTER (WHERE grp = 'B') AS nb FROM points""",
    "nearest_center": _given("SELECT point_id, cluster, round(dist, 6) AS dist FROM near"),
    "nearest_center_wide": f"""{_WIDE} SELECT vec_id AS point_id, center_id AS cluster,
        round(dist, 6) AS dist FROM near""",
    "standard_objective": _given("SELECT round(avg(dist), 6) AS delta FROM near", foreign=True),
    "fair_objective": _given(
        f"""SELECT round(mean_a, 6) AS mean_a, round(mean_b, 6) AS mean_b,
        round(greatest(mean_a, mean_b), 6) AS phi FROM (SELECT {_PHI} FROM near)"""
    ),
    "fair_objective_wide": f"""{_WIDE} SELECT round(mean_a, 6) AS mean_a, round(mean_b, 6) AS mean_b,
        round(greatest(mean_a, mean_b), 6) AS phi FROM (SELECT {_PHI} FROM (
        SELECT dist, CASE WHEN label < 3 THEN 'A' ELSE 'B' END AS grp FROM near))""",
    "compare_objectives": f"""WITH {_points()}, {_centers(CENTERS)}, {_near()},
        {_centers(views.OTHER_CENTERS, "others")}, {_near("others", "other_near")}
        SELECT 'first' AS method, round(greatest(mean_a, mean_b), 6) AS fair_objective
        FROM (SELECT {_PHI} FROM near)
        UNION ALL SELECT 'second', round(greatest(mean_a, mean_b), 6) FROM (SELECT {_PHI} FROM other_near)""",
    "cluster_group_counts": _given(_COUNTS),
    "cluster_group_counts_salted": _given(_COUNTS),
    "group_statistics": _given(
        f"""SELECT n, na, nb, round(delta, 6) AS delta, round(greatest(mean_a, mean_b), 6) AS phi FROM (
        SELECT count(*) AS n, count(*) FILTER (WHERE grp = 'A') AS na,
        count(*) FILTER (WHERE grp = 'B') AS nb, avg(dist) AS delta, {_PHI} FROM near)""",
        foreign=True,
    ),
    "cluster_report": _given(
        """SELECT center_id AS cluster, round(cx, 6) AS cx, round(cy, 6) AS cy,
        count(*) FILTER (WHERE grp = 'A') AS na, count(*) FILTER (WHERE grp = 'B') AS nb
        FROM centers LEFT JOIN near ON cluster = center_id GROUP BY center_id, cx, cy""",
        foreign=True,
    ),
    "cluster_moments": _fair(
        """SELECT center_id AS cluster, n_a, round(ax, 6) AS mx_a, round(ay, 6) AS my_a,
        n_b, round(bx, 6) AS mx_b, round(by_, 6) AS my_b FROM means_r1"""
    ),
    "fair_fixed_costs": _fair("SELECT round(fixed_a, 6) AS fixed_a, round(fixed_b, 6) AS fixed_b FROM fixed_r1"),
    "fair_line_search": _fair("SELECT center_id AS cluster, round(x, 6) AS x, round(ell, 6) AS ell FROM found_r1"),
    "fair_center_step": _fair("SELECT center_id AS cluster, round(cx, 6) AS cx, round(cy, 6) AS cy FROM next_r1"),
    "fair_lloyd": _fair(
        f"SELECT center_id AS cluster, round(cx, 6) AS cx, round(cy, 6) AS cy FROM next_r{FAIR_ROUNDS}",
        FAIR_ROUNDS,
    ),
    "initial_centers": f"""WITH {_points()}, {_sampled_start(TRAINED_CLUSTERS)}
        {_CENTER_ROWS.format("start")}""",
    "standard_kmeans": _trained(
        _lloyd_rounds("start", TRAINING_ROUNDS), _CENTER_ROWS.format(f"next_s{TRAINING_ROUNDS}")
    ),
    "fair_kmeans": _trained(
        _fair_rounds("start", TRAINING_ROUNDS), _CENTER_ROWS.format(f"next_r{TRAINING_ROUNDS}")
    ),
    "standard_lloyd": f"""WITH {_points()}, {_centers(CENTERS)}, {_lloyd_rounds("centers", FAIR_ROUNDS)}
        {_CENTER_ROWS.format(f"next_s{FAIR_ROUNDS}")}""",
    "fair_vs_standard": f"""WITH RECURSIVE {_points()}, {_centers(CENTERS)},
        {_lloyd_rounds("centers", FAIR_ROUNDS)}, {_fair_rounds("centers", FAIR_ROUNDS)},
        {_near(f"next_s{FAIR_ROUNDS}", "standard_near")}, {_near(f"next_r{FAIR_ROUNDS}", "fair_near")}
        SELECT 'standard' AS method, round(greatest(mean_a, mean_b), 6) AS fair_objective
        FROM (SELECT {_PHI} FROM standard_near)
        UNION ALL SELECT 'fair', round(greatest(mean_a, mean_b), 6) FROM (SELECT {_PHI} FROM fair_near)""",
    "clustered_group_statistics": _trained(
        f"""{_lloyd_rounds("start", TRAINING_ROUNDS)}, {_near(f"next_s{TRAINING_ROUNDS}")},
        totals AS (
            SELECT count(*) AS n, count(*) FILTER (WHERE grp = 'A') AS tot_na,
                   count(*) FILTER (WHERE grp = 'B') AS tot_nb, avg(dist) AS delta, {_PHI} FROM near)""",
        f"""SELECT center_id AS cluster, round(cx, 6) AS cx, round(cy, 6) AS cy,
        count(*) FILTER (WHERE grp = 'A') AS na, count(*) FILTER (WHERE grp = 'B') AS nb,
        any_value(n) AS tot_n, any_value(tot_na) AS tot_na, any_value(tot_nb) AS tot_nb,
        round(any_value(delta), 6) AS delta, round(any_value(greatest(mean_a, mean_b)), 6) AS phi
        FROM next_s{TRAINING_ROUNDS} LEFT JOIN near ON cluster = center_id CROSS JOIN totals
        GROUP BY center_id, cx, cy""",
        foreign=True,
    ),
    "fair_step_lone_groups": _fair(_CENTER_ROWS.format("next_r1"), centers=views.LONE_CENTERS),
    "fair_moments_lone_groups": _fair(
        """SELECT center_id AS cluster, n_a, n_b, round(ax, 6) AS mx_a, round(ay, 6) AS my_a,
        round(bx, 6) AS mx_b, round(by_, 6) AS my_b FROM means_r1""",
        centers=views.LONE_CENTERS,
    ),
    "fair_fixed_costs_shifted": _fair(
        "SELECT round(fixed_a, 6) AS fixed_a, round(fixed_b, 6) AS fixed_b FROM fixed_r1", shift=views.SHIFT
    ),
    "save_points": _given(
        f"""SELECT {_THREE_DECIMALS.format("x")} || ',' || {_THREE_DECIMALS.format("y")} || ',' || grp || ','
        || cluster AS line FROM near"""
    ),
    "cluster_series": _given(
        """SELECT cluster || '-' || grp AS series, count(*) AS n, round(min(x), 6) AS min_x,
        round(max(x), 6) AS max_x, round(min(y), 6) AS min_y, round(max(y), 6) AS max_y
        FROM near GROUP BY series"""
    ),
    "cluster_series_sample": _given(
        f"""SELECT series, round(x, 6) AS x, round(y, 6) AS y FROM (
            SELECT *, row_number() OVER (PARTITION BY series ORDER BY key) AS r FROM (
                SELECT cluster || '-' || grp AS series, x, y, {_KEY} AS key FROM near))
        WHERE r <= {views.SAMPLE_ROWS}"""
    ),
    "items_parse": f"WITH {_ITEMS} SELECT seq, item FROM items",
    "item_frequencies": f"WITH {_ITEMS} SELECT item, count(*) AS freq FROM items GROUP BY item",
    "item_totals": f"WITH {_ITEMS} SELECT count(*) AS processed, count(DISTINCT item) AS distinct_items FROM items",
    "items_prefix": f"WITH {_PREFIX} SELECT item, count(*) AS freq FROM items GROUP BY item",
    "count_min_sketch": f"WITH {_ITEMS}, {_FREQ}, {_cm_table(CM)} SELECT d, col, counter FROM cm",
    "count_sketch": f"WITH {_ITEMS}, {_FREQ}, {_cs_table(CS)} SELECT d, col, counter FROM cs",
    "count_min_estimate": f"""WITH {_ITEMS}, {_FREQ}, {_cm_table(CM)}, {_CM_EST}
        SELECT item, freq, est FROM freq JOIN cm_est USING (item)""",
    "count_sketch_estimate": f"""WITH {_ITEMS}, {_FREQ}, {_cs_table(CS)}, {_cs_est(CS)}
        SELECT item, freq, est FROM freq JOIN cs_est USING (item)""",
    "count_sketch_estimate_even": f"""WITH {_ITEMS}, {_FREQ}, {_cs_table(CS_EVEN)}, {_cs_est(CS_EVEN)}
        SELECT item, freq, est FROM freq JOIN cs_est USING (item)""",
    "count_min_estimate_large": f"""WITH {_ITEMS}, {_FREQ}, {_cm_table(CM_LARGE)}, {_CM_EST}
        SELECT seq, item, est FROM items JOIN cm_est USING (item)""",
    "count_sketch_estimate_large": f"""WITH {_ITEMS}, {_FREQ}, {_cs_table(CS_LARGE)}, {_cs_est(CS_LARGE)}
        SELECT seq, item, est FROM items JOIN cs_est USING (item)""",
    "heavy_hitters": f"WITH {_ITEMS}, {_FREQ}, {_RANKED} SELECT item, freq FROM hh",
    "heavy_hitter_listing": f"""WITH {_ITEMS}, {_FREQ}, {_cm_table(CM)}, {_CM_EST}, {_RANKED}
        SELECT item, freq, est AS cm_est FROM hh JOIN cm_est USING (item) ORDER BY item LIMIT {views.TOP_K}""",
    "heavy_hitter_errors": _errors(_ITEMS),
    "stream_item_frequencies": f"WITH {_ITEMS} SELECT item, count(*) AS freq FROM items GROUP BY item",
    "stream_sketches": f"""WITH {_ITEMS}, {_FREQ}, {_cm_table(CM)}, {_cs_table(CS)}
        {_SKETCH_ROWS.format(key="col")}""",
    "stream_prefix_counters": f"""WITH {_PREFIX}, {_FREQ}, {_cm_table(CM)}, {_cs_table(CS)}
        SELECT 'exact' AS kind, 0 AS d, item AS key, freq AS counter FROM freq
        UNION ALL {_SKETCH_ROWS.format(key="key")}""",
    "stream_report": _errors(_PREFIX),
}
