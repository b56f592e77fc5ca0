"""The queries' SQL for DuckDB, written from the operators' definitions."""

from __future__ import annotations

import math

from reliefspark.functions.projection import SCALE, WGS84, series

REF = """
ref AS (
  SELECT o_orderkey // 100 AS row, o_orderkey % 100 AS col, o_totalprice / 1000 AS z, substr(o_orderpriority, 1, 1)::INT AS priority,
         CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN 2 ELSE 3 END AS status
  FROM orders
)"""
SEC = """
items AS (SELECT l_orderkey, round(sum(l_extendedprice), 2) / 1000 AS z FROM lineitem GROUP BY 1),
sec AS (
  SELECT o_orderkey // 100 AS row, o_orderkey % 100 AS col, i.z, (month(o_orderdate) % 5 + 1)::INT AS priority
  FROM orders LEFT JOIN items i ON l_orderkey = o_orderkey
)"""
DIFF = f"""{REF}, {SEC},
d AS (SELECT row, col, r.z - s.z AS z, r.priority AS pr, s.priority AS ps, r.status AS st FROM ref r JOIN sec s USING (row, col))"""
EDGE = "e AS (SELECT max(row) AS rm, max(col) AS cm FROM ref)"


def z(name: str = "z", digits: int = 5, alias: str | None = None) -> str:
    return f"round({name}, {digits}) + 0.0 AS {alias or name}"


def sobel(source: str, to: str) -> str:
    """CTEs that end in `to`: row, col, gx, gy of a grid; edges stand in for what lies beyond."""
    return f"""
{to}_1 AS (
  SELECT row, col, z, rm, CASE WHEN col = 0 THEN z ELSE lag(z) OVER w END AS zl, CASE WHEN col = cm THEN z ELSE lead(z) OVER w END AS zr
  FROM {source}, e WINDOW w AS (PARTITION BY row ORDER BY col)
),
{to}_2 AS (SELECT row, col, rm, zl - zr AS hd, zl + 2 * z + zr AS hs FROM {to}_1),
{to} AS (
  SELECT row, col,
         CASE WHEN row = 0 THEN hd ELSE lag(hd) OVER w END + 2 * hd + CASE WHEN row = rm THEN hd ELSE lead(hd) OVER w END AS gx,
         CASE WHEN row = 0 THEN hs ELSE lag(hs) OVER w END - CASE WHEN row = rm THEN hs ELSE lead(hs) OVER w END AS gy
  FROM {to}_2 WINDOW w AS (PARTITION BY col ORDER BY row)
)"""


def gradient(source: str, to: str) -> str:
    """CTE `to`: row, col, z, d_row, d_col."""
    return f"""
{to} AS (
  SELECT row, col, z,
         CASE WHEN row = 0 THEN lead(z) OVER c - z WHEN row = rm THEN z - lag(z) OVER c ELSE (lead(z) OVER c - lag(z) OVER c) / 2 END AS d_row,
         CASE WHEN col = 0 THEN lead(z) OVER r - z WHEN col = cm THEN z - lag(z) OVER r ELSE (lead(z) OVER r - lag(z) OVER r) / 2 END AS d_col
  FROM {source}, e WINDOW r AS (PARTITION BY row ORDER BY col), c AS (PARTITION BY col ORDER BY row)
)"""


def slope(g: str = "g", px: float = 100.0) -> str:
    return f"atan(sqrt(pow(gx / {px}, 2) + pow(gy / {px}, 2)) / 8) * 100"


METRICS = {
    "mean": "avg({z})", "median": "median({z})", "max": "max({z})", "min": "min({z})", "sum": "sum({z})", "percentil_90": "quantile_cont(abs({z} - mu), 0.9)",
    "squared_sum": "sum({z} * {z})", "nmad": "1.4826 * median(abs({z} - md))", "rmse": "sqrt(avg({z} * {z}))", "std": "stddev_pop({z})",
}


def class_stats(ctes: str, classes: list[tuple[str, str]], index: str, chosen=tuple(METRICS), mode: str = "standard", where: str = "TRUE", inliers: bool = False) -> str:
    """Statistics by class of d (z, columns that index reads)."""
    names = ", ".join(f"({k}, '{n}:{v}')" for k, (n, v) in enumerate(classes))
    value = "CASE WHEN z > lo AND z < hi THEN z END" if inliers else "z"
    columns = ", ".join(f"round({METRICS[m].format(z='v')}, {2 if m in ('sum', 'squared_sum') else 5}) AS {m}" for m in chosen)
    return f"""
WITH {ctes},
lim AS (SELECT avg(z) - 3 * stddev_pop(z) AS lo, avg(z) + 3 * stddev_pop(z) AS hi FROM d),
k AS (SELECT *, {index} AS class_idx FROM d),
m AS (SELECT z, {value} AS v, class_idx FROM k, lim WHERE {where}),
c AS (SELECT *, avg(v) OVER (PARTITION BY class_idx) AS mu, median(v) OVER (PARTITION BY class_idx) AS md FROM m),
s AS (SELECT class_idx, count(z) AS nbpts, {columns} FROM c GROUP BY class_idx)
SELECT '{mode}' AS mode, n.class_idx, n.set_name, {', '.join(chosen)}, coalesce(nbpts, 0) AS nbpts,
       round(coalesce(nbpts, 0) * 100.0 / (SELECT count(*) FROM orders), 5) AS percent_valid_points
FROM (VALUES {names}) n(class_idx, set_name) LEFT JOIN s USING (class_idx)"""


SEGMENTS = [("urgent", "[1]"), ("high", "[2]"), ("medium", "[3]"), ("rest", "[4, 5]")]
SEGMENT = "CASE {c} WHEN 1 THEN 0 WHEN 2 THEN 1 WHEN 3 THEN 2 WHEN 4 THEN 3 WHEN 5 THEN 3 END"
PR, PS = SEGMENT.format(c="pr"), SEGMENT.format(c="ps")
SLOPED = f"""{REF}, {SEC}, {EDGE}, {sobel('ref', 'g')},
d AS (SELECT row, col, r.z - s.z AS z, r.status AS st, {slope()} AS sl FROM ref r JOIN sec s USING (row, col) JOIN g USING (row, col))"""
SLOPE_CLASS = "CASE WHEN sl >= 45 THEN 4 WHEN sl >= 25 THEN 3 WHEN sl >= 10 THEN 2 WHEN sl >= 5 THEN 1 WHEN sl >= 0 THEN 0 END"


def crop(r0: str, r1: str, c0: str, c1: str) -> str:
    return f"WITH {REF}, {EDGE} SELECT row - ({r0}) AS row, col - ({c0}) AS col, {z()} FROM ref, e WHERE row >= {r0} AND row < {r1} AND col >= {c0} AND col < {c1}"


def bilinear(fy: str, fx: str, extra: str = "", clamp: bool = True, where: str = "TRUE") -> str:
    """Bilinear samples of sec at (fy, fx) of each pixel of ref; null pixels with weight make null."""
    cx, cy = ("least(greatest({}, 0), cm)".format(fx), "least(greatest({}, 0), rm)".format(fy)) if clamp else (fx, fy)
    return f"""
WITH {REF}, {SEC}, {EDGE},
p AS (SELECT row, col, {cx} AS fx, {cy} AS fy FROM ref, e WHERE {where}),
q AS (SELECT *, floor(fx)::BIGINT AS c0, floor(fy)::BIGINT AS r0, fx - floor(fx) AS wx, fy - floor(fy) AS wy FROM p),
n AS (
  SELECT row, col, r0 + i AS rr, c0 + j AS cc, CASE i WHEN 0 THEN 1 - wy ELSE wy END * CASE j WHEN 0 THEN 1 - wx ELSE wx END AS w
  FROM q, (VALUES (0), (1)) a(i), (VALUES (0), (1)) b(j)
),
v AS (
  SELECT n.row, n.col, CASE WHEN count(s.z) = count(*) THEN sum(w * s.z) END AS z
  FROM n LEFT JOIN sec s ON s.row = rr AND s.col = cc WHERE w > 0 GROUP BY 1, 2
)"""


def histogram(value: str, where: str = "TRUE", share: str = "round(k::DOUBLE / sum(k) OVER (), 5) + 0.0", cell: str = "({value} - low) / width") -> str:
    """Counts k of d's `value` in the n bins from low, each of width, that the one row of b names."""
    return f"""
cells AS (SELECT least(floor({cell.format(value=value)}), n - 1)::BIGINT AS bin, count(*) AS k FROM d, b WHERE {value} IS NOT NULL AND {where} GROUP BY 1),
bins AS (SELECT bin, coalesce(k, 0) AS k FROM (SELECT unnest(generate_series(0, n - 1)) AS bin FROM b) LEFT JOIN cells USING (bin))
SELECT bin, round(low + bin * width, 5) + 0.0 AS edge, {share} AS value FROM bins, b"""


PDF = """b0 AS (SELECT {bound} AS bound FROM d),
b AS (SELECT CASE WHEN ceil(2 * bound / 10) >= 25 THEN ceil(2 * bound / 10) - 1 ELSE 25 END::BIGINT AS n, CASE WHEN ceil(2 * bound / 10) >= 25 THEN -bound ELSE -abs(bound) END AS low,
      CASE WHEN ceil(2 * bound / 10) >= 25 THEN 10.0 ELSE 2 * abs(bound) / 25 END AS width FROM b0),"""
NK = f"""{REF}, {SEC}, {EDGE}, {gradient('sec', 'g')},
px AS (SELECT g.z - r.z AS dh, sqrt(d_col * d_col + d_row * d_row) AS slope, atan2(-d_col, d_row) + {math.pi!r} AS aspect FROM g JOIN ref r USING (row, col)),
t AS (SELECT floor(aspect / {math.pi / 36!r})::INT AS slice, aspect, dh / slope AS t FROM px WHERE dh IS NOT NULL AND slope >= 0.001),
u AS (SELECT * FROM t WHERE aspect > slice * {math.pi / 36!r} AND slice < 72),
sp AS (SELECT slice, avg(t) AS m, stddev_pop(t) AS s FROM u GROUP BY 1),
sl AS (SELECT slice, count(*) AS n, median(t) AS med FROM u JOIN sp USING (slice) WHERE t >= m - 3 * s AND t <= m + 3 * s GROUP BY 1)"""

SMOOTH = "smooth AS (SELECT vec_id AS row, unnest(embedding)::DOUBLE AS z, unnest(generate_series(0, len(embedding) - 1)) AS col FROM embeddings)"
FILLED = """
m AS (SELECT a.row, a.col, arg_min(b.z, (pow(a.row - b.row, 2) + pow(a.col - b.col, 2)) * 1e12 + b.row * 1e5 + b.col) AS z FROM sec a, sec b WHERE a.z IS NULL AND b.z IS NOT NULL GROUP BY 1, 2),
filled AS (SELECT row, col, z FROM sec WHERE z IS NOT NULL UNION ALL SELECT * FROM m)"""


def cosine(source: str) -> str:
    """CTEs that end in cv: row, col, z of the filtered grid, by cosine sums along rows and columns of the whole grid."""
    pi = repr(math.pi)
    return f"""
dim AS (SELECT max(row) + 1 AS h, max(col) + 1 AS w FROM {source}),
rs AS (SELECT unnest(generate_series(0, h - 1)) AS k FROM dim),
cs AS (SELECT unnest(generate_series(0, w - 1)) AS k FROM dim),
c1 AS (SELECT row, k AS kc, sum(z * cos({pi} * k * (col + 0.5) / w)) AS z FROM {source}, cs, dim GROUP BY 1, 2),
c2 AS (SELECT kc, k AS kr, sum(z * cos({pi} * k * (row + 0.5) / h)) AS z FROM c1, rs, dim GROUP BY 1, 2),
c3 AS (SELECT kc, kr, z * pow(pow({pi} * kr / h, 2) + pow({pi} * kc / w, 2), 0.45) * CASE WHEN kr = 0 THEN 1 ELSE 2 END * CASE WHEN kc = 0 THEN 1 ELSE 2 END / (h * w) AS z FROM c2, dim),
c4 AS (SELECT kc, k AS row, sum(z * cos({pi} * kr * (k + 0.5) / h)) AS z FROM c3, rs, dim GROUP BY 1, 2),
cv AS (SELECT row, k AS col, sum(z * cos({pi} * kc * (k + 0.5) / w)) AS z FROM c4, cs, dim GROUP BY 1, 2)"""


BY_CLASS = f"""{DIFF},
k AS (SELECT z, {PR} AS class_idx FROM d WHERE z IS NOT NULL),
names AS (SELECT * FROM (VALUES (0, 'urgent:[1]'), (1, 'high:[2]'), (2, 'medium:[3]'), (3, 'rest:[4, 5]')) v(class_idx, set_name))"""


def by_class(bins: str, where: str, value: str, share: str, edge: str = "low + bin * width") -> str:
    """Histograms of each class: `bins` makes b (class_idx, n, low, width) from k."""
    return f"""
WITH {BY_CLASS}, {bins},
cells AS (SELECT class_idx, least(floor(({value} - low) / width), n - 1)::BIGINT AS bin, count(*) AS c FROM k JOIN b USING (class_idx) WHERE {where} GROUP BY 1, 2),
bins AS (SELECT class_idx, bin, coalesce(c, 0) AS c, low, width FROM (SELECT class_idx, low, width, unnest(generate_series(0, n - 1)) AS bin FROM b) LEFT JOIN cells USING (class_idx, bin))
SELECT 'standard' AS mode, class_idx, set_name, bin, round(round({edge}, 5), 3) + 0.0 AS edge, round({share}, 5) + 0.0 AS value FROM bins JOIN names USING (class_idx)"""


ORACLES = {
    "scan_grid_ref": f"WITH {REF} SELECT row, col, {z()} FROM ref",
    "scan_grid_sec_nodata": f"WITH {SEC} SELECT row, col, {z()} FROM sec",
    "unit_convert": f"WITH {REF} SELECT row, col, {z('z * 0.3048', 9, 'z')} FROM ref",
    "pix_to_coord": f"WITH {REF} SELECT row, col, 596255.0::DOUBLE + 500.0::DOUBLE * col AS x, 5099745.0::DOUBLE - 500.0::DOUBLE * row AS y FROM ref",
    "translate_grid": f"WITH {REF}, {EDGE} SELECT 250.0::DOUBLE AS left_x, (-150 - (rm + 1) * 100)::DOUBLE AS bottom_y, ((cm + 1) * 100 + 250)::DOUBLE AS right_x, -150.0::DOUBLE AS top_y FROM e",
    "roi_image": crop("2", "9", "10", "40"),
    "roi_terrain": crop("2", "10", "10", "42"),
    "crop_offset_pp": crop("4", "rm + 1", "0", "cm + 1 - 3"),
    "crop_offset_pm": crop("0", "rm + 1 - 5", "0", "cm + 1 - 3"),
    "crop_offset_mp": crop("4", "rm + 1", "2", "cm + 1"),
    "crop_offset_mm": crop("0", "rm + 1 - 5", "2", "cm + 1"),
    "alti_diff": f"WITH {DIFF} SELECT row, col, {z()} FROM d",
    "sec_with_ref_labels": f"WITH {REF}, {SEC} SELECT row, col, {z('s.z', alias='z')}, r.priority AS priority_ref, r.status AS status_ref FROM ref r JOIN sec s USING (row, col)",
    "label_planes": f"WITH {DIFF} SELECT row, col, {z()}, pr AS priority_ref, st AS status_ref, ps AS priority_sec FROM d",
    "waveform_row": f"WITH {DIFF} SELECT row, col, {z('z - avg(z) OVER (PARTITION BY col)', 7, 'row_wave')} FROM d",
    "waveform_col": f"WITH {DIFF} SELECT row, col, {z('z - avg(z) OVER (PARTITION BY row)', 7, 'col_wave')} FROM d",
    "stats_global": class_stats(DIFF, [("global", "1")], "0"),
    "stats_segmentation": class_stats(DIFF, SEGMENTS, PR),
    "stats_multilabel": class_stats(DIFF, [("closed", "[1]"), ("other", "[2, 3]"), ("none", "[9]")], "CASE WHEN st = 1 THEN 0 WHEN st IN (2, 3) THEN 1 WHEN st = 9 THEN 2 END"),
    "stats_slope": class_stats(SLOPED, [("[0%;5%[", "0"), ("[5%;10%[", "5"), ("[10%;25%[", "10"), ("[25%;45%[", "25"), ("[45%;inf[", "45")], SLOPE_CLASS, ("mean", "median", "std")),
    "stats_fusion": class_stats(
        SLOPED, [(f"status_{a}_&_Slope0_{b}", str(3 * i + j + 1)) for i, a in enumerate(("closed", "other")) for j, b in enumerate(("[0%;25%[", "[25%;45%[", "[45%;inf["))],
        "CASE WHEN st = 1 THEN 0 ELSE 3 END + CASE WHEN sl >= 45 THEN 2 WHEN sl >= 25 THEN 1 WHEN sl >= 0 THEN 0 END", ("mean", "max", "min"),
    ),
    "modes_intersection": class_stats(DIFF, SEGMENTS, PR, ("mean", "std", "median"), "intersection", f"({PR}) IS NOT DISTINCT FROM ({PS})"),
    "modes_exclusion": class_stats(DIFF, SEGMENTS, PR, ("mean", "std", "median"), "exclusion", f"({PR}) IS DISTINCT FROM ({PS})"),
    "outliers_stats": class_stats(DIFF, SEGMENTS, PR, ("mean", "max", "min", "std"), inliers=True),
    "stats_long": f"""
WITH {DIFF}, s AS (SELECT avg(z) AS mean, max(z) AS max, min(z) AS min, count(z) AS n, count(*) AS total FROM d)
SELECT 'alti-diff' AS method, 'global' AS layer, 'standard' AS mode, 0 AS class_idx, 'global:1' AS set_name, metric, value::DOUBLE AS value FROM (
  SELECT 'mean' AS metric, round(mean, 5) AS value FROM s UNION ALL SELECT 'max', round(max, 5) FROM s UNION ALL SELECT 'min', round(min, 5) FROM s
  UNION ALL SELECT 'nbpts', n FROM s UNION ALL SELECT 'percent_valid_points', round(n * 100.0 / total, 5) FROM s)""",
    "cdf": f"WITH {DIFF}, b AS (SELECT greatest(floor(max(abs(z)) / 10), 25)::BIGINT AS n, 0.0 AS low, max(abs(z)) / greatest(floor(max(abs(z)) / 10), 25) AS width, max(abs(z)) AS top FROM d),"
    + histogram("abs(z)", share="round(sum(k) OVER (ORDER BY bin) / sum(k) OVER (), 5) + 0.0", cell="{value} / top * n"),
    "pdf": f"WITH {DIFF}, {PDF.format(bound='max(z)')}" + histogram("z", "z >= low AND z <= low + n * width"),
    "pdf_p98": f"WITH {DIFF}, {PDF.format(bound='abs(quantile_cont(z, 0.98))')}" + histogram("z", "z >= low AND z <= low + n * width"),
    "ratio_above_threshold": f"WITH {DIFF} SELECT (i - 1)::BIGINT AS bin, t AS edge, round(avg((z > t)::INT), 5) + 0.0 AS value FROM d, (VALUES (1, 0.5::DOUBLE), (2, 10.0::DOUBLE), (3, 100.0::DOUBLE)) v(i, t) WHERE z IS NOT NULL GROUP BY 1, 2",
    "orientation_hist": f"""
WITH {REF}, {EDGE}, {gradient('ref', 'g')},
n AS (SELECT sqrt(pow(d_col / 100, 2) + pow(d_row / 100, 2) + 1) AS norm, * FROM g),
o AS (SELECT atan2(-(d_col / 100) / norm, (d_row / 100) / norm) AS a FROM n),
d AS (SELECT CASE WHEN a < 0 THEN a + {2 * math.pi!r} ELSE a END AS z FROM o),
b AS (SELECT 100 AS n, min(z) AS low, (max(z) - min(z)) / 100 AS width FROM d),"""
    + histogram("z", share="k"),
    "slope_projected": f"WITH {REF}, {SEC}, {EDGE}, {sobel('sec', 'g')} SELECT row, col, {z(slope(), alias='slope')} FROM g",
    "slope_geographic": f"""
WITH {REF}, {EDGE}, {sobel('ref', 'g')},
k AS (SELECT *, greatest(col, 1) AS kc, greatest(row, 1) AS kr FROM g),
l AS (SELECT row, col, gx, gy, radians(0.001 * kc) AS lon1, radians(0.001 * (kc - 1)) AS lon2, radians(-0.001 * row) AS lat, radians(-0.001 * kr) AS lat1, radians(-0.001 * (kr - 1)) AS lat2 FROM k),
m AS (SELECT row, col, gx, gy, 6378137 * acos(least(cos(lat) * cos(lat) * cos(lon1 - lon2) + sin(lat) * sin(lat), 1)) AS dx, 6378137 * acos(least(cos(lat1) * cos(lat2) + sin(lat1) * sin(lat2), 1)) AS dy FROM l)
SELECT row, col, {z('degrees(atan(sqrt(pow(gx / dx, 2) + pow(gy / dy, 2)) / 8))', 4, 'slope')} FROM m""",
    "gradient_aspect": f"WITH {REF}, {EDGE}, {gradient('ref', 'g')} SELECT row, col, {z('sqrt(d_col * d_col + d_row * d_row)', alias='slope')}, {z(f'atan2(-d_col, d_row) + {math.pi!r}', alias='aspect')} FROM g",
    "normals": f"WITH {REF}, {EDGE}, {gradient('ref', 'g')}, n AS (SELECT row, col, -d_col / 100 AS x, -d_row / 100 AS y, sqrt(pow(d_col / 100, 2) + pow(d_row / 100, 2) + 1) AS l FROM g) SELECT row, col, {z('x / l', alias='n_x')}, {z('y / l', alias='n_y')}, {z('1 / l', alias='n_z')} FROM n",
    "angular_diff": f"""
WITH {REF}, {SEC}, {EDGE}, {gradient('ref', 'a')}, {gradient('sec', 'b')},
n AS (SELECT row, col, (a.d_col * b.d_col + a.d_row * b.d_row) / 10000 + 1 AS dot, sqrt(pow(a.d_col / 100, 2) + pow(a.d_row / 100, 2) + 1) * sqrt(pow(b.d_col / 100, 2) + pow(b.d_row / 100, 2) + 1) AS l FROM a JOIN b USING (row, col))
SELECT row, col, {z('acos(abs(CASE WHEN dot / l > 1 THEN 1 WHEN dot / l < -1 THEN -1 ELSE dot / l END))', 4, 'z')} FROM n""",
    "hillshade": f"""
WITH {REF}, {SEC}, {EDGE}, {gradient('sec', 'g')},
a AS (SELECT row, col, z, {math.pi / 2!r} - atan(sqrt(d_row * d_row + d_col * d_col)) AS slope, atan2(-d_row, d_col) AS aspect FROM g)
SELECT row, col, {z(f'CASE WHEN z IS NOT NULL THEN 255 * (sin(radians(45)) * sin(slope) + cos(radians(45)) * cos(slope) * cos(radians(315) - aspect) + 1) / 2 END', 4, 'z')} FROM a""",
    "slope_norm_diff": f"""
WITH {REF}, {SEC}, {EDGE}, {sobel('sec', 'g')},
d AS (SELECT row, col, r.z - s.z AS z, {slope()} / 100 AS alpha FROM ref r JOIN sec s USING (row, col) JOIN g USING (row, col)),
m AS (SELECT min(alpha) AS low, max(alpha) AS high, (max(alpha) - min(alpha)) / 100 AS w FROM d WHERE z IS NOT NULL AND alpha IS NOT NULL),
b AS (SELECT least(ceil((alpha - low) / w) - 1, 99) AS bin, stddev_pop(z) AS s, count(*) AS n FROM d, m WHERE z IS NOT NULL AND alpha > low GROUP BY 1 HAVING count(*) > 1),
f AS (SELECT regr_slope(s, tan(low + bin * w)) AS a, regr_intercept(s, tan(low + bin * w)) AS b FROM b, m),
mu AS (SELECT avg(z) AS mu FROM d)
SELECT row, col, {z('CASE WHEN alpha >= low AND alpha <= high THEN (z - mu) / (1 + b / a * tan(alpha)) END', 4, 'z')} FROM d, m, f, mu""",
    "bilinear_shift": bilinear("row + 2.5", "col + 1.25") + f" SELECT row, col, {z(digits=8)} FROM v",
    "resample_affine": bilinear("(row + 0.5) / 1.5 - 0.5", "(col + 0.5) / 1.5 - 0.5", where="(row + 0.5) / 1.5 <= rm + 1 AND (col + 0.5) / 1.5 <= cm + 1") + f" SELECT r.row, r.col, {z('v.z', 7, 'z')} FROM ref r LEFT JOIN v USING (row, col)",
    "resample_nearest": f"WITH {REF}, {SEC} SELECT r.row, r.col, {z('s.z', alias='z')} FROM ref r LEFT JOIN sec s ON s.row = floor((r.row + 0.5) / 1.4) AND s.col = floor((r.col + 0.5) / 1.4)",
    "nearest_fill": f"WITH {SEC}, {FILLED} SELECT row, col, {z()} FROM filled",
    "geoid_offset": f"WITH {REF} SELECT row, col, {z('z + row / 10.0 * 0.5 - col / 10.0 * 0.25', alias='z')} FROM ref",
    "nk_slices": f"WITH {NK} SELECT slice, n, {z('med', alias='median')} FROM sl",
    "nk_single_iter": f"""
WITH {NK},
x AS (SELECT cos(slice * {math.pi / 36!r}) AS c, sin(slice * {math.pi / 36!r}) AS s, med AS y FROM sl),
q AS (SELECT sum(c * c) AS cc, sum(c * s) AS cs, sum(c) AS c1, sum(s * s) AS ss, sum(s) AS s1, count(*)::DOUBLE AS n, sum(c * y) AS cy, sum(s * y) AS sy, sum(y) AS y1 FROM x),
det AS (SELECT *, cc * (ss * n - s1 * s1) - cs * (cs * n - s1 * c1) + c1 * (cs * s1 - ss * c1) AS det FROM q)
SELECT {z('(cc * (sy * n - s1 * y1) - cy * (cs * n - s1 * c1) + c1 * (cs * y1 - sy * c1)) / det', 3, 'east')},
       {z('(cy * (ss * n - s1 * s1) - cs * (sy * n - s1 * y1) + c1 * (sy * s1 - ss * y1)) / det', 3, 'north')},
       {z('(cc * (ss * y1 - sy * s1) - cs * (cs * y1 - sy * c1) + cy * (cs * s1 - ss * c1)) / det', 3, 'c')} FROM det""",
    "coreg_counts": f"WITH {REF}, {SEC} SELECT 'ref' AS support, count(*) AS nb_points, count(z) AS nb_valid_points, round(count(z) / count(*), 5) AS percentage_valid_points FROM ref UNION ALL SELECT 'sec', count(*), count(z), round(count(z) / count(*), 5) FROM sec",
    "curvature": f"WITH {SMOOTH}, {cosine('smooth')} SELECT row, col, {z(digits=4)} FROM cv",
    "svf": f"WITH {SMOOTH}, {cosine('smooth')}, n AS (SELECT row, col, least(z, 0) AS z FROM cv), q AS (SELECT quantile_cont(z, 0.09) AS a, quantile_cont(z, 0.91) AS b FROM n) SELECT row, col, {z('greatest(least((z - a) / (b - a), 1), 0) * 255', 3, 'z')} FROM n, q",
    "ref_curvature": f"WITH {REF}, {cosine('ref')} SELECT row, col, {z(digits=4)} FROM cv",
    "sec_curvature": f"WITH {SEC}, {FILLED}, {cosine('filled')} SELECT row, col, {z('CASE WHEN s.z IS NOT NULL THEN cv.z END', 4, 'z')} FROM cv JOIN sec s USING (row, col)",
    "ref_labels": f"WITH {REF} SELECT row, col, {z()}, priority AS priority_ref, status AS status_ref FROM ref",
    "crop_labels": f"WITH {REF}, {EDGE} SELECT row - 4 AS row, col, {z()}, priority, status FROM ref, e WHERE row >= 4 AND col < cm + 1 - 3",
    "ratio_by_class": f"WITH {BY_CLASS} SELECT 'standard' AS mode, class_idx, set_name, (i - 1)::BIGINT AS bin, t AS edge, round(avg((z > t)::INT), 5) + 0.0 AS value FROM k JOIN names USING (class_idx), (VALUES (1, 0.5::DOUBLE), (2, 10.0::DOUBLE), (3, 100.0::DOUBLE)) v(i, t) GROUP BY 1, 2, 3, 4, 5",
    "cdf_by_class": by_class("b AS (SELECT class_idx, greatest(floor(max(abs(z)) / 10), 25)::BIGINT AS n, 0.0 AS low, max(abs(z)) / greatest(floor(max(abs(z)) / 10), 25) AS width FROM k GROUP BY 1)", "TRUE", "abs(z)", "sum(c) OVER (PARTITION BY class_idx ORDER BY bin) / sum(c) OVER (PARTITION BY class_idx)"),
    "pdf_by_class": by_class(
        """b0 AS (SELECT class_idx, max(z) AS bound FROM k GROUP BY 1),
b AS (SELECT class_idx, CASE WHEN ceil(2 * bound / 10) >= 25 THEN ceil(2 * bound / 10) - 1 ELSE 25 END::BIGINT AS n, CASE WHEN ceil(2 * bound / 10) >= 25 THEN -bound ELSE -abs(bound) END AS low,
      CASE WHEN ceil(2 * bound / 10) >= 25 THEN 10.0 ELSE 2 * abs(bound) / 25 END AS width FROM b0)""",
        "z >= low AND z <= low + n * width", "z", "c::DOUBLE / sum(c) OVER (PARTITION BY class_idx)",
    ),
    "events_scan": f"""
WITH e AS (SELECT user_id AS row, ts::DATE AS day, value FROM events), s AS (SELECT min(day) AS d0, max(day) AS d1, max(row) AS rm FROM e),
c AS (SELECT row, (day - d0)::BIGINT AS col, avg(value) AS z FROM e, s GROUP BY 1, 2),
g AS (SELECT row, unnest(generate_series(0, (d1 - d0)::BIGINT)) AS col FROM (SELECT unnest(generate_series(0, rm)) AS row, d0, d1 FROM s))
SELECT row, col, {z()} FROM g LEFT JOIN c USING (row, col)""",
}
TILES = """
n AS (SELECT greatest(1, ceil((rm + 1 - 10) / 30.0))::BIGINT AS nr, greatest(1, ceil((cm + 1 - 10) / 20.0))::BIGINT AS nc FROM e),
t AS (SELECT tr AS tile_row, tc AS tile_col FROM (SELECT unnest(generate_series(0, nr - 1)) AS tr, nc FROM n), LATERAL (SELECT unnest(generate_series(0, nc - 1)) AS tc))"""
INSIDE = "row >= tile_row * 30 AND row < tile_row * 30 + 40 AND col >= tile_col * 20 AND col < tile_col * 20 + 30"
ORACLES["tile_assignment"] = f"WITH {REF}, {EDGE}, {TILES} SELECT row, col, tile_row, tile_col FROM ref JOIN t ON {INSIDE}"
ORACLES["tile_stats"] = f"""
WITH {DIFF}, {EDGE}, {TILES}
SELECT tile_row, tile_col, count(*) AS nb_points, {z('count(z) * 100.0 / count(*)', alias='pct_valid')}, {z('avg(z)', alias='mean')}, {z('median(z)', 6, 'median')}
FROM t JOIN d ON {INSIDE} GROUP BY 1, 2"""

# two views of REF's averaged heights
VIEWS = f"""{REF}, {SEC}, {EDGE},
w1 AS MATERIALIZED (SELECT row, col, avg(z) OVER (PARTITION BY row ORDER BY col ROWS BETWEEN 7 PRECEDING AND 7 FOLLOWING) AS z FROM ref),
view_ref AS MATERIALIZED (SELECT row, col, avg(z) OVER (PARTITION BY col ORDER BY row ROWS BETWEEN 7 PRECEDING AND 7 FOLLOWING) AS z FROM w1),
view_sec AS MATERIALIZED (SELECT a.row, a.col, CASE WHEN s.z IS NOT NULL THEN b.z + 3.5 END AS z FROM view_ref a JOIN sec s USING (row, col) LEFT JOIN view_ref b ON b.row = a.row + 1 AND b.col = a.col + 2)"""


def nuth_kaab(parts: str, iterations: int = 6) -> str:
    """CTEs of whole coregistrations, one for each t: `parts` makes a0 (t, row, col, r, z, h, w) of them; the last are st{n} (t, x, y) and p{n} (t, row, col, r, z)."""
    step = repr(math.pi / 36)
    out = [parts, "st0 AS (SELECT DISTINCT t, 0.0::DOUBLE AS x, 0.0::DOUBLE AS y FROM a0)", "p0 AS MATERIALIZED (SELECT * FROM a0)"]
    for k in range(iterations):
        n = k + 1
        out.append(f"""
b{k} AS (SELECT t, median(r - z) AS bias FROM p{k} GROUP BY t),
g{k} AS MATERIALIZED (
  SELECT t, z - (r - bias) AS dh,
         CASE WHEN row = 0 THEN lead(z) OVER c - z WHEN row = h - 1 THEN z - lag(z) OVER c ELSE (lead(z) OVER c - lag(z) OVER c) / 2 END AS d_row,
         CASE WHEN col = 0 THEN lead(z) OVER l - z WHEN col = w - 1 THEN z - lag(z) OVER l ELSE (lead(z) OVER l - lag(z) OVER l) / 2 END AS d_col
  FROM p{k} JOIN b{k} USING (t) WINDOW l AS (PARTITION BY t, row ORDER BY col), c AS (PARTITION BY t, col ORDER BY row)),
s{k} AS (SELECT t, dh / sqrt(d_col * d_col + d_row * d_row) AS v, atan2(-d_col, d_row) + {math.pi!r} AS aspect FROM g{k} WHERE dh IS NOT NULL AND sqrt(d_col * d_col + d_row * d_row) >= 0.001),
i{k} AS MATERIALIZED (SELECT t, floor(aspect / {step})::INT AS slice, v FROM s{k} WHERE aspect > floor(aspect / {step}) * {step} AND aspect / {step} < 72),
o{k} AS (SELECT t, slice, avg(v) AS m, stddev_pop(v) AS s FROM i{k} GROUP BY 1, 2),
m{k} AS MATERIALIZED (SELECT t, cos(slice * {step}) AS c, sin(slice * {step}) AS s, median(v) AS y FROM i{k} JOIN (SELECT t, slice, m, s AS sd FROM o{k}) USING (t, slice) WHERE v >= m - 3 * sd AND v <= m + 3 * sd GROUP BY t, slice),
q{k} AS (SELECT t, sum(c * c) AS cc, sum(c * s) AS cs, sum(c) AS c1, sum(s * s) AS ss, sum(s) AS s1, count(*)::DOUBLE AS n, sum(c * y) AS cy, sum(s * y) AS sy, sum(y) AS y1 FROM m{k} GROUP BY t),
f{k} AS (SELECT *, cc * (ss * n - s1 * s1) - cs * (cs * n - s1 * c1) + c1 * (cs * s1 - ss * c1) AS det FROM q{k}),
st{n} AS MATERIALIZED (SELECT t, x + (cc * (sy * n - s1 * y1) - cy * (cs * n - s1 * c1) + c1 * (cs * y1 - sy * c1)) / det AS x, y + (cy * (ss * n - s1 * s1) - cs * (sy * n - s1 * y1) + c1 * (sy * s1 - ss * y1)) / det AS y FROM st{k} JOIN f{k} USING (t)),
e{k} AS (SELECT a0.*, x, y, CASE WHEN x >= 0 THEN 0 ELSE floor(-x) END::BIGINT AS c_low, CASE WHEN x >= 0 THEN w - ceil(x) ELSE w END::BIGINT AS c_high, CASE WHEN y <= 0 THEN 0 ELSE floor(y) END::BIGINT AS r_low, CASE WHEN y <= 0 THEN h - ceil(-y) ELSE h END::BIGINT AS r_high FROM a0 JOIN st{n} USING (t)),
x{k} AS (SELECT *, least(greatest(row - y, 0), h - 1) AS fy, least(greatest(col + x, 0), w - 1) AS fx FROM e{k} WHERE row >= r_low AND row < r_high AND col >= c_low AND col < c_high),
n{k} AS (SELECT t, row, col, floor(fy)::BIGINT + i AS rr, floor(fx)::BIGINT + j AS cc, CASE i WHEN 0 THEN 1 - (fy - floor(fy)) ELSE fy - floor(fy) END * CASE j WHEN 0 THEN 1 - (fx - floor(fx)) ELSE fx - floor(fx) END AS weight FROM x{k}, (VALUES (0), (1)) a(i), (VALUES (0), (1)) b(j)),
v{k} AS (SELECT n.t, n.row, n.col, CASE WHEN count(a.r) = count(*) THEN sum(weight * a.r) END AS r FROM n{k} n LEFT JOIN a0 a ON a.t = n.t AND a.row = rr AND a.col = cc WHERE weight > 0 GROUP BY 1, 2, 3),
p{n} AS MATERIALIZED (SELECT t, row - r_low AS row, col - c_low AS col, v.r, z, r_high - r_low AS h, c_high - c_low AS w FROM x{k} JOIN v{k} v USING (t, row, col))""")
    return ", ".join(out)


ORACLES["nk_coregistration"] = f"""
WITH {VIEWS}, {nuth_kaab("a0 AS MATERIALIZED (SELECT 0 AS t, row, col, r.z AS r, s.z, rm + 1 AS h, cm + 1 AS w FROM view_ref r JOIN view_sec s USING (row, col), e)")}
SELECT {z('x', alias='dx')}, {z('-y', alias='dy')}, {z('dz')} FROM st6, (SELECT avg(r - z) AS dz FROM p6)"""
TILED = nuth_kaab("""
tc AS (SELECT rm + 1 AS nrows, cm + 1 AS ncols, greatest(1, ceil((rm + 1 - 20) / 40.0))::BIGINT AS nr, greatest(1, ceil((cm + 1 - 20) / 30.0))::BIGINT AS nc FROM e),
tiles AS (SELECT k // nc AS tile_row, k % nc AS tile_col, k AS t, least(60, nrows - 40 * (k // nc)) AS h, least(50, ncols - 30 * (k % nc)) AS w FROM (SELECT unnest(generate_series(0, nr * nc - 1)) AS k, * FROM tc)),
a0 AS MATERIALIZED (SELECT t, row - 40 * tile_row AS row, col - 30 * tile_col AS col, r.z AS r, s.z, h, w FROM view_ref r JOIN view_sec s USING (row, col) JOIN tiles ON row >= 40 * tile_row AND row < 40 * tile_row + 60 AND col >= 30 * tile_col AND col < 30 * tile_col + 50)""")
ORACLES["tile_shifts"] = f"""
WITH {VIEWS}, {TILED},
last AS (SELECT t, avg(r - z) AS d, count(r) * 100.0 / count(*) AS pr, count(z) * 100.0 / count(*) AS ps FROM p6 GROUP BY t)
SELECT tile_row, tile_col, {z('x', alias='dx')}, {z('-y', alias='dy')}, {z('d', alias='dz')}, {z('pr', alias='pct_valid_ref')}, {z('ps', alias='pct_valid_sec')} FROM tiles JOIN st6 USING (t) JOIN last USING (t)"""
ORACLES["tile_comparison"] = f"""
WITH {VIEWS}, {TILED}
SELECT tile_row, tile_col, {z('round(avg(r - z), 5)', 4, 'mean')}, {z('round(median(r - z), 5)', 4, 'median')}, {z('round(stddev_pop(r - z), 5)', 4, 'std')}, count(r - z) AS nbpts, round(count(r - z) * 100.0 / count(*), 5) AS percent_valid_points
FROM p6 JOIN tiles USING (t) GROUP BY 1, 2"""

ORACLES["raster_scan"] = f"WITH {SEC} SELECT row, col, {z()} FROM sec"
ORACLES["raster_region"] = f"WITH {REF} SELECT row - 2 AS row, col - 35 AS col, {z()}, {z('priority::DOUBLE', alias='priority')} FROM ref WHERE row BETWEEN 2 AND 131 AND col BETWEEN 35 AND 84"


def to_utm(source: str, lon: str, lat: str) -> str:
    """CTEs that end in utm: row, col, x, y in zone 31 of columns of a table."""
    n, radius, alpha, _, _ = series(WGS84[1])
    e, size = 2 * math.sqrt(n) / (1 + n), SCALE * WGS84[0] * radius
    x = " + ".join(["eta", *[f"{c!r} * cos({2 * k} * xi) * (exp({2 * k} * eta) - exp(-{2 * k} * eta)) / 2" for k, c in enumerate(alpha, 1)]])
    y = " + ".join(["xi", *[f"{c!r} * sin({2 * k} * xi) * (exp({2 * k} * eta) + exp(-{2 * k} * eta)) / 2" for k, c in enumerate(alpha, 1)]])
    return f"""
u1 AS (SELECT row, col, sin(radians({lat})) AS s, radians({lon} - 3) AS l FROM {source}),
u2 AS (SELECT row, col, l, sinh(atanh(s) - {e!r} * atanh({e!r} * s)) AS t FROM u1),
u3 AS (SELECT row, col, atan2(t, cos(l)) AS xi, asinh(sin(l) / sqrt(t * t + cos(l) * cos(l))) AS eta FROM u2),
utm AS (SELECT row, col, {size!r} * ({x}) + 500000 AS x, {size!r} * ({y}) AS y FROM u3)"""


def to_lonlat(source: str, x: str, y: str) -> str:
    """CTEs that end in lonlat: row, col, lon, lat of columns of a table in zone 31."""
    _, radius, _, beta, delta = series(WGS84[1])
    size = SCALE * WGS84[0] * radius
    u = " - ".join(["xi", *[f"{c!r} * sin({2 * k} * xi) * cosh({2 * k} * eta)" for k, c in enumerate(beta, 1)]])
    v = " - ".join(["eta", *[f"{c!r} * cos({2 * k} * xi) * sinh({2 * k} * eta)" for k, c in enumerate(beta, 1)]])
    lat = " + ".join(["chi", *[f"{c!r} * sin({2 * k} * chi)" for k, c in enumerate(delta, 1)]])
    return f"""
l1 AS (SELECT row, col, ({y}) / {size!r} AS xi, (({x}) - 500000) / {size!r} AS eta FROM {source}),
l2 AS (SELECT row, col, {u} AS u, {v} AS v FROM l1),
l3 AS (SELECT row, col, u, v, asin(sin(u) / cosh(v)) AS chi FROM l2),
lonlat AS (SELECT row, col, degrees(atan2(sinh(v), cos(u))) + 3 AS lon, degrees({lat}) AS lat FROM l3)"""


ORACLES["to_lonlat"] = f"WITH {REF}, {to_lonlat('ref', '450000 + 1000 * col', '5000000 - 1000 * row')} SELECT row, col, {z('lon', 8)}, {z('lat', 8)} FROM lonlat"
ORACLES["from_lonlat"] = f"WITH {SEC}, {to_utm('sec', '2.3 + 0.01 * col', '45.2 - 0.01 * row')} SELECT row, col, {z('x', 4)}, {z('y', 4)} FROM utm"
_pixels = "px AS (SELECT row, col, (lon - 2.3) / 0.01 AS x, (45.2 - lat) / 0.01 AS y FROM lonlat)"
ORACLES["warp"] = (
    bilinear("y - 0.5", "x - 0.5", where="x >= 0 AND y >= 0 AND x <= cm + 1 AND y <= rm + 1").replace("FROM ref, e WHERE", "FROM px, e WHERE").replace("\np AS", f"{to_lonlat('ref', '450000 + 1000 * (col + 0.5)', '5000000 - 1000 * (row + 0.5)')}, {_pixels},\np AS")
    + f" SELECT r.row, r.col, {z('v.z', 3, 'z')} FROM ref r LEFT JOIN v USING (row, col)"
)
ORACLES["geoid_lonlat"] = f"WITH {REF}, {to_lonlat('ref', '450000 + 1000 * col', '5000000 - 1000 * row')} SELECT row, col, {z('z + (46 - lat) * 0.5 - lon * 0.25', alias='z')} FROM ref JOIN lonlat USING (row, col)"

_places = lambda m: "::DECIMAL(18, 5), 2)::DOUBLE" if m in ("sum", "squared_sum") else ", 5)"
_columns = ", ".join(f"round(round({METRICS[m].format(z='z')}, 5){_places(m)} + 0.0 AS {m}" for m in METRICS)
ORACLES["stats_by_tile"] = f"""
WITH {DIFF}, {EDGE},
every AS (SELECT unnest(generate_series(0, greatest(1, ceil(rm / 3.0))::BIGINT - 1)) AS tile_row, nc FROM (SELECT rm, greatest(1, ceil(cm / 3.0))::BIGINT AS nc FROM e)),
tiles AS (SELECT tile_row, unnest(generate_series(0, nc - 1)) AS tile_col FROM every),
p AS (SELECT tile_row, tile_col, z / 1.609344 AS z, {PR} AS class_idx, ({PR}) IS NOT DISTINCT FROM ({PS}) AS agree FROM tiles JOIN d ON row BETWEEN 3 * tile_row AND 3 * tile_row + 3 AND col BETWEEN 3 * tile_col AND 3 * tile_col + 3),
total AS (SELECT tile_row, tile_col, count(*) AS total FROM p GROUP BY ALL),
k AS (SELECT tile_row, tile_col, z, class_idx, 'standard' AS mode FROM p UNION ALL SELECT tile_row, tile_col, z, class_idx, CASE WHEN agree THEN 'intersection' ELSE 'exclusion' END FROM p),
c AS (SELECT *, avg(z) OVER w AS mu, median(z) OVER w AS md FROM k WINDOW w AS (PARTITION BY tile_row, tile_col, mode, class_idx)),
s AS (SELECT tile_row, tile_col, mode, class_idx, count(z) AS nbpts, {_columns} FROM c GROUP BY ALL),
n AS (SELECT * FROM (VALUES {', '.join(f"({k}, '{n}:{v}')" for k, (n, v) in enumerate(SEGMENTS))}) a(class_idx, set_name), (VALUES ('standard'), ('intersection'), ('exclusion')) b(mode)),
grid AS (SELECT * FROM total, n)
SELECT tile_row, tile_col, mode, class_idx, set_name, {', '.join(METRICS)}, coalesce(nbpts, 0) AS nbpts, round(coalesce(nbpts, 0) * 100.0 / total, 5) AS percent_valid_points
FROM grid LEFT JOIN s USING (tile_row, tile_col, mode, class_idx)"""

_pi = repr(math.pi)
_angle = lambda k, x, n: f"2 * {_pi} * (({k} * {x}) % {n}) / {n}"
# the transform as sums of sines and cosines along rows, then columns, and back
ORACLES["curvature_plain"] = f"""
WITH {SMOOTH},
dim AS (SELECT max(row) + 1 AS h, max(col) + 1 AS w FROM smooth),
rs AS (SELECT unnest(generate_series(0, h - 1)) AS k FROM dim),
cs AS (SELECT unnest(generate_series(0, w - 1)) AS k FROM dim),
f1 AS MATERIALIZED (SELECT row, k AS kc, sum(z * cos({_angle('k', 'col', 'w')})) AS re, -sum(z * sin({_angle('k', 'col', 'w')})) AS im FROM smooth, cs, dim GROUP BY 1, 2),
f2 AS MATERIALIZED (SELECT kc, k AS kr, sum(re * cos({_angle('k', 'row', 'h')}) + im * sin({_angle('k', 'row', 'h')})) AS re, sum(im * cos({_angle('k', 'row', 'h')}) - re * sin({_angle('k', 'row', 'h')})) AS im FROM f1, rs, dim GROUP BY 1, 2),
f3 AS MATERIALIZED (SELECT kc, kr, pow(pow(2 * {_pi} * least(kr, h - kr) / h, 2) + pow(2 * {_pi} * least(kc, w - kc) / w, 2), 0.45) / (h * w) AS g, re * g AS re, im * g AS im FROM f2, dim),
f4 AS MATERIALIZED (SELECT kc, k AS row, sum(re * cos({_angle('k', 'kr', 'h')}) - im * sin({_angle('k', 'kr', 'h')})) AS re, sum(im * cos({_angle('k', 'kr', 'h')}) + re * sin({_angle('k', 'kr', 'h')})) AS im FROM f3, rs, dim GROUP BY 1, 2)
SELECT row, k AS col, {z(f"sum(re * cos({_angle('k', 'kc', 'w')}) - im * sin({_angle('k', 'kc', 'w')}))", 4, 'z')} FROM f4, cs, dim GROUP BY 1, 2"""
ORACLES["spatial_freq"] = f"""
WITH n AS (SELECT max(o_orderkey) // 100 AS h FROM orders), g AS (SELECT unnest(generate_series(0, h - 1)) AS row, h FROM n), c AS (SELECT row, h, unnest(generate_series(0, 98)) AS col FROM g),
f AS (SELECT row, col, (row - h // 2) * 2 * {_pi} / h AS f_row, (col - 49) * 2 * {_pi} / 99 AS f_col FROM c)
SELECT row, col, {z('f_row', 9)}, {z('f_col', 9)}, {z('pow(f_row * f_row + f_col * f_col, 0.45)', 9, 'weight')} FROM f"""
for _name, _of in (("alti_diff_blocks", "alti_diff"), ("slope_blocks", "slope_projected"), ("normals_blocks", "normals"), ("hillshade_blocks", "hillshade")):
    ORACLES[_name] = ORACLES[_of]  # another way to the same pixels

ORACLES["cube_band"] = f"WITH {SEC} SELECT row, col, {z()} FROM sec"
ORACLES["cube_index"] = f"WITH {DIFF}, p AS (SELECT row, col, r.z AS a, s.z AS b FROM ref r JOIN sec s USING (row, col)) SELECT row, col, {z('CASE WHEN a + b <> 0 THEN (a - b) / (a + b) END', 7, 'z')} FROM p"
ORACLES["cube_stats"] = f"""
WITH {REF}, {SEC}, b AS (SELECT 1 AS band, 'height' AS name, z FROM ref UNION ALL SELECT 2, 'priority', priority FROM ref UNION ALL SELECT 3, 'other', z FROM sec)
SELECT band, name, count(z) AS n, {z('avg(z)', alias='mean')}, {z('stddev_pop(z)', alias='std')}, {z('min(z)', alias='min')}, {z('max(z)', alias='max')} FROM b GROUP BY 1, 2"""


def _bound(points: str, value: str, name: str) -> str:
    """CTE: the interpolated median of weighted points by class."""
    return f"""
{name}_1 AS (SELECT class_idx, {value} AS v, sum(n) OVER (PARTITION BY class_idx ORDER BY {value} ROWS UNBOUNDED PRECEDING) AS upto, sum(n) OVER (PARTITION BY class_idx) AS total FROM {points}),
{name} AS (SELECT class_idx, min(v) FILTER (upto > floor((total - 1) / 2.0)) + (min(v) FILTER (upto > ceil((total - 1) / 2.0)) - min(v) FILTER (upto > floor((total - 1) / 2.0))) * (any_value(total) - 1) % 2 / 2.0 AS {name} FROM {name}_1 GROUP BY 1)"""


ORACLES["order_bounds"] = f"""
WITH {DIFF},
v AS (SELECT pr AS class_idx, z, CASE WHEN z = 0 THEN 0 ELSE sign(z) * (floor(log2(abs(z)) * 16) + 17600) END AS cell FROM d WHERE z IS NOT NULL),
t AS MATERIALIZED (SELECT class_idx, cell, count(*) AS n, min(z) AS lo, max(z) AS hi FROM v GROUP BY 1, 2),
{_bound('t', 'lo', 'median_low')}, {_bound('t', 'hi', 'median_high')},
q AS (SELECT class_idx, n, 1.4826 * greatest(0, lo - median_high, median_low - hi) AS near, 1.4826 * greatest(hi - median_low, median_high - lo) AS far FROM t JOIN median_low USING (class_idx) JOIN median_high USING (class_idx)),
{_bound('q', 'near', 'nmad_low')}, {_bound('q', 'far', 'nmad_high')},
c AS (SELECT class_idx, sum(n)::BIGINT AS nbpts FROM t GROUP BY 1)
SELECT class_idx, nbpts, {z('median_low')}, {z('median_high')}, {z('nmad_low')}, {z('nmad_high')} FROM c JOIN median_low USING (class_idx) JOIN median_high USING (class_idx) JOIN nmad_low USING (class_idx) JOIN nmad_high USING (class_idx)"""

_moved = bilinear("row + 2.5", "col + 1.25").replace("s.z", "s.{c}").replace(" sec s ON", " ref s ON")
_planes = [f"({_moved.replace('{c}', c)} SELECT row, col, {z('z', 8, c)} FROM v)" for c in ("z", "priority", "status")]
ORACLES["shifted_labels"] = f"SELECT row, col, a.z, b.priority, c.status FROM {_planes[0]} a JOIN {_planes[1]} b USING (row, col) JOIN {_planes[2]} c USING (row, col)"
_kept = ("mean", "median", "max", "min", "std")
ORACLES["whole_run"] = f"""
WITH {DIFF},
p AS (SELECT z, {PR} AS class_idx, ({PR}) IS NOT DISTINCT FROM ({PS}) AS agree FROM d),
k AS (
  SELECT 'global' AS layer, 'standard' AS mode, 0 AS class_idx, z FROM p
  UNION ALL SELECT 'priority', 'standard', class_idx, z FROM p
  UNION ALL SELECT 'priority', CASE WHEN agree THEN 'intersection' ELSE 'exclusion' END, class_idx, z FROM p),
s AS (SELECT layer, mode, class_idx, {', '.join(f"round({METRICS[m].format(z='z')}, 5) AS {m}" for m in _kept)}, count(z)::DOUBLE AS nbpts, round(count(z) * 100.0 / (SELECT count(*) FROM orders), 5) AS percent_valid_points FROM k GROUP BY ALL),
u AS (UNPIVOT s ON {', '.join(_kept)}, nbpts, percent_valid_points INTO NAME metric VALUE value)
SELECT 'alti-diff' AS method, layer, mode, class_idx, CASE WHEN layer = 'global' THEN 'global:1' ELSE set_name END AS set_name, metric, value + 0.0 AS value
FROM u JOIN (VALUES {', '.join(f"({k}, '{n}:{v}')" for k, (n, v) in enumerate(SEGMENTS))}) n(class_idx, set_name) USING (class_idx)"""
