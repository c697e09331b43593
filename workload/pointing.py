"""Queries over prompts: lines, regions, endpoints, target choice, prompt-aware filtering."""

from __future__ import annotations

from pyspark.sql import functions as F

from voxtally.functions import geometry as geo
from voxtally.operators import components as cc
from voxtally.operators import prompts as pr
from voxtally.operators import select as sel
from voxtally.operators import targets as tg
from workload import fixtures as fx
from workload.oracle_parts import PARTS
from workload.registry import query, rounded


def line_part(name: str, prompts: str, radius: int, thick: int, keys: str = "case_id", shift: bool = False) -> None:
    def end(e: str, dim: str, part: str) -> str:
        moved = f'"{e}"' + (f" + greatest({dim} // {part})" if shift else "")
        return f'greatest(0, least({moved}, {dim} - 1)) AS "{e}"'

    parts = {"x": ("nx", "4, 2"), "y": ("ny", "5, 2"), "z": ("nz", "6, 1")}
    ends = ", ".join(end(f"{s}{a}", *parts[a]) for s in "ab" for a in "xyz")
    PARTS[name] = ([prompts], f"""SELECT DISTINCT {keys}, CAST(cz + i AS INT) AS z, CAST(py + j AS INT) AS y, CAST(px + k AS INT) AS x FROM (
      SELECT {keys}, nz, ny, nx, CAST(round_even((az + bz) / 2, 0) AS INT) AS cz,
        CAST(round_even(CAST(CAST(ay AS FLOAT) + t * CAST("by" - ay AS FLOAT) AS DOUBLE), 0) AS INT) AS py,
        CAST(round_even(CAST(CAST(ax AS FLOAT) + t * CAST(bx - ax AS FLOAT) AS DOUBLE), 0) AS INT) AS px
      FROM (SELECT *, CAST(step * (1.0::DOUBLE / steps) AS FLOAT) AS t FROM (
        SELECT *, unnest(range(0, steps + 1)) AS step FROM (
          SELECT *, greatest(CAST(ceil(2 * sqrt(pow(bx - ax, 2) + pow("by" - ay, 2))) AS INT), 1) AS steps
          FROM (SELECT {keys}, nz, ny, nx, {ends} FROM {prompts}))))) q,
      range(-{thick}, {thick + 1}) a(i), range(-{radius}, {radius + 1}) b(j), range(-{radius}, {radius + 1}) c(k)
      WHERE j*j + k*k <= {radius * radius} AND cz + i BETWEEN 0 AND nz - 1 AND py + j BETWEEN 0 AND ny - 1 AND px + k BETWEEN 0 AND nx - 1""")


line_part("line2", "case_prompts", 2, 0)
line_part("line2_wrong", "case_prompts", 2, 0, shift=True)
line_part("tube", "case_prompts", 6, 1)
line_part("line0_all", "prompts", 0, 0, "case_id, prompt")
PARTS["gauss25"] = (["case_prompts"], """SELECT case_id, CAST(z AS INT) AS z, CAST(y AS INT) AS y, CAST(x AS INT) AS x, g AS gauss FROM (SELECT *,
  greatest(exp(-(pow(z - az, 2) + pow(y - ay, 2) + pow(x - ax, 2)) / 8), exp(-(pow(z - bz, 2) + pow(y - "by", 2) + pow(x - bx, 2)) / 8)) AS g
  FROM (SELECT *, unnest(range(0, 24)) AS z FROM case_prompts) p, range(0, 50) b(y), range(0, 50) c(x)
  WHERE (abs(z - az) <= 4 AND abs(y - ay) <= 4 AND abs(x - ax) <= 4) OR (abs(z - bz) <= 4 AND abs(y - "by") <= 4 AND abs(x - bx) <= 4)) WHERE g > 0.25""")
PARTS["region"] = (["line2", "gauss25"], "SELECT case_id, z, y, x FROM line2 UNION SELECT case_id, z, y, x FROM gauss25")


@query("rasterize_line", ["line0_all"], "SELECT * FROM line0_all")
def rasterize_line(spark, d):
    return pr.rasterize_line(fx.prompts(spark, d), radius=0, keys=("case_id", "prompt"))


@query("rasterize_tube", ["tube"], "SELECT * FROM tube")
def rasterize_tube(spark, d):
    return pr.tube_region(fx.case_prompts(spark, d))


@query("endpoint_gaussian", ["gt", "case_prompts"], """SELECT case_id, z, y, x, g.label, round(greatest(
  exp(-(pow(z - az, 2) + pow(y - ay, 2) + pow(x - ax, 2)) / 8), exp(-(pow(z - bz, 2) + pow(y - "by", 2) + pow(x - bx, 2)) / 8)), 6) AS gauss
  FROM gt g JOIN case_prompts USING (case_id)""")
def endpoint_gaussian(spark, d):
    return rounded(pr.endpoint_gaussian(fx.gt(spark, d), fx.case_prompts(spark, d)))


@query("prompt_region", ["region"], "SELECT * FROM region")
def prompt_region(spark, d):
    return pr.prompt_region(fx.case_prompts(spark, d))


@query("prompt_region_wrong", ["line2_wrong"], "SELECT * FROM line2_wrong")
def prompt_region_wrong(spark, d):
    return pr.rasterize_line(geo.shift_to_wrong_place(fx.case_prompts(spark, d)))


@query("prompt_channels", ["line2", "case_prompts"], """SELECT case_id, z, y,
    sum(CASE WHEN l.x IS NULL THEN 0 ELSE v.x + 1 END)::DOUBLE AS line, round(sum(g), 6) AS gauss FROM (
  SELECT *, greatest(exp(-(pow(z - az, 2) + pow(y - ay, 2) + pow(x - ax, 2)) / 8), exp(-(pow(z - bz, 2) + pow(y - "by", 2) + pow(x - bx, 2)) / 8)) AS g
  FROM case_prompts, range(0, 24) a(z), range(0, 50) b(y), range(0, 50) c(x)) v LEFT JOIN line2 l USING (case_id, z, y, x) GROUP BY 1, 2, 3""")
def prompt_channels(spark, d):
    prompts = fx.case_prompts(spark, d)
    # a number of its own, since few bytes become many lines
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    lines = prompts.selectExpr("case_id", "nx", "ny", "explode(sequence(0, nz - 1)) AS z").repartition(parts, "case_id", "z").selectExpr(
        "case_id", "z", "explode(sequence(0, ny - 1)) AS y", "array_repeat(0D, nx) AS vals")
    both = pr.prompt_channels(lines, prompts)
    return rounded(both.selectExpr(
        "case_id", "z", "y", "aggregate(transform(line, (v, x) -> v * (x + 1)), 0D, (a, v) -> a + v) AS line",
        "aggregate(gauss, 0D, (a, v) -> a + v) AS gauss"))


@query("wrong_prompt_shift", ["prompts"], """SELECT case_id, prompt, least(ax + 12, 49) AS ax, least(ay + 10, 49) AS ay, least(az + 4, 23) AS az,
  least(bx + 12, 49) AS bx, least("by" + 10, 49) AS "by", least(bz + 4, 23) AS bz, abs(az - bz) AS spread FROM prompts""")
def wrong_prompt_shift(spark, d):
    return geo.shift_to_wrong_place(fx.prompts(spark, d)).select("case_id", "prompt", *geo.ENDS, geo.slice_spread().alias("spread"))


@query("endpoint_box", ["case_prompts"], """SELECT case_id, CAST(greatest(az - 1, 0) AS INT) AS box_z0, CAST(least(az + 2, 24) AS INT) AS box_z1,
  CAST(greatest(least(ay, "by") - 8, 0) AS INT) AS box_y0, CAST(least(greatest(ay, "by") + 9, 50) AS INT) AS box_y1,
  CAST(greatest(ax - 8, 0) AS INT) AS box_x0, CAST(least(bx + 9, 50) AS INT) AS box_x1 FROM case_prompts""")
def endpoint_box(spark, d):
    boxes = geo.endpoint_box(fx.case_prompts(spark, d), (1, 8, 8))
    return boxes.select("case_id", *[f"box_{a}{i}" for a in "zyx" for i in (0, 1)])


# Farthest in-slice pair of every group, weighing all pairs.
def endpoints_sql(source: str, keys: str) -> str:
    on = " AND ".join(f"a.{k.strip()} = b.{k.strip()}" for k in keys.split(","))
    return f"""(SELECT {keys}, slice, marker_voxels, ax, ay, az, bx, "by", bz FROM (
      SELECT {', '.join('a.' + k.strip() for k in keys.split(','))}, a.z AS slice, a.total AS marker_voxels, a.x::DOUBLE AS ax, a.y::DOUBLE AS ay, a.z::DOUBLE AS az,
        b.x::DOUBLE AS bx, b.y::DOUBLE AS "by", b.z::DOUBLE AS bz,
        row_number() OVER (PARTITION BY {', '.join('a.' + k.strip() for k in keys.split(','))} ORDER BY (a.x-b.x)*(a.x-b.x) + (a.y-b.y)*(a.y-b.y) DESC, a.y, a.x, b.y, b.x) AS rn
      FROM peak_{source} a JOIN peak_{source} b ON {on}) WHERE rn = 1)"""


def peak_part(source: str, keys: str) -> None:
    PARTS[f"peak_{source}"] = ([source], f"""SELECT s.*, total FROM {source} s JOIN (
      SELECT {keys}, z, total FROM (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY n DESC, z) AS rn, sum(n) OVER (PARTITION BY {keys}) AS total
        FROM (SELECT {keys}, z, count(*) AS n FROM {source} GROUP BY {keys}, z)) WHERE rn = 1) USING ({keys}, z)""")


peak_part("marker", "case_id, label")
peak_part("gt", "case_id, label")
peak_part("gt_comp", "case_id, label, component_id")
PARTS["marker_ends"] = (["peak_marker"], "SELECT * FROM " + endpoints_sql("marker", "case_id, label"))
PARTS["comp_ends"] = (["peak_gt_comp"], "SELECT * FROM " + endpoints_sql("gt_comp", "case_id, label, component_id"))


@query("derive_endpoints", ["marker_ends"], "SELECT * FROM marker_ends")
def derive_endpoints(spark, d):
    return pr.derive_endpoints(cc.mask_runs(fx.marker(spark, d)), ("case_id", "label"))


@query("farthest_pair", ["peak_gt"], f"""SELECT case_id, label, slice, pow(ax - bx, 2) + pow(ay - "by", 2) AS d2, ax, ay, bx, "by" FROM {endpoints_sql('gt', 'case_id, label')}""")
def farthest_pair(spark, d):
    ends = pr.derive_endpoints(cc.mask_runs(fx.gt(spark, d)), ("case_id", "label"))
    return ends.selectExpr("case_id", "label", "slice", "pow(ax - bx, 2) + pow(ay - by, 2) AS d2", "ax", "ay", "bx", "by")


@query("component_records", ["comp_ends"], """SELECT CASE WHEN count(*) OVER (PARTITION BY case_id) <= 1 THEN case_id::VARCHAR
  ELSE case_id || '__label' || label || '_component' || component_id END AS record_id, case_id, label, component_id, ax, ay, az, bx, "by", bz, slice,
  'derived_from_gt_component' AS prompt_source, marker_voxels AS target_voxel_count FROM comp_ends""")
def component_records(spark, d):
    runs = cc.component_runs(fx.gt(spark, d))
    return tg.component_records(runs, pr.derive_endpoints(runs, ("case_id", "label", "component_id")))


PARTS["named_marker"] = (["marker_comp"], """SELECT m.*, 'recist' || CASE WHEN v.n_values > 1 THEN label::VARCHAR ELSE '' END || CASE WHEN v2.n > 1 THEN '_component' || component_id ELSE '' END AS suffix,
    v.total AS component_count FROM marker_comp m JOIN (SELECT case_id, label, max(component_id) AS n FROM marker_comp GROUP BY 1, 2) v2 USING (case_id, label)
  JOIN (SELECT case_id, count(DISTINCT label) AS n_values, count(DISTINCT (label, component_id)) AS total FROM marker_comp GROUP BY 1) v USING (case_id)""")
PARTS["marker_hits"] = (["named_marker", "gt_comp"], """SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY case_id, suffix ORDER BY overlap DESC, voxel_count DESC, label, component_id) AS rn
  FROM (SELECT g.case_id, suffix, g.label, g.component_id, count(*) AS overlap FROM named_marker m JOIN gt_comp g USING (case_id, z, y, x) GROUP BY ALL)
  JOIN (SELECT case_id, label, component_id, count(*) AS voxel_count FROM gt_comp GROUP BY ALL) USING (case_id, label, component_id)) WHERE rn = 1""")


@query("marker_components", ["named_marker"], "SELECT * FROM named_marker")
def marker_components(spark, d):
    return cc.runs_to_voxels(pr.marker_components(fx.marker(spark, d)))


@query("marker_to_target", ["marker_hits"], "SELECT case_id, suffix, label, component_id, overlap, voxel_count FROM marker_hits")
def marker_to_target(spark, d):
    return tg.marker_to_target(pr.marker_components(fx.marker(spark, d)), cc.component_runs(fx.gt(spark, d)))


peak_part("named_marker", "case_id, suffix, component_count")


@query("marker_records", ["peak_named_marker", "marker_hits"], f"""SELECT CASE WHEN component_count <= 1 THEN case_id::VARCHAR ELSE case_id || '__' || suffix END AS record_id,
  case_id, ax, ay, az, bx, "by", bz, slice, CASE WHEN component_count <= 1 THEN 'recist' ELSE 'recist_component' END AS prompt_source, label AS target_label,
  component_id AS target_component, voxel_count AS target_voxel_count FROM {endpoints_sql('named_marker', 'case_id, suffix, component_count')} e
  LEFT JOIN marker_hits USING (case_id, suffix)""")
def marker_records(spark, d):
    marks = pr.marker_components(fx.marker(spark, d))
    ends = pr.derive_endpoints(marks, ("case_id", "suffix", "component_count"))
    return tg.marker_records(ends, tg.marker_to_target(marks, cc.component_runs(fx.gt(spark, d))))


@query("endpoint_records", ["prompts"], """SELECT CASE WHEN count(*) OVER (PARTITION BY case_id) = 1 THEN case_id::VARCHAR ELSE
  case_id || '__recist_endpoint' || row_number() OVER (PARTITION BY case_id ORDER BY prompt) END AS record_id, case_id, ax, ay, az, bx, "by", bz,
  CAST(round_even((az + bz) / 2, 0) AS INT) AS slice FROM prompts""")
def endpoint_records(spark, d):
    ends = F.array(F.array("ax", "ay", "az"), F.array("bx", "by", "bz"))
    sets = fx.prompts(spark, d).groupBy("case_id").agg(F.array_sort(F.collect_list(F.struct("prompt", ends.alias("e")))).alias("s"))
    return tg.endpoint_records(sets.select("case_id", geo.endpoint_sets(F.col("s.e")).alias("sets")))


PARTS["touch"] = (["prompts", "line0_all", "gt"], """SELECT p.*, g.label FROM (
    SELECT case_id, prompt, CAST(round_even(az, 0) AS INT) AS z, CAST(round_even(ay, 0) AS INT) AS y, CAST(round_even(ax, 0) AS INT) AS x, 0 AS kind FROM prompts UNION ALL
    SELECT case_id, prompt, CAST(round_even(bz, 0) AS INT), CAST(round_even("by", 0) AS INT), CAST(round_even(bx, 0) AS INT), 0 FROM prompts UNION ALL
    SELECT l.case_id, l.prompt, l.z, l.y, l.x, 1 FROM line0_all l JOIN prompts p ON p.case_id = l.case_id AND p.prompt = l.prompt AND p.slice = l.z) p
  JOIN gt g USING (case_id, z, y, x)""")


@query("labels_at_endpoints", ["touch"], """SELECT case_id, prompt, list_sort(coalesce(list(DISTINCT label) FILTER (kind = 0), [])) AS labels_at_endpoints,
  list_sort(coalesce(list(DISTINCT label) FILTER (kind = 1), [])) AS labels_on_line FROM touch GROUP BY 1, 2""")
def labels_at_endpoints(spark, d):
    return tg.prompt_labels(fx.prompts(spark, d), cc.mask_runs(fx.gt(spark, d)))


PARTS["candidates"] = (["gt_comp", "prompts", "touch"], """SELECT c.*, coalesce(t.line_overlap, 0) AS line_overlap, coalesce(t.endpoint_hits, 0) AS endpoint_hits,
    coalesce(max(t.endpoint_hits > 0) OVER (PARTITION BY c.case_id, c.prompt, c.label), false) AS endpoint_label_hit,
    coalesce(max(t.line_overlap > 0) OVER (PARTITION BY c.case_id, c.prompt, c.label), false) AS line_label_hit,
    count(*) OVER (PARTITION BY c.case_id, c.prompt) AS component_candidate_count
  FROM (SELECT case_id, prompt, g.label, component_id, count(*) AS voxel_count, min(abs(z - slice)) AS slice_distance, p.slice,
      (coalesce(min(sqrt(pow(z - az, 2) + pow(y - ay, 2) + pow(x - ax, 2))) FILTER (z = slice), min(sqrt(pow(z - az, 2) + pow(y - ay, 2) + pow(x - ax, 2))))
      + coalesce(min(sqrt(pow(z - bz, 2) + pow(y - "by", 2) + pow(x - bx, 2))) FILTER (z = slice), min(sqrt(pow(z - bz, 2) + pow(y - "by", 2) + pow(x - bx, 2))))) / 2 AS endpoint_distance
    FROM gt_comp g JOIN prompts p USING (case_id) GROUP BY ALL) c
  LEFT JOIN (SELECT case_id, prompt, g.label, g.component_id, count(*) FILTER (kind = 1) AS line_overlap, count(*) FILTER (kind = 0) AS endpoint_hits
    FROM touch t JOIN gt_comp g USING (case_id, z, y, x) GROUP BY 1, 2, 3, 4) t USING (case_id, prompt, label, component_id)""")
PARTS["instances"] = (["candidates"], """SELECT *, CASE WHEN endpoint_label_hit THEN 'direct_endpoint_label_hit' WHEN line_label_hit OR line_overlap > 0 OR endpoint_hits > 0
    THEN 'recist_line_match' ELSE 'nearest_component_fallback' END AS selection_mode FROM (SELECT *, row_number() OVER (PARTITION BY case_id, prompt ORDER BY
    endpoint_label_hit DESC, line_label_hit DESC, line_overlap DESC, endpoint_hits DESC, round(endpoint_distance, 9), slice_distance, voxel_count DESC, label, component_id) AS rn
  FROM candidates) WHERE rn = 1""")


@query("select_target_instance", ["instances", "gt"], """SELECT case_id, prompt, slice, component_candidate_count, n AS positive_label_count, label, component_id, voxel_count,
  line_overlap, endpoint_hits, round(endpoint_distance, 6) AS endpoint_distance, slice_distance, endpoint_label_hit, line_label_hit, selection_mode,
  selection_mode = 'nearest_component_fallback' AS used_fallback FROM instances JOIN (SELECT case_id, count(DISTINCT label) AS n FROM gt GROUP BY 1) USING (case_id)""")
def select_target_instance(spark, d):
    return rounded(tg.select_target_instance(fx.prompts(spark, d), cc.component_runs(fx.gt(spark, d))))


def _records(spark, d):
    """Three of four records name their label, one of four also a component that may not exist."""
    return fx.prompts(spark, d).selectExpr(
        "case_id", "prompt", "if(prompt % 4 = 0, null, label) AS target_label", "if(prompt % 4 = 1, prompt, null) AS target_component"
    )


PARTS["resolved"] = (["prompts", "instances", "gt_comp"], """, named AS (SELECT p.case_id, prompt, p.label, CASE WHEN prompt % 4 = 1 THEN prompt END AS component_id, count(*) AS voxel_count,
    'manifest_target_label' AS selection_mode FROM prompts p JOIN gt_comp g ON g.case_id = p.case_id AND g.label = p.label
    AND (prompt % 4 <> 1 OR g.component_id = prompt) WHERE prompt % 4 <> 0 GROUP BY ALL)
  SELECT * FROM named UNION ALL SELECT case_id, prompt, label, component_id, voxel_count, selection_mode FROM instances i
  WHERE NOT EXISTS (SELECT 1 FROM named n WHERE n.case_id = i.case_id AND n.prompt = i.prompt)""".replace(", named AS", "WITH named AS", 1))


@query("resolve_case_target", ["resolved"], "SELECT * FROM resolved")
def resolve_case_target(spark, d):
    return tg.resolve_targets(_records(spark, d), fx.prompts(spark, d), cc.component_runs(fx.gt(spark, d)))


# ---- prompt-aware filtering ---------------------------------------------------------------------------------------------

KEYS = ("case_id", "prompt")
PARTS["tilted"] = (["prompts"], 'SELECT * REPLACE ("by" + prompt % 4 AS "by") FROM prompts')
line_part("line2_all", "tilted", 2, 0, "case_id, prompt")
line_part("tube_all", "tilted", 6, 1, "case_id, prompt")
PARTS["gauss25_all"] = (["tilted"], """SELECT DISTINCT case_id, prompt, CAST(ez + i AS INT) AS z, CAST(ey + j AS INT) AS y, CAST(ex + k AS INT) AS x FROM (
    SELECT case_id, prompt, az AS ez, ay AS ey, ax AS ex FROM tilted UNION ALL SELECT case_id, prompt, bz, "by", bx FROM tilted),
  range(-4, 5) a(i), range(-4, 5) b(j), range(-4, 5) c(k) WHERE exp(-(i * i + j * j + k * k) / 8) > 0.25 AND ez + i BETWEEN 0 AND 23 AND ey + j BETWEEN 0 AND 49 AND ex + k BETWEEN 0 AND 49""")
PARTS["region_all"] = (["line2_all", "gauss25_all"], "SELECT case_id, prompt, z, y, x FROM line2_all UNION SELECT case_id, prompt, z, y, x FROM gauss25_all")
PARTS["bin_sizes"] = (["bin_comp"], """SELECT case_id, component_id, count(*) AS voxel_count, sum(z) / count(*) AS cz, sum(y) / count(*) AS cy, sum(x) / count(*) AS cx FROM bin_comp GROUP BY 1, 2""")
PARTS["bin_shares"] = (["bin_comp", "region_all", "tube_all", "tilted"], """SELECT case_id, prompt, component_id, sum(r) AS prompt_overlap, sum(t) AS tube_overlap, sum(b) AS box_overlap FROM (
    SELECT case_id, prompt, component_id, 1 AS r, 0 AS t, 0 AS b FROM bin_comp JOIN region_all USING (case_id, z, y, x) UNION ALL
    SELECT case_id, prompt, component_id, 0, 1, 0 FROM bin_comp JOIN tube_all USING (case_id, z, y, x) UNION ALL
    SELECT v.case_id, prompt, component_id, 0, 0, 1 FROM bin_comp v JOIN tilted p ON v.case_id = p.case_id AND v.z BETWEEN az - 1 AND az + 1
      AND v.y BETWEEN least(ay, "by") - 8 AND greatest(ay, "by") + 8 AND v.x BETWEEN ax - 8 AND bx + 8) GROUP BY 1, 2, 3""")
PARTS["bin_overlaps"] = (["bin_sizes", "bin_shares", "tilted"], """SELECT s.*, p.prompt, coalesce(prompt_overlap, 0) AS prompt_overlap, coalesce(tube_overlap, 0) AS tube_overlap, coalesce(box_overlap, 0) AS box_overlap
  FROM bin_sizes s JOIN tilted p USING (case_id) LEFT JOIN bin_shares b ON b.case_id = s.case_id AND b.prompt = p.prompt AND b.component_id = s.component_id""")
PARTS["bin_points"] = (["bin_overlaps", "region_all", "tilted"], """SELECT *, round(sqrt(pow(cz - mz, 2) + pow(cy - my, 2) + pow(cx - mx, 2)), 9) AS mid_distance,
    round(sqrt(pow(cz - rz, 2) + pow(cy - ry, 2) + pow(cx - rx, 2)), 9) AS region_distance, count(*) OVER (PARTITION BY case_id, prompt) AS components
  FROM bin_overlaps JOIN (SELECT case_id, prompt, (az + bz) / 2 AS mz, (ay + "by") / 2 AS my, (ax + bx) / 2 AS mx FROM tilted) USING (case_id, prompt)
  JOIN (SELECT case_id, prompt, avg(z) AS rz, avg(y) AS ry, avg(x) AS rx FROM region_all GROUP BY 1, 2) USING (case_id, prompt)""")
_KEPT = """SELECT b.case_id, k.prompt, z, y, x FROM bin_comp b JOIN (SELECT case_id, prompt, component_id FROM (SELECT *, row_number() OVER (PARTITION BY case_id, prompt ORDER BY {order}) AS rn,
  first_value(voxel_count) OVER (PARTITION BY case_id, prompt ORDER BY {order}) AS chosen_size FROM bin_points) WHERE components <= 1 OR rn = 1 {extra}) k USING (case_id, component_id)"""
_MODES = {
    "prompt_component": "prompt_overlap DESC, CASE WHEN prompt_overlap > 0 THEN 0 ELSE region_distance END, component_id",
    "prompt_tube_component": "tube_overlap DESC, mid_distance, voxel_count DESC, component_id",
    "prompt_box_component": "box_overlap DESC, mid_distance, voxel_count DESC, component_id",
    "prompt_hybrid_component": "tube_overlap DESC, box_overlap DESC, mid_distance, voxel_count DESC, component_id",
}


def _kept(spark, d, **options):
    prompts = fx.tilted_prompts(spark, d)
    return sel.keep_prompt_component(fx.pred(spark, d), pr.prompt_region_runs(prompts, keys=KEYS), prompts, keys=KEYS, **options)


for _mode, _order in _MODES.items():
    query(f"keep_{_mode}", ["bin_comp", "bin_points"], _KEPT.format(order=_order, extra=""))(lambda spark, d, _mode=_mode: _kept(spark, d, mode=_mode))


@query("remove_small_islands", ["bin_comp", "bin_points"], _KEPT.format(
    order="prompt_overlap DESC, mid_distance, voxel_count DESC, component_id", extra="OR voxel_count >= greatest(20, ceil(0.4 * chosen_size))"))
def remove_small_islands(spark, d):
    return _kept(spark, d, min_voxels=20, min_fraction=0.4)


@query("component_prompt_overlap", ["bin_overlaps"], """SELECT case_id, prompt, component_id, voxel_count, round(cz, 6) AS cz, round(cy, 6) AS cy, round(cx, 6) AS cx,
  prompt_overlap, tube_overlap, box_overlap FROM bin_overlaps""")
def component_prompt_overlap(spark, d):
    prompts = fx.tilted_prompts(spark, d)
    return rounded(sel.component_prompt_overlap(cc.binary_component_runs(fx.pred(spark, d)), pr.prompt_region_runs(prompts, keys=KEYS), prompts, keys=KEYS))


@query("component_audit", ["bin_overlaps"], "SELECT case_id, prompt, component_id, voxel_count AS size, prompt_overlap FROM bin_overlaps ORDER BY case_id, prompt, size DESC, component_id")
def component_audit(spark, d):
    prompts = fx.tilted_prompts(spark, d)
    return sel.component_audit(cc.binary_component_runs(fx.pred(spark, d)), pr.prompt_region_runs(prompts, keys=KEYS), prompts, KEYS)


@query("merge_kept_prompts", ["bin_comp", "bin_points"], f"""SELECT case_id, z, y, x, label, prompt FROM (SELECT *, 1 + (case_id * 10 + prompt) % 3 AS label,
  row_number() OVER (PARTITION BY case_id, z, y, x ORDER BY prompt) AS rn FROM ({_KEPT.format(order=_MODES["prompt_component"], extra="")})) WHERE rn = 1""")
def merge_kept_prompts(spark, d):
    kept = _kept(spark, d, mode="prompt_component")
    return sel.merge_prompt_masks(kept.join(fx.prompts(spark, d).select("case_id", "prompt", "label"), ["case_id", "prompt"]))


def _prompt_masks(spark, d):
    """Each lesion's own box as its prompt's mask; neighbours overlap."""
    boxes = fx.lesions(spark, d).selectExpr("case_id", "lesion AS prompt", "label", "cz", "cy", "cx", "rx", "explode(sequence(cz - 1, cz + 1)) AS z")
    boxes = boxes.selectExpr("*", "explode(sequence(cy - 2, cy + 2)) AS y")
    return boxes.selectExpr("case_id", "prompt", "label", "z", "y", "explode(sequence(cx - rx, cx + rx)) AS x")


PARTS["prompt_masks"] = (["lesions"], """SELECT case_id, lesion AS prompt, label, CAST(cz + i AS INT) AS z, CAST(cy + j AS INT) AS y, CAST(cx + k AS INT) AS x
  FROM lesions, range(-1, 2) a(i), range(-2, 3) b(j), range(-5, 6) c(k) WHERE abs(k) <= rx""")


@query("merge_prompt_masks", ["prompt_masks"], """SELECT case_id, z, y, x, label, prompt FROM (SELECT *, row_number() OVER (PARTITION BY case_id, z, y, x ORDER BY prompt) AS rn
  FROM prompt_masks) WHERE rn = 1""")
def merge_prompt_masks(spark, d):
    return sel.merge_prompt_masks(_prompt_masks(spark, d))


@query("merge_report", ["prompt_masks"], """SELECT case_id, prompt, count(*) AS predicted_voxels, count(*) FILTER (rn = 1) AS assigned_voxels, count(*) FILTER (rn > 1) AS overlap_voxels
  FROM (SELECT *, row_number() OVER (PARTITION BY case_id, z, y, x ORDER BY prompt) AS rn FROM prompt_masks) GROUP BY 1, 2""")
def merge_report(spark, d):
    return sel.merge_report(_prompt_masks(spark, d))


@query("compose_organ_labels", ["aux_voxels"], """SELECT case_id, z, y, x, CASE WHEN bool_or(class_id = 1) THEN 1 ELSE max(class_id) END AS class_id
  FROM aux_voxels WHERE class_id > 0 GROUP BY 1, 2, 3, 4""")
def compose_organ_labels(spark, d):
    return sel.compose_organ_labels(fx.aux_voxels(spark, d))


@query("border_load", ["pred", "meta"], """SELECT case_id, cnt_z AS count_z, round(cnt_z / (2 * 2500 * 4), 6) AS load_z, cnt_y AS count_y, round(cnt_y / (2 * 24 * 50 * 4), 6) AS load_y,
  cnt_x AS count_x, round(cnt_x / (2 * 24 * 50 * 4), 6) AS load_x FROM (SELECT m.case_id, count(*) FILTER (z < 4) + count(*) FILTER (z >= 20) AS cnt_z,
  count(*) FILTER (y < 4) + count(*) FILTER (y >= 46) AS cnt_y, count(*) FILTER (x < 4) + count(*) FILTER (x >= 46) AS cnt_x FROM meta m LEFT JOIN pred p ON p.case_id = m.case_id GROUP BY 1)""")
def border_load(spark, d):
    return rounded(sel.border_load(fx.pred(spark, d), fx.meta(spark, d), margin=3))


PARTS["case_windows"] = (["case_prompts"], """SELECT case_id, CAST(greatest(0, least(round_even((az + bz) / 2, 0) - 5, 24 - 10)) AS INT) AS w_z0,
  CAST(greatest(0, least(round_even((ay + "by") / 2, 0) - 10, 50 - 20)) AS INT) AS w_y0, CAST(greatest(0, least(round_even((ax + bx) / 2, 0) - 12, 50 - 24)) AS INT) AS w_x0 FROM case_prompts""")


@query("border_change", ["paired", "case_windows"], """SELECT case_id, changed_z, foreground_z, changed_z > 12 * s_z OR (changed_z > 2 * s_z AND changed_z / greatest(foreground_z, 1) > 0.2) AS trigger_z,
    changed_y, foreground_y, changed_y > 12 * s_y OR (changed_y > 2 * s_y AND changed_y / greatest(foreground_y, 1) > 0.2) AS trigger_y,
    changed_x, foreground_x, changed_x > 12 * s_x OR (changed_x > 2 * s_x AND changed_x / greatest(foreground_x, 1) > 0.2) AS trigger_x FROM (
  SELECT w.case_id, 480 / 576 AS s_z, 240 / 384 AS s_y, 200 / 384 AS s_x, coalesce(sum(pz * ch), 0) AS changed_z, coalesce(sum(pz), 0) AS foreground_z,
    coalesce(sum(py * ch), 0) AS changed_y, coalesce(sum(py), 0) AS foreground_y, coalesce(sum(px * ch), 0) AS changed_x, coalesce(sum(px), 0) AS foreground_x
  FROM case_windows w LEFT JOIN (SELECT case_id, (z IN (w_z0, w_z0 + 9))::INT AS pz, (y IN (w_y0, w_y0 + 19))::INT AS py, (x IN (w_x0, w_x0 + 23))::INT AS px,
      ((g > 0) <> (p > 0))::INT AS ch FROM paired JOIN case_windows USING (case_id) WHERE z BETWEEN w_z0 AND w_z0 + 9 AND y BETWEEN w_y0 AND w_y0 + 19 AND x BETWEEN w_x0 AND w_x0 + 23) q
    ON q.case_id = w.case_id GROUP BY 1)""")
def border_change(spark, d):
    windows = geo.crop_window(fx.case_prompts(spark, d), (10, 20, 24))
    return sel.border_change(fx.gt(spark, d), fx.pred(spark, d), windows, ref_patch_zyx=(16, 24, 24), base_abs=12, base_min=2)


@query("crop_window", ["case_windows"], "SELECT case_id, w_z0, w_z0 + 10 AS w_z1, w_y0, w_y0 + 20 AS w_y1, w_x0, w_x0 + 24 AS w_x1 FROM case_windows")
def crop_window(spark, d):
    windows = geo.crop_window(fx.case_prompts(spark, d), (10, 20, 24))
    return windows.select("case_id", *[f"w_{a}{i}" for a in "zyx" for i in (0, 1)])


PARTS["diff_mask"] = (["paired"], "SELECT case_id, z, y, x, 1 AS label FROM paired WHERE (g > 0) <> (p > 0)")
from workload.oracle_parts import components_part  # noqa: E402

components_part("diff_comp", "diff_mask", binary=True)


@query("refinement_boxes", ["diff_comp", "pred"], """, b AS (SELECT case_id, w_z0, w_y0, w_x0, min(component_id) AS first FROM (SELECT case_id, component_id,
    CAST(greatest(0, least(round_even((min(z) + max(z) + 1) / 2, 0) - 5, 24 - 10)) AS INT) AS w_z0, CAST(greatest(0, least(round_even((min(y) + max(y) + 1) / 2, 0) - 10, 50 - 20)) AS INT) AS w_y0,
    CAST(greatest(0, least(round_even((min(x) + max(x) + 1) / 2, 0) - 12, 50 - 24)) AS INT) AS w_x0 FROM diff_comp GROUP BY 1, 2) GROUP BY ALL)
  SELECT case_id, w_z0, w_z0 + 10 AS w_z1, w_y0, w_y0 + 20 AS w_y1, w_x0, w_x0 + 24 AS w_x1, score, CAST(box AS INT) AS box FROM (
    SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY score DESC, first) AS box FROM (SELECT b.*, count(p.z) AS score FROM b LEFT JOIN pred p ON p.case_id = b.case_id
      AND z BETWEEN w_z0 AND w_z0 + 9 AND y BETWEEN w_y0 AND w_y0 + 19 AND x BETWEEN w_x0 AND w_x0 + 23 GROUP BY ALL))""")
def refinement_boxes(spark, d):
    from voxtally.operators.overlap import mask_symmetric_difference

    gt, pred = fx.gt(spark, d), fx.pred(spark, d)
    return sel.refinement_boxes(mask_symmetric_difference(gt, pred), pred, fx.meta(spark, d), (10, 20, 24))
