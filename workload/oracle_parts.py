"""DuckDB twins of the fixtures, as named common table expressions."""

from __future__ import annotations

from voxtally.operators.surface import code_facets

PARTS: dict[str, tuple[list[str], str]] = {
    "lesions": ([], """SELECT o_orderkey // 10 AS case_id, CAST(o_orderkey % 10 AS INT) AS lesion,
        CAST(1 + o_orderkey % 3 AS INT) AS label, o_custkey AS ck, o_orderpriority <> '5-LOW' AS found,
        CAST(3 + o_custkey % 18 AS INT) AS cz, CAST(5 + (o_orderkey * 7 + o_custkey) % 38 AS INT) AS cy,
        CAST(5 + (o_custkey * 13) % 38 AS INT) AS cx, CAST(1 + o_custkey % 3 AS INT) AS rz,
        CAST(2 + o_orderkey % 3 AS INT) AS ry, CAST(2 + (o_custkey // 3) % 4 AS INT) AS rx FROM orders"""),
    "ball": ([], """SELECT i, j, k FROM range(-4, 5) a(i), range(-5, 6) b(j), range(-7, 8) c(k)"""),
    "gt": (["lesions", "ball"], """SELECT case_id, CAST(cz + i AS INT) AS z, CAST(cy + j AS INT) AS y, CAST(cx + k AS INT) AS x, min(label) AS label
        FROM lesions, ball
        WHERE i*i*ry*ry*rx*rx + j*j*rz*rz*rx*rx + k*k*rz*rz*ry*ry <= rz*rz*ry*ry*rx*rx GROUP BY ALL"""),
    "pred": (["lesions", "ball"], """SELECT case_id, CAST(cz + i AS INT) AS z, CAST(cy + (ck // 2) % 2 + j AS INT) AS y,
        CAST(cx + ck % 2 + k AS INT) AS x, min(label) AS label FROM (SELECT *, rx + ck % 2 AS r FROM lesions WHERE found) l, ball
        WHERE i*i*ry*ry*r*r + j*j*rz*rz*r*r + k*k*rz*rz*ry*ry <= rz*rz*ry*ry*r*r GROUP BY ALL"""),
    "meta": (["lesions"], """SELECT DISTINCT case_id, 24 AS nz, 50 AS ny, 50 AS nx,
        CAST(1 + case_id % 3 AS DOUBLE) AS sz, 1.0::DOUBLE AS sy, 1.0::DOUBLE AS sx FROM lesions"""),
    "prompts": (["lesions"], """SELECT case_id, lesion AS prompt, label, CAST(cx - rx AS DOUBLE) AS ax, CAST(cy AS DOUBLE) AS ay,
        CAST(cz AS DOUBLE) AS az, CAST(cx + rx AS DOUBLE) AS bx, CAST(cy AS DOUBLE) AS "by", CAST(cz AS DOUBLE) AS bz, cz AS slice,
        24 AS nz, 50 AS ny, 50 AS nx FROM lesions"""),
    "case_prompts": (["prompts"], """SELECT case_id, prompt, label, ax, ay, az, bx, "by" + prompt % 4 AS "by", bz, slice, nz, ny, nx FROM (
        SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY bx - ax DESC, prompt) AS rn FROM prompts) WHERE rn = 1"""),
    "marker": (["lesions"], """SELECT case_id, cz AS z, cy AS y, CAST(cx + k AS INT) AS x, min(label) AS label
        FROM lesions, range(-5, 6) t(k) WHERE abs(k) <= rx GROUP BY ALL"""),
    "scattered_gt": ([], """SELECT l_orderkey // 750 AS case_id, CAST(l_linenumber - 1 AS INT) AS z, CAST(l_partkey % 24 AS INT) AS y,
        CAST(l_orderkey % 24 AS INT) AS x, min(CASE WHEN l_returnflag = 'R' THEN 2 ELSE 1 END) AS label FROM lineitem GROUP BY 1, 2, 3, 4"""),
    "prob_voxels": ([], """SELECT l_orderkey // 750 AS case_id, CAST(l_linenumber - 1 AS INT) AS z, CAST(l_partkey % 24 AS INT) AS y,
        CAST(l_orderkey % 24 AS INT) AS x, max(CAST(l_quantity AS INT)) / 50 AS prob FROM lineitem GROUP BY 1, 2, 3, 4"""),
    "scattered_meta": ([], """SELECT DISTINCT l_orderkey // 750 AS case_id, 7 AS nz, 24 AS ny, 24 AS nx,
        CAST(1 + (l_orderkey // 750) % 3 AS DOUBLE) AS sz, 1.0::DOUBLE AS sy, 1.0::DOUBLE AS sx FROM lineitem"""),
    "aux_voxels": ([], """SELECT DISTINCT l_orderkey // 750 AS case_id, CAST(l_linenumber - 1 AS INT) AS z, CAST(l_partkey % 24 AS INT) AS y,
        CAST(l_orderkey % 24 AS INT) AS x, CAST(l_suppkey % 29 AS INT) AS class_id FROM lineitem"""),
    "scan_voxels": ([], """SELECT vec_id AS case_id, label AS grp, CAST(i // 16 AS INT) AS z, CAST(i // 4 % 4 AS INT) AS y, CAST(i % 4 AS INT) AS x,
        CAST(embedding[i + 1] AS DOUBLE) AS v FROM embeddings, range(0, 64) t(i)"""),
    "scan_meta": ([], """SELECT vec_id AS case_id, 4 AS nz, 4 AS ny, 4 AS nx, CAST(1 + vec_id % 4 AS DOUBLE) AS sz, 1.0::DOUBLE AS sy,
        1.0::DOUBLE AS sx FROM embeddings"""),
    "scan_mask": (["scan_voxels"], """SELECT case_id, z, y, x, CASE WHEN v > 0.1 THEN 2 ELSE 1 END AS label FROM scan_voxels WHERE v > 0"""),
    "manifest": ([], """SELECT case_id * 2 + c AS ord, case_id, image_path, source, split, target_voxel_count, target_label_value FROM (
        SELECT doc_id AS case_id, 'images/' || doc_id || '.npz' AS image_path, source, CASE WHEN lang = 'en' THEN 'train' ELSE 'val' END AS split,
        CASE WHEN doc_id % 13 = 0 THEN NULL WHEN n_chars % 11 = 0 THEN 0 ELSE n_chars END AS target_voxel_count,
        CASE WHEN n_chars % 3 = 0 THEN NULL ELSE CAST(1 + n_chars % 3 AS INT) END AS target_label_value, doc_id % 10 = 0 AS twice
        FROM documents) d, range(0, 2) t(c) WHERE c = 0 OR twice"""),
    "file_listing": ([], "SELECT 'images/' || doc_id || '.npz' AS path, doc_id * 10 + quality AS length, 1700000000 + doc_id AS seconds FROM labels"),
    "case_log": ([], """SELECT event_id AS case_id, CASE event_type WHEN 'error' THEN 'error' WHEN 'signup' THEN 'timeout' ELSE 'ok' END AS status,
        CASE WHEN event_type = 'error' THEN NULL ELSE value / 10 END AS total_seconds,
        CAST(json_extract_string(props, '$.k') AS DOUBLE) AS rss_mb,
        CASE WHEN event_type = 'error' THEN NULL ELSE value * 2 END AS cpu_memory_time_mb_seconds,
        CASE WHEN event_type IN ('click', 'view') THEN (event_id % 101) / 100 END AS dsc,
        CASE WHEN event_type IN ('click', 'view') THEN (event_id % 97) / 96 END AS nsd FROM events"""),
    "train_steps": ([], """SELECT CAST(day(ts) AS INT) AS epoch, ts, event_id AS step_key, value AS loss, (event_id % 101) / 103 AS crop_dice, event_type FROM events"""),
    "logits": ([], """SELECT l_orderkey // 750 AS sample, (l_quantity - 25) / 10 AS logit, CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS target FROM lineitem"""),
    "class_logits": ([], """SELECT l_orderkey // 750 AS sample, [l_quantity / 20, l_discount * 30, l_tax * 40] AS scores,
        CASE l_returnflag WHEN 'R' THEN 2 WHEN 'A' THEN 1 ELSE CASE WHEN l_linestatus = 'F' THEN 0 ELSE -1 END END AS target FROM lineitem"""),
}

# Components by recursion over face neighbours; only voxels whose root fell in the last step are looked at again.
def components_part(name: str, mask: str, binary: bool = False) -> None:
    label = "1" if binary else "label"
    PARTS[f"{name}_v"] = ([mask], f"SELECT case_id, {label} AS label, z, y, x, (CAST(z AS BIGINT) * 1000 + y) * 1000 + x AS lin FROM {mask}")
    PARTS[f"{name}_cc"] = ([f"{name}_v"], f"""SELECT case_id, label, lin, lin AS root FROM {name}_v
      UNION
      SELECT n.case_id, n.label, n.lin, min(c.root) FROM {name}_cc c, (VALUES (1), (-1), (1000), (-1000), (1000000), (-1000000)) s(step),
        recurring.{name}_cc n WHERE n.case_id = c.case_id AND n.label = c.label AND n.lin = c.lin + s.step AND c.root < n.root
      GROUP BY ALL""")
    PARTS[name] = ([f"{name}_cc", f"{name}_v"], f"""SELECT v.case_id, v.label, v.z, v.y, v.x,
      CAST(dense_rank() OVER (PARTITION BY v.case_id, v.label ORDER BY c.root) AS INT) AS component_id
      FROM {name}_v v JOIN {name}_cc c USING (case_id, label, lin)""")


components_part("gt_comp", "gt")
components_part("pred_comp", "pred")
components_part("scat_comp", "scattered_gt")
components_part("bin_comp", "pred", binary=True)
components_part("marker_comp", "marker")

STATS = """SELECT case_id, label, component_id, count(*) AS voxel_count, min(z) AS z_min, min(y) AS y_min, min(x) AS x_min,
  max(z) + 1 AS z_max, max(y) + 1 AS y_max, max(x) + 1 AS x_max, sum(z) / count(*) AS cz, sum(y) / count(*) AS cy, sum(x) / count(*) AS cx
  FROM {comp} GROUP BY 1, 2, 3"""
PEAK = """SELECT case_id, label, component_id, z AS slice_index, area AS peak_area FROM (SELECT *, row_number() OVER (
  PARTITION BY case_id, label, component_id ORDER BY area DESC, z) AS rn FROM (
  SELECT case_id, label, component_id, z, count(*) AS area FROM {comp} GROUP BY 1, 2, 3, 4)) WHERE rn = 1"""
for _comp in ("gt_comp", "scat_comp", "bin_comp"):
    PARTS[f"{_comp}_stats"] = ([_comp], f"SELECT * FROM ({STATS.format(comp=_comp)}) JOIN ({PEAK.format(comp=_comp)}) USING (case_id, label, component_id)")

_facets = ", ".join(f"({code}, {a}, {b}, {c})" for code, facets in code_facets() for a, b, c in facets)
PARTS["facets"] = ([], f"SELECT * FROM (VALUES {_facets}) f(code, a, b, c)")
PARTS["areas"] = (["facets", "meta"], """SELECT case_id, code, sum(sqrt(pow(a / 8 * sy * sx, 2) + pow(b / 8 * sz * sx, 2) + pow(c / 8 * sz * sy, 2))) AS area
  FROM facets, meta GROUP BY 1, 2""")
PARTS["cells"] = (["gt", "pred"], """SELECT case_id, label, side, z + dz AS z, y + dy AS y, x + dx AS x,
    CAST(sum(1 << (dz * 4 + dy * 2 + dx)) AS INT) AS code
  FROM (SELECT *, 0 AS side FROM gt UNION ALL SELECT *, 1 FROM pred) m, range(0, 2) a(dz), range(0, 2) b(dy), range(0, 2) c(dx)
  GROUP BY 1, 2, 3, 4, 5, 6 HAVING sum(1 << (dz * 4 + dy * 2 + dx)) < 255""")
PARTS["near_cells"] = (["cells", "meta"], """SELECT DISTINCT c.case_id, c.label, 1 - c.side AS side, c.z + i AS z, c.y + j AS y, c.x + k AS x
  FROM cells c JOIN meta m USING (case_id), range(-2, 3) a(i), range(-2, 3) b(j), range(-2, 3) d(k)
  WHERE i*i*sz*sz + j*j*sy*sy + k*k*sx*sx <= 4""")
PARTS["within"] = (["cells", "near_cells", "areas"], """SELECT c.case_id, c.label, c.side, sum(a.area) AS area, sum(CASE WHEN n.z IS NOT NULL THEN a.area ELSE 0 END) AS near_area
  FROM cells c JOIN areas a USING (case_id, code) LEFT JOIN near_cells n USING (case_id, label, side, z, y, x) GROUP BY 1, 2, 3""")
PARTS["paired"] = (["gt", "pred"], """SELECT case_id, z, y, x, coalesce(g.label, 0) AS g, coalesce(p.label, 0) AS p
  FROM gt g FULL JOIN pred p USING (case_id, z, y, x)""")
PARTS["tallies"] = (["paired"], """SELECT case_id, label, sum(ing) AS gt_voxels, sum(inp) AS pred_voxels, sum(ing * inp) AS tp FROM (
  SELECT case_id, g AS label, 1 AS ing, CASE WHEN g = p THEN 1 ELSE 0 END AS inp FROM paired WHERE g > 0 UNION ALL
  SELECT case_id, p, 0, 1 FROM paired WHERE p > 0 AND p <> g) GROUP BY 1, 2""")
PARTS["label_dice"] = (["tallies"], "SELECT case_id, label, 2 * tp / (gt_voxels + pred_voxels) AS dsc, gt_voxels, pred_voxels FROM tallies")
PARTS["label_scores"] = (["label_dice", "within"], """SELECT d.case_id, d.label, d.dsc, CASE WHEN d.dsc < 0.2 OR gt_voxels = 0 OR pred_voxels = 0 THEN 0 ELSE n.nsd END AS nsd, gt_voxels, pred_voxels
  FROM label_dice d JOIN (SELECT case_id, label, sum(near_area) / sum(area) AS nsd FROM within GROUP BY 1, 2) n USING (case_id, label)""")


def sql(parts: list[str], body: str, changed: dict[str, tuple[list[str], str]] | None = None) -> str:
    """``body`` preceded by the parts it needs, in order of need; ``changed`` parts stand in for those of their name."""
    order: list[str] = []
    known = PARTS | (changed or {})

    def need(name: str) -> None:
        if name not in order:
            for other in known[name][0]:
                need(other)
            order.append(name)

    for part in parts:
        need(part)
    recursive = any(name.endswith("_cc") for name in order)
    ctes = []
    for name in order:
        if name.endswith("_cc"):
            ctes.append(f"{name}(case_id, label, lin, root) USING KEY (case_id, label, lin) AS ({known[name][1]})")
        else:
            hint = "MATERIALIZED " if name not in ("facets", "ball") else ""
            ctes.append(f"{name} AS {hint}({known[name][1]})")
    if not ctes:
        return "WITH" + body.lstrip()[1:] if body.lstrip().startswith(",") else body
    return f"WITH {'RECURSIVE ' if recursive else ''}{', '.join(ctes)} {body}"
