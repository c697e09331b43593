"""Queries of ``case_prompts`` over every prompt of every case, keyed by (case_id, prompt); the filtering queries read all prompts under their own names."""

from __future__ import annotations

from voxtally.operators import prompts as pr
from workload import dense, masks, pointing  # noqa: F401
from workload import fixtures as fx
from workload.oracle_parts import PARTS, sql
from workload.registry import _ORACLES, QUERIES, query

NAMES = [
    "prompt_label_dice", "select_manifest_target", "rasterize_tube", "endpoint_gaussian", "prompt_region", "prompt_region_wrong", "prompt_channels", "endpoint_box",
    "border_change", "crop_window", "restore_crop", "crop_endpoints", "needs_bbox_tail", "multifov_windows", "multifov_crop",
    "bbox_fit_mask", "bbox_fit_crop",
]
# Key of a prompt in the twins; case_id % 3, which sets a case's spacing, stays what it is.
STEP = 3_000_000_000_000


def _copied(name: str) -> dict:
    return {f"{name}_once": PARTS[name], name: ([f"{name}_once", "prompts"], f"SELECT o.* REPLACE (o.case_id + {STEP} * p.prompt AS case_id) FROM {name}_once o JOIN (SELECT case_id, prompt FROM prompts) p USING (case_id)")}


def twin(name: str) -> str:
    """The SQL of a query, over copies of each case for all its prompts."""
    parts, body = _ORACLES[name]
    every = ["prompts"], f"""SELECT * REPLACE (case_id + {STEP} * prompt AS case_id, "by" + prompt % 4 AS "by") FROM prompts"""
    inner = sql(parts, body, {"case_prompts": every, **_copied("gt"), **_copied("pred"), **_copied("meta")})
    return f"SELECT * REPLACE (case_id % {STEP} AS case_id), case_id // {STEP} AS prompt FROM ({inner})"


def _every_prompt(name: str):
    def build(spark, d):
        with fx.every_prompt():
            rows = QUERIES[name](spark, d)
        return pr.split_prompt_key(rows, fx.prompts(spark, d))

    return build


for _name in NAMES:
    query(f"{_name}_every_prompt", [], twin(_name))(_every_prompt(_name))
