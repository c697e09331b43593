"""All registered queries; importing a module registers its own."""

from workload import dense, every_prompt, jobs, masks, pointing, tables  # noqa: F401
from workload.registry import QUERIES, oracles

__all__ = ["QUERIES", "oracles"]
