"""Query plans: each module registers its queries in the catalog on import."""

from __future__ import annotations

import importlib

MODULES: tuple[str, ...] = ("components", "sequences", "resampling", "relational", "files", "verification", "variants")


def load_all() -> None:
    for name in MODULES:
        importlib.import_module(f"curvestat.plans.{name}")
