"""Fathomline: a PySpark-native engine for research analytics and corpus preparation."""

from __future__ import annotations

import os


def ship(spark) -> None:
    """Lets Python workers on machines that share this path import the package; elsewhere pass it with --py-files."""
    home = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    env = spark.sparkContext.environment
    if home not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (home, env.get("PYTHONPATH", "")) if x)
