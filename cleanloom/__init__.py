"""A Spark-native engine that profiles, cleans, harmonises, imputes and audits messy tables."""

import os
from pathlib import Path


def on_workers(spark) -> None:
    """Puts this package's folder on the path of Python workers that start from now on; where executors don't share it, ship the package with --py-files."""
    root, known = str(Path(__file__).resolve().parent.parent), spark.sparkContext.environment
    paths = [p for p in known.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in paths:
        known["PYTHONPATH"] = os.pathsep.join([root, *paths])
