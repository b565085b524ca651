"""Run manifests: what a stage did, with which inputs and settings, and whether it can be skipped."""

from __future__ import annotations

import hashlib
import json
import platform
import time
from collections.abc import Callable, Sequence
from typing import Any

import pyspark
from pyspark.sql import SparkSession

from . import __version__
from .sources import files

NAME = "_manifest.json"


def fingerprint(spark: SparkSession, inputs: Sequence[str]) -> str:
    """Digest of every input file's path, size and time of change."""
    return hashlib.sha256(files.dumps([files.listing(spark, p) for p in inputs]).encode()).hexdigest()


def run_key(component: str, config: dict[str, Any], inputs: str) -> str:
    """Names a run: component, settings, inputs, and this engine's and Spark's versions."""
    what = {"component": component, "config": config, "inputs": inputs, "tollgate": __version__, "spark": pyspark.__version__}
    return hashlib.sha256(files.dumps(what, sort_keys=True).encode()).hexdigest()


class Run:
    """Context of one stage: ``record`` metrics; the manifest is written on leaving, failed or not."""

    def __init__(self, spark: SparkSession, component: str, config: dict[str, Any], dest: str, inputs: Sequence[str] = ()):
        self.spark, self.component, self.config, self.dest = spark, component, config, dest
        self.metrics: dict[str, Any] = {}
        self.inputs = fingerprint(spark, inputs)
        self.key = run_key(component, config, self.inputs)

    def record(self, **metrics: Any) -> None:
        self.metrics |= metrics

    def __enter__(self) -> Run:
        self.began = time.time()
        return self

    def __exit__(self, kind: type | None, error: BaseException | None, trace: object) -> None:
        out = {
            "component": self.component, "key": self.key, "config": self.config, "inputs": self.inputs, "metrics": self.metrics, "status": "failed" if kind else "ok",
            "error": f"{kind.__name__}: {error}"[:2000] if kind else None, "seconds": round(time.time() - self.began, 3), "outputs": [x[:2] for x in files.listing(self.spark, self.dest) if not x[0].endswith(NAME)],
            "env": {"python": platform.python_version(), "spark": pyspark.__version__, "tollgate": __version__},
        }
        files.write_json(self.spark, f"{self.dest}/{NAME}", out)
        print(files.dumps({"event": f"{self.component}_{out['status']}", "seconds": out["seconds"], **self.metrics}), flush=True)


def cached(spark: SparkSession, component: str, config: dict[str, Any], dest: str, inputs: Sequence[str]) -> dict[str, Any] | None:
    """Metrics of an earlier run of the same key, if it succeeded and its outputs are still as it left them."""
    path = f"{dest}/{NAME}"
    if not files.exists(spark, path):
        return None
    try:
        seen = files.read_json(spark, path)
    except json.JSONDecodeError:
        return None
    same = seen.get("status") == "ok" and seen.get("key") == run_key(component, config, fingerprint(spark, inputs))
    now = [list(x[:2]) for x in files.listing(spark, dest) if not x[0].endswith(NAME)]
    return seen["metrics"] if same and [list(x) for x in seen["outputs"]] == now else None


def stage(spark: SparkSession, component: str, config: dict[str, Any], dest: str, inputs: Sequence[str], work: Callable[[Run], None], force: bool = False) -> dict[str, Any]:
    """Run ``work`` under a manifest, or give the metrics of the run that already did it."""
    if not force and (hit := cached(spark, component, config, dest, inputs)) is not None:
        return hit
    with Run(spark, component, config, dest, inputs) as run:
        work(run)
    return run.metrics
