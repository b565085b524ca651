"""Command line: ``python -m tollgate.cli STAGE ...``; exit 0 done, 1 may be retried, 2 will not change by retrying."""

from __future__ import annotations

import argparse
import inspect
import sys
import traceback
from collections.abc import Callable

from pyspark.sql import SparkSession

from .failures import OK, classify
from .plans import stages
from .sources import files, transfers

STAGES = {n.replace("_", "-"): getattr(stages, n) for n in (
    "verify_dataset", "normalize", "parse_patterns", "reconcile", "build_features", "split_sweep", "build_splits", "train", "evaluate", "model_stability", "plant_leak", "leak_sweep", "make_drift", "splice_drift", "drift_experiment", "make_bundle", "verify_bundle",
)}


def session(name: str = "tollgate") -> SparkSession:
    """A session with the settings that results depend on; sizes are the cluster's."""
    spark = SparkSession.builder.appName(name).config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true").getOrCreate()
    spark.sparkContext.setLogLevel("WARN")
    return spark


def _many(kind: type) -> Callable[[str], list]:
    return lambda x: [kind(v) for v in x.split(",")]


def _option(parser: argparse.ArgumentParser, p: inspect.Parameter) -> None:
    name, default, said = f"--{p.name.replace('_', '-')}", p.default, str(p.annotation)
    number = float if "float" in said else int if "int" in said else str
    if isinstance(default, bool):
        parser.add_argument(name, action="store_true")
    elif "Sequence" in said:
        parser.add_argument(name, type=_many(number), **({"required": True} if default is inspect.Parameter.empty else {"default": default}))
    elif default is inspect.Parameter.empty:
        parser.add_argument(name, required=True, type=number)
    else:
        parser.add_argument(name, default=default, type=number)


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="tollgate", description=__doc__)
    sub = out.add_subparsers(dest="stage", required=True)
    for name, f in STAGES.items():
        own = sub.add_parser(name, help=(f.__doc__ or "").splitlines()[0])
        for p in list(inspect.signature(f).parameters.values())[1:]:
            if p.kind is not inspect.Parameter.VAR_KEYWORD:
                _option(own, p)
    demo = sub.add_parser("demo", help="Write a small synthetic corpus and run every stage on it.")
    demo.add_argument("--dest", required=True)
    demo.add_argument("--only-write", action="store_true")
    return out


def main(argv: list[str] | None = None) -> int:
    options = vars(parser().parse_args(argv))
    name = options.pop("stage")
    spark = session()
    try:
        if name == "demo":
            got = dict(zip(("transfers", "patterns"), transfers.demo_corpus(spark, options["dest"]))) if options["only_write"] else stages.demo(spark, options["dest"])
            print(files.dumps(got))
            return OK
        got = STAGES[name](spark, **options)
        print(files.dumps(got))
        return int(got.get("exit", OK)) if name == "verify-bundle" else OK
    except Exception as error:  # noqa: BLE001  classified, not swallowed: the code says what happened
        traceback.print_exc()
        return classify(error)


if __name__ == "__main__":
    sys.exit(main())
