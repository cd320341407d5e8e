"""Commands over a study's configuration: python -m gaitspark.cli COMMAND --config FILE."""

from __future__ import annotations

import argparse
import os
import sys
from collections.abc import Sequence

from pyspark.sql import SparkSession

from . import __version__
from .config import load_config
from .plans import project as stages
from .plans.report import report
from .sources import manifest as manifests
from .sources.synthetic import write_study

#: The commands, the stages that each needs in order, and the tables whose failures it answers for.
COMMANDS = {
    "preprocess": (("preprocess",), ("imu_qc",)),
    "synchronize": (("preprocess", "annotate", "synchronize"), ("synchronization", "segment_errors")),
    "process-audio": (("preprocess", "annotate", "synchronize", "listen"), ("audio_qc",)),
    "process-footswitch": (("preprocess", "annotate", "synchronize", "step"), ("footswitch_qc",)),
    "process-video": (("preprocess", "annotate", "watch"), ("video_qc",)),
    "extract-features": (("preprocess", "annotate", "synchronize", "listen", "step", "watch"), ("imu_feature_failures", "segment_errors")),
    "fuse-features": (stages.ORDER, ()),
    "run-baselines": ((*stages.ORDER, "model"), ()),
    "generate-report": (stages.ORDER, ()),
    "run-all": (stages.ORDER, tuple(stages.FAILED)),
}
#: run-all goes on after these stages only if no trial has failed so far.
GATES = ("preprocess", "synchronize", "watch")


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="gaitspark")
    out.add_argument("--version", action="version", version=f"%(prog)s {__version__}")
    out.add_argument("--verbose", action="store_true", help="say which stages ran and which were current")
    sub = out.add_subparsers(dest="command", required=True)
    made = sub.add_parser("generate-synthetic")
    made.add_argument("--output", default="data/synthetic")
    made.add_argument("--participants", type=int, default=1)
    made.add_argument("--seed", type=int, default=42)
    for name in ("validate-manifest", *COMMANDS):
        p = sub.add_parser(name)
        p.add_argument("--config", default="configs/example.yaml")
        p.add_argument("--no-check-files", action="store_true")
        if name == "generate-report":
            p.add_argument("--output")
    return out


def write_report(study: stages.Study, path: str | None) -> None:
    path = path or f"{study.project.resolve(study.project.output_dir)}/research_summary.md"
    os.makedirs(os.path.dirname(os.path.abspath(path)), exist_ok=True)
    with open(path, "w", encoding="utf-8") as f:
        f.write(report(study))


def run(spark: SparkSession, args: argparse.Namespace) -> int:
    """A command's stages: those whose tables are current are read, the others run. A report shows modelling where its
    tables are current, and doesn't run it."""
    project = load_config(args.config)
    if args.command == "validate-manifest":
        _, issues = manifests.validate(spark, project, not args.no_check_files)
        for r in issues.orderBy("row_number", "severity", "code").toLocalIterator():
            print(f"{r.severity}: row {r.row_number}: {r.message}")
        return int(not issues.where("severity = 'error'").isEmpty())
    study = stages.load(spark, project, not args.no_check_files)
    needed, answers_for = COMMANDS[args.command]
    whole = args.command == "run-all"
    stopped = False
    for name in needed:
        stages.perform(study, name)
        if args.verbose:
            print(f"{name}: {'done' if name in study.ran else 'current'}", file=sys.stderr)
        if whole and name in GATES and stages.failures(study):
            print(f"error: {name} has failures, later stages were not run", file=sys.stderr)
            stopped = True
            break
    if whole and not stopped and project.modeling.enabled:
        stages.perform(study, "model")
    if args.command == "generate-report":
        stages.reuse(study, "model")
    if args.command == "generate-report" or whole and not stopped:
        write_report(study, getattr(args, "output", None))
    stages.export(study)
    no_model = study.successes == 0 and (whole or args.command == "run-baselines")
    return int(no_model or bool(stages.failures(study, answers_for)))


def main(argv: Sequence[str] | None = None, spark: SparkSession | None = None) -> int:
    """0: done; 1: a trial failed or the manifest is invalid; 2: the configuration or a file can't be used."""
    args = parser().parse_args(argv)
    try:
        if args.command == "generate-synthetic":
            print(write_study(os.path.abspath(args.output), args.participants, args.seed))
            return 0
        return run(spark or SparkSession.builder.appName("gaitspark").getOrCreate(), args)
    except (ValueError, OSError) as e:
        print(f"error: {e}", file=sys.stderr)
        return 2


if __name__ == "__main__":
    sys.exit(main())
