"""Command line: quality limits from a folder of recordings as Parquet samples.

    python -m pulseframe calibrate FOLDER [--subjects S ...] [--sessions D ...] [--channels ch0 ...] [--rate 2000] [--settings FILE] [--margin 3]

Samples are resampled and filtered as the gate sees them, and windows of 200 ms every 50 ms are profiled, at most 2,000 a recording, evenly spaced.
"""

from __future__ import annotations

import argparse
import json
import sys
from collections.abc import Sequence


def main(argv: Sequence[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="pulseframe", description="Profile recordings and suggest limits for the quality gate.")
    command = parser.add_subparsers(dest="command", required=True).add_parser("calibrate")
    command.add_argument("folder")
    command.add_argument("--source", default="parquet", help="how the folder is read: parquet (samples with subject_id, session_id, sample_idx, label, repetition and channels) or ninapro_db6 (matrix files)")
    command.add_argument("--subjects", nargs="*")
    command.add_argument("--sessions", nargs="*")
    command.add_argument("--channels", nargs="+", default=["ch0", "ch1"], help="those that will be gated on")
    command.add_argument("--rate", type=float, default=2000.0, help="samples a second")
    command.add_argument("--settings", help="JSON file of a configuration: rates, filters, window sizes")
    command.add_argument("--windows", type=int, default=2000, help="most windows a recording")
    command.add_argument("--margin", type=float, default=3.0)
    args = parser.parse_args(argv)

    from pyspark.sql import SparkSession

    from pulseframe.operators import build, qc
    from pulseframe.sources import loaders, signals

    spark = SparkSession.builder.appName("pulseframe-calibrate").getOrCreate()
    samples = loaders.loader(args.source, spark, args.folder).load(args.subjects, args.sessions)
    config = signals.config_of(signals.read_config(spark, args.settings)) if args.settings else signals.PreprocessConfig()
    profile = build.profile_recordings(samples, config, args.rate, args.channels, args.windows)
    if profile.isEmpty():
        print("no windows", file=sys.stderr)
        return 1
    out: dict[str, dict] = {}
    for r in qc.calibrate(profile, args.margin).collect():
        out.setdefault(r.section, {})[r.name] = r.value
        if r.derivation:
            out.setdefault("derivation", {})[r.name] = r.derivation
    out |= {"subjects": args.subjects or "all", "channels": args.channels}
    print(json.dumps(out, indent=2))
    return 0


if __name__ == "__main__":
    sys.exit(main())
