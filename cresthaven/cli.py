"""python -m cresthaven.cli --config f.json [--auto-gap on|off] [--quiet]"""

from __future__ import annotations

import argparse
import json
from pathlib import Path

from pyspark.sql import SparkSession

from .plans import outputs, pipeline
from .plans.config import Config
from .sources.pointcloud import PointCloud


def main(argv: list[str] | None = None) -> dict:
    a = argparse.ArgumentParser(description=__doc__)
    a.add_argument("--config", required=True)
    a.add_argument("--auto-gap", choices=["on", "off"])
    a.add_argument("--quiet", action="store_true")
    args = a.parse_args(argv)
    c = Config.load(args.config)
    if args.auto_gap:
        c = c.but(auto_gap_enabled=args.auto_gap == "on")
    if not c.input or not c.output:
        a.error("the configuration needs input and output")
    spark = SparkSession.builder.appName("cresthaven").getOrCreate()
    spark.dataSource.register(PointCloud)
    lines = pipeline.lines_of(spark.read.format("pointcloud").load(c.input), c)
    outputs.write_outputs(lines, c)
    found = outputs.report(lines, c)
    Path(c.output).with_name("run_params.json").write_text(json.dumps(found, ensure_ascii=False, indent=1), encoding="utf-8")
    if not args.quiet:
        print(json.dumps(found["line_counts"]), found["total_length_m"])
    return found


if __name__ == "__main__":
    main()
