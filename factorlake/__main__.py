"""python -m factorlake run --config FILE --out FOLDER | export --run FOLDER --site FOLDER | preset NAME --out FILE"""

from __future__ import annotations

import argparse
import json
import sys
from datetime import date

from pyspark.sql import SparkSession

from factorlake.plans import configs, pipeline


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="factorlake")
    sub = p.add_subparsers(dest="command", required=True)
    r = sub.add_parser("run")
    r.add_argument("--config", required=True)
    r.add_argument("--out", required=True)
    r.add_argument("--csv", action="store_true")
    e = sub.add_parser("export")
    e.add_argument("--run", required=True)
    e.add_argument("--site", required=True)
    e.add_argument("--bars", type=int, default=500)
    e.add_argument("--root", help="texts are shown from this folder, which has to hold the site")
    w = sub.add_parser("preset")
    w.add_argument("name", choices=sorted(configs.PRESETS))
    w.add_argument("--out", required=True)
    a = p.parse_args(argv)
    if a.command == "preset":
        configs.save(a.out, configs.preset(a.name, date.today()))
        return 0
    spark = SparkSession.builder.appName("factorlake").getOrCreate()
    if a.command == "run":
        done = pipeline.Runner(spark, configs.load(a.config), pipeline.RunContext(log=lambda level, m: print(level, m, file=sys.stderr))).run(a.out, a.csv)
    else:
        done = pipeline.export_site(spark, a.run, a.site, a.bars, a.root)
    print(json.dumps(done, default=str))
    return 0


if __name__ == "__main__":
    sys.exit(main())
