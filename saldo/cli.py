"""Command line: python -m saldo.cli PROJECT.json [--plan | --check] [--out FOLDER], --template FILE, --find CODE CUBE..., --query NAME FOLDER."""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import SparkSession


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="saldo", description=__doc__)
    p.add_argument("project", nargs="?", help="project file (JSON)")
    p.add_argument("--template", metavar="FILE", help="write an example project")
    p.add_argument("--plan", action="store_true", help="list what is missing; nothing runs")
    p.add_argument("--json", action="store_true", help="the plan as JSON")
    p.add_argument("--check", action="store_true", help="run and print the checks only")
    p.add_argument("--key-alternatives", action="store_true", help="also run every other key of the same codes")
    p.add_argument("--out", metavar="FOLDER", default="outputs")
    p.add_argument("--find", nargs="+", metavar=("CODE", "CUBE"), help="where a code is published")
    p.add_argument("--query", nargs=2, metavar=("NAME", "FOLDER"), help="run a registered query and show it")
    p.add_argument("--regionalise", metavar="ACTIVITY", help="regional table from an activity CSV")
    p.add_argument("--national", metavar="BUNDLE", help="interchange folder of the national table")
    p.add_argument("--method", default="FLQ", choices=["SLQ", "CILQ", "RLQ", "FLQ"])
    p.add_argument("--delta", type=float, help="exponent of FLQ; there is no default")
    args = p.parse_args(argv)
    from saldo.plans import catalogue, config, report, scenario
    from saldo.sources import files, fixture

    if args.template:
        with open(args.template, "w") as f:
            json.dump(config.TEMPLATE, f, indent=2)
        return 0
    spark = SparkSession.builder.appName("saldo").getOrCreate()
    if args.find:
        print(json.dumps(catalogue.advise(spark, args.find[0], args.find[1:]), indent=2))
        return 0
    if args.query:
        from saldo.plans.registry import QUERIES

        QUERIES[args.query[0]](spark, args.query[1]).show(50, False)
        return 0
    if args.regionalise:
        if not args.national:
            p.error("--regionalise needs --national")
        from saldo.plans import regionalise

        regionalise.run_files(spark, args.national, args.regionalise, args.out, args.method, args.delta)["imports"].show(50, False)
        return 0
    if not args.project:
        p.error("a project file, --template, --find or --query is needed")
    spec = config.load(args.project)
    kind, path = spec.get("project", {}).get("table_kind"), spec.get("project", {}).get("table_path")
    t = fixture.io_table(spark, path) if kind == "fixture" else files.read_bundle(spark, path)[0]
    sectors = {r["idx"] for r in t.sector.select("idx").collect()}
    if args.plan:
        found = config.gaps(spec, sectors)
        ready = not any(s == "blocking" for s, _ in found)
        print(json.dumps({"ready": ready, "gaps": found}) if args.json else "\n".join(f"{s}: {m}" for s, m in found) or "ready")
        return 0
    project = config.build(spec, sectors)
    runs = scenario.run(t, project)
    if args.check:
        for r in runs:
            r.checks.show(truncate=False)
    else:
        report.write(project, runs, args.out)
        if args.key_alternatives:
            scenario.key_alternatives(t, project, project.scenarios[0]).show(truncate=False)
    return int(any(r.checks.where("severity = 'error' AND NOT passed").count() for r in runs))


if __name__ == "__main__":
    sys.exit(main())
