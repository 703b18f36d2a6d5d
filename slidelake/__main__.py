"""Times variants of the tissue filter: python -m slidelake list | all | CATEGORY | VERSION ... --slides PATH [--json FILE]."""

from __future__ import annotations

import argparse
import datetime
import sys

from .plans import harness
from .session import build_session

REPORTS = {"speedup": lambda r: harness.report(r, "base"), "kernel": harness.kernel_report, "summary": harness.summary_report, "sections": harness.section_report}


def chosen(names: list[str]) -> list[str]:
    """Versions by name, alias, category or all, each once, in the registry's order; an unknown name raises ValueError."""
    known = {**{v: [v] for v in harness.REGISTRY}, **{a: [v] for a, v in harness.ALIASES.items()}, "all": list(harness.REGISTRY)}
    for v, (category, _) in harness.REGISTRY.items():
        known.setdefault(category, []).append(v)
    unknown = [n for n in names if n not in known]
    if unknown:
        raise ValueError(f"unknown: {', '.join(unknown)}; try list")
    wanted = {v for n in names for v in known[n]}
    return [v for v in harness.REGISTRY if v in wanted]


def main(arguments: list[str] | None = None, spark=None) -> int:
    p = argparse.ArgumentParser(prog="slidelake")
    p.add_argument("versions", nargs="+")
    p.add_argument("--slides")
    p.add_argument("--patch", type=int, default=1024)
    p.add_argument("--stride", type=int, default=1024)
    p.add_argument("--iterations", type=int, default=3)
    p.add_argument("--no-warm-up", action="store_true")
    p.add_argument("--json")
    p.add_argument("--report", choices=sorted(REPORTS), default="speedup")
    a = p.parse_args(arguments)
    if a.versions == ["list"]:
        for v, (category, _) in harness.REGISTRY.items():
            print(f"{v:16} {category}")
        for alias, v in harness.ALIASES.items():
            print(f"{alias:16} = {v}")
        return 0
    try:
        versions = chosen(a.versions)
    except ValueError as e:
        p.error(str(e))
    if not a.slides:
        p.error("--slides is needed")
    spark = spark or build_session("slidelake", "local[*]")
    metrics, kept = harness.measure(spark, a.slides, versions, a.iterations, not a.no_warm_up, patch=a.patch, stride=a.stride)
    good = metrics.where("failed is null")
    for r in REPORTS[a.report](good).orderBy("ord").collect():
        print(r.line)
    for r in metrics.where("failed is not null").collect():
        print(f"{r.version}: {r.failed}", file=sys.stderr)
    if a.json:
        meta = {"script": "slidelake", "wsi": a.slides, "patch_size": a.patch, "stride": a.stride, "iterations": a.iterations, "warmup": not a.no_warm_up, "timestamp": datetime.datetime.now().strftime("%Y%m%d_%H%M%S")}
        with open(a.json, "w") as f:
            f.write(harness.document(metrics, meta))
    for df in kept.values():
        df.unpersist()
    return 1 if metrics.where("failed is not null").count() else 0


if __name__ == "__main__":
    sys.exit(main())
