"""Command-line runner for the named catalogue.

    python -m sitelens list [PATTERN]
    python -m sitelens run KEY --data DIR [-p name=value ...] [--show N | --out PATH --format csv|json|parquet]
    python -m sitelens explain KEY --data DIR [-p name=value ...]

Only registered keys run (the catalogue is the allow-list); parameter values
are JSON literals (``-p k=50``, ``-p statuses='["successful"]'``), anything
that is not valid JSON is taken as a string.  Output files are written by the
executors (one part file per partition), never collected to the driver; only
``--show`` prints the first N rows.
"""

from __future__ import annotations

import argparse
import json
import sys

from sitelens.plans import REGISTRY
from sitelens.session import get_spark
from sitelens.sources.io import export_csv, write_json, write_parquet
from sitelens.sources.roles import load_roles


def _params(items: list[str]) -> dict:
    out = {}
    for it in items or []:
        k, _, v = it.partition("=")
        try:
            val = json.loads(v)
        except json.JSONDecodeError:
            val = v
        out[k] = tuple(val) if isinstance(val, list) else val
    return out


def main(argv: list[str] | None = None) -> int:
    ap = argparse.ArgumentParser(prog="sitelens")
    sub = ap.add_subparsers(dest="cmd", required=True)
    ls = sub.add_parser("list")
    ls.add_argument("pattern", nargs="?", default="")
    for name in ("run", "explain"):
        p = sub.add_parser(name)
        p.add_argument("key")
        p.add_argument("--data", required=True, help="folder with the source Parquet tables")
        p.add_argument("-p", "--param", action="append", default=[])
        if name == "run":
            p.add_argument("--show", type=int, default=20)
            p.add_argument("--out")
            p.add_argument("--format", choices=["csv", "json", "parquet"], default="parquet")
    a = ap.parse_args(argv)

    if a.cmd == "list":
        for name, spec in REGISTRY.items():
            if a.pattern in name:
                print(f"{name:60s} {'oracle' if spec.sql else '      '}  {spec.title}")
        return 0

    if a.key not in REGISTRY:
        print(f"unknown query {a.key!r}; see `python -m sitelens list`", file=sys.stderr)
        return 2
    spark = get_spark()
    df = REGISTRY[a.key].fn(load_roles(spark, a.data), **_params(a.param))
    if a.cmd == "explain":
        df.explain("formatted")
        return 0
    if a.out:
        {"csv": export_csv, "json": write_json, "parquet": write_parquet}[a.format](df, a.out)
        print(a.out)
    else:
        df.show(a.show, truncate=60)
    return 0


if __name__ == "__main__":
    sys.exit(main())
