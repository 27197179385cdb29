"""Print the registry as a markdown table: survey id → queries() key, oracle or rows-only."""

from __future__ import annotations

import os
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from sitelens.plans import REGISTRY  # noqa: E402


def main() -> None:
    print("| survey id | `queries()` key | check | what |")
    print("|---|---|---|---|")
    groups = ["C-X", "C-S", "X", "C-E", "C-G", "C-A", "C-P", "C-V", "D", "B", "U", "L", "N", "K", "F", "M", "T"]

    def order(item):
        qid = item[1].qid
        g = max((gr for gr in groups if qid.startswith(gr)), key=len)
        return groups.index(g), qid

    for name, spec in sorted(REGISTRY.items(), key=order):
        check = "DuckDB oracle" if spec.sql else "rows + tests"
        print(f"| {spec.qid} | `{name}` | {check} | {spec.title} |")
    n = len(REGISTRY)
    o = sum(1 for s in REGISTRY.values() if s.sql)
    print(f"\n{n} registered queries, {o} with an oracle SQL.")


if __name__ == "__main__":
    main()
