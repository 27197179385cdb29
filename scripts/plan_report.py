"""Plan shapes of the headline queries as they would run on large inputs.

Automatic broadcasting is switched off (``autoBroadcastJoinThreshold=-1``), so
every remaining broadcast is an explicit one with a proven size bound.  The
report counts shuffles (Exchange hashpartitioning / rangepartitioning),
sort-merge joins, broadcasts, single-partition exchanges, nested-loop joins
and partial aggregates per query and writes a markdown table.
"""

from __future__ import annotations

import os
import re
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from bench import HEADLINE  # noqa: E402
from sitelens.plans import REGISTRY  # noqa: E402
from sitelens.session import get_spark  # noqa: E402
from sitelens.sources.roles import load_roles  # noqa: E402


def main() -> None:
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark = get_spark()
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")   # show the static plan
    roles = load_roles(spark, sf_dir)
    print("| query | shuffles | sort-merge joins | broadcasts (explicit, bounded) | single-partition exchanges "
          "| nested-loop joins | partial aggregates |")
    print("|---|---|---|---|---|---|---|")
    for name in HEADLINE:
        if name.startswith(("m1", "m2")):
            continue   # their key assignment checkpoints eagerly
        p = REGISTRY[name].fn(roles)._jdf.queryExecution().executedPlan().toString()
        # scalar subqueries (table counts, one-row guards) are listed once each
        shuffles = len(re.findall(r"Exchange (hash|range)partitioning", p))
        smj = p.count("SortMergeJoin")
        bcast = p.count("BroadcastExchange")
        single = p.count("Exchange SinglePartition")
        nlj = p.count("NestedLoopJoin")
        partial = len(re.findall(r"HashAggregate\(keys=\[[^\]]*\], functions=\[partial_", p))
        print(f"| `{name}` | {shuffles} | {smj} | {bcast} | {single} | {nlj} | {partial} |")


if __name__ == "__main__":
    main()
