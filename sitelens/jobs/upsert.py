"""M3: keyed upsert / update / delete on a table, producing its next version.

Without a transactional table format the engine writes a new version of the
table (see ``sitelens.sources.io.write_version``) instead of mutating rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitelens.operators.windows import latest_per_key


def update_where(df: DataFrame, pred: Column, assignments: dict[str, Column]) -> DataFrame:
    """UPDATE df SET col = expr … WHERE pred (rows where pred is not TRUE stay)."""
    hit = F.coalesce(pred, F.lit(False))
    return df.select(*[(F.when(hit, assignments[c]).otherwise(F.col(c)).cast(df.schema[c].dataType).alias(c)
                        if c in assignments else F.col(c)) for c in df.columns])


def delete_where(df: DataFrame, pred: Column) -> DataFrame:
    """DELETE FROM df WHERE pred (rows where pred is NULL are kept, as in SQL)."""
    return df.where(~F.coalesce(pred, F.lit(False)))


def upsert(base: DataFrame, changes: DataFrame, key: Sequence[str], op_col: str = "op",
           ts_col: str = "ts", keep_old: Sequence[str] = ()) -> DataFrame:
    """Apply a batch of keyed changes (``op`` = 'upsert' | 'delete') to ``base``.

    * only the latest change per key counts (max by ``ts``: partial aggregate);
    * 'delete' removes the key, 'upsert' replaces or inserts the row;
    * columns in ``keep_old`` keep the base value when the change has NULL
      (e.g. an empty password keeps the old hash).
    Result = base rows without a change (anti join) ∪ upserted rows.  Running
    the same batch twice gives the same table (idempotent).
    """
    key = list(key)
    cols = base.columns
    ch = changes.select(*key, op_col, ts_col, *[c for c in cols if c not in key and c in changes.columns])
    latest = latest_per_key(ch, key, [ts_col])
    untouched = base.join(latest.select(*key), key, "left_anti")
    ups = latest.where(F.col(op_col) == "upsert")
    if keep_old:
        old = base.select(*key, *[F.col(c).alias(f"__old_{c}") for c in keep_old])
        ups = ups.join(old, key, "left")
        for c in keep_old:
            ups = ups.withColumn(c, F.coalesce(F.col(c), F.col(f"__old_{c}")))
    ups = ups.select(*[(F.col(c) if c in ups.columns else F.lit(None)).cast(base.schema[c].dataType).alias(c)
                       for c in cols])
    return untouched.unionByName(ups)
