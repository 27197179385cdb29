"""Column-expression helpers (all JVM-side built-ins; no Python UDFs)."""

from sitelens.functions.numeric import avg_exact, avg_int, ravg, ravg_int, sum2, as_dec
from sitelens.functions.text import excerpt, ellipsis, like_escape, contains_like, tokens, boolean_match
from sitelens.functions.dates import month_bucket, months_before, day_lit, ts_lit
from sitelens.functions.ordering import field_order, tie_break

__all__ = [
    "avg_exact", "avg_int", "ravg", "ravg_int", "sum2", "as_dec",
    "excerpt", "ellipsis", "like_escape", "contains_like", "tokens", "boolean_match",
    "month_bucket", "months_before", "day_lit", "ts_lit",
    "field_order", "tie_break",
]
