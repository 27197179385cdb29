"""SQL fragments for oracle texts, typed like the Spark side (functions/numeric.py)."""


def s_sum(x: str) -> str:
    return f"CAST(SUM({x}) AS DECIMAL(20,2))"


def s_avg(x: str) -> str:
    return f"CAST(AVG({x}) AS DECIMAL(14,6))"


def s_ravg(x: str, n: int = 2) -> str:
    return f"CAST(ROUND(CAST(AVG({x}) AS DECIMAL(14,6)), {n}) AS DECIMAL(14,{n}))"


def s_avgi(x: str) -> str:
    return f"CAST(AVG({x}) AS DECIMAL(14,4))"


def s_ravgi(x: str, n: int = 2) -> str:
    return f"CAST(ROUND(CAST(AVG({x}) AS DECIMAL(14,4)), {n}) AS DECIMAL(14,{n}))"


def profile_sql(table: str) -> str:
    """The exact column profile of a role table, one SELECT per declared column."""
    from sitelens.sources.roles import ROLE_SCHEMAS
    return " UNION ALL ".join(
        f"""SELECT '{table}' AS table_name, {i} AS ordinal, '{f.name}' AS column_name,
 '{f.dataType.simpleString()}' AS data_type, {str(f.nullable).upper()} AS is_nullable, COUNT(*) AS row_count,
 COUNT(*) - COUNT({f.name}) AS nulls, COUNT(DISTINCT {f.name}) AS distinct_values,
 CAST(MIN({f.name}) AS VARCHAR) AS min_value, CAST(MAX({f.name}) AS VARCHAR) AS max_value FROM {table}"""
        for i, f in enumerate(ROLE_SCHEMAS[table].fields, 1))
