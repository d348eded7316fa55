"""The price formulas as SQL functions, for sessions that ask in SQL.

A temporary SQL function is a macro to Catalyst: its body stands in the plan of the
query, so pushdown and code generation see through it. The formulas are those of
functions.pricing; the tests hold both against each other.
"""

from __future__ import annotations

from pyspark.sql import SparkSession

_FIFTY = "round(CAST({0} AS DECIMAL(28,10)) / CAST(50 AS DECIMAL(4,0)), 0) * 50"
_M = "DECIMAL(38,10)"
#: Name, parameters, result and body, in the order they are made.
FUNCTIONS = (
    ("effective_cost_price", f"manual {_M}, baseline {_M}", _M, "coalesce(nullif(manual, 0), nullif(baseline, 0))"),
    ("total_cost_price", f"cost {_M}, fee {_M}", _M, "CAST(cost + coalesce(fee, 0) AS DECIMAL(38,10))"),
    ("unit_price_coefficient", f"unit {_M}", "DECIMAL(4,2)", "CASE WHEN unit > 12000 THEN 0.98 WHEN unit > 8000 THEN 1.00 WHEN unit < 3000 THEN 1.05 ELSE 1.02 END"),
    ("returns_multiple", "returns STRING", "DECIMAL(4,2)", "CASE returns WHEN 'High' THEN 1.10 WHEN 'Moderate' THEN 1.06 ELSE 1.00 END"),
    (
        "price_before_floor",
        f"unit {_M}, fee {_M}, cost {_M}, returns STRING",
        "DECIMAL(38,4)",
        "CAST(" + _FIFTY.format("CAST(CAST(CAST(cost + fee AS DECIMAL(20,4)) / CAST(0.76 AS DECIMAL(4,2)) AS DECIMAL(24,10)) * unit_price_coefficient(unit) AS DECIMAL(26,10)) * returns_multiple(returns) - fee") + " AS DECIMAL(38,4))",
    ),
    ("price_excl_shipping", f"unit {_M}, fee {_M}, cost {_M}, returns STRING", "DOUBLE", "CASE WHEN cost > 0 AND fee IS NOT NULL THEN CAST(greatest(price_before_floor(unit, fee, cost, returns), 0) AS DOUBLE) END"),
    ("price_incl_shipping", f"unit {_M}, fee {_M}, cost {_M}, returns STRING", "DOUBLE", "CASE WHEN cost > 0 AND fee IS NOT NULL THEN CAST(greatest(" + _FIFTY.format("(price_before_floor(unit, fee, cost, returns) + fee)") + ", 0) AS DOUBLE) END"),
)


def register(spark: SparkSession) -> None:
    """Makes the functions in a session; to be called again does no harm."""
    for name, parameters, result, body in FUNCTIONS:
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) RETURNS {result} RETURN {body}")
