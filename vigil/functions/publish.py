"""Output shaping shared by the registered queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import types as T

# Published doubles are rounded (HALF_UP) to this many decimals; aggregation
# order differs between engines in the last bits, the rounded value does not.
PUBLISH_DIGITS = 8


def publish(df: DataFrame, digits: int = PUBLISH_DIGITS) -> DataFrame:
    """Round every double / float column; leave everything else as is (one
    ``selectExpr`` call, however wide the frame)."""
    exprs = []
    for f in df.schema.fields:
        name = f"`{f.name}`"
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            exprs.append(f"round(CAST({name} AS DOUBLE), {int(digits)}) AS {name}")
        else:
            exprs.append(name)
    return df.selectExpr(*exprs)
