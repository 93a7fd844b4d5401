"""Built-in functions on streams: they are Columns, so a stream takes them like any table. The catalog has no operator of its own for streams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

import quernal.functions  # noqa: F401
from quernal import registry
from quernal.errors import EngineError


def with_results(rows: DataFrame, **calls: tuple[str, ...]) -> DataFrame:
    """rows, streaming or not, with a column for each call: the name of a function, and of the columns it takes."""
    out = {}
    for column, (name, *args) in calls.items():
        function = registry.find_by_name(name)
        if function is None or len(function.args) != len(args):
            raise EngineError(f"there is no function {name} of {len(args)} arguments")
        out[column] = function(*map(F.col, args))
    return rows.withColumns(out)
