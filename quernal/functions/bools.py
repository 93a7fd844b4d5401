"""BOOL: three-valued logic; false sorts before true."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from quernal.functions.common import comparisons, fail
from quernal.registry import builtin
from quernal.types import BOOL, STRING


@builtin(BOOL, "BOOL_in", 770, (STRING,))
def bool_in(s: Column) -> Column:
    bad = fail('cannot parse "', s, '" as a BOOL').cast("boolean")
    return F.when(s.isNull(), F.lit(None)).when(s.rlike("^(?i:true|t|yes|y|1)$"), F.lit(True)).when(s.rlike("^(?i:false|f|no|n|0)$"), F.lit(False)).otherwise(bad)


builtin(STRING, "BOOL_out", 771, (BOOL,))(lambda a: a.cast("string"))
builtin(BOOL, "BOOL_not", 772, (BOOL,), ("NOT",))(lambda a: ~a)
builtin(BOOL, "BOOL_or", 773, (BOOL, BOOL), ("OR",))(lambda a, b: a | b)
builtin(BOOL, "BOOL_and", 774, (BOOL, BOOL), ("AND",))(lambda a, b: a & b)
comparisons(BOOL, 776)
