"""OID: comparison only, no arithmetic."""

from pyspark.sql import functions as F

from quernal.functions.common import SPACE, comparisons, fail
from quernal.registry import builtin
from quernal.types import OID, STRING


@builtin(OID, "OID_in", 740, (STRING,))
def oid_in(s):
    number = s.try_cast("decimal(38,0)")
    good = s.rlike(rf"^{SPACE}\+?[0-9]+{SPACE}$") & number.between(F.lit(OID.limits[0]), F.lit(OID.limits[1]))
    return F.when(s.isNull(), F.lit(None)).when(F.coalesce(good, F.lit(False)), number.cast("bigint")).otherwise(fail('cannot parse "', s, '" as an OID').cast("bigint"))


builtin(STRING, "OID_out", 741, (OID,))(lambda a: a.cast("string"))
comparisons(OID, 742)
