"""64-bit XXH3 of texts, as unpadded hex."""

from __future__ import annotations

import pandas as pd
import xxhash
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


@F.pandas_udf(StringType())
def xxh3_hex(content: pd.Series) -> pd.Series:
    """Null for null; Spark's own ``xxhash64`` is another function."""
    return content.map(lambda s: None if s is None else f"{xxhash.xxh3_64_intdigest(s.encode('utf-8', 'surrogatepass')):x}")
