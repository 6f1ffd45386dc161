"""Normal distribution and signatures: functions that Spark SQL lacks, as Arrow batches."""

from __future__ import annotations

import hashlib
import hmac
import math

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T


@F.pandas_udf(T.DoubleType())
def normal_cdf(z: pd.Series) -> pd.Series:
    erf = np.frompyfunc(math.erf, 1, 1)
    return pd.Series(0.5 * (1 + erf(z.to_numpy(float) / math.sqrt(2)).astype(float)))


def hmac_sha256(secret: str):
    """A signature column function: hex HMAC-SHA256 of a text column under a secret."""

    @F.pandas_udf(T.StringType())
    def sign(s: pd.Series) -> pd.Series:
        return s.map(lambda x: None if x is None else hmac.new(secret.encode(), x.encode(), hashlib.sha256).hexdigest())

    return sign
