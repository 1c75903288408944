"""Arrow-batched functions for what no built-in expression says: Unicode normal forms, the sequence matcher."""

from __future__ import annotations

import difflib

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType


def _strings(t: pd.Series) -> pa.Array:
    return pa.array(t, pa.large_string(), from_pandas=True)


@F.pandas_udf(StringType())
def nfkc(t: pd.Series) -> pd.Series:
    return pc.utf8_normalize(_strings(t), "NFKC").to_pandas()


@F.pandas_udf(StringType())
def nfd_without_accents(t: pd.Series) -> pd.Series:
    """Decomposed, without U+0300 to U+036F; Arabic vowel marks stay."""
    return pc.replace_substring_regex(pc.utf8_normalize(_strings(t), "NFD"), "[\u0300-\u036f]", "").to_pandas()


@F.pandas_udf(DoubleType())
def similarity(a: pd.Series, b: pd.Series) -> pd.Series:
    """Sequence-matcher ratio without case; 0 if either is null or empty (T4)."""
    return pd.Series([difflib.SequenceMatcher(None, x.lower(), y.lower()).ratio() if x and y else 0.0 for x, y in zip(a, b, strict=True)])
