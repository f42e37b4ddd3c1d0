"""Functions that need Unicode decomposition, which Spark lacks: Arrow-batched Pandas functions."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

_NO_TOKEN = re.compile(r"[^\w\s-]|_")
_NO_SLUG = re.compile(r"[^A-Za-z0-9_\s-]")


def tokens_of(text: str | None) -> list[str]:
    """Lower case, decomposed, everything but letters, digits, hyphens and space as space; words longer than two characters.

    Combining marks become spaces: a decomposed letter splits its word there.
    """
    if not text:
        return []
    return [w for w in _NO_TOKEN.sub(" ", unicodedata.normalize("NFKD", text.lower())).split() if len(w) > 2]


def slug_of(text: str | None) -> str | None:
    """Lower case, decomposed, other than ASCII word characters, space and hyphen dropped; runs of space, `_`, `-` as one `-`."""
    if text is None:
        return None
    kept = _NO_SLUG.sub("", unicodedata.normalize("NFKD", text.lower())).strip()
    return re.sub(r"[\s_-]+", "-", kept).strip("-")


@F.pandas_udf(T.ArrayType(T.StringType()))
def tokens(c: pd.Series) -> pd.Series:
    return c.map(tokens_of)


@F.pandas_udf(T.StringType())
def slugs(c: pd.Series) -> pd.Series:
    return c.map(slug_of)
