"""Text functions as column expressions; Python only where the JVM has no such function."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed value: the search tokens' form.
#: Latin words and numbers with an inner apostrophe, runs of Hangul, runs of other letters and non-decimal numbers.
TOKEN = "[A-Za-z0-9]+(?:['’][A-Za-z0-9]+)?|[가-힣]+|[\\p{L}\\p{Nl}\\p{No}&&[^A-Za-z가-힣]]+"


def tokens(text: str | Column) -> Column:
    """Search tokens, case-folded; ß is the one letter of these alphabets that folding lengthens."""
    text = F.col(text) if isinstance(text, str) else text
    found = F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0))
    return F.transform(found, lambda t: F.replace(F.lower(t), F.lit("ß"), F.lit("ss")))


def word_count(text: str) -> Column:
    return F.size(F.filter(F.split(text, r"\s+"), lambda w: w != ""))


def slug(title: str) -> Column:
    """Lower-case words joined by _, of at most 48 letters, or `section`."""
    joined = F.trim(F.regexp_replace(F.lower(title), "[^a-z0-9]+", "_"), F.lit("_"))
    return F.coalesce(F.nullif(F.left(joined, F.lit(48)), F.lit("")), F.lit("section"))


def sentences(text: str) -> Column:
    """Pieces that end in . ! or ? before white space and a capital or digit."""
    return F.split(text, r"(?<=[.!?])\s+(?=[A-Z0-9])")


def normalised(text: str) -> Column:
    """NFKC, case-folded, single spaces; the JVM functions know neither NFKC nor folding."""

    @F.pandas_udf(T.StringType())
    def fold(values: pd.Series) -> pd.Series:
        return values.map(lambda v: None if v is None else " ".join(unicodedata.normalize("NFKC", v).casefold().split()))

    return fold(F.col(text))


def display_name(text: str) -> Column:
    """NFKC and single spaces, none just inside brackets."""

    @F.pandas_udf(T.StringType())
    def tidy(values: pd.Series) -> pd.Series:
        def one(v: str) -> str:
            v = " ".join(unicodedata.normalize("NFKC", v).split())
            return re.sub(r"\s+\)", ")", re.sub(r"\(\s+", "(", v))

        return values.map(lambda v: None if v is None else one(v))

    return tidy(F.col(text))


def redacted(text: str) -> Column:
    """Keys, bearer tokens and passwords replaced."""
    out = F.regexp_replace(F.col(text), r"(?i)\b(bearer\s+)[A-Za-z0-9._~+/=-]{8,}", "$1[redacted]")
    out = F.regexp_replace(out, r"(?i)\b((?:api[_-]?key|token|secret|password)\s*[=:]\s*)\"?[^\s\",;]+\"?", "$1[redacted]")
    return F.regexp_replace(out, r"\bsk-[A-Za-z0-9_-]{16,}", "[redacted]")


def safe_rate(part: Column, whole: Column) -> Column:
    """part / whole, 0 where the whole is 0."""
    return F.coalesce(F.try_divide(part, whole), F.lit(0.0))


def token_cost(inputs: str, cached: str, outputs: str, price_in: float, price_cached: float, price_out: float) -> Column:
    return F.round(((F.col(inputs) - F.col(cached)) * price_in + F.col(cached) * price_cached + F.col(outputs) * price_out) / 1e6, 12)


def cosine(a: str, b: str) -> Column:
    """Inner product over norms, in double precision and array order."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return dot(F.col(a), F.col(b)) / (F.sqrt(dot(F.col(a), F.col(a))) * F.sqrt(dot(F.col(b), F.col(b))))


def valid_vector(column: str, size: int, tolerance: float = 1e-5) -> Column:
    """Of the right size, finite, and of unit norm within the tolerance."""
    v = F.col(column)
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return F.coalesce((F.size(v) == size) & finite & (F.abs(norm - 1) <= tolerance), F.lit(False))
