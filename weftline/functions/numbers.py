"""Number words, NFKC and the full matching normalisation, as Arrow functions."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# English number words.
ONES = "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen".split()
TENS = "twenty thirty forty fifty sixty seventy eighty ninety".split()
LARGEST = 999_999


def spell(n: int) -> str:
    """English words of 0 to LARGEST, with `and` and commas as in British usage."""
    if n < 20:
        return ONES[n]
    if n < 100:
        return TENS[n // 10 - 2] + (f"-{ONES[n % 10]}" if n % 10 else "")
    if n < 1000:
        return f"{ONES[n // 100]} hundred" + (f" and {spell(n % 100)}" if n % 100 else "")
    rest = n % 1000
    joint = " and " if 0 < rest < 100 else ", "
    return f"{spell(n // 1000)} thousand" + (joint + spell(rest) if rest else "")


def normalize_for_matching(text: str | None, numbers: bool = True) -> str | None:
    """Lower, NFKC, hyphens to blanks, word characters only, digits to words, single blanks."""
    if text is None:
        return None
    plain = re.sub(r"[^\w\s]", "", unicodedata.normalize("NFKC", text.lower()).replace("-", " "))
    if numbers:
        plain = re.sub(r"\d+", lambda m: spell(int(m[0])) if int(m[0]) <= LARGEST else m[0], plain)
    return " ".join(plain.split())


@F.pandas_udf(StringType())
def matching_column(text: pd.Series) -> pd.Series:
    return text.map(normalize_for_matching, na_action="ignore")


def nfkc(text: str) -> Column:
    @F.pandas_udf("string")
    def run(column: pd.Series) -> pd.Series:
        return column.map(lambda x: unicodedata.normalize("NFKC", x), na_action="ignore")

    return run(text)
