"""Which script files are worth reading."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The six characters of the obfuscation, and the least length.
_ONLY_SYMBOLS = r"(?U)^[\s\uFEFF()\[\]!+]*+$"
_BLANK = r"(?U)[\s\uFEFF]+"
MIN_LENGTH = 20


def is_obfuscated(text: Column, min_length: int = MIN_LENGTH) -> Column:
    """Nothing but ``()[]!+`` apart from white space, and longer than ``min_length``.

    With -1 there is no least length and blank texts count as well.  Other texts
    fail at their first letter, so their length is never worked out.
    """
    return text.rlike(_ONLY_SYMBOLS) & (F.length(F.regexp_replace(text, _BLANK, "")) > min_length)


def readable(corpus: DataFrame, *, text: str = "content", min_length: int = MIN_LENGTH) -> DataFrame:
    return corpus.filter(~is_obfuscated(F.col(text), min_length))


def script_files(corpus: DataFrame, *, path: str = "path") -> DataFrame:
    """``.js`` files without their source maps."""
    return corpus.filter(F.endswith(F.col(path), F.lit(".js")))
