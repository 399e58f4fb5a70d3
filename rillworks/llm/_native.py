"""Column expressions over words, without Python in tasks."""

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

SPACES = " \t\n\x0b\x0c\r"


def words(text: Column) -> Column:
    """Runs of other characters than space and 9 to 13; none for null."""
    return F.array_remove(F.split(F.translate(F.coalesce(text, F.lit("")), SPACES, " " * len(SPACES)), " "), "")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with the value computed once for all the places that use it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))
