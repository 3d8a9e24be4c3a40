"""Half-even rounding in doubles, as the SQL of the queries has it."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def half_even(value: Column, digits: int = 0, slack: int = 0) -> Column:
    """``value`` rounded half-even after scaling in doubles.

    ``bround`` looks at the shortest decimal of a double and so parts from the SQL where a computed value lies one bit beside
    a tie. Sums whose rows come in any order err by some bits: with ``slack``, what lies so many bits beside a tie is one.
    """
    scaled = value * 10.0**digits
    whole = F.rint(scaled)
    if slack:
        tie = F.abs(F.abs(scaled - whole) - 0.5) <= F.abs(scaled) * slack * 2.0**-52
        whole = F.when(tie, 2 * F.rint(scaled / 2)).otherwise(whole)
    return whole / 10.0**digits
