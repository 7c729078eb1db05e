"""Checks of identity numbers and papers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from vaultspark import lexicons as L
from vaultspark.functions.strings import rx


def dihedral() -> list[list[int]]:
    """Products in the group of the pentagon's symmetries: 0-4 rotate, 5-9 reflect."""
    def times(a: int, b: int) -> int:
        turn = (a + b) % 5 if a < 5 else (a - b) % 5
        return turn + 5 * ((a < 5) != (b < 5))

    return [[times(a, b) for b in range(10)] for a in range(10)]


def permutations() -> list[list[int]]:
    """The identity and seven powers of Verhoeff's permutation (fixed value)."""
    step, out = [1, 5, 7, 6, 2, 8, 3, 0, 9, 4], [list(range(10))]
    for _ in range(7):
        out.append([step[x] for x in out[-1]])
    return out


def _cells(table: list[list[int]]) -> Column:
    return F.array(*(F.lit(x) for row in table for x in row))


def verhoeff_valid(digits: Column) -> Column:
    """Whether a run of digits passes Verhoeff's check; false for anything else."""
    product, place = _cells(dihedral()), _cells(permutations())
    back = F.split(F.reverse(digits), "")
    at = F.sequence(F.lit(0), F.length(digits) - 1)
    left = F.aggregate(at, F.lit(0), lambda c, i: F.get(product, c * 10 + F.get(place, (i % 8) * 10 + F.get(back, i).cast("int"))))
    return F.when(digits.rlike(r"\A[0-9]+\z"), left == 0).otherwise(F.lit(False))


def national_id_valid(number: Column) -> Column:
    """Twelve digits but for white space, not starting with 0 or 1, that pass the check."""
    d = F.regexp_replace(number, rx(r"\s"), "")
    return (F.length(d) == 12) & ~F.substring(d, 1, 1).isin("0", "1") & verhoeff_valid(d)


def tax_holder_valid(number: Column) -> Column:
    """Ten characters whose fourth is the letter of a kind of holder."""
    n = F.upper(F.trim(number))
    return (F.length(n) == 10) & F.substring(n, 4, 1).isin(*L.TAX_HOLDERS)


def insurance_score(text: Column) -> Column:
    """How many insurers' names and marks of a policy a text holds."""
    t, total = F.lower(text), F.lit(0)
    for term in L.INSURERS + L.POLICY_MARKERS:
        total += F.contains(t, F.lit(term)).cast("int")
    return total


def has_registration(text: Column) -> Column:
    """Whether a doctor's registration number is given."""
    return text.rlike(rx(L.REGISTRATION, "i"))
