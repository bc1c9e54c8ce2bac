"""Checks of identity numbers as column expressions. Each takes a text column and gives a boolean
(false for anything of the wrong shape, null for null)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def normal(value: Column) -> Column:
    """Without blanks, dots and dashes."""
    return F.regexp_replace(value, r"(?U)[\s.\-]", "")


def _digits(value: Column) -> Column:
    return F.transform(F.split(value, ""), lambda c: c.cast("int"))


def _weighted(digits: Column, weights: list[int]) -> Column:
    total = F.lit(0)
    for i, w in enumerate(weights):
        total = total + F.element_at(digits, i + 1) * w
    return total


def _checked(value: Column, shape: str, test) -> Column:
    """test(digits) where the normal form has the shape; digits are read only then."""
    v = normal(value)
    return F.when(v.isNull(), None).when(v.rlike(shape), test(_digits(F.when(v.rlike(shape), v)))).otherwise(False)


def tckn(value: Column) -> Column:
    """Eleven digits, first not 0; the tenth and eleventh are check digits."""

    def test(d: Column) -> Column:
        odd, even = _weighted(d, [1, 0, 1, 0, 1, 0, 1, 0, 1]), _weighted(d, [0, 1, 0, 1, 0, 1, 0, 1, 0])
        return (F.pmod(odd * 7 - even, F.lit(10)) == F.element_at(d, 10)) & (_weighted(d, [1] * 10) % 10 == F.element_at(d, 11))

    return _checked(value, "^[1-9][0-9]{10}$", test)


def cpf(value: Column) -> Column:
    """Eleven digits, not all alike; two check digits by weights down to 2, modulo 11."""

    def test(d: Column) -> Column:
        check = lambda n: F.when(_weighted(d, list(range(n + 1, 1, -1))) * 10 % 11 == 10, 0).otherwise(_weighted(d, list(range(n + 1, 1, -1))) * 10 % 11)
        return (F.size(F.array_distinct(d)) > 1) & (check(9) == F.element_at(d, 10)) & (check(10) == F.element_at(d, 11))

    return _checked(value, "^[0-9]{11}$", test)


def ssn(value: Column) -> Column:
    """Nine digits; area not 000, 666 or 9xx, group not 00, serial not 0000."""
    return _checked(value, "^[0-9]{9}$", lambda d: F.array_join(d, "").rlike("^(?!000|666|9)[0-9]{3}(?!00)[0-9]{2}(?!0000)[0-9]{4}$"))


def iban_remainder(value: Column) -> Column:
    """The number that the rearranged IBAN spells, modulo 97; 1 for a valid one. Null for other characters."""
    v = F.upper(normal(value))
    turned = F.concat(F.substring(v, 5, 1000), F.substring(v, 1, 4))
    chars = F.split(F.when(v.rlike("^[0-9A-Z]+$"), turned), "")

    def step(rest: Column, c: Column) -> Column:
        number = F.when(c.rlike("^[0-9]$"), c.cast("int")).otherwise(F.ascii(c) - 55)
        return (rest * F.when(number > 9, 100).otherwise(10) + number) % 97

    return F.aggregate(chars, F.lit(0), step)


def iban(value: Column) -> Column:
    v = F.upper(normal(value))
    return F.when(v.isNull(), None).otherwise(v.rlike("^[A-Z]{2}[0-9]{2}[0-9A-Z]{11,30}$") & (F.coalesce(iban_remainder(value), F.lit(0)) == 1))


def _dihedral(a: int, b: int) -> int:
    """The group of the pentagon: 0-4 turn it, 5-9 turn and flip it."""
    if a < 5:
        return (a + b) % 5 if b < 5 else 5 + (a + b - 5) % 5
    return 5 + (a - b) % 5 if b < 5 else (a - b) % 5


#: Where a digit goes for each place, counted from the right.
_PLACE = [[0, 1, 2, 3, 4, 5, 6, 7, 8, 9], [1, 5, 7, 6, 2, 8, 3, 0, 9, 4]]
while len(_PLACE) < 8:
    _PLACE.append([_PLACE[1][x] for x in _PLACE[-1]])


def verhoeff_remainder(digits: Column) -> Column:
    """0 where the last of the digits is the right check digit."""
    place = F.array(*[F.lit(x) for row in _PLACE for x in row])
    group = F.array(*[F.lit(_dihedral(a, b)) for a in range(10) for b in range(10)])
    turned = F.reverse(digits)
    placed = F.transform(turned, lambda d, i: F.element_at(place, (i % 8) * 10 + d + 1))
    return F.aggregate(placed, F.lit(0), lambda c, p: F.element_at(group, c * 10 + p + 1))


def aadhaar(value: Column) -> Column:
    """Twelve digits, first 2 to 9, with a Verhoeff check digit."""
    return _checked(value, "^[2-9][0-9]{11}$", lambda d: verhoeff_remainder(d) == 0)


def verhoeff_digit(value: Column) -> Column:
    """The digit that, put behind the digits of value, makes them pass."""
    rest = verhoeff_remainder(F.concat(_digits(value), F.array(F.lit(0))))
    return F.element_at(F.array(*[F.lit(next(b for b in range(10) if _dihedral(a, b) == 0)) for a in range(10)]), rest + 1)


def luhn_digit(value: Column) -> Column:
    """The digit that completes value for the Luhn test."""

    def part(d: Column, i: Column) -> Column:
        return F.when(i % 2 == 1, d).when(d > 4, 2 * d - 9).otherwise(2 * d)

    total = F.aggregate(F.transform(F.reverse(_digits(value)), part), F.lit(0), lambda a, x: a + x)
    return (10 - total % 10) % 10


def luhn(value: Column) -> Column:
    return _checked(value, "^[0-9]{2,}$", lambda d: luhn_digit(F.array_join(F.slice(d, 1, F.size(d) - 1), "")) == F.element_at(d, -1))


CHECKS = {"tckn": tckn, "cpf": cpf, "ssn": ssn, "iban": iban, "aadhaar": aadhaar, "luhn": luhn}


def detailed(kind: str, value: Column) -> Column:
    """Whether the value passes, and its normal form."""
    return F.struct(CHECKS[kind](value).alias("valid"), normal(value).alias("normal"))
