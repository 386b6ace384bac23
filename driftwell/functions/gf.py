"""Arithmetic in the field of integers modulo a prime, and on polynomials over it (ascending coefficients)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The default prime, 2**31 - 1. Products of two elements stay below 2**62.
PRIME = 2147483647


def add(a: Column, b: Column, p: int = PRIME) -> Column:
    if p > LONG_PRODUCTS:  # the sum itself may leave the range of a long
        a, b = (F.pmod(x.cast("long"), F.lit(p).cast("long")) for x in (a, b))
        return F.when(a >= F.lit(p) - b, a - (F.lit(p) - b)).otherwise(a + b)
    return F.pmod(a + b, F.lit(p).cast("long"))


#: The greatest modulus whose products fit a long; beyond, decimals of 38 digits hold those of moduli below 2**63.
LONG_PRODUCTS = 3037000499


def mul(a: Column, b: Column, p: int = PRIME) -> Column:
    if p > LONG_PRODUCTS:
        wide = [F.pmod(x.cast("long"), F.lit(p).cast("long")).cast("decimal(19,0)") for x in (a, b)]
        return ((wide[0] * wide[1]).cast("decimal(38,0)") % F.lit(p).cast("decimal(19,0)")).cast("long")
    return F.pmod(F.pmod(a, F.lit(p).cast("long")) * F.pmod(b, F.lit(p).cast("long")), F.lit(p).cast("long"))


def power(a: Column, n: int, p: int = PRIME) -> Column:
    """Square and multiply over the bits of a fixed exponent, as one fold."""
    bits = F.array(*[F.lit(int(b)) for b in bin(n)[2:]])
    one, base = F.lit(1).cast("long"), a.cast("long")
    return F.aggregate(bits, one, lambda acc, bit: F.when(bit == 1, mul(mul(acc, acc, p), base, p)).otherwise(mul(acc, acc, p)))


def inverse(a: Column, p: int = PRIME) -> Column:
    """a**(p-2); raises for 0."""
    return F.when(F.pmod(a, F.lit(p).cast("long")) == 0, F.raise_error(F.lit("division by zero in the field"))).otherwise(power(a, p - 2, p))


def divide(a: Column, b: Column, p: int = PRIME) -> Column:
    return mul(a, inverse(b, p), p)


def horner(coefficients: list[int], x: Column, p: int = PRIME) -> Column:
    """Value of a polynomial at x."""
    high_first = F.array(*[F.lit(c % p).cast("long") for c in reversed(coefficients)])
    return F.aggregate(high_first, F.lit(0).cast("long"), lambda acc, c: add(mul(acc, x.cast("long"), p), c, p))


def poly_value(coefficients: list[int], x: int, p: int = PRIME) -> int:
    total = 0
    for c in reversed(coefficients):
        total = (total * x + c) % p
    return total


def _trim(a: list[int]) -> list[int]:
    while a and not a[-1]:
        a = a[:-1]
    return a


def poly_divmod(a: list[int], b: list[int], p: int) -> tuple[list[int], list[int]]:
    a, b = _trim([x % p for x in a]), _trim([x % p for x in b])
    lead = pow(b[-1], -1, p)
    quotient = [0] * max(len(a) - len(b) + 1, 0)
    while len(a) >= len(b):
        factor, at = a[-1] * lead % p, len(a) - len(b)
        quotient[at] = factor
        a = _trim([(x - factor * b[i - at]) % p if i >= at else x for i, x in enumerate(a)])
    return quotient, a


def poly_gcd(a: list[int], b: list[int], p: int) -> list[int]:
    a, b = _trim(a), _trim(b)
    while b:
        a, b = b, poly_divmod(a, b, p)[1]
    return [x * pow(a[-1], -1, p) % p for x in a]


def solve(rows: list[list[int]], p: int) -> list[int] | None:
    """A solution of the linear system whose rows end in the right side (free variables 0), or None."""
    rows = [[x % p for x in r] for r in rows]
    unknowns = len(rows[0]) - 1 if rows else 0
    pivots: list[int] = []
    at = 0
    for column in range(unknowns):
        pivot = next((i for i in range(at, len(rows)) if rows[i][column]), None)
        if pivot is None:
            continue
        rows[at], rows[pivot] = rows[pivot], rows[at]
        scale = pow(rows[at][column], -1, p)
        rows[at] = [x * scale % p for x in rows[at]]
        for i, row in enumerate(rows):
            if i != at and row[column]:
                factor = row[column]
                rows[i] = [(x - factor * y) % p for x, y in zip(row, rows[at], strict=True)]
        pivots.append(column)
        at += 1
    if any(r[-1] for r in rows[at:]):
        return None
    out = [0] * unknowns
    for i, column in enumerate(pivots):
        out[column] = rows[i][-1]
    return out


def rational(xs: list[int], values: list[int], difference: int, p: int = PRIME) -> tuple[list[int], list[int]] | None:
    """Monic P and Q without a common factor, deg P - deg Q = ``difference``, with P(x)/Q(x) = value at each x.

    The degrees are the largest that the number of points determines. None if there is no solution.
    """
    n = len(xs)
    if abs(difference) > n:
        return None
    up, down = (n + difference) // 2, (n - difference) // 2
    rows = []
    for x, v in zip(xs, values, strict=True):
        powers = [1]
        for _ in range(max(up, down)):
            powers.append(powers[-1] * x % p)
        rows.append([*powers[:up], *[-v * y % p for y in powers[:down]], (v * powers[down] - powers[up]) % p])
    found = solve(rows, p) if up + down else []
    if found is None:
        return None
    top, bottom = [*found[:up], 1], [*found[up:], 1]
    common = poly_gcd(top, bottom, p)
    return poly_divmod(top, common, p)[0], poly_divmod(bottom, common, p)[0]
