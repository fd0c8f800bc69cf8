"""Keyed permutations of 0..n-1: where a row goes in a shuffle is computed from its number alone, with no sort and no state.

A Feistel network of ROUNDS rounds over pairs (x mod a, x div a), with a * b just above n; what falls at or beyond n goes
through it again until it doesn't (cycle walking). a * b exceeds n by less than a, about the square root of n, so that
is rare, and no walk is longer than the excess. Numbers come from SHA-1 of the seed, the round and the other half, so that
columns, Python and SQL agree.
"""

from __future__ import annotations

import hashlib
from math import isqrt

from pyspark.sql import Column
from pyspark.sql import functions as F

ROUNDS = 4


def sides(n: int) -> tuple[int, int]:
    """The sizes of both halves."""
    a = isqrt(max(n, 1) - 1) + 1
    return a, -(-max(n, 1) // a)


def number(*parts: object) -> int:
    """60 bits for a key."""
    return int(hashlib.sha1(":".join(map(str, parts)).encode()).hexdigest()[:15], 16)


def number_column(*parts: Column | int | str) -> Column:
    """number() of columns and literals."""
    key = F.concat_ws(":", *[p.cast("string") if isinstance(p, Column) else F.lit(str(p)) for p in parts])
    return F.conv(F.substring(F.sha1(key.cast("binary")), 1, 15), 16, 10).cast("long")


def turned(x: int, n: int, seed: int) -> int:
    a, b = sides(n)
    left, right = x % a, x // a
    for k in range(ROUNDS):
        if k % 2:
            right = (right + number(seed, k, left)) % b
        else:
            left = (left + number(seed, k, right)) % a
    return left + a * right


def permuted(x: int, n: int, seed: int) -> int:
    """The place of x, of 0..n-1, in the permutation for the seed."""
    x = turned(x, n, seed)
    while x >= n:
        x = turned(x, n, seed)
    return x


def turned_column(x: Column, n: int, seed: Column | int) -> Column:
    a, b = sides(n)

    def turn(s: Column, k: Column) -> Column:
        odd = k % 2 == 1
        left, right = s["left"], s["right"]
        drawn = number_column(seed, k, F.when(odd, left).otherwise(right))
        return F.struct(F.when(odd, left).otherwise((left + drawn) % a).alias("left"), F.when(odd, (right + drawn) % b).otherwise(right).alias("right"))

    halves = F.struct((x % a).alias("left"), F.call_function("div", x, F.lit(a).cast("long")).alias("right"))
    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), halves, turn, lambda s: s["left"] + s["right"] * a)


def permuted_column(x: Column, n: int, seed: Column | int) -> Column:
    """permuted() of a column of numbers below n; the seed may be a column as well."""
    a, b = sides(n)
    excess = a * b - n
    first = turned_column(x.cast("long"), n, seed)
    if not excess:
        return first
    # in lambdas each value is computed once; the walk is only taken by what fell beyond n
    def walk(y: Column) -> Column:
        return F.aggregate(F.sequence(F.lit(1), F.lit(excess)), y, lambda z, _: F.when(z < n, z).otherwise(turned_column(z, n, seed)))

    return F.element_at(F.transform(F.array(first), lambda y: F.when(y < n, y).otherwise(walk(y))), 1)
