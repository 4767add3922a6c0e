"""The affine hash family behind both sketches."""

from __future__ import annotations

import random
from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: the prime modulus of the hash family.
HASH_PRIME = 8191

_INT_SPAN = 1 << 32
_INT_HALF = 1 << 31


class HashRow(NamedTuple):
    """Parameters of one sketch row: bucket hash (a, b) and, for Count sketch, sign hash."""

    a: int
    b: int
    a_sign: int = 1
    b_sign: int = 0


class SketchParams(NamedTuple):
    """D rows of hash parameters and the number W of counters per row."""

    rows: tuple[HashRow, ...]
    width: int

    @property
    def depth(self) -> int:
        return len(self.rows)

    @property
    def cells(self) -> int:
        return self.depth * self.width

    def checked(self) -> SketchParams:
        if self.depth < 1 or self.width < 1:
            raise ValueError("a sketch needs at least one row and one column")
        for row in self.rows:
            if not (1 <= row.a < HASH_PRIME and 1 <= row.a_sign < HASH_PRIME):
                raise ValueError(f"a must lie in [1, {HASH_PRIME - 1}]: {row}")
            if not (0 <= row.b < HASH_PRIME and 0 <= row.b_sign < HASH_PRIME):
                raise ValueError(f"b must lie in [0, {HASH_PRIME - 1}]: {row}")
        return self


def draw_params(depth: int, width: int, seed: int | None = None) -> tuple[SketchParams, SketchParams]:
    """Independent random parameters for a Count-Min sketch and a Count sketch."""
    rng = random.Random(seed)

    def pair() -> tuple[int, int]:
        return rng.randint(1, HASH_PRIME - 1), rng.randint(0, HASH_PRIME - 1)

    drawn = [(pair(), pair(), pair()) for _ in range(depth)]
    count_min = SketchParams(tuple(HashRow(*bucket) for bucket, _, _ in drawn), width)
    count = SketchParams(tuple(HashRow(*bucket, *sign) for _, bucket, sign in drawn), width)
    return count_min.checked(), count.checked()


def affine_hash(item: Column, a: int | Column, b: int | Column) -> Column:
    """``(a * item + b) % prime`` in wrapping 32-bit arithmetic, sign following the dividend.

    The product is taken in 64 bits and wrapped by hand, since ANSI mode raises on overflow.
    """
    wide = item.cast("bigint") * a + (b + (_INT_HALF if isinstance(b, int) else F.lit(_INT_HALF)))
    wrapped = wide.bitwiseAND(F.lit(_INT_SPAN - 1)) - _INT_HALF
    return wrapped % HASH_PRIME


def wrapped_int(wide: Column) -> Column:
    """A 64-bit value as a 32-bit integer by its low bits; a cast would raise in ANSI mode."""
    return ((wide.bitwiseAND(F.lit(_INT_SPAN - 1)) + _INT_HALF).bitwiseAND(F.lit(_INT_SPAN - 1)) - _INT_HALF).cast("int")


def row_struct(row: HashRow, **more: Column) -> Column:
    """The parameters of a sketch row as one value, with further fields."""
    return F.struct(*[F.lit(v).alias(n) for n, v in row._asdict().items()], *[c.alias(n) for n, c in more.items()])


def bucket(item: Column, row: Column, width: int | Column) -> Column:
    """Column in [0, width) that the item falls into, for a ``row_struct``."""
    width = F.lit(width) if isinstance(width, int) else width
    return F.pmod(affine_hash(item, row["a"], row["b"]), width).cast("int")


def sign(item: Column, row: Column) -> Column:
    """+1 or -1, for a ``row_struct``; an odd remainder of either sign gives -1."""
    return F.when(affine_hash(item, row["a_sign"], row["b_sign"]) % 2 == 0, 1).otherwise(-1)
