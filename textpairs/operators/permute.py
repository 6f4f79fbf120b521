"""Permutations by arithmetic (W1, W8: a fresh order per epoch; J2: pairs by number).

``permute`` maps 0..n-1 onto itself one to one by a Feistel network over the
mixed-radix digits of a number, so a row's place in a seeded random order, and
the row at a place, follow from its dense number alone: no sort, no exchange,
no state, and another seed or epoch is another order.

The digits are ``(x div b, x mod b)`` with ``a = ceil(sqrt(n))`` and
``b = ceil(n / a)``; a round adds a keyed function of one digit to the other.
``a * b`` exceeds ``n`` by less than ``a``: a result outside 0..n-1 is put
through again until it falls inside (cycle walking), which keeps the map one to
one and is rarely needed.  All arithmetic fits 64 bits for n up to 2**60.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROUNDS = 6
#: Fixed value: the Mersenne prime 2**31 - 1.
PRIME = (1 << 31) - 1
MAX_WALK = 64


def round_keys(seed, rounds: int = ROUNDS) -> list[tuple[int, int]]:
    """A multiplier and an offset for every round."""
    out = []
    for r in range(rounds):
        h = hashlib.md5(f"{seed}:{r}".encode()).hexdigest()
        out.append((int(h[:8], 16) % (PRIME - 1) + 1, int(h[8:16], 16) % PRIME))
    return out


def _long(x) -> Column:
    return (x if isinstance(x, Column) else F.lit(x)).cast("long")


def _div(x: Column, y: Column) -> Column:
    return F.call_function("div", x, y)


def _keyed(x: Column, key: Column, tweak: Column) -> Column:
    """A number below ``PRIME`` that depends on a digit, the round key and the tweak."""
    t = ((x + tweak) % PRIME * key["a"] + key["b"]) % PRIME
    return t * (t + 1) % PRIME


def _sizes(n: Column) -> tuple[Column, Column]:
    a = F.greatest(F.ceil(F.sqrt(n.cast("double"))).cast("long"), F.lit(1).cast("long"))
    return a, _div(n + a - 1, a)


def _network(x: Column, n: Column, keys: Sequence[tuple[int, int]], tweak: Column, forward: bool) -> Column:
    """One pass through the rounds: a fold over the round keys of (left digit, right digit, their sizes)."""
    a, b = _sizes(n)
    table = F.array(*[F.struct(_long(m).alias("a"), _long(o).alias("b")) for m, o in (keys if forward else keys[::-1])])
    start = F.struct(_div(x, b).alias("l"), (x % b).alias("r"), a.alias("ml"), b.alias("mr"))

    def step(s: Column, k: Column) -> Column:
        return F.struct(s["r"].alias("l"), ((s["l"] + _keyed(s["r"], k, tweak)) % s["ml"]).alias("r"),
                        s["mr"].alias("ml"), s["ml"].alias("mr"))

    def back(s: Column, k: Column) -> Column:
        left = (s["r"] - _keyed(s["l"], k, tweak) % s["mr"] + s["mr"]) % s["mr"]
        return F.struct(left.alias("l"), s["l"].alias("r"), s["mr"].alias("ml"), s["ml"].alias("mr"))

    return F.aggregate(table, start, step if forward else back, lambda s: s["l"] * s["mr"] + s["r"])


def _walk_steps(n) -> int:
    """Passes after the first that no walk needs in full: a walk of k meets k numbers beyond n in a row, of which
    there are fewer than a; for large n a chance below 2**-150 is left."""
    if not isinstance(n, int):
        return MAX_WALK
    a = math.isqrt(max(n - 1, 0)) + 1
    return min(a, MAX_WALK) if a <= MAX_WALK else math.ceil(150 / math.log2(a))


def permute(x, n, seed, tweak=0, inverse: bool = False) -> Column:
    """Where ``x`` of 0..n-1 lies in the seeded order of n (``inverse``: which number lies at place ``x``).

    ``n`` is a number or a column; a ``tweak`` (a whole number from 0 below 2**31, for
    example a hash of the group) gives every group an order of its own.  A null
    ``x`` gives null; one outside 0..n-1 fails the job.
    """
    keys = round_keys(seed)
    steps = _walk_steps(n)
    x, n, tweak = _long(x), _long(n), _long(tweak)
    first = _network(x, n, keys, tweak, not inverse)
    walked = F.aggregate(F.array_repeat(first, steps + 1), first, lambda y, _: F.when(y < n, y).otherwise(
        _network(y, n, keys, tweak, not inverse)))
    settled = F.when(walked < n, walked).otherwise(F.raise_error(F.lit("the walk did not end")).cast("long"))
    bad = F.raise_error(F.lit("a number to permute lies outside 0..n-1")).cast("long")
    return F.when(x.isNull(), F.lit(None).cast("long")).when((x < 0) | (x >= n), bad).otherwise(settled)


def epoch_order(df: DataFrame, row: str, n: int, seed, epoch: int, out: str = "position") -> DataFrame:
    """W1 anew for an epoch: the place of each dense row number in the epoch's order, without an exchange."""
    return df.withColumn(out, permute(F.col(row), n, f"{seed}:{epoch}"))


def row_at(df: DataFrame, position: str, n: int, seed, epoch: int, out: str = "row_no") -> DataFrame:
    """The inverse: the dense row number at each place of an epoch's order."""
    return df.withColumn(out, permute(F.col(position), n, f"{seed}:{epoch}", inverse=True))


def permute_sql(source: str, seed) -> str:
    """One pass over ``source(x, n, tweak, ...)`` in DuckDB SQL: ``x`` is replaced (for the SQL twins)."""
    sql = (f"SELECT *, x // b AS l, x % b AS r, a AS ml, b AS mr FROM (SELECT *, (n + a - 1) // a AS b FROM ("
           f"SELECT *, greatest(CAST(ceil(sqrt(CAST(n AS DOUBLE))) AS BIGINT), 1) AS a FROM {source}))")
    for m, o in round_keys(seed):
        sql = (f"SELECT * EXCLUDE (t) REPLACE (r AS l, (l + t * (t + 1) % {PRIME}) % ml AS r, mr AS ml, ml AS mr) FROM ("
               f"SELECT *, ((r + tweak) % {PRIME} * {m} + {o}) % {PRIME} AS t FROM ({sql}))")
    return f"SELECT * EXCLUDE (a, b, l, r, ml, mr) REPLACE (l * mr + r AS x) FROM ({sql})"
