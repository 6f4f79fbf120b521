"""Array-valued column functions (Q5-Q7, Q10, Q13, Q14 and the per-row parts
of A5-A7).  Higher-order functions keep the work inside the row: no explode,
no re-collect, no shuffle."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def int_array(values: Sequence[int]) -> Column:
    """A literal ``array<int>`` (empty allowed)."""
    if not values:
        return F.array().cast("array<int>")
    return F.array(*[F.lit(int(v)) for v in values]).cast("array<int>")


def drop_last_id(c) -> Column:
    """Q7: all but the final id (an empty array stays empty)."""
    a = _c(c)
    return F.slice(a, 1, F.greatest(F.size(a) - 1, F.lit(0)))


def seq2seq_input(prefix_ids: Sequence[int], ids) -> Column:
    """Q5: prefix ids (kept as given, end token included) followed by the source ids."""
    return F.concat(int_array(prefix_ids), _c(ids))


def nli_input(hypothesis, premise, p1: Sequence[int], p2: Sequence[int], max_len: int) -> Column:
    """Q6: ``p1 ++ h[:-1][:min(L-1, |h|-1)] ++ p2 ++ p[:L]`` with L = max_len // 2."""
    half = max_len // 2
    h, p = _c(hypothesis), _c(premise)
    h_len = F.greatest(F.least(F.lit(half - 1), F.size(h) - 1), F.lit(0))
    return F.concat(int_array(p1), F.slice(h, 1, h_len), int_array(p2),
                    F.slice(p, 1, F.least(F.lit(half), F.size(p))))


def shift_right(c, start: int = 0) -> Column:
    """Q10: decoder input -- start id in front, last id dropped (same width)."""
    a = _c(c)
    return F.when(F.size(a) == 0, a).otherwise(
        F.concat(int_array([start]), F.slice(a, 1, F.size(a) - 1)))


def argmax(c) -> Column:
    """Q13: 0-based position of the first maximum (null for an empty array)."""
    a = _c(c)
    return (F.array_position(a, F.array_max(a)) - 1).cast("int")


def clip_width(pred, target) -> Column:
    """Q14: cut predictions to the target's width."""
    return F.slice(_c(pred), 1, F.size(_c(target)))


def truncate(c, max_len: int) -> Column:
    return F.slice(_c(c), 1, max_len)


def pad_to(c, width, pad: int = 0) -> Column:
    """Right-pad (already truncated) ids to ``width`` with ``pad``."""
    a = _c(c)
    w = width if isinstance(width, Column) else F.lit(width)
    return F.concat(a, F.array_repeat(F.lit(pad), F.greatest(w - F.size(a), F.lit(0))).cast("array<int>"))


def mask_of(c, width) -> Column:
    a = _c(c)
    w = width if isinstance(width, Column) else F.lit(width)
    return F.concat(F.array_repeat(F.lit(1), F.size(a)),
                    F.array_repeat(F.lit(0), F.greatest(w - F.size(a), F.lit(0)))).cast("array<int>")


def pad_width(max_len_in_batch, max_len: int) -> Column:
    """Q8 arithmetic: m > 8 ? ceil(min(max_len, m) / 8) * 8 : m."""
    m = _c(max_len_in_batch)
    return F.when(m > 8, (F.ceil(F.least(F.lit(max_len), m) / 8.0) * 8).cast("int")).otherwise(m.cast("int"))


def logsumexp(c) -> Column:
    """log(sum(exp(x))) with the maximum factored out (doubles)."""
    a = F.transform(_c(c), lambda x: x.cast("double"))
    m = F.array_max(a)
    s = F.aggregate(a, F.lit(0.0).cast("double"), lambda acc, x: acc + F.exp(x - m))
    return F.log(s) + m


def cross_entropy(logits, target) -> Column:
    """A6 per row: logsumexp(l) - l[target]."""
    return logsumexp(logits) - F.get(_c(logits), _c(target)).cast("double")


def dot(a, b) -> Column:
    """Sum of element products, in array order, as double."""
    return F.aggregate(F.zip_with(_c(a), _c(b), lambda x, y: x.cast("double") * y.cast("double")),
                       F.lit(0.0).cast("double"), lambda acc, v: acc + v)
