"""Array-valued expressions: probabilities, entropies, padding, encodings."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, functions as F


def total(arr) -> Column:
    """Sum of all entries, first to last."""
    return F.aggregate(arr, F.lit(0.0), lambda acc, x: acc + x.cast("double"))


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def to_number(col) -> Column:
    """Number in a text; anything else becomes null."""
    return _c(col).try_cast("double")


def array_sum(arr) -> Column:
    return F.aggregate(_c(arr), F.lit(0.0), lambda acc, x: acc + x)


def softmax(arr) -> Column:
    top = F.array_max(_c(arr))
    exps = F.transform(_c(arr), lambda x: F.exp(x - top))
    return F.transform(exps, lambda e: e / array_sum(exps))


def argmax(arr) -> Column:
    """Index from 0 of the largest entry; the first one on ties."""
    return (F.array_position(_c(arr), F.array_max(_c(arr))) - 1).cast("int")


def log_sum_exp(arr) -> Column:
    top = F.array_max(_c(arr))
    return top + F.log(array_sum(F.transform(_c(arr), lambda x: F.exp(x - top))))


def two_class(logit) -> Column:
    """A single logit as the probabilities of both classes."""
    p = 1 / (1 + F.exp(-_c(logit)))
    return F.array(1 - p, p)


def normalized(arr) -> Column:
    return F.transform(_c(arr), lambda x: x / array_sum(arr))


def entropy(arr) -> Column:
    p = normalized(arr)
    return -array_sum(F.transform(p, lambda x: F.when(x > 0, x * F.log(x)).otherwise(0.0)))


def kl(p, q) -> Column:
    """Relative entropy of two weight arrays, each normalised first."""
    return array_sum(
        F.zip_with(normalized(p), normalized(q), lambda a, b: F.when(a > 0, a * F.log(a / b)).otherwise(0.0))
    )


def pad_right(arr, length, value) -> Column:
    arr = _c(arr)
    length = F.lit(length) if isinstance(length, int) else length
    return F.concat(arr, F.array_repeat(F.lit(value), F.greatest(length - F.size(arr), F.lit(0)).cast("int")))


def pad_left(arr, length, value) -> Column:
    arr = _c(arr)
    length = F.lit(length) if isinstance(length, int) else length
    return F.concat(F.array_repeat(F.lit(value), F.greatest(length - F.size(arr), F.lit(0)).cast("int")), arr)


def mono(arr) -> Column:
    """Mean over channels of an array of equally long channels."""
    arr = _c(arr)
    zero = F.transform(arr[0], lambda x: x * 0.0)
    total = F.aggregate(arr, zero, lambda acc, ch: F.zip_with(acc, ch, lambda a, b: a + b))
    return F.transform(total, lambda x: x / F.size(arr))


def multi_hot(col, classes: Sequence) -> Column:
    """One 0/1 entry per class, for a label array or a single label."""
    c = _c(col)
    return F.array(*[F.coalesce(F.array_contains(c, F.lit(k)), F.lit(False)).cast("int") for k in classes])


def one_hot(col, classes: Sequence) -> Column:
    return multi_hot(F.array(_c(col)), classes)


def scale_array(arr, low: float = 0.0, high: float = 1.0, eps: float = 1e-6) -> Column:
    """Min-max scaling of a whole signal held in one array."""
    arr = _c(arr)
    lo, hi = F.array_min(arr), F.array_max(arr)
    return F.transform(arr, lambda x: low + (high - low) * (x - lo) / (hi - lo + eps))


def parse_probs(col) -> Column:
    """Text like ``{'0': 0.2, '1': 0.8}`` as a map from class to probability."""
    return F.from_json(_c(col), "map<string,double>", {"allowSingleQuotes": "true"})
