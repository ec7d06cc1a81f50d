"""Column functions on score vectors (``array<double>``)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def as_doubles(vector: Column) -> Column:
    return F.transform(vector, lambda v: v.cast("double"))


def log_sum_exp(logits: Column) -> Column:
    top = F.array_max(logits)
    total = F.aggregate(logits, F.lit(0.0), lambda s, v: s + F.exp(v - top))
    return top + F.ln(total)


def softmax(logits: Column) -> Column:
    norm = log_sum_exp(logits)
    return F.transform(logits, lambda v: F.exp(v - norm))


def foreground_probabilities(logits: Column) -> Column:
    """Softmax with the background channel (the first) left out."""
    return F.slice(softmax(logits), F.lit(2), F.size(logits) - 1)


def argmax(scores: Column) -> Column:
    """Index of the first maximum, from 0."""
    return (F.array_position(scores, F.array_max(scores)) - 1).cast("int")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, v: s + v)


def nll(logits: Column, target: Column) -> Column:
    """Negative log likelihood of the target class."""
    return log_sum_exp(logits) - F.get(logits, target)
