"""Answer scores on characters, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from graphloom.functions.text import bare


def answer_chars(c: Column) -> Column:
    return F.filter(F.split(bare(c), ""), lambda x: x != "")


def exact_match(gold: Column, told: Column) -> Column:
    return F.when(gold.isNull(), F.lit(None).cast("boolean")).otherwise(F.coalesce(bare(gold) == bare(told), F.lit(False)))


def token_f1(gold: Column, told: Column) -> Column:
    """F1 of the multisets of letters and digits; null without gold, 0 without an answer."""
    g, t = answer_chars(gold), answer_chars(told)
    count = lambda a, x: F.size(F.filter(a, lambda y: y == x))
    shared = F.aggregate(F.transform(F.array_intersect(g, t), lambda x: F.least(count(g, x), count(t, x))), F.lit(0), lambda a, b: a + b)
    f1 = F.lit(2.0) * shared / (F.size(g) + F.size(t))
    return F.when(gold.isNull() | (F.size(g) == 0), F.lit(None).cast("double")).when(told.isNull() | (F.size(t) == 0), F.lit(0.0)).otherwise(f1)
