"""Checks of a claimed relation against its source, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from graphloom.functions.text import norm_name

#: Signs of negation, sought shortly before the relation's cue.
NEGATIONS = ["没有", "并未", "并非", "不是", "从未", "不曾", "never", "not "]
#: Qualifiers that change what a relation means.
QUALIFIERS = ["预科", "短期交流", "访问学者", "进修", "荣誉学位", "交换生"]
NEGATION_WINDOW = 8
_NEGATION = "|".join(NEGATIONS)


def span_ok(text: Column, start: Column, end: Column, quote: Column) -> Column:
    """The span lies in the text, is not empty, and holds the quote (offsets in code points from 0)."""
    held = F.substring(text, start + 1, end - start)
    return F.coalesce((start >= 0) & (end <= F.length(text)) & (start < end) & (held == quote), F.lit(False))


def relation_matches(relation: Column, variants: Column) -> Column:
    """Some variant that is not blank equals, holds, or lies in the relation, normalised."""
    r = norm_name(relation)
    return F.coalesce(F.exists(F.filter(F.transform(variants, norm_name), lambda v: v != ""), lambda v: F.contains(r, v) | F.contains(v, r)), F.lit(False))


def cue_in_text(text: Column, variants: Column) -> Column:
    return F.coalesce(F.exists(variants, lambda v: (v != "") & F.contains(text, v)), F.lit(False))


def negation_before_cue(text: Column, variants: Column) -> Column:
    """A sign of negation within the characters before some variant's first occurrence."""

    def negated(v: Column) -> Column:
        at = F.position(v, text)
        begin = F.greatest(F.lit(1), at - NEGATION_WINDOW)
        return (v != "") & (at > 0) & F.substring(text, begin, at - begin).rlike(_NEGATION)

    return F.coalesce(F.exists(variants, negated), F.lit(False))


def qualifier_conflict(text: Column, predicate: Column) -> Column:
    told = F.coalesce(predicate, F.lit(""))
    return F.coalesce(F.exists(F.split(F.lit("|".join(QUALIFIERS)), r"\|"), lambda q: F.contains(text, q) & ~F.contains(told, q)), F.lit(False))


def names_match(surface: Column, names: Column) -> Column:
    return F.coalesce(F.array_contains(F.transform(names, norm_name), norm_name(surface)), F.lit(False))


def _verdict(decision: str, reason: str) -> Column:
    return F.struct(F.lit(decision).alias("decision"), F.lit(reason).alias("reason"))


def text_verdict(span: Column, direction: Column, quote: Column, predicate: Column, variants: Column, verify: Column) -> Column:
    """The decision on a candidate read from text, the first reason that applies."""
    return (
        F.when(~span, _verdict("INVALID_SPAN", "INVALID_SPAN"))
        .when(~direction, _verdict("UNKNOWN", "DIRECTION_MISMATCH"))
        .when(~cue_in_text(quote, variants), _verdict("UNKNOWN", "COOCCURRENCE"))
        .when(verify & negation_before_cue(quote, variants), _verdict("CONFLICT", "NEGATION"))
        .when(verify & qualifier_conflict(quote, predicate), _verdict("UNKNOWN", "QUALIFIER_MISMATCH"))
        .when(verify, _verdict("SUPPORTED", "TEXT_SUPPORTED"))
        .otherwise(_verdict("SUPPORTED", "TEXT_PROGRAMMATIC_ACCEPT"))
    )


def graph_verdict(direction: Column, relation: Column, variants: Column, quotes: Column, located: Column, forced: Column, verify: Column) -> Column:
    """The decision on an edge, with its source quotes in one text."""
    fits = relation_matches(relation, variants)
    return (
        F.when(~direction, _verdict("UNKNOWN", "DIRECTION_MISMATCH"))
        .when(~verify & (fits | forced), _verdict("SUPPORTED", "GRAPH_UNVERIFIED_ACCEPT"))
        .when(~verify, _verdict("UNKNOWN", "RELATION_MISMATCH"))
        .when(~located, _verdict("UNKNOWN", "SOURCE_UNLOCATABLE"))
        .when(fits & cue_in_text(quotes, variants) & ~negation_before_cue(quotes, variants), _verdict("SUPPORTED", "GRAPH_SOURCE_OK"))
        .otherwise(_verdict("CONFLICT", "GRAPH_SOURCE_REJECT"))
    )
