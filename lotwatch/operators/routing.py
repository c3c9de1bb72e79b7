"""Which path should a question take?  One label column over a table of questions."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lotwatch import fixed_values as fixed
from lotwatch.functions.text import contains_any, starts_with_any


def is_followup(text: Column, markers: Sequence[str] = tuple(fixed.FOLLOWUP_MARKERS), whole_word: bool = False) -> Column:
    """Does the question lean on an earlier answer?"""
    return contains_any(F.trim(text), markers, whole_word)


def investigation_kind(text: Column, triggers: Mapping[str, Sequence[str]] = fixed.INVESTIGATION_TRIGGERS) -> Column:
    """First kind, in the order of the mapping, one of whose triggers occurs; else null."""
    kinds = list(triggers.items())
    label = F.when(contains_any(text, kinds[0][1]), F.lit(kinds[0][0]))
    for kind, words in kinds[1:]:
        label = label.when(contains_any(text, words), F.lit(kind))
    return label


def question_path(
    text: Column,
    leading: Sequence[str] = tuple(fixed.QUALITATIVE_LEADING_WORDS),
    qualitative: Sequence[str] = tuple(fixed.QUALITATIVE_WORDS),
    quantitative: Sequence[str] = tuple(fixed.QUANTITATIVE_WORDS),
) -> Column:
    """``sql`` for questions that count or compare, ``vector`` for all others."""
    describes = starts_with_any(text, leading) | contains_any(text, qualitative)
    return F.when(~describes & contains_any(F.trim(text), quantitative), F.lit("sql")).otherwise(F.lit("vector"))


def route(
    text: Column,
    followup: Column | None = None,
    kind: Column | None = None,
    path: Column | None = None,
) -> Column:
    """Follow-up first, then investigations, then ``sql`` or ``vector``."""
    followup = is_followup(text) if followup is None else followup
    kind = investigation_kind(text) if kind is None else kind
    path = question_path(text) if path is None else path
    return (
        F.when(followup, F.lit("followup"))
        .when(kind.isNotNull(), F.concat(F.lit("investigation:"), kind))
        .otherwise(path)
    )


def routing_report(questions: DataFrame, route_column: str = "route") -> DataFrame:
    return questions.groupBy(route_column).agg(F.count(F.lit(1)).alias("n_questions"))
