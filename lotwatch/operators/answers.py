"""Deterministic checks of written answers against their evidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lotwatch import fixed_values as fixed
from lotwatch.functions.text import link_known_ids, strip_links, ungrounded_measurements, with_evidence

UNGROUNDED_NOTE = "⚠️ Not found in the evidence: "
SAMPLE_NOTE = "ℹ️ Small sample, N="


def _noted(condition: Column, note: Column, text: Column) -> Column:
    return F.when(condition, F.concat(note, F.lit("\n\n"), text)).otherwise(text)


def audit_answers(
    answers: DataFrame,
    base_url: str,
    measurement: str = fixed.MEASUREMENT,
    ungrounded_note: str = UNGROUNDED_NOTE,
    sample_note: str = SAMPLE_NOTE,
    min_sample: int = fixed.MIN_FAIR_SAMPLE_SIZE,
) -> DataFrame:
    """Audit a table of ``answer_id, text, context, known_ids, sample_size``.

    Strips links the writer made up, reports numbers with a unit that the
    context lacks, links verified ids, appends the evidence when none is cited
    and notes small samples.  Everything is local to a row.
    """
    plain = strip_links(F.col("text"))
    found = ungrounded_measurements(F.col("plain"), F.coalesce("context", F.lit("")), measurement)
    known = F.coalesce("known_ids", F.array().cast("array<string>"))
    linked = link_known_ids(F.col("warned"), F.col("known"), base_url)
    return (
        answers.withColumns({"plain": plain, "known": known})
        .withColumn("ungrounded", found)
        .withColumn(
            "warned",
            _noted(
                F.size("ungrounded") > 0,
                F.concat(F.lit(ungrounded_note), F.array_join("ungrounded", ", ")),
                F.col("plain"),
            ),
        )
        .withColumn("audited", with_evidence(linked, F.col("known"), base_url, F.col("plain")))
        .withColumn("is_small_sample", F.coalesce(F.col("sample_size") < min_sample, F.lit(False)))
        .withColumn(
            "audited",
            _noted(
                F.col("is_small_sample"),
                F.concat(F.lit(sample_note), F.col("sample_size").cast("string")),
                F.col("audited"),
            ),
        )
        .select("answer_id", "ungrounded", "is_small_sample", "audited")
    )
