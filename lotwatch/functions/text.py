"""Text expressions: matching, links, evidence ids, rendering."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lotwatch import fixed_values as fixed
from lotwatch.functions.values import drop_nan, fixed_number, iso_instant

JAVA_META = re.compile(r"([\\.\[\]{}()*+?^$|#&~\-])")
INSTANTS = (T.TimestampType, T.TimestampNTZType)
MARKDOWN_SPECIAL = r"([_*`\[])"
ESCAPED_SPECIAL = r"\\([_*`\[])"


def alternation(words: Sequence[str]) -> str:
    """One regular expression that matches any of the literal words."""
    return "|".join(JAVA_META.sub(r"\\\1", w) for w in words)


def contains_any(text: Column, words: Sequence[str], whole_word: bool = False) -> Column:
    """Case-blind: does the text contain any of the words?

    A single alternation reads each text once, however many words there are.
    By default a word also counts inside a longer one; ``whole_word`` demands a
    boundary on both sides.
    """
    if not words:
        return F.lit(False)
    pattern = alternation([w.lower() for w in words])
    if whole_word:
        pattern = rf"(?U)(?<!\w)(?:{pattern})(?!\w)"
    return F.lower(text).rlike(pattern)


def starts_with_any(text: Column, words: Sequence[str]) -> Column:
    """Does the trimmed text begin with any of the words?"""
    return F.lower(F.trim(text)).rlike("^(?:" + alternation([w.lower() for w in words]) + ")")


def contains_ci(text: Column, value: str | Column) -> Column:
    """Case-blind containment.  ``%`` and ``_`` inside the value stay wildcards."""
    if isinstance(value, str):
        return text.ilike("%" + value.replace("\\", "\\\\") + "%")
    return F.ilike(text, F.concat(F.lit("%"), F.replace(value, F.lit("\\"), F.lit("\\\\")), F.lit("%")))


def strip_links(text: Column) -> Column:
    """Markdown links become their label, bare addresses vanish."""
    return F.regexp_replace(F.regexp_replace(text, fixed.MARKDOWN_LINK, "$1"), fixed.BARE_URL, "")


def links_to_plain(text: Column) -> Column:
    """Markdown to plain text: ``label (url)``, escapes undone."""
    return F.regexp_replace(F.regexp_replace(text, fixed.ANY_MARKDOWN_LINK, "$1 ($2)"), ESCAPED_SPECIAL, "$1")


def escape_markdown(text: Column) -> Column:
    return F.regexp_replace(text, MARKDOWN_SPECIAL, r"\\$1")


def record_ids(text: Column, pattern: str = fixed.TENDER_NUMBER) -> Column:
    """All ids of the record pattern found in a text, in order of occurrence."""
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def record_url(record_id: Column, base_url: str) -> Column:
    return F.concat(F.lit(base_url), record_id)


def markdown_link(record_id: Column, base_url: str) -> Column:
    return F.concat(F.lit("["), record_id, F.lit("]("), record_url(record_id, base_url), F.lit(")"))


def link_known_ids(
    text: Column, known_ids: Column, base_url: str, pattern: str = fixed.TENDER_NUMBER
) -> Column:
    """Escape the text and turn the ids that are known into links.

    An id the pattern finds but ``known_ids`` lacks stays plain text.  The ids
    hold no character that escaping changes, so they can be looked up in the
    escaped text; the boundaries of the pattern keep longer tokens apart.
    """
    cited = F.array_intersect(record_ids(text, pattern), known_ids)
    return F.aggregate(
        cited,
        escape_markdown(text),
        lambda done, one: F.regexp_replace(
            done, F.concat(F.lit(r"\b"), one, F.lit(r"\b")), F.concat(F.lit("["), one, F.lit(f"]({base_url}"), one, F.lit(")"))
        ),
    )


def cited_ids(text: Column, known_ids: Column) -> Column:
    """The known ids that occur in the text."""
    return F.filter(F.array_distinct(known_ids), lambda one: F.contains(text, one))


def with_evidence(answer: Column, known_ids: Column, base_url: str, checked: Column | None = None) -> Column:
    """Append links to all known ids, sorted, when the text cites none of them."""
    source = answer if checked is None else checked
    links = F.array_join(
        F.transform(F.array_sort(F.array_distinct(known_ids)), lambda one: markdown_link(one, base_url)), ", "
    )
    needed = (F.size(known_ids) > 0) & (F.size(cited_ids(source, known_ids)) == 0)
    return F.when(needed, F.concat(answer, F.lit("\n\n" + fixed.EVIDENCE_LABEL), links)).otherwise(answer)


def ungrounded_measurements(answer: Column, context: Column, pattern: str = fixed.MEASUREMENT) -> Column:
    """Numbers with a unit in the answer that the context does not hold verbatim, sorted."""
    found = F.regexp_extract_all(answer, F.lit(pattern), F.lit(0))
    return F.array_sort(F.array_distinct(F.filter(found, lambda m: ~F.contains(context, m))))


def render(column: Column, kind: T.DataType, default: str = fixed.NOT_STATED) -> Column:
    """Field as text; missing values as ``default``.  Doubles keep two decimals."""
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        shown = fixed_number(drop_nan(column), 2)
    elif isinstance(kind, INSTANTS):
        shown = iso_instant(column)
    else:
        shown = column.cast("string")
    return F.coalesce(shown, F.lit(default))


def chunk_text(
    schema: T.StructType,
    lines: Sequence[str] = fixed.CHUNK_LINES,
    defaults: Mapping[str, str] = fixed.CHUNK_DEFAULTS,
    missing: str = fixed.NOT_STATED,
) -> Column:
    """One labelled text per row, filled in from ``{column}`` places in ``lines``."""
    kinds = {f.name: f.dataType for f in schema.fields}
    pieces: list[Column] = []
    for token in re.split(r"(\{\w+\})", "\n".join(lines)):
        if token.startswith("{"):
            name = token[1:-1]
            fallback = defaults.get(name, missing)
            pieces.append(render(F.col(name), kinds[name], fallback) if name in kinds else F.lit(fallback))
        elif token:
            pieces.append(F.lit(token))
    return F.concat(*pieces)


def metadata_json(schema: T.StructType) -> Column:
    """Flat JSON of the row without its missing values; instants as ISO text."""
    fields = []
    for f in schema.fields:
        column = F.col(f.name)
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            column = drop_nan(column)
        elif isinstance(f.dataType, INSTANTS):
            column = iso_instant(column)
        elif not isinstance(f.dataType, (T.StringType, T.BooleanType, T.NumericType)):
            column = column.cast("string")
        fields.append(column.alias(f.name))
    return F.to_json(F.struct(*fields), {"ignoreNullFields": "true"})


def restrictive_specification(
    text: Column, model_patterns: Sequence[str], excuses: Sequence[str] = tuple(fixed.OR_EQUIVALENT)
) -> Column:
    """Names a particular model without allowing an equivalent."""
    names_model = text.rlike("(?iu)" + "|".join(f"(?:{p})" for p in model_patterns))
    return names_model & ~contains_any(text, excuses)
