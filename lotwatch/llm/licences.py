"""Licence scans by canonical digests.

A text is brought to a canonical form: copyright lines left out, lower case,
marks and white space as single spaces, equivalent spellings made one.  The
SHA-256 of the whole canonical text, and of each of its lines, is joined to
those of known licences and notices.
"""

from __future__ import annotations

import pkgutil

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lotwatch.session import stored

# Notices and full texts of well-known licences.
MIT = """MIT License
Copyright (c) <year> <copyright holders>
Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
ISC = """ISC License
Copyright (c) <year> <copyright holders>
Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.
THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
KNOWN = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC0-1.0", "This work is dedicated to the public domain under CC0 1.0."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("ISC", ISC),
    ("ISC", "Released under the ISC License."),
    ("MIT", MIT),
    ("MIT", "Released under the MIT License."),
    ("MPL-2.0", "Licensed under the Mozilla Public License, Version 2.0."),
]
# Full texts in ``licence_texts``, one file each.
FILES = [
    "Apache-2.0", "Artistic-1.0-Perl", "BSD-2-Clause", "BSD-3-Clause", "CC0-1.0", "GFDL-1.2", "GFDL-1.3", "GPL-1.0", "GPL-2.0", "GPL-3.0",
    "LGPL-2.0", "LGPL-2.1", "LGPL-3.0", "MPL-1.1", "MPL-2.0", "Unlicense",
]
END_OF_TERMS = "END OF TERMS AND CONDITIONS"


def full_texts() -> list[tuple[str, str]]:
    """Whole licences, also in the shapes that projects give them: without title, with marks for numbers, without what follows the terms."""
    texts = [(name, text.partition("\n")[2]) for name, text in (("MIT", MIT), ("ISC", ISC))]
    texts += [("MIT", "The MIT License (MIT)\n" + texts[0][1]), ("MIT", "The MIT License\n" + texts[0][1])]
    for name in FILES:
        text = pkgutil.get_data("lotwatch.llm", f"licence_texts/{name}.txt").decode()
        texts.append((name, text))
        if END_OF_TERMS in text:
            texts.append((name, text[: text.index(END_OF_TERMS) + len(END_OF_TERMS)]))
        if name.startswith("BSD"):
            marked = text.replace("1. ", "* ").replace("2. ", "* ").replace("3. ", "* ")
            title = f"BSD {name[4]}-Clause License\n"
            texts += [(name, marked), (name, title + text), (name, title + marked)]
    return texts


KNOWN += full_texts()
# Spellings that count as one, within words or between them.
SPELLINGS = [
    ("licence", "license"),
    ("sub license", "sublicense"),
    ("acknowledgement", "acknowledgment"),
    ("authorisation", "authorization"),
    ("merchantibility", "merchantability"),
    ("non infringement", "noninfringement"),
    ("non commercial", "noncommercial"),
    ("per cent", "percent"),
    ("copyright owner", "copyright holder"),
    ("judgement", "judgment"),
    ("favour", "favor"),
    ("programme", "program"),
]
MARKS = r"[^\p{L}\p{N}\n]+"
# A copyright line begins with the word and a sign or a year, or with a sign and the word or a year ...
_SIGN, _YEAR = r"(?:\(c\)|©|&copy;)", r"[\[<{]?(?:(?:1[89]|20)[0-9][0-9]|yyyy|year)"
COPYRIGHT = rf"^[^\p{{L}}\p{{N}}(©&]*(?:copyright[ \t]*[:,]?[ \t]*(?:{_SIGN}|(?:by[ \t]+)?{_YEAR})|{_SIGN}[ \t]*(?:copyright|{_YEAR}))"
# ... and makes no statement.
VERBS = ["is", "are", "was", "were", "be", "been", "has", "have", "had", "must", "shall", "should", "may", "might", "can", "could", "will", "would", "do", "does", "did", "applies", "apply", "protects", "protect", "means", "you", "we", "this"]
VERB = rf"(?:^|[^\p{{L}}\p{{N}}])(?:{'|'.join(VERBS)})(?:[^\p{{L}}\p{{N}}]|$)"
RESERVED = r"^[^\p{L}\p{N}]*all rights reserved[^\p{L}\p{N}]*$"


def is_copyright_line(line: Column) -> Column:
    """Whether a line names holders of a copyright and says no more; judged with its marks and capitals."""
    low = F.lower(line)
    return F.rlike(low, F.lit(COPYRIGHT)) & ~F.rlike(line, F.lit(VERB)) | F.rlike(low, F.lit(RESERVED))


def canonical_lines(text: Column) -> Column:
    """Canonical lines of a text that are neither blank nor copyright lines; null has none."""
    lines = F.filter(F.split(F.coalesce(text, F.lit("")), "\n"), lambda line: ~is_copyright_line(line))
    body = F.replace(F.lower(F.array_join(lines, "\n")), F.lit("©"), F.lit(" copyright "))
    body = F.regexp_replace(body, MARKS, " ")
    for given, one in SPELLINGS:
        body = F.replace(body, F.lit(given), F.lit(one))
    return F.filter(F.transform(F.split(body, "\n"), lambda line: F.trim(line)), lambda line: line != "")


def known_digests(spark: SparkSession, known: list[tuple[str, str]] | None = None) -> DataFrame:
    """``licence``, ``digest`` of known texts; the list is the caller's and small.  A text with nothing left is not known."""
    rows = spark.createDataFrame(known if known is not None else KNOWN, "licence string, text string")
    canonical = rows.select("licence", F.array_join(canonical_lines(F.col("text")), " ").alias("canonical")).filter("canonical <> ''")
    return canonical.select("licence", F.sha2("canonical", 256).alias("digest")).groupBy("digest").agg(F.min("licence").alias("licence"))


def scan(docs: DataFrame, known: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: ``key``, ``canonical_sha256``, ``licence``, ``notices``, ``notice_lines``.

    ``licence`` is that of the whole text (null, if unknown); ``notices`` are
    the different licences its lines name, sorted and comma-separated (empty
    text, if none), and ``notice_lines`` the number of those lines.  Null and
    empty texts have the digest of the empty text and no licence.  Rows that
    repeat key and canonical lines get the same values.
    """
    read = docs.select(F.col(f"`{key}`").alias("__key"), canonical_lines(F.col(f"`{text}`")).alias("lines"))
    units = stored(
        read.select("__key", F.sha2(F.array_join("lines", " "), 256).alias("whole"), F.transform("lines", lambda x: F.unhex(F.sha2(x, 256))).alias("lines")),
        "canonical",
    )
    # A join by the digest of a whole text, and one by those of the lines; of equal documents one is looked up.
    known = known.select(F.col("digest").alias("known"), "licence")
    named = units.join(known, F.col("whole") == F.col("known"), "left").select("__key", "whole", "licence", F.xxhash64("lines").alias("same"))
    digests = known.select(F.unhex("known").alias("line"), F.col("licence").alias("notice"))
    # Numbered before they are exploded, so that repeated documents are not counted together.
    numbered = units.select("__key", "whole", "lines", F.xxhash64("lines").alias("same"), F.monotonically_increasing_id().alias("row"))
    lines = numbered.select("__key", "whole", "same", "row", F.explode("lines").alias("line"))
    hits = (
        lines.join(digests, "line")
        .groupBy("__key", "whole", "same", "row")
        .agg(F.array_join(F.array_sort(F.collect_set("notice")), ",").alias("notices"), F.count(F.lit(1)).alias("notice_lines"))
        .groupBy("__key", "whole", "same")
        .agg(F.first("notices").alias("notices"), F.first("notice_lines").alias("notice_lines"))
        .select(F.struct("__key", "whole", "same").alias("of"), "notices", "notice_lines")
    )
    return named.join(hits, F.struct("__key", "whole", "same") == F.col("of"), "left").select(
        F.col("__key").alias(key),
        F.col("whole").alias("canonical_sha256"),
        "licence",
        F.coalesce("notices", F.lit("")).alias("notices"),
        F.coalesce("notice_lines", F.lit(0).cast("long")).alias("notice_lines"),
    )
