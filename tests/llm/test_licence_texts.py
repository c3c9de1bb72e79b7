"""Whole licences in the shapes that documents have, and prose that begins like a copyright line."""

import pkgutil
import textwrap

import pytest

from lotwatch.llm import licences


def test_full_texts_are_recognised(spark):
    rows = []
    for i, name in enumerate(licences.FILES):
        text = pkgutil.get_data("lotwatch.llm", f"licence_texts/{name}.txt").decode()
        text = text.replace("<year>, <copyright holder>", "2020-2024, A. B. Nobody and others").replace("[yyyy] [name of copyright owner]", "2021 Nobody Ltd")
        rows += [(i, text), (100 + i, text.replace("\n", "\r\n"))]
    found = {r["doc_id"]: r["licence"] for r in licences.scan(spark.createDataFrame(rows, "doc_id long, text string"), licences.known_digests(spark)).collect()}
    assert found == {i + k: name for i, name in enumerate(licences.FILES) for k in (0, 100)}


@pytest.mark.parametrize("line,gone", [
    ("Copyright (c) 2020 A", True), ("© 2021 B", True), ("Copyright (C) Some Body", True), ("(c) 2019-2020 X", True), ("Copyright 1999, The Authors", True), ("All rights reserved.", True),
    ("  * Copyright: 2004 by X", True), ("&copy; 2001 A", True), ("Copyright (c) 2020 Will May", True), ("Copyright <year> <holder>", True),
    ("C was standardised by ANSI in 1989", False), ("Copyright law in the United States changed in 1976", False), ("Copyright infringement", False), ("Copyright X", False),
    ("Copyright (c) 2020 X. You may not copy this.", False), ("Copyright 1976 was the year that law changed", False), ("All rights reserved to you", False),
    ("Copyright law protects authors.", False), ("C is a language with many compilers", False), ("(c) You must retain all copyright notices", False), ("copyright licenses of each contributor", False),
])
def test_only_copyright_lines_are_left_out(spark, line, gone):
    docs = spark.createDataFrame([(line,)], "text string")
    assert (docs.select(licences.canonical_lines(docs["text"])).first()[0] == []) == gone


def test_prose_keeps_its_own_digest(spark):
    lines = ["C was standardised by ANSI in 1989 after years.", "Copyright law in the United States changed in 1976 for good.", "Copyright infringement", ""]
    docs = spark.createDataFrame([(i, "Notes\n" + x) for i, x in enumerate(lines)], "doc_id long, text string")
    assert len({r["canonical_sha256"] for r in licences.scan(docs, licences.known_digests(spark)).collect()}) == 4
