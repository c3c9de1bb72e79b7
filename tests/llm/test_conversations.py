"""Conversation repair against a search of all edits in plain Python."""

import functools
import hashlib
import itertools
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from lotwatch.llm import conversations
from lotwatch.llm.queries import QUERIES

COLUMNS = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def _damaged(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = (" " if x is None else x for x in (role, text))
        spoken = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        kind = zlib.crc32(spoken.encode()) % 20
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        out += [(conv, turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    return out


def _best(kinds):
    """Cost and least string of edits over rows (initial, fault), by all ways onward from each place."""
    grow = {"": {"s": "s", "u": "u"}, "s": {"u": "u"}, "u": {"a": "a"}, "a": {"u": "u"}}

    @functools.cache
    def best(i, said, more):
        ways = [(0, "")] if i == len(kinds) and said in ("", "a") else []
        if more:
            ways += [(2 + c, "I" + s) for r in "ua" if r in grow[said] for c, s in [best(i, r, more - 1)]]
        if i < len(kinds):
            initial, fault = kinds[i]
            ways += [(3 + c, "D" + s) for c, s in [best(i + 1, said, 3)]]
            if fault not in ("blank", "duplicate"):
                extra = fault == "truncated"
                if initial in grow[said]:
                    ways += [(extra + c, "K" + s) for c, s in [best(i + 1, initial, 3)]]
                ways += [(2 + extra + c, "R" + s) for r in "ua" if r in grow[said] for c, s in [best(i + 1, r, 3)]]
        return min(ways, default=(10**9, ""))

    for i in range(len(kinds), 0, -100):
        for said in grow:
            best(i, said, 3)
    return best(0, "", 3)


def _expected(rows):
    """Of damaged rows, one row per conversation."""
    groups = {}
    for conv, turn, role, text in rows:
        groups.setdefault(conv, []).append((turn is not None, turn or 0, role, text))
    for conv, group in groups.items():
        group.sort()
        seen, kinds, faults = set(), [], []
        for _, _, role, text in group:
            plain = text.rstrip(" \t\n\x0b\x0c\r")
            fault = "blank" if not plain else "duplicate" if (role, text) in seen else "truncated" if plain[-1] not in ".!?" else None
            seen.add((role, text))
            kinds.append((role[:1], fault))
            faults.append(fault)
        turns = {t for given, t, _, _ in group if given}
        cost, audit = _best(kinds)
        lines, said, left = [], "", iter(group)
        for letter in audit:
            if letter == "D":
                next(left)
                continue
            row = next(left) if letter in "KR" else None
            role = row[2] if letter == "K" else "assistant" if said == "u" else "user"
            lines.append(f"{role}:{row[3] if row else ''}")
            said = role[0]
        pairs = [a[0] + b[0] for a, b in itertools.pairwise(kinds)]
        yield (
            conv, max(turns) - min(turns) + 1 - len(turns) if turns else 0, *map(faults.count, ("blank", "duplicate", "truncated")),
            sum(p not in ("su", "ua", "au") for p in pairs), cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest(),
        )


def _whole(rows):
    found = {r[0]: r for r in _expected(_damaged(rows))}
    for conv in {r[0] for r in rows} - found.keys():
        found[conv] = (conv, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    return sorted(found.values(), key=str)


def _code(kind):
    return conversations.row_code(*kind)


def test_every_short_conversation():
    kinds = [(r, f) for r in ("s", "u", "a", "x") for f in (None, "truncated", "blank")]
    for n in range(4):
        for rows in itertools.product(kinds, repeat=n):
            assert conversations.cheapest(bytes(map(_code, rows))) == _best(rows)


@pytest.mark.parametrize("block", [1, 3, 64])
def test_long_conversations_in_blocks(monkeypatch, block):
    monkeypatch.setattr(conversations, "BLOCK", block)
    rnd = random.Random(block)
    for n in (5, 17, 40, 150):
        for _ in range(12):
            rows = tuple((rnd.choice("suax" if rnd.random() < 0.3 else "ua"), rnd.choice([None, None, None, "truncated", "blank", "duplicate"])) for _ in range(n))
            assert conversations.cheapest(bytes(map(_code, rows))) == _best(rows)


def test_prices_are_feasible_and_tight():
    rnd = random.Random(9)
    for _ in range(50):
        rows = [(rnd.choice("suax"), rnd.choice([None, "truncated", "blank"])) for _ in range(12)]
        codes = bytes(map(_code, rows))
        prices = conversations.auction(codes, conversations.NOTHING, dict.fromkeys(conversations.LAST, 0), True)
        for (i, last), price in prices.items():
            for _, step, said, cost in conversations.arcs(codes[i] if i < 12 else None, last):
                assert price <= cost + prices[i + step, said]
        assert prices[0, conversations.NOTHING] == _best(tuple(rows))[0]


def _rows(seed, n):
    rnd = random.Random(seed)
    texts = ["Yes.", "No!", "Why?", "and", "", " \t\r\n", "Fine. \n", " ", "x\x0b", "ok.", "long " * 50 + "end."]
    rows = [(rnd.choice([None, *range(n)]), rnd.choice([None, -5, *range(9)]), rnd.choice(["user", "assistant", "system", "tool", "", None, "user", "assistant"]), rnd.choice([None, *texts])) for _ in range(n * 5)]
    return rows + [(n, t, ["user", "assistant"][t % 2], rnd.choice(texts)) for t in range(300)] + [(n + 1, 7, "user", f"Row {k}.") for k in range(40)]


@pytest.mark.parametrize("sizes", [{}, {"held": 3, "turns": 4}])
def test_repair_by_brute_force(spark, sizes):
    """Null and repeated keys, turns, roles and texts; long conversations as pieces, and more rows than a task holds."""
    rows = _rows(1, 60)
    docs = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("piece", F.lit("clash")).withColumn("key", F.lit(1)).repartition(4)
    got = conversations.with_missing(conversations.repair(conversations.damage(docs), **sizes), docs)
    assert got.columns == COLUMNS and {t for _, t in got.dtypes[1:7]} == {"bigint"}
    assert sorted(map(tuple, got.collect()), key=str) == _whole(rows)
    none = docs.limit(0)
    assert conversations.with_missing(conversations.repair(conversations.damage(none)), none).count() == 0


def test_op13_whole_table(spark):
    folder = "/root/testdata/sf0.01"
    rows = [tuple(r) for r in spark.read.parquet(f"{folder}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = QUERIES["op13_conversations"](spark, folder)
    assert sorted(map(tuple, got.collect()), key=str) == _whole(rows)
