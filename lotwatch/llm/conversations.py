"""Cheapest repair of damaged conversations, by an auction for shortest paths.

A conversation's rows and what has been said so far span a lattice: its layers
are the places between rows, its four nodes a layer say that nothing, the
system, the user or the assistant spoke last.  Keeping, changing the role of,
or deleting a row leads to the next layer, inserting a row stays in the layer;
a legal conversation is a path to the last layer after nothing or the
assistant.

The auction keeps a price at each node, at most what any arc costs plus the
price of its end, and one path.  The path's last node bids the least of these
sums: if its price is below, it takes that price and the path contracts, else
the path extends along the cheapest arc.  Once the path arrives, the price at
the start is the least cost, and every arc of every cheapest path is tight:
its cost is the difference of its nodes' prices.  The audit follows the first
letter of the alphabet among tight arcs that lead on to the end.

Long conversations are solved in blocks: auctions give the costs between the
ends of a block, their least sums give the prices where blocks meet.  Of a
conversation's rows a task holds a byte each, and the texts of ``HELD`` at most;
where there are more, the edits are found from the bytes and the texts come
again, as a stream, to be hashed.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from lotwatch.session import stored

# Edits and their costs; a truncated row that stays costs one more.
KEEP, REROLE, DELETE, INSERT = "K", "R", "D", "I"
COST = {KEEP: 0, REROLE: 2, DELETE: 3, INSERT: 2}
TRUNCATED_COST = 1
# Who spoke last, and who may speak then: the role's initial and what it leads to.
NOTHING, SYSTEM, USER, ASSISTANT = range(4)
NEXT = {NOTHING: {"s": SYSTEM, "u": USER}, SYSTEM: {"u": USER}, USER: {"a": ASSISTANT}, ASSISTANT: {"u": USER}}
ROLES = {"u": "user", "a": "assistant"}
LAST = (NOTHING, ASSISTANT)
# A row's byte: its initial, or another one, times four, plus its fault.
INITIALS = "sua"
FINE, TRUNCATED, MUST_GO = range(3)
# Rows of a block; rows whose texts a task holds at once; turns of a piece of a conversation.
BLOCK, HELD, TURNS = 64, 1_000, 1_000
NEVER = 1 << 60

BLANK, DUPLICATE, CUT_OFF = "blank", "duplicate", "truncated"


def row_code(initial: str, fault: str | None) -> int:
    state = MUST_GO if fault in (BLANK, DUPLICATE) else TRUNCATED if fault == CUT_OFF else FINE
    return 4 * (INITIALS.index(initial) if initial and initial in INITIALS else 3) + state


def arcs(code: int | None, last: int) -> list[tuple[str, int, int, int]]:
    """Edits possible before a row (None: at the end) after ``last``: letter, layers onward, who spoke last, cost."""
    said = NEXT[last]
    found = [(INSERT, 0, said[r], COST[INSERT]) for r in ROLES if r in said]
    if code is None:
        return found
    who, state = divmod(code, 4)
    found.append((DELETE, 1, last, COST[DELETE]))
    if state != MUST_GO:
        more = TRUNCATED_COST * (state == TRUNCATED)
        initial = INITIALS[who] if who < 3 else ""
        if initial in said:
            found.append((KEEP, 1, said[initial], COST[KEEP] + more))
        found += [(REROLE, 1, said[r], COST[REROLE] + more) for r in ROLES if r in said and r != initial]
    return found


def auction(codes: bytes, start: int, goal: dict[int, int], final: bool) -> dict[tuple[int, int], int] | None:
    """Prices of the lattice of ``codes`` after a path from ``start`` to the goal has been found; None if there is none.

    ``goal`` has the price of each node of the last layer that the path may
    end at.  Rows may be inserted in the last layer only if it is ``final``.
    """
    n = len(codes)
    # What remains costs at least what each row does by itself: prices that no arc undercuts.
    rest = [min(goal.values())] * (n + 1)
    for i in range(n - 1, -1, -1):
        rest[i] = rest[i + 1] + (0, TRUNCATED_COST, COST[DELETE])[codes[i] % 4]
    prices: dict[tuple[int, int], int] = {}
    price = lambda node: prices.get(node, rest[node[0]] if node is not END else 0)
    path = [(0, start)]
    while path[-1] is not END:
        node = i, last = path[-1]
        least, best = NEVER, None
        for _, step, said, cost in arcs(codes[i] if i < n else None, last) if i < n or final else ():
            bid = cost + price((i + step, said))
            if bid < least:
                least, best = bid, (i + step, said)
        if i == n and goal.get(last, NEVER) < least:
            least, best = goal[last], END
        if best is None and len(path) == 1:
            return None
        if price(node) < least:
            prices[node] = least
            if len(path) > 1:
                path.pop()
            elif least >= NEVER:
                return None
        else:
            path.append(best)
    return {node: price(node) for node in ((i, s) for i in range(n + 1) for s in NEXT)}


END = (-1, -1)


def trace(codes: bytes, start: int, goal: dict[int, int], final: bool) -> tuple[str, int] | None:
    """The least audit of the cheapest paths, and where it ends; None if there is none."""
    prices = auction(codes, start, goal, final)
    if prices is None:
        return None
    n = len(codes)

    def tight(i: int, last: int) -> list[tuple[str, int, int]]:
        if i == n and not final:
            return []
        return [(letter, i + step, said) for letter, step, said, cost in arcs(codes[i] if i < n else None, last) if prices[i, last] == cost + prices[i + step, said]]

    # Nodes from which tight arcs lead to the goal; within a layer insertions lead on at most twice before they repeat.
    good = {(n, s) for s, price in goal.items() if prices[n, s] == price}
    for i in range(n, -1, -1):
        for _ in NEXT:
            good |= {(i, s) for s in NEXT if any((j, said) in good for _, j, said in tight(i, s))}
    letters, node = [], (0, start)
    ends = {(n, s) for s, price in goal.items() if prices[n, s] == price}
    while node not in ends:
        letter, *node = min(x for x in tight(*node) if x[1:] in good)
        node = tuple(node)
        letters.append(letter)
    return "".join(letters), node[1]


def _least(codes: bytes, start: int, goal: dict[int, int], final: bool) -> int:
    prices = auction(codes, start, goal, final)
    return NEVER if prices is None else prices[0, start]


def _reaches(codes: bytes, start: int, end: int) -> bool:
    """Whether rows can lead from ``start`` to ``end``; prices would rise without bound where not."""
    if end == NOTHING:
        return start == NOTHING
    if end == SYSTEM:
        return start == SYSTEM or start == NOTHING and any(c // 4 == 0 and c % 4 != MUST_GO for c in codes)
    return True


@functools.lru_cache(maxsize=50_000)
def _between(codes: bytes) -> list[list[int]]:
    """Least costs from each node before a block to each node after it, inserting before rows only."""
    return [[_least(codes, start, {end: 0}, False) if _reaches(codes, start, end) else NEVER for end in NEXT] for start in NEXT]


@functools.lru_cache(maxsize=50_000)
def _block(codes: bytes, start: int, goal: tuple[tuple[int, int], ...], final: bool) -> tuple[str, int] | None:
    return trace(codes, start, dict(goal), final)


def cheapest(codes: bytes) -> tuple[int, str]:
    """Cost and least audit of the cheapest legal repair of rows given by their bytes."""
    *others, final = [codes[a : a + BLOCK] for a in range(0, len(codes), BLOCK)] or [b""]
    # Prices where blocks meet, from the end.
    goals = [tuple((s, 0) for s in LAST)]
    ahead = {s: _least(final, s, dict(goals[0]), True) for s in (NEXT if others else [NOTHING])}
    for block in reversed(others):
        goals.append(tuple((s, p) for s, p in ahead.items() if p < NEVER))
        between = _between(block)
        ahead = {s: min(between[s][e] + p for e, p in goals[-1]) for s in NEXT}
    node, audit = NOTHING, []
    for block, goal in zip([*others, final], reversed(goals), strict=True):
        letters, node = _block(block, node, goal, len(goals) == len(audit) + 1)
        audit.append(letters)
    return ahead[NOTHING], "".join(audit)


@functools.lru_cache(maxsize=50_000)
def _cheapest(codes: bytes) -> tuple[int, str]:
    return cheapest(codes)


def solve(codes: bytes) -> tuple[int, str]:
    """``cheapest``; answers for few rows are remembered."""
    return _cheapest(codes) if len(codes) <= 4 * BLOCK else cheapest(codes)


class Repairer:
    """Turns rows, one after the other, into repaired lines by an audit."""

    def __init__(self, audit: str):
        self.letters, self.last = iter(audit), NOTHING

    def _say(self, initial: str) -> None:
        self.last = NEXT[self.last][initial]

    def _inserted(self) -> str:
        initial = next(r for r in ROLES if r in NEXT[self.last])
        self._say(initial)
        return ROLES[initial] + ":"

    def row(self, role: str, text: str) -> Iterator[str]:
        """Lines up to and with this row."""
        for letter in self.letters:
            if letter == INSERT:
                yield self._inserted()
                continue
            if letter == KEEP:
                self._say(role[0])
                yield f"{role}:{text}"
            elif letter == REROLE:
                initial = next(r for r in ROLES if r in NEXT[self.last])
                self._say(initial)
                yield f"{ROLES[initial]}:{text}"
            return

    def end(self) -> Iterator[str]:
        for _ in self.letters:
            yield self._inserted()


# What words are made without.
WHITE = " \t\n\x0b\x0c\r"


def fault_of(role: Column, text: Column, seen: Column) -> Column:
    """The first fault of a row, or null; ``seen`` says that an earlier row of the conversation has its role and text."""
    trimmed = F.rtrim(text, F.lit(WHITE))
    ends = F.substring(trimmed, -1, 1).isin(".", "!", "?")
    return F.when(trimmed == "", BLANK).when(seen, DUPLICATE).when(~ends, CUT_OFF)


def _named(rows: DataFrame, key: str, turn: str, role: str, text: str) -> DataFrame:
    named = {"key": F.col(f"`{key}`"), "turn": F.col(f"`{turn}`"), "role": F.coalesce(F.col(f"`{role}`"), F.lit(" ")), "text": F.coalesce(F.col(f"`{text}`"), F.lit(" "))}
    return rows.select(*(c.alias(n) for n, c in named.items()))


def damage(rows: DataFrame, key: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """``key``, ``turn``, ``role``, ``text`` of conversations with one row in four damaged, chosen by key and turn.

    Of a null, one space is read.
    """
    named = _named(rows, key, turn, role, text)
    spoken = F.concat(F.coalesce(F.col("key").cast("string"), F.lit(" ")), F.lit(":"), F.coalesce(F.col("turn").cast("string"), F.lit(" ")))
    kind = named.withColumn("kind", F.crc32(spoken.cast("binary")) % 20).filter("kind <> 0")
    changed = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    made = kind.select(
        "key", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"), changed.alias("text"),
        F.explode(F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))),
    )
    return made.select(F.col("key").alias(key), F.col("turn").alias(turn), F.col("role").alias(role), F.col("text").alias(text))


# A conversation's rows follow their turns, null ones first; of one turn, roles and texts in order.
_ORDER = ["turn", "role", "text"]
_PIECE = {
    "rows": (T.LongType(), pa.int64()),
    "turns": (T.LongType(), pa.int64()),
    "low": (T.LongType(), pa.int64()),
    "high": (T.LongType(), pa.int64()),
    "blank": (T.LongType(), pa.int64()),
    "duplicate": (T.LongType(), pa.int64()),
    "truncated": (T.LongType(), pa.int64()),
    "illegal": (T.LongType(), pa.int64()),
    "first": (T.StringType(), pa.string()),
    "last": (T.StringType(), pa.string()),
    "codes": (T.BinaryType(), pa.binary()),
    "cost": (T.LongType(), pa.int64()),
    "audit": (T.StringType(), pa.string()),
    "repaired_sha256": (T.StringType(), pa.string()),
}
LEGAL = {"su", "ua", "au"}


class _Piece:
    """What is known of a piece of a conversation after its rows, which come in order."""

    def __init__(self, held: int):
        self.held, self.texts = held, []
        self.codes, self.turn, self.turns, self.low, self.high = bytearray(), None, 0, None, None
        self.counts = {BLANK: 0, DUPLICATE: 0, CUT_OFF: 0}
        self.illegal, self.first, self.last = 0, None, None

    def add(self, turn: int | None, role: str, text: str, fault: str | None) -> None:
        initial = role[:1]
        if turn is not None and turn != self.turn:
            self.turns += 1
            self.low = turn if self.low is None else self.low
            self.turn = self.high = turn
        if fault:
            self.counts[fault] += 1
        if self.last is None:
            self.first = initial
        elif self.last + initial not in LEGAL:
            self.illegal += 1
        self.last = initial
        self.codes.append(row_code(initial, fault))
        if len(self.codes) <= self.held:
            self.texts.append((role, text))
        else:
            self.texts = []

    def result(self) -> tuple:
        """The piece's values; cost, audit and digest are right where it is a whole conversation, and null where it is too large to say."""
        codes = bytes(self.codes)
        solved = (None, None, None)
        if len(codes) <= self.held:
            cost, audit = solve(codes)
            solved = (cost, audit, repaired_digest(audit, self.texts))
        return (len(codes), self.turns, self.low, self.high, *self.counts.values(), self.illegal, self.first, self.last, codes, *solved)


def repaired_digest(audit: str, rows: list[tuple[str, str]]) -> str:
    repairer = Repairer(audit)
    lines = [line for role, text in rows for line in repairer.row(role, text)]
    return hashlib.sha256("\n".join([*lines, *repairer.end()]).encode()).hexdigest()


def _runs(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[tuple[tuple, tuple]]:
    """Rows as the first ``width`` values and the others."""
    for batch in batches:
        for values in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            yield values[:width], values[width:]


def _pieces(rows: DataFrame, held: int) -> DataFrame:
    """One row per ``key`` and ``piece``."""
    kinds = {"key": rows.schema["key"].dataType, "piece": T.LongType(), **{n: k for n, (k, _) in _PIECE.items()}}
    schema = T.StructType([T.StructField(n, k) for n, k in kinds.items()])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key_kind = None
        names, made, now, piece = [], [], None, None

        def batch() -> pa.RecordBatch:
            columns = [pa.array([n[0] for n in names], key_kind), pa.array([n[1] for n in names], pa.int64())]
            columns += [pa.array([m[i] for m in made], kind) for i, (_, kind) in enumerate(_PIECE.values())]
            names.clear()
            made.clear()
            return pa.RecordBatch.from_arrays(columns, names=list(kinds))

        for part in batches:
            key_kind = part.column(0).type
            for name, row in _runs(iter([part]), 2):
                if piece is None or name != now:
                    if piece is not None:
                        names.append(now)
                        made.append(piece.result())
                    now, piece = name, _Piece(held)
                piece.add(*row)
            if len(names) > 1000:
                yield batch()
        if piece is not None:
            names.append(now)
            made.append(piece.result())
            yield batch()

    return rows.select("key", "piece", "turn", "role", "text", "fault").mapInArrow(run, schema)


def _joined(pieces: DataFrame) -> DataFrame:
    """One row per conversation of several pieces: its bytes joined and solved, its counts added up."""
    fields = ["rows", "turns", "low", "high", "blank", "duplicate", "truncated", "illegal"]
    gathered = pieces.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("piece", *fields, "first", "last", "codes"))).alias("all"))

    @F.udf("cost long, audit string")
    def solved(parts):
        return solve(b"".join(parts))

    at = lambda field: F.transform("all", lambda x: x[field])
    total = lambda field: F.aggregate(at(field), F.lit(0).cast("long"), lambda a, x: a + x)
    meets = F.zip_with(F.slice(at("last"), 1, F.size("all") - 1), F.slice(at("first"), 2, F.size("all")), lambda a, b: F.concat(a, b))
    between = F.size(F.filter(meets, lambda x: ~x.isin(*sorted(LEGAL)))).cast("long")
    sums = [total(f).alias(f) for f in ("rows", "turns", "blank", "duplicate", "truncated")]
    found = gathered.select("key", *sums, F.array_min(at("low")).alias("low"), F.array_max(at("high")).alias("high"), (total("illegal") + between).alias("illegal"), solved(at("codes")).alias("s"))
    return found.select("key", *fields, F.col("s.cost").alias("cost"), F.col("s.audit").alias("audit"))


def _digests(rows: DataFrame, audits: DataFrame) -> DataFrame:
    """``key``, ``repaired_sha256`` of conversations whose texts are hashed as a stream."""
    schema = T.StructType([T.StructField("key", rows.schema["key"].dataType), T.StructField("repaired_sha256", T.StringType())])
    # The audit comes once, before the rows.
    first = audits.select("key", F.lit(0).alias("kind"), F.lit(None).cast("long").alias("piece"), F.lit(None).cast("long").alias("turn"), F.lit(None).cast("string").alias("role"), F.col("audit").alias("text"))
    theirs = rows.join(audits.select(F.col("key").alias("other")), F.col("key").eqNullSafe(F.col("other")), "left_semi")
    stream = first.unionByName(theirs.select("key", F.lit(1).alias("kind"), "piece", "turn", "role", "text"))
    stream = stream.repartition("key").sortWithinPartitions("key", "kind", "piece", *_ORDER).select("key", "kind", "role", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, kind_of, repairer, digest, lines = None, None, None, None, 0

        def put(made: Iterator[str]) -> None:
            nonlocal lines
            for line in made:
                digest.update((("\n" if lines else "") + line).encode())
                lines += 1

        def done() -> pa.RecordBatch:
            put(repairer.end())
            return pa.RecordBatch.from_arrays([pa.array([key], kind_of), pa.array([digest.hexdigest()])], names=["key", "repaired_sha256"])

        for part in batches:
            kind_of = part.column(0).type
            for (name, kind), (role, text) in _runs(iter([part]), 2):
                if kind == 0:
                    if repairer:
                        yield done()
                    key, repairer, digest, lines = name, Repairer(text), hashlib.sha256(), 0
                else:
                    put(repairer.row(role, text))
        if repairer:
            yield done()

    return stream.mapInArrow(run, schema)


def repair(rows: DataFrame, key: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", held: int = HELD, turns: int = TURNS) -> DataFrame:
    """One row per conversation: ``key``, ``gaps``, the rows with each fault, ``illegal``, ``cost``, ``audit``, ``repaired_sha256``.

    Rows follow their turns, null turns first; of one turn, roles and texts in
    order.  A row's first fault counts: no word, role and text of an earlier
    row, or a last word without ``.``, ``!`` or ``?`` at its end.  Null roles
    and texts count as one space.  The null key is a conversation like any
    other.  The audit has a letter per edit, in order: keep, rerole, delete,
    insert.  A role that begins with none of s, u, a cannot be kept.
    """
    named = _named(rows, key, turn, role, text).withColumn("turn", F.col("turn").cast("long"))
    # Contiguous pieces of the order, so that no task gets all of a long conversation.
    named = named.select("key", "turn", "role", "text", F.coalesce(F.floor(F.col("turn") / turns), F.lit(-(1 << 62))).alias("piece"))
    same = Window.partitionBy("key", "role", F.xxhash64("text"), "text").orderBy("turn")
    marked = stored(named.withColumn("fault", fault_of(F.col("role"), F.col("text"), F.row_number().over(same) > 1)), "marked")
    ordered = marked.repartition("key", "piece").sortWithinPartitions("key", "piece", *_ORDER)
    pieces = stored(_pieces(ordered, held), "pieces")
    several = pieces.groupBy("key").agg((F.count(F.lit(1)) > 1).alias("several"))
    told = stored(pieces.join(several.select(F.col("key").alias("other"), "several"), F.col("key").eqNullSafe(F.col("other"))).drop("other"), "told")
    fields = ["key", "turns", "low", "high", "blank", "duplicate", "truncated", "illegal", "cost", "audit"]
    whole = told.filter("NOT several AND audit IS NOT NULL").select(*fields, "repaired_sha256")
    joined = stored(_joined(told.filter("several OR audit IS NULL")), "joined")
    long = joined.select(*fields).join(_digests(marked, joined).withColumnRenamed("key", "other"), F.col("key").eqNullSafe(F.col("other"))).select(*fields, "repaired_sha256")
    gaps = F.coalesce(F.col("high") - F.col("low") + 1 - F.col("turns"), F.lit(0).cast("long"))
    return whole.unionByName(long).select(F.col("key").alias(key), gaps.alias("gaps"), *fields[4:], "repaired_sha256")


def with_missing(repaired: DataFrame, rows: DataFrame, key: str = "conv_id") -> DataFrame:
    """``repaired`` and, with zeros and the digest of nothing, the conversations of ``rows`` that have no row left."""
    every = rows.select(F.col(f"`{key}`").alias("every")).distinct()
    zero = {n: F.lit(0).cast("long") for n in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")} | {"audit": F.lit(""), "repaired_sha256": F.lit(hashlib.sha256(b"").hexdigest())}
    both = every.join(repaired, F.col("every").eqNullSafe(F.col(key)), "left")
    return both.select(F.col("every").alias(key), *(F.coalesce(F.col(n), z).alias(n) for n, z in zero.items()))
