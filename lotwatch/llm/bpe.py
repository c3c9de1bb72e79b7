"""Byte-level BPE encoding and decoding.

A text is cut at its spaces into parts that the merges never cross, and parts
seen before are looked up.  New words are merged many at a time: each has a
segment tree over its adjacent pairs whose root is the leftmost pair of lowest
rank; a merge updates three leaves and their paths, until no mergeable pair is
left.  The trees of equally wide words lie in one array.

Token ids are little-endian unsigned 32-bit integers in a binary column.
"""

from __future__ import annotations

import functools
import json
import re
from collections.abc import Callable, Iterable, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from lotwatch.llm.rows import map_column, remembering

# White space of the splitting pattern, and the pattern itself.
SPACE = r"\t-\r \x85\xa0  -     　"
SPLIT = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{SPACE}\p{{L}}\p{{N}}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+"

# Marks that are words by themselves after letters.
MARKS = ",.!?;:"

# Bounds of memory only: parts remembered per Python worker, and tree cells held at once.
REMEMBERED_PARTS = 150_000
TREE_CELLS = 131_072
# Up to this width all inner nodes are made again after a round of merges, beyond it those on the changed paths.
WHOLE_TREES = 64
# Cells of the vocabulary's hash table of pairs, as a power of two, and marks of free ones and of those that several pairs share.
CELL_BITS = 18
FREE, SHARED = -(2**62), -(2**62) - 1


def _byte_letters() -> dict[str, int]:
    """The letters that stand for bytes in the vocabulary file: printable ones for themselves, others from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Vocabulary:
    """Merges and tokens of a tokenizers JSON file of the byte-level BPE kind."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            data = json.load(file)
        model, letters = data["model"], _byte_letters()
        vocab = model["vocab"]
        self.special = {t["content"]: t["id"] for t in data["added_tokens"]}
        self.size = size = 1 + max([*vocab.values(), *self.special.values()])
        self.token_bytes = [b""] * size
        for token, i in vocab.items():
            if token not in self.special:
                self.token_bytes[i] = bytes(letters[c] for c in token)
        for token, i in self.special.items():
            self.token_bytes[i] = token.encode()
        self.byte_id = np.zeros(256, np.int64)
        for letter, b in letters.items():
            self.byte_id[b] = vocab[letter]
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self.merged = np.array([vocab[a + b] for a, b in pairs], np.int64)
        # Keys are never negative, and "no symbol", -1, is in none of them.
        keys = self._keys(np.array([vocab[a] for a, _ in pairs], np.int64), np.array([vocab[b] for _, b in pairs], np.int64))
        # Of a pair listed twice the lower rank counts.
        self.keys, self.ranks = np.unique(keys, return_index=True)
        # Most pairs are found, or known to be none, by one look at the cell of their hash.
        cells = self._cells(self.keys)
        self.cell_keys, self.cell_ranks = np.full(1 << CELL_BITS, FREE, np.int64), np.full(1 << CELL_BITS, -1, np.int32)
        self.cell_keys[cells], self.cell_ranks[cells] = self.keys, self.ranks
        # Cells that several pairs share send the search to the sorted keys.
        self.cell_keys[np.bincount(cells, minlength=1 << CELL_BITS) > 1] = SHARED
        self.byte_ranks = self.pair_ranks(np.repeat(self.byte_id, 256), np.tile(self.byte_id, 256)).reshape(256, 256)

    def _keys(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        return left * (self.size + 1) + (right + 1)

    @staticmethod
    def _cells(keys: np.ndarray) -> np.ndarray:
        return (keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - CELL_BITS)).astype(np.int64)

    def pair_ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair, or -1; a negative id pairs with nothing."""
        wanted = self._keys(left, right)
        cells = self._cells(wanted)
        held = self.cell_keys[cells]
        ranks = np.where(held == wanted, self.cell_ranks[cells], -1)
        shared = np.flatnonzero(held == SHARED)
        if len(shared):
            wanted = wanted[shared]
            at = np.minimum(np.searchsorted(self.keys, wanted), len(self.keys) - 1)
            ranks[shared] = np.where(self.keys[at] == wanted, self.ranks[at], -1)
        return ranks


@functools.lru_cache(maxsize=4)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def _merge_rows(cells: np.ndarray, lengths: np.ndarray, vocab: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """Merge words side by side, one in a column of ``cells``, whose height is a power of two: ids in order, and how many of each."""
    width, n = cells.shape
    bits = width.bit_length() - 1
    inside = np.arange(width)[:, None] < lengths
    # A node holds rank and place of a pair in one number, which stays small for narrow words.
    kind = np.int32 if int(vocab.ranks.max(initial=0)) << bits < 2**30 else np.int64
    no_pair = np.iinfo(kind).max
    # One spare place at the end stands for "no symbol".
    ids = np.full((width + 1, n), -1, np.int64)
    ids[:width] = np.where(inside, vocab.byte_id[cells], -1)
    after = np.repeat(np.arange(1, width + 2, dtype=np.int32)[:, None], n, axis=1)
    after[lengths - 1, np.arange(n)] = width
    after[width] = width
    before = np.repeat(np.arange(-1, width, dtype=np.int32)[:, None], n, axis=1)
    before[0] = width

    # The spare place has a leaf of its own below no node.
    tree = np.full((2 * width + 1, n), no_pair, kind)
    ranks = vocab.byte_ranks[cells[:-1], cells[1:]].astype(kind)
    tree[width : 2 * width - 1] = np.where((ranks >= 0) & inside[1:], (ranks << bits) | np.arange(width - 1)[:, None], no_pair)
    del inside, ranks

    def make_nodes() -> None:
        level = width // 2
        while level:
            np.minimum(tree[2 * level : 4 * level : 2], tree[2 * level + 1 : 4 * level : 2], out=tree[level : 2 * level])
            level //= 2

    make_nodes()
    ids_, after_, before_, tree_ = ids.reshape(-1), after.reshape(-1), before.reshape(-1), tree.reshape(-1)
    rows = np.arange(n)
    while True:
        root = tree[1][rows]
        going = root != no_pair
        if not going.all():
            rows, root = rows[going], root[going]
        if not len(rows):
            break
        left = (root & (width - 1)).astype(np.int64)
        at_left = left * n + rows
        right = after_[at_left].astype(np.int64)
        at_right = right * n + rows
        beyond, ahead = after_[at_right].astype(np.int64), before_[at_left].astype(np.int64)
        at_beyond, at_ahead = beyond * n + rows, ahead * n + rows
        ids_[at_left] = new = vocab.merged[root >> bits]
        ids_[at_right] = -1
        after_[at_left] = beyond
        before_[at_beyond] = left
        to_right = vocab.pair_ranks(new, ids_[at_beyond]).astype(np.int64)
        to_left = vocab.pair_ranks(ids_[at_ahead], new).astype(np.int64)
        tree_[width * n + at_right] = no_pair
        tree_[width * n + at_left] = np.where(to_right >= 0, (to_right << bits) | left, no_pair)
        tree_[width * n + at_ahead] = np.where(to_left >= 0, (to_left << bits) | ahead, no_pair)
        if width <= WHOLE_TREES:
            make_nodes()
            continue
        has = ahead < width
        spot = np.concatenate([left, right, ahead[has]]) + width
        below = np.concatenate([rows, rows, rows[has]])
        for _ in range(bits):
            spot >>= 1
            under = 2 * spot * n + below
            tree_[spot * n + below] = np.minimum(tree_[under], tree_[under + n])
    found = ids[:width].T
    kept = found >= 0
    return found[kept].astype("<u4"), kept.sum(axis=1)


def merge_array(words: pa.Array, vocab: Vocabulary) -> pa.BinaryArray:
    """Token ids of words (strings or binary, none null) that the splitting pattern made."""
    words = words.cast(pa.binary())
    if not len(words):
        return words
    ends = np.frombuffer(words.buffers()[1], np.int32)[words.offset : words.offset + len(words) + 1].astype(np.int64)
    data = np.frombuffer(words.buffers()[2] or b"", np.uint8)
    starts, lengths = ends[:-1], np.diff(ends)
    # The least power of two that holds the word.
    bits = np.frexp(np.maximum(lengths - 1, 0).astype(float))[1]
    bits[lengths == 0] = -1
    order = np.argsort(bits, kind="stable")
    classes, firsts = np.unique(bits[order], return_index=True)
    ids, counts = [], []
    for bit, places in zip(classes.tolist(), np.split(order, firsts[1:]), strict=True):
        if bit < 1:
            made = vocab.byte_id[data[starts[places]]].astype("<u4") if bit == 0 else np.zeros(0, "<u4")
            ids.append(made)
            counts.append(lengths[places])
            continue
        step = max(1, TREE_CELLS >> bit)
        for a in range(0, len(places), step):
            block = places[a : a + step]
            cells = data[np.minimum(starts[block] + np.arange(1 << bit)[:, None], len(data) - 1)]
            made, n = _merge_rows(cells, lengths[block], vocab)
            ids.append(made)
            counts.append(n)
    offsets = np.zeros(len(words) + 1, np.int32)
    np.cumsum(4 * np.concatenate(counts), out=offsets[1:])
    sorted_ids = pa.BinaryArray.from_buffers(pa.binary(), len(words), [None, pa.py_buffer(offsets), pa.py_buffer(np.concatenate(ids))])
    places = np.empty(len(words), np.int64)
    places[order] = np.arange(len(words))
    return sorted_ids.take(pa.array(places))


def merge_words(words: Sequence[bytes], vocab: Vocabulary) -> list[bytes]:
    """Token ids of words that the splitting pattern made."""
    return merge_array(pa.array(words, pa.binary()), vocab).to_pylist()


def joined(values: pa.BinaryArray, bounds: np.ndarray) -> pa.BinaryArray:
    """Neighbouring values of a whole array (no slice, none null) joined between ``bounds``."""
    offsets = np.frombuffer(values.buffers()[1], np.int32, len(values) + 1)[bounds]
    return pa.BinaryArray.from_buffers(pa.binary(), len(bounds) - 1, [None, pa.py_buffer(offsets), values.buffers()[2]])


class PartEncoder:
    """Encode whole texts, remembering the ids of parts between spaces.

    A single space between two characters that are no white space always begins
    a new word of the splitting pattern, so texts may be cut there.  Arrow
    numbers the different parts of a slice of texts, and only these are looked
    up.  Parts are remembered in two generations: when the young one is full it
    becomes the old one, and what is met again moves back to the young one.
    """

    def __init__(self, encode_parts: Callable[[Sequence[str], Sequence[str]], Iterable[bytes]], special: dict[str, int], remembered: int = REMEMBERED_PARTS):
        self.encode_parts = encode_parts
        self.special = {s: i.to_bytes(4, "little") for s, i in special.items()}
        self.at_special = re.compile("(" + "|".join(map(re.escape, sorted(special, key=len, reverse=True))) + ")") if special else None
        self.remembered = remembered
        # Ids of parts that follow a space, under the part without it.
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def __call__(self, texts: Sequence[str | None]) -> list[bytes]:
        """Ids of each text; null counts as the empty text."""
        return self.encode(pa.array(texts, pa.string())).to_pylist()

    def encode(self, texts: pa.Array, end: bytes = b"") -> pa.BinaryArray:
        """Ids of each text and ``end``; null counts as the empty text."""
        texts = pc.fill_null(texts, "")
        if self.at_special:
            marked = functools.reduce(pc.or_, (pc.match_substring(texts, s) for s in self.special))
            if pc.any(marked).as_py():
                # Every other piece is a special token.
                cut = [self.at_special.split(t) if m else [t] for t, m in zip(texts.to_pylist(), marked.to_pylist(), strict=True)]
                plain = iter(self._encode(pa.array([p for c in cut for p in c[::2]], pa.string()), b"").to_pylist())
                return pa.array([b"".join(self.special[p] if k % 2 else next(plain) for k, p in enumerate(c)) + end for c in cut], pa.binary())
        return self._encode(texts, end)

    def _encode(self, texts: pa.Array, end: bytes) -> pa.BinaryArray:
        n = len(texts)
        if not n:
            return pa.array([], pa.binary())
        lists = pc.split_pattern(texts, " ")
        bounds = lists.offsets.to_numpy().astype(np.int64)
        numbered = lists.values.dictionary_encode()
        parts, codes = numbered.dictionary.to_numpy(zero_copy_only=False), numbered.indices.to_numpy()
        follows = np.ones(len(codes), bool)
        follows[bounds[:-1]] = False
        wanted = np.zeros(len(parts), bool)
        wanted[codes[follows]] = True

        if len(self.young) > self.remembered:
            self.old, self.young = self.young, {}
        names = parts.tolist()
        found = list(map(self.young.get, names))
        missing = [i for i, ids in enumerate(found) if ids is None]
        unknown = []
        for i, ids in zip(missing, map(self.old.get, [names[i] for i in missing]), strict=True):
            if ids is None:
                unknown.append(i)
            else:
                self.young[names[i]] = found[i] = ids
        opens, closes = np.zeros((2, len(parts)), bool)  # parts that begin or end with white space, or are empty
        for i in [i for i in unknown if not names[i] or names[i].strip() != names[i]]:
            part = names[i]
            opens[i], closes[i] = not part or part[0].isspace(), not part or part[-1].isspace()
        new_at = np.array(unknown, np.int64)
        fresh = new_at[(wanted & ~opens & ~closes)[new_at]].tolist()

        # White space around a space may belong to one word with it: such parts are joined again.
        odd = (opens | closes)[codes]
        glued = np.zeros(len(codes) + 1, bool)
        if odd.any():
            glued[1:-1] = follows[1:] & (opens[codes[1:]] | closes[codes[:-1]])
        # Texts' first parts, and parts that are odd or joined, are encoded anew each time.
        heads = np.flatnonzero(~glued[:-1] & (~follows | odd | glued[1:]))
        ends = heads + 1
        several = glued[ends]
        ends[several] = np.flatnonzero(glued[:-1] & ~glued[1:]) + 1
        apart: dict[str, int] = {}
        places = []
        for a, b, inner in zip(heads.tolist(), ends.tolist(), follows[heads].tolist(), strict=True):
            whole = names[codes[a]] if b == a + 1 else " ".join(parts[codes[a:b]])
            places.append(apart.setdefault(" " + whole if inner else "\n" + whole, len(apart)))
        new = [names[i] for i in fresh]
        made = iter(self.encode_parts([p if p[0] == " " else p[1:] for p in apart], new))
        found += [next(made) for _ in apart]
        encoded = list(made)
        for i, ids in zip(fresh, encoded, strict=True):
            found[i] = ids
        self.young.update(zip(new, encoded, strict=True))

        at = codes.copy()
        at[glued[:-1]] = len(found)
        at[heads] = len(parts) + np.array(places)
        if end:
            at = np.insert(at, bounds[1:], len(found) + 1)
            bounds = bounds + np.arange(n + 1)
        return joined(pa.array([*found, b"", end], pa.binary()).take(pa.array(at)), bounds)


_pattern = regex.compile(SPLIT)


def _words(part: str) -> list[str]:
    """Words of a part that follows a space: the pattern's, found without it where it is letters and then marks."""
    letters = part.rstrip(MARKS)
    if letters.isalpha():
        return [" " + letters, part[len(letters) :]] if len(letters) < len(part) else [" " + part]
    return _pattern.findall(" " + part)


@functools.lru_cache(maxsize=4)
def tree_encoder(path: str, remembered: int = REMEMBERED_PARTS) -> PartEncoder:
    """Encoder of this worker whose new parts are merged in segment trees."""
    vocab = vocabulary(path)

    def encode_parts(firsts: Sequence[str], parts: Sequence[str]) -> Iterable[bytes]:
        # Most parts are letters and then marks, and so are their words; others are cut by the pattern.
        spaced = pa.array(parts, pa.string())
        letters = pc.utf8_rtrim(spaced, characters=MARKS)
        plain = pc.utf8_is_alpha(letters).to_numpy(zero_copy_only=False)
        marks = pc.binary_length(spaced).to_numpy() - pc.binary_length(letters).to_numpy()
        marked = np.flatnonzero(plain & (marks > 0))
        tails = [parts[i][-n:] for i, n in zip(marked.tolist(), marks[marked].tolist(), strict=True)]
        others = np.flatnonzero(~plain)
        cut = [*map(_pattern.findall, firsts), *(_pattern.findall(" " + parts[i]) for i in others.tolist())]
        words = pa.concat_arrays(
            [
                pc.binary_join_element_wise("", letters.filter(pa.array(plain)), " "),
                pa.array(tails, pa.string()),
                pa.array([w for c in cut for w in c], pa.string()),
            ]
        )
        rows = np.concatenate([np.arange(len(firsts)), len(firsts) + others]).repeat(np.fromiter(map(len, cut), np.int64, len(cut)))
        rows = np.concatenate([len(firsts) + np.flatnonzero(plain), len(firsts) + marked, rows])
        order = np.argsort(rows, kind="stable")
        numbered = words.dictionary_encode()
        ids = merge_array(numbered.dictionary, vocab).take(numbered.indices.take(pa.array(order)))
        n = len(firsts) + len(parts)
        bounds = np.zeros(n + 1, np.int64)
        np.cumsum(np.bincount(rows, minlength=n), out=bounds[1:])
        return joined(ids, bounds).to_pylist()

    return PartEncoder(encode_parts, vocab.special, remembered)


def bpe_encode(df: DataFrame, path: str, text: str = "text", ids: str = "ids", keep: Sequence[str] | None = None) -> DataFrame:
    """Replace the text column by its token ids (binary, unsigned 32-bit, little-endian).

    Null and empty texts get no ids (an empty binary).  Rows are independent,
    so repeated rows and ties need no rule; the columns in ``keep`` (all, if
    not given) stay, save one named like the output, which is replaced.
    """

    def make(values: list) -> list[Sequence]:
        remembering("bpe", tree_encoder.cache_clear)
        return [tree_encoder(path)(values)]

    return map_column(df, text, make, {ids: (T.BinaryType(), pa.binary())}, keep)


def bpe_decode(df: DataFrame, path: str, ids: str = "ids", text: str = "decoded", keep: Sequence[str] | None = None) -> DataFrame:
    """Replace the ids by their text; bytes that are no UTF-8 become U+FFFD.

    Null or empty ids give the empty text.  An id beyond the vocabulary is an error.
    """

    def make(values: list) -> list[Sequence]:
        table = vocabulary(path).token_bytes
        return [[b"".join(map(table.__getitem__, np.frombuffer(v or b"", "<u4").tolist())).decode(errors="replace") for v in values]]

    return map_column(df, ids, make, {text: (T.StringType(), pa.string())}, keep)
