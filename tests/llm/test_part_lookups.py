"""The part encoder works on arrays: what it calls in Python does not grow with the parts."""

import json
import random
import sys

import numpy as np
import pyarrow as pa
from tokenizers import Tokenizer

from lotwatch.llm import bpe
from lotwatch.llm.queries import BYTE_BPE


def _ids(library, text):
    return np.array(library.encode(text or "", add_special_tokens=False).ids, "<u4").tobytes()


def test_no_call_for_each_part():
    encode = bpe.PartEncoder(bpe.tree_encoder(BYTE_BPE).encode_parts, bpe.vocabulary(BYTE_BPE).special)
    rnd = random.Random(2)
    text = " ".join("".join(rnd.choices("abcdefgh", k=9)) + rnd.choice(["", ",", "."]) for _ in range(3000))
    calls = 0

    def count(frame, event, arg):
        nonlocal calls
        calls += event == "call"

    sys.setprofile(count)
    try:
        first, again = encode([text]), encode([text])
    finally:
        sys.setprofile(None)
    assert first == again == [_ids(Tokenizer.from_file(BYTE_BPE), text)]
    assert calls < 3000


def test_pair_ranks_by_hash_equal_those_of_the_sorted_keys():
    vocab = bpe.vocabulary(BYTE_BPE)
    library = Tokenizer.from_file(BYTE_BPE)
    pairs = {}
    for rank, merge in enumerate(json.loads(library.to_str())["model"]["merges"]):
        a, b = merge if isinstance(merge, list) else merge.split(" ")
        pairs.setdefault((library.token_to_id(a), library.token_to_id(b)), rank)
    rng = np.random.default_rng(0)
    left = np.concatenate([[p[0] for p in pairs], rng.integers(-1, vocab.size, 50_000), [-1, -1, 5, 5]])
    right = np.concatenate([[p[1] for p in pairs], rng.integers(-1, vocab.size, 50_000), [-1, vocab.size - 1, -1, vocab.size - 1]])
    wanted = [pairs.get(p, -1) for p in zip(left.tolist(), right.tolist(), strict=True)]
    assert vocab.pair_ranks(left, right).tolist() == wanted


def test_every_letter_and_any_white_space_as_the_library_has_it():
    library = Tokenizer.from_file(BYTE_BPE)
    encoder = bpe.tree_encoder(BYTE_BPE)
    letters = [chr(i) for i in range(0x30000) if not 0xD800 <= i < 0xE000]
    texts = ["x " + " ".join(f"ab{c}cd,. {c}." for c in letters[k : k + 400]) for k in range(0, len(letters), 400)]
    rnd = random.Random(3)
    pieces = [" ", " ", "  ", "\n", "\x85", "　", "\x1c", "ab", "c", "don't", "x,.", "12", "日本", "<|endoftext|>", "<|endof"]
    texts += [None, "", *("".join(rnd.choices(pieces, k=rnd.randint(0, 30))) for _ in range(600))]
    for a in range(0, len(texts), 100):
        part = texts[a : a + 100]
        assert encoder.encode(pa.array(["", *part], pa.string()).slice(1), b"1234").to_pylist() == [_ids(library, t) + b"1234" for t in part]


def test_words_of_all_widths_beside_each_other():
    library = Tokenizer.from_file(BYTE_BPE)
    rnd = random.Random(4)
    texts = ["x " + " ".join("".join(rnd.choices("etaoin", k=k)) for k in (1, 2, 3, 63, 64, 65, 127, 128, 129)) for _ in range(20)]
    texts.append("x " + "".join(rnd.choices("etaoinshr", k=40_000)))
    assert bpe.tree_encoder(BYTE_BPE)(texts) == [_ids(library, t) for t in texts]
