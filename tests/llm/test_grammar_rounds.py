"""Pairs are replaced until none is frequent."""

import random
from collections import Counter

import numpy as np
import pytest

from strataflow.llm import grammar


def test_no_frequent_pair_remains():
    rnd = np.random.default_rng(3)
    passage = rnd.integers(0, 1000, 300)
    docs = [np.concatenate([rnd.integers(0, 1000, 20), passage]) for _ in range(20)] + [np.zeros(500, np.int64)]
    ids, ends = np.concatenate(docs).astype(np.uint32), np.cumsum([len(d) for d in docs])
    seq, ends_in, rules, terminals = grammar.compress(ids, ends)
    first = len(terminals)
    assert (terminals[grammar.expand(seq, rules, first)] == ids).all()
    parts = [seq[a:b].tolist() for a, b in zip(np.r_[0, ends_in[:-1]], ends_in, strict=True)]
    assert max(Counter(p for d in parts for p in zip(d, d[1:], strict=False)).values()) < grammar.MIN_COUNT
    assert grammar.rule_lengths(rules, first).max() > 256


def test_shards_are_smaller_than_16_bit_ids():
    import pyarrow as pa

    from strataflow.llm.text import default_tokenizer, token_ids

    rnd = random.Random(2)
    words = [rnd.choice("aeiou") + rnd.choice("bdfklmnprst") + rnd.choice(["an", "er", "ing", "os"]) for _ in range(400)]
    texts = [" ".join(rnd.choices(words, k=300)) for _ in range(150)]
    ids, offsets = token_ids(pa.array(texts), default_tokenizer(), grammar.END_ID)
    body, symbols = grammar.write_shard(ids, offsets[1:])
    assert ids.max() < 1 << 16 and len(body) < 0.8 * 2 * len(ids) and symbols < len(ids)
    assert (grammar.Shard(body).all() == ids).all()


@pytest.mark.parametrize("top", [0, 1, 2, 255, 65535, 2**32 - 1])
def test_bits_round_trip(top):
    rng = np.random.default_rng(top)
    for n in (0, 1, 7, 70000):
        v = rng.integers(0, top + 1, n)
        packed = b"xx" + grammar.pack_bits(v) + b"yy"
        assert (grammar.unpack_bits(packed, 2, n) == v).all() and len(packed) == 4 + grammar.packed_bytes(packed, 2, n)
        a = n // 3
        assert (grammar.unpack_bits(packed, 2, n - a - n // 5, a) == v[a : n - n // 5]).all()
