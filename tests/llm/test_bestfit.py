import itertools
import json
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest

from landwatch.llm import bestfit as B

ODD = [None, "", " ", "a  b", " a b ", "x\n y z\n", "<|endoftext|>a b<|endoftext|>", "a\x1c b", "日本 語 です", "I'M don'T it's",
       "x" + " " * 3000 + "a b", " " * 2001, "\n" * 1500 + "'s", "long " * 9000, "é́x " * 700]


def reference_ids(texts):
    from tokenizers import Tokenizer

    encode = Tokenizer.from_file(B.VOCABULARY)
    return [encode.encode(t or "", add_special_tokens=False).ids + [0] for t in texts]


def check(rows, ids_of, capacity):
    """Every piece once, cut by the rule, and no gap in any sequence."""
    bins, found = defaultdict(list), defaultdict(list)
    for r in rows:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
        found[r["doc_id"]].append((r["piece"], r["start"], r["length"], r["ids_crc32"]))
    for places in bins.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    want = defaultdict(list)
    for key, ids in ids_of:
        first = (len(ids) - 1) % capacity + 1
        for k, stop in enumerate(range(first, len(ids) + 1, capacity)):
            start = max(0, stop - capacity) if k else 0
            want[key].append((k, start, stop - start, zlib.crc32(np.array(ids[start:stop], "<u4").tobytes())))
    assert {k: sorted(v) for k, v in found.items()} == {k: sorted(v) for k, v in want.items()}
    return len(bins)


def test_pieces_and_sequences_against_plain_encoding(spark, docs_of):
    rng = random.Random(5)
    rows = [(i, t) for i, t in enumerate(ODD)] + [(None, "same text"), (None, "same text"), (3, "again"), (3, "again")]
    rows += [(100 + i, " ".join(rng.choices(["one", "two", "Straße", "x,y", "12"], k=rng.choice([1, 5, 60, 61, 400])))) for i in range(300)]
    out = B.pack_documents(docs_of(rows).repartition(5), 256)
    n = check(out.collect(), list(zip([k for k, _ in rows], reference_ids([t for _, t in rows]))), 256)
    bins = []
    for length in sorted((r["length"] for r in out.collect()), reverse=True):  # first fit decreasing
        k = next((k for k, used in enumerate(bins) if used + length <= 256), None)
        bins.append(0) if k is None else None
        bins[-1 if k is None else k] += length
    assert n <= len(bins)
    assert out.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]


def test_given_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    ids = reference_ids([t for _, t in rows])
    n = check(B.pack_documents(docs).collect(), [(k, x) for (k, _), x in zip(rows, ids)], 2048)
    assert n == -(-sum(map(len, ids)) // 2048)


def test_every_token_encodes_itself():
    """Then merging by rank and by the list of merges give the same ids, for any text."""
    from tokenizers import Tokenizer, models

    with open(B.VOCABULARY, encoding="utf-8") as f:
        spec = json.load(f)
    merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in spec["model"]["merges"]]
    special = {x["content"] for x in spec["added_tokens"]}
    tokens = [t for t in spec["model"]["vocab"] if t not in special]
    plain = Tokenizer(models.BPE(vocab=spec["model"]["vocab"], merges=merges))
    assert all(e.ids == [spec["model"]["vocab"][t]] for t, e in zip(tokens, plain.encode_batch(tokens)))


def one_by_one(counts, capacity):
    """Best-two-fit a sequence at a time."""
    left, out = list(counts), []
    while any(left):
        took, gap = [], capacity
        for n in range(capacity, 0, -1):
            while left[n] and n <= gap:
                left[n] -= 1
                gap -= n
                took.append(n)
        small = min(took)
        pairs = [(x + y, x, y) for x, y in itertools.combinations_with_replacement([n for n in range(1, capacity) if left[n]], 2)
                 if x + y <= gap + small and left[x] >= 1 + (x == y)] if gap else []
        if pairs and (best := max(pairs, key=lambda p: (p[0], -p[1])))[0] > small:
            took.remove(small)
            left[small] += 1
            for n in best[1:]:
                left[n] -= 1
                took.append(n)
        out.append(sorted(took, reverse=True))
    return out


@pytest.mark.parametrize("seed", range(12))
def test_plan_is_the_rule_one_sequence_at_a_time(seed):
    rng = random.Random(seed)
    capacity = rng.choice([8, 13, 30])
    counts = [0] + [rng.choice([0, 0, 1, 2, 7, 40]) for _ in range(capacity)]
    steps = B.plan(np.array(counts), capacity)
    assert [[n for n, k in took for _ in range(k)] for took, times in steps for _ in range(times)] == one_by_one(counts, capacity)


def test_plan_does_not_grow_with_the_corpus():
    rng = np.random.default_rng(1)
    counts = np.concatenate(([0], rng.integers(0, 50, 2048)))
    few, many = B.plan(counts, 2048), B.plan(counts * 10**9, 2048)
    assert len(many) < 2 * len(few) + 2048
    assert sum(k for _, k in many) <= 1.02 * (counts * np.arange(2049)).sum() * 1e9 / 2048


def test_empty_table(spark, docs_of):
    assert B.pack_documents(docs_of([])).collect() == []
