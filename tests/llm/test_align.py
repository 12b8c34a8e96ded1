import hashlib
import itertools
import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from landwatch.llm import align as A

TEXTS = [None, "", " ", "a  b", " a b ", "x\n y z\n", "the end</s> <s> <|endoftext|> of it", "a▁b is not spelled", "日本 語 です", "I'M don'T it's fine",
         "tab\t stop", "x" + " " * 1200 + "a b", "é́x y ﬁ ﬀ　full", "a​b ﻿c", "\x1c \x85 a", "<0x41> bytes", "long words " * 3000, "one", "ends in blank ", "\n\n\n"]


def expected(rows):
    """The contract, one token at a time."""
    import sentencepiece
    from tokenizers import Tokenizer

    first = Tokenizer.from_file(A.BYTE_VOCABULARY)
    first.encode_special_tokens = True
    byte_of = A.ByteLevel.__init__.__globals__["byte_alphabet"]()
    second = sentencepiece.SentencePieceProcessor(model_file=A.PIECE_VOCABULARY)
    docs, counts = [], Counter()
    for key, text in rows:
        links, groups, a, b = [], [], [], []
        if text:
            a = [(k, bytes(byte_of[c] for c in first.id_to_token(k))) for k in first.encode(" " + text, add_special_tokens=False).ids]
            for k in second.encode(text):
                p = second.id_to_piece(k)
                b.append((k, bytes([int(p[3:5], 16)]) if second.is_byte(k) else p.replace("▁", " ").encode()))
            if not b"".join(x for _, x in a) == b"".join(x for _, x in b) == (" " + text).encode():
                a, b = [], []
            at_a, at_b = (dict(zip(itertools.accumulate(len(x) for _, x in side), range(len(side)))) for side in (a, b))
            i = j = 0
            for end in sorted(at_a.keys() & at_b.keys()):
                p, q = at_a[end], at_b[end]
                links.append((a[p][0], b[q][0]))
                groups.append(",".join(str(k) for k, _ in a[i : p + 1]) + "|" + ",".join(str(k) for k, _ in b[j : q + 1]))
                i, j = p + 1, q + 1
        counts.update(links)
        docs.append((key, len(a), len(b), links, hashlib.sha256(";".join(groups).encode()).hexdigest() if a else ""))
    highest = defaultdict(int)
    for (_, b), n in counts.items():
        highest[b] = max(highest[b], n)
    return [(key, n_a, n_b, len(links), len(links), sum(counts[x] == highest[x[1]] for x in links), sum(counts[x] for x in links), sha)
            for key, n_a, n_b, links, sha in docs]


def test_against_token_by_token(spark, docs_of):
    rng = random.Random(3)
    words = ["the", "Straße", "naïve", "token,", "don't", "x1y2", "été.", "日本", "(a)", "b;c", "alignment", "unbelievable"]
    rows = list(enumerate(TEXTS)) + [(None, "the end"), (None, "the end"), (7, "the end")]
    rows += [(100 + i, " ".join(rng.choices(words, k=rng.choice([1, 4, 30, 90])))) for i in range(150)]
    out = A.align_tokens(docs_of(rows).repartition(4), spill_at=150, fan=2)
    assert out.columns == "doc_id n_a n_b n_groups n_links n_best count_sum groups_sha256".split()
    assert sorted(map(tuple, out.collect()), key=str) == sorted(expected(rows), key=str)


def test_given_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    assert sorted(map(tuple, A.align_tokens(docs).collect())) == sorted(expected(rows))


def test_no_tokens_at_all(spark, docs_of):
    assert A.align_tokens(docs_of([])).collect() == []
    assert [tuple(r) for r in A.align_tokens(docs_of([(1, None)])).collect()] == [(1, 0, 0, 0, 0, 0, 0, "")]


def runs_of(rng, n):
    out = []
    for _ in range(n):
        codes = np.unique(rng.integers(0, 5000, rng.integers(1, 900)).astype(np.uint64) * np.uint64(77))
        out.append((codes, rng.integers(1, 1000, len(codes))))
    return out


@pytest.mark.parametrize("seed", range(5))
def test_merge_sums_every_pair(seed, monkeypatch):
    monkeypatch.setattr(A, "BLOCK", 37)
    rng = np.random.default_rng(seed)
    runs = runs_of(rng, int(rng.integers(1, 12)))
    want = Counter()
    for codes, links in runs:
        want.update(dict(zip(codes.tolist(), links.tolist())))
    blobs = [A.packed(A.steps(c), A.least_type(n)) for c, n in runs]
    parts = list(A.merged([A.blocks(b) for b in blobs]))
    codes = np.concatenate([c for c, _ in parts])
    assert (np.diff(codes.astype(np.int64)) > 0).all() and all(len(c) <= 37 * len(runs) for c, _ in parts)
    assert dict(zip(codes.tolist(), np.concatenate([n for _, n in parts]).tolist())) == want


def test_totals_in_several_rows(spark, monkeypatch):
    """Rows of counts never cut a second id, so its highest count is right."""
    rng = np.random.default_rng(2)
    b, a = rng.integers(0, 40, 3000) * A.RADIXES + 3, rng.integers(0, 60, 3000)
    codes = np.unique(A.pair_code(a, b))
    links = rng.integers(1, 50, len(codes))
    # The default row size holds them all; the rule is tested on what one row gives.
    runs = spark.createDataFrame([(3, 0, bytearray(A.packed(A.steps(codes[::2]), A.least_type(links[::2])))),
                                  (3, 1, bytearray(A.packed(A.steps(codes[1::2]), A.least_type(links[1::2]))))], "radix int, run long, counts binary")
    (row,) = A.totals(runs).collect()
    gaps, got, best = A.unpacked(bytes(row["totals"]))
    assert (np.cumsum(gaps, dtype=np.uint64) == codes).all() and (got == links).all()
    ids = A.second_id(codes)
    assert all(best[k] == (links[k] == links[ids == ids[k]].max()) for k in range(len(codes)))
