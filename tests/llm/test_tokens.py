import random

import pytest

from landwatch.llm import tokens as K


@pytest.mark.parametrize("rule", ["start", "end", "most"])
def test_sections_equal_brute_force(spark, docs_of, rule):
    rng = random.Random(1)
    rows = [(i, "".join(rng.choice(["a", "the ", "\n", "\n\n", "é", "日本", "🙂", " x", "12"]) for _ in range(rng.randint(0, 80)))) for i in range(60)]
    rows += [(60, None), (61, ""), (62, "\n"), (63, "no end"), (63, "no end"), (None, "a\nb")]
    enc, _ = K.encoder(K.VOCABULARY)
    got = {}
    for r in K.section_tokens(docs_of(rows), rule=rule).collect():
        got.setdefault(r["doc_id"], []).append(tuple(r[1:]))
    assert set(got) == {r[0] for r in rows}
    for doc, text in rows:
        raw = (text or "").encode()
        tokens, at = [], 0
        for t in enc.encode_ordinary(text or ""):
            size = len(enc.decode_single_token_bytes(t))
            tokens.append((at, at + size))
            at += size
        assert at == len(raw)
        pieces = raw.split(b"\n")
        pieces = [p + b"\n" for p in pieces[:-1]] + ([pieces[-1]] if pieces[-1] or len(pieces) == 1 else [])
        want, lo = [], 0
        for k, p in enumerate(pieces):
            want.append([k, lo, lo + len(p), 0, 0])
            lo += len(p)
        for a, b in tokens:
            held = [min(b, w[2]) - max(a, w[1]) for w in want]
            inside = [k for k, h in enumerate(held) if h > 0]
            k = {"start": inside[0], "end": inside[-1], "most": max(inside, key=lambda i: (held[i], -i))}[rule]
            want[k][3] += 1
            want[k][4] += len(inside) > 1
        times = sum(r[0] == doc for r in rows)
        assert sorted(got[doc]) == sorted([tuple(w) for w in want] * times)


def test_documents_add_up_and_empty_table(spark, docs_of):
    sections = K.section_tokens(docs_of([(1, "a b\nc"), (2, None)]))
    got = {r["doc_id"]: (r["n_sections"], r["n_tokens"]) for r in K.document_tokens(sections).collect()}
    enc, _ = K.encoder(K.VOCABULARY)
    assert got == {1: (2, len(enc.encode_ordinary("a b\nc"))), 2: (1, 0)}
    assert K.section_tokens(docs_of([])).collect() == []
    with pytest.raises(ValueError):
        K.section_tokens(docs_of([]), rule="other")
