import random

import numpy as np

from landwatch.llm import language as L

ALPHABETS = {"aa": "abcde", "bb": "klmno", "cc": "жшщюя"}


def text(rng, lang):
    return " ".join("".join(rng.choices(ALPHABETS[lang], k=rng.randint(2, 9))) for _ in range(rng.randint(3, 60)))


def test_held_out_accuracy_and_rejection(spark, docs_of):
    rng = random.Random(4)
    langs = list(ALPHABETS)
    model = L.fit(docs_of([(i, text(rng, langs[i % 3]), langs[i % 3]) for i in range(300)]))
    assert sum(x == "aa" for x in model.langs) > 1
    new = [(i, text(rng, langs[i % 3]), None) for i in range(150)] + [(150, "0 1 2 ..."), (151, None), (152, ""), (153, "QQ XX WW QQ XX WW VV")]
    got = {r["doc_id"]: r for r in L.identify(docs_of(new), model).collect()}
    assert all(got[i]["lang_pred"] == langs[i % 3] and 0 < got[i]["score"] <= 1 for i in range(150))
    assert [got[i]["lang_pred"] for i in (150, 151, 152)] == ["und"] * 3 and got[150]["score"] == 0
    assert got[153]["rejected"] and got[153]["lang_pred"] in langs
    assert sum(got[i]["rejected"] for i in range(150)) < 30


def test_nothing_to_learn_from(spark, docs_of):
    model = L.fit(docs_of([(1, "abc", None), (2, None, "aa"), (None, "abc", "aa")]))
    got = L.identify(docs_of([(1, "abc"), (1, "abc"), (2, "x" * 200_000)]), model).collect()
    assert [r["lang_pred"] for r in got] == ["und"] * 3
    assert L.identify(docs_of([]), model).collect() == []


def plain_vector(text, idf):
    """TF-IDF from a dictionary of buckets, n-gram by n-gram."""
    from landwatch.llm.ngrams import codes

    c, found = [int(x) for x in codes(text)], {}
    for n in (1, 2, 3):
        for i in range(len(c) - n + 1):
            h = c[i]
            for x in c[i + 1 : i + n]:
                h = (h * 0x01000193 + x) & 0xFFFFFFFF
            at = (((h + n) & 0xFFFFFFFF) * 0x9E3779B1 & 0xFFFFFFFF) >> (32 - L.BITS)
            found[at] = found.get(at, 0) + 1
    v = np.zeros(L.BUCKETS)
    for at, k in found.items():
        v[at] = np.log1p(k) * idf[at]
    return v / max(np.sqrt((v * v).sum()), 1e-12)


def test_cosines_against_plain_loops(spark, docs_of):
    rng = random.Random(6)
    langs = list(ALPHABETS)
    docs = [(i, text(rng, langs[i % 3]), langs[i % 3]) for i in range(90)]
    model = L.fit(docs_of(docs))
    new = [(i, text(rng, langs[i % 3]), None) for i in range(30)]
    got = {r["doc_id"]: r for r in L.identify(docs_of(new), model).collect()}
    for i, t, _ in new:
        cos = [sum(a * b for a, b in zip(c.tolist(), plain_vector(t, model.idf).tolist())) for c in model.centroids]
        best = max(range(len(cos)), key=lambda k: cos[k])
        assert abs(got[i]["score"] - cos[best]) < 1e-4 and (got[i]["lang_pred"] == model.langs[best] or sorted(cos)[-1] - sorted(cos)[-2] < 1e-5)
        assert got[i]["rejected"] == (cos[best] < model.least[best]) or abs(cos[best] - model.least[best]) < 1e-5
