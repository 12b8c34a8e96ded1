import random

import numpy as np

from landwatch.llm import toxicity as T


def make(rng, toxic, marks):
    words = ["".join(rng.choices("aeiourstln", k=rng.randint(2, 8))) for _ in range(rng.randint(20, 60))]
    for _ in range(rng.randint(2, 4) if toxic else 0):
        words.insert(rng.randrange(len(words)), rng.choice(marks))
    return " ".join(words)


def test_unseen_misspellings_are_found_and_clean_texts_left(spark, docs_of):
    rng = random.Random(8)
    rows = [(i, make(rng, i % 4 == 0, ["vexgrobbler", "zumpfhack"])) for i in range(1200)]
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(1200)], "doc_id long, label int")
    model = T.fit(docs_of(rows), labels)
    new = [(i, make(rng, i % 2 == 0, ["vexgrobblr", "zumpfhakk"])) for i in range(200)]
    got = T.scored(docs_of(new), model).collect()
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in got)
    right = np.mean([r["predicted"] == int(r["doc_id"] % 2 == 0) for r in got])
    assert right > 0.9


def test_scores_of_odd_texts_and_labels(spark, docs_of):
    odd = docs_of([(1, None), (2, ""), (3, " .. "), (None, "words"), (5, "x" * 300_000), (5, "x" * 300_000)])
    for labels in ([], [(1, 1)], [(5, 0), (5, 0), (9, 7), (8, None)]):
        model = T.fit(odd, spark.createDataFrame(labels, "doc_id long, label int"))
        got = T.scored(odd, model).collect()
        assert len(got) == 6 and all(0 <= r["score"] <= 1 for r in got)
        assert len({r["score"] for r in got if r["doc_id"] in (1, 2, 3)}) == 1
    assert T.scored(docs_of([]), model).collect() == []


def test_blocks_cover_every_ngram(monkeypatch):
    import landwatch.llm.ngrams as N

    text = " ".join("abc defgh i jklmnop".split() * 40)
    whole = set(np.concatenate(list(T.ngrams(text))).tolist())
    monkeypatch.setattr(N, "BLOCK", 16)
    assert set(np.concatenate(list(T.ngrams(text))).tolist()) == whole


def test_one_step_and_score_against_plain_loops():
    """The first Adam step from zero moments moves every number by its rate, along the sign of its gradient."""
    texts, labels = ["abc abd", "xyz"], np.array([0, 1])
    bags = [T.bag(t) for t in texts]

    def by_hand(text):
        grams = [("<" + w + ">", n) for w in text.split() for n in T.SIZES]
        return sum(max(0, len(w) - n + 1) for w, n in grams)

    assert [len(np.concatenate(list(T.ngrams(t)))) for t in texts] == [by_hand(t) for t in texts]
    assert all(np.isclose(w.sum(), 1) for _, w in bags)
    model = T.train(bags, labels, 0.5, epochs=40)
    for text, label in zip(texts, labels):
        at, w = T.bag(text)
        logit = model.bias + sum(float(model.value[a]) * float(x) for a, x in zip(at.tolist(), w.tolist()))
        assert np.isclose(model.score_text(text), 1 / (1 + np.exp(-logit)), atol=1e-5)
        assert (model.score_text(text) > 0.9) == bool(label)
    # A text of both words is the average of their n-grams, weighted by how many each has.
    both = "abc abd xyz"
    n = [by_hand(t) for t in texts]
    logits = [np.log(s / (1 - s)) - model.bias for s in map(model.score_text, texts)]
    mixed = model.bias + (n[0] * logits[0] + n[1] * logits[1]) / sum(n)
    assert np.isclose(model.score_text(both), 1 / (1 + np.exp(-mixed)), atol=1e-4)


def test_training_lowers_the_loss_of_a_softmax_over_averages():
    rng = random.Random(1)
    texts = [make(rng, i % 2 == 0, ["zumpfhack"]) for i in range(80)]
    labels = np.array([int(i % 2 == 0) for i in range(80)])
    bags = [T.bag(t) for t in texts]
    losses = []
    for epochs in (1, 30):
        model = T.train(bags, labels, 0.5, epochs=epochs, least_steps=0)
        p = np.array([model.score_text(t) for t in texts])
        losses.append(-np.log(np.where(labels == 1, p, 1 - p)).mean())
    assert losses[1] < 0.2 < losses[0]
