import zlib

import numpy as np
import pytest

import __spark_entry__ as entry
import corpus_pipeline as C
from landwatch.llm import queries, simhash

SF = "/root/testdata/sf0.001"


def shingles(text, k=5):
    words = simhash.words_of(text)
    return {tuple(words[i : i + k]) for i in range(max(1, len(words) - k + 1))} if words else set()


def test_every_operator_is_registered():
    assert {q.split("_")[0] for q in entry.queries() if q.startswith("op")} == {f"op{n}" for n in range(1, 14)}
    assert entry.queries()["pipeline"] is C.run and set(queries.ORACLES) <= set(queries.QUERIES)


def test_similar_texts_keep_one_of_each_group(spark, docs_of):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    texts = {r["doc_id"]: shingles(r["text"]) for r in docs.collect()}
    name = {i: i for i in texts}
    ids = sorted(i for i in texts if texts[i])
    close = [(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if len(texts[a] & texts[b]) >= 0.8 * len(texts[a] | texts[b])]
    for _ in ids:
        for a, b in close:
            name[a] = name[b] = min(name[a], name[b])
    kept = {r["doc_id"] for r in C.drop_near_duplicates(spark, docs, SF).collect()}
    assert kept == {i for i in name if name[i] == i}


def test_similar_texts_of_odd_rows(spark, docs_of):
    text = " ".join(f"w{i}" for i in range(40))
    rows = [(None, text), (None, text), (3, text), (3, text), (4, text.upper()), (5, None), (6, ""), (7, " "), (8, "a b"), (9, "A  b")]
    out = simhash.drop_similar(docs_of(rows))
    assert sorted((r["doc_id"] for r in out.collect()), key=str) == sorted([None, None, 3, 3, 5, 6, 7, 8], key=str)
    assert out.columns == docs_of([]).columns and simhash.drop_similar(docs_of([])).collect() == []


def test_stages_take_effect(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, n = docs.columns, docs.count()
    for name, step in C.STAGES[:-1]:
        docs = C.stage(step(spark, docs, SF), f"test-{name}")
        assert docs.columns == columns and 0 < docs.count()
        assert name == "mixing" or docs.count() <= n
    words = {}
    for r in docs.collect():
        words[r["doc_id"]] = words.get(r["doc_id"], 0) + len((r["text"] or "").encode().split())
    packed = C.STAGES[-1][1](spark, docs, SF).groupBy("doc_id").sum("n_tokens").collect()
    assert {r[0]: r[1] for r in packed} == words


def test_mixing_learns_only_domains_of_its_input(spark, monkeypatch):
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("doc_id % 2 = 0")
    seen = []
    monkeypatch.setattr(C.mixing, "mix", lambda docs, labels, domain, targets: seen.append((labels.collect(), targets)))
    C.mix_domains(spark, docs, SF)
    (labels, targets), = seen
    assert set(targets) == {"clean", "noisy"} == {r["domain"] for r in labels}
    assert all(r["doc_id"] % 2 == 0 for r in labels)


@pytest.mark.parametrize("name", ["op1_toxicity", "op2_language"])
def test_held_out_rows(spark, name):
    divisor, left = (4, 2) if name == "op1_toxicity" else (3, 1)
    got = queries.QUERIES[name](spark, SF).collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % divisor == left) for r in got)
    assert np.isfinite([r["score"] for r in got]).all()
