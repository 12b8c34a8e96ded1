import math
import random
import re
from collections import Counter

from pyspark.sql import functions as F

from fleet.check import compare, duckdb_over
from fleet.registry import ORACLES, QUERIES
from landwatch.llm import quality as Q
from landwatch.llm import queries

SF = "/root/testdata/sf0.001"


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    grams = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    again = {i + d for i in range(len(words) - 2) if grams[tuple(words[i : i + 3])] > 1 for d in range(3)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(again))


def test_measures_equal_brute_force(spark, docs_of):
    rng = random.Random(2)
    rows = [(i, "".join(rng.choice(["a", "b ", "c\n", "\t", "é", "#", " x", "a b a b a "]) for _ in range(rng.randint(0, 120)))) for i in range(60)]
    rows += [(60, None), (61, ""), (62, "a a a a"), (63, "x\n\n x\nx\n"), (64, "w " * 5000), (64, "w " * 5000)]
    got = Q.measures(docs_of(rows)).collect()
    assert len(got) == len(rows)
    for r in got:
        assert tuple(r[c] for c in "n_words word_chars n_symbols n_dup_lines n_repeat_words".split()) == brute(dict(rows)[r["doc_id"]])


def test_binomial_tail(spark):
    cases = [(n, k) for n in (1, 10, 700, 5000) for k in (0, 1, 5, 60, 300) if k <= n]
    df = spark.createDataFrame(cases, "n long, k long")
    for p in (0.0125, 0.3):
        for r in df.select("n", "k", Q.binomial_tail(F.col("n"), F.col("k"), p).alias("t")).collect():
            n, k = r["n"], r["k"]
            exact = sum(math.exp(math.lgamma(n + 1) - math.lgamma(j + 1) - math.lgamma(n - j + 1) + j * math.log(p) + (n - j) * math.log(1 - p)) for j in range(k + 1))
            assert r["t"] == 1.0 if k >= n * p else math.isclose(r["t"], exact, rel_tol=1e-6, abs_tol=1e-300)


def test_only_certified_cutoffs_reject(spark, docs_of):
    good = [(i, " ".join(f"w{i}x{j}" for j in range(60)), "en") for i in range(1500)]
    noisy = [(i, " ".join(f"w{i}y{j}###" for j in range(60)), "en") for i in range(1500, 1600)]
    few = [(i, " ".join(f"w{i}z{j}###" for j in range(60)), "xx") for i in range(1600, 1620)]
    docs = docs_of(good + noisy + few)
    labels = spark.createDataFrame([(i, 1) for i in range(1500)] + [(i, 0) for i in range(1500, 1620)], "doc_id long, quality int")
    kept = {r["doc_id"] for r in Q.judge(docs, labels).where("kept").collect()}
    assert kept == set(range(1500)) | set(range(1600, 1620))  # "xx" has too few good holdouts to certify a cutoff


def test_empty_tables(spark, docs_of):
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert Q.judge(docs_of([]), none).collect() == []
    assert [r["kept"] for r in Q.judge(docs_of([(1, " ".join(f"w{j}" for j in range(60)))]), none).collect()] == [True]


def test_query_equals_sql(spark, monkeypatch):
    monkeypatch.setitem(QUERIES, "op6_quality", queries.op6_quality)
    monkeypatch.setitem(ORACLES, "op6_quality", queries.ORACLES["op6_quality"])
    ok, note = compare(spark, duckdb_over(SF), SF, "op6_quality")
    assert ok, note
