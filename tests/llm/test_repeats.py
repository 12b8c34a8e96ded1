import hashlib
import random

import pytest

from landwatch.llm.repeats import remove_repeats


def brute(rows, length=100):
    seen, out = set(), {}
    for doc, text in sorted((r for r in rows if r[0] is not None), key=lambda r: r[0]):
        raw = (text or "").encode()
        gone = [False] * len(raw)
        for p in range(len(raw) - length + 1):
            s = raw[p : p + length]
            if s in seen:
                gone[p : p + length] = [True] * length
            seen.add(s)
        kept = bytes(b for b, g in zip(raw, gone) if not g)
        spans = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        out[doc] = (len(raw), sum(gone), spans, hashlib.sha256(kept).hexdigest())
    return out


def rows_for(seed):
    rng = random.Random(seed)
    words = ["the", "of", "naïve", "über", "of the", "straße"] + ["".join(rng.choices("abcdefgh", k=rng.randint(3, 9))) for _ in range(300)]
    text = lambda n: " ".join(rng.choices(words, k=n))
    passage, line = text(40), text(9)
    rows = [(i, text(rng.randint(1, 120))) for i in range(40)]
    for i in range(40, 70):
        old = rows[rng.randrange(len(rows))][1].split(" ")
        for _ in range(rng.randint(0, 4)):
            old[rng.randrange(len(old))] = rng.choice(words)
        rows.append((i, " ".join(old)))
    rows += [(70, passage + text(20)), (71, text(3) + passage), (72, passage + passage + passage), (73, line + "\n" + line + "\n" + text(30)), (74, text(30) + line)]
    rows += [(75, "ab" * 400), (76, "a" * 1000), (77, "ab" * 300), (78, ""), (79, None), (80, "x" * 99), (81, "x" * 99), (82, "y" * 100), (83, "y" * 100)]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_equals_brute_force(spark, docs_of, seed):
    rows = rows_for(seed)
    got = {r[0]: tuple(r[1:]) for r in remove_repeats(docs_of(rows)).collect()}
    assert got == brute(rows)


def test_small_blocks_give_the_same(spark, docs_of, monkeypatch):
    """Runs split at block borders, and tasks that send their rows in small portions."""
    import landwatch.llm.repeats as m

    rows = rows_for(4)
    want = brute(rows)
    names = m.runs_of
    import numpy as np

    raw = np.frombuffer(("ab" * 700 + "hello " * 60).encode(), np.uint8)
    monkeypatch.setattr(m, "BLOCK", 128)
    whole = [tuple(int(v[i]) for v in (n[2], n[3])) for n in names(raw, 100) for i in range(len(n[0]))]
    assert sum(k for _, k in whole) == len(raw) - 99 and whole == sorted(whole)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        assert {r[0]: tuple(r[1:]) for r in remove_repeats(docs_of(rows)).collect()} == want
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_null_ids_repeated_rows_and_empty_table(spark, docs_of):
    long = "some words that repeat " * 20
    got = remove_repeats(docs_of([(None, long), (1, long), (1, long), (2, long)]), with_text=True).collect()
    by = {}
    for r in got:
        by.setdefault(r["doc_id"], set()).add((r["n_bytes"], r["n_removed"], bytes(r["kept"])))
    assert len(got) == 4 and by[None] == {(len(long), 0, long.encode())}
    assert len(by[1]) == 1 and by[2] == {(len(long), len(long), b"")}
    assert remove_repeats(docs_of([])).collect() == []
