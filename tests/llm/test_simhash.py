import random
import re

import numpy as np
import xxhash

from landwatch.llm import simhash as S
from landwatch.llm.components import components


def brute_print(text, k=3):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))]
    hs = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def brute_components(ids, linked):
    name = {i: i for i in ids}
    change = True
    while change:
        change = False
        for a in ids:
            for b in ids:
                if linked(a, b) and name[a] != name[b]:
                    name[a] = name[b] = min(name[a], name[b])
                    change = True
    return name


def test_groups_equal_brute_force(spark, docs_of):
    rng = random.Random(5)
    words = ["".join(rng.choices("abcdef", k=5)) for _ in range(400)]
    rows = [(i, " ".join(rng.choices(words, k=rng.randint(1, 400)))) for i in range(60)]
    for i in range(60, 150):
        t = rows[rng.randrange(60)][1].split(" ")
        for _ in range(rng.randint(0, 3)):
            t[rng.randrange(len(t))] = rng.choice(words)
        rows.append((i, " ".join(t)))
    rows += [(150, None), (151, ""), (152, " \n\t"), (153, "One Word"), (154, "one word"), (155, "Ünï ü"), (156, " x  ")]
    prints = {i: brute_print(t) for i, t in rows}
    want = brute_components(list(prints), lambda a, b: bin(prints[a] ^ prints[b]).count("1") <= 3)
    got = S.simhash_groups(docs_of(rows)).collect()
    assert {r["doc_id"]: r["fingerprint"] for r in got} == {i: f"{p:016x}" for i, p in prints.items()}
    assert {r["doc_id"]: r["component_id"] for r in got} == want
    assert len(set(want.values())) < len(rows)


def test_no_pair_is_lost_at_any_number_of_levels(spark):
    rng = np.random.default_rng(3)
    base = rng.integers(0, 1 << 63, 300, dtype=np.uint64)
    near = base.copy()
    for k in range(len(near)):
        for bit in rng.choice(64, rng.integers(0, 4), replace=False):
            near[k] ^= np.uint64(1) << np.uint64(bit)
    for levels in (1, 3, 8):
        for shift in (0, 32):
            a, b = (x >> np.uint64(shift) & np.uint64(0xFFFFFFFF) for x in (base, near))
            met = S.leaf_keys(a, levels) == S.leaf_keys(b, levels)
            for half, other in ((a, b), (b, a)):
                row, leaf = S.visits(half, levels)
                own = S.leaf_keys(other, levels)
                met |= np.bincount(row, leaf == own[row], len(a)) > 0
            close = np.bitwise_count(a ^ b) <= 1
            assert met[close].all()


def test_components_of_paths_and_stars(spark):
    rng = random.Random(1)
    pairs = [(i, i + 1) for i in range(100, 180)] + [(1, x) for x in range(200, 260)] + [(5, 5), (None, 3), (7, 8), (7, 8)]
    rng.shuffle(pairs)
    got = {r["id"]: r["component"] for r in components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == {**{i: 100 for i in range(101, 181)}, **{x: 1 for x in range(200, 260)}, 8: 7}


def test_empty_table_null_ids_and_repeated_rows(spark, docs_of):
    assert S.simhash_groups(docs_of([])).collect() == []
    got = S.simhash_groups(docs_of([(None, "a b c"), (4, "a b c"), (4, "a b c"), (2, "A B C")])).collect()
    assert len(got) == 4 and {r["component_id"] for r in got} == {2}


def shingle_set(text, k=5):
    words = text.split()
    return {tuple(words[i : i + k]) for i in range(max(1, len(words) - k + 1))}


def similar_at(texts, similarity=0.8):
    sets = {i: shingle_set(t) for i, t in texts}
    return {(a, b) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) >= similarity * len(sets[a] | sets[b])}


def kept_by_brute_force(texts):
    pairs = similar_at(texts)
    name = brute_components([i for i, _ in texts], lambda a, b: (min(a, b), max(a, b)) in pairs)
    return {i for i, c in name.items() if i == c}


def test_appended_and_removed_blocks_are_found(spark, docs_of, monkeypatch):
    """Copies with one new or missing block, at 0.80 to 0.85: the fingerprints are some ten bits apart.

    Trees, if any, are as deep as over millions of texts.
    """
    monkeypatch.setattr(S, "LEAF", 0.05)
    rng = random.Random(8)
    vocabulary = ["".join(rng.choices("abcdefghij", k=6)) for _ in range(5000)]
    texts = []
    for i in range(0, 240, 2):
        words = rng.choices(vocabulary, k=rng.randint(60, 300))
        n = len(words) - 4
        if i % 4:
            other = words + rng.choices(vocabulary, k=int(n * rng.uniform(0.18, 0.25)))
        else:
            other = words[: len(words) - int(n * rng.uniform(0.15, 0.2))]
        texts += [(i, " ".join(words)), (i + 1, " ".join(other))]
    assert len(similar_at(texts)) >= 110 and not similar_at(texts, 0.86)
    assert {r["doc_id"] for r in S.drop_similar(docs_of(texts)).collect()} == kept_by_brute_force(texts)


def around_the_threshold(seed=4, templates=24):
    """Groups of edited copies, half of whose pairs are just above and half just below 0.8."""
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choices("abcdefghij", k=6)) for _ in range(5000)]
    texts = []
    for _ in range(templates):
        words = rng.choices(vocabulary, k=rng.randint(80, 250))
        for _ in range(10):
            copy = list(words)
            for at in rng.sample(range(5, len(copy) - 5), max(1, round(len(copy) / 90 * rng.uniform(0.6, 1.5)))):
                copy[at] = rng.choice(vocabulary)
            texts.append((len(texts), " ".join(copy)))
    return texts


def test_links_below_the_threshold_hide_no_link_above_it(spark, docs_of):
    """A text close to two others by fingerprint, but similar to neither, must not stand for the link between them."""
    texts = around_the_threshold()
    assert {r["doc_id"] for r in S.drop_similar(docs_of(texts)).collect()} == kept_by_brute_force(texts)


def test_similar_texts_go_through_the_trees(spark, docs_of, monkeypatch):
    """The trees' links are tried first and leave only what fingerprints cannot find to the exact search."""
    rng = random.Random(6)
    vocabulary = ["".join(rng.choices("abcdefghij", k=6)) for _ in range(3000)]
    texts = []
    for i in range(0, 60, 3):
        words = rng.choices(vocabulary, k=1200)
        far = words + rng.choices(vocabulary, k=270)  # still similar, but many bits away
        near = [*words[:600], rng.choice(vocabulary), *words[601:]]
        texts += [(i, " ".join(words)), (i + 1, " ".join(near)), (i + 2, " ".join(far))]
    prints = {i: brute_print(t, 5) for i, t in texts}
    near = {(a, b) for a in prints for b in prints if a < b and bin(prints[a] ^ prints[b]).count("1") <= 3}
    tried = {}
    whole = S.similar_pairs

    def seen(edges, *rest):
        tried.setdefault("first", {(r["b"], r["a"]) for r in edges.select("a", "b").collect()})
        return whole(edges, *rest)

    monkeypatch.setattr(S, "similar_pairs", seen)
    kept = {r["doc_id"] for r in S.drop_similar(docs_of(texts)).collect()}
    assert len(near) >= 15 and tried["first"] and tried["first"] <= near
    assert brute_components(list(prints), lambda a, b: (min(a, b), max(a, b)) in tried["first"]) == brute_components(list(prints), lambda a, b: (min(a, b), max(a, b)) in near)
    assert kept == kept_by_brute_force(texts) == {i for i, _ in texts if i % 3 == 0}
