"""Wide rows are moved and taken apart no more often than the job needs."""

import glob
import hashlib
import itertools
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

import landwatch as lw
from landwatch.operators import classify, entities
from landwatch.operators.entities import entity_of_table
from landwatch.session import shared_dir
from landwatch.sources import folded
from landwatch.sources.state import _folded_events
from tests.test_compaction import now, update
from tests.test_state import event

LANDED = "connection_id string, table_schema string, table_name string, column_name string, data_type string, ordinal_position bigint, is_nullable boolean"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_compaction_moves_base_and_tail_once(spark, root):
    event(spark, root, "d1")
    update(spark, root, "d1", "2024-01-03", remediation_status="APPROVED")
    update(spark, root, "d2", "2024-01-04", approved_by="early")
    lw.compact_state(spark, root)
    base = spark.read.parquet(folded.read_pointer(spark, root, "drift").base)
    assert {"_remediation_status", "_approved_by"} <= set(base.columns) and "_rationale" not in base.columns  # nothing has set it
    event(spark, root, "d2")
    event(spark, root, "d1")
    update(spark, root, "d1", "2024-01-05", rationale="known")
    before = now(spark, root)
    assert plan(_folded_events(spark, root)).split("Initial Plan")[-1].count("hashpartitioning(drift_id") == 1
    lw.compact_state(spark, root)
    assert now(spark, root) == before == [
        ("d1", "APPROVED", None, 0.5, "2024-01-05 00:00:00"), ("d2", "PROPOSED", "early", 0.5, "2024-01-04 00:00:00")
    ]
    assert "_rationale" in spark.read.parquet(folded.read_pointer(spark, root, "drift").base).columns
    assert {r.drift_id: r.rationale for r in lw.drift_events_current(spark, root, committed_only=False).collect()}["d1"] == "known"


def test_entity_name_is_worked_out_once(spark):
    df = spark.createDataFrame([("crm_accounts",), ("12_34",), ("Companies_2024",), (None,)], "table_name string").select(entity_of_table(F.col("table_name")).alias("e"))
    assert [r.e for r in df.collect()] == ["customer", None, "company", None]
    assert df._jdf.queryExecution().optimizedPlan().toString().count("split(") == 1


def _columns(n=6):
    rows = []
    for c, t in itertools.product(range(n), ("users", "orders", "12")):
        names = ["id", f"{t}_id", "user_id", "userid", f"only_{c}", f"pair_{c // 2}"]
        rows += [(f"c{c}", "public", t, name, "INT64" if (c + k) % 3 else "STRING", k + 1, (c * k) % 2 == 0) for k, name in enumerate(names)]
    return rows


@pytest.mark.parametrize("common", [1, 4, 20_000])
def test_occurrences_whatever_is_looked_up_in_place(spark, monkeypatch, common):
    monkeypatch.setattr(entities, "COMMON_NAMES", common)
    rows = _columns()
    got = {(r.entity, r.connection_id): r for r in lw.entity_occurrences(spark.createDataFrame(rows, LANDED)).collect()}
    entity = {"users": "customer", "orders": "order"}
    seen = defaultdict(list)
    for c, _, t, name, kind, _, null in rows:
        if t in entity:
            seen[entity[t], name.replace("_", "")].append((c, kind, null))
    assert len(got) == 12
    for c, t in itertools.product(range(6), entity):
        mine = [r for r in rows if r[0] == f"c{c}" and r[2] == t]
        conflicts, shared = set(), 0
        for r in mine:
            name = r[3].replace("_", "")
            conns, kinds, nulls = (set(x) for x in zip(*seen[entity[t], name]))
            shared += len(conns) > 1
            if len(kinds) > 1:
                conflicts.add(f"{name} has types {min(kinds)} and {max(kinds)}")
            if len(nulls) > 1:
                conflicts.add(f"{name} is NOT NULL in one place and NULLABLE in another")
        r = got[entity[t], f"c{c}"]
        assert (r.n_columns, r.n_shared, r.join_key_col, r.conflicts) == (len(mine), shared, "id", sorted(conflicts))


def test_pairs_read_the_columns_once(spark, tmp_path):
    path = str(tmp_path / "landed_once")
    spark.createDataFrame(_columns(), LANDED).write.parquet(path)
    pairs = lw.entity_overlap_pairs(spark.read.parquet(path))
    assert "landed_once" not in plan(pairs)
    assert {(r.entity, r.connection_id, r.anchor_connection_id, r.n_common, r.jaccard) for r in pairs.collect() if r.connection_id in ("c0", "c1", "c3")} == {
        (e, c, a, n, round(n / (10 - n), 4)) for e in ("customer", "order") for c, a, n in (("c0", "c1", 4), ("c1", "c0", 4), ("c3", "c0", 3))
    }


def test_questions_and_replies_are_joined_by_a_short_key(spark):
    before = set(glob.glob(f"{shared_dir(spark)}/landwatch/*"))
    rows = spark.createDataFrame([(k, f"ask {k % 3}" if k else None) for k in range(7)], "k int, prompt string")
    got = lw.run_model(rows, lambda p: None if p.endswith("2") else p.upper())
    assert {r.k: r.raw for r in got.collect()} == {0: None, 1: "ASK 1", 2: None, 3: "ASK 0", 4: "ASK 1", 5: None, 6: "ASK 0"}
    new = {p.rsplit("/", 1)[-1].split("-")[0]: p for p in set(glob.glob(f"{shared_dir(spark)}/landwatch/*")) - before}
    for name, key in (("questions", "_question"), ("replies", "question")):
        stored = spark.read.parquet(new[name])
        assert {r.n for r in stored.where(f"{key} IS NOT NULL").select(F.octet_length(key).alias("n")).collect()} == {16}
        assert all(".zstd." in f for f in stored.inputFiles())


@pytest.mark.parametrize("gathered", [0, 5, 4096])
def test_consumers_are_moved_once_with_their_table(spark, monkeypatch, tmp_path, gathered):
    monkeypatch.setattr(classify, "NAMES_GATHERED", gathered, raising=False)
    before = [("c1", "p", "t", "a", "INT64", 1, True), ("c1", "p", "t", "b", "INT64", 2, True), ("c1", "p", "u", "a", "INT64", 1, True), ("c2", "p", "t", "a", "INT64", 1, True)]
    after = [("c1", "p", "t", "a", "STRING", 1, True), ("c1", "p", "t", "b", "INT64", 3, True), ("c1", "p", "u", "a", "INT64", 2, True), ("c1", "p", "v", "n", "INT64", 1, True)]
    path = str(tmp_path / "readers_once")
    rows = [("c1", "p", "t", f"j{i:02}") for i in range(25)] * 2 + [("c1", "p", "u", "only"), ("c1", "p", "u", None), ("c1", None, "u", "x"), ("c9", "p", "t", "x")]
    spark.createDataFrame(rows, "connection_id string, table_schema string, table_name string, consumer string").write.parquet(path)
    changes = lw.diff_columns(spark.createDataFrame(before, LANDED), spark.createDataFrame(after, LANDED))
    told = lw.classify_changes(changes, consumers=spark.read.parquet(path))
    got = {(r.connection_id, r.table_name, r.change_type): (r.is_collateral, r.n_consumers, r.downstream_consumers, r.ordinal_delta) for r in told.collect()}
    first = [f"j{i:02}" for i in range(20)]
    assert got == {
        ("c1", "t", "TYPE_PROMOTION"): (False, 25, first, 0), ("c1", "t", "REORDER"): (True, 25, first, 1), ("c1", "u", "REORDER"): (False, 1, ["only"], 1),
        ("c1", "v", "NEW_FIELD"): (False, 0, [], None), ("c2", "t", "DEPRECATION"): (False, 0, [], None),
    }
    if gathered == 4096:
        assert plan(told).split("Initial Plan")[-1].count("consumer:string>") == 1


@pytest.mark.parametrize("sets, tables, least", [(1, 1, 0.5), (2, 3, 0.3), (1_000, 200, 0.7)])
def test_every_similar_pair_has_a_row(spark, monkeypatch, sets, tables, least):
    monkeypatch.setattr(entities, "SETS_COMPARED", sets, raising=False)
    monkeypatch.setattr(entities, "TABLES_GATHERED", tables, raising=False)
    names = {}
    for c, (t, entity) in itertools.product(range(9), (("users", "customer"), ("accounts", "customer"), ("orders", "order"))):
        names[entity, f"c{c}", f"public.{t}"] = {f"n{(c * k + len(t)) % 7}" for k in range(1 + (c + len(t)) % 4)} | ({f"own{c}"} if c == 4 else set())
    rows = [(c, "public", t.split(".")[1], n, "STRING", 1, True) for (_, c, t), every in names.items() for n in every]
    want, linked = set(), set()

    def row(a, b):
        both = len(names[a] & names[b])
        return (*a, *b[1:], both, round(both / len(names[a] | names[b]), 4))

    for entity in ("customer", "order"):
        mine = sorted(t for t in names if t[0] == entity)
        second = next(t for t in mine if t[1] != mine[0][1])
        for t in mine:
            anchor = second if t[1] == mine[0][1] else mine[0]
            linked.add(frozenset((t, anchor)))
            want.add(row(anchor, t))
        want |= {r for a, b in itertools.combinations(mine, 2) if a[1] != b[1] and frozenset((a, b)) not in linked and (r := row(b, a))[-1] >= least}
    got = [tuple(r) for r in lw.entity_overlap_pairs(spark.createDataFrame(rows, LANDED), least).collect()]
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 27


def test_content_hash_sums_no_decimals_by_row(spark):
    rows = [("c", "public", f"t{k % 3}", f"n{k}", "INT64", k, True) for k in range(200)]
    hashed = lw.content_hash(spark.createDataFrame(rows, LANDED))
    text = lambda r: "".join(f"{len(str(p))}:{p}" for p in r[1:6])
    digests = [hashlib.md5(text(r).encode()).hexdigest() for r in rows]
    sums = [sum(int(d[at:at + 15], 16) for d in digests) for at in (0, 16)]
    want = "2:" + hashlib.sha256(f"200|{sums[0]}|{sums[1]}".encode()).hexdigest()
    assert [(r.content_hash, r.column_count) for r in hashed.collect()] == [(want, 200)]
    assert "sum(cast(conv" not in plan(hashed)
