import hashlib
import random

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import landwatch as lw
from landwatch.operators.classify import create_shim_view
from landwatch.schemas import LANDED_COLUMNS

CONN = "c1"


def col(name, kind="INT64", ordinal=1, table="customers", schema="public", nullable=True, conn=CONN):
    return (conn, schema, table, name, kind, ordinal, nullable)


def frame(spark, rows):
    return spark.createDataFrame(rows, LANDED_COLUMNS)


def diff(spark, a, b):
    rows = lw.diff_columns(frame(spark, a), frame(spark, b)).collect()
    return sorted(
        (r.change_type, r.table_name, r.before.column_name if r.before else None, r.after.column_name if r.after else None)
        for r in rows
    )


def similarity(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        new = [i + 1]
        for j, y in enumerate(b):
            new.append(min(row[j + 1] + 1, new[j] + 1, row[j] + (x != y)))
        row = new
    s, t = set(a.split("_")), set(b.split("_"))
    return round(max(1 - row[-1] / max(len(a), len(b)), len(s & t) / len(s | t)), 4)


def brute_diff(a, b):
    """The same rules over plain dicts."""
    index = lambda rows: {(r[0], r[1], r[2], r[3]): r for r in sorted(rows, key=lambda r: r[5])}
    p, c = index(a), index(b)
    out = []
    for k in p.keys() & c.keys():
        if p[k][4] != c[k][4]:
            out.append(("TYPE_PROMOTION", k[2], k[3], k[3]))
        elif p[k][5] != c[k][5]:
            out.append(("REORDER", k[2], k[3], k[3]))
    removed, added = p.keys() - c.keys(), c.keys() - p.keys()
    scored = [(r, n, similarity(r[3], n[3])) for r in removed for n in added if r[:3] == n[:3] and p[r][4] == c[n][4]]
    pairs = []
    for r, n, _ in sorted((x for x in scored if x[2] >= 0.6), key=lambda x: (-x[2], x[0][3], x[1][3])):
        if all(r != x and n != y for x, y in pairs):
            pairs.append((r, n))
    out += [("RENAME", r[2], r[3], n[3]) for r, n in pairs]
    out += [("NEW_FIELD", n[2], None, n[3]) for n in added - {n for _, n in pairs}]
    out += [("DEPRECATION", r[2], r[3], None) for r in removed - {r for r, _ in pairs}]
    return sorted(out, key=repr)


@pytest.mark.parametrize(
    "before, after, expected",
    [
        ([col("x"), col("y", ordinal=2)], [col("x"), col("y", ordinal=2)], []),
        ([col("x")], [col("x"), col("y", "STRING", 2)], [("NEW_FIELD", "customers", None, "y")]),
        ([col("x"), col("y", "STRING", 2)], [col("x")], [("DEPRECATION", "customers", "y", None)]),
        ([col("amount", "BIGNUMERIC")], [col("amount", "STRING", 9)], [("TYPE_PROMOTION", "customers", "amount", "amount")]),
        ([col("x", nullable=True)], [col("x", nullable=False)], []),
        ([col("customer_id")], [col("cust_id", ordinal=99)], [("RENAME", "customers", "customer_id", "cust_id")]),
        ([col("customer_id")], [col("cust_id", "STRING")], [("DEPRECATION", "customers", "customer_id", None), ("NEW_FIELD", "customers", None, "cust_id")]),
        ([col("x", "int64")], [col("x", "INT64")], [("TYPE_PROMOTION", "customers", "x", "x")]),
        (
            [col("gone", table="customers"), col("k", "STRING", table="orders")],
            [col("new", table="orders", ordinal=2), col("k", "STRING", table="orders")],
            [("DEPRECATION", "customers", "gone", None), ("NEW_FIELD", "orders", None, "new")],
        ),
    ],
)
def test_diff_cases(spark, before, after, expected):
    assert diff(spark, before, after) == expected


def test_each_column_is_in_one_change_and_unrelated_ones_are_no_rename(spark):
    a = [col("customer_id"), col("user_id", ordinal=2), col("ssn", "STRING", 3)]
    b = [col("customer_ids"), col("users_id", ordinal=2), col("free_text_note", "STRING", 3)]
    assert diff(spark, a, b) == sorted(
        [("RENAME", "customers", "customer_id", "customer_ids"), ("RENAME", "customers", "user_id", "users_id"),
         ("DEPRECATION", "customers", "ssn", None), ("NEW_FIELD", "customers", None, "free_text_note")], key=lambda r: (r[0], r[1], r[2] or "")
    )
    rows = lw.classify_changes(lw.diff_columns(frame(spark, a), frame(spark, b))).collect()
    assert not [r for r in rows if "free_text_note AS ssn" in r.remediation_sql]


def test_promotion_with_collateral_reorders(spark):
    a = [col("amount", "BIGNUMERIC", 1, "orders"), col("status", "STRING", 2, "orders"), col("order_id", "INT64", 3, "orders")]
    b = [col("amount", "STRING", 1, "orders"), col("order_id", "INT64", 2, "orders"), col("status", "STRING", 3, "orders")]
    rows = lw.classify_changes(lw.diff_columns(frame(spark, a), frame(spark, b))).collect()
    kinds = {(r.change_type, r.is_collateral, r.classification_conf, r.ordinal_delta) for r in rows}
    assert kinds == {("TYPE_PROMOTION", False, 1.0, 0), ("REORDER", True, 0.3, 1), ("REORDER", True, 0.3, -1)}


def test_repeated_name_takes_the_last_ordinal(spark):
    assert diff(spark, [col("x", "INT64", 1), col("x", "STRING", 2)], [col("x", "STRING", 2)]) == []


column_rows = st.lists(
    st.tuples(st.sampled_from(["id_a", "id_b", "user_id", "user_ids", "x", "zz"]), st.sampled_from(["INT64", "STRING"]), st.integers(1, 4), st.sampled_from(["t", "u"])),
    max_size=10,
    unique_by=lambda r: (r[0], r[3]),
)


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(column_rows, column_rows)
def test_diff_equals_brute_force(spark, a, b):
    left = [col(n, k, o, t) for n, k, o, t in a]
    right = [col(n, k, o, t) for n, k, o, t in b]
    assert sorted(diff(spark, left, right), key=repr) == brute_diff(left, right)


def test_wide_rebuild_stays_linear_and_does_not_depend_on_the_split(spark):
    """A table with 400 removed and 350 added columns of one type, split over many shards."""
    a = [col(f"old_{i}", ordinal=i + 1) for i in range(400)]
    b = [col(f"older_{i}", ordinal=i + 1) for i in range(350)]
    matched = lw.changed_columns(frame(spark, a), frame(spark, b))
    got = [{(r.before.column_name, r.after.column_name) for r in lw.diff_rename_candidates(matched, pairs_per_task=n).collect()} for n in (1000, 10**9)]
    assert got[0] == got[1] and 0 < len(got[0]) <= 350
    assert lw.diff_columns(frame(spark, a), frame(spark, b)).count() == 750 - len(got[0])


def test_a_column_whose_first_choice_is_taken_gets_the_next(spark):
    a = [col("order_total"), col("order_totals", ordinal=2)]
    b = [col("order_total1"), col("order_totl_sum", ordinal=2)]
    assert [r[0] for r in diff(spark, a, b)] == ["RENAME", "RENAME"]


names = st.lists(st.text(alphabet="ab_1X", max_size=7), max_size=9, unique=True)


@settings(max_examples=10, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(names, names)
def test_rare_keys_lose_no_pair(spark, a, b):
    """Names that share bigrams and tokens many times, by the way of large groups, against all comparisons."""
    matched = lw.changed_columns(frame(spark, [col(n, ordinal=1) for n in a]), frame(spark, [col(n, ordinal=1) for n in b]))
    got = [sorted((r.before.column_name, r.after.column_name) for r in lw.diff_rename_candidates(matched, pairs_per_task=n).collect()) for n in (0, 10**9)]
    assert got[0] == got[1]


@pytest.mark.parametrize("threshold", [0.3, 0.5, 0.75])
def test_other_thresholds(spark, threshold):
    rng = random.Random(8)
    word = lambda: "_".join(rng.choice(["user", "usr", "id", "ids", "total", "x1"]) for _ in range(rng.randint(1, 3)))
    a, b = sorted({word() for _ in range(14)}), sorted({word() + "s" for _ in range(14)})
    matched = lw.changed_columns(frame(spark, [col(n, ordinal=1) for n in a]), frame(spark, [col(n, ordinal=1) for n in b]))
    got = [sorted((r.before.column_name, r.after.column_name) for r in lw.diff_rename_candidates(matched, threshold=threshold, pairs_per_task=n).collect()) for n in (0, 10**9)]
    assert got[0] == got[1]


def test_ten_thousand_renamed_columns(spark):
    """10,000 removed and 10,000 added columns of one type: few of the 100 million pairs are compared."""
    from landwatch.operators.drift import _paired, _sides, rename_comparisons

    rng = random.Random(11)
    syllables = [x + y for x in "bcdfghklmnprstvw" for y in "aeiou"]
    word = lambda: "".join(rng.choice(syllables) for _ in range(rng.randint(2, 4)))
    stems = sorted({f"{word()}_{word()}_{word()}" for _ in range(10_500)})[:10_000]
    a = [col(n, ordinal=i) for i, n in enumerate(stems)]
    b = [col(n[:-1] + "q7" if i % 2 else f"{n}_v2", ordinal=i) for i, n in enumerate(stems)]
    matched = lw.changed_columns(frame(spark, a), frame(spark, b))
    lone, group = _paired(matched, ("connection_id",))
    removed, added = _sides(lone, group)
    assert rename_comparisons(removed, added, group, 0.9).count() < 400_000
    renames = {(r.before.column_name, r.after.column_name) for r in lw.diff_rename_candidates(matched).collect()}
    assert len(renames) == 10_000 and sum(y in (x[:-1] + "q7", f"{x}_v2") for x, y in renames) > 9_900


def reference_hash(rows):
    digests = [hashlib.md5("".join(f"{len(str(x))}:{x}" for x in r[1:6]).encode()).hexdigest() for r in rows]
    sums = [sum(int(d[at : at + 15], 16) for d in digests) for at in (0, 16)]
    return "2:" + hashlib.sha256("|".join(map(str, (len(rows), *sums))).encode()).hexdigest()


@pytest.mark.parametrize("names", [["b", "a"], ["naïve", "日本"], ["it's \"both\"", "tab\there"], ["a b", "a"], [f"c{i}" for i in range(3000)]])
def test_content_hash_is_one_digest_at_every_size(spark, names):
    rows = [col(n, ordinal=i + 1) for i, n in enumerate(names)]
    got = lw.content_hash(frame(spark, rows)).collect()[0]
    assert (got.content_hash, got.column_count) == (reference_hash(rows), len(rows))


def test_content_hash_ignores_order_and_nullability_and_sees_the_rest(spark):
    rows = [col(f"c{i}", ordinal=i) for i in range(20)]
    shuffled = [r[:6] + (not r[6],) for r in random.Random(1).sample(rows, len(rows))]
    changed = rows[:-1] + [col("c19", "STRING", 19)]
    twice = rows + rows[:1]
    h = [lw.content_hash(frame(spark, x)).collect()[0].content_hash for x in (rows, shuffled, changed, twice)]
    assert h[0] == h[1] and len(set(h)) == 3


def test_hash_gate_states(spark):
    current = spark.createDataFrame([("a", "h1", 1), ("b", "h2", 1), ("c", "h3", 1)], "connection_id string, content_hash string, column_count long")
    latest = spark.createDataFrame([("a", "s1", "h1"), ("b", "s2", "old")], "connection_id string, snapshot_id string, content_hash string").withColumn("captured_at", F.lit("2024-01-01").cast("timestamp"))
    assert {r.connection_id: r.gate_state for r in lw.hash_gate(current, latest).collect()} == {"a": "UNCHANGED", "b": "CHANGED", "c": "BOOTSTRAP"}


def test_system_columns_by_affix_only(spark):
    names = ["_sys_synced", "_sys_deleted", "ctid_sys_id", "_sys_id", "my_sys_metric", "sys_score"]
    kept = lw.exclude_system_columns(frame(spark, [col(n) for n in names]), "_sys_", "_sys_id")
    assert {r.column_name for r in kept.collect()} == {"my_sys_metric", "sys_score"}


def test_rename_rank_prefers_related_names(spark):
    a, b = [col("customer_id")], [col("cust_id"), col("zzz", ordinal=2)]
    pairs = lw.diff_rename_candidates(lw.changed_columns(frame(spark, a), frame(spark, b)), threshold=0.0)
    own = pairs.unionByName(pairs.withColumn("after", F.col("after").withField("column_name", F.lit("zzz"))))
    assert {r.after.column_name: r.rename_rank for r in lw.rank_rename_candidates(own).collect()} == {"cust_id": 1, "zzz": 2}


def test_apply_shim(spark):
    df = spark.createDataFrame([("12", 3.5), ("x", None)], "amount string, cust_id double")
    changes = [
        {"change_type": "TYPE_PROMOTION", "new_name": "amount", "old_type": "INT64"},
        {"change_type": "RENAME", "old_name": "customer_id", "new_name": "cust_id"},
        {"change_type": "DEPRECATION", "old_name": "gone", "old_type": "NUMERIC(10,2)"},
        {"change_type": "TYPE_PROMOTION", "new_name": "cust_id", "old_type": "GEOGRAPHY"},
        {"change_type": "REORDER", "new_name": "amount"},
    ]
    out = lw.apply_shim(df, changes)
    assert out.columns == ["amount", "cust_id", "amount_legacy", "customer_id", "gone"]
    assert [tuple(r) for r in out.collect()] == [("12", 3.5, 12, 3.5, None), ("x", None, None, None, None)]
    assert dict(out.dtypes)["gone"] == "decimal(10,2)"
    assert spark.table(create_shim_view(df, "orders", changes)).count() == 2
    with pytest.raises(ValueError):
        lw.apply_shim(df, [{"change_type": "DEPRECATION", "old_name": "amount", "old_type": "STRING"}])


def test_snapshot_pairs_across_days_and_ties(spark):
    rows = [("a", "s3", "2024-01-03 01:00"), ("a", "s1", "2024-01-01 01:00"), ("a", "s2", "2024-01-01 02:00"), ("a", "s2b", "2024-01-01 02:00"), ("b", "t1", "2024-01-01 00:00")]
    snapshots = spark.createDataFrame(rows, "connection_id string, snapshot_id string, at string").withColumn("captured_at", F.col("at").cast("timestamp"))
    got = {(r.from_snapshot_id, r.to_snapshot_id) for r in lw.snapshot_pairs(snapshots).collect()}
    assert got == {("s1", "s2"), ("s2", "s2b"), ("s2b", "s3")}


def test_autonomy_levels(spark):
    events = spark.createDataFrame([("NEW_FIELD", 1.0), ("RENAME", 0.9), ("RENAME", 0.2), ("NEW_FIELD", None)], "change_type string, classification_conf double")
    got = {level: [r.auto_apply for r in lw.autonomy_filter(events, level).collect()] for level in ("STRICT", "TRUSTED_ADDITIVE", "FULL_AUTO")}
    assert got == {"STRICT": [False] * 4, "TRUSTED_ADDITIVE": [True, False, False, False], "FULL_AUTO": [True, True, False, False]}
    with pytest.raises(ValueError):
        lw.autonomy_filter(events, "YOLO")
