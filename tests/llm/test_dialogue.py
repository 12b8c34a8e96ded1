import hashlib
import heapq
import random
import re
import zlib
from collections import defaultdict

import duckdb
import numpy as np
import pytest

from landwatch.llm import dialogue as D
from landwatch.llm import queries

COLUMNS = "conv_id gaps blank duplicate truncated illegal cost audit repaired_sha256".split()


def damaged(rows):
    out = defaultdict(list)
    for conv, turn, role, text in rows:
        mine = out[conv]
        role, text = " " if role is None else role, " " if text is None else text
        h = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if h == 0:
            continue
        text = "" if h == 1 else re.sub("[.!?]", "", text) if h == 2 else text
        mine += [(turn, "user" if h == 4 else role, text)] * (2 if h == 3 else 1)
    return out


def repaired(rows):
    """Cheapest edits by Dijkstra's search from the end."""
    faults, seen = [], set()
    for _, role, text in rows:
        visible = re.findall(r"[^\x20\x09-\x0D]", text)
        faults.append("blank" if not visible else "duplicate" if (role, text) in seen else "" if visible[-1] in ".!?" else "truncated")
        seen.add((role, text))
    # The costs are settled first, then the least letter of a cheapest path is followed.
    least = {}
    queue = [(0, len(rows), s) for s in ("", "a")]
    after = {"": "su", "s": "u", "u": "a", "a": "u"}
    while queue:
        cost, i, s = heapq.heappop(queue)
        if (i, s) in least:
            continue
        least[i, s] = cost
        for before in ("", "s", "u", "a"):
            if s and s in after[before]:
                if s in "ua":
                    heapq.heappush(queue, (cost + 3, i, before))
                if i and faults[i - 1] not in ("blank", "duplicate"):
                    more = 3 * (faults[i - 1] == "truncated")
                    if rows[i - 1][1][:1] == s:
                        heapq.heappush(queue, (cost + more, i - 1, before))
                    if s in "ua":
                        heapq.heappush(queue, (cost + 3 + more, i - 1, before))
        if i:
            heapq.heappush(queue, (cost + 4, i - 1, s))
    i, s, audit, lines = 0, "", "", []
    while (i, s) not in ((len(rows), ""), (len(rows), "a")) or least[i, s]:
        here, found = least[i, s], []
        for t in after[s]:
            name = {"u": "user", "a": "assistant"}.get(t)
            if name and least.get((i, t), 1e9) + 3 == here:
                found.append(("I", i, t, name + ":"))
            if i < len(rows) and faults[i] not in ("blank", "duplicate"):
                more = 3 * (faults[i] == "truncated")
                if rows[i][1][:1] == t and least.get((i + 1, t), 1e9) + more == here:
                    found.append(("K", i + 1, t, f"{rows[i][1]}:{rows[i][2]}"))
                if name and least.get((i + 1, t), 1e9) + 3 + more == here:
                    found.append(("R", i + 1, t, f"{name}:{rows[i][2]}"))
        if i < len(rows) and least.get((i + 1, s), 1e9) + 4 == here:
            found.append(("D", i + 1, s, None))
        letter, i, s, line = min(found)
        audit += letter
        lines += [line] if line is not None else []
    return faults, least[0, ""], audit, lines


def expected(given):
    out = []
    for conv, rows in damaged(given).items():
        rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, hashlib.sha256(f"{len(r[1])}:{r[1]}{r[2]}".encode()).digest()))
        turns = [t for t, _, _ in rows if t is not None]
        faults, cost, audit, lines = repaired(rows)
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        out.append((conv, gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit,
                    hashlib.sha256("\n".join(lines).encode()).hexdigest()))
    return out


def run(spark, given, block_rows=D.BLOCK_ROWS):
    table = spark.createDataFrame([(*r, "x", 1) for r in given], "conv_id long, turn long, role string, text string, kind string, block int")
    return D.digest(*D.repair(D.damage(table), table.select("conv_id"), block_rows))


def conversations(seed):
    rng = random.Random(seed)
    roles = ["user", "assistant", "system", "user", "assistant", "tool", "", None, "User", "unknown", "agent"]
    texts = ["Hi.", "Yes!", "what", "  ", None, "Really? \n", "a.b", "né!", ". \t", "x" * 3000 + "."]
    out = []
    for conv in [*range(60), None]:
        for turn in range(rng.choice([1, 2, 3, 5, 9])):
            out.append((conv, rng.choice([turn, turn, turn, turn + 3, None, 0]), rng.choice(roles), rng.choice(texts)))
    return out + out[:7]


@pytest.mark.parametrize("seed", range(2))
def test_against_brute_force(spark, seed):
    given = conversations(seed)
    got = run(spark, given)
    assert got.columns == COLUMNS
    assert sorted(map(tuple, got.collect()), key=str) == sorted(expected(given), key=str)


def test_long_conversation_in_many_blocks(spark):
    rng = random.Random(9)
    given = [(1, t, rng.choice(["user", "assistant", "system", "tool"]), rng.choice(["a.", "b.", "c", f"{t}.", f"{t}", " "])) for t in range(700)]
    given += [(k, t, "user", "a.") for k in (0, 2) for t in range(3)]
    want = sorted(expected(given), key=str)
    assert sorted(map(tuple, run(spark, given, 5).collect()), key=str) == want
    assert sorted(map(tuple, run(spark, given).collect()), key=str) == want


def test_conversations_without_rows_and_empty_table(spark):
    gone = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    empty = hashlib.sha256(b"").hexdigest()
    assert [tuple(r) for r in run(spark, [(gone, 0, "user", "Hi.")]).collect()] == [(gone, 0, 0, 0, 0, 0, 0, "", empty)]
    none = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert D.digest(*D.repair(D.damage(none), none.select("conv_id"))).collect() == []


def test_sql_agrees(spark):
    got = queries.QUERIES["op11_conversations"](spark, "/root/testdata/sf0.01")
    con = duckdb.connect()
    con.execute("CREATE VIEW conversations AS SELECT * FROM '/root/testdata/sf0.01/conversations.parquet'")
    want = con.sql(queries.ORACLES["op11_conversations"])
    assert want.columns == got.columns
    assert sorted(map(tuple, got.collect())) == sorted(want.fetchall())


def test_repaired_rows_alternate(spark):
    given = conversations(5)
    table = spark.createDataFrame(given, "conv_id long, turn long, role string, text string")
    edited, _ = D.repair(D.damage(table), table.select("conv_id"), 4)
    found = defaultdict(str)
    for r in edited.orderBy("conv_id", "block").collect():
        found[r["conv_id"]] += "".join(x[0] for x in r["roles"])
        assert len(r["audit"].replace("D", "")) == len(r["roles"]) == len(r["texts"])
    assert all(re.fullmatch("(s?(ua)+)?", x) for x in found.values())


def test_ranks_order_whole_audits():
    """Ranks by doubling agree with comparing the audits themselves, at every node."""
    rng = np.random.default_rng(4)
    kinds = [np.append(rng.integers(0, 16, rng.integers(0, 40)), D.END) for _ in range(30)]
    paths = D.Paths(kinds, np.zeros((30, 4), np.int64))
    found = []
    for b, k in enumerate(kinds):
        exits, audits = paths.of(b, [0, 1, 2, 3])
        found += [(a, paths.rank[paths.base[b] + s]) for s, a in enumerate(audits) if a is not None]
    # A closed block ends with END, whose letter is empty, so equal audits may differ by it only.
    for (a, x) in found:
        for (b, y) in found:
            assert (x < y) == (a < b) or a == b
