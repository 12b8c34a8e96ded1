"""Repair of conversations by cost, with the least audit trail found by prefix doubling.

Rows are edited into ``(s?(ua)+)?`` by role initials: Keep 0, Rerole to user or assistant 3, Delete 4
(the only choice for blank and duplicate rows), Insert an empty user or assistant row 3, and 3 more
for a truncated row that is not deleted. A state says what was read last: nothing, s, u or a.

Conversations are sorted by range and cut into blocks of a bounded number of rows, so that one with
most rows is worked on by many tasks. A block is a table of costs from state to state; chaining the
tables backwards gives the cost to go at the end of every block. Inside a block the arcs that are on
cheapest paths then form a graph in which each letter of the audit leads to one node. Its nodes are
ranked by the audits of 1, 2, 4, ... letters: the rank of twice the length is that of the pair (own
rank, rank of the node that many letters on), and the pointers double with it. The doubled pointers
also list the least path from each state. Chaining the blocks forwards tells which state it starts in.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from landwatch.llm.common import stage

#: Rows and characters after which a block is cut.
BLOCK_ROWS, BLOCK_CHARS = 4096, 4_000_000
BLANKS = " \t\n\x0b\x0c\r"
INITIALS = "sua"
#: Kind of a step: initial (3: any other) and 4 times the fault (0 none, 1 blank, 2 duplicate, 3 truncated); END closes a conversation.
BLANK, DUPLICATE, TRUNCATED, END = 1, 2, 3, 16
REROLE, DELETE, INSERT, UNFINISHED = 3, 4, 3, 3
FAR = 1 << 60
#: State after reading an initial (-1: not allowed): states 0 nothing, 1 s, 2 u, 3 a.
AFTER = np.array([[1, 2, -1, -1], [-1, 2, -1, -1], [-1, -1, 3, -1], [-1, 2, -1, -1]])
#: The user or assistant row that may follow, as the state it leads to.
NEXT = np.array([2, 2, 3, 2])
ROLE_OF_STATE = {2: "user", 3: "assistant"}
LEGAL = {(0, 1), (1, 2), (2, 1)}
LETTERS = np.frombuffer(b"\0DIKR", np.uint8)
NONE, D, I, K, R = range(5)


def damage(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text with faults planted by crc32(``conv_id:turn``) % 20; NULLs are written as one blank.

    0 drops a row, 1 empties its text, 2 removes its sentence ends, 3 repeats it, 4 makes it the user's.
    """
    written = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    fault = F.crc32(F.concat(written("conv_id"), F.lit(":"), written("turn"))) % 20
    text = F.when(F.col("_fault") == 1, "").when(F.col("_fault") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    return (
        conversations.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), written("role").alias("role"), written("text").alias("text"), fault.alias("_fault"))
        .where("_fault != 0")
        .select("conv_id", "turn", F.when(F.col("_fault") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"),
                F.explode(F.array_repeat(F.lit(0), F.when(F.col("_fault") == 3, 2).otherwise(1))).alias("_copy"))
        .drop("_copy")
    )


def kind(first: Column) -> Column:
    """Kind of a row's step, its first fault counting; ``first``: no earlier row has its role and text."""
    initial = F.substring("role", 1, 1)
    code = sum((F.when(initial == x, k).otherwise(0) for k, x in enumerate(INITIALS)), F.lit(0)) + F.when(initial.isin(*INITIALS), 0).otherwise(len(INITIALS))
    seen = F.rtrim(F.col("text"), F.lit(BLANKS))
    fault = F.when(seen == "", BLANK).when(~first, DUPLICATE).when(F.substring(seen, -1, 1).isin(".", "!", "?"), 0).otherwise(TRUNCATED)
    return (code + 4 * fault).cast("int")


def ordered(rows: DataFrame, conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, kind sorted over all partitions; each conversation is closed by a row of kind ``END``.

    Rows are told apart by a number given when they are stored. The first row of each role and text
    comes from an aggregate, and its mark is joined back by that number, so no key is hot in a join.
    """
    digest = F.unhex(F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"), 256))
    stored = stage(rows.select("conv_id", "turn", "role", "text", digest.alias("digest"), F.monotonically_increasing_id().alias("nth")), "turns")
    place = F.struct(F.col("turn").isNotNull().alias("known"), "turn", "nth")
    firsts = stored.groupBy("conv_id", "digest").agg(F.min(place).alias("place")).select(F.col("place.nth").alias("nth"), F.lit(True).alias("first"))
    marked = stored.join(firsts, "nth", "left")
    steps = marked.select("conv_id", F.lit(False).alias("last"), "turn", "digest", "nth", "role", "text", kind(F.coalesce("first", F.lit(False))).alias("kind"))
    none = lambda kind, name: F.lit(None).cast(kind).alias(name)
    ends = conversations.select(F.col("conv_id").cast("long")).distinct().select(
        "conv_id", F.lit(True).alias("last"), none("long", "turn"), none("binary", "digest"), none("long", "nth"), none("string", "role"), none("string", "text"),
        F.lit(END).alias("kind"),
    )
    keys = [F.col("conv_id").asc_nulls_first(), "last", F.col("turn").asc_nulls_first(), "digest", "nth"]
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    both = stage(steps.unionByName(ends), "steps")
    return both.repartitionByRange(n, *keys).sortWithinPartitions(*keys).select("conv_id", "turn", "role", "text", "kind")


BLOCKS = ("conv_id long, block long, kinds binary, first_turn long, last_turn long, n_turns long, blank long, duplicate long, "
          "truncated long, illegal long, costs array<long>, roles array<string>, texts array<string>")


def arrow_schema(ddl: str) -> pa.Schema:
    types = {"long": pa.int64(), "int": pa.int32(), "boolean": pa.bool_(), "string": pa.string(), "binary": pa.binary()}
    fields = []
    for field in ddl.split(", "):
        name, kind = field.split(" ")
        fields.append((name, pa.list_(types[kind[6:-1]]) if kind.startswith("array") else types[kind]))
    return pa.schema(fields)


def batch_of(rows: list[tuple], ddl: str) -> pa.RecordBatch:
    schema = arrow_schema(ddl)
    columns = list(zip(*rows)) if rows else [()] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)


def open_up(v: np.ndarray) -> np.ndarray:
    """Costs to go of the states where rows may be inserted first; states are on the second axis."""
    out = v.copy()
    out[:, 2] = np.minimum(v[:, 2], v[:, 3] + INSERT)
    out[:, 3] = np.minimum(v[:, 3], v[:, 2] + INSERT)
    out[:, :2] = np.minimum(v[:, :2], out[:, 2:3] + INSERT)
    return out


def row_costs() -> np.ndarray:
    """[kind, letter, state]: cost of each edit of a row, ``FAR`` where it isn't allowed; END reads nothing after a or nothing."""
    out = np.full((END + 1, 5, 4), FAR, np.int64)
    for k in range(END):
        fault = k // 4
        out[k, D] = DELETE
        if fault not in (BLANK, DUPLICATE):
            more = UNFINISHED if fault == TRUNCATED else 0
            out[k, K] = np.where(AFTER[:, k % 4] >= 0, more, FAR)
            out[k, R] = REROLE + more
    out[END, NONE] = [0, FAR, FAR, 0]
    return out


def row_targets() -> np.ndarray:
    """[kind, letter, state]: the state each edit leads to."""
    out = np.zeros((END + 1, 5, 4), np.int64)
    out[:, D] = np.arange(4)
    out[:, R] = NEXT
    out[:END, K] = np.maximum(AFTER[:, np.arange(END) % 4].T, 0)
    return out


COSTS, TARGETS = row_costs(), row_targets()


def back_over(v: np.ndarray, kinds: np.ndarray) -> np.ndarray:
    """Costs to go before a row of each block from those after it; v: [block, state, ...], inserts first included."""
    best = np.full_like(v, FAR)
    for letter in (NONE, D, K, R):
        cost = COSTS[kinds, letter]
        to = np.take_along_axis(v, TARGETS[kinds, letter].reshape(*cost.shape, *[1] * (v.ndim - 2)), 1)
        best = np.minimum(best, np.minimum(to + cost.reshape(*cost.shape, *[1] * (v.ndim - 2)), FAR))
    return np.minimum(open_up(best), FAR)


def costs_to_go(kinds: list[np.ndarray], end: np.ndarray) -> list[np.ndarray]:
    """[step, state, ...] for each block, the last step being ``end`` itself; all blocks go back one row at a time together."""
    order = np.argsort([-len(k) for k in kinds], kind="stable")
    out = [np.empty((len(k) + 1, *end.shape[1:]), np.int64) for k in kinds]
    for b in range(len(kinds)):
        out[b][-1] = end[b]
    sizes = np.array([len(kinds[b]) for b in order])
    v = end[order].copy()
    for step in range(1, int(sizes[0]) + 1 if len(sizes) else 0):
        n = int(np.searchsorted(-sizes, -step, "right"))  # blocks with so many rows
        now = np.array([kinds[b][len(kinds[b]) - step] for b in order[:n]], np.int64)
        v[:n] = back_over(v[:n], now)
        for i, b in enumerate(order[:n]):
            out[b][-1 - step] = v[i]
    return out


def cut_blocks(batches: Iterable[pa.RecordBatch], block_rows: int = BLOCK_ROWS) -> Iterator[pa.RecordBatch]:
    """Blocks of a sorted partition, numbered in order; one conversation each."""
    number = TaskContext.get().partitionId() << 40
    held: list[tuple] = []
    conv, chars = None, 0

    def block() -> tuple:
        nonlocal number, held, chars
        turns, roles, texts, kinds = zip(*held)
        faults = [k // 4 for k in kinds if k != END]
        known = [t for t in turns if t is not None]
        out = (conv, number, bytes(kinds), known[0] if known else None, known[-1] if known else None, len(set(known)),
               faults.count(BLANK), faults.count(DUPLICATE), faults.count(TRUNCATED),
               sum((a % 4, b % 4) not in LEGAL for a, b in zip(kinds, kinds[1:]) if b != END), roles, texts)
        number, held, chars = number + 1, [], 0
        return out

    def measured(found: list[tuple]) -> pa.RecordBatch:
        kinds = [np.frombuffer(b[2], np.uint8) for b in found]
        ends = np.full((len(found), 4, 4), FAR, np.int64)
        ends[:, np.arange(4), np.arange(4)] = 0  # the last axis: the state at the end of the block
        # END leads to state 0 of whatever follows, which is nothing.
        table = [c[0].ravel().tolist() for c in costs_to_go(kinds, ends)]
        return batch_of([(*b[:10], t, *b[10:]) for b, t in zip(found, table)], BLOCKS)

    for batch in batches:
        found = []
        for c, *row in zip(*(batch.column(k).to_pylist() for k in range(5))):
            if held and (c != conv or len(held) >= block_rows or chars >= BLOCK_CHARS):
                found.append(block())
            conv = c
            held.append(tuple(row))
            chars += len(row[2] or "")
        if found:
            yield measured(found)
    if held:
        yield measured([block()])


CHAINED = "block long, first boolean, to_go array<long>, n_turns long, min_turn long, max_turn long, blank long, duplicate long, truncated long, illegal long, cost long"


def chain_back(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The costs to go at the end of each block, from blocks sorted by conversation and backwards.

    The row of a conversation's first block also has its totals. One conversation's state is four
    costs and a few counts, however many blocks it has.
    """
    now: list | None = None  # conv, costs to go, sums, last turn, first turn, first kind
    waiting: tuple | None = None  # the block before whose conversation may end here

    def closed() -> tuple:
        conv, to_go, (n, blank, duplicate, truncated, illegal), low, high, _ = now
        return (waiting[0], True, waiting[1], n, low, high, blank, duplicate, truncated, illegal, int(to_go[0]))

    for batch in batches:
        out = []
        for conv, block, kinds, low, high, n, *counts, costs in zip(*(batch.column(k).to_pylist() for k in range(11))):
            same = now is not None and now[0] == conv
            if waiting is not None:
                out.append((waiting[0], False, waiting[1], *[None] * 8) if same else closed())
            end = now[1] if same else np.zeros(4, np.int64)
            start = np.minimum((np.array(costs, np.int64).reshape(4, 4) + end).min(1), FAR)
            sums = [n, *counts]
            if same:
                n -= low is not None and now[3] is not None and high == now[3]
                sums = [a + b for a, b in zip(now[2], [n, *counts])]
                sums[4] += now[5] != END and (kinds[-1] % 4, now[5] % 4) not in LEGAL
                high = now[4] if now[4] is not None else high
                low = low if low is not None else now[3]
            now = [conv, start, sums, low, high, kinds[0]]
            waiting = (block, end.tolist())
        if out:
            yield batch_of(out, CHAINED)
    if waiting is not None:
        yield batch_of([closed()], CHAINED)


class Paths:
    """Cheapest paths through many blocks: nodes are (block, step, state), and each block's last step has its exits."""

    def __init__(self, kinds: list[np.ndarray], ends: np.ndarray):
        costs = costs_to_go(kinds, ends)
        sizes = np.array([len(c) for c in costs], np.int64)
        self.base = (np.cumsum(sizes) - sizes) * 4
        v = np.concatenate(costs) if costs else np.zeros((0, 4), np.int64)
        n = len(v)
        last = np.zeros(n, bool)
        last[np.cumsum(sizes) - 1] = True
        kind = np.zeros(n, np.int64)
        kind[~last] = np.concatenate(kinds) if len(kinds) else []
        node = np.arange(n * 4).reshape(n, 4)
        ahead = np.vstack([v[1:], np.full((1, 4), FAR)])
        arcs = []  # (letter, whether on a cheapest path, node it leads to)
        for letter in (NONE, D, I, K, R):
            if letter == I:
                cost, to = v[:, NEXT] + INSERT, node[:, :1] + NEXT
            else:
                state = TARGETS[kind, letter]
                cost, to = np.take_along_axis(ahead, state, 1) + COSTS[kind, letter], node[:, :1] + 4 + state
            arcs.append((letter, (cost == v) & (v < FAR) & ~last[:, None], to))
        self.letter, self.jumps = np.zeros(n * 4, np.int64), [node.ravel().copy()]
        chosen = np.zeros((n, 4), bool)
        for letter, on, to in arcs:  # letters ascend, so the first arc of a node has its least letter
            take = (on & ~chosen).ravel()
            self.letter[take], self.jumps[0][take] = letter, to.ravel()[take]
            chosen |= on
        self.last, self.arcs = np.repeat(last, 4), arcs
        self._rank()

    def _rank(self) -> None:
        """Ranks of the nodes by audits of doubling lengths, until every pointer is at an exit or stuck."""
        self.rank = self.letter
        while True:
            jump = self.jumps[-1]
            pairs = self.rank * (int(self.rank.max(initial=0)) + 1) + self.rank[jump]
            self.rank = np.unique(pairs, return_inverse=True)[1]
            twice = jump[jump]
            if (twice == jump).all():
                break
            self.jumps.append(twice)
        # The rank of a whole audit agrees with its first letter, so ranks select the arcs that the pointers follow.
        best = np.full(len(self.letter), np.iinfo(np.int64).max)
        span = int(self.rank.max(initial=0)) + 1
        for letter, on, to in self.arcs:
            key = np.where(on, letter * span + self.rank[np.minimum(to, len(self.rank) - 1)], best.reshape(on.shape))
            best = np.minimum(best, key.ravel())
        moving = best < np.iinfo(np.int64).max
        if (best[moving] != self.letter[moving] * span + self.rank[self.jumps[0][moving]]).any():
            raise ValueError("two edits of one node share a letter")

    def of(self, block: int, states: list[int]) -> tuple[list[int], list[str | None]]:
        """For each state at the start of a block the state at its end and the least audit; (-1, None) without a path."""
        at = self.base[block] + np.array(states)
        path = at[:, None]
        for jump in self.jumps:
            if self.last[path[:, -1]].all():
                break
            path = np.hstack([path, jump[path]])
        exits, audits = [], []
        for row in path:
            if not self.last[row[-1]]:
                exits.append(-1)
                audits.append(None)
                continue
            letters = self.letter[row[: int(self.last[row].argmax())]]
            exits.append(int(row[-1] % 4))
            audits.append(LETTERS[letters[letters != NONE]].tobytes().decode())
        return exits, audits


TRAILS = "conv_id long, block long, exits array<int>, audits array<string>"


def rank_paths(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each block and state it may begin in: the state it ends in and the least audit of cheapest edits."""
    for batch in batches:
        conv, block, kinds, first, to_go = (batch.column(k).to_pylist() for k in range(5))
        paths = Paths([np.frombuffer(k, np.uint8).astype(np.int64) for k in kinds], np.array(to_go, np.int64).reshape(-1, 4))
        yield batch_of([(c, b, *paths.of(k, [0] if f else [0, 1, 2, 3])) for k, (c, b, f) in enumerate(zip(conv, block, first))], TRAILS)


ENTRIES = "block long, entry int"


def chain_forward(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The state in which each block begins, from blocks sorted by conversation."""
    conv, state, begun = None, 0, False
    for batch in batches:
        out = []
        for c, block, exits in zip(*(batch.column(k).to_pylist() for k in range(3))):
            if not begun or c != conv:
                conv, state, begun = c, 0, True
            out.append((block, state))
            state = exits[state]
        yield batch_of(out, ENTRIES)


REPAIRED = "conv_id long, block long, audit string, roles array<string>, texts array<string>"


def apply_edits(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The repaired rows of each block."""
    for batch in batches:
        out = []
        for conv, block, entry, audits, kinds, roles, texts in zip(*(batch.column(k).to_pylist() for k in range(7))):
            state, i, new_roles, new_texts = entry, 0, [], []
            for letter in audits[entry]:
                if letter == "I" or letter == "R":
                    state = int(NEXT[state])
                    new_roles.append(ROLE_OF_STATE[state])
                    new_texts.append("" if letter == "I" else texts[i])
                elif letter == "K":
                    state = int(AFTER[state, kinds[i] % 4])
                    new_roles.append(roles[i])
                    new_texts.append(texts[i])
                i += letter != "I"
            out.append((conv, block, audits[entry], new_roles, new_texts))
        yield batch_of(out, REPAIRED)


def repair(rows: DataFrame, conversations: DataFrame, block_rows: int = BLOCK_ROWS) -> tuple[DataFrame, DataFrame]:
    """Blocks of repaired rows (conv_id, block, audit, roles, texts), and one row of totals per conversation.

    ``rows``: conv_id, turn, role, text without NULL roles and texts; other columns are not read.
    Rows are taken by turn, NULL turns first; equal turns in the order of a digest of role and text,
    equal rows beside each other. A role without a first letter, or with another one than s, u, a,
    cannot be kept. ``conversations`` names all ids; one without rows is repaired to nothing, and
    NULL is an id like any other. Texts of any length are moved, never compared beyond their digest.
    """
    blocks = stage(ordered(rows, conversations).mapInArrow(lambda batches: cut_blocks(batches, block_rows), BLOCKS), "dialogue-blocks")
    spark = rows.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def by_conversation(df: DataFrame, order: Column) -> DataFrame:
        return df.repartition(n, "conv_id").sortWithinPartitions("conv_id", order)

    summary = "conv_id block kinds first_turn last_turn n_turns blank duplicate truncated illegal costs".split()
    chained = stage(by_conversation(blocks.select(summary), F.desc("block")).mapInArrow(chain_back, CHAINED), "dialogue-chained")
    ranked = blocks.select("conv_id", "block", "kinds").join(chained.select("block", "first", "to_go"), "block")
    trails = stage(ranked.select("conv_id", "block", "kinds", "first", "to_go").mapInArrow(rank_paths, TRAILS), "dialogue-trails")
    entries = by_conversation(trails.select("conv_id", "block", "exits"), F.asc("block")).mapInArrow(chain_forward, ENTRIES)
    edited = (
        blocks.select("block", "kinds", "roles", "texts").join(trails.select("conv_id", "block", "audits"), "block").join(entries, "block")
        .select("conv_id", "block", "entry", "audits", "kinds", "roles", "texts").mapInArrow(apply_edits, REPAIRED)
    )
    totals = blocks.select("conv_id", "block").join(chained.where("first"), "block").select(
        "conv_id", F.coalesce(F.col("max_turn") - F.col("min_turn") + 1 - F.col("n_turns"), F.lit(0).cast("long")).alias("gaps"),
        "blank", "duplicate", "truncated", "illegal", "cost",
    )
    return edited, totals


DIGEST = "conv_id long, audit string, repaired_sha256 string"


def digest_conversations(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Audit and digest of each conversation, read block by block; only the audit is held."""
    conv, audits, sha, begun, written = None, [], hashlib.sha256(), False, False
    for batch in batches:
        out = []
        for c, _, audit, roles, texts in zip(*(batch.column(k).to_pylist() for k in range(5))):
            if begun and c != conv:
                out.append((conv, "".join(audits), sha.hexdigest()))
            if not begun or c != conv:
                conv, audits, sha, begun, written = c, [], hashlib.sha256(), True, False
            audits.append(audit)
            for role, text in zip(roles, texts):
                sha.update(f"{chr(10) if written else ''}{role}:{text}".encode())
                written = True
        if out:
            yield batch_of(out, DIGEST)
    if begun:
        yield batch_of([(conv, "".join(audits), sha.hexdigest())], DIGEST)


def digest(edited: DataFrame, totals: DataFrame) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256: one row per conversation.

    A digest runs over its conversation in order, so the repaired rows of one conversation pass through
    one task, a block at a time.
    """
    n = int(edited.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    read = edited.repartition(n, "conv_id").sortWithinPartitions("conv_id", "block").mapInArrow(digest_conversations, DIGEST)
    read = read.withColumnRenamed("conv_id", "_conv")
    return (
        totals.join(read, F.col("conv_id").eqNullSafe(F.col("_conv")))
        .select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")
    )


def digest_sql(table: str = "conversations") -> str:
    """``digest(*repair(damage(...)))`` for DuckDB, one row of each conversation at a time from its end."""

    def least(*options: str) -> str:
        return f"list_min([{', '.join(options)}])"

    def option(v: str, cost: int | str, letter: str, state: int, line: str | None = None, when: str = "true") -> str:
        old = f"{v}[{state + 1}]"
        lines = f"{old}.t" if line is None else f"list_prepend({line}, {old}.t)"
        return f"{{'c': CASE WHEN {when} THEN {cost} + {old}.c ELSE {FAR} END, 'a': '{letter}' || {old}.a, 't': {lines}}}"

    def insert(v: str, state: int) -> str:
        to = int(NEXT[state])
        return least(f"{v}[{state + 1}]", option(v, INSERT, "I", to, f"'{ROLE_OF_STATE[to]}:'"))

    def opened(source: str) -> str:
        """Inserts before what is next, on lists of four (cost, audit, lines)."""
        pair = f"list_value(w[1], w[2], {insert('w', 2)}, {insert('w', 3)})"
        both = f"list_value({insert('x', 0)}, {insert('x', 1)}, x[3], x[4])"
        return f"SELECT conv_id, i, {both} AS v FROM (SELECT conv_id, i, {pair} AS x FROM ({source}))"

    def row(state: int) -> str:
        more, live = f"(CASE WHEN fault = {TRUNCATED} THEN {UNFINISHED} ELSE 0 END)", f"fault NOT IN ({BLANK}, {DUPLICATE})"
        keep = [option("v", more, "K", int(AFTER[state, k]), "role || ':' || text", f"{live} AND left(role, 1) = '{x}'")
                for k, x in enumerate(INITIALS) if AFTER[state, k] >= 0]
        to = int(NEXT[state])
        return least(option("v", DELETE, "D", state), *keep, option("v", f"{REROLE} + {more}", "R", to, f"'{ROLE_OF_STATE[to]}:' || text", live))

    final = ", ".join(f"{{'c': CAST({c} AS BIGINT), 'a': '', 't': CAST([] AS VARCHAR[])}}" for c in (0, FAR, FAR, 0))
    visible = "rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))"
    return f"""
WITH RECURSIVE crc AS (
  SELECT list_transform(range(256), lambda b: list_reduce(list_prepend(b, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t
), named AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    list_transform(string_split(coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' '), ''), lambda x: CAST(ascii(x) AS BIGINT)) AS name
  FROM {table}
), hashed AS (
  SELECT conv_id, turn, role, text,
    xor(list_reduce(list_prepend(4294967295, name), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) % 20 AS h
  FROM named, crc
), damaged AS (
  SELECT conv_id, turn, CASE WHEN h = 4 THEN 'user' ELSE role END AS role,
    CASE WHEN h = 1 THEN '' WHEN h = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
    unnest(range(CASE WHEN h = 3 THEN 2 ELSE 1 END)) AS copy
  FROM hashed WHERE h <> 0
), numbered AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, sha256(length(role) || ':' || role || text), copy) AS n FROM damaged
), seen AS (
  SELECT *, {visible} AS visible, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY n) AS nth FROM numbered
), steps AS (
  SELECT conv_id, turn, role, text, n,
    CASE WHEN visible = '' THEN {BLANK} WHEN nth > 1 THEN {DUPLICATE} WHEN right(visible, 1) IN ('.', '!', '?') THEN 0 ELSE {TRUNCATED} END AS fault,
    lead(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY n) AS following
  FROM seen
), totals AS (
  SELECT conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
    count(*) FILTER (WHERE fault = {BLANK}) AS blank, count(*) FILTER (WHERE fault = {DUPLICATE}) AS duplicate,
    count(*) FILTER (WHERE fault = {TRUNCATED}) AS truncated,
    count(*) FILTER (WHERE following IS NOT NULL AND left(role, 1) || following NOT IN ('su', 'ua', 'au')) AS illegal
  FROM steps GROUP BY conv_id
), every_id AS (
  SELECT c.conv_id, coalesce(t.n, 0) AS n, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
    coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal
  FROM (SELECT DISTINCT conv_id FROM {table}) c LEFT JOIN totals t ON c.conv_id IS NOT DISTINCT FROM t.conv_id
), back AS (
  {opened(f"SELECT conv_id, n AS i, list_value({final}) AS w FROM every_id")}
  UNION ALL
  {opened(f"SELECT b.conv_id, b.i - 1 AS i, list_value({', '.join(map(row, range(4)))}) AS w FROM back b JOIN steps s ON b.conv_id IS NOT DISTINCT FROM s.conv_id AND s.n = b.i")}
)
SELECT e.conv_id, CAST(gaps AS BIGINT) AS gaps, CAST(blank AS BIGINT) AS blank, CAST(duplicate AS BIGINT) AS duplicate, CAST(truncated AS BIGINT) AS truncated,
  CAST(illegal AS BIGINT) AS illegal, CAST(v[1].c AS BIGINT) AS cost, v[1].a AS audit, sha256(coalesce(array_to_string(v[1].t, chr(10)), '')) AS repaired_sha256
FROM every_id e JOIN back b ON e.conv_id IS NOT DISTINCT FROM b.conv_id AND b.i = 0
"""
