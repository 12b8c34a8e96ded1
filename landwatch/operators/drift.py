"""Schema drift between column snapshots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from landwatch.functions.hashing import content_hash, empty_hash  # noqa: F401  (public here)
from landwatch.functions.text import name_similarity, name_tokens
from landwatch.schemas import COLUMN_STRUCT
from landwatch.session import materialize

# Comparisons of a (table, type) group up to which all of its names are compared directly.
PAIRS_PER_TASK = 4096
REVIEW_THRESHOLD = 0.6
COLLATERAL_CONFIDENCE = 0.3

_PLACE = ["table_schema", "table_name"]


def _column(side: str) -> Column:
    """The full column struct of one side, or NULL when the column is absent there."""
    fields = [
        F.col(n) if n in ("table_schema", "table_name", "column_name") else F.col(f"{side}.{n}")
        for n in COLUMN_STRUCT.names
    ]
    return F.when(F.col(side).isNotNull(), F.struct(*[f.alias(n) for f, n in zip(fields, COLUMN_STRUCT.names)])).cast(
        COLUMN_STRUCT
    )


def match_columns(
    prior: DataFrame, current: DataFrame, keys: tuple[str, ...] = ("connection_id",)
) -> DataFrame:
    """Every column name of either side with its ``before`` and ``after`` structs.

    One pass: both sides are unioned, shuffled once by full column name and aggregated. This
    is the outer join of the two snapshots; it reads each side once and lets the last ordinal
    win where a name repeats. The key is a single column, so no connection or table, however
    large, makes a hot partition.

    The shuffle is asked for explicitly. Inputs that are already partitioned alike would let
    Spark 4.1 skip it (``spark.sql.unionOutputPartitioning``), and its adaptive local reads
    can then separate rows of one key.
    """
    columns = [*keys, *COLUMN_STRUCT.names]
    both = (
        prior.select(*columns, F.lit(False).alias("is_current"))
        .unionByName(current.select(*columns, F.lit(True).alias("is_current")))
        .repartition(*keys, *_PLACE, "column_name")
    )
    return match_tagged(both, keys)


def digest(names: list[str]) -> Column:
    """A number standing for the key in sorts: put before the key's own strings, it decides
    almost every comparison, and equal prefixes such as a common connection cost nothing."""
    return F.xxhash64(*names)


def match_tagged(columns: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """As ``match_columns`` for rows of both sides in one frame, told apart by ``is_current``."""
    name = [*keys, *_PLACE, "column_name"]
    payload = F.struct(
        F.col("ordinal_position").cast("bigint").alias("ordinal_position"), "data_type", "is_nullable"
    )
    return (
        columns.select(*name, payload.alias("c"), "is_current")
        .groupBy(digest(name).alias("_digest"), *name)
        .agg(
            F.max(F.when(~F.col("is_current"), F.col("c"))).alias("p"),
            F.max(F.when(F.col("is_current"), F.col("c"))).alias("n"),
        )
        .select(*keys, *_PLACE, "column_name", _column("p").alias("before"), _column("n").alias("after"))
    )


def changed_columns(
    prior: DataFrame, current: DataFrame, keys: tuple[str, ...] = ("connection_id",)
) -> DataFrame:
    """The matched columns that differ, written to the shared folder.

    Kept, renamed, new and dropped columns are all derived from these rows. They are a small
    share of the two snapshots, so the snapshots are read and shuffled once instead of once
    per kind of change, and later joins know the real size of their inputs.
    """
    return store_changed(match_columns(prior, current, keys))


def store_changed(matched: DataFrame) -> DataFrame:
    differs = (
        F.col("before").isNull()
        | F.col("after").isNull()
        | (F.col("before.data_type") != F.col("after.data_type"))
        | (F.col("before.ordinal_position") != F.col("after.ordinal_position"))
    )
    # A column's place and name are stored once, not in both structs.
    rest = [n for n in COLUMN_STRUCT.names if n not in (*_PLACE, "column_name")]
    keys = [c for c in matched.columns if c not in ("before", "after")]
    short = lambda side: F.when(F.col(side).isNotNull(), F.struct(*[F.col(f"{side}.{n}").alias(n) for n in rest])).alias(side)
    stored = materialize(matched.filter(differs).select(*keys, short("before"), short("after")), "changed-columns")
    return stored.select(*keys, _column("before").alias("before"), _column("after").alias("after"))


def diff_kept(matched: DataFrame, keys: tuple[str, ...] = ("connection_id",)) -> DataFrame:
    """Columns on both sides: TYPE_PROMOTION when the type differs, else REORDER when only
    the ordinal does. Nullability is not compared."""
    type_differs = F.col("before.data_type") != F.col("after.data_type")
    moved = F.col("before.ordinal_position") != F.col("after.ordinal_position")
    return (
        matched.filter(F.col("before").isNotNull() & F.col("after").isNotNull())
        .withColumn("change_type", F.when(type_differs, "TYPE_PROMOTION").when(moved, "REORDER"))
        .filter(F.col("change_type").isNotNull())
        .select(*keys, *_PLACE, "change_type", "before", "after")
    )


def _paired(matched: DataFrame, keys: tuple[str, ...]) -> tuple[DataFrame, list[str]]:
    """Columns on one side only whose table and type has columns on the other side too, with
    the number of comparisons in their group; stored, since every step below reads them.

    Groups are counted by their digests, so names are not moved for it, and the few groups with
    both sides are stored first: their real size decides the join. Two groups of one digest only
    let rows through that find no partner below.
    """
    names = [*keys, *_PLACE, "data_type"]
    lone = (
        matched.filter(F.col("before").isNull() | F.col("after").isNull())
        .withColumn("data_type", F.coalesce("before.data_type", "after.data_type"))
        .withColumn("_digest", digest(names))
    )
    group = ["_digest", *names]
    removed, added = F.count_if(F.col("before").isNotNull()), F.count_if(F.col("after").isNotNull())
    sizes = materialize(lone.groupBy("_digest").agg((removed * added).alias("_pairs")).filter("_pairs > 0"), "paired-groups")
    return materialize(lone.join(sizes, "_digest").select(*group, "_pairs", "before", "after"), "one-sided"), group


def _sides(lone: DataFrame, group: list[str]) -> tuple[DataFrame, DataFrame]:
    removed = lone.filter(F.col("before").isNotNull()).select(*group, "before")
    return removed, lone.filter(F.col("after").isNotNull()).select(*group, "after")


def _scored(pairs: DataFrame, threshold: float) -> DataFrame:
    similarity = name_similarity(F.col("before.column_name"), F.col("after.column_name"))
    return pairs.withColumn("_similarity", similarity).filter(F.col("_similarity") >= threshold)


def _matched_directly(lone: DataFrame, group: list[str], threshold: float) -> DataFrame:
    """Greedy matching of groups of few comparisons: all plausible pairs of a group in order,
    each taken if both of its names are still free."""
    removed, added = _sides(lone, group)
    pair = F.struct(
        (-F.col("_similarity")).alias("o"), F.col("before.column_name").alias("b"), F.col("after.column_name").alias("a"), "before", "after"
    )
    ordered = _scored(removed.join(added, group), threshold).groupBy(*group).agg(F.array_sort(F.collect_list(pair)).alias("_pairs"))

    def take(taken: Column, p: Column) -> Column:
        free = ~F.array_contains(taken["b"], p["b"]) & ~F.array_contains(taken["a"], p["a"])
        both = F.struct(F.array_append(taken["b"], p["b"]).alias("b"), F.array_append(taken["a"], p["a"]).alias("a"))
        return F.when(free, both).otherwise(taken)

    none = F.array().cast("array<string>")
    taken = F.aggregate("_pairs", F.struct(none.alias("b"), none.alias("a")), take)
    partner = lambda p: F.get(F.col("_taken")["a"], (F.array_position(F.col("_taken")["b"], p["b"]) - 1).cast("int"))
    return (
        ordered.withColumn("_taken", taken)
        .select(*group, F.explode(F.filter("_pairs", lambda p: F.array_contains(F.col("_taken")["b"], p["b"]) & (partner(p) == p["a"]))).alias("p"))
        .select(*group, "p.before", "p.after")
    )


def _name_keys(side: DataFrame, group: list[str], own: str, similarity: float, q: int) -> DataFrame:
    """What a name may share with a similar one: its pieces of ``q`` characters, end marks
    counted in, each with its place, and its distinct tokens; and how many of either decide.

    Of two names within an edit distance of (1 - s) l, l the longer length, each edit spoils up
    to q pieces, so a name keeps all but q (1 - s) of its own length of them, each moved by at
    most that distance. One piece more, taken from the rarest on, holds the first piece kept;
    with token sets that overlap by s it is the same with the size less s times the size.
    """
    name = F.col(f"{own}.column_name")
    marks = [F.lit(c * (q - 1)) for c in ("\x02", "\x03")]
    marked = F.concat(marks[0], F.lower(name), marks[1])
    size = F.greatest(F.length(name), F.length(F.lower(name)))
    pieces = F.transform(F.sequence(F.lit(1), F.length(marked) - (q - 1)), lambda i: F.struct(F.substring(marked, i, F.lit(q)).alias("key"), i.alias("place")))
    tokens = F.array_distinct(name_tokens(name))
    kinds = F.array(
        F.struct((F.floor(q * (1 - similarity) * size + 1e-9) + 1).cast("int").alias("n"), pieces.alias("keys")),
        F.struct(
            (F.size(tokens) - F.greatest(F.ceil(similarity * F.size(tokens) - 1e-9), F.lit(1)) + 1).cast("int").alias("n"),
            F.transform(tokens, lambda t: F.struct(t.alias("key"), F.lit(0).alias("place"))).alias("keys"),
        ),
    )
    return side.select(*group, own, F.posexplode(kinds).alias("kind", "k")).select(*group, own, "kind", "k.n", F.explode("k.keys").alias("k")).select(
        *group, own, "kind", "n", "k.key", "k.place"
    )


def rename_comparisons(removed: DataFrame, added: DataFrame, group: list[str], similarity: float) -> DataFrame:
    """The pairs of names that can reach ``similarity`` (above one half): those that share one
    of their rarest pieces at about the same place, or one of their rarest tokens, rarity
    counted in their group. No plausible pair is lost."""
    loose = similarity - 1e-4  # similarities are rounded to four places
    q = max(2, min(4, int(0.6 / (1 - loose))))
    both = [(_name_keys(side, group, own, loose, q), own) for side, own in ((removed, "before"), (added, "after"))]
    every = [keys.select(*group, "kind", "key") for keys, _ in both]
    counts = materialize(every[0].unionByName(every[1]).groupBy(*group, "kind", "key").agg(F.count("*").alias("seen")), "name-keys")

    def rarest(keys: DataFrame, own: str) -> DataFrame:
        mine = keys.withColumn("_name", F.col(f"{own}.column_name")).join(counts, [*group, "kind", "key"]).groupBy(*group, "_name", "kind").agg(
            F.first(own).alias(own), F.first("n").alias("n"), F.array_sort(F.collect_list(F.struct("seen", "key", "place"))).alias("keys")
        )
        return mine.select(*group, "kind", own, F.explode(F.slice("keys", F.lit(1), F.greatest("n", F.lit(1)))).alias("k")).select(
            *group, "kind", own, F.col("k.key").alias("key"), F.col("k.place").alias(f"_{own}_place")
        )

    shared = rarest(*both[0]).join(rarest(*both[1]), [*group, "kind", "key"])
    sizes = [F.greatest(F.length(n), F.length(F.lower(n))) for n in (F.col("before.column_name"), F.col("after.column_name"))]
    moved = F.greatest(F.abs(F.col("_before_place") - F.col("_after_place")), F.abs(sizes[0] - sizes[1]))
    near = shared.filter((F.col("kind") == 1) | (moved <= (1 - loose) * F.greatest(*sizes) + 1e-9))
    named = [F.col("before.column_name").alias("_b"), F.col("after.column_name").alias("_a")]
    return near.groupBy(*group, *named).agg(F.first("before").alias("before"), F.first("after").alias("after")).drop("_b", "_a")


def _greedy_rounds(pairs: DataFrame, group: list[str]) -> DataFrame:
    """Greedy matching by rounds of mutual best pairs, until no pair has both names free.

    Pairs are in one strict order (similarity, then names), so the best pair left is mutual in
    every round, and the outcome is that of taking the pairs one by one in that order.
    """
    b, a = F.col("before.column_name").alias("_b"), F.col("after.column_name").alias("_a")
    left = pairs.select(*group, "before", "after", "_similarity", b, a)
    found = None
    while True:
        best = lambda own, other: left.groupBy(*group, own).agg(F.min(F.struct((-F.col("_similarity")).alias("o"), other)).alias("m")).select(*group, own, F.col(f"m.{other}").alias(other))
        mutual = best("_b", "_a").join(best("_a", "_b"), [*group, "_b", "_a"], "left_semi")
        taken = materialize(left.join(mutual, [*group, "_b", "_a"], "left_semi"), "renames")
        if taken.isEmpty():
            return found if found is not None else taken.select(*group, "before", "after")
        rows = taken.select(*group, "before", "after")
        found = rows if found is None else found.unionByName(rows)
        left = left.join(taken.select(*group, "_b"), [*group, "_b"], "left_anti").join(taken.select(*group, "_a"), [*group, "_a"], "left_anti")
        left = materialize(left, "rename-pairs")


def _matched_in_bands(lone: DataFrame, group: list[str], threshold: float) -> DataFrame:
    """Greedy matching of large groups, the most similar names first.

    What is matched at a high similarity leaves before lower ones are tried, where names have
    to share less and more pairs are compared. Below one half nothing need be shared, and the
    names that are left are all compared.
    """
    bands = [t for t in (0.9, 0.8, 0.7, 0.6) if t > threshold + 1e-9] + ([threshold] if threshold > 0.5 else [0.51, threshold])
    found = None
    for t in sorted(set(bands), reverse=True):
        removed, added = _sides(lone, group)
        compared = rename_comparisons(removed, added, group, t) if t > 0.5 else removed.join(added, group)
        taken = _greedy_rounds(materialize(_scored(compared, t), "rename-pairs"), group)
        found = taken if found is None else found.unionByName(taken)
        side = F.array(F.struct(F.col("before.column_name").alias("_name"), F.lit(False).alias("_new")), F.struct(F.col("after.column_name").alias("_name"), F.lit(True).alias("_new")))
        used = taken.select(*group, F.explode(side).alias("s")).select(*group, "s.*")
        named = lone.withColumns({"_name": F.coalesce("before.column_name", "after.column_name"), "_new": F.col("after").isNotNull()})
        lone = materialize(named.join(used, [*group, "_name", "_new"], "left_anti").drop("_name", "_new"), "one-sided")
        if any(s.isEmpty() for s in _sides(lone, group)):
            break
    return found


def diff_rename_candidates(
    matched: DataFrame,
    keys: tuple[str, ...] = ("connection_id",),
    threshold: float = REVIEW_THRESHOLD,
    pairs_per_task: int = PAIRS_PER_TASK,
) -> DataFrame:
    """Removed and added columns of one table and type, paired by name similarity.

    A pair is plausible when its name similarity reaches ``threshold``. Plausible pairs are
    taken from the most similar down, ties by the names, as long as both columns are free: each
    column is in at most one pair, and no two columns that are left over are plausible. Groups
    with up to ``pairs_per_task`` comparisons are compared as they are; in larger ones a name
    meets only names that share one of its rarest pieces or tokens. Both ways give the same.
    """
    lone, group = _paired(matched, keys)
    found = _matched_directly(lone.filter(F.col("_pairs") <= pairs_per_task), group, threshold)
    large = lone.filter(F.col("_pairs") > pairs_per_task)
    if not large.isEmpty():
        found = found.unionByName(_matched_in_bands(large, group, threshold))
    return found.select(*keys, *_PLACE, F.lit("RENAME").alias("change_type"), "before", "after")


def diff_one_sided(matched: DataFrame, keys: tuple[str, ...] = ("connection_id",)) -> DataFrame:
    """RENAME, DEPRECATION and NEW_FIELD: every one-sided column in exactly one change."""
    renames = materialize(diff_rename_candidates(matched, keys), "renames")
    return renames.unionByName(_unpaired(matched, renames, keys))


def _unpaired(matched: DataFrame, renames: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    place = [*keys, *_PLACE, "column_name", "is_after"]
    sides = F.array(
        F.struct(F.col("before.column_name").alias("column_name"), F.lit(False).alias("is_after")),
        F.struct(F.col("after.column_name").alias("column_name"), F.lit(True).alias("is_after")),
    )
    used = renames.select(*keys, *_PLACE, F.explode(sides).alias("s")).select(*keys, *_PLACE, "s.*")
    lone = matched.filter(F.col("before").isNull() | F.col("after").isNull()).withColumn("is_after", F.col("after").isNotNull())
    kind = F.when(F.col("is_after"), "NEW_FIELD").otherwise("DEPRECATION")
    return lone.join(used, place, "left_anti").select(*keys, *_PLACE, kind.alias("change_type"), "before", "after")


def diff_unpaired(matched: DataFrame, keys: tuple[str, ...] = ("connection_id",)) -> DataFrame:
    """NEW_FIELD and DEPRECATION: one-sided columns that are in no plausible rename."""
    return diff_one_sided(matched, keys).filter(F.col("change_type") != "RENAME")


def diff_new_field(matched: DataFrame, keys: tuple[str, ...] = ("connection_id",)) -> DataFrame:
    return diff_unpaired(matched, keys).filter(F.col("change_type") == "NEW_FIELD")


def diff_deprecation(matched: DataFrame, keys: tuple[str, ...] = ("connection_id",)) -> DataFrame:
    return diff_unpaired(matched, keys).filter(F.col("change_type") == "DEPRECATION")


def diff_columns(
    prior: DataFrame,
    current: DataFrame,
    keys: tuple[str, ...] = ("connection_id",),
    ordered: bool = False,
) -> DataFrame:
    """Candidate changes between two sides, for every key at once.

    Both sides must already be free of system columns. The columns that differ are found
    and stored when this is called; the changes are then derived from them lazily. With
    ``ordered`` rows come by table, then kept, renamed, new and dropped columns.
    """
    return changes_from(changed_columns(prior, current, keys), keys, ordered)


def changes_from(
    matched: DataFrame, keys: tuple[str, ...] = ("connection_id",), ordered: bool = False
) -> DataFrame:
    """All candidate changes of matched columns."""
    changes = (
        diff_kept(matched, keys)
        .unionByName(diff_one_sided(matched, keys))
    )
    if ordered:
        rank = (
            F.when(F.col("change_type").isin("TYPE_PROMOTION", "REORDER"), 0)
            .when(F.col("change_type") == "RENAME", 1)
            .when(F.col("change_type") == "NEW_FIELD", 2)
            .otherwise(3)
        )
        changes = changes.orderBy(*keys, *_PLACE, rank, "before.column_name", "after.column_name")
    return changes


def hash_gate(current_hashes: DataFrame, latest: DataFrame) -> DataFrame:
    """Compare current hashes with each connection's newest snapshot.

    ``gate_state`` is BOOTSTRAP without a prior snapshot, else CHANGED or UNCHANGED.
    """
    prior = latest.select(
        "connection_id",
        F.col("snapshot_id").alias("prior_snapshot_id"),
        F.col("content_hash").alias("prior_hash"),
        F.col("captured_at").alias("prior_captured_at"),
    )
    state = (
        F.when(F.col("prior_snapshot_id").isNull(), "BOOTSTRAP")
        .when(F.col("content_hash") == F.col("prior_hash"), "UNCHANGED")
        .otherwise("CHANGED")
    )
    return (
        current_hashes.join(prior, "connection_id", "left")
        .withColumn("gate_state", state)
        .withColumnRenamed("content_hash", "current_hash")
    )


def attribute_collateral_reorder(
    changes: DataFrame, keys: tuple[str, ...] = ("connection_id",)
) -> DataFrame:
    """Add ``is_collateral``: a REORDER on a table that also had a TYPE_PROMOTION in the same
    diff. Loaders rewrite the table layout on a type change, so such moves are noise.

    Only moved columns are looked up; all other changes stay where they are."""
    place = [*keys, *_PLACE]
    promoted = (
        changes.filter(F.col("change_type") == "TYPE_PROMOTION")
        .select(*place)
        .distinct()
        .withColumn("_promoted", F.lit(True))
    )
    is_move = F.coalesce(F.col("change_type") == "REORDER", F.lit(False))
    moved = changes.filter(is_move).join(promoted, place, "left")
    return (
        changes.filter(~is_move).withColumn("is_collateral", F.lit(False))
        .unionByName(moved.select(*changes.columns, F.col("_promoted").isNotNull().alias("is_collateral")))
    )


def ordinal_delta(changes: DataFrame) -> DataFrame:
    """Add ``ordinal_delta`` = after − before, NULL when a side is absent. Advisory only."""
    return changes.withColumn(
        "ordinal_delta", F.col("after.ordinal_position") - F.col("before.ordinal_position")
    )


def rank_rename_candidates(
    changes: DataFrame, keys: tuple[str, ...] = ("connection_id",)
) -> DataFrame:
    """Add ``name_similarity`` and ``rename_rank`` (1 = most plausible per removed column) to
    the RENAME rows. From ``diff_columns`` each column has one; a list merged from several
    sources, such as reviewers' own pairs, is ranked as it is."""
    by_removed = Window.partitionBy(*keys, *_PLACE, "before.column_name").orderBy(
        F.desc("name_similarity"), "after.column_name"
    )
    return (
        changes.filter(F.col("change_type") == "RENAME")
        .withColumn("name_similarity", name_similarity(F.col("before.column_name"), F.col("after.column_name")))
        .withColumn("rename_rank", F.row_number().over(by_removed))
    )


def needs_human_review(events: DataFrame, threshold: float = REVIEW_THRESHOLD) -> DataFrame:
    """Add ``needs_review``: the classification confidence is below the threshold."""
    return events.withColumn("needs_review", F.col("classification_conf") < threshold)


def autonomy_filter(events: DataFrame, level: str = "STRICT") -> DataFrame:
    """Add ``auto_apply``: whether the autonomy level lets the event be applied unapproved.

    An event that needs review, by its confidence or a ``needs_review`` column, never is."""
    rules = {
        "STRICT": F.lit(False),
        "TRUSTED_ADDITIVE": F.col("change_type") == "NEW_FIELD",
        "FULL_AUTO": F.lit(True),
    }
    if level not in rules:
        raise ValueError(f"unknown autonomy level: {level}")
    sure = F.coalesce(F.col("classification_conf") >= REVIEW_THRESHOLD, F.lit(False))
    if "needs_review" in events.columns:
        sure = sure & ~F.coalesce("needs_review", F.lit(True))
    return events.withColumn("auto_apply", rules[level] & sure)


def list_proposed(events: DataFrame, ordered: bool = True) -> DataFrame:
    """Events awaiting review, oldest first, column structs as JSON text."""
    out = events.filter(F.col("remediation_status") == "PROPOSED").select(
        "drift_id",
        "connection_id",
        "detected_at",
        "change_type",
        "table_schema",
        "table_name",
        F.to_json("column_before", {"ignoreNullFields": "false"}).alias("column_before"),
        F.to_json("column_after", {"ignoreNullFields": "false"}).alias("column_after"),
        "classification_conf",
        "rationale",
        "remediation_sql",
        "remediation_status",
    )
    return out.orderBy("detected_at", "drift_id") if ordered else out
