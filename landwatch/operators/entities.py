"""The same business entity in several connections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from landwatch.functions.text import match_token, name_tokens, table_key
from landwatch.session import materialize

MIN_CONFIDENCE = 0.5
# A table whose name says the entity starts here; the shared part of its columns adds the rest.
NAME_CONFIDENCE = 0.4
# The most frequent column names, looked up where the columns are; others are brought together by name.
COMMON_NAMES = 20_000
# Similarity of the column names of two tables from which they are a pair.
MIN_JACCARD = 0.5
# Sets of names of which any two are compared in one place, and tables of one set gathered in a row.
SETS_COMPARED = 1_000
TABLES_GATHERED = 200
# Comparisons that a task makes on average, and the most tasks there are.
COMPARISONS_A_TASK = 5_000_000
COMPARISON_TASKS = 100_000

# Words for the same entity in different systems (ours).
SYNONYMS = {
    "customer": "client, account, user, contact, member, subscriber",
    "order": "purchase, transaction, sale",
    "product": "item, part, sku, article",
    "supplier": "vendor",
    "event": "activity, log",
    "ticket": "case, issue",
    "employee": "staff",
    "payment": "charge",
}


def singular(word: Column) -> Column:
    return (
        F.when(word.rlike("ies$") & (F.length(word) > 4), F.regexp_replace(word, "ies$", "y"))
        .when(word.rlike("(ss|x|ch|sh)es$"), F.regexp_replace(word, "es$", ""))
        .when(word.rlike("[^s]s$") & (F.length(word) > 3), F.regexp_replace(word, "s$", ""))
        .otherwise(word)
    )


def entity_of_table(table_name: Column) -> Column:
    """Entity a table name stands for: its last word in the singular, synonyms merged."""
    words = F.filter(name_tokens(table_name), lambda t: ~t.rlike("^[0-9]+$"))
    canonical = F.create_map(
        *[F.lit(x) for main, others in SYNONYMS.items() for w in others.split(",") for x in (w.strip(), main)]
    )
    # As a lambda's variable the word is worked out once, not wherever it is named.
    last = F.transform(F.slice(words, -1, 1), singular)
    return F.get(F.transform(last, lambda w: F.coalesce(canonical[w], w)), 0)


def _has_entity(table_name: Column) -> Column:
    """Whether ``entity_of_table`` finds a word: it does in any name of more than digits and marks."""
    return F.lower(table_name).rlike(r"[\p{L}\p{N}&&[^0-9]]")


def connection_digests() -> list[Column]:
    """Two independent digests of the connection. Their minima and maxima differ where there are
    several connections, as those of the ids do, but need no sort to be aggregated."""
    known = lambda *c: F.when(F.col("connection_id").isNotNull(), F.xxhash64(*c))
    return [known("connection_id").alias("_conn_a"), known(F.lit("b"), F.col("connection_id")).alias("_conn_b")]


def _table_profile(landed: DataFrame, names: DataFrame | None = None) -> DataFrame:
    """Landed columns with their entity and normalized column name. ``names`` (connection_id,
    table_key, entity) tells the entity where a table's own name does not."""
    if names is not None:
        known = names.select("connection_id", F.col("table_key").alias("_key"), F.col("entity").alias("_entity"))
        landed = landed.withColumn("_key", table_key()).join(known, ["connection_id", "_key"], "left")
    ruled, found = entity_of_table(F.col("table_name")), _has_entity(F.col("table_name"))
    entity = ruled if names is None else F.coalesce("_entity", ruled)
    return landed.filter(found if names is None else found | F.col("_entity").isNotNull()).select(
        "connection_id",
        table_key().alias("table_key"),
        F.col("ordinal_position").cast("bigint").alias("ordinal_position"),
        "column_name",
        "data_type",
        "is_nullable",
        entity.alias("entity"),
        match_token(F.col("column_name")).alias("name"),
    )


def entity_columns(landed: DataFrame, names: DataFrame | None = None) -> DataFrame:
    """Per entity and normalized column name: whether several connections share it and
    whether its type or nullability conflicts between occurrences.

    Only minima and maxima are kept per key, so any entity, however common, is combined on
    the map side to one row per column name and type, and these to one per name.
    """
    return _column_facts(_table_profile(landed, names)).drop("n")


def _column_facts(profile: DataFrame) -> DataFrame:
    """``entity_columns`` with the number ``n`` of columns that have the name."""
    ends = lambda *columns: [f(c).alias(f"{f.__name__}_{c}") for c in columns for f in (F.min, F.max)]
    per_type = (
        profile.select("entity", "name", "data_type", "is_nullable", *connection_digests())
        .groupBy("entity", "name", "data_type")
        .agg(F.count(F.lit(1)).alias("n"), *ends("_conn_a", "_conn_b", "is_nullable"))
    )
    again = [f(f"{f.__name__}_{c}").alias(f"{f.__name__}_{c}") for c in ("_conn_a", "_conn_b", "is_nullable") for f in (F.min, F.max)]
    return (
        per_type.groupBy("entity", "name")
        .agg(F.sum("n").alias("n"), *ends("data_type"), *again)
        .select(
            "entity",
            "name",
            "n",
            ((F.col("min__conn_a") != F.col("max__conn_a")) | (F.col("min__conn_b") != F.col("max__conn_b"))).alias("is_shared"),
            F.when(F.col("min_data_type") != F.col("max_data_type"),
                   F.concat("name", F.lit(" has types "), "min_data_type", F.lit(" and "), "max_data_type")).alias("type_conflict"),
            F.when(F.col("min_is_nullable") != F.col("max_is_nullable"),
                   F.concat("name", F.lit(" is NOT NULL in one place and NULLABLE in another"))).alias("null_conflict"),
        )
    )


def _join_key_rank(name: Column, entity: Column) -> Column:
    lowered = F.lower(name)
    return (
        F.when(lowered == F.concat(entity, F.lit("_id")), 0)
        .when(lowered == "id", 1)
        .when(lowered.endswith("_id"), 2)
    )


def entity_occurrences(landed: DataFrame, names: DataFrame | None = None) -> DataFrame:
    """One row per (entity, table): columns, shared columns, join key, conflicts, confidence.

    Conflicts listed on a row are those of the columns this table has, so the array is
    bounded by the table's width. What is known of a column name is stored where it is shared or
    conflicts. The ``COMMON_NAMES`` most frequent names of these are looked up in place, so that
    names which most tables have are not brought together; columns of any other name are.
    """
    lowered = F.lower("column_name")
    is_key = (lowered == "id") | lowered.endswith("_id")
    key = F.when(is_key, F.struct(_join_key_rank(F.col("column_name"), F.col("entity")).alias("r"), "ordinal_position", "column_name"))
    place = ["entity", "connection_id", "table_key"]
    profile = materialize(_table_profile(landed, names).select(*place, "name", "data_type", "is_nullable", key.alias("key")), "entity-profile")
    conflicts = F.array_compact(F.array("type_conflict", "null_conflict"))
    facts = _column_facts(profile).withColumn("_conflicts", F.when(F.size(conflicts) > 0, conflicts)).drop("type_conflict", "null_conflict")
    about = materialize(facts.filter("is_shared OR _conflicts IS NOT NULL"), "entity-columns")
    common = materialize(about.orderBy(F.desc("n"), "entity", "name").limit(COMMON_NAMES), "entity-common")
    name = ["entity", "name"]
    columns = profile.select(*place, "name", "key")
    known = columns.join(F.broadcast(common), name)
    rare = columns.join(F.broadcast(common.select(*name)), name, "left_anti")
    rare = rare.join(about.join(F.broadcast(common.select(*name)), name, "left_anti"), name, "left")
    by_table = (
        known.unionByName(rare)
        .groupBy(F.xxhash64(*place).alias("_table"), *place)
        .agg(
            F.count(F.lit(1)).alias("n_columns"),
            F.count_if("is_shared").alias("n_shared"),
            F.min("key")["column_name"].alias("join_key_col"),
            F.sort_array(F.array_distinct(F.flatten(F.collect_list("_conflicts")))).alias("conflicts"),
        )
        .drop("_table")
    )
    share = F.col("n_shared") / F.col("n_columns")
    return by_table.withColumn(
        "confidence", F.round(F.lit(NAME_CONFIDENCE) + (1 - NAME_CONFIDENCE) * share, 2)
    )


def merged_names(links: DataFrame, preferred: DataFrame) -> DataFrame:
    """(name, entity): every name of ``links`` (a, b) with one name reachable from it: the smallest
    of those in ``preferred`` (name), or else the smallest.

    Names are few beside the tables that have them, and links are distinct. Each round hands the
    smaller label over every link, and then takes the label's own label, so a chain of names
    takes as many rounds as the logarithm of its length; every round is stored.
    """
    ends = links.where("a IS NOT NULL AND b IS NOT NULL").select("a", "b").distinct()
    both = materialize(ends.union(ends.select("b", "a")).distinct(), "name-links")
    names = both.select(F.col("a").alias("name")).distinct().join(preferred.select("name").distinct().withColumn("_first", F.lit("0")), "name", "left")
    labels = materialize(names.select("name", F.concat(F.coalesce("_first", F.lit("1")), "name").alias("entity")), "name-labels")
    while True:
        heard = both.join(labels, F.col("b") == F.col("name")).groupBy("a").agg(F.min("entity").alias("heard"))
        nearer = labels.join(heard, F.col("name") == F.col("a"), "left").select("name", "entity", F.least("entity", "heard").alias("_near"))
        jump = labels.select(F.col("entity").alias("_far"), F.col("name").alias("_label"))
        moved = nearer.join(jump, F.substring("_near", 2, 1 << 30) == F.col("_label"), "left").select("name", "entity", F.least("_near", "_far").alias("_next"))
        after = materialize(moved, "name-labels")
        labels = after.select("name", F.col("_next").alias("entity"))
        if after.where("entity != _next").isEmpty():
            return labels.withColumn("entity", F.substring("entity", 2, 1 << 30))


def entity_overlap_pairs(landed: DataFrame, min_jaccard: float = MIN_JACCARD) -> DataFrame:
    """The pairs of tables of one entity in different connections whose column names have a
    Jaccard similarity of at least ``min_jaccard``, and each table with an anchor of its entity,
    however similar.

    Two anchors per entity, the first table by connection and name and the first one outside
    that table's connection, link the whole group: tables of the first anchor's connection go to
    the second anchor, all others to the first. Every table with a counterpart in another
    connection has such a row. Every further pair has one row, in which the table of the later
    connection stands as the anchor.

    The rows grow with the similar pairs, and so with the square of a group of equal tables.
    Tables with the same names are compared once, sets of names only where they share a rare name,
    and both the comparisons and the rows of a pair of sets are dealt out in blocks.
    """
    if not 0 < min_jaccard <= 1:
        raise ValueError("min_jaccard must be above 0 and at most 1")
    table = ["entity", "connection_id", "table_key"]
    columns = _table_profile(landed).select(F.xxhash64("connection_id", "table_key", "entity").alias("_table"), *table, "name")
    # A column without a name is one that no other has.
    named = columns.groupBy("_table", *table).agg(F.sort_array(F.collect_set("name")).alias("names"), F.max(F.col("name").isNull()).cast("int").alias("_unnamed"))
    tables = materialize(named.select(*table, "names", (F.size("names") + F.col("_unnamed")).cast("bigint").alias("n")), "entity-tables")
    place = F.struct("connection_id", "table_key").alias("p")
    first = materialize(tables.groupBy("entity").agg(F.min(place).alias("p")), "entity-anchors")
    elsewhere = tables.join(first, "entity").filter(F.col("connection_id") != F.col("p.connection_id"))
    second = materialize(elsewhere.groupBy("entity").agg(F.min(place).alias("p")), "entity-anchors")

    def described(places: DataFrame, name: str) -> DataFrame:
        of = places.select("entity", "p.connection_id", "p.table_key")
        return tables.join(of, table).select("entity", F.struct("connection_id", "table_key", "names", "n").alias(name))

    anchors = materialize(described(first, "a").join(described(second, "b"), "entity"), "entity-anchors").select("entity", "a", "b")
    beside = F.col("connection_id") == F.col("a.connection_id")
    common = F.size(F.array_intersect("names", "anchor.names")).cast("bigint")
    links = tables.join(anchors, "entity").withColumn("anchor", F.when(beside, F.col("b")).otherwise(F.col("a"))).withColumn("n_common", common).select(
        "entity",
        F.col("anchor.connection_id").alias("anchor_connection_id"),
        F.col("anchor.table_key").alias("anchor_table_key"),
        "connection_id",
        "table_key",
        "n_common",
        F.round(F.col("n_common") / (F.col("n") + F.col("anchor.n") - F.col("n_common")), 4).alias("jaccard"),
    )
    # Both tables of a link are in these; the pair is not given a second time.
    anchored = lambda side: F.col("p") == F.struct(F.col(f"{side}.connection_id"), F.col(f"{side}.table_key"))
    marked = tables.withColumn("p", place).join(anchors, "entity").select(
        "entity", "names", "n", F.struct("connection_id", "table_key", anchored("a").alias("first"), anchored("b").alias("second"), beside.alias("beside")).alias("t")
    )
    return links.unionByName(_similar_tables(marked, min_jaccard))


def _similar_tables(tables: DataFrame, least: float) -> DataFrame:
    """The similar pairs of ``tables`` (entity, names, n, t) that no link to an anchor holds.

    Tables of one set of names are gathered in blocks, similar sets are brought to each pair of
    their blocks, and the tables are paired there."""
    same = ["entity", "names", "n"]
    sets = materialize(
        tables.groupBy(F.xxhash64(*same).alias("_digest"), *same).agg(F.count(F.lit(1)).alias("n_tables")).drop("_digest").withColumn("set", F.monotonically_increasing_id()),
        "entity-sets",
    )
    n_blocks = F.ceil(F.col("n_tables") / TABLES_GATHERED)
    block = F.pmod(F.xxhash64("t.connection_id", "t.table_key"), n_blocks).alias("block")
    gathered = tables.join(sets, same).select("set", block, "t").groupBy("set", "block").agg(F.collect_list("t").alias("tables"))
    blocks = materialize(gathered, "entity-blocks")
    itself = sets.where("n_tables > 1 AND size(names) > 0").select("entity", "set", F.col("set").alias("other"), F.size("names").cast("bigint").alias("n_common"), (2 * F.col("n")).alias("n"))
    itself = itself.where(F.col("n_common") / (F.col("n") - F.col("n_common")) >= least)
    pairs = itself.unionByName(_similar_sets(sets, least))
    ours = blocks.select("set", F.col("block").alias("_a"), F.col("tables").alias("_ours"))
    theirs = blocks.select(F.col("set").alias("other"), F.col("block").alias("_b"), F.col("tables").alias("_theirs"))
    # Of a set and itself each pair of blocks meets once; one block of it meets itself both ways.
    met = pairs.join(ours, "set").join(theirs, "other").where("set != other OR _a <= _b").hint("rebalance")
    both = met.withColumn("a", F.explode("_ours")).withColumn("b", F.explode("_theirs"))
    both = both.where("a.connection_id != b.connection_id AND (set != other OR _a != _b OR a.connection_id < b.connection_id)")
    ordered = F.col("a.connection_id") < F.col("b.connection_id")
    both = both.select("entity", "n_common", "n", F.when(ordered, F.col("a")).otherwise(F.col("b")).alias("t"), F.when(ordered, F.col("b")).otherwise(F.col("a")).alias("anchor"))
    return both.where("NOT t.first AND NOT (anchor.second AND t.beside)").select(
        "entity",
        F.col("anchor.connection_id").alias("anchor_connection_id"),
        F.col("anchor.table_key").alias("anchor_table_key"),
        "t.connection_id",
        "t.table_key",
        "n_common",
        F.round(F.col("n_common") / (F.col("n") - F.col("n_common")), 4).alias("jaccard"),
    )


def _similar_sets(sets: DataFrame, least: float) -> DataFrame:
    """(entity, set, other, n_common, n): the pairs of different sets of names of one entity whose
    similarity is at least ``least``, ``n`` the names of both added up.

    Names are numbered from the rarest on. Two sets that are similar enough share one of the few
    rarest names of each: leaving out more would leave too few in common. The first name they
    share decides where they meet, so they meet once. Sets with a frequent name are dealt to blocks,
    of which every two are compared, so no group is one task's work.
    """
    named = sets.select("entity", "set", "n", F.explode("names").alias("name"))
    seen = named.groupBy("entity", "name").agg(F.count(F.lit(1)).alias("seen")).where("seen > 1")
    numbers = materialize(seen.orderBy("seen", "entity", "name").withColumn("token", F.monotonically_increasing_id()), "entity-names")
    needed = F.greatest(F.ceil(least * F.col("n") - 1e-9), F.lit(1))
    # Names that no other set has are the rarest of all, and are only counted.
    alone = F.size("names") - F.size("tokens")
    numbered = (
        named.join(numbers.select("entity", "name", "token"), ["entity", "name"])
        .groupBy("entity", "set")
        .agg(F.sort_array(F.collect_list("token")).alias("tokens"))
        .join(sets.select("set", "names", "n"), "set")
        .withColumn("rarest", (F.size("names") - needed + 1 - alone).cast("int"))
        .where("rarest > 0")
        .select("entity", "set", "n", "tokens", F.slice("tokens", F.lit(1), F.col("rarest")).alias("rarest"))
    )
    # Bits of names: a bit that one set has and the other lacks is a name less in common.
    bits = F.expr("aggregate(tokens, 0L, (held, t) -> held | shiftleft(1L, cast(t % 64 as int)))")
    stored = materialize(numbered.withColumn("bits", bits), "entity-numbered")
    posted = stored.select("entity", "set", "n", "bits", "tokens", F.explode("rarest").alias("token"))
    groups = materialize(posted.groupBy("token").agg(F.count(F.lit(1)).alias("sets")).where("sets > 1"), "entity-groups")
    half = groups.agg(F.sum(F.col("sets") * F.col("sets") / 2)).first()[0] or 0
    tasks = max(1, min(COMPARISON_TASKS, int(half / COMPARISONS_A_TASK)))
    dealt = posted.join(groups.select("token", F.ceil(F.col("sets") / SETS_COMPARED).cast("int").alias("blocks")), "token")
    dealt = dealt.withColumn("mine", F.pmod(F.xxhash64("set", "token"), F.col("blocks")).cast("int"))
    meeting = ["token", "row", "block"]
    block = lambda *ends: F.explode(F.sequence(*ends))
    ours = dealt.select("token", F.col("mine").alias("row"), block(F.col("mine"), F.col("blocks") - 1).alias("block"), "entity", "set", "n", "bits", "tokens")
    theirs = dealt.select(
        "token", block(F.lit(0), F.col("mine")).alias("row"), F.col("mine").alias("block"),
        F.col("set").alias("other"), F.col("n").alias("m"), F.col("bits").alias("other_bits"), F.col("tokens").alias("others"),
    )
    # Dealt out by their number: the sets are few bytes, the comparisons are many.
    met = ours.repartition(tasks, *meeting).join(theirs, meeting).where((F.col("row") != F.col("block")) | (F.col("set") < F.col("other")))
    lacks = lambda a, b: F.bit_count(F.col(a).bitwiseAND(F.bitwise_not(b)))
    most = F.least(F.size("tokens") - lacks("bits", "other_bits"), F.size("others") - lacks("other_bits", "bits"))
    met = met.where(most / (F.col("n") + F.col("m") - most) >= least)
    # As a lambda's variable the common names are worked out once.
    found = F.transform(F.array(F.array_intersect("tokens", "others")), lambda c: F.struct(F.size(c).cast("bigint").alias("n"), F.get(c, 0).alias("first")))
    both = met.select("entity", "set", "other", "token", (F.col("n") + F.col("m")).alias("n"), F.explode(found).alias("c"))
    return both.where((F.col("c.first") == F.col("token")) & (F.col("c.n") / (F.col("n") - F.col("c.n")) >= least)).select(
        "entity", "set", "other", F.col("c.n").alias("n_common"), "n"
    )
