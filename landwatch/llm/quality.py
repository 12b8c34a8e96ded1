"""Quality rules with risk-controlled thresholds, in DataFrame functions only.

Each rule rejects documents whose measure lies above a cutoff. For every stratum, labelled
holdouts give the number of good documents a cutoff would reject. A cutoff is certified if the
exact binomial probability of so few rejections, were the true rate at its limit, is at most
``delta`` divided by the number of (stratum, rule, cutoff) tests: with probability 1 - ``delta``
no certified cutoff rejects more than its share of ``alpha`` of a stratum's good documents.
Among the certified cutoffs of a rule the one with the largest net gain on the labels is taken.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from landwatch.llm.common import stage

BLANKS = " \t\n\x0b\x0c\r"
NON_BLANKS = r"[^\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"
#: Measures and the cutoffs tried for each, loosest first.
RULES: dict[str, tuple[float, ...]] = {
    "symbol_share": (2.0, 1.0, 0.5, 0.25, 0.1, 0.05),
    "dup_line_share": (0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.3),
    "repeat_share": (0.5, 0.4, 0.3, 0.25, 0.2),
    "word_length": (12.0, 10.0, 9.0, 8.0, 7.0, 6.5, 6.0),
}
#: What one share of good documents rejected costs, in shares of bad documents rejected.
COST = 4.0


def _let(value: Column, use) -> Column:
    """``use`` of a value that is computed once."""
    return F.transform(F.array(value), use)[0]


def _repeated_words(words: Column) -> Column:
    """Words inside 3-word windows that occur more than once in the text."""
    last = F.size(words) - 3
    window = lambda i: F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2))
    hashes = F.transform(F.sequence(F.lit(0), last), window)

    def covered(sorted_windows: Column) -> Column:
        again = F.filter(
            sorted_windows,
            lambda x, j: (F.coalesce(F.get(sorted_windows, j - 1)["h"] == x["h"], F.lit(False)))
            | (F.coalesce(F.get(sorted_windows, j + 1)["h"] == x["h"], F.lit(False))),
        )
        places = F.array_sort(F.transform(again, lambda x: x["i"]))
        # Window i covers three words; of those, the ones before the next repeated window count here.
        return _let(places, lambda p: F.aggregate(
            F.transform(p, lambda i, j: F.least(F.lit(3), F.coalesce(F.get(p, j + 1) - i, F.lit(3)))), F.lit(0), lambda s, x: s + x
        ))

    # Most texts repeat no window: sorting is for the others only.
    return F.when(last < 0, F.lit(0)).otherwise(
        _let(hashes, lambda hs: F.when(F.size(F.array_distinct(hs)) == F.size(hs), F.lit(0)).otherwise(
            _let(F.array_sort(F.transform(hs, lambda h, i: F.struct(h.alias("h"), i.alias("i")))), covered)
        ))
    )


def measures(documents: DataFrame, text_col: str = "text", key_col: str = "doc_id", stratum_col: str = "lang") -> DataFrame:
    """doc_id, stratum and the base measures of every whole text; NULL is an empty text, a NULL stratum is ``und``.

    One pass over the rows without a shuffle. Equal windows are told by a 64-bit hash.
    """
    rows = documents.select(
        F.col(key_col).alias("doc_id"), F.coalesce(F.col(stratum_col).cast("string"), F.lit("und")).alias("stratum"),
        F.coalesce(F.col(text_col), F.lit("")).alias("text"),
    )
    rows = rows.withColumn("words", F.regexp_extract_all("text", F.lit(NON_BLANKS), F.lit(0)))
    rows = rows.withColumn("lines", F.filter(F.split("text", "\n"), lambda x: x.rlike(NON_BLANKS)))
    length = F.length("text")
    rows = rows.select(
        "doc_id", "stratum",
        F.size("words").cast("long").alias("n_words"),
        F.length(F.translate("text", BLANKS, "")).cast("long").alias("word_chars"),
        (length - F.length(F.translate("text", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        _repeated_words(F.col("words")).cast("long").alias("n_repeat_words"),
    )
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    share = lambda a, b: F.col(a).cast("double") / F.greatest(F.col(b), F.lit(1))
    return rows.select(
        "*", failed.alias("base_failed"),
        share("n_symbols", "n_words").alias("symbol_share"), share("n_dup_lines", "n_lines").alias("dup_line_share"),
        share("n_repeat_words", "n_words").alias("repeat_share"), share("word_chars", "n_words").alias("word_length"),
    )


def binomial_tail(n: Column, k: Column, p: float) -> Column:
    """P(X <= k) for X ~ Binomial(n, p), for k below n * p; 1.0 otherwise (nothing is certified there).

    The largest term is computed from logarithms; the smaller ones follow from it by ratios.
    """
    odds = p / (1 - p)
    log_choose = F.aggregate(
        F.sequence(F.lit(1), F.greatest(k, F.lit(1))), F.lit(0.0),
        lambda s, i: s + F.when(k == 0, F.lit(0.0)).otherwise(F.log((n - k + i) / i)),
    )
    first = F.exp(log_choose + k * F.log(F.lit(odds)) + n * F.log(F.lit(1 - p)))
    ratio = F.aggregate(
        F.sequence(F.lit(0), F.greatest(k - 1, F.lit(0))),
        F.struct(F.lit(1.0).alias("term"), F.lit(1.0).alias("sum")),
        lambda s, i: _let(
            s["term"] * F.when(k == 0, F.lit(0.0)).otherwise((k - i) / (n - k + i + 1) / odds),
            lambda t: F.struct(t.alias("term"), (s["sum"] + t).alias("sum")),
        ),
        lambda s: s["sum"],
    )
    return F.when(k >= n * p, F.lit(1.0)).otherwise(first * ratio)


def cutoffs(measured: DataFrame, labels: DataFrame, alpha: float = 0.05, delta: float = 0.05, label_col: str = "quality", key_col: str = "doc_id") -> DataFrame:
    """stratum, rule, cutoff: the certified cutoff of largest net gain for each stratum and rule, where there is one.

    ``labels``: 1 is a good document, 0 a bad one; others are ignored. Labelled documents that
    pass the base rule are the holdouts: cutoffs come from a fixed list, so nothing is fitted on
    them before. A rule without a certified cutoff, or with none that gains, is off in that
    stratum. Strata must be few; counts are summed in the tasks, so one with most rows is no hot task.
    """
    known = labels.where(F.col(label_col).isin(0, 1)).select(F.col(key_col).alias("doc_id"), F.col(label_col).alias("good"))
    held = measured.where(~F.col("base_failed")).join(known, "doc_id")
    counts = [
        F.count_if((F.col("good") == good) & (F.col(rule) > c)).alias(f"{rule}_{i}_{good}")
        for rule, cs in RULES.items() for i, c in enumerate(cs) for good in (0, 1)
    ]
    strata = stage(held.groupBy("stratum").agg(F.count_if(F.col("good") == 1).alias("n1"), F.count_if(F.col("good") == 0).alias("n0"), *counts), "strata")
    tests = F.explode(F.array(*[
        F.struct(F.lit(rule).alias("rule"), F.lit(i).alias("place"), F.lit(c).alias("cutoff"), F.col(f"{rule}_{i}_0").alias("k0"), F.col(f"{rule}_{i}_1").alias("k1"))
        for rule, cs in RULES.items() for i, c in enumerate(cs)
    ]))
    each = sum(map(len, RULES.values()))
    rows = strata.select("stratum", "n0", "n1", tests.alias("t")).select("stratum", "n0", "n1", "t.*")
    n_tests = each * strata.count()
    tail = binomial_tail(F.col("n1"), F.col("k1"), alpha / len(RULES))
    gain = F.col("k0") / F.greatest("n0", F.lit(1)) - COST * F.col("k1") / F.greatest("n1", F.lit(1))
    safe = rows.withColumn("gain", gain).where((tail <= delta / max(1, n_tests)) & (F.col("gain") > 0))
    best = F.max_by("cutoff", F.struct("gain", -F.col("place")))
    return safe.groupBy("stratum", "rule").agg(best.alias("cutoff"))


def judge(documents: DataFrame, labels: DataFrame, alpha: float = 0.05, delta: float = 0.05) -> DataFrame:
    """Base measures, base_failed, rejected_by (rules above their cutoff) and kept, for every row of ``documents``.

    NULL and empty texts have no words and fail the base rule. Without labels only the base rule
    rejects. A measure equal to its cutoff passes; of cutoffs of equal gain the first of the grid
    counts. Repeated rows are judged alike, and those with a label count as often as they occur.
    Whole texts are measured, whatever their length; an empty table gives no rows. The table of
    cutoffs has one row per stratum; its size is that of the strata.
    """
    measured = stage(measures(documents), "quality")
    chosen = cutoffs(measured, labels, alpha, delta).collect()  # one row per stratum and rule
    above = [
        F.when((F.col("stratum") == r["stratum"]) & (F.col(r["rule"]) > r["cutoff"]), F.lit(r["rule"]))
        for r in sorted(chosen, key=lambda r: (r["stratum"], r["rule"]))
    ]
    rejected = F.array_compact(F.array(*above)) if above else F.array().cast("array<string>")
    rows = measured.withColumn("rejected_by", F.when(F.col("base_failed"), F.array().cast("array<string>")).otherwise(rejected))
    return rows.withColumn("kept", ~F.col("base_failed") & (F.size("rejected_by") == 0))


def judge_sql(alpha: float = 0.05, delta: float = 0.05) -> str:
    """DuckDB SQL for the columns of the registered query."""
    grid = ", ".join(f"('{rule}', {i}, {c!r}::DOUBLE)" for rule, cs in RULES.items() for i, c in enumerate(cs))
    p = alpha / len(RULES)
    measure = "CASE rule " + " ".join(f"WHEN '{r}' THEN {r}" for r in RULES) + " END"
    return rf"""
WITH split AS (
  SELECT doc_id, coalesce(lang, 'und') AS stratum, coalesce(text, '') AS text,
    list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS words,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
  FROM documents),
grams AS (
  SELECT doc_id, unnest(range(1, len(words) - 1)) AS i, words FROM split),
named AS (SELECT doc_id, i, words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] AS g FROM grams),
again AS (SELECT doc_id, i FROM named QUALIFY count(*) OVER (PARTITION BY doc_id, g) > 1),
repeated AS (SELECT doc_id, count(DISTINCT i + d) AS n FROM again, (VALUES (0), (1), (2)) AS t(d) GROUP BY doc_id),
base AS (
  SELECT s.doc_id, stratum, len(words)::BIGINT AS n_words,
    length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
    (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
    len(lines)::BIGINT AS n_lines, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
    coalesce(n, 0)::BIGINT AS n_repeat_words
  FROM split s LEFT JOIN repeated USING (doc_id)),
measured AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
    n_symbols::DOUBLE / greatest(n_words, 1) AS symbol_share, n_dup_lines::DOUBLE / greatest(n_lines, 1) AS dup_line_share,
    n_repeat_words::DOUBLE / greatest(n_words, 1) AS repeat_share, word_chars::DOUBLE / greatest(n_words, 1) AS word_length
  FROM base),
grid(rule, place, cutoff) AS (VALUES {grid}),
held AS (SELECT m.*, quality FROM measured m JOIN labels USING (doc_id) WHERE NOT base_failed AND quality IN (0, 1)),
tests AS (
  SELECT stratum, rule, place, cutoff, count(*) FILTER (quality = 1) AS n1, count(*) FILTER (quality = 0) AS n0,
    count(*) FILTER (quality = 1 AND {measure} > cutoff) AS k1, count(*) FILTER (quality = 0 AND {measure} > cutoff) AS k0
  FROM held, grid GROUP BY ALL),
judged AS (
  SELECT *, k0::DOUBLE / greatest(n0, 1) - {COST!r} * k1 / greatest(n1, 1) AS gain,
    CASE WHEN k1 >= n1 * {p!r}::DOUBLE THEN 1.0 ELSE list_sum(list_transform(range(0, k1 + 1), lambda j:
      exp(lgamma(n1 + 1) - lgamma(j + 1) - lgamma(n1 - j + 1) + j * ln({p!r}::DOUBLE) + (n1 - j) * ln(1 - {p!r}::DOUBLE)))) END AS tail
  FROM tests),
chosen AS (
  SELECT stratum, rule, arg_max(cutoff, (gain, -place)) AS cutoff FROM judged
  WHERE tail <= {delta!r}::DOUBLE / (SELECT count(*) FROM tests) AND gain > 0 GROUP BY stratum, rule),
rejected AS (SELECT DISTINCT doc_id FROM measured JOIN chosen USING (stratum) WHERE {measure} > cutoff)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND doc_id NOT IN (SELECT doc_id FROM rejected) AS kept
FROM measured
"""
