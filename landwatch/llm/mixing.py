"""Mixing to target weights by soft membership, in DataFrame functions only.

A classifier learned from a labelled table (naive Bayes over hashed words) gives every document a
posterior over domains. Each document gets a nonnegative rate, its expected number of copies, so
that the expected domain totals of tokens, sum of rate * posterior * tokens, match the targets in
the least-squares sense; a small penalty keeps rates near 1 where the targets leave a choice.
Documents of like posterior are first summed into cells, with their exact posteriors, and share a rate.

The rates are those that a projected gradient step leaves unchanged: from 1, against the gradient,
onto the nonnegative numbers. The gradient is a weighted sum of one slope per domain, so the steps
move the few slopes by the curvature of the cells not held at zero, until the step leaves the
rates where they are. Each step is one aggregate over the cells, whatever came before it.
"""

from __future__ import annotations

from dataclasses import dataclass
from math import log

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from landwatch.llm.common import labelled_sample, sampled_texts, stage

BUCKETS = 4096
#: Cells are posteriors rounded to this many steps, which bounds their number whatever the corpus.
STEPS = 64
#: A text counts as evidence of at most this many words: posteriors of long texts stay soft.
EVIDENCE = 200
WORD = r"[^\x20\x09-\x0D]+"


def words(text_col: str = "text") -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(F.col(text_col), F.lit(""))), F.lit(WORD), F.lit(0))


def _table(values: list[float]) -> Column:
    """An array constant, written as one string so that the plan holds one literal."""
    return F.split(F.lit(",".join(repr(float(v)) for v in values)), ",").cast("array<double>")


def _looked_up(places: str, values: Column) -> Column:
    """Sum of the values at an array of places."""
    return F.aggregate(places, F.lit(0.0), lambda s, at: s + F.get(values, at))


class Classifier:
    """Domains, their log priors, and for each the log probabilities of ``BUCKETS`` word buckets."""

    def __init__(self, domains: list[str], log_prior: list[float], log_word: list[list[float]]):
        self.domains, self.log_prior, self.log_word = domains, log_prior, log_word

    def posterior(self, documents: DataFrame, keep: list[str], text_col: str = "text") -> DataFrame:
        """Columns ``keep``, n_tokens (words), p (posterior) and q (the posterior in whole steps of 1 / ``STEPS``).

        A NULL or empty text has the prior as posterior.
        """
        rows = documents.select(*keep, words(text_col).alias("_words"))
        rows = rows.select(*keep, F.size("_words").cast("long").alias("n_tokens"),
                           F.transform("_words", lambda w: F.pmod(F.xxhash64(w), F.lit(BUCKETS)).cast("int")).alias("_at"))
        weight = F.least(F.col("n_tokens"), F.lit(EVIDENCE)) / F.greatest(F.col("n_tokens"), F.lit(1))
        logs = [
            F.lit(prior) + weight * _looked_up("_at", _table(values)) for prior, values in zip(self.log_prior, self.log_word)
        ]
        rows = rows.select(*keep, "n_tokens", F.array(*logs).alias("_logs"))
        rows = rows.select(*keep, "n_tokens", F.transform("_logs", lambda x: F.exp(x - F.array_max("_logs"))).alias("_e"))
        total = F.aggregate("_e", F.lit(0.0), lambda s, x: s + x)
        rows = rows.select(*keep, "n_tokens", F.transform("_e", lambda x: x / total).alias("p"))
        return rows.withColumn("q", F.transform("p", lambda x: F.round(x * STEPS).cast("int")))


def fit(documents: DataFrame, labels: DataFrame, domain: str, per_domain: int = 2000, max_chars: int = 20_000,
        text_col: str = "text", key_col: str = "doc_id") -> Classifier:
    """Learn from about ``per_domain`` texts of each domain, those of at most ``max_chars`` characters.

    ``labels``: ``key_col`` and ``domain``. Word counts are summed in the tasks; ``BUCKETS`` numbers
    per domain reach the driver. Without labels there is one domain, ``all``.
    """
    known = labels.where(F.col(domain).isNotNull() & F.col(key_col).isNotNull())
    rows = sorted(known.groupBy(F.col(domain).cast("string").alias("d")).agg(F.count("*").alias("n")).collect(), key=lambda r: r["d"])
    if not rows:
        return Classifier(["all"], [0.0], [[0.0] * BUCKETS])
    total = sum(r["n"] for r in rows)
    sample = sampled_texts(documents, labelled_sample(known, domain, per_domain, key_col), max_chars, text_col, key_col)
    counted = (
        sample.select("label", F.explode(words()).alias("w"))
        .groupBy("label", F.pmod(F.xxhash64("w"), F.lit(BUCKETS)).cast("int").alias("at")).agg(F.count("*").alias("n")).collect()
    )
    counts = {r["d"]: [0.5] * BUCKETS for r in rows}
    for r in counted:
        counts[r["label"]][r["at"]] += r["n"]
    log_word = [[log(c / sum(counts[r["d"]])) for c in counts[r["d"]]] for r in rows]
    # Only differences between domains matter; centring each bucket keeps the sums small.
    means = [sum(col) / len(rows) for col in zip(*log_word)]
    return Classifier([r["d"] for r in rows], [log(r["n"] / total) for r in rows], [[v - m for v, m in zip(t, means)] for t in log_word])


@dataclass
class Solution:
    """Slopes of the domains, from which every rate follows, and what they reach.

    ``reached``: shares of the domains at these rates; ``distance``: the largest share by which a
    projected gradient step would still move a domain (0 at the optimum); ``missed``: the largest
    difference between a reached and a wanted share.
    """

    slopes: list[float]
    reached: list[float]
    distance: float
    missed: float
    largest_rate: float
    steps: int
    penalty: float
    max_rate: float | None

    def rate(self, shares: list[Column]) -> Column:
        """Rate of a cell with these mean memberships."""
        pull = sum((x * F.lit(float(g)) for x, g in zip(shares, self.slopes)), F.lit(0.0))
        free = F.greatest(F.lit(0.0), 1 - pull / self.penalty)
        return free if self.max_rate is None else F.least(F.lit(float(self.max_rate)), free)


def membership(cells: DataFrame, k: int) -> list[Column]:
    """Mean membership of a cell in each domain: ``mass`` over ``tokens``, or the rounded one where masses are not given."""
    if "mass" in cells.columns:
        return [F.when(F.col("tokens") > 0, F.get("mass", F.lit(i)) / F.col("tokens")).otherwise(F.get("q", F.lit(i)) / _total("q")) for i in range(k)]
    return [F.get("q", F.lit(i)) / _total("q") for i in range(k)]


def _total(array: str) -> Column:
    return F.greatest(F.lit(1), F.aggregate(array, F.lit(0), lambda s, x: s + x))


def least_squares(cells: DataFrame, targets: list[float], penalty: float = 1e-3, max_steps: int = 60, tolerance: float = 1e-9,
                  max_rate: float | None = None) -> Solution:
    """The rates with the least squared distance to ``targets``, over ``cells`` (q, tokens, and mass: tokens by domain).

    ``targets`` are shares of the present total; residuals are scaled by each domain's present share.
    A domain without tokens is left out. Steps that overshoot are halved; the optimum is unique, and
    the steps end when a projected gradient step would move no domain by more than ``tolerance``.
    ``max_rate`` caps the rates inside the projection; ``missed`` then tells what it costs.
    """
    k = len(targets)
    p = membership(cells, k)
    total, *now = cells.agg(F.sum("tokens"), *[F.sum(F.col("tokens") * x) for x in p]).first()
    here = [j for j in range(k) if (now[j] or 0.0) > 0] if total else []
    wanted = sum(targets[j] for j in here)
    if not here or not wanted:
        return Solution([0.0] * k, [0.0] * k, 0.0, 0.0, 1.0, 0, penalty, max_rate)
    share = np.array([now[j] / total for j in here])
    aim = np.array([targets[j] / wanted for j in here])
    pairs = [(a, b) for a in range(len(here)) for b in range(a + 1)]

    def spread(slopes: np.ndarray) -> list[float]:
        full = [0.0] * k
        for j, g in zip(here, slopes):
            full[j] = float(g)
        return full

    def at(slopes: np.ndarray) -> tuple[float, np.ndarray, np.ndarray, float]:
        """Dual cost, its gradient, its curvature, and the largest rate."""
        rate = Solution(spread(slopes), [], 0.0, 0.0, 0.0, 0, penalty, max_rate).rate(p)
        pull = sum((p[j] * F.lit(float(g)) for j, g in zip(here, slopes)), F.lit(0.0))
        free = (F.col("_r") > 0) if max_rate is None else (F.col("_r") > 0) & (F.col("_r") < max_rate)
        rows = cells.select((F.col("tokens") / float(total)).alias("_w"), rate.alias("_r"), pull.alias("_pull"), *[p[j].alias(f"_p{i}") for i, j in enumerate(here)])
        found = rows.agg(
            F.sum(F.col("_w") * (F.col("_r") * F.col("_pull") + penalty / 2 * (F.col("_r") - 1) ** 2)), F.max("_r"),
            *[F.sum(F.col("_w") * F.col("_r") * F.col(f"_p{i}")) for i in range(len(here))],
            *[F.sum(F.when(free, F.col("_w") * F.col(f"_p{a}") * F.col(f"_p{b}")).otherwise(0.0)) for a, b in pairs],
        ).first()
        sums = np.array(found[2 : 2 + len(here)])
        curve = np.diag(share)
        for (a, b), x in zip(pairs, found[2 + len(here) :]):
            curve[a, b] += x / penalty
            curve[b, a] = curve[a, b]
        cost = 0.5 * float(share @ slopes**2) + float(aim @ slopes) - found[0]
        return cost, share * slopes + aim - sums, curve, found[1]

    slopes, steps = np.zeros(len(here)), 0
    cost, gradient, curve, largest = at(slopes)
    while np.abs(gradient).max() > tolerance and steps < max_steps:
        step, size = -np.linalg.solve(curve, gradient), 1.0
        while steps < max_steps:
            steps += 1
            after = at(slopes + size * step)
            if after[0] <= cost + 1e-4 * size * float(gradient @ step) + 1e-15 * abs(cost):
                break
            size /= 2
        slopes = slopes + size * step
        cost, gradient, curve, largest = after
    reached = share * slopes + aim - gradient
    return Solution(spread(slopes), spread(reached), float(np.abs(gradient).max()), float(np.abs(reached - aim).max()), float(largest), steps, penalty, max_rate)


def solve(cells: DataFrame, targets: list[float], penalty: float = 1e-3, max_steps: int = 60, tolerance: float = 1e-9,
          max_rate: float | None = None) -> Column:
    """The rate of a row of ``cells`` by ``least_squares``."""
    return least_squares(cells, targets, penalty, max_steps, tolerance, max_rate).rate(membership(cells, len(targets)))


def _wanted(domains: list[str], targets: dict[str, float]) -> list[float]:
    """Targets in the order of the domains; those without one share what is left of 1 equally."""
    unnamed = [d for d in domains if d not in targets]
    rest = max(0.0, 1.0 - sum(targets.get(d, 0.0) for d in domains))
    return [targets.get(d, rest / max(1, len(unnamed))) for d in domains]


def _copies(rate: Column, key: Column) -> Column:
    """The rate rounded up or down by a hash of the key, with the rate as its mean."""
    drawn = F.pmod(F.xxhash64(F.coalesce(key.cast("string"), F.lit("")), F.lit("copies")), F.lit(1 << 30)) / float(1 << 30)
    return (F.floor(rate) + F.when(drawn < rate - F.floor(rate), 1).otherwise(0)).cast("long")


def _rated(rows: DataFrame, targets: list[float], max_rate: float | None) -> DataFrame:
    """(_llm_q, rate, largest_rate, target_distance) for each cell of ``rows`` (n_tokens, p, q); at most as many as roundings of a posterior."""
    mass = [F.sum(F.col("n_tokens") * F.get("p", F.lit(i))) for i in range(len(targets))]
    cells = stage(rows.groupBy("q").agg(F.sum("n_tokens").alias("tokens"), F.array(*mass).alias("mass")), "cells")
    found = least_squares(cells, targets, max_rate=max_rate)
    rate = found.rate(membership(cells, len(targets)))
    return stage(cells.select(F.col("q").alias("_llm_q"), rate.alias("rate"), F.lit(found.largest_rate).alias("largest_rate"), F.lit(found.missed).alias("target_distance")), "cell-rates")


def rates(documents: DataFrame, labels: DataFrame, domain: str, targets: dict[str, float], text_col: str = "text", key_col: str = "doc_id",
          per_domain: int = 2000, max_rate: float | None = None) -> DataFrame:
    """doc_id, n_tokens, p_<domain>..., rate, n_copies, largest_rate, target_distance for every row.

    Repeated rows fare alike, since ``n_copies`` draws from a hash of doc_id; rows with a NULL
    doc_id share one draw. Texts without words, NULL among them, have no tokens to add and get the
    rate of their cell. Long texts are read whole but weigh as ``EVIDENCE`` words in the posterior.
    Rates have no upper limit unless ``max_rate`` sets one: a rare domain with a large target repeats
    its few documents often. ``largest_rate`` and ``target_distance`` (the largest share missed) are
    those of the whole table, on every row. An empty table gives no rows; other columns are not read.
    """
    model = fit(documents, labels, domain, per_domain, text_col=text_col, key_col=key_col)
    texts = documents.select(F.col(key_col).alias("doc_id"), F.col(text_col).alias("text"))
    rows = stage(model.posterior(texts, ["doc_id"]), "posteriors")
    rated = _rated(rows, _wanted(model.domains, targets), max_rate)
    shares = [F.get("p", F.lit(i)).alias(f"p_{d}") for i, d in enumerate(model.domains)]
    return (
        rows.join(rated, F.col("q") == F.col("_llm_q"))
        .select("doc_id", "n_tokens", *shares, "rate", _copies(F.col("rate"), F.col("doc_id")).alias("n_copies"), "largest_rate", "target_distance")
    )


def mix(documents: DataFrame, labels: DataFrame, domain: str, targets: dict[str, float], text_col: str = "text", key_col: str = "doc_id",
        max_rate: float | None = None) -> DataFrame:
    """``documents`` with each row repeated by its number of copies (0 drops it); the columns stay.

    Rows are scored in place, so equal ids, NULL ids and extra columns need no join by id; what
    ``rates`` says of odd rows holds here too. Only the cells' rates are joined, by posterior.
    """
    model = fit(documents, labels, domain, text_col=text_col, key_col=key_col)
    packed = documents.select(
        F.struct(*[F.col(c) for c in documents.columns]).alias("_llm_row"), F.col(text_col).alias("_llm_text"), F.col(key_col).alias("_llm_key")
    )
    rated = _rated(model.posterior(packed, [], "_llm_text"), _wanted(model.domains, targets), max_rate)
    scored = model.posterior(packed, ["_llm_row", "_llm_key"], "_llm_text").join(rated, F.col("q") == F.col("_llm_q"))
    times = F.explode(F.array_repeat(F.lit(1), _copies(F.col("rate"), F.col("_llm_key")).cast("int")))
    return scored.select("_llm_row", times.alias("_llm_copy")).select("_llm_row.*")
