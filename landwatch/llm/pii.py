"""Information-theoretic sanitisation of personal data.

Patterns find the protected entities: e-mail and IP addresses, card and phone numbers. Over the
whole corpus, the terms of each entity's documents are counted: a term t (any run of letters and
digits outside the protected values) discloses an entity e to the
degree PMI(t, e) / IC(e) = log(p(e|t) / p(e)) / log(1 / p(e)), which is 1 where the term is only
ever seen with the entity. Terms at or above ``disclose`` are masked wherever they occur, also in
documents that do not name the entity: generalised, or removed at or above ``remove``.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from bisect import bisect_left
from collections import Counter
from collections.abc import Callable, Iterable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from landwatch.llm.common import stage

KINDS = ("email", "ip", "card", "phone")
TERM = "term"
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# A match that fails at the first digit of a run fails at the others, so each run is tried once.
IP = re.compile(r"(?<![0-9])[0-9]++\.([0-9]++)\.([0-9]++)\.([0-9]++)")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
WORD = re.compile(r"[^\W_]+")
#: Slots of the fixed-size table that tells words which may be terms in question from all others.
SLOTS = 1 << 20
#: Words of four letters and more on each side of an entity or term that make its surroundings.
REACH, LETTERS = 8, 4
#: Documents that tell common words, and the most such words kept: a lower bound of a word's documents spares pairs that cannot disclose.
SAMPLE, COMMON = 4096, 1 << 17
#: Pairs a task counts before it hands them on.
HELD = 50_000


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        x = int(d) * (1 + k % 2)
        total += x - 9 if x > 9 else x
    return total % 10 == 0


def emails(text: str) -> Iterable[tuple[int, int]]:
    """From each @, back over the local part and on over the domain: linear in the text."""
    done, at = 0, text.find("@")
    while at >= 0:
        lo = at
        while lo > done and text[lo - 1] in LOCAL:
            lo -= 1
        m = DOMAIN.match(text, at + 1) if lo < at else None
        if m:
            done = m.end()
            yield lo, done
        else:
            done = at + 1  # no later match can reach over this @
        at = text.find("@", max(at + 1, done))


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) in order of kind and start; leftmost matches that do not overlap within a kind."""
    out = [("email", lo, hi) for lo, hi in emails(text)]
    for m in IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p[-9:] if len(p) > 9 else p) <= 255 for p in m[0].split(".")):
            out.append(("ip", *m.span()))
    for m in CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 16 <= len(digits) <= 19 and luhn(digits):
            out.append(("card", *m.span()))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 8 <= sum(c in "0123456789" for c in m[0]) <= 15:
                out.append(("phone", *m.span()))
    return out


def written(spans: Iterable[tuple[str, int, int]]) -> str:
    return ",".join(f"{kind}:{lo}:{hi}" for kind, lo, hi in spans)


def read(spans: str) -> list[tuple[str, int, int]]:
    return [(k, int(a), int(b)) for k, a, b in (s.split(":") for s in spans.split(",") if s)]


def entity(kind: str, value: str) -> int:
    """A protected value as a number: its letters and digits only, so spellings of one number agree."""
    plain = "".join(c for c in value.lower() if c.isalnum() or c in "@.") if kind in ("email", "ip") else "".join(c for c in value if c in "0123456789")
    return int.from_bytes(hashlib.blake2b(f"{kind}:{plain}".encode("utf-8", "replace"), digest_size=8).digest(), "little", signed=True)


def outside(text: str, spans: list[tuple[str, int, int]]) -> list[tuple[int, int]]:
    """The terms of the text that overlap no span."""
    ordered = sorted((lo, hi) for _, lo, hi in spans)
    out, k, reach = [], 0, -1
    for m in WORD.finditer(text):
        lo, hi = m.span()
        while k < len(ordered) and ordered[k][0] < hi:
            reach = max(reach, ordered[k][1])
            k += 1
        if reach <= lo:
            out.append((lo, hi))
    return out


def _hashed(words: Iterable[str]) -> int:
    return int.from_bytes(hashlib.blake2b(" ".join(words).encode("utf-8", "replace"), digest_size=8).digest(), "little", signed=True)


def contexts(text: str, spans: list[tuple[str, int, int]], most: Callable[[int], float], common: dict[str, int]) -> Iterable[tuple[int, str, set[int]]]:
    """(entity, term, contexts) for every entity and term of the document that can disclose.

    ``most`` gives the documents that a term of an entity may have, 0 for an entity out of
    question; ``common`` a lower bound of a term's. A term beside the entity has the entity's
    surroundings as context, one further off both surroundings; equal surroundings are one context.
    """
    limits = {(lo, hi): (code, limit) for kind, lo, hi in spans for code in (entity(kind, text[lo:hi]),) if (limit := most(code)) > 0}
    if not limits:
        return
    words = outside(text, spans)
    names = [text[lo:hi].lower() for lo, hi in words]
    starts = [lo for lo, _ in words]
    long = [i for i, w in enumerate(names) if len(w) >= LETTERS and w.isalpha()]

    def around(i: int) -> tuple[int, int, int]:
        """Surroundings of the place before term i, and the terms they reach over."""
        at = bisect_left(long, i)
        lo, hi = at - REACH, at + REACH
        return _hashed(names[j] for j in long[max(lo, 0) : hi]), long[lo] if lo >= 0 else 0, long[hi - 1] + 1 if hi <= len(long) else len(names)

    near: dict[int, dict[str, set[int]]] = {}
    known: dict[int, tuple[float, int]] = {}
    for (lo, _), (code, limit) in sorted(limits.items()):
        place, left, right = around(bisect_left(starts, lo))
        known.setdefault(code, (limit, place))
        beside = near.setdefault(code, {})
        for term in set(names[left:right]):
            beside.setdefault(term, set()).add(place)
    first: dict[str, int] = {}
    for i, w in enumerate(names):
        first.setdefault(w, i)
    places: dict[str, int] = {}
    for code, (limit, place) in known.items():
        for term, i in first.items():
            if common.get(term, 0) > limit:
                continue
            here = near[code].get(term)
            if here is None:
                if term not in places:
                    places[term] = around(i)[0]
                here = {_hashed((str(place), str(places[term])))}
            yield code, term, here


def slot(term: str) -> int:
    return zlib.crc32(term.encode("utf-8", "replace")) % SLOTS


def marked_words(text: str, marks: np.ndarray) -> list[tuple[int, int, str]]:
    """(start, end, word) of the words whose slot is marked. Most texts hold none; only the others are gone through place by place."""
    held = {w for w in map(str.lower, set(WORD.findall(text))) if marks[slot(w)]}
    return [(*m.span(), w) for m in WORD.finditer(text) if (w := m[0].lower()) in held] if held else []


def _table(terms: DataFrame) -> np.ndarray:
    """Which of the ``SLOTS`` slots any term falls in: one bit each, whatever the number of terms."""
    marks = np.zeros(SLOTS, bool)
    marks[terms.select((F.crc32("term") % SLOTS).alias("s")).distinct().toArrow()["s"].to_numpy()] = True
    return marks


def detect(documents: DataFrame, text_col: str = "text", key_col: str = "doc_id") -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base (spans as text) of every whole text; NULL is empty."""

    @F.pandas_udf("n_email long, n_ip long, n_card long, n_phone long, base string")
    def found(texts: pd.Series) -> pd.DataFrame:
        rows = []
        for t in texts:
            spans = base_spans(t or "")
            n = Counter(s[0] for s in spans)
            rows.append((*(n[k] for k in KINDS), written(spans)))
        return pd.DataFrame(rows, columns=[*(f"n_{k}" for k in KINDS), "base"])

    return documents.select(F.col(key_col).alias("doc_id"), found(F.col(text_col)).alias("_found")).select("doc_id", "_found.*")


def _common(texts: DataFrame, total: int) -> dict[str, int]:
    """The most frequent words of about ``SAMPLE`` texts, with the number of these texts that hold them outside protected values."""

    def words(batches: Iterable[pd.DataFrame]) -> Iterable[pd.DataFrame]:
        for pdf in batches:
            counts = Counter(w for t in pdf["text"] if t for w in {t[lo:hi].lower() for lo, hi in outside(t, base_spans(t))})
            yield pd.DataFrame(list(counts.items()), columns=["term", "n"])

    some = texts.where(F.pmod(F.xxhash64("text", F.lit("common")), F.lit(1 << 32)) < SAMPLE / total * (1 << 32))
    counts = some.mapInPandas(words, "term string, n long").groupBy("term").agg(F.sum("n").alias("n")).where("n > 3")
    return {r["term"]: r["n"] for r in counts.orderBy(F.desc("n"), "term").limit(COMMON).collect()}


def disclosing_terms(documents: DataFrame, support: int = 3, disclose: float = 0.9, remove: float = 0.98, text_col: str = "text") -> DataFrame:
    """term, disclosure, action: the terms that reveal some entity, over all documents.

    p(e|t) is the number of documents with e and t over the number of documents with t, and p(e)
    that of documents with e over all, each row of ``documents`` counted. Below ``support``
    different contexts a term says nothing, so copies of one passage do not make its words disclosing. Counts are combined in the tasks before each shuffle; a name in a third of all
    documents is one row per task. Entities with fewer spans than ``support``, and words that by a
    sample stand in too many documents to disclose the entity, are left out of the pairs, which
    changes no result. Corpus-wide only words that share a slot with a term in
    question are counted, and equal terms are joined exactly afterwards.
    """
    if not 0 < disclose <= remove:
        raise ValueError("0 < disclose <= remove is required")
    texts = documents.select(F.col(text_col).alias("text"))

    def named(batches: Iterable[pd.DataFrame]) -> Iterable[pd.DataFrame]:
        for pdf in batches:
            rows: dict[int, list[int]] = {}
            for t in pdf["text"]:
                for code, times in Counter(entity(kind, t[lo:hi]) for kind, lo, hi in base_spans(t or "")).items():
                    row = rows.setdefault(code, [0, 0])
                    row[0] += 1
                    row[1] += times
            yield pd.DataFrame([(code, *row) for code, row in rows.items()], columns=["entity", "n", "times"])

    entities = texts.mapInPandas(named, "entity long, n long, times long").groupBy("entity").agg(F.sum("n").alias("times"), F.sum("times").alias("spans"))
    entities = stage(entities.where(F.col("spans") >= support).drop("spans"), "pii-entities")
    total = max(documents.count(), 2)
    # p(e|t) >= p(e) ** (1 - disclose) bounds the documents of t by those of e; each slot has the largest bound of its entities.
    bound = (F.pow("times", F.lit(disclose)) * float(total) ** (1 - disclose)) * (1 + 1e-6)
    bounds = entities.groupBy(F.pmod("entity", F.lit(SLOTS)).alias("s")).agg(F.max(bound).alias("most")).toArrow()
    limits = np.zeros(SLOTS)
    limits[bounds["s"].to_numpy()] = bounds["most"].to_numpy()
    common = _common(texts, total)

    def beside(batches: Iterable[pd.DataFrame]) -> Iterable[pd.DataFrame]:
        held: dict[tuple[int, str], list] = {}

        def rows() -> pd.DataFrame:
            # More contexts than the support asks for change nothing.
            out = [(e, t, c, n if k == 0 else 0) for (e, t), (n, cs) in held.items() for k, c in enumerate(sorted(cs)[:support])]
            return pd.DataFrame(out, columns=["entity", "term", "context", "n"])

        for pdf in batches:
            for t in pdf["text"]:
                for code, term, places in contexts(t or "", base_spans(t or ""), lambda e: limits[e % SLOTS], common):
                    pair = held.setdefault((code, term), [0, set()])
                    pair[0] += 1
                    if len(pair[1]) < support:
                        pair[1] |= places
                if len(held) >= HELD:
                    yield rows()
                    held = {}
        yield rows()

    seen = texts.mapInPandas(beside, "entity long, term string, context long, n long").groupBy("entity", "term", "context").agg(F.sum("n").alias("n"))
    pairs = seen.groupBy("entity", "term").agg(F.count("*").alias("contexts"), F.sum("n").alias("together"))
    pairs = stage(pairs.where(F.col("contexts") >= support), "pii-pairs")
    marks = _table(pairs)

    def frequencies(batches: Iterable[pd.DataFrame]) -> Iterable[pd.DataFrame]:
        counts: Counter[str] = Counter()
        for pdf in batches:
            for t in pdf["text"]:
                held = {w for w in map(str.lower, set(WORD.findall(t or ""))) if marks[slot(w)]}
                if held and (spans := base_spans(t)):
                    held &= {t[lo:hi].lower() for lo, hi in outside(t, spans)}
                counts.update(held)
            if len(counts) > 200_000:
                yield pd.DataFrame(list(counts.items()), columns=["term", "n"])
                counts.clear()
        yield pd.DataFrame(list(counts.items()), columns=["term", "n"])

    if not marks.any():
        return pairs.select("term", F.lit(0.0).alias("disclosure"), F.lit("").alias("action")).limit(0)
    holding = texts.mapInPandas(frequencies, "term string, n long").groupBy("term").agg(F.sum("n").alias("documents"))
    prior = F.col("times") / F.lit(float(total))
    given = F.least(F.col("together") / F.col("documents"), F.lit(1.0))
    share = F.when(prior >= 1, F.lit(0.0)).otherwise(F.log(given / prior) / -F.log(prior))
    scored = pairs.join(holding, "term").join(entities, "entity").select("term", share.alias("disclosure")).where(F.col("disclosure") >= disclose)
    most = scored.groupBy("term").agg(F.max("disclosure").alias("disclosure"))
    return most.withColumn("action", F.when(F.col("disclosure") >= remove, "remove").otherwise("generalise"))


def term_spans(documents: DataFrame, terms: DataFrame, text_col: str = "text", key_col: str = "doc_id") -> DataFrame:
    """doc_id, terms (array of ``start:end:action``) of the documents that hold a disclosing term outside a base span."""
    marks = _table(terms)

    def words(batches: Iterable[pd.DataFrame]) -> Iterable[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for doc, t in zip(pdf["doc_id"], pdf["text"]):
                hits = marked_words(t or "", marks)
                if hits:
                    free = set(outside(t, base_spans(t)))
                    rows += [(doc, *h) for h in hits if h[:2] in free]
            yield pd.DataFrame(rows, columns=["doc_id", "lo", "hi", "term"])

    rows = documents.where(F.col(key_col).isNotNull()).select(F.col(key_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    if not marks.any():
        return rows.select("doc_id", F.array().cast("array<string>").alias("terms")).limit(0)
    hits = rows.mapInPandas(words, "doc_id long, lo long, hi long, term string").join(terms.select("term", "action"), "term")
    return hits.groupBy("doc_id").agg(F.collect_set(F.concat_ws(":", "lo", "hi", "action")).alias("terms"))


def personal_data(documents: DataFrame, support: int = 3, disclose: float = 0.9, remove: float = 0.98, text_col: str = "text", key_col: str = "doc_id") -> DataFrame:
    """doc_id, the four counts, base, terms for every row: base spans and the method's spans.

    NULL and empty texts have no span. Spans of terms never overlap base spans, which all stay. A
    doc_id names one text (equal rows repeated under one id get equal spans); a row with a NULL
    doc_id gets its base spans only. Long texts are searched whole, in time linear in their length;
    a disclosure equal to ``disclose`` counts. An empty table gives no rows.
    """
    terms = stage(disclosing_terms(documents, support, disclose, remove, text_col), "pii-terms")
    found = stage(term_spans(documents, terms, text_col, key_col), "pii-term-spans")
    rows = detect(documents, text_col, key_col)
    return rows.join(found, "doc_id", "left").withColumn("terms", F.coalesce("terms", F.array().cast("array<string>")))


def digest(found: DataFrame) -> DataFrame:
    """The registered query's columns: base_sha256 and all spans as text, in order of kind and start."""

    @F.pandas_udf("string")
    def every(base: pd.Series, terms: pd.Series) -> pd.Series:
        out = []
        for b, ts in zip(base, terms):
            added = sorted((int(lo), int(hi)) for lo, hi, _ in (t.split(":") for t in ts))
            out.append(",".join([*([b] if b else []), *(f"{TERM}:{lo}:{hi}" for lo, hi in added)]))
        return pd.Series(out)

    return found.select("doc_id", *(f"n_{k}" for k in KINDS), F.sha2("base", 256).alias("base_sha256"), every("base", "terms").alias("spans"))


def masked(text: str, terms: Iterable[str]) -> str:
    """The text with base spans replaced by their kind in brackets, and terms generalised or removed.

    Where spans of two kinds overlap, they are covered by one bracket of the first kind.
    """
    marks = [(lo, hi, f"[{kind.upper()}]") for kind, lo, hi in base_spans(text)]
    for t in terms:
        lo, hi, action = t.split(":")
        marks.append((int(lo), int(hi), "" if action == "remove" else f"[{TERM.upper()}]"))
    out, at = [], 0
    for lo, hi, mark in sorted(marks):
        if hi <= at:
            continue
        if lo >= at:
            out += [text[at:lo], mark]
        at = hi
    return "".join([*out, text[at:]])


def sanitise(documents: DataFrame, support: int = 3, disclose: float = 0.9, remove: float = 0.98, text_col: str = "text", key_col: str = "doc_id") -> DataFrame:
    """``documents`` with the same rows and columns, and personal data masked in ``text_col`` (NULL stays NULL)."""
    terms = stage(disclosing_terms(documents, support, disclose, remove, text_col), "pii-terms")
    found = stage(term_spans(documents, terms, text_col, key_col), "pii-term-spans")

    @F.pandas_udf("string")
    def mask(texts: pd.Series, spans: pd.Series) -> pd.Series:
        return pd.Series([None if t is None else masked(t, s if s is not None else ()) for t, s in zip(texts, spans)])

    found = found.select(F.col("doc_id").alias("_llm_key"), F.col("terms").alias("_llm_terms"))
    rows = documents.join(found, F.col(key_col).cast("long") == F.col("_llm_key"), "left")
    return rows.withColumn(text_col, mask(F.col(text_col), F.col("_llm_terms"))).select(documents.columns)
