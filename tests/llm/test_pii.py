import hashlib
import random
import re

from landwatch.llm import pii as P


def luhn(d):
    return sum(sum(divmod(2 * int(c), 10)) if k % 2 else int(c) for k, c in enumerate(reversed(d))) % 10 == 0


def brute(text):
    kinds = {
        "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda s: True),
        "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda s: all(int(x) <= 255 for x in s.split("."))),
        "card": (r"[0-9]([\x20-]?[0-9])+", lambda s: 16 <= len(d := re.sub("[^0-9]", "", s)) <= 19 and luhn(d)),
        "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda s: 8 <= len(re.sub("[^0-9]", "", s)) <= 15),
    }
    return [(k, *m.span()) for k, (p, ok) in kinds.items() for m in re.finditer(p, text) if ok(m[0])]


def test_base_spans_equal_the_patterns():
    rng = random.Random(3)
    parts = ["a@b.co", "x.y+z@q-1.org.uk", "@", "a@", "@b.c", "1.2.3.4", "1.2.3.4.5", "300.1.2.3", "007.1.1.1", "4111 1111 1111 1111", "4111111111111111", "5500-0000-0000-0004",
             "1 2 3", "+1 (555) 010-9999", "+49.30.1234567", "+1", "+1 2", " ", ".", "..", "é", "naïve", "\n", "-", "12345678901234567890", "a.b@c.d@e.f", "0000000000000000", "٣"]
    for _ in range(4000):
        text = "".join(rng.choices(parts, k=rng.randint(0, 9)))
        assert P.base_spans(text) == brute(text), text


def test_long_runs_take_linear_time():
    for piece in ("a", "1", "1.", "1 ", "+1", "a@", "@", "."):
        P.base_spans(piece * 60_000)


def test_query_digest_and_added_terms(spark, docs_of):
    fillers = [" ".join(f"{chr(97 + i // 26)}{chr(97 + i % 26)}{chr(97 + j)}abcd" for j in range(20)) for i in range(60)]
    rows = [(i, f"{fillers[i]} zorgulan writes from jo@zo.org here. {fillers[i][:30]}") for i in range(5)]
    rows += [(5, "only zorgulan is named"), (6, None), (7, ""), (8, "call +1 555 010 9999 ok")] + [(i, fillers[i]) for i in range(9, 60)]
    docs = docs_of(rows)
    got = {r["doc_id"]: r for r in P.digest(P.personal_data(docs)).collect()}
    assert len(got) == len(rows)
    for i, t in rows:
        base = brute(t or "")
        assert got[i]["base_sha256"] == hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in base).encode()).hexdigest()
        assert [got[i][f"n_{k}"] for k in P.KINDS] == [sum(b[0] == k for b in base) for k in P.KINDS]
        added = [s for s in got[i]["spans"].split(",") if s.startswith("term:")]
        words = {(t or "")[int(a):int(b)] for _, a, b in (s.split(":") for s in added)}
        assert words == ({"zorgulan", "writes", "from", "here"} & set(re.findall(r"\w+", t or "")))
    clean = {r["doc_id"]: r["text"] for r in P.sanitise(docs).collect()}
    assert clean[5] == "only [TERM] is named" and clean[6] is None and clean[8] == "call [PHONE] ok"
    assert "jo@zo.org" not in clean[0] and clean[10] == fillers[10]


def test_copies_of_one_passage_disclose_nothing(spark, docs_of):
    docs = docs_of([(i, "quokkas write to an@im.al about marsupials") for i in range(50)])
    assert P.disclosing_terms(docs).collect() == []


def test_empty_table_null_ids_and_repeated_rows(spark, docs_of):
    assert P.digest(P.personal_data(docs_of([]))).collect() == []
    got = P.digest(P.personal_data(docs_of([(None, "a@b.cc"), (1, "a@b.cc"), (1, "a@b.cc")]))).collect()
    assert [r["spans"] for r in got] == ["email:0:6"] * 3


def test_copies_of_every_document_change_no_term(spark, docs_of):
    fillers = [" ".join(f"{chr(97 + i // 26)}{chr(97 + i % 26)}{chr(97 + j)}abcd" for j in range(20)) for i in range(60)]
    rows = [(i, f"{fillers[i]} zorgulan writes from jo@zo.org here. {fillers[i]}") for i in range(3)] + [(i, fillers[i]) for i in range(3, 60)]
    once = {tuple(r) for r in P.disclosing_terms(docs_of(rows)).collect()}
    copied = {tuple(r) for r in P.disclosing_terms(docs_of(rows * 10)).collect()}
    assert {t for t, *_ in once} == {"zorgulan", "writes", "from", "here"} and once == copied


def test_far_short_and_alphanumeric_terms(spark, docs_of):
    """A heading's names and the number of a file disclose the address in the footer."""
    fillers = [" ".join(f"{chr(97 + i // 26)}{chr(97 + i % 26)}{chr(97 + j)}abcd" for j in range(20)) for i in range(60)]
    rows = [(i, f"{fillers[i]} zorgulan Bo 王小 K7x9 {fillers[i]} {fillers[i]} end of letter jo@zo.org") for i in range(5)]
    rows += [(i, f"{fillers[i]} end of letter") for i in range(5, 60)] + [(60, "Bo k7X9 only")]
    docs = docs_of(rows)
    assert {r["term"] for r in P.disclosing_terms(docs).collect()} == {"zorgulan", "bo", "王小", "k7x9"}
    assert {r["text"] for r in P.sanitise(docs).where("doc_id = 60").collect()} == {"[TERM] [TERM] only"}


def test_far_words_of_one_passage_disclose_nothing(spark, docs_of):
    """A long passage shared by otherwise different documents is one context for the words in its middle."""
    passage = " ".join(f"{chr(97 + i)}{chr(97 + j)}passage" for i in range(6) for j in range(10))
    rows = [(i, f"front{i}x {passage} quokkas {passage} to an@im.al {passage}") for i in range(20)] + [(i, "nothing of it") for i in range(20, 90)]
    assert "quokkas" not in {r["term"] for r in P.disclosing_terms(docs_of(rows)).collect()}


def test_texts_without_a_marked_word_are_not_gone_through(monkeypatch):
    marks = P.np.zeros(P.SLOTS, bool)
    marks[P.slot("bob")] = True
    assert P.marked_words("Bob met bob_BOB, not bobby", marks) == [(0, 3, "bob"), (8, 11, "bob"), (12, 15, "bob")]
    word = P.WORD

    class Once:
        findall = staticmethod(word.findall)

    monkeypatch.setattr(P, "WORD", Once)
    assert P.marked_words("nobody here " * 1000, marks) == [] == P.marked_words("", marks)
