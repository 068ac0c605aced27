import hashlib
import math
import random
import re

from hypothesis import given, settings
from hypothesis import strategies as st

from halyard.llm import pii
from halyard.llm.queries import op3_pii
from tests.conftest import SF_SMALL
from tests.llm.conftest import DOCS, as_files


def plain(text):
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(x) <= 255 for x in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        digits = [int(c) for c in m[0] if c.isdigit()]
        doubled = [d if k % 2 == 0 else d * 2 - 9 * (d > 4) for k, d in enumerate(digits[::-1])]
        if 16 <= len(digits) <= 19 and sum(doubled) % 10 == 0:
            out.append(("card", *m.span()))
    out += [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 8 <= sum(c.isdigit() for c in m[0]) <= 15]
    return out


@settings(max_examples=600, deadline=None)
@given(st.one_of(st.text("ab@.1234567890 -+()%_\n9é", max_size=50), st.text("0123456789 -", max_size=60), st.text("1.2@a", max_size=40)))
def test_patterns(text):
    assert pii.base_spans(text) == plain(text)


def test_whole_table(spark):
    docs = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").collect()}
    rows = op3_pii(spark, SF_SMALL).collect()
    assert len(rows) == len(docs)
    for r in rows:
        base = plain(docs[r["doc_id"]])
        written = ",".join(f"{k}:{s}:{e}" for k, s, e in base)
        assert [r[f"n_{k}"] for k in pii.KINDS] == [sum(b[0] == k for b in base) for k in pii.KINDS]
        assert r["base_sha256"] == hashlib.sha256(written.encode()).hexdigest() and r["spans"].startswith(written)
        assert base or r["spans"] == ""


FILLER = "the plain text of the rest goes on and on in the same few words as all of the rest goes on"


def corpus():
    """`codename` stands in the documents of one address alone, far from it; `red` in two of them and in three others; the
    filler everywhere. 900 holds an address of its own and a word of its own."""
    other = [(100 + k, f"{FILLER} number {'abcdefghij'[k % 10]}{' red' if k < 3 else ''}", "en", "s", 1) for k in range(60)]
    told = [(k, f"Codename {FILLER} meets me@secret.example.org the codename {w}", "en", "s", 1) for k, w in enumerate(["red", "red", "of"])]
    return told + other + [(900, f"zanzibar {FILLER} you@only.example.org", "en", "s", 1), (901, None, "en", "s", 1)]


def brute_terms(rows):
    """{(row, start, end, removed)} by counting every pair of an entity and a word."""
    rows = [(k, t or "") for k, t, *_ in rows]
    spans = {k: pii.base_spans(t) for k, t in rows}
    names = {k: {pii.entity_name(s[0], t[s[1] : s[2]]) for s in spans[k]} for k, t in rows}
    words = {k: {w.lower() for w in re.findall(r"[^\W\d_]+", t)} for k, t in rows}
    n, out = len(rows), set()
    for k, t in rows:
        for m in re.finditer(r"[^\W\d_]+", t):
            if any(a < m.end() and m.start() < b for _, a, b in spans[k]):
                continue
            shares = []
            for e in names[k]:
                n_e, n_t = sum(e in x for x in names.values()), sum(m[0].lower() in x for x in words.values())
                n_te = sum(e in names[j] and m[0].lower() in words[j] for j, _ in rows)
                shares.append(math.log2(n_te * n / (n_t * n_e)) / math.log2(n / n_e))
            if shares and max(shares) >= pii.REVEAL:
                out.add((k, m.start(), m.end(), max(shares) >= pii.REMOVE))
    return out


def found_terms(docs):
    return {(r["doc_id"], t["start"], t["end"], t["removed"]) for r in pii.find_pii(docs, ["doc_id"]).collect() for t in r["terms"]}


def test_revealing_words(spark, tmp_path):
    docs = as_files(spark, tmp_path, corpus(), DOCS, "d")
    rows = {r["doc_id"]: r for r in pii.find_pii(docs, ["doc_id", "text"]).collect()}
    words = lambda r: {r["text"][t["start"] : t["end"]] for t in r["terms"]}
    assert all(words(rows[k]) == {"Codename", "codename", "meets"} for k in range(3))
    assert words(rows[900]) == {"zanzibar"}
    assert all(not rows[100 + k]["terms"] and not rows[100 + k]["base"] for k in range(60))
    clean = {r["doc_id"]: r["text"] for r in pii.sanitise(docs).collect()}
    assert clean[0] == f" {FILLER}  [EMAIL] the  red" and clean[100] == corpus()[3][1] and clean[901] is None
    assert found_terms(docs) == brute_terms(corpus())


@settings(max_examples=6, deadline=None)
@given(st.integers(0, 1 << 30))
def test_terms_equal_all_pairs(spark, tmp_path_factory, seed):
    """Entities and words that share their document sets, or not; hot ones, lists of entities, copies."""
    rng = random.Random(seed)
    words = [a + b for a in "bcdfgh" for b in "aeiouy"]
    rows = []
    for k in range(80):
        parts = rng.choices(words[: rng.choice((4, 36))], k=rng.randint(0, 12)) + rng.choices(["x@a.bc", "y@a.bc", "z@a.bc", f"own{k}@a.bc", "10.0.0.1"], k=rng.choice((0, 0, 1, 4)))
        rng.shuffle(parts)
        rows.append((k, " ".join(parts), "en", "s", 1))
    rows += [(200 + k, rows[k % 3][1], "en", "s", 1) for k in range(20)]
    assert found_terms(as_files(spark, tmp_path_factory.mktemp("pii"), rows, DOCS, "d")) == brute_terms(rows)


def test_copies_reveal_as_one_does(spark, tmp_path):
    rows = [(k, "rare words by a@b.cd here", "en", "s", 1) for k in range(5)] + [(9 + k, f"other {k} text", "en", "s", 1) for k in range(20)]
    found = found_terms(as_files(spark, tmp_path, rows, DOCS, "d"))
    assert found == brute_terms(rows) and len(found) == 5 * 4 and all(x[3] for x in found)


def test_occurrences_leave_spans_alone():
    spans = [{"start": 0, "end": 12}, {"start": 2, "end": 5}, {"start": 20, "end": 24}]
    found = pii.occurrences("one two one two Two one one.", spans, {"one": True, "two": False})
    assert [(t["start"], t["removed"]) for t in found] == [(12, False), (16, False), (24, True)]


def test_awkward_rows(odd, empty):
    assert all(not r["base"] and not r["terms"] for r in pii.find_pii(odd, ["doc_id"]).collect())
    assert pii.find_pii(odd, ["doc_id"]).count() == odd.count()
    assert pii.find_pii(empty, ["doc_id"]).count() == 0 and pii.sanitise(empty).count() == 0
    clash = odd.withColumnRenamed("source", "base").withColumnRenamed("lang", "terms").withColumnRenamed("n_chars", "row")
    out = pii.sanitise(clash)
    assert out.columns == clash.columns and sorted(map(str, out.select("text").collect())) == sorted(map(str, odd.select("text").collect()))


def test_overlapping_spans_are_shown_once():
    base = [{"kind": "card", "start": 2, "end": 8}, {"kind": "phone", "start": 1, "end": 6}]
    assert pii.cleaned("0123456789", base, []) == "0[PHONE]89"
