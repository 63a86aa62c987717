import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from quaystone.llm import pii, tagger
from quaystone.llm.queries import QUERIES, table
from quaystone.llm.tagger import Tagger

PATTERNS = {
    "email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    "ip": re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    "card": re.compile(r"[0-9]([\x20-]?[0-9])+"),
    "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}


def good(kind, s):
    d = re.sub("[^0-9]", "", s)
    if kind == "ip":
        return all(int(p) <= 255 for p in s.split("."))
    if kind == "card":
        total = sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(d)))
        return 16 <= len(d) <= 19 and total % 10 == 0
    return kind == "email" or 8 <= len(d) <= 15


def brute(t):
    return [(k, *m.span()) for k, p in PATTERNS.items() for m in p.finditer(t or "") if good(k, m[0])]


def test_patterns_equal_plain_expressions():
    r = random.Random(3)
    for _ in range(4000):
        t = "".join(r.choice(["1", "22", "300", ".", "@", "a", "b.c", "-", " ", "+", "(", ")", "4539578763621486", "+1 (918) 555-6998", "10.0.0.1", "é", "x@y.z", "00"]) for _ in range(r.randrange(1, 14)))
        assert pii.base_spans(t) == brute(t), t
    assert pii.base_spans(None) == []
    long = "1" * 50000 + " " + "a" * 50000 + "@" + " a@b.c"
    assert pii.base_spans(long)[0] == ("email", len(long) - 5, len(long))


def test_gradients():
    """The tagger's gradient equals finite differences of its loss."""
    from quaystone.llm import tagger

    m = Tagger(5, seed=1)
    for k in m.p:
        m.p[k] = m.p[k].astype(np.float64)
    r = np.random.default_rng(2)
    ids, gold = r.integers(32, 120, (3, 7)), r.integers(0, 5, (3, 7))
    as_is, tagger.np.float32 = tagger.np.float32, np.float64
    try:
        _, grads = m._loss(ids, gold)
        for k, g in grads.items():
            at = np.unravel_index(np.argmax(np.abs(g)), g.shape)
            keep = m.p[k][at]
            m.p[k][at] = keep + 1e-5
            up, _ = m._loss(ids, gold)
            m.p[k][at] = keep - 1e-5
            down, _ = m._loss(ids, gold)
            m.p[k][at] = keep
            assert abs((up - down) / 2e-5 - g[at]) < 1e-3 * max(1, abs(g[at])), k
    finally:
        tagger.np.float32 = as_is


def test_viterbi_equals_all_paths():
    from itertools import product

    m = Tagger(3)
    r = np.random.default_rng(5)
    m.p["move"] = r.normal(size=(3, 3))
    scores = [r.normal(size=(n, 3)).astype(np.float32) for n in (1, 4, 6, 3)]
    for s, got in zip(scores, m.decode(scores)):
        best = max(product(range(3), repeat=len(s)), key=lambda p: sum(s[i, t] for i, t in enumerate(p)) + sum(m.p["move"][a, b] for a, b in zip(p, p[1:])))
        assert got.tolist() == list(best)
    assert m.decode([]) == []


@pytest.fixture(scope="module")
def model(spark):
    return pii.train(table(spark, "/root/testdata/sf0.1", "documents"))


def test_other_forms_are_found_and_clean_text_is_left_alone(spark, model):
    r = random.Random(77)
    words = [w for x in table(spark, "/root/testdata/sf0.001", "documents").limit(60).collect() for w in (x.text or "").split() if not re.search("[0-9@]", w)]
    hit = tried = wrong = 0
    for kind, span in (("email", "jo.smith7@mail2.example.org"), ("ip", "1.2.3.4"), ("card", "4364625931206748"), ("phone", "+1 (918) 555-6998")) * 40:
        form = pii._varied(kind, span, r)
        before, after = (" ".join(r.choice(words) for _ in range(12)) for _ in range(2))
        ((*found,),) = pii.spans_of([f"{before} {form} {after}"], model, {})
        tried += 1
        hit += any(k == kind and a <= len(before) + 1 and b >= len(before) + 1 + len(form) for k, a, b, _ in found)
        ((*found,),) = pii.spans_of([f"{before} {pii._decoy(r)} {after}"], model, {})
        wrong += len([s for s in found if not s[3]])
    assert hit / tried > 0.7 and wrong / tried < 0.03


PHONES = ["5556986998", "06 12 34 56 78", "020 7946 0958", "030 1234567"]
#: Forms that the training's generator doesn't make.
HELD_OUT = ["44 20 7946 0958", "0161 496 0123", "0221 - 4710123", "93 412 3456"]


def test_phones_of_other_countries_and_plain_at(spark, model):
    assert all(pii._valid("phone", p) for p in [*PHONES, *HELD_OUT]) and not pii._valid("phone", "1234567") and not pii._valid("phone", "1234_567890")
    assert pii.stretches("mail to jo.smith at mail.example.org please") == [(0, 43)] and pii.stretches("we are at home. Then") == []
    r = random.Random(78)
    words = [w for x in table(spark, "/root/testdata/sf0.001", "documents").limit(60).collect() for w in (x.text or "").split() if not re.search("[0-9@]", w)]

    def share(kind, forms):
        hit = 0
        for form in forms:
            before, after = (" ".join(r.choice(words) for _ in range(12)) for _ in range(2))
            ((*found,),) = pii.spans_of([f"{before} {form} {after}"], model, {})
            hit += any(k == kind and a <= len(before) + 1 and b >= len(before) + 1 + len(form) for k, a, b, _ in found)
        return hit / len(forms)

    got = {p: share("phone", ["".join(str(r.randrange(10)) if c.isdigit() and i > 1 else c for i, c in enumerate(p)) for _ in range(40)]) for p in [*PHONES, *HELD_OUT]}
    got["at"] = share("email", [f"{r.choice(['jo.smith', 'eva.lang', 'tom.meyer'])} at {r.choice(['mail.', ''])}{r.choice(['example', 'firma', 'correo'])}.{r.choice(['org', 'de', 'es'])}" for _ in range(40)])
    assert all(got[p] > 0.7 for p in PHONES) and got["at"] > 0.5 and sum(got[k] for k in HELD_OUT) / len(HELD_OUT) > 0.5, str(got)


def test_query_keeps_base_spans(spark, sf):
    docs = {r.doc_id: r.text for r in table(spark, sf, "documents").collect()}
    got = QUERIES["op6_pii"](spark, sf).collect()
    assert len(got) == len(docs)
    for r in got:
        want = brute(docs[r.doc_id])
        text = ",".join(f"{k}:{a}:{b}" for k, a, b in want)
        assert r.base_sha256 == hashlib.sha256(text.encode()).hexdigest()
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(s[0] == k for s in want) for k in pii.KINDS]
        assert set(filter(None, text.split(","))) <= set(r.spans.split(","))


def test_edges_and_redaction(spark, model):
    df = spark.createDataFrame([(1, None), (2, ""), (3, "mail a@b.cd or +1 (918) 555-6998 now"), (3, "mail a@b.cd or +1 (918) 555-6998 now"), (None, "x" * 200000 + " 10.0.0.1")], "doc_id long, text string").withColumn("spans", F.lit("clash"))
    got = {str(r.doc_id): r for r in pii.digests(pii.find(df.drop("spans"), model, ["doc_id"]), ["doc_id"]).collect()}
    assert got["1"].spans == got["2"].spans == "" and got["3"].spans == "email:5:11,phone:15:32" and got["None"].n_ip == 1
    clean = sorted(str(r.text)[-24:] for r in pii.redact(df, model).collect())
    assert clean == sorted(["None", "", "l [EMAIL] or [PHONE] now", "l [EMAIL] or [PHONE] now", "x" * 19 + " [IP]"])
    assert pii.train(df.limit(0)) is None
    assert pii.find(df.limit(0), None, ["doc_id"]).count() == 0


def test_long_sequences_are_decoded_the_same_in_blocks(monkeypatch):
    model, rng = Tagger(9), np.random.default_rng(3)
    model.p["move"] = rng.normal(0, 2, (9, 9)).astype(np.float32)
    for n in (1, 7, 8, 9, 40, 65):
        scores = [rng.normal(0, 3, (n, 9)).astype(np.float32), rng.normal(0, 3, (3, 9)).astype(np.float32), np.zeros((0, 9), np.float32)]
        monkeypatch.setattr(tagger, "BLOCK", 1 << 20)
        plain = [x.tolist() for x in model.decode(scores)]
        monkeypatch.setattr(tagger, "BLOCK", 8)
        assert [x.tolist() for x in model.decode(scores)] == plain
        monkeypatch.setattr(tagger, "DECODED", 1)
        assert [x.tolist() for x in model.decode(scores)] == plain


def test_very_long_texts_of_numbers(spark):
    """One stretch from end to end: patterns' spans are all there, and what is seen of it is what is seen of a part."""
    docs = spark.createDataFrame([(f"write to ana{i}@mail.example or call +1 918 555 {i:04}",) for i in range(200)], "text string")
    model = pii.train(docs)
    part = "12 34 56, " * 40
    long = part * 150 + "ann@host.example 10.1.2.3 " + part * 150
    found = pii.spans_of([long, part, None, ""], model, {})
    at = len(part) * 150
    assert [s[:3] for s in found[0] if s[3]] == [("email", at, at + 16), ("ip", at + 17, at + 25)]
    assert found[2] == found[3] == []
    assert len([s for s in found[0] if not s[3]]) <= 300 * len([s for s in found[1] if not s[3]]) + 4
