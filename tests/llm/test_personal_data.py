from __future__ import annotations

import hashlib
import re

from factloom.llm import personal_data as P

RULES = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(digits):
    values = [int(c) for c in reversed(digits)]
    return sum(v if i % 2 == 0 else (2 * v - 9 if v > 4 else 2 * v) for i, v in enumerate(values)) % 10 == 0


def brute(text):
    spans, counts = [], []
    for kind, rule in RULES.items():
        n = 0
        for m in re.finditer(rule, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            ok = {"email": True, "ip": kind != "ip" or all(int(x) <= 255 for x in m[0].split(".")), "card": 13 <= len(digits) <= 19 and luhn(digits), "phone": 9 <= len(digits) <= 15}[kind]
            if ok:
                spans.append(f"{kind}:{m.start()}:{m.end()}")
                n += 1
        counts.append(n)
    return counts, hashlib.sha256(",".join(spans).encode()).hexdigest()


ODD = [
    "a@b.cx_y@d.e.f", " 1.2.3.4.5.6.7.8 256.1.1.1 0001.2.3.0255 1.2.3", "+1 (222) 333-4444+44 20 7946 0958", "4111 1111 1111 1111 5555-5555-5555-4444 4111111111111111",
    "é😀 x@y.zz 😀 +123456789012345", "9" * 20_000, "1 " * 20_000, "a@" * 5_000, "a." * 20_000 + "@b.c", None, "", "1.1.1.1 " * 5_000, "x@y.z " * 1_000, "a@b@c.d", "@x.y", "1.2.3.4@h.i",
]


def test_base_spans_against_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").unionByName(spark.createDataFrame([(-1 - i, t) for i, t in enumerate(ODD)], "doc_id long, text string"))
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in P.digest(P.find_spans(docs)).collect():
        counts, digest = brute(texts[r.doc_id])
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == counts and r.base_sha256 == digest, r.doc_id


def test_added_spans_and_redaction(spark):
    texts = [(i, f"word word\ntoken = \"{hashlib.sha1(str(i).encode()).hexdigest()}\" word {i}@mail.example.com and call 212 555 0{i % 900 + 100} now") for i in range(60)]
    found = P.find_spans(spark.createDataFrame(texts, "doc_id long, text string"))
    spans = {r.doc_id: r.spans for r in P.digest(found).collect()}
    assert all("secret:" in s and "email:" in s for s in spans.values())
    out = {r.row.doc_id: r.text for r in P.redact(found).collect()}
    assert all(out[i].startswith('word word\ntoken = "<secret>" word <email> and call') for i, _ in texts)


def test_added_spans_on_planted_text(spark):
    """Precision and recall of the kinds beyond the base ones, among decoys of the same shape."""
    import random

    draw, texts, truth = random.Random(4), [], set()
    pick = lambda: "".join(draw.choices("abcdef0123456789", k=32))
    phone = lambda: f"{draw.randint(201, 989)} {draw.randint(200, 999)} {draw.randint(1000, 9999)}"
    for i in range(400):
        text, planted = "It was a plain day. ", []
        for kind, before, value in (
            ("secret", draw.choice(["api_key = ", "password: ", "token=", "secret: "]), pick()),
            ("ssn", draw.choice(["SSN: ", "social security # "]), f"{draw.randint(100, 665)}-{draw.randint(10, 99)}-{draw.randint(1000, 9999)}"),
            ("local_phone", draw.choice(["call: ", "phone (", "tel: "]), phone()),
            ("name", draw.choice(["written by ", "from ", "contact: "]), draw.choice(P.FIRST_NAMES) + " " + draw.choice(["Miller", "Weber", "Dubois"])),
        ):
            if draw.random() < 0.4:
                text += before
                planted.append((kind, len(text), len(text) + len(value)))
                text += value + "; then more. "
            if draw.random() < 0.2:  # the same shape without meaning
                decoy = {"secret": "the_quick_brown_fox_jumps_over_it", "ssn": f"version 000-{draw.randint(10, 99)}-0000", "local_phone": f"page 1{draw.randint(10, 99)} 1{draw.randint(10, 99)} 1234", "name": "Later Monday"}[kind]
                text += decoy + " and on. "
        texts.append((i, text))
        truth |= {(i, f"{k}:{s}:{e}") for k, s, e in planted}
    found = {(r.doc_id, x) for r in P.digest(P.find_spans(spark.createDataFrame(texts, "doc_id long, text string"))).collect() for x in r.spans.split(",") if x.split(":")[0] not in (*P.BASE, "")}
    assert len(found & truth) / len(truth) >= 0.9 and len(found & truth) / len(found) >= 0.9, (len(found), len(truth), len(found & truth), sorted(truth - found)[:5], sorted(found - truth)[:5])


def test_expectation_maximisation_finds_a_bad_labeler():
    import random

    rng, counts = random.Random(1), {}
    for _ in range(20_000):
        truth = rng.random() < 0.3
        vote = lambda p, truth=truth: (1 if truth else -1) if rng.random() < p else (-1 if truth else 1)
        p = (vote(0.9), vote(0.85), vote(0.5))
        counts[p] = counts.get(p, 0) + 1
    guess, _ = P.fit_votes(counts)
    assert guess[1, 1, -1] > 0.8 and guess[-1, -1, 1] < 0.1 and abs(guess[1, 1, 1] - guess[1, 1, -1]) < 0.1


def test_odd_input(spark, odd, none):
    rows = P.digest(P.find_spans(odd)).collect()
    assert len(rows) == 6 and {r.base_sha256 for r in rows} == {hashlib.sha256(b"").hexdigest()}
    assert P.digest(P.find_spans(none)).count() == 0
