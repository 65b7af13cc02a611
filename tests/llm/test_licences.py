from __future__ import annotations

import random
import re
import time
from collections import Counter

from factloom.llm import licences as L

SMALL = (("a", "Released under the MIT License."), ("b", "free of charge to any person free of charge to all"), ("c", "x y"), ("d", "under the MIT license version two or later"))


def brute(text, templates, least=0.8):
    """Every run of words against every template by plain counting, then greedily without overlap."""
    spans = [m.span() for m in re.finditer(r"[^\W_]+", text)]
    words = [text[s:e].lower().replace("licence", "license") for s, e in spans]
    found = []
    for name, template in templates:
        t = [w.replace("licence", "license") for w in re.findall(r"[^\W_]+", template.lower())]
        wanted = Counter(zip(t, t[1:]))
        a = sum(wanted.values())
        for i in range(len(words)):
            for j in range(i + 2, min(len(words), i + 2 + 2 * a) + 1):
                b = Counter(zip(words[i:j], words[i + 1 : j]))
                score = 2 * sum((wanted & b).values()) / (a + j - i - 1)
                if score >= least:
                    found.append((-score, spans[i][0] - spans[j - 1][1], spans[i][0], name, spans[j - 1][1], j - i - 1))
    taken = []
    for score, _, start, name, end, n in sorted(found):
        if all(end <= s or start >= x for _, _, s, x, _ in taken):
            taken.append((name, -score, start, end, n))
    return sorted(taken, key=lambda x: x[2])


def test_against_brute_force():
    matcher, draw = L.Matcher(SMALL, 0.8), random.Random(1)
    words = "released under the mit licence License. free of charge, to any person all x y version two or later _ é İ word\n".split(" ")
    texts = [" ".join(draw.choices(words, k=draw.randint(0, 40))) for _ in range(300)]
    texts += ["free of charge to any person " * 4, "x y x y y x", "(x)y-x_y", "İx y ß"]
    parts = [t for _, t in SMALL] + ["and", "more of it;", "free of charge"]
    texts += [" ".join(draw.choices(parts, k=draw.randint(1, 6))) for _ in range(200)]
    for text in texts:
        assert matcher.passages(text) == brute(text, SMALL), text


def names(text):
    return [x[0] for x in L.Matcher(L.TEMPLATES, L.DICE).passages(text)]


def test_known_licences_anywhere():
    for name, text in L.TEMPLATES:
        assert names(f"Some words before it, {text.upper()} and some that follow") == [name]
        assert names("Copyright (c) 2020 Someone.\n# " + text.replace(" ", "\n# ")) == [name]
    assert names("it is released under the MIT License since 2019, and was licensed under CC BY-NC 4.0 before") == ["mit-notice", "cc-by-nc-4.0-notice"]
    assert names("a b c " * 50) == [] == names("the license of the software is free")


def test_long_texts_take_linear_time():
    matcher, took = L.Matcher(L.TEMPLATES, L.DICE), []
    for n in (2_000, 8_000):
        start = time.process_time()
        assert len(matcher.passages("Released under the MIT License. " * n)) == n
        took.append(time.process_time() - start)
    assert took[1] < 8 * took[0]


def test_odd_input(spark, odd, none):
    assert L.scan_licences(odd).count() == 0 and L.scan_licences(none).count() == 0
    df = spark.createDataFrame([(7, "x" * 100_000 + "\nReleased under the MIT License."), (7, "x" * 100_000 + "\nReleased under the MIT License."), (None, "Released under the MIT License.")], "doc_id long, text string")
    assert [(r.doc_id, r.passage) for r in L.scan_licences(df).collect()] == [(7, "Released under the MIT License")] * 2 + [(None, "Released under the MIT License")]
