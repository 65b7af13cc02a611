from __future__ import annotations

import re

from factloom.llm import decontamination as D

ITEM = "What is the total cost when Bob buys 12 apples and Carol buys 7.5 kg of flour at 12 dollars each in town"


def run(spark, texts, items=((1, ITEM), (2, "of only six words here now")), **kw):
    docs = spark.createDataFrame(list(texts), "doc_id long, text string")
    return D.contaminated(docs, spark.createDataFrame(list(items), "item_id long, text string"), **kw)


def test_reparameterised_questions(spark):
    texts = [
        (1, "Intro text here. what is the total cost when Ann buys 30 apples and Dave buys 9 kg of flour at 30 dollars each in town ok"),
        (2, "what is the total cost when Ann buys 30 apples and Dave buys 9 kg of flour at 31 dollars each in town"),
        (3, ITEM), (4, "What is the total cost when Bob buys a lot of other things that nobody counts in any town at all"),
    ]
    for size in (1 << 24, 0):  # broadcast, and by shuffle
        out = {(r.doc_id, r.item_id): (r.run, r.changed) for r in run(spark, texts, broadcast_bytes=size).collect()}
        assert out == {(1, 1): (23, 5), (3, 1): (23, 0)}


def test_copies_beside_an_inconsistent_slot(spark):
    plain = [f"w{c}" for c in "abcdefghijklmnopq"]
    item = " ".join(["start", "3", "and", "4", "ends", *plain[:9], "break", *plain])
    texts = [
        (1, ITEM.replace("12 dollars", "15 dollars")),  # 18 words as they are, then 12 stands for 15 too
        (2, ITEM.replace("12 apples", "15 apples")),  # 8 and 14 words as they are
        (3, " ".join(["start", "7", "and", "7", "ends", *plain[:9], "other", *plain])),  # 14 inconsistent words, and a second run
        (4, ITEM.replace("12 apples", "15 apples").replace("Carol", "Bob")),  # no 13 words as they are
    ]
    out = {(r.doc_id, r.item_id): (r.run, r.changed) for r in run(spark, texts, [(1, ITEM), (2, item)]).collect()}
    assert out == {(1, 1): (18, 0), (2, 1): (14, 0), (3, 2): (17, 0)}


def test_names_in_any_place_and_case(spark):
    item = "Mary has 12 apples. Mary gives 3 apples to Tom each day. Mary then eats 2. How many apples are left for Mary now?"
    names = "we saw Ann and Bob and Carl and Dora and Emil and Fritz and Gina and Hugo and Ida at the gate"
    texts = [
        (1, "Notes first. " + item.replace("Mary", "Anna").replace("Tom", "Bob").replace("12", "15").replace("3", "4")),
        (2, names.lower()), (3, names.upper()), (4, names.replace(" ", "\n")), (5, "x y z " + ITEM.upper().replace(" ", " \n ")),
        # consistent from the second sentence's second word on
        (6, item.replace("Mary", "Anna", 2).replace("Tom", "Bob").replace("12", "15").replace("3", "4")),
    ]
    for size in (1 << 24, 0):
        out = {(r.doc_id, r.item_id): (r.run, r.changed) for r in run(spark, texts, [(1, item), (2, names), (3, ITEM)], broadcast_bytes=size).collect()}
        assert out == {(1, 1): (24, 7), (2, 2): (22, 0), (3, 2): (22, 0), (4, 2): (22, 0), (5, 3): (23, 0), (6, 1): (19, 2)}


def test_every_run_of_thirteen_words(spark):
    words = [f"{a}{b}" for a in "qwrtpsdfg" for b in "aeiouy"]
    item = " ".join(words[:40])
    texts = [(n * 100 + at, " ".join(["zz"] * at + words[5 : 5 + n] + ["zz"] * 7)) for n in (8, 12, 13, 20) for at in range(6)]
    out = {r.doc_id for r in run(spark, texts, [(1, item)]).collect()}
    plain = {d for d, t in texts if any(" ".join(words[i : i + 13]) in t for i in range(28))}
    assert out == plain == {n * 100 + at for n in (13, 20) for at in range(6)}


def test_tables_against_substrings(spark):
    sf = "/root/testdata/sf0.01"
    docs, items = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "benchmark"))
    words = lambda t: " " + " ".join(re.findall(r"[^\W_]+", (t or "").lower())) + " "
    texts, wanted = [(r.doc_id, words(r.text)) for r in docs.collect()], [(r.item_id, words(r.text)) for r in items.collect()]
    whole = {(d, i) for d, t in texts for i, w in wanted if w in t}
    assert {(r.doc_id, r.item_id) for r in D.op2_decontamination(spark, sf).collect()} == whole


def test_verbatim_words_between_changed_slots(spark):
    between = "and then walks along the long river to the old town where nobody knows him and the market opens early so he sells"
    item, doc = (f"In the morning Bob buys {a} apples {between} {b} pears each day" for a, b in ((12, 12), (30, 31)))
    (row,) = run(spark, [(1, doc)], [(1, item)]).collect()
    assert row.run >= len(between.split()) and row.changed == 0


def test_generated_questions(spark):
    """Questions with slots: the same with other values are found, mixed-up values and other questions are not."""
    import random

    draw = random.Random(5)
    vocabulary = [f"{a}{b}{c}" for a in "bdfgklmnprst" for b in "aeiou" for c in "lmnrst"]
    names, items, docs, wanted = ["Ann", "Bert", "Carl", "Dora", "Emma", "Fritz", "Gina", "Hugo"], [], [], set()
    for i in range(30):
        words = [draw.choice(vocabulary) for _ in range(24)]
        who, n = draw.sample(names, 2), draw.sample(range(10, 99), 2)
        fill = lambda w, n, words=words: " ".join(["now", *words[:5], "see", w[0], *words[5:9], str(n[0]), *words[9:12], "see", w[1], *words[12:16], str(n[1]), *words[16:20], "see", w[0], str(n[0]), *words[20:]])
        items.append((i, fill(who, n)))
        other, m = draw.sample([x for x in names if x not in who], 2), draw.sample([x for x in range(100, 999)], 2)
        pad = lambda k: " ".join(draw.choice(vocabulary) for _ in range(k))
        docs.append((10 * i, f"{pad(i)} {fill(other, m)} {pad(3)}"))
        wanted.add((10 * i, i))
        docs.append((10 * i + 1, f"{pad(i)} {fill([other[0]] * 2, [m[0]] * 2)}"))  # two values become one
        docs.append((10 * i + 2, pad(60)))
    assert {(r.doc_id, r.item_id) for r in run(spark, docs, items).collect()} == wanted


def test_short_items_are_compared_whole(spark):
    items = [(1, "Only six words here, right now"), (2, "Bob has 12"), (3, "one"), (4, " ".join("abcdefgh")), (None, "one two")]
    texts = [(1, "x ONLY six\nwords here right now y"), (2, "only six words here right"), (3, "bob has 12 and bob has 13"), (4, "Ann has 12"), (5, "one two one"), (6, ""), (None, None), (7, "z a b c d e f g h")]
    for size in (1 << 24, 0):
        out = {(r.doc_id, r.item_id): (r.run, r.item_words, r.doc_start, r.changed) for r in run(spark, texts, items, broadcast_bytes=size).collect()}
        assert out == {(1, 1): (6, 6, 1, 0), (3, 2): (3, 3, 0, 0), (5, 3): (1, 1, 0, 0), (5, None): (2, 2, 0, 0), (7, 4): (8, 8, 1, 0)}


def test_odd_input(spark, odd, none):
    items = spark.createDataFrame([(1, ITEM), (None, ITEM), (1, ITEM), (2, None), (3, "")], "item_id long, text string")
    assert D.contaminated(odd, items).count() == 0 and D.contaminated(none, items).count() == 0 and D.contaminated(odd, items.limit(0)).count() == 0
    docs = spark.createDataFrame([(1, ITEM), (1, ITEM), (None, "word " * 50_000 + ITEM)], "doc_id long, text string")
    assert D.contaminated(docs, items).groupBy("doc_id").count().orderBy("doc_id").collect() == [(None, 3), (1, 6)]
