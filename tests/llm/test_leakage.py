"""Leaked items: seed masks cover all exchanges, dress does not matter, short quotes and instructions do not count."""

import itertools
import random

import numpy as np

from lodeplane.llm import leakage as L

WORDS = "alpha bravo charlie delta echo foxtrot golf hotel india juliet kilo lima mike november oscar papa quebec romeo sierra tango uniform victor whiskey xray yankee zulu".split()


def test_every_mask_survives_two_exchanges_in_fifteen_words():
    for mask in L.MASKS:
        for wrong in itertools.combinations(range(15), 2):
            assert any(not {m + o for m in mask} & set(wrong) for o in range(15 - mask[-1]))


def test_tolerant_run():
    ok = np.ones(15, bool)
    assert L.tolerant_run(ok) and not L.tolerant_run(ok[:14])
    two, three = ok.copy(), ok.copy()
    two[[3, 9]] = False
    three[[3, 9, 12]] = False
    assert L.tolerant_run(two) and not L.tolerant_run(three)


def found(spark, docs, items, **kw):
    d = spark.createDataFrame([(i, t, "x") for i, t in enumerate(docs)], "doc_id bigint, text string, item_id string")
    e = spark.createDataFrame([(i, t) for i, t in enumerate(items)], "item_id bigint, text string")
    return {tuple(r) for r in L.leaked_items(d, e, **kw).collect()}


def test_dress_exchanges_and_short_quotes(spark):
    random.seed(3)
    passage = " ".join(random.choice(WORDS) for _ in range(40))
    ws = passage.split()
    upper = "## " + " ".join(w.upper() for w in ws[5:25])
    dressed = "x <b>" + "​".join(ws[3][:2:]) + ws[3][2:] + "</b> " + ", ".join(ws[4:24]).replace("a", "а")  # Cyrillic look-alike
    comment = "\n".join(" * " + " ".join(ws[i : i + 5]) for i in range(0, 20, 5))
    changed = " ".join("other" if i in (4, 13) else w for i, w in enumerate(ws[10:30]))
    spoiled = " ".join("other" if i % 4 == 1 else w for i, w in enumerate(ws))
    docs = [upper, dressed, comment, changed, " ".join(ws[:7]), " ".join(ws[:14]), spoiled, None, "", "nothing here at all"]
    assert found(spark, docs, [passage, None, ""]) == {(0, 0), (1, 0), (2, 0), (3, 0)}


def test_words_wrapped_at_line_ends(spark):
    random.seed(6)
    ws = [random.choice(WORDS) + random.choice(WORDS) for _ in range(24)]
    passage = " ".join(ws)
    ws[7:10] = ["state", "of", "art"]
    hyphens = " ".join(ws)
    cut = lambda i, mark="\n": " ".join(ws[:i] + [ws[i][:3] + "-" + mark + ws[i][3:]] + ws[i + 1 :])
    half = lambda text: " ".join(text.split(" ")[2:22])
    soft = half(passage.replace(passage.split()[12], passage.split()[12][:4] + "\xad\r\n" + passage.split()[12][4:]))
    real = " ".join(ws[2:7]) + " state-\n   * of-\n   * art " + " ".join(ws[10:13] + [ws[13][:4] + "-\n   * " + ws[13][4:]] + ws[14:20])
    changed = real.replace(ws[5], "oth-\n// er").replace(ws[11], "other")
    short = "\n".join([" ".join(ws[:6]), ws[6][:3] + "-\n" + ws[6][3:], " ".join(ws[7:13])])
    docs = [soft, cut(12), cut(12, '"\n  + "'), real, changed, short, changed.replace(ws[15], "other")]
    assert found(spark, docs[:1], [passage]) == {(0, 0)}
    assert found(spark, docs[1:], [hyphens]) == {(0, 0), (1, 0), (2, 0), (3, 0)}
    assert found(spark, [hyphens], [cut(12)]) == {(0, 0)}


def test_shared_instruction_blocks_and_repeats(spark):
    random.seed(4)
    line = "Read the passage below and answer the question that follows it in one short clear sentence please now"
    bodies = [" ".join(random.choice(WORDS) + str(random.randint(0, 9)) for _ in range(30)) for _ in range(4)]
    items = [line + "\n\n" + b + "\n\nWhy is that so, item " + str(i) + "?" for i, b in enumerate(bodies)]
    docs = [line, "intro " + bodies[2], bodies[2], line + " " + " ".join(bodies[0].split()[-10:]) + " Why is that so, item 0?"]
    want = {(1, 2), (2, 2), (3, 0)}
    assert found(spark, docs, items) == want
    assert found(spark, docs, items, block_words=40) == want
    assert found(spark, docs, []) == set() and found(spark, [None], items) == set()


def test_against_brute_force(spark):
    random.seed(5)
    items = [" ".join(random.choice(WORDS) for _ in range(30)) for _ in range(6)]
    docs = []
    for _ in range(40):
        it = random.choice(items).split()
        a = random.randint(0, 12)
        part = it[a : a + random.randint(10, 18)]
        for _ in range(random.randint(0, 3)):
            part[random.randrange(len(part))] = "zz"
        docs.append(" ".join([random.choice(WORDS)] * 3 + part + [random.choice(WORDS)] * 3))
    want = set()
    for i, d in enumerate(docs):
        w = d.split()
        for k, it in enumerate(items):
            x = it.split()
            if any(L.tolerant_run(np.array([w[p + o] == x[p] if 0 <= p + o < len(w) else False for p in range(max(0, -o), min(len(x), len(w) - o))])) for o in range(-len(x) + 15, len(w) - 14)):
                want.add((i, k))
    assert found(spark, docs, items) == want


def test_passages_shared_by_items_count_and_instructions_do_not(spark):
    passage = "the ember keeps build strict headers while score after triplelix waits for eighty frabru to build nodes again"
    head = "read the passage about the service below and answer the question that follows in one short and clear sentence please"
    items = spark.createDataFrame([(i, f"{head}\n\n{passage}\n\nwhy does number {i} wait") for i in range(5)], "item_id bigint, text string")
    docs = spark.createDataFrame([(1, f"x y {passage} z"), (2, head)], "doc_id bigint, text string")
    assert sorted(tuple(r) for r in L.leaked_items(docs, items).collect()) == [(1, i) for i in range(5)]
