import random
import time
import tracemalloc

import numpy as np
import pytest
from factloom.llm import leakage
from factloom.llm.leakage import Items, SuffixArray, leaked_items, leaks, letters, without_leaks

WORDS = "mill lock barley ferry hoop guild ledger copper velvet lantern orchard pepper saddle quarry timber anchor walnut harbour candle bishop".split()


def sentence(rnd, n):
    return " ".join(rnd.choice(WORDS) + str(rnd.randrange(9)) for _ in range(n))


def longest_common(a, b):
    n = 0
    while n < min(len(a), len(b)) and a[n] == b[n]:
        n += 1
    return n


@pytest.mark.parametrize("kind", ["random", "periodic", "equal"])
def test_suffix_array_against_brute_force(kind):
    rnd = random.Random(1)
    draw = {"random": lambda i: rnd.randrange(1, 4), "periodic": lambda i: i % 5 + 1, "equal": lambda i: 1}[kind]
    a = np.array([draw(i) for i in range(400)] + [0] + [draw(i) for i in range(150)] + [0], np.uint16)
    b = np.concatenate([a[100:140], [0], [draw(i) for i in range(60)], [0]]).astype(np.uint16)
    array = SuffixArray(a)
    suffixes = [a[i:].tolist() for i in range(len(a))]
    assert array.order.tolist() == sorted(range(len(a)), key=suffixes.__getitem__)
    bounds, stand, values = array.search(b)
    for depth, (low, high) in bounds.items():
        for q in range(len(b) - depth):
            want = {p for p in range(len(a)) if a[p : p + depth].tolist() == b[q : q + depth].tolist()}
            assert set(array.order[low[q] : high[q]].tolist()) == want
    q, p = (x.ravel() for x in np.meshgrid(np.arange(len(b) - 1), np.arange(len(a))))
    # Behind the last text there are only zeros, which callers leave out.
    assert np.minimum(array.common(b, values, q, p), len(b) - q).tolist() == [longest_common(b[x:].tolist(), suffixes[y]) for x, y in zip(q.tolist(), p.tolist())]


def test_longest_match_of_each_document():
    rnd = random.Random(2)
    items = Items([1], ["".join(rnd.choice("ab") for _ in range(80))])
    texts = ["".join(rnd.choice("ab") for _ in range(60)) for _ in range(8)] + [items.texts[0][10:50]]
    shard = leakage._Shard(items, texts)
    q, doc = (x.ravel() for x in np.meshgrid(np.arange(80), np.arange(len(texts))))
    n, where = shard.longest(q, doc)
    for x, d, k, p in zip(q.tolist(), doc.tolist(), n.tolist(), where.tolist()):
        want = max(longest_common(items.texts[0][x:], texts[d][i:]) for i in range(len(texts[d])))
        assert k == want and (not k or texts[d][shard.place[p] :][:k] == items.texts[0][x : x + k])


def test_repetitive_text_stays_small():
    items = Items([1, 2], ["a" * 1500, "ab" * 750])
    tracemalloc.start()
    found = leaks(items, np.arange(2), ["a" * 60_000, "ba" * 20_000], 0.5)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert {(d, i, c) for d, i, c, *_ in found} == {(0, 1, 1500), (1, 2, 1500)} and most < 500 << 20


def test_letters_ignore_format():
    code, number, place = letters(["Ａb-C。", "", "х😀1"])
    assert "".join(map(chr, code)) == "abc\0\0х1\0" and number.tolist() == [0, 0, 0, 0, 1, 2, 2, 2] and place.tolist() == [0, 1, 3, 5, 0, 0, 2, 3]
    code, number, place = letters(["oﬃce 𠮷É", "e\u0301"])
    assert code[:6].tobytes().decode("utf-16-le") == "office" and place[:6].tolist() == [0, 1, 1, 1, 2, 3]
    assert code[6:8].tobytes().decode("utf-16-le") == "𠮷" and place[6:10].tolist() == [5, 5, 6, 7] and chr(code[8]) == chr(code[10]) == "e"


def test_leaks(spark):
    rnd = random.Random(3)
    prompt = "Read and answer. "
    items = {1: sentence(rnd, 40), 2: sentence(rnd, 40), 3: "青岚渡的织席匠桥梧从未听说旧主事改口说石磨早已在竹岚渡点清共一百三十四件"}
    base = lambda: sentence(rnd, 120)
    half = items[1][: int(len(items[1]) * 0.6)]
    docs = {
        10: base() + items[1] + base(),
        11: base(),
        12: base() + half.upper().replace(" ", "\n—") + base(),
        13: base() + items[1][: len(items[1]) // 5] + base(),
        14: "前文。" + items[3][:12] + "，" + items[3][12:24] + "！" + base() + items[3][24:],
        15: prompt * 20,
        16: "",
        17: None,
        18: items[2] + " " + items[1],
        None: items[1],
    }
    d = spark.createDataFrame(list(docs.items()), "doc_id long, text string").selectExpr("*", "'x' AS item_id")
    i = spark.createDataFrame([(k, prompt + v) for k, v in items.items()] + [(4, prompt), (5, None), (6, "")], "item_id long, text string").selectExpr("*", "0 AS doc_id")
    want = {(10, 1), (12, 1), (14, 3), (18, 1), (18, 2), (None, 1)}
    for block in (10**6, 150):
        out = leaked_items(d, i, prompts=(prompt,), block_chars=block)
        rows = out.collect()
        assert {(r.doc_id, r.item_id) for r in rows} == want and len(rows) == len(want)
        r = next(r for r in rows if r.doc_id == 10)
        assert docs[10][r.doc_start : r.doc_end].strip() == items[1].strip() and r.covered == r.item_chars
    assert {r.doc_id for r in without_leaks(d, out).collect()} == {11, 13, 15, 16, 17, None}
    assert leaked_items(d.limit(0), i).count() == 0 and leaked_items(d, i.limit(0)).count() == 0


def test_a_shard_with_many_copies_is_searched_in_halves(monkeypatch):
    rnd = random.Random(6)
    items = Items([1, 2, 3], [sentence(rnd, 30) for _ in range(3)])
    texts = [items.texts[i % 2] + " " + sentence(rnd, 20) if i % 3 else sentence(rnd, 40) for i in range(40)]
    whole = leaks(items, np.arange(40), texts, 0.5)
    monkeypatch.setattr(leakage, "MAX_PAIRS", 200)
    assert sorted(leaks(items, np.arange(40), texts, 0.5)) == sorted(whole) and len(whole) == 26


def test_half_of_an_item_is_a_case_and_shared_phrases_are_not():
    rnd = random.Random(8)
    word = lambda: "".join(rnd.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(7))
    own = lambda n: " ".join(word() for _ in range(n))
    phrases = ["where the gate book names many wooden", "around the old fair bailiffs sealed", "who must open the books on these"]
    texts = [own(2) + " ".join(f" {p} {own(3)}" for p in phrases) for _ in range(8)]
    items = Items(list(range(8)), texts)
    flat = lambda t: t.replace(" ", "")
    half, less = (flat(texts[0])[: int(len(flat(texts[0])) * x)] for x in (0.51, 0.48))
    # Every 24th letter of 53 % is changed, so equal letters cover less than a half.
    part = list(flat(texts[1])[: int(len(flat(texts[1])) * 0.53)])
    for k in range(20, len(part), 24):
        part[k] = "9"
    # All items share more than half of their letters with the copy of any.
    docs = [own(30) + half + own(30), own(30) + "".join(part) + own(30), own(30) + texts[2] + own(30), own(30) + less + own(30)]
    docs.append(own(9) + texts[3] + own(9) + texts[4] + own(9))
    assert {(d, i) for d, i, *_ in leaks(items, np.arange(5), docs, 0.5)} == {(0, 0), (1, 1), (2, 2), (4, 3), (4, 4)}
    # Items that ask about one passage all leak with it.
    asked = Items([1, 2], [texts[0] + own(4), texts[0] + own(4)])
    assert {i for _, i, *_ in leaks(asked, np.arange(1), [own(9) + texts[0] + own(9)], 0.5)} == {1, 2}


def test_a_document_that_holds_all_items():
    rnd = random.Random(11)
    texts = ["Around the fair the " + sentence(rnd, 12) + " and each new moon the " + sentence(rnd, 12) for _ in range(800)]
    items = Items(list(range(800)), texts)
    began = time.perf_counter()
    found = leaks(items, np.arange(2), ["\n".join(texts), "Nothing of the kind stands here. " * 50], 0.5)
    assert {(d, i) for d, i, *_ in found} == {(0, i) for i in range(800)} and time.perf_counter() - began < 60


HAN = [chr(c) for c in range(0x4E00, 0x5000)]


@pytest.mark.parametrize("every", [7, 9, 14])
def test_altered_copies(every):
    rnd = random.Random(every)
    zh = ["".join(rnd.choice(HAN) for _ in range(120)) for _ in range(20)]
    words_of = ["".join(rnd.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rnd.randrange(2, 10))) for _ in range(500)]
    text_of = lambda n: " ".join(rnd.choice(words_of) for _ in range(n))
    en = [text_of(60) for _ in range(20)]
    items = Items(list(range(40)), zh + en)
    docs = []
    for text in zh:
        t = list(text)
        for k in range(rnd.randrange(every), len(t), every):
            t[k] = rnd.choice(HAN)
        docs.append("".join(rnd.choice(HAN) for _ in range(200)) + "".join(t) + "".join(rnd.choice(HAN) for _ in range(200)))
    for text in en:
        words = text.split()
        for k in range(0, len(words), 2 if every < 14 else 4):
            at = rnd.randrange(len(words[k]))
            words[k] = words[k][:at] + rnd.choice("abcdefgh") + words[k][at + 1 :]
        docs.append(text_of(300) + " " + " ".join(words) + " " + text_of(300))
    found = {(d, i) for d, i, *_ in leaks(items, np.arange(40), docs, 0.5)}
    assert found == {(i, i) for i in range(40)}
