import random
import re

from sonde.llm import decontaminate as D

WORD = re.compile(r"[a-z0-9\u0080-\U0010ffff]+")


def words(t):
    return WORD.findall(t.lower())


def brute(text, items, least, coverage, floor):
    """Flags of the words of ``text`` that lie in a counting match, by trying every length at every place."""
    w, its = words(text), [words(i) for i in items if len(words(i)) >= floor]
    hit = [False] * len(w)
    for item in its:
        need = min(least, max(floor, -(-int(coverage * 1000) * len(item) // 1000)))
        grams = {tuple(item[i : i + need]) for i in range(len(item) - need + 1)}
        for i in range(len(w) - need + 1):
            if tuple(w[i : i + need]) in grams:
                hit[i : i + need] = [True] * need
    at, short = 0, [words(i) for i in items if 0 < len(words(i)) < floor]
    for line in text.split("\n"):
        n = len(words(line))
        if words(line) in short:
            hit[at : at + n] = [True] * n
        at += n
    return hit


def covered(text, spans):
    out, raw = [], text.encode()
    for m in re.finditer(rb"[a-z0-9\x80-\xff]+", raw.lower()):
        out.append(any(x <= m.start() < y for x, y in spans))
    return out


def test_matches_equal_brute_force():
    rng, vocab = random.Random(2), "a bc de fg hi jk l".split()
    for _ in range(150):
        items = [" ".join(rng.choices(vocab, k=rng.randrange(2, 16))) for _ in range(4)]
        texts = [" ".join(rng.choices([*vocab, "zz"], k=rng.randrange(0, 40))) for _ in range(5)] + [f"x {rng.choice(items)} y", f"x\n{rng.choice(items)}\ny {items[0]}", "\n".join(items)]
        m = D.Matcher(items, least=6, coverage=0.6, floor=4)
        got = {}
        for d, spans, total in m.find(texts):
            got[d] = [(x, y) for _, _, x, y in spans]
            assert total == len(words(texts[d]))
        for d, t in enumerate(texts):
            assert covered(t, got.get(d, [])) == brute(t, items, 6, 0.6, 4), (items, t)


def test_groups_of_items_give_the_same():
    rng, vocab = random.Random(4), [f"w{i}" for i in range(9)]
    items = [" ".join(rng.choices(vocab, k=12)) for _ in range(20)]
    texts = [" ".join(rng.choices(vocab, k=200)) for _ in range(10)]
    assert list(D.Matcher(items, least=6).find(texts)) == list(D.Matcher(items, least=6, group=20).find(texts))


BENCH = ["Alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu", "uno dos tres cuatro cinco seis siete ocho", None, "", "too short"]


def frames(spark):
    clean = "nothing to see here at all, really nothing of any kind whatsoever my friend"
    rows = [(1, f"Before İ. {BENCH[0].upper()}!\nAfter it, {clean}", 9, "a"), (2, clean, 5, "b"), (3, None, None, "c"), (4, "", 0, None), (5, BENCH[1], 41, "d"), (None, f"{clean} UNO dos, tres; cuatro cinco seis", 1, "e"), (2, clean, 5, "b")]
    return spark.createDataFrame(rows, "doc_id long, text string, n_chars long, spans string"), spark.createDataFrame([(i, t) for i, t in enumerate(BENCH)], "item_id long, text string")


def test_contamination(spark):
    docs, bench = frames(spark)
    got = {r.doc_id: (r.n_spans, r.longest, r.removed_words) for r in D.contamination(docs, bench).collect()}
    assert got == {1: (1, 12, 12), 5: (1, 8, 8), None: (1, 6, 6)}
    assert D.contamination(docs.limit(0), bench).count() == 0 and D.contamination(docs, bench.limit(0)).count() == 0


def test_decontaminate(spark):
    docs, bench = frames(spark)
    out = D.decontaminate(docs, bench, chars="n_chars")
    assert out.columns == docs.columns
    rows = {r.doc_id: r for r in out.collect()}
    assert rows[1].text == "Before İ. !\nAfter it, " + docs.where("doc_id = 2").first().text
    assert rows[1].n_chars == len(rows[1].text) and rows[2].n_chars == 5
    assert 5 not in rows and rows[3].text is None and rows[4].text == ""
    assert rows[None].text.endswith("friend ") and out.where("doc_id = 2").count() == 2


def test_a_long_text(spark):
    m = D.Matcher([BENCH[0]])
    t = "filler words " * 200000 + BENCH[0]
    assert [(d, [w1 - w0 for w0, w1, _, _ in spans]) for d, spans, _ in m.find(["x", t])] == [(1, [12])]


def test_items_in_parts_give_the_same(spark):
    docs, bench = frames(spark)
    docs = docs.union(docs.where("doc_id = 1"))
    for f in (D.contamination, D.decontaminate):
        whole, parts = (sorted(map(str, f(docs, bench, part_mb=mb).collect())) for mb in (6, 60 / (1 << 20)))
        assert whole == parts and whole
        assert f(docs.limit(0), bench, part_mb=60 / (1 << 20)).count() == 0


def test_short_items_are_whole_lines(spark):
    _, bench = frames(spark)
    docs = spark.createDataFrame([(1, "It is too short to say.\nToo short!\nmore"), (2, "this is too short")], "doc_id long, text string")
    assert [(r.doc_id, r.removed_words) for r in D.contamination(docs, bench).collect()] == [(1, 2)]
    assert {r.doc_id: r.text for r in D.decontaminate(docs, bench).collect()} == {1: "It is too short to say.\n!\nmore", 2: "this is too short"}
