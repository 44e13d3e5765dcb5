import random
import re
import zlib
from collections import Counter

from hypothesis import given, settings
from hypothesis import strategies as st

from barflow.llm.spelling import near_words, one_edit, variants


def edits(u, v):
    """Levenshtein distance."""
    row = list(range(len(v) + 1))
    for i, c in enumerate(u, 1):
        last, row[0] = row[0], i
        for j, d in enumerate(v, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (c != d))
    return row[-1]


@settings(max_examples=300, deadline=None)
@given(st.text("abé", max_size=7), st.text("abé", max_size=7))
def test_one_edit(u, v):
    assert one_edit(u, v) == (edits(u, v) == 1)


def brute(rows, noise=None):
    n = Counter()
    for i, text in rows:
        for w in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = "".join(c.lower() if c < "\x80" else c for c in w)
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            if noise and h % noise == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            n[w] += 1
    n = {w: k for w, k in n.items() if len(w) >= 7 and k >= 2}
    out = {}
    for w in n:
        near = sorted((v for v in n if abs(len(v) - len(w)) < 2 and edits(v, w) == 1), key=lambda v: (-n[v], v))
        form = near[0] if near and n[near[0]] >= 10 * n[w] else None
        out[w] = (n[w], len(near), form, n[form] if form else None)
    def root(w):
        return root(out[w][2]) if out[w][2] else w
    return sorted((w, *x, root(w)) for w, x in out.items())


def found(df):
    return sorted((r.word, r.n, r.n_near, r.form, r.form_n, r.root) for r in df.collect())


def corpus(r):
    base = ["".join(r.choice("abcdeéÿ") for _ in range(r.randrange(7, 11))) for _ in range(12)]
    rows = []
    for i in range(60):
        words = []
        for _ in range(60):
            w = r.choice(base)
            if r.random() < 0.25:
                k = r.randrange(len(w))
                w = r.choice([w[:k] + w[k + 1 :], w[:k] + r.choice("abz") + w[k:], w[:k] + r.choice("abÀ") + w[k + 1 :], w.upper()])
            words.append(w)
        rows.append((i, r.choice([" ", "-", "\n"]).join(words)))
    chain = ["abcdefgh"] * 2 + ["abcdefghi"] * 20 + ["abcdefghij"] * 200
    return [*rows, (61, " ".join(chain)), (62, None), (63, ""), (None, "wordone wordone wordonE"), (64, "q" * 30_000 + " " + "q" * 30_000), (64, "q" * 30_001 + " " + "q" * 30_001)]


def test_equals_brute_force(spark):
    rows = corpus(random.Random(2))
    small = [x for x in rows if x[0] != 64]
    docs = spark.createDataFrame(small, "doc_id bigint, text string").repartition(3)
    for noise in (None, 31, 3):
        assert found(variants(docs, noise=noise)) == brute(small, noise)


def test_tiles_and_long_words(spark):
    """Blocks cut into tiles give what whole blocks give; words of any length are compared exactly."""
    rows = corpus(random.Random(6))
    words = Counter(w for _, t in rows for w in re.findall("[a-zÀ-ÿ]{7,}", (t or "").lower()))
    df = spark.createDataFrame(sorted(words.items()), "word string, n bigint")
    def total(**k):
        return sorted((r.word, r["sum(n_near)"]) for r in near_words(df, **k).groupBy("word").sum("n_near").collect())
    assert total(tile_rows=3, bin_rows=5) == total() and ("q" * 30_000, 1) in total()


def test_edges(spark, no_docs):
    assert variants(no_docs).count() == 0
    clash = spark.createDataFrame([(1, "letters letters lettersx lettersx", "a", 3)], "doc_id bigint, text string, word string, n bigint")
    assert found(variants(clash)) == [("letters", 2, 1, None, None, "letters"), ("lettersx", 2, 1, None, None, "lettersx")]
    assert [r[0] for r in found(variants(clash.union(clash)))] == ["letters", "lettersx"]
