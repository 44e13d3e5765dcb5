import re
from collections import Counter, defaultdict
from itertools import combinations

import numpy as np
import pandas as pd
import pytest

from barflow.llm import decontaminate, embeddings, line_dedup, ngram_join
from barflow.llm.common import components


def roots(nodes, pairs):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = sorted((find(a), find(b)))
        parent[b] = a
    return {n: find(n) for n in nodes}


def test_components(spark):
    pairs = [(i, i + 1) for i in range(0, 40)] + [(100, 200), (200, 100), (300, 300)] + [(500, 501 + i) for i in range(30)]
    got = dict(map(tuple, components(spark.createDataFrame(pairs, "u bigint, v bigint")).collect()))
    nodes = {n for p in pairs for n in p if p[0] != p[1]}
    assert got == roots(nodes, [p for p in pairs if p[0] != p[1]])
    assert components(spark.createDataFrame([], "u bigint, v bigint")).count() == 0


@pytest.mark.parametrize("block, options", [(1024, {}), (3, {}), (2, {"most_chunks": 1})])
def test_ngram_join_equals_brute_force(spark, docs, corpus, no_docs, block, options):
    out = defaultdict(list)
    for r in ngram_join.join(docs, block_docs=block, **options).collect():
        out[r.doc_id].append(r)
    sets = {}
    for k, (i, t) in enumerate(corpus):
        w = (t or "").lower().split()
        sets[k] = frozenset(tuple(w[j : j + 5]) for j in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])
    pairs = [(a, b) for a, b in combinations(sets, 2) if sets[a] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    links = Counter(x for p in pairs for x in p)
    ids = [i for i, _ in corpus]
    found = roots(range(len(ids)), pairs)
    least = defaultdict(set)
    for k, root in found.items():
        least[root].add(ids[k])
    for k, i in enumerate(ids):
        if i is None:
            continue
        row = out[i][0]
        assert row.n_links == links[k], (i, row)
        assert row.class_id == min(x for x in least[found[k]] if x is not None)
    assert ngram_join.join(no_docs).count() == 0
    kept = ngram_join.representatives(docs, block_docs=block)
    assert kept.columns == docs.columns and kept.where("doc_id in (30, 40, 41, 45)").count() == 0 and kept.where("doc_id in (0, 3, 43, 44)").count() == 4


def test_prefix_depth_meets_recall():
    d = ngram_join.prefix_depth(0.8, 24, 0.9999, 8)
    assert 1 - (1 - 0.8**d) ** 24 >= 0.9999 > 1 - (1 - 0.8 ** (d + 1)) ** 24


def test_embeddings_equal_brute_force(spark):
    r = np.random.default_rng(5)
    base = r.normal(size=(40, 16))
    near = base[r.integers(0, 40, 160)] + r.normal(size=(160, 16)) * 0.12
    x = np.vstack([base, near, base[:5], base[5:8] * 3]).astype(np.float32)
    labels = [int(v) for v in r.integers(0, 2, len(x))]
    rows = [(i, v.tolist(), labels[i], "d") for i, v in enumerate(x)]
    rows += [(1000, None, 1, "d"), (1001, [0.0] * 16, 1, "d"), (1002, [float("nan")] + [1.0] * 15, 1, "d"), (1003, [None] + [1.0] * 15, 1, "d"), (1004, rows[0][1], None, "d"), (1005, [1.0, 2.0], 1, "d"), (1006, [], 0, "d")]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int, digest string").repartition(5)
    n = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    same = np.array(labels)[:, None] == np.array(labels)[None, :]
    hit = (n @ n.T >= 0.93) & same & ~np.eye(len(x), dtype=bool)
    root = roots(range(len(x)), zip(*np.nonzero(np.triu(hit)), strict=True))
    for options in ({}, {"cell_rows": 10, "block_rows": 7, "max_pivots": 6}):
        out = {q.vec_id: q for q in embeddings.near_duplicates(df, **options).collect()}
        assert len(out) == len(rows)
        for i in range(len(x)):
            assert (out[i].n_links, out[i].component_id, out[i].kept) == (hit[i].sum(), root[i], root[i] == i)
        assert all(out[i].n_links == 0 and out[i].kept for i in range(1000, 1007))
    assert embeddings.near_duplicates(df.limit(0)).count() == 0


def test_decontamination_equals_brute_force(spark, docs, corpus, no_docs):
    texts = {i: t for i, t in corpus if i is not None}
    w = lambda t: [x for x in re.split(r"[\W_]+", (t or "").lower()) if x]
    items = [(1, " ".join(texts[2].split()[5:35])), (2, texts[20].upper().replace(" ", ", ")), (3, "too short item"), (4, None), (5, " ".join(texts[46].split()[20000:20050])), (1, " ".join(texts[2].split()[5:35]))]
    changed = texts[11].split()[:45]
    changed[44] = "other"
    items.append((6, " ".join(changed)))
    bench = spark.createDataFrame([(i, t, 0) for i, t in items], "item_id bigint, text string, n bigint")
    grams = lambda ws: [tuple(ws[k : k + 5]) for k in range(len(ws) - 4)]
    want = set()
    for i, t in texts.items():
        s = grams(w(t))
        for _, item in items:
            b = Counter(grams(w(item)))
            m = sum(b.values())
            for k in range(max(1, len(s) - m + 1)) if m else ():
                a = Counter(s[k : k + m])
                both = sum((a & b).values())
                if both >= 0.8 * (sum(a.values()) + m - both):
                    want.add(i)
                    break
    out = decontaminate.findings(docs, bench)
    assert {r.doc_id for r in out.collect()} == want and out.where("not contaminated").count() == 0 and out.count() == len(want)
    assert {2, 20, 46, 11} <= want and {r.doc_id for r in out.collect()} == want
    assert {r.doc_id for r in decontaminate.clean(docs, bench).collect()} == {i for i, _ in corpus} - want
    assert decontaminate.findings(no_docs, bench).count() == 0
    assert decontaminate.findings(docs, bench.limit(0)).count() == 0


LONG = " ".join(f"word{i}" for i in range(60))


def test_line_dedup(spark, no_docs):
    block = "alpha line of text here\nbeta line of text here\ngamma line of text here\ndelta line of text here\nepsilon line\nzeta line of it\neta line again\ntheta line of text\niota\nkappa line\nlambda is a line\nmu"
    rows = [
        (1, f"first of one\nsecond of one\n{block}\nlast of one"), (2, f"other start\n{block}\nother end\nmore end"), (3, LONG + "\nshort"), (4, "head\n" + LONG), (5, None), (6, ""), (7, "Of.\nOf.\nOf."),
        (8, LONG + "!" + "\n" + "x" * 100_000), (9, "head\n" + LONG + "\ntail"), (9, "head\n" + LONG + "\ntail"), (None, LONG),
    ]
    df = spark.createDataFrame([(i, t, "h", "n") for i, t in rows], "doc_id bigint, text string, h string, n string").repartition(4)
    out = line_dedup.dedup(df)
    assert out.columns == df.columns and out.count() == len(rows)
    got = defaultdict(list)
    for r in out.collect():
        got[r.doc_id].append(r.text)
    assert got[1] == [rows[0][1]] and got[None] == [LONG]
    assert len(got[2][0]) < len(rows[1][1]) - 60 and got[2][0].startswith("other start") and got[2][0].endswith("more end")
    assert got[3] == ["short"] and got[4] == ["head"] and got[9] == ["head\ntail"] * 2
    assert got[5] == [None] and got[6] == [""] and got[7] == ["Of.\nOf.\nOf."] and got[8] == [rows[7][1]]
    assert line_dedup.dedup(no_docs).count() == 0


def test_chunks_join_to_the_text_and_resist_shifts(spark):
    texts = ["", "a", "a\nb", "\n\n", f"x\n{LONG}\ny", "\n".join(f"line {i} {i % 7}" for i in range(400))]
    shifted = "\n".join(["new", "lines", *texts[-1].split("\n")])
    df = spark.createDataFrame([(t,) for t in [*texts, shifted]], "t string")
    out = [[c.text for c in r[0]] for r in df.select(line_dedup.chunks(df.t)).collect()]
    assert ["\n".join(c) for c in out] == [*texts, shifted]
    assert len(set(out[-1]) & set(out[-2])) >= 0.9 * len(out[-2])


def test_line_dedup_removes_whole_repeated_runs(spark):
    """Passages of 2 to 8 lines amid other text, short lines among them, go to the last line; firsts, small repeats and overlaps stay."""
    rows, want = [], {}
    for n in range(2, 9):
        for k in range(4):
            line = lambda w, n=n, k=k: [f"{w} {n} {k} {j} of a line" if j % 3 or n == 2 else f"{w[0]}{n}{k}{j}" for j in range(n)]
            i, run = 100 * n + 2 * k, line("passage")
            one, two = [f"before {i}", *run, f"behind {i}"], [f"above {i}", *run, f"below {i}"]
            rows += [(i, "\n".join(one)), (i + 1, "\n".join(two))]
            want |= {i: rows[-2][1], i + 1: f"above {i}\nbelow {i}"}
    short = "\n".join(f"s{j}" for j in range(9))
    same = "the same line of text"
    rows += [(1, f"left\n{short}\nright"), (2, f"l\n{short}\nr"), (3, "}\n}\n}"), (4, "}\n}\n}"), (5, "\n".join([same] * 3)), (6, "\n".join([same + "!"] * 5))]
    want |= {1: rows[-6][1], 2: "l\nr", 3: "}\n}\n}", 4: "}\n}\n}", 5: rows[-2][1], 6: "\n".join([same + "!"] * 2)}
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    assert dict(map(tuple, line_dedup.dedup(df).collect())) == want


def test_decontamination_verifies_every_window(spark):
    """Passages cut at 90 % and followed by one repeated word, and passages whose halves are swapped."""
    r = np.random.default_rng(3)
    items = [(i, " ".join(f"w{v}" for v in r.integers(0, 10**6, 204))) for i in range(6)]
    docs = [(i, f"some text before it {' '.join(t.split()[:184])}{' again' * 40}") for i, t in items]
    docs += [(10 + i, f"text before {' '.join(t.split()[102:])} {' '.join(t.split()[:102])} text behind") for i, t in items]
    docs += [(20 + i, f"{' '.join(t.split()[:160])}{' again' * 60}") for i, t in items]
    df, bench = spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string")
    out = {x.doc_id: x.similarity for x in decontaminate.findings(df, bench).collect()}
    assert out == {i: 0.818182 for i in range(6)} | {10 + i: 0.960784 for i in range(6)}


def test_decontamination_finds_short_items_inside_texts(spark, no_docs):
    texts = {1: "The Answer is forty-two, of course", 2: "the answer is", 3: "answer is forty two", 4: "the answer was forty two", 5: "forty", 6: None, 7: "", 8: "yes " * 5000 + "a b c d", 9: "a b c d e f", 10: "x the answer"}
    items = {1: "the answer is", 2: "Forty two", 3: "forty", 4: "a b c d", 5: "the answer is forty two", 6: "", 7: None, 8: "a b c d e f", 9: "the answer"}
    w = lambda t: re.findall(r"[a-z]+", (t or "").lower())
    held = lambda t, i: any(w(t)[k : k + len(w(i))] == w(i) for k in range(len(w(t)))) if w(i) else False
    want = {(d, i, 1.0) for d, t in texts.items() for i, item in items.items() if held(t, item)}
    rows = [*texts.items(), (9, texts[9]), (None, "forty")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    bench = spark.createDataFrame([*items.items(), (3, "forty")], "item_id bigint, text string")
    got = [tuple(r) for r in decontaminate.contamination(df, bench).collect()]
    assert len(got) == len(set(got)) and set(got) == want | {(None, 3, 1.0)}
    assert {(1, 1, 1.0), (1, 5, 1.0), (8, 4, 1.0), (5, 3, 1.0)} <= want and not any(d == 8 and i == 8 for d, i, _ in want)
    assert {r.doc_id for r in decontaminate.clean(df, bench).collect()} == {6, 7} and decontaminate.findings(no_docs, bench).count() == 0


def test_block_links_pairs_without_a_common_key():
    """Exact similarity decides inside a block, also across chunks; keys (no two alike here) don't."""
    sets = [np.arange(k, k + 90, dtype=np.uint64) for k in (0, 10, 20, 500)]
    block = {"unit": 5, "a": 0, "b": 0, "chunk": 0, "weight": 1, "nodes": None}
    rows = [block | {"digest": f"d{k}", "shingles": x.tobytes()} for k, x in enumerate(sets)]
    out = ngram_join._verify(0.8)(pd.DataFrame(rows))
    assert out.groupby("digest").links.sum().to_dict() == {"d0": 1, "d1": 2, "d2": 1}
    two = [r | {"b": 1, "chunk": k % 3 // 2} for k, r in enumerate(rows)]
    assert ngram_join._verify(0.8)(pd.DataFrame(two)).groupby("digest").links.sum().to_dict() == {"d1": 1, "d2": 1}
    # the pair of d0 and d1 also shares an earlier node, whose block counts it
    nodes = ([3, 5], [3, 5], [4, 5, 9], [5, 9])
    assert ngram_join._verify(0.8)(pd.DataFrame([r | {"nodes": np.array(v)} for r, v in zip(rows, nodes)])).groupby("digest").links.sum().to_dict() == {"d1": 1, "d2": 1}
