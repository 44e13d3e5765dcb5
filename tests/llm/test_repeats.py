import hashlib
import random
from collections import Counter

import pytest

from barflow.llm import repeats
from barflow.llm.repeats import COVER, PERIOD, covers, remove_repeats


def brute(texts, length=200):
    """Kept bytes and spans per text, by counting every string of that length."""
    raw = [(t or "").encode() for t in texts]
    seen = Counter(b[i : i + length] for b in raw for i in range(len(b) - length + 1))
    out = []
    for b in raw:
        gone = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if seen[b[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        spans = [i for i in range(len(b)) if gone[i] and (not i or not gone[i - 1])]
        out.append((bytes(c for c, g in zip(b, gone, strict=True) if not g), len(spans)))
    return out


def results(df):
    return [(r.doc_id, r.n_bytes, bytes(r.kept), len(r.spans)) for r in df.collect()]


def expected(rows, length=200):
    return [(i, len((t or "").encode()), kept, n) for (i, t), (kept, n) in zip(rows, brute([t for _, t in rows], length), strict=True)]


def text(r, n):
    return "".join(r.choice("abcdefghij kü") for _ in range(n))


def test_cover():
    assert covers(COVER, PERIOD) and not covers(COVER[:-1], PERIOD)


def test_equals_brute_force(spark):
    """Shifted copies, passages at the edge of the length, repeats within a text, overlaps, and periodic texts."""
    r = random.Random(3)
    a, b, c = text(r, 900), text(r, 700), text(r, 260)
    rows = [
        (1, a), (2, text(r, 37) + a[100:500] + text(r, 50)), (3, b[:199]), (4, b), (5, text(r, 10) + b[:199]), (6, text(r, 11) + b[:205] + "Z"),
        (7, c + text(r, 40) + c), (8, "ab" * 400), (9, "x" * 200), (10, "x" * 201), (11, a[:300] + a[250:600]), (12, None), (13, ""), (14, "short"), (15, "short"),
        (16, text(r, 20_000)), (17, a[50:260]), (18, text(r, 5) + a[55:255]), (None, text(r, 300)), (19, "€" * 100), (20, "é€" * 60 + "y"),
    ]
    rows += [(100 + k, text(r, k) + c[k : k + 201 + k % 3] + text(r, 30)) for k in range(40)]
    got = results(remove_repeats(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3), batch_bytes=4000))
    assert sorted(got, key=str) == sorted(expected(rows), key=str)


def test_copies_lose_everything(spark):
    """Equal rows, equal texts under several ids and null ids; texts below the length stay."""
    r = random.Random(4)
    a = text(r, 400)
    rows = [(1, a), (1, a), (2, a), (None, a), (None, a), (3, a[:150]), (4, a[:150]), (5, text(r, 50) + a[:220])]
    got = results(remove_repeats(spark.createDataFrame(rows, "doc_id bigint, text string")))
    assert sorted(got, key=str) == sorted(expected(rows), key=str)
    assert all(not kept for i, n, kept, _ in got if n == 400)


def test_slices(spark, monkeypatch):
    """A text longer than a slice, with repeats over the slices' borders."""
    monkeypatch.setattr(repeats, "SLICE", 512)
    r = random.Random(5)
    a = text(r, 3000)
    batch = repeats.Batch(__import__("pyarrow").scalar((a + a[400:1100]).encode()), [len(a.encode()), len(a[400:1100].encode())], [], 200)
    places, names = batch.samples()
    tied = places[repeats.Dealt(names, names, 7).count[repeats.Dealt(names, names, 7).place] > 1]
    hit, _, second = batch.candidates(tied)
    same = Counter(second.tolist())
    found = {int(p) for p, x in zip(hit, second, strict=True) if same[x] > 1}
    whole = batch.bytes.tobytes()
    cut = len(a.encode())
    count = Counter(x[i : i + 200] for x in (whole[:cut], whole[cut:]) for i in range(len(x) - 199))
    assert found == {i + at for x, at in ((whole[:cut], 0), (whole[cut:], cut)) for i in range(len(x) - 199) if count[x[i : i + 200]] > 1}


def test_edges(spark, no_docs):
    assert remove_repeats(no_docs).count() == 0
    extra = spark.createDataFrame([(1, "t" * 300, "x", 5)], "doc_id bigint, text string, kept string, batch bigint")
    assert results(remove_repeats(extra)) == [(1, 300, b"", 1)]
    with pytest.raises(ValueError, match="length"):
        remove_repeats(no_docs, length=100)


def test_query_digests(spark, tmp_path, corpus):
    from barflow.llm import registry

    spark.createDataFrame(corpus, "doc_id bigint, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = [tuple(r) for r in registry.op13_suffix_dedup(spark, str(tmp_path)).collect()]
    want = [(i, n, n - len(kept), spans, hashlib.sha256(kept).hexdigest()) for i, n, kept, spans in expected(corpus)]
    assert sorted(got, key=str) == sorted(want, key=str)
