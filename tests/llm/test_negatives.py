import math
import random
from pathlib import Path

import numpy as np
import pyarrow.parquet as pq
from pyspark.sql import functions as F

from barflow.llm.common import shared_dir
from barflow.llm.negatives import hilbert_keys, mine

ROWS = "vec_id bigint, embedding array<double>, label int"


def brute(rows, every=10):
    """By a loop over all rows; repeated rows are rows of their own."""
    some = [(i, label, [math.floor(256 * x) for x in v]) for i, v, label in rows if None not in (i, v, label) and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for k, (i, label, v) in enumerate(some):
        if i % every:
            continue
        score = {j: sum(map(int.__mul__, v, w)) for j, (_, _, w) in enumerate(some) if j != k and len(w) == len(v)}
        order = sorted(score, key=lambda j: (-score[j], some[j][0]))
        for p in [j for j in order if some[j][1] == label][:5]:
            ok = [j for j in order if some[j][1] != label and 80 * score[p] <= 100 * score[j] <= 100 * score[p]][:5]
            out += [(i, some[p][0], rank, some[j][0], score[p], score[j]) for rank, j in enumerate(ok, 1)]
    return sorted(out)


def found(spark, rows, **k):
    df = spark.createDataFrame(rows, ROWS).repartition(3)
    return sorted((r.anchor_id, r.positive_id, r.rank, r.negative_id, r.positive_score, r.negative_score) for r in mine(df, F.col("vec_id") % 10 == 0, **k).collect())


def test_equals_brute_force(spark):
    """Clusters, ties by coarse vectors, one label with a third of the rows, several lengths, small blocks and packs."""
    r = random.Random(1)
    centres = [[r.gauss(0, 1) for _ in range(6)] for _ in range(8)]
    rows = [(i, [c + r.gauss(0, 0.2) for c in r.choice(centres)], 0 if i % 3 == 0 else r.randrange(1, 5)) for i in range(400)]
    rows += [(i, [r.randrange(-2, 3) / 4 for _ in range(4)], r.randrange(3)) for i in range(400, 700)]
    assert found(spark, rows, block_rows=16, pack_rows=7, zone_rows=5) == brute(rows)


def test_ties_in_whole_blocks(spark):
    """More ties than are kept in every block, and vectors of two and of four bytes a component side by side."""
    r = random.Random(2)
    rows = [(i, [r.randrange(-1, 2) / 2 for _ in range(3)], r.randrange(2)) for i in range(1300)]
    rows += [(i, [300.0, r.randrange(3) / 2, 0.0], r.randrange(2)) for i in range(1300, 1400)]
    assert found(spark, rows) == brute(rows)


def test_tables_hold_no_pairs(spark):
    """500 anchors and 188 blocks: no table holds anchors once for each block that they need, nor the best rows of each block."""
    r = random.Random(3)
    rows = [(i, [r.gauss(0, 1) for _ in range(16)], r.randrange(3)) for i in range(1500)]
    tables = Path(shared_dir(spark).removeprefix("file://"), "tables")
    before = set(tables.glob("*"))
    df = spark.createDataFrame(rows, ROWS).repartition(3)
    got = sorted(map(tuple, mine(df, F.col("vec_id") % 3 == 0, block_rows=8).collect()))
    assert got == brute(rows, 3)
    size, n = {}, {}
    for folder in set(tables.glob("*")) - before:
        metas = [pq.read_metadata(f) for f in folder.glob("*.parquet")]
        size[folder.name] = sum(m.row_group(k).total_byte_size for m in metas for k in range(m.num_row_groups))
        n[folder.name] = sum(m.num_rows for m in metas)
    assert size and max(size.values()) < 1_000_000 and max(n.values()) < 500 * 188, (size, n)


def test_rows_without_part(spark):
    bad = [(10, None, 1), (20, [1.0, None], 1), (30, [1.0, float("nan")], 1), (40, [float("inf"), 1.0], 1), (None, [1.0, 1.0], 1), (50, [1.0, 1.0], None), (60, [1e300, 0.0], 1), (70, [], 1), (71, [], 1), (80, [], 2)]
    good = [(90, [1.0, 1.0], 1), (91, [1.0, 0.9], 1), (92, [1.0, 0.8], 2), (92, [1.0, 0.8], 2), (90, [1.0, 1.0], 1), (100, [0.0, 0.0], 1), (101, [0.0, 0.0], 2), (110, [-1.0, 0.0], 5), (111, [1.0, 0.0], 5)]
    want = brute([x for x in bad if x[0] != 60] + good)
    assert found(spark, bad + good) == want and any(x[0] == 70 for x in want)


def test_large_components(spark):
    """Products beyond 53 bits are exact."""
    rows = [(10, [2.0**21 + 1 / 256, 1.0], 1), (11, [2.0**21 + 2 / 256, 1.0], 1), (12, [2.0**21 + 1 / 256, 2.0], 2), (13, [2.0**21 + 1 / 256, 1.0], 2), (14, [2.0**21, 3.0], 3)]
    assert found(spark, rows) == brute(rows)


def test_edges(spark):
    assert found(spark, []) == []
    assert found(spark, [(10, [1.0], 1)]) == []
    clash = spark.createDataFrame([(10, [1.0], 1, 3), (11, [1.0], 1, 3), (12, [0.9], 2, 3)], "vec_id bigint, embedding array<double>, label int, block int")
    assert mine(clash, F.col("vec_id") % 10 == 0).count() == 1


def test_hilbert_curve():
    """Neighbours on the curve differ by one step in one dimension, and every point is met once."""
    points = np.stack(np.meshgrid(*[np.arange(4)] * 3, indexing="ij"), -1).reshape(-1, 3)
    keys = hilbert_keys(points, 2)
    way = points[np.argsort(keys)]
    assert len(set(keys)) == 64 and (np.abs(np.diff(way, axis=0)).sum(1) == 1).all()
