"""Embedding near-duplicates: an exact range join by pivots, with triangle-inequality replication and independent cells."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, written

CLASSES = "label string, digest string, vec_id bigint, unit binary"


def _prepare(rows: DataFrame) -> DataFrame:
    """Per row: the vector scaled to length one (double precision) and a digest of label and vector; null where it links with nothing."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, labels, vectors = (b.column(k).to_pylist() for k in range(3))
            digest, unit = [], []
            for label, v in zip(labels, vectors, strict=True):
                x = None if label is None or v is None or any(c is None for c in v) else np.array(v, np.float64)
                scale = math.sqrt(float(x @ x)) if x is not None and len(x) and np.isfinite(x).all() else 0.0
                if not scale or not math.isfinite(scale):
                    # squares that over- or underflow: scaled by the largest component first
                    top = float(np.abs(x).max()) if x is not None and len(x) and np.isfinite(x).all() else 0.0
                    if not top:
                        digest.append(None)
                        unit.append(None)
                        continue
                    x = x / top
                    scale = math.sqrt(float(x @ x))
                x = x / scale
                raw = (x + 0.0).tobytes()
                digest.append(hashlib.blake2b(f"{label}\0".encode() + raw, digest_size=16).hexdigest())
                unit.append(raw)
            yield pa.RecordBatch.from_arrays(
                [pa.array(labels, pa.string()), pa.array(digest, pa.string()), pa.array(ids, pa.int64()), pa.array(unit, pa.binary())], names=["label", "digest", "vec_id", "unit"]
            )

    return rows.mapInArrow(run, CLASSES)


def _cells(reps: DataFrame, pivots: DataFrame, radius: float) -> DataFrame:
    """Each vector in its home cell (nearest pivot) and in every cell where a vector within ``radius`` may live.

    Let h and d be the distances to the home pivot and another, c that between both. A vector within ``radius`` of this one
    that lies nearer to the other pivot needs d - h <= 2 radius (triangle inequality), and in this space even
    (d^2 - h^2) / (2c) <= radius, the distance to the plane between both cells. What meets the second is replicated.
    Vectors of several lengths under one label never link: each length has cells of its own.
    """

    def place(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = []
        for size, group in left.groupby(left.unit.map(len), sort=True):
            x = np.frombuffer(b"".join(group.unit)).reshape(len(group), -1)
            p = np.array([np.frombuffer(u) for u in right.unit if len(u) == size])
            if len(p) < 2:
                rows, cells, home = np.arange(len(x)), np.zeros(len(x), np.int64), np.ones(len(x), bool)
            else:
                p = p[np.lexsort(p.T)]
                between = np.sqrt(np.maximum(0, 2 - 2 * p @ p.T))
                d = np.maximum(0, 2 - 2 * x @ p.T)  # squared distances
                h = d.argmin(1)
                near = d - d[np.arange(len(x)), h][:, None] <= 2 * between[h] * (radius + 1e-9)
                rows, cells = np.nonzero(near)
                home = cells == h[rows]
            g = group.iloc[rows]
            out.append(pd.DataFrame({"label": g.label, "cell": size * (1 << 24) + cells, "home": home, "digest": g.digest, "weight": g.weight, "unit": g.unit}))
        schema = {"label": [], "cell": [], "home": [], "digest": [], "weight": [], "unit": []}
        return pd.concat(out) if out else pd.DataFrame(schema)

    grouped = reps.select("label", "part", "digest", "weight", "unit").groupBy("label", "part").cogroup(pivots.select("label", "part", "unit").groupBy("label", "part"))
    return grouped.applyInPandas(place, "label string, cell bigint, home boolean, digest string, weight bigint, unit binary")


def _links(threshold: float):
    """Within one block: how many vectors each home vector of part a links with among part b, and a parent for one link of each."""

    def block(pdf: pd.DataFrame) -> pd.DataFrame:
        left, right = pdf[pdf.side == 0], pdf[pdf.side == 1]
        empty = pd.DataFrame({"digest": [], "links": [], "parent": []}).astype({"digest": str, "links": "int64", "parent": str})
        if not len(left) or not len(right):
            return empty
        a, b = (np.array([np.frombuffer(x) for x in side.unit]) for side in (left, right))
        names, others = left.digest.to_numpy(), right.digest.to_numpy()
        weight = right.weight.to_numpy()
        order = np.argsort(others, kind="stable")
        b, others, weight = b[order], others[order], weight[order]
        links = np.zeros(len(a), np.int64)
        edges = []
        for k in range(0, len(a), 512):
            cos = a[k : k + 512] @ b.T
            hit = cos >= threshold
            for i, j in zip(*np.nonzero(np.abs(cos - threshold) < 1e-12), strict=True):  # the last digits by an exact sum
                hit[i, j] = math.fsum(a[k + i] * b[j]) >= threshold
            hit &= names[k : k + 512, None] != others[None, :]
            links[k : k + 512] = hit @ weight
            # A spanning set of the block's links, a row at a time: this vector with the least root of each partner.
            rows, cols = np.nonzero(hit)
            edges.append(np.stack([rows + k, cols], 1))
        at = np.concatenate(edges) if edges else np.zeros((0, 2), np.int64)
        joined = _forest(np.concatenate([names, others]), at[:, 0], at[:, 1] + len(names))
        some = links > 0
        return pd.concat(
            [
                pd.DataFrame({"digest": names[some], "links": links[some], "parent": None}),
                pd.DataFrame({"digest": [x for x, _ in joined], "links": 0, "parent": [y for _, y in joined]}),
            ]
        )

    return block


def _forest(names: np.ndarray, u: np.ndarray, v: np.ndarray) -> list[tuple[str, str]]:
    """(name, least name) for all names in the components of index pairs, so at most one edge for each name."""
    _, same = np.unique(names, return_inverse=True)  # a name may stand on both sides
    least = same.copy()
    u, v = same[u], same[v]
    root = np.arange(same.max() + 1 if len(same) else 0)
    while len(u):
        low = np.minimum(root[u], root[v])
        new = root.copy()
        np.minimum.at(new, u, low)
        np.minimum.at(new, v, low)
        np.minimum.at(new, root[u], low)
        np.minimum.at(new, root[v], low)
        new = new[new]
        if (new == root).all():
            break
        root = new
    sorted_names = np.unique(names)
    moved = np.unique(least[root[least] != least])
    return [(sorted_names[i], sorted_names[root[i]]) for i in moved]


def near_duplicates(
    rows: DataFrame,
    *,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label_col: str = "label",
    threshold: float = 0.93,
    cell_rows: int = 4000,
    max_pivots: int = 4096,
    block_rows: int = 4096,
    part_rows: int = 4096,
) -> DataFrame:
    """``(vec_id, n_links, component_id, kept)`` per row: links are pairs of one label with cosine >= ``threshold``.

    Vectors that are null, zero, or hold null or non-finite components, and rows without label, link with nothing. Equal
    vectors of a label are one class, counted, compared once. Vectors of different lengths don't link. Repeated rows are
    vectors of their own. A null id is a row of its own whose component is the smallest id of its links, if any.

    Pivots are a bounded sample per label (``max_pivots``); cells of any size are exact, since cells are cut into blocks of
    at most ``block_rows`` rows a side, each its own group. An empty table gives an empty result.
    """
    base = rows.select(F.col(id_col).cast("bigint").alias("vec_id"), F.col(label_col).cast("string").alias("label"), F.col(vector_col).cast("array<double>").alias("v"))
    vectors = written(_prepare(base.select("vec_id", "label", "v")), "vectors")
    classes = written(
        vectors.where(F.col("digest").isNotNull())
        .groupBy("digest")
        .agg(F.min("label").alias("label"), F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("weight"), F.min("unit").alias("unit")),
        "classes",
    )
    # About one pivot for each cell_rows vectors, at most max_pivots a label, chosen by their digests' hashes. The vectors of a
    # label are dealt into parts of about part_rows, each of which gets the label's pivots once.
    sizes = written(classes.groupBy("label").agg(F.count(F.lit(1)).alias("n")), "labels")
    sized = classes.join(sizes, "label").withColumn("parts", F.ceil(F.col("n") / part_rows).cast("int"))
    dealt = sized.withColumn("part", F.pmod(F.xxhash64("digest"), F.col("parts")).cast("int"))
    wanted = F.least(F.lit(max_pivots), F.ceil(F.col("n") / cell_rows) + 1)
    drawn = (
        sized.where((F.col("n") > cell_rows) & (F.pmod(F.xxhash64(F.lit(1), "digest"), F.col("n")) < 2 * wanted))
        .groupBy("label")
        .agg(F.array_sort(F.collect_list("unit")).alias("p"), F.first(wanted).alias("k"), F.first("parts").alias("parts"))
        .select("label", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.slice("p", 1, F.col("k").cast("int")).alias("p"))
        .select("label", "part", F.explode("p").alias("unit"))
    )
    placed = written(_cells(dealt, written(drawn, "pivots"), math.sqrt(2 - 2 * threshold)), "cells")
    size = placed.groupBy("label", "cell").agg(
        F.ceil(F.sum(F.col("home").cast("bigint")) / block_rows).cast("int").alias("na"), F.ceil(F.count(F.lit(1)) / block_rows).cast("int").alias("nb")
    )
    cells = placed.join(written(size, "sizes"), ["label", "cell"])
    key = lambda n: F.pmod(F.xxhash64("digest"), F.greatest(F.col(n), F.lit(1))).cast("int")
    parts = lambda n: F.sequence(F.lit(0), F.greatest(F.col(n), F.lit(1)) - 1)
    names = ("label", "cell", "a", "b", "side", "digest", "weight", "unit")
    left = cells.where("home").select("*", key("na").alias("a"), F.lit(0).alias("side"), F.explode(parts("nb")).alias("b")).select(*names)
    right = cells.select("*", key("nb").alias("b"), F.lit(1).alias("side"), F.explode(parts("na")).alias("a")).select(*names)
    found = written(
        left.unionByName(right).groupBy("label", "cell", "a", "b").applyInPandas(_links(threshold), "digest string, links bigint, parent string"), "links"
    )
    links = found.groupBy("digest").agg(F.sum("links").alias("others"))
    roots = components(found.where(F.col("parent").isNotNull()).select(F.col("digest").alias("u"), F.col("parent").alias("v")), "vector-cc")
    known = classes.select("digest", "rep", "weight").join(roots.withColumnRenamed("node", "digest"), "digest", "left")
    known = written(known.withColumn("component", F.coalesce("component", "digest")).join(links, "digest", "left"), "class-links")
    least = known.groupBy("component").agg(F.min("rep").alias("component_id"))
    facts = known.join(written(least, "least"), "component").select("digest", "component_id", (F.col("weight") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"))
    out = vectors.select("vec_id", "digest").join(written(facts, "facts"), "digest", "left")
    component = F.coalesce("component_id", "vec_id")
    return out.select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"), component.alias("component_id"), F.coalesce(component == F.col("vec_id"), F.lit(False)).alias("kept")
    )
