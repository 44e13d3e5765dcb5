"""Hard-negative mining over Hilbert-ordered blocks of candidates with zone maps.

Vectors of one length become integers. Candidates are sorted by label and Hilbert key and written as blocks of bounded size,
one Parquet row each, with the least and greatest value of every dimension. For an anchor, interval arithmetic bounds the
inner products that a block can hold: the sum over dimensions of the anchor's component times the zone's smaller or larger
end. Only blocks whose interval meets what the anchor looks for are read.

Positives first: an anchor's own block gives a score that its positives reach at least, and blocks of its label whose upper
bound is below are passed over. Their scores then set windows; blocks of other labels whose interval meets none of the
windows are passed over. What an anchor needs of a block is one bit: anchors stand in packs, and for each pack and block
some of it needs there is a row with a bit for each anchor. Blocks go to their packs, dealt over the cluster; a task keeps the best rows
found so far for the anchors of one pack, so neither its memory nor what it returns grows with the number of blocks.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import wide_rows, written

BITS = 4
QUANTISED = "vec_id bigint, label string, anchor boolean, size int, q binary"
STATS = "size int, n bigint, sums array<double>, squares array<double>"
BLOCK = "block bigint, label string, size int, n int, ids binary, q binary, low binary, high binary, a_at array<int>, a_least array<bigint>"
ANCHOR = "block bigint, at int, anchor_id bigint, label string, size int, q binary, least bigint"
NEEDS = "number bigint, target bigint, needed binary"
POSITIVE = "block bigint, at int, positive_id bigint, score bigint"
NEGATIVE = "block bigint, at int, anchor_id bigint, place int, positive_id bigint, positive_score bigint, negative_id bigint, score bigint"
#: No score is as small or as great.
NONE, MOST = -(2**63 - 1), 2**63 - 1
#: Anchors that meet a block, or zone maps, at once; bytes of the vectors of a pack and of a block at most.
SLICE, PACK_BYTES, BLOCK_BYTES = 512, 4 << 20, 1 << 20
#: A task that reads or writes wide rows holds a row group of them.
GROUPS = {"parquet.block.size": 16 << 20}


def _cell(x: np.ndarray) -> bytes:
    """Integers in two bytes each if all fit, else in four; ``_quantise`` lets none through that need more."""
    return x.astype("<i2" if np.abs(x).max(initial=0) < 2**15 else "<i4").tobytes()


def _matrix(cell: bytes, n: int, size: int) -> np.ndarray:
    return np.frombuffer(cell, "<i2" if len(cell) == 2 * n * size else "<i4").reshape(n, size).astype(np.float64)


def _vectors(cells: list[bytes], size: int) -> np.ndarray:
    if len({len(c) for c in cells}) > 1:
        return np.concatenate([_matrix(c, 1, size) for c in cells])
    return _matrix(b"".join(cells), len(cells), size)


def _record(sql: str, columns: list) -> pa.RecordBatch:
    kinds = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string(), "boolean": pa.bool_(), "binary": pa.binary(), "double": pa.float64()}
    kinds |= {f"array<{k}>": pa.list_(kinds[k]) for k in ("int", "bigint", "double")}
    names, types = zip(*(f.strip().split(" ") for f in sql.split(",")), strict=True)
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[t]) for c, t in zip(columns, types, strict=True)], names=list(names))


def _quantise(scale: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            vec_id, label, anchor, v = b.columns
            there = pc.and_(pc.and_(vec_id.is_valid(), label.is_valid()), v.is_valid()).to_numpy(zero_copy_only=False)
            sizes = pc.fill_null(pc.list_value_length(v), 0).to_numpy().astype(np.int64)
            first = np.cumsum(sizes) - sizes
            flat = v.flatten().to_numpy(zero_copy_only=False)  # a null component becomes NaN
            for size in np.unique(sizes[there]):
                rows = np.nonzero(there & (sizes == size))[0]
                with np.errstate(over="ignore", invalid="ignore"):
                    q = np.floor(scale * flat[first[rows, None] + np.arange(size)].astype(np.float64))
                    # a product of such vectors fits a long
                    ok = np.isfinite(q).all(1) & (np.abs(q).max(1, initial=0) < 2**31 / max(size, 1) ** 0.5)
                rows, q = pa.array(rows[ok]), q[ok]
                cells = [_cell(x) for x in q]
                yield _record(QUANTISED, [vec_id.take(rows), label.take(rows), pc.fill_null(anchor.take(rows), False), [int(size)] * len(cells), cells])

    return run


def _stats(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    totals: dict[int, list] = {}
    for b in batches:
        sizes = np.array(b.column(0).to_pylist(), np.int64)
        cells = b.column(1).to_pylist()
        for size in np.unique(sizes):
            x = _vectors([c for c, k in zip(cells, sizes, strict=True) if k == size], int(size))
            t = totals.setdefault(int(size), [0, np.zeros(size), np.zeros(size)])
            t[0] += len(x)
            t[1] += x.sum(0)
            t[2] += (x * x).sum(0)
    rows = [(k, n, a.tolist(), q.tolist()) for k, (n, a, q) in totals.items()]
    yield _record(STATS, list(zip(*rows, strict=True)) if rows else [[]] * 4)


def hilbert_keys(cells: np.ndarray, bits: int) -> list[bytes]:
    """Keys along the Hilbert curve of integer points (rows) with ``bits`` bits a dimension, by Skilling's transposition."""
    x = cells.astype(np.int64).T.copy()
    if not len(x):
        return [b""] * cells.shape[0]
    m = 1 << (bits - 1)
    q = m
    while q > 1:
        p = q - 1
        for i in range(len(x)):
            on = (x[i] & q) != 0
            t = np.where(on, 0, (x[0] ^ x[i]) & p)
            x[0] ^= np.where(on, p, t)
            x[i] ^= t
        q >>= 1
    for i in range(1, len(x)):
        x[i] ^= x[i - 1]
    t, q = np.zeros(x.shape[1], np.int64), m
    while q > 1:
        t ^= np.where((x[-1] & q) != 0, q - 1, 0)
        q >>= 1
    x ^= t
    planes = [(x >> b) & 1 for b in range(bits - 1, -1, -1)]  # the highest bits of all dimensions, then the next
    packed = np.packbits(np.concatenate(planes).T.astype(np.uint8), axis=1)
    return [row.tobytes() for row in packed]


def _keyed(stats: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]):
    """Hilbert key of each vector on a grid of two standard deviations either way; the dimensions that spread most come first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sizes, cells = np.array(b.column(3).to_pylist(), np.int64), b.column(4).to_pylist()
            keys: list = [b""] * len(cells)
            for size in np.unique(sizes):
                rows = np.nonzero(sizes == size)[0]
                mean, spread, order = stats[int(size)]
                x = (_vectors([cells[k] for k in rows], int(size)) - mean) / spread
                grid = np.clip(np.floor((x[:, order] + 2) * (1 << BITS) / 4), 0, (1 << BITS) - 1)
                for k, key in zip(rows, hilbert_keys(grid, BITS), strict=True):
                    keys[k] = key
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(keys, pa.binary())], names=[*b.schema.names, "key"])

    return run


def _products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """All inner products, exactly: in floats or doubles where they hold every integer that can occur, else in 64-bit integers."""
    top = max(np.abs(a).max(initial=0), 1) * max(np.abs(b).max(initial=0), 1) * max(a.shape[1], 1)
    kind = np.float32 if top < 2**24 else np.float64 if top < 2**53 else np.int64
    return a.astype(kind, copy=False) @ b.astype(kind, copy=False).T


def _like(bounds: np.ndarray, scores: np.ndarray) -> np.ndarray:
    """Bounds as a column that compares with ``scores`` exactly; beyond what these can be, all bounds are alike."""
    held = {"f4": 2**24, "f8": 2**53}.get(scores.dtype.str[1:], MOST)
    return np.clip(bounds, -held, held).astype(scores.dtype)[:, None]


class _Best:
    """The best ``k`` rows so far of each anchor of a pack, at each of its places: of the scores from ``floor`` to ``top``, the greatest, ties by smaller id."""

    def __init__(self, x: np.ndarray, floor: np.ndarray, top: np.ndarray, k: int):
        self.x, self.floor, self.top, self.k = x, floor, top, k
        self.scores = np.full((*floor.shape, k), NONE)
        self.ids = np.zeros(self.scores.shape, np.int64)

    def meet(self, rows: np.ndarray, y: np.ndarray, ids: np.ndarray, own: np.ndarray | None = None) -> None:
        """``rows``: the anchors to compare with the rows ``y``, named ``ids``; ``own``: the column to leave out for each anchor of the pack, -1 for none."""
        for part in (rows[i : i + SLICE] for i in range(0, len(rows), SLICE)):
            s = _products(self.x[part], y)
            last, last_id, top = self.scores[part, :, -1], self.ids[part, :, -1], self.top[part]
            least = np.maximum(self.floor[part], last)
            r, c = np.divmod(np.flatnonzero((s >= _like(least.min(1), s)) & (s <= _like(top.max(1), s))), s.shape[1])
            if own is not None:
                other = c != own[part[r]]
                r, c = r[other], c[other]
            v, i = s[r, c].astype(np.int64), ids[c]
            for p in range(top.shape[1]):
                ok = (v >= least[r, p]) & (v <= top[r, p]) & ((v > last[r, p]) | (i < last_id[r, p]))
                if ok.sum() > 8 * self.k * len(part) and s.shape[1] > self.k:
                    some = np.full(s.shape, NONE)
                    some[r[ok], c[ok]] = v[ok]
                    ok &= v >= np.partition(some, -self.k, axis=1)[r, -self.k]
                if ok.any():
                    self._take(p, part[r[ok]], v[ok], i[ok])

    def _take(self, p: int, r: np.ndarray, v: np.ndarray, i: np.ndarray) -> None:
        old = np.unique(r)
        r = np.concatenate([np.repeat(old, self.k), r])
        v = np.concatenate([self.scores[old, p].ravel(), v])
        i = np.concatenate([self.ids[old, p].ravel(), i])
        order = np.lexsort((i, -v, r))
        first = np.searchsorted(r[order], old)
        at = order[first[:, None] + np.arange(self.k)]
        self.scores[old, p], self.ids[old, p] = v[at], i[at]


def _blocks(block_rows: int, n_positives: int):
    """Sorted rows to blocks of one label and length. An anchor's ``n_positives``-th score within its own block is the least that its positives reach."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, made = TaskContext.get().partitionId(), 0
        kind, rows = None, []

        def full() -> pa.RecordBatch:
            label, size = kind
            rows.sort(key=lambda r: r[0])
            q = _vectors([r[2] for r in rows], size)
            at = [k for k, r in enumerate(rows) if r[1]]
            scores = _products(q[at], q).astype(np.int64)
            scores[np.arange(len(at)), at] = NONE
            deep = len(rows) > n_positives
            least = np.partition(scores, len(rows) - n_positives, axis=1)[:, len(rows) - n_positives] if deep and at else np.full(len(at), NONE)
            ids = np.array([r[0] for r in rows], "<i8").tobytes()
            one = [(task << 32) + made, label, size, len(rows), ids, _cell(q), _cell(q.min(0)), _cell(q.max(0)), at, least.tolist()]
            return _record(BLOCK, [[x] for x in one])

        for b in batches:
            for vec_id, label, anchor, size, q in zip(*(b.column(k).to_pylist() for k in range(5)), strict=True):
                if rows and (kind != (label, size) or len(rows) >= min(block_rows, max(BLOCK_BYTES // (4 * size or 1), 1))):
                    yield full()
                    made, rows = made + 1, []
                kind = (label, size)
                rows.append((vec_id, anchor, q))
        if rows:
            yield full()

    return run


def _anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for r in b.to_pylist():
            if r["a_at"]:
                q, ids = _matrix(r["q"], r["n"], r["size"]), np.frombuffer(r["ids"], "<i8")
                m = len(r["a_at"])
                yield _record(ANCHOR, [[r["block"]] * m, r["a_at"], ids[r["a_at"]].tolist(), [r["label"]] * m, [r["size"]] * m, [_cell(q[k]) for k in r["a_at"]], r["a_least"]])


def _table(b: pa.RecordBatch) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, b.schema) as w:
        w.write_batch(b)
    return sink.getvalue().to_pybytes()


def _opened(cell: bytes) -> dict[str, list]:
    return pa.ipc.open_stream(cell).read_all().to_pydict()


def _packs(most: int, column: str):
    """Rows of one vector length in packs of ``most``, fewer if vectors are long, each one row of Arrow's stream format, numbered."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, made = TaskContext.get().partitionId(), 0
        held: dict[int, pa.Table] = {}
        for b in batches:
            sizes = np.array(b.column(b.schema.get_field_index("size")).to_pylist(), np.int64)
            for size in np.unique(sizes):
                part = pa.Table.from_batches([b.filter(pa.array(sizes == size))])
                held[int(size)] = pa.concat_tables([held[int(size)], part]) if int(size) in held else part
                full = min(most, max(PACK_BYTES // (4 * int(size) or 1), 1))
                while held[int(size)].num_rows >= full:
                    one = held[int(size)].slice(0, full).combine_chunks().to_batches()[0]
                    held[int(size)] = held[int(size)].slice(full)
                    yield _record(f"number bigint, size int, {column} binary", [[(task << 32) + made], [int(size)], [_table(one)]])
                    made += 1
        for size, rest in held.items():
            if rest.num_rows:
                yield _record(f"number bigint, size int, {column} binary", [[(task << 32) + made], [size], [_table(rest.combine_chunks().to_batches()[0])]])
                made += 1

    return run


def _choose(kind: str, low: int):
    """Which blocks each anchor of a pack must read: where the interval of possible products meets what it looks for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for number, pack, zones in zip(*(b.column(k).to_pylist() for k in range(3)), strict=True):
                a, z = _opened(pack), _opened(zones)
                size = z["size"][0]
                all_x, lows, highs = _vectors(a["q"], size), _vectors(z["low"], size), _vectors(z["high"], size)
                labels, others, far = np.array(a["label"], object), np.array(z["label"], object), np.maximum(np.abs(lows), np.abs(highs))
                need = np.zeros((len(all_x), len(lows)), bool)
                for i in range(0, len(all_x), SLICE):
                    part = slice(i, i + SLICE)
                    x = all_x[part]
                    plus, minus = np.maximum(x, 0), np.minimum(x, 0)
                    slack = 1e-9 * (np.abs(x) @ far.T) + 0.5  # sums in doubles may round
                    most, fewest = plus @ highs.T + minus @ lows.T + slack, plus @ lows.T + minus @ highs.T - slack
                    same = labels[part, None] == others[None, :]
                    if kind == "positive":
                        need[part] = same & (most >= np.array(a["least"][part], float)[:, None])
                        continue
                    for k in range(max(map(len, a["scores"][part]))):
                        s = np.array([float(v[k]) if k < len(v) else -1.0 for v in a["scores"][part]])[:, None]
                        need[part] |= ~same & (s >= 0) & (100 * most >= low * s * (1 - 1e-12)) & (fewest <= s * (1 + 1e-12))
                targets = np.nonzero(need.any(0))[0]
                yield _record(NEEDS, [[number] * len(targets), [z["block"][j] for j in targets], [np.packbits(need[:, j]).tobytes() for j in targets]])

    return run


def _score_positives(k: int):
    def start(a: dict[str, list], x: np.ndarray) -> _Best:
        return _Best(x, np.array(a["least"], np.int64)[:, None], np.full((len(x), 1), MOST), k)

    def rows(a: dict[str, list], best: _Best) -> pa.RecordBatch:
        i, _, j = np.nonzero(best.scores != NONE)
        return _record(POSITIVE, [np.array(a["block"], np.int64)[i], np.array(a["at"], np.int32)[i], best.ids[i, 0, j], best.scores[i, 0, j]])

    return _scored(start, rows, True)


def _score_negatives(k: int, low: int):
    def start(a: dict[str, list], x: np.ndarray) -> _Best:
        places = max(map(len, a["scores"]))
        top = np.array([[*v, *[NONE] * (places - len(v))] for v in a["scores"]], np.int64)
        # low * top <= 100 * score, without products beyond a long; a negative top has no negatives
        return _Best(x, np.where(top < 0, MOST, low * (top // 100) - -low * (top % 100) // 100), top, k)

    def rows(a: dict[str, list], best: _Best) -> pa.RecordBatch:
        i, p, j = np.nonzero(best.scores != NONE)
        names = [a["positives"][m][n] for m, n in zip(i, p, strict=True)]
        block, at, anchor = (np.array(a[c], np.int64)[i] for c in ("block", "at", "anchor_id"))
        return _record(NEGATIVE, [block, at.astype(np.int32), anchor, (p + 1).astype(np.int32), names, best.top[i, p], best.ids[i, p, j], best.scores[i, p, j]])

    return _scored(start, rows, False)


def _scored(start, rows, leave_own: bool):
    """Blocks come sorted by pack: what is kept is of one pack, and is returned when another follows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, a, best = None, {}, None
        for b in batches:
            names = b.schema.names
            cells = {c: b.column(names.index(c)) for c in names}
            for k in range(b.num_rows):
                r = {c: cells[c][k].as_py() for c in ("number", "target", "size", "n", "ids", "q", "needed")}
                if r["number"] != number:
                    if best:
                        yield from _slices(rows(a, best))
                    number, a = r["number"], _opened(cells["pack"][k].as_py())
                    best = start(a, _vectors(a["q"], r["size"]))
                    places = np.array(a["block"], np.int64), np.array(a["at"], np.int64)
                own = np.where(places[0] == r["target"], places[1], -1) if leave_own else None
                needed = np.nonzero(np.unpackbits(np.frombuffer(r["needed"], np.uint8), count=len(best.x)))[0]
                best.meet(needed, _matrix(r["q"], r["n"], r["size"]), np.frombuffer(r["ids"], "<i8"), own)
        if best:
            yield from _slices(rows(a, best))

    return run


def _slices(b: pa.RecordBatch, most: int = 10_000) -> Iterator[pa.RecordBatch]:
    return (b.slice(i, most) for i in range(0, b.num_rows, most))


def mine(
    rows: DataFrame,
    is_anchor: Column,
    *,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label_col: str = "label",
    scale: float = 256.0,
    n_positives: int = 5,
    n_negatives: int = 5,
    low_percent: int = 80,
    block_rows: int = 512,
    pack_rows: int = 4096,
    zone_rows: int = 512,
) -> DataFrame:
    """``(anchor_id, positive_id, rank, negative_id, positive_score, negative_score)``: for each anchor and each of its best ``n_positives``
    other rows of its label, the best ``n_negatives`` rows of other labels that score from ``low_percent`` per cent of the positive up to it.

    A score is the inner product of the vectors' integers floor(``scale`` * x); ties go to the smaller id. Rows with a null id,
    label or vector or a null or non-finite component take no part, nor do those whose scaled components are so large that a
    score may not fit a long. Vectors of different lengths are never compared. Rows are told apart by their place, so a
    repeated row is another row, and an anchor given twice is mined twice. A positive with a negative score has no negatives.
    An empty table gives an empty result.
    """
    spark = rows.sparkSession
    base = rows.select(F.col(id_col).cast("bigint").alias("vec_id"), F.col(label_col).cast("string").alias("label"), is_anchor.alias("anchor"), F.col(vector_col).cast("array<double>").alias("v"))
    with wide_rows(spark):
        quantised = written(base.mapInArrow(_quantise(scale), QUANTISED), "quantised")
        # One row a task and vector length: sums of each dimension.
        stats: dict[int, list] = {}
        for r in quantised.select("size", "q").mapInArrow(_stats, STATS).toLocalIterator():
            t = stats.setdefault(r["size"], [0, np.zeros(r["size"]), np.zeros(r["size"])])
            t[0], t[1], t[2] = t[0] + r["n"], t[1] + np.array(r["sums"]), t[2] + np.array(r["squares"])
        grid = {}
        for size, (n, sums, squares) in stats.items():
            spread = np.sqrt(np.maximum(squares / n - (sums / n) ** 2, 0))
            grid[size] = (sums / n, np.where(spread > 0, spread, 1), np.argsort(-spread, kind="stable"))
        order = ["label", "size", "key", "vec_id"]
        keyed = quantised.mapInArrow(_keyed(grid), f"{QUANTISED}, key binary").repartitionByRange(*order).sortWithinPartitions(*order)
        blocks = written(keyed.drop("key").mapInArrow(_blocks(block_rows, n_positives), BLOCK), "blocks", GROUPS)
        zones = written(blocks.select("block", "label", "size", "low", "high").mapInArrow(_packs(zone_rows, "zones"), "number bigint, size int, zones binary"), "zones", GROUPS)
        # Anchors lie in few blocks: only those are opened.
        anchors = written(blocks.where(F.size("a_at") > 0).select("block", "label", "size", "n", "ids", "q", "a_at", "a_least").mapInArrow(_anchors, ANCHOR), "anchors")
        n_packs = max(1, ceil(anchors.count() / pack_rows))
        # Blocks of a pack go to so many tasks at most, some 256 to each if there are many; the pack goes to each of them.
        n_blocks = blocks.count()
        n_parts = max(1, n_blocks // 256, min(n_blocks, 4 * spark.sparkContext.defaultParallelism))

        def needed(some: DataFrame, kind: str) -> DataFrame:
            """Each pack of anchors meets each pack of zone maps, then each block that one of its anchors needs; both kinds of pairs are dealt over the cluster."""
            dealt = some.repartitionByRange(n_packs, "size", "label", "block", "at")
            packs = written(dealt.mapInArrow(_packs(pack_rows, "pack"), "number bigint, size int, pack binary"), "packs", GROUPS)
            few = max(1, n_packs // 16)  # so many groups of packs, each of which meets a pack of zones in one task
            side = packs.select("size", F.col("number").alias("of"), "pack", F.pmod(F.xxhash64("number"), F.lit(few)).alias("group"))
            other = zones.select("size", "number", "zones", F.explode(F.sequence(F.lit(0), F.lit(few - 1)).cast("array<bigint>")).alias("group"))
            listed = zones.select("size", "number").distinct()
            side = side.join(listed.hint("shuffle_hash"), "size")
            pairs = side.join(other, ["size", "number", "group"]).select("of", "pack", "zones")
            found = written(pairs.mapInArrow(_choose(kind, low_percent), NEEDS), "needs")
            part = F.pmod(F.xxhash64("target"), F.lit(n_parts)).alias("part")
            sent = found.join(blocks.select(F.col("block").alias("target"), "size", "n", "ids", "q"), "target").select("*", part)
            each = packs.select("number", "pack", F.explode(F.sequence(F.lit(0), F.lit(n_parts - 1)).cast("array<bigint>")).alias("part"))
            # A merge join returns rows by pack, as _scored likes them.
            return sent.join(each.hint("merge"), ["number", "part"]).drop("part")

        scored = written(needed(anchors, "positive").mapInArrow(_score_positives(n_positives), POSITIVE), "positives")
        first = Window.partitionBy("block", "at").orderBy(F.desc("score"), "positive_id")
        best = scored.withColumn("place", F.row_number().over(first)).where(F.col("place") <= n_positives)
        listed = F.array_sort(F.collect_list(F.struct("place", "positive_id", "score")))
        windows = best.groupBy("block", "at").agg(listed.alias("p")).select("block", "at", F.col("p.positive_id").alias("positives"), F.col("p.score").alias("scores"))
        windows = written(anchors.drop("least").join(windows, ["block", "at"]), "windows")
        found = written(needed(windows, "negative").mapInArrow(_score_negatives(n_negatives, low_percent), NEGATIVE), "negatives")
    last = Window.partitionBy("block", "at", "place").orderBy(F.desc("score"), "negative_id")
    ranked = found.withColumn("rank", F.row_number().over(last)).where(F.col("rank") <= n_negatives)
    return ranked.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", F.col("score").alias("negative_score"))
