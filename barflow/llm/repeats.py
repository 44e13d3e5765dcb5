"""Removal of long repeated byte strings: blockwise suffix grouping with a difference cover.

Two suffixes tie over ``length`` bytes if their first ``length`` bytes are the same. For every pair of positions a difference
cover modulo ``v`` has an offset below ``v`` at which both land on the cover, so a tie always holds an equal string of
``length - v`` bytes that starts at two cover positions. Three passes over the texts follow:

1. The cover samples (9 % of all positions) get names, fingerprints of the ``length - v`` bytes from there. Names are dealt
   into buckets, each sorted by itself, and those met twice are known.
2. Only suffixes that start less than ``v`` before such a sample can tie. They are dealt into buckets by one fingerprint of
   their first ``length`` bytes and sorted there by another, one bucket at a time, which finds the ties.
3. Bytes covered by tied strings are removed.

Texts never move between machines: they are written once in batches, bucketed by batch, and each pass joins the bits that
the buckets answer (one for each name of a batch) with the batches where they lie. A name repeated within a batch is sent
once, so that frequent strings are no hot keys. Buckets have a bounded size, so memory is bounded at every size of the input.
Order within a bucket is that of fingerprints, since nothing but ties is asked for. Whether strings are the same is decided
by a fingerprint of 56 bits among the some million of a bucket: one wrong tie is expected in about 10^11 positions, at any size.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_batches, new_folder, written

#: A perfect difference set; every distance modulo 133 but 0 is met once.
PERIOD = 133
COVER = (1, 8, 9, 11, 25, 37, 69, 88, 94, 99, 103, 121)
SLICE = 1 << 20
LONGEST = 4096


def covers(cover: tuple[int, ...], period: int) -> bool:
    """Whether every distance modulo ``period`` is one between two members of ``cover``."""
    return {(a - b) % period for a in cover for b in cover} == set(range(period))


def _mixed(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


class Fingerprints:
    """Fingerprints of all strings of a length in a piece of bytes: differences of prefix sums modulo 2^64."""

    def __init__(self, seed: int, size: int = SLICE + LONGEST):
        base = (int(_mixed(np.array([seed + 1], np.uint64))[0]) | 1) & (2**64 - 1)
        self.values = _mixed(_mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(seed * 2 + 1)))
        self.powers, self.inverse = (self._series(x, size) for x in (base, pow(base, -1, 2**64)))

    @staticmethod
    def _series(base: int, size: int) -> np.ndarray:
        x = np.full(size, base, np.uint64)
        x[0] = 1
        return np.multiply.accumulate(x)

    def at(self, piece: np.ndarray, where: np.ndarray, length: int) -> np.ndarray:
        sums = np.zeros(len(piece) + 1, np.uint64)
        np.cumsum(self.values[piece] * self.powers[: len(piece)], out=sums[1:])
        return _mixed((sums[where + length] - sums[where]) * self.inverse[where])


_PRINTS: list[Fingerprints] = []


def _prints(k: int) -> Fingerprints:
    while len(_PRINTS) <= k:
        _PRINTS.append(Fingerprints(17 + 31 * len(_PRINTS)))
    return _PRINTS[k]


class Batch:
    """Documents whose bytes stand one behind the other; copies of other documents are passed over."""

    def __init__(self, body: pa.Scalar, sizes: list[int], passed: list[int], length: int):
        self.bytes = np.frombuffer(body.as_buffer(), np.uint8)
        self.ends = np.cumsum(np.array(sizes, np.int64))
        self.starts = self.ends - np.array(sizes, np.int64)
        self.length = length
        self.passed = set(passed)

    def _valid(self, a: int, b: int, length: int) -> np.ndarray:
        """Which positions in [a, b) start a string of ``length`` bytes within one document."""
        ok = np.ones(b - a, bool)
        for k in range(np.searchsorted(self.ends, a, "right"), len(self.ends)):
            if self.starts[k] >= b:
                break
            low = self.starts[k] if k in self.passed else max(self.starts[k], self.ends[k] - length + 1)
            ok[max(0, low - a) : max(0, self.ends[k] - a)] = False
        return ok

    def samples(self) -> tuple[np.ndarray, np.ndarray]:
        """Cover positions and their names."""
        cover, size = np.zeros(PERIOD, bool), self.length - PERIOD
        cover[list(COVER)] = True
        places, names = [], []
        for a in range(0, len(self.bytes), SLICE):
            b = min(a + SLICE, len(self.bytes))
            p = np.nonzero(self._valid(a, b, size) & cover[np.arange(a, b) % PERIOD])[0]
            places.append(p + a)
            names.append(_prints(0).at(self.bytes[a : b + size], p, size))
        return (np.concatenate(places), np.concatenate(names)) if places else (np.zeros(0, np.int64), np.zeros(0, np.uint64))

    def candidates(self, tied: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Positions less than a period before a tied sample, and two fingerprints of the string from there."""
        out = [(np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.uint64))]
        for a in range(0, len(self.bytes), SLICE):
            b = min(a + SLICE, len(self.bytes))
            near = tied[np.searchsorted(tied, a) : np.searchsorted(tied, b + PERIOD)] - a
            if not len(near):
                continue
            step = np.bincount(np.maximum(0, near - PERIOD + 1), minlength=b - a + 1)[: b - a + 1] - np.bincount(np.minimum(near + 1, b - a), minlength=b - a + 1)
            p = np.nonzero((np.cumsum(step)[: b - a] > 0) & self._valid(a, b, self.length))[0]
            piece = self.bytes[a : b + self.length]
            out.append((p + a, _prints(1).at(piece, p, self.length), _prints(2).at(piece, p, self.length)))
        return tuple(np.concatenate(x) for x in zip(*out, strict=True))


class Dealt:
    """Names in buckets: of each bucket the distinct names in order, and of each position the place of its name."""

    def __init__(self, chooser: np.ndarray, names: np.ndarray, buckets: int):
        bucket = ((chooser >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)
        order = np.lexsort((names, bucket))
        self.bucket, self.names = bucket[order], names[order]
        first = np.ones(len(order), bool)
        first[1:] = (self.bucket[1:] != self.bucket[:-1]) | (self.names[1:] != self.names[:-1])
        self.place = np.empty(len(order), np.int64)
        self.place[order] = np.cumsum(first) - 1
        self.count = np.bincount(self.place, minlength=int(first.sum()))
        self.bucket, self.names = self.bucket[first], self.names[first]
        self.cuts = np.searchsorted(self.bucket, np.arange(buckets + 1).astype(np.uint64))

    def rows(self, width: int) -> Iterator[tuple[int, bytes, bytes]]:
        """Bucket, its names of ``width`` bytes each, and a bit for each: whether the batch holds it twice."""
        raw = np.ascontiguousarray(self.names).view(np.uint8).reshape(-1, 8)[:, :width]
        for k in np.nonzero(np.diff(self.cuts))[0]:
            part = slice(self.cuts[k], self.cuts[k + 1])
            yield int(k), raw[part].tobytes(), np.packbits(self.count[part] > 1).tobytes()

    def answered(self, found: list[dict] | None) -> np.ndarray:
        """Which positions have a name that the buckets call repeated."""
        bits = np.zeros(len(self.names), bool)
        for x in found or ():
            a, b = self.cuts[x["bucket"]], self.cuts[x["bucket"] + 1]
            bits[a:b] = np.unpackbits(np.frombuffer(x["bits"], np.uint8), count=b - a).astype(bool)
        return bits[self.place]


def _pack(batch_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, made = TaskContext.get().partitionId(), 0
        ids: list = []
        texts: list[bytes] = []
        total = 0

        def full() -> pa.RecordBatch:
            sizes = [len(t) for t in texts]
            row = [[(task << 32) + made], [list(ids)], [sizes], [b"".join(texts)], [[_digest(t) for t in texts]]]
            return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(row, PACKED, strict=True)], schema=PACKED)

        for b in batches:
            for doc, text in zip(b.column(0), b.column(1), strict=True):
                t = text.as_buffer().to_pybytes() if text.is_valid else b""
                if texts and total + len(t) > batch_bytes:
                    yield full()
                    made, total, ids, texts = made + 1, 0, [], []
                ids.append(doc.as_py())
                texts.append(t)
                total += len(t)
        if texts:
            yield full()

    return run


def _digest(text: bytes) -> bytes:
    return hashlib.blake2b(text, digest_size=16).digest()


PACKED = pa.schema([("batch", pa.int64()), ("ids", pa.list_(pa.int64())), ("sizes", pa.list_(pa.int64())), ("body", pa.binary()), ("digests", pa.list_(pa.binary()))])
NAMED = pa.schema([("bucket", pa.int32()), ("batch", pa.int64()), ("names", pa.binary()), ("twice", pa.binary())])
ANSWER = pa.schema([("bucket", pa.int32()), ("batch", pa.int64()), ("bits", pa.binary()), ("n", pa.int64())])
KEPT = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("kept", pa.binary()), ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))])


def _rows(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [[]] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def _batches(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[tuple[dict, Batch]]:
    """Each row's small columns and its texts; the last batch before this one is let go first."""
    for b in batches:
        body = b.column(b.schema.get_field_index("body"))
        rest = b.drop_columns(["body"]).to_pylist()
        for k, row in enumerate(rest):
            yield row, Batch(body[k], row["sizes"], row["passed"] or [], length)


def _sample_names(length: int, buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row, batch in _batches(batches, length):
            _, names = batch.samples()
            dealt = Dealt(names, names & np.uint64(0xFFFFFFFF), buckets)
            yield _rows([(k, row["batch"], x, y) for k, x, y in dealt.rows(4)], NAMED)

    return run


def _tied_samples(batch: Batch, found: list[dict] | None, buckets: int) -> np.ndarray:
    places, names = batch.samples()
    return places[Dealt(names, names & np.uint64(0xFFFFFFFF), buckets).answered(found)]


def _suffix_names(length: int, first: int, second: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row, batch in _batches(batches, length):
            _, chooser, names = batch.candidates(_tied_samples(batch, row["tied"], first))
            dealt = Dealt(chooser, names & np.uint64((1 << 56) - 1), second)
            yield _rows([(k, row["batch"], x, y) for k, x, y in dealt.rows(7)], NAMED)

    return run


def _sort_bucket(width: int):
    """One bucket: its names are sorted, and every batch is told which of its own are there twice."""

    def run(table: pa.Table) -> pa.Table:
        bucket, batches = table.column("bucket").to_pylist(), table.column("batch").to_pylist()
        parts = [np.frombuffer(x.as_buffer(), np.uint8).reshape(-1, width) for c in table.column("names").chunks for x in c]
        sizes = [len(p) for p in parts]
        raw = np.zeros((sum(sizes), 8), np.uint8)
        raw[:, :width] = np.concatenate(parts)
        names = raw.view(np.uint64).ravel()
        order = np.argsort(names)
        same = names[order[1:]] == names[order[:-1]]
        tied = np.zeros(len(names), bool)
        tied[order[1:][same]] = True
        tied[order[:-1][same]] = True
        rows, at = [], 0
        for k, twice in enumerate(x for c in table.column("twice").chunks for x in c):
            own = tied[at : at + sizes[k]] | np.unpackbits(np.frombuffer(twice.as_buffer(), np.uint8), count=sizes[k]).astype(bool)
            at += sizes[k]
            if own.any():
                rows.append((bucket[k], batches[k], np.packbits(own).tobytes(), int(own.sum())))
        return pa.Table.from_batches([_rows(rows, ANSWER)])

    return run


def _remove(length: int, first: int, second: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row, batch in _batches(batches, length):
            hit = np.zeros(0, np.int64)
            if row["suffixes"]:
                places, chooser, names = batch.candidates(_tied_samples(batch, row["tied"], first))
                hit = places[Dealt(chooser, names & np.uint64((1 << 56) - 1), second).answered(row["suffixes"])]
            whole = set(row["copied"] or ())
            out, view = [], memoryview(batch.bytes)
            for k, doc in enumerate(row["ids"]):
                a, b = int(batch.starts[k]), int(batch.ends[k])
                if k in whole and b - a >= length:
                    out.append((doc, b - a, b"", [{"start": 0, "end": b - a}]))
                    continue
                own = hit[np.searchsorted(hit, a) : np.searchsorted(hit, b)]
                cut = np.nonzero(np.diff(own) > length)[0]
                lows = own[np.concatenate([[0], cut + 1])] if len(own) else own
                highs = own[np.concatenate([cut, [len(own) - 1]])] + length if len(own) else own
                ends = [a, *highs.tolist()]
                kept = b"".join(view[x:y] for x, y in zip(ends, [*lows.tolist(), b], strict=True))
                out.append((doc, b - a, kept, [{"start": int(x) - a, "end": int(y) - a} for x, y in zip(lows, highs, strict=True)]))
            yield _rows(out, KEPT)

    return run


def remove_repeats(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", length: int = 200, batch_bytes: int = 2 << 20, bucket_bytes: int = 4 << 20
) -> DataFrame:
    """``(doc_id, n_bytes, kept, spans)`` per row: the text's UTF-8 bytes without those of strings of ``length`` bytes that start
    anywhere else too, and the maximal runs removed.

    Strings are judged on the input, overlaps count, matches never cross rows. Null texts are empty ones. A null id is a row
    like others; repeated rows are copies of each other, so all of them lose everything if they have ``length`` bytes. Texts
    shorter than that are kept whole. Further columns are not looked at. An empty table gives an empty result. A text of any
    size is worked on in slices, but has to fit a row.
    """
    if not PERIOD + 16 < length <= LONGEST:
        raise ValueError(f"length must be above {PERIOD + 16} and at most {LONGEST}")
    spark = docs.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    name, path = f"texts_{uuid.uuid4().hex}", new_folder(spark, "texts")
    packed = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    with arrow_batches(spark, batch_bytes):
        packed.mapInArrow(_pack(batch_bytes), "batch bigint, ids array<bigint>, sizes array<bigint>, body binary, digests array<binary>").write.bucketBy(n, "batch").option(
            "path", path
        ).option("compression", "zstd").saveAsTable(name)
    texts = spark.table(name)
    # Equal texts: the first stands for all, the others are passed over.
    each = texts.select("batch", F.posexplode("digests").alias("at", "digest"))
    several = each.groupBy("digest").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("batch", "at")).alias("first")).where("n > 1")
    several = written(several, "several")  # a table of its own, so that the join can split a hot digest
    copies = each.join(several, "digest").groupBy("batch").agg(
        F.collect_list("at").alias("copied"), F.collect_list(F.when(F.struct("batch", "at") != F.col("first"), F.col("at"))).alias("passed")
    )
    copies = written(copies, "copies")
    bare = texts.drop("digests").join(copies.hint("shuffle_hash"), "batch", "left")
    total = texts.select(F.sum(F.aggregate("sizes", F.lit(0).cast("bigint"), lambda a, x: a + x)).alias("n")).first()["n"] or 0
    first = _count(total * len(COVER) / PERIOD * 4, bucket_bytes)
    with arrow_batches(spark, batch_bytes):
        tied = _answers(bare.select("batch", "sizes", "passed", "body").mapInArrow(_sample_names(length, first), _sql(NAMED)), 4, "tied")
        # Candidates are at most all positions near a tied sample.
        n_tied = tied.agg(F.sum("n_tied")).first()[0] or 0
        second = _count(min(total, n_tied * PERIOD / len(COVER)) * 7, bucket_bytes)
        near = bare.select("batch", "sizes", "passed", "body").join(tied.drop("n_tied").hint("shuffle_hash"), "batch")
        hits = _answers(near.mapInArrow(_suffix_names(length, first, second), _sql(NAMED)), 7, "suffixes")
        everything = bare.join(tied.drop("n_tied").hint("shuffle_hash"), "batch", "left").join(hits.drop("n_suffixes").hint("shuffle_hash"), "batch", "left")
        return written(everything.mapInArrow(_remove(length, first, second), _sql(KEPT)), "kept")


def _count(size: float, bucket_bytes: int) -> int:
    return max(32, int(size / bucket_bytes) + 1)


def _sql(schema: pa.Schema) -> str:
    from pyspark.sql.pandas.types import from_arrow_schema

    return from_arrow_schema(schema)


def _answers(named: DataFrame, width: int, tag: str) -> DataFrame:
    """Per batch the answers of all buckets: ``(batch, <tag>, n_<tag>)``."""
    answers = named.groupBy("bucket").applyInArrow(_sort_bucket(width), _sql(ANSWER))
    return written(answers.groupBy("batch").agg(F.collect_list(F.struct("bucket", "bits")).alias(tag), F.sum("n").alias(f"n_{tag}")), tag)
