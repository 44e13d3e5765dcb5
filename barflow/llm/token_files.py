"""Token ids as flat unsigned integer files with 64-bit document offsets, memory-mapped for reading.

Each partition of a range partitioning by document id is one pair of files: ``tokens-<p>.bin`` (little-endian, 16 bits
wide where the vocabulary allows, else 32) and ``offsets-<p>.bin`` (int64, one more than documents, from 0). The
partitions' token counts are summed up to each partition's base, so a document's global start is base plus offset.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import new_folder, small_batches, text_slices, worker_state, written
from .files import mapped, writing
from .words import Table, cut, gather

class WordEncoder:
    """Encodes texts with a tokenizers file by way of a bounded cache of space-separated parts.

    Valid for tokenizers whose results never depend on what is beyond a space or line break; ``exact`` says whether the
    file declares so (its words are split from white space, which is dropped), else whole texts are encoded.
    """

    def __init__(self, content: str, most: int = 1_000_000) -> None:
        import json

        from tokenizers import Tokenizer

        self.t, self.most = Tokenizer.from_str(content), most
        spec = json.loads(content)
        steps = (spec.get("pre_tokenizer") or {}).get("pretokenizers", [])
        first = steps[0] if steps else {}
        pattern = (first.get("pattern") or {}).get("Regex", "")
        specials = [x["content"] for x in spec["added_tokens"]]
        self.exact = (
            first.get("type") == "Split" and first.get("behavior") == "Removed" and bool(first.get("invert"))
            and "[^\\s" in pattern and not re.search(r"(?<!\[\^)\\s|\\S|\(\?|\.|\$|(?<!\[)\^| ", pattern) and not any(re.search(r"\s", x) for x in specials)
            and not any(x["lstrip"] or x["rstrip"] or x["single_word"] for x in spec["added_tokens"])
        )
        self.exact = self.exact and bool(spec["added_tokens"])
        if self.exact:
            self.mark = spec["added_tokens"][0]["content"], spec["added_tokens"][0]["id"]
        self.table = Table(np.uint32)

    def _learn(self, words: list[str]) -> None:
        # Words go in joined by a special token, which encodes as itself: far fewer calls and objects than words one by one.
        mark, mark_id = self.mark
        plain = [w for w in words if mark not in w]
        joined = [mark.join(plain[k : k + 1000]) for k in range(0, len(plain), 1000)]
        for k, e in enumerate(self.t.encode_batch_fast(joined, add_special_tokens=False)):
            part = plain[1000 * k : 1000 * k + 1000]
            ids = np.array(e.ids, np.int64)
            ends = np.append(np.flatnonzero(ids == mark_id), len(ids))
            self.table.add(part, ids[ids != mark_id], np.diff(ends, prepend=-1) - 1)
        for w in words:
            if mark in w:
                ids = np.array(self.t.encode(w, add_special_tokens=False).ids, np.int64)
                self.table.add([w], ids, np.array([len(ids)]))

    def encode(self, texts: pa.Array, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids with ``end_id`` after each text, and the number of ids of each text."""
        if not self.exact:
            ids = [[*e.ids, end_id] for e in self.t.encode_batch_fast(texts.to_pylist(), add_special_tokens=False)]
            return np.fromiter(chain.from_iterable(ids), np.uint32), np.fromiter(map(len, ids), np.int64, len(ids))
        for c in "\n\t\r":
            texts = pc.replace_substring(texts, c, " ")
        codes, count, words = cut(texts, " ")
        if len(self.table.index) > self.most:
            self.table.keep_half()
        self._learn(self.table.missing(words))
        word_starts, word_size = self.table.spans(self.table.places(words))
        # One slot more after each text's words, for its end id.
        starts = np.zeros(len(codes) + len(count), np.int64)
        size = np.ones(len(starts), np.int64)
        slots = np.ones(len(starts), bool)
        last = np.cumsum(count + 1) - 1
        slots[last] = False
        starts[slots] = word_starts[codes]
        size[slots] = word_size[codes]
        ids = gather(self.table.flat, starts, size)
        ends = np.cumsum(size)[last]
        ids[ends - 1] = end_id
        return ids, np.diff(ends, prepend=0)


def worker_encoder(content: str) -> WordEncoder:
    """The encoder of this Python worker: words once encoded stay known to later tasks."""
    return worker_state(("tokens", content), lambda: WordEncoder(content))


def _size(df: DataFrame) -> int:
    """Bytes of a table as the optimizer estimates them from its files; 0 where it knows nothing."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return size if size < 1 << 60 else 0


def write(
    docs: DataFrame, tokenizer_file: str, folder: str | None = None, *, id_col: str = "doc_id", text_col: str = "text", end_id: int = 1,
    partitions: int | None = None, partition_bytes: int = 64 << 20,
) -> DataFrame:
    """Write all documents in ascending order of id; returns the manifest ``(part, folder, width, documents, tokens, base)``.

    Null text: as empty (its end id alone). Null ids come first; equal ids are ordered by their text; repeated rows are
    documents each. Very long texts are written whole. An empty table writes no files and an empty manifest. The
    tokenizer file is read on the driver and goes with the tasks. Width is 2 bytes for up to 65,536 ids, else 4. There are
    ``partitions`` files, or else one for each ``partition_bytes`` of input, at least ``spark.sql.shuffle.partitions``. Ranges
    are of the id and the text's beginning, so that an id of very many rows (or none) spreads.
    """
    from tokenizers import Tokenizer

    spark = docs.sparkSession
    folder = folder or new_folder(spark, "tokens")
    with open(tokenizer_file, encoding="utf-8") as f:
        content = f.read()
    width = 2 if max(Tokenizer.from_str(content).get_vocab_size(with_added_tokens=True), end_id + 1) <= 1 << 16 else 4
    shared = spark.sparkContext.broadcast(content)
    rows = docs.select(F.col(id_col).cast("bigint").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    small_batches(spark)
    n = partitions or max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-_size(docs) // partition_bytes))
    ordered = rows.repartitionByRange(n, F.col("id").asc_nulls_first(), F.substring("text", 1, 32)).sortWithinPartitions(F.col("id").asc_nulls_first(), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        encoder = None
        total, size, ids = 0, [], []
        with writing(folder, f"tokens-{part:06d}.bin") as out:
            for whole in batches:
                encoder = encoder or worker_encoder(shared.value)
                for b in text_slices(whole, most=4_000_000):
                    tokens, count = encoder.encode(b.column(1), end_id)
                    out.write(tokens.astype(f"<u{width}").tobytes())
                    size.append(count)
                    ids.append(np.array([(i is None, i or 0) for i in b.column(0).to_pylist()], np.int64).reshape(-1, 2))
                pa.default_memory_pool().release_unused()
        counts = np.concatenate(size) if size else np.zeros(0, np.int64)
        with writing(folder, f"offsets-{part:06d}.bin") as out:
            out.write(np.concatenate([[0], np.cumsum(counts)]).astype("<i8").tobytes())
        with writing(folder, f"ids-{part:06d}.bin") as out:  # whether null, and the id
            out.write((np.concatenate(ids) if ids else np.zeros((0, 2), np.int64)).astype("<i8").tobytes())
        yield pa.RecordBatch.from_pydict(
            {"part": pa.array([part], pa.int32()), "folder": [folder], "width": pa.array([width], pa.int32()), "documents": [len(counts)], "tokens": [int(counts.sum())]}
        )

    made = ordered.mapInArrow(run, "part int, folder string, width int, documents bigint, tokens bigint")
    # One row a partition of the files: their prefix sum is a window over as many rows as there are files.
    manifest = written(made.where(F.col("documents") > 0), "manifest")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return written(manifest.withColumn("base", F.coalesce(F.sum("tokens").over(before), F.lit(0)).cast("bigint")), "manifest")


def read(manifest: DataFrame, id_name: str = "doc_id") -> DataFrame:
    """Per document from the files: id, start, n_tokens and the crc32 of its ids as little-endian 32-bit integers."""
    n = max(1, int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions")), manifest.count())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                at = f"{r['folder']}/{{}}-{r['part']:06d}.bin"
                tokens, offsets = mapped(at.format("tokens"), f"<u{r['width']}"), mapped(at.format("offsets"), "<i8")
                ids = mapped(at.format("ids"), "<i8").reshape(-1, 2)
                for k in range(0, len(ids), 20_000):
                    o = offsets[k : k + 20_001]
                    crc = [zlib.crc32(tokens[x:y].astype("<u4").tobytes()) for x, y in zip(o[:-1].tolist(), o[1:].tolist(), strict=True)]
                    i = ids[k : k + 20_000]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(i[:, 1], pa.int64(), mask=i[:, 0] == 1), pa.array(r["base"] + o[:-1]), pa.array(np.diff(o)), pa.array(crc, pa.int64())],
                        names=[id_name, "start", "n_tokens", "ids_crc32"],
                    )

    return manifest.repartition(n, "part").mapInArrow(run, f"`{id_name}` bigint, start bigint, n_tokens bigint, ids_crc32 bigint")
