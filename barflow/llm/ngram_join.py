"""N-gram Jaccard join by a MinHash LSH forest, with exact verification.

Each tree is a prefix trie of signatures: a document's label in it is a sequence of ``depth`` MinHash values, and a node is
a run of documents with a common prefix. Every document starts with its full labels and shortens its matched prefixes, in
all trees at once, until its expected recall reaches the target: the partners that its fullest node holds count as found,
and one more link of the least similarity is supposed. Documents without partners go down to the depth at which the trees
find such a link with the target recall; those in well-filled deep nodes stop earlier, which keeps frequent short prefixes
from chaining groups together. Nodes that somebody looks at are open: all their documents become candidates.

Documents joined by open nodes are compared by their whole shingle sets, all pairs of a group, in blocks of bounded size. A
group too large for that is compared node by node, each pair in the first node that holds both. Counts and spanning links
leave a block, never its pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, fresh_names, small_batches, text_slices, worker_state, written
from .embeddings import _forest

GRAM = 5
MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


class _Hashes(dict):
    """Hashes of words; those met first, the frequent ones, are kept, up to a bound."""

    def __missing__(self, word: str) -> int:
        value = xxhash.xxh3_64_intdigest(word)
        if len(self) < 200_000:
            self[word] = value
        return value


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_hashes(words: list[list[str]], gram: int = GRAM) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all word n-grams, flat, and how many each text has; a text of 1 to n - 1 words is one shingle, one without words has none."""
    count = np.fromiter(map(len, words), np.int64, len(words))
    known = worker_state("word-hashes", _Hashes)
    flat = np.fromiter(map(known.__getitem__, chain.from_iterable(words)), np.uint64, int(count.sum()))
    size = np.where(count >= gram, count - gram + 1, np.minimum(count, 1))
    with np.errstate(over="ignore"):
        # positions are padded by n - 1 zeros after each text, so that n-grams never cross texts
        starts = np.cumsum(count + gram - 1) - (count + gram - 1)
        padded = np.zeros(int((count + gram - 1).sum()), np.uint64)
        padded[np.repeat(starts - (np.cumsum(count) - count), count) + np.arange(len(flat))] = flat
        total = np.zeros(max(0, len(padded) - gram + 1), np.uint64)
        for k in range(gram):
            total = total * MULTIPLIER + padded[k : k + len(total)]
        at = np.repeat(starts - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
        return _mix(total[at]), size


def expected_recall(similarity: float, depth: int, trees: int) -> float:
    """The chance that a pair of this similarity shares a prefix of this depth in some tree."""
    return 1 - (1 - similarity**depth) ** trees


def prefix_depth(similarity: float, trees: int, recall: float, depth: int) -> int:
    """The longest prefix, ``depth`` at most, by which ``trees`` trees find a pair of this similarity with the target recall."""
    while depth > 1 and expected_recall(similarity, depth, trees) < recall:
        depth -= 1
    return depth


def partners_to_stop(similarity: float, depth: int, trees: int, recall: float) -> int:
    """How many partners in one node let a document stop at ``depth``: with one more link of the least similarity supposed
    beside them, the expected share of links that the trees find is the target recall."""
    missed = 1 - expected_recall(similarity, depth, trees)
    return max(0, math.ceil(missed / (1 - recall) - 1 - 1e-9))


#: Bits of one signature value below the root prefix; equal bits of other values only add candidates.
STEP = 16


def sketch(docs: DataFrame, *, id_col: str, text_col: str, trees: int, depth: int, floor: int) -> DataFrame:
    """Per row: id, hash of its text, digest of its words (null without words), their number, and its labels: for each tree
    the hash of the first ``floor`` values and the ``depth`` - ``floor`` others in order, ``STEP`` bits each."""
    rng = np.random.default_rng(20240229)
    a = rng.integers(1, 1 << 63, trees * depth, np.uint64) | np.uint64(1)
    b = rng.integers(0, 1 << 63, trees * depth, np.uint64)
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in text_slices(whole):
                words = [t.lower().split() for t in batch.column(2).to_pylist()]
                digest = [xxhash.xxh3_128_digest(" ".join(w)) if w else None for w in words]
                hashes, size = shingle_hashes(words)
                some = size > 0
                starts = (np.cumsum(size) - size)[some]
                keys, tails = np.zeros((2, len(words), trees), np.uint64)
                if len(starts):
                    with np.errstate(over="ignore"):
                        for t in range(trees):
                            key, tail = np.full(len(starts), np.uint64(t + 1)), np.zeros(len(starts), np.uint64)
                            for k in range(depth):
                                least = np.minimum.reduceat((hashes * a[t * depth + k] + b[t * depth + k]) >> np.uint64(24), starts)
                                if k < floor:
                                    key = _mix(key * MULTIPLIER + least)
                                else:
                                    tail = (tail << np.uint64(STEP)) | (_mix(least) & np.uint64((1 << STEP) - 1))
                            keys[some, t], tails[some, t] = key, tail
                lists = (pa.FixedSizeListArray.from_arrays(pa.array(x.view(np.int64).ravel()), trees).cast(pa.list_(pa.int64())) for x in (keys, tails))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), batch.column(1), pa.array(digest, pa.binary()), pa.array([len(w) for w in words], pa.int64()), *lists],
                    names=["id", "h", "digest", "n_words", "keys", "tails"],
                )

    rows = docs.select(F.col(id_col).cast("bigint").alias("id"), F.xxhash64(text_col).alias("h"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return rows.mapInArrow(run, "id bigint, h bigint, digest binary, n_words bigint, keys array<bigint>, tails array<bigint>")


def open_nodes(classes: DataFrame, *, similarity: float, recall: float, trees: int, depth: int, floor: int) -> DataFrame:
    """``(digest, node)``: the documents of all trie nodes that some document's shortened prefix selects.

    Only nodes of two documents or more matter; roots are counted first, deeper prefixes are laid out below those alone.
    Documents go by a 64-bit name here: two that share one only become candidates together.
    """
    name = F.xxhash64("digest").alias("doc")
    roots = classes.select(name, F.explode(F.arrays_zip("keys", "tails")).alias("p")).select("doc", F.col("p.keys").alias("key"), F.col("p.tails").alias("tail"))
    filled = written(roots.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("key"), "roots")
    below = roots.join(filled, "key")
    levels = F.array(*(F.struct(F.lit(d).alias("level"), F.xxhash64("key", F.lit(d), F.shiftrightunsigned("tail", STEP * (depth - d))).alias("node")) for d in range(floor, depth + 1)))
    prefixes = written(below.select("doc", F.explode(levels).alias("p")).select("doc", "p.level", "p.node"), "prefixes")
    counts = written(prefixes.groupBy("node").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "nodes")
    seen = prefixes.join(counts, "node")
    # The deepest level at which a document's fullest node holds partners enough; the floor needs none.
    enough = F.lit(False)
    for d in range(floor, depth + 1):
        enough = F.when(F.col("level") == d, F.col("n") - 1 >= (0 if d == floor else partners_to_stop(similarity, d, trees, recall))).otherwise(enough)
    stops = written(seen.groupBy("doc").agg(F.coalesce(F.max(F.when(enough, F.col("level"))), F.lit(floor)).alias("stop")), "stops")
    looked = prefixes.join(stops, "doc").where(F.col("level") == F.col("stop")).select("node").distinct().join(counts.select("node"), "node")
    members = prefixes.select("doc", "node").join(written(looked, "open"), "node")
    return written(members.join(classes.select(name, "digest"), "doc").select("digest", "node"), "members")


def _sets(texts: DataFrame, names: list[str]) -> DataFrame:
    """Shingle sets (sorted distinct hashes, as bytes) of the texts whose words have the wanted digest."""
    at = names.index("digest") + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in text_slices(whole):
                words = [t.lower().split() for t in batch.column(0).to_pylist()]
                hashes, size = shingle_hashes(words)
                ends = np.cumsum(size)
                right = [xxhash.xxh3_128_digest(" ".join(w)) == d for w, d in zip(words, batch.column(at).to_pylist(), strict=True)]
                sets = [np.unique(hashes[e - n : e]).tobytes() for e, n in zip(ends.tolist(), size.tolist(), strict=True)]
                out = pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(sets, pa.binary())], names=[*names, "shingles"])
                yield out.filter(pa.array(right, pa.bool_()))

    wanted = texts.select("text", *names)
    kinds = ", ".join(f"{n} {wanted.schema[n].dataType.simpleString()}" for n in names)
    return wanted.mapInArrow(run, f"{kinds}, shingles binary")


def _verify(similarity: float):
    """Within a block: exact similarity of every pair, whether it meets in a tree or not; across the sides only, if the block has
    two. In the block of a node, pairs that also share an earlier node are left to that one's block."""

    def block(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.drop_duplicates("digest").sort_values("digest")
        n = len(pdf)
        a, b = int(pdf.a.iloc[0]), int(pdf.b.iloc[0])
        side = pdf.chunk.to_numpy() if a != b else None
        unit = int(pdf.unit.iloc[0])
        earlier = [np.asarray([x for x in (v if v is not None else ()) if x < unit], np.int64) for v in pdf.nodes]
        shared = np.concatenate(earlier)
        shared_by = np.repeat(np.arange(n), [len(x) for x in earlier])
        names, weight = pdf.digest.to_numpy(), pdf.weight.to_numpy()
        sets = [np.frombuffer(x, np.uint64) for x in pdf.shingles]
        size = np.array([len(x) for x in sets])
        flat = np.concatenate(sets) if n else np.zeros(0, np.uint64)
        owner = np.repeat(np.arange(n), size)
        # postings of every shingle: the texts that have it
        order = np.argsort(flat, kind="stable")
        values = flat[order]
        first = np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]]))
        slot = np.empty(len(flat), np.int64)
        slot[order] = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(flat))))
        holders, begin = owner[order], first
        many = np.diff(np.append(first, len(flat)))
        ends = np.cumsum(size)
        links = np.zeros(n, np.int64)
        u, v = [], []
        for i in range(n):
            other = np.arange(n) > i
            if side is not None:
                other &= side != side[i]
            if len(earlier[i]):
                other[shared_by[np.isin(shared, earlier[i])]] = False
            if not other.any():
                continue
            own = slot[ends[i] - size[i] : ends[i]]
            m = many[own]
            posting = np.repeat(begin[own] - (np.cumsum(m) - m), m) + np.arange(int(m.sum()))
            both = np.bincount(holders[posting], minlength=n)
            # both / (|A| + |B| - both) >= similarity, in whole numbers of shingles
            hit = np.flatnonzero(other & (both >= similarity * (size[i] + size - both) - 1e-9))
            links[i] += weight[hit].sum()
            links[hit] += weight[i]
            u.append(np.full(len(hit), i))
            v.append(hit)
        joined = _forest(names, np.concatenate(u), np.concatenate(v)) if u else []
        some = links > 0
        return pd.concat(
            [
                pd.DataFrame({"digest": names[some], "links": links[some], "parent": None}),
                pd.DataFrame({"digest": [x for x, _ in joined], "links": 0, "parent": [y for _, y in joined]}),
            ]
        ).astype({"links": "int64"})

    return block


def _by_node(sets: DataFrame, members: DataFrame, size) -> DataFrame:
    """The texts of groups that are taken apart, once for each node that holds them, with all their nodes."""
    members = written(members, "split-members")
    lists = members.groupBy("digest").agg(F.sort_array(F.collect_list("node")).alias("nodes"))  # trees x levels nodes at most
    placed = members.select("digest", "node").join(size(members, "node"), "node").join(lists, "digest")
    unit = F.struct(F.lit(2).alias("kind"), F.col("node").alias("unit"))
    return sets.join(placed.hint("merge"), "digest").select("digest", "weight", "shingles", "chunks", unit.alias("u"), "nodes")


def _linked(
    docs: DataFrame,
    *,
    id_col: str,
    text_col: str,
    similarity: float = 0.8,
    recall: float = 0.9999,
    trees: int = 24,
    depth: int = 8,
    block_docs: int = 1024,
    block_words: int = 500_000,
    most_chunks: int = 32,
) -> tuple[DataFrame, DataFrame]:
    """The rows ``(id, h, digest)`` and, per digest, ``(copy_id, n_links, component_id, keeper)``; keeper is the (id, h) of
    the row that stands for the group: the one with the smallest id, rows without id last."""
    floor = prefix_depth(similarity, trees, recall, depth)
    depth = min(depth, floor + 63 // STEP)
    rows = written(sketch(docs, id_col=id_col, text_col=text_col, trees=trees, depth=depth, floor=floor), "sketch")
    row = F.struct(F.col("id").isNull().alias("none"), "id", "h")
    classes = written(
        rows.where(F.col("digest").isNotNull())
        .groupBy("digest")
        .agg(F.min(row).alias("rep"), F.count(F.lit(1)).alias("weight"), F.min("n_words").alias("n_words"), F.first("keys").alias("keys"), F.first("tails").alias("tails")),
        "classes",
    )
    members = open_nodes(classes, similarity=similarity, recall=recall, trees=trees, depth=depth, floor=floor)
    low = written(members.groupBy("node").agg(F.min("digest").alias("low")), "lowest")
    edges = members.join(low, "node").where(F.col("digest") != F.col("low")).select(F.col("digest").alias("u"), F.col("low").alias("v"))
    groups = components(edges, "candidates")
    known = classes.select("digest", "rep", "weight", "n_words")
    members = members.join(known, "digest")
    grouped = written(groups.withColumnRenamed("node", "digest").join(known, "digest"), "grouped")
    texts = docs.select(F.col(id_col).cast("bigint").alias("id"), F.xxhash64(text_col).alias("h"), F.col(text_col).alias("text")).where(F.col("text").isNotNull())
    # Texts are joined by sort-merge at every size: neither side is bounded. Of a row that is repeated one text is taken.
    repeated = written(rows.groupBy("id", "h").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.struct(F.col("id").isNull().alias("none"), "id", "h").alias("rep"), F.lit(True).alias("many")), "repeated")
    chosen = grouped.join(repeated, "rep", "left").select("digest", "weight", "component", F.col("rep.id").alias("rep_id"), F.col("rep.h").alias("rep_h"), F.coalesce("many", F.lit(False)).alias("many"))
    match = (F.col("h") == F.col("rep_h")) & F.col("id").eqNullSafe(F.col("rep_id"))
    found = texts.join(chosen.where("not many").hint("merge"), match).select("text", "digest", "weight", "component")
    if not repeated.isEmpty():
        again = texts.join(chosen.where("many").hint("merge"), match).groupBy("digest").agg(*(F.first(c).alias(c) for c in ("text", "weight", "component")))
        found = found.unionByName(again)
    sets = written(_sets(found, ["digest", "weight", "component"]), "sets")
    # Small groups share units of work; larger ones are dealt into chunks, and each pair of chunks is a block. Groups of more
    # than most_chunks chunks are taken apart into their nodes, which are dealt alike.
    size = lambda df, key: df.groupBy(key).agg(
        F.greatest(F.ceil(F.count(F.lit(1)) / block_docs), F.ceil(F.sum("n_words") / block_words)).cast("int").alias("chunks")
    )
    sizes = written(size(grouped, "component"), "sizes")
    whole = grouped.agg(F.count(F.lit(1)).alias("n"), F.sum("n_words").alias("words")).first()
    units = max(1, -(-whole["n"] // max(1, block_docs // 4)), -(-(whole["words"] or 0) // block_words))
    small = F.pmod(F.xxhash64("component"), F.lit(units)) - F.lit(units)  # below all nodes of earlier() and apart from the large ones
    none = F.lit(None).cast("array<bigint>")
    by_group = sets.join(sizes, "component").where(F.col("chunks") <= most_chunks)
    unit = F.when(F.col("chunks") == 1, F.struct(F.lit(0).alias("kind"), small.alias("unit"))).otherwise(F.struct(F.lit(1).alias("kind"), F.xxhash64("component").alias("unit")))
    by_group = by_group.select("digest", "weight", "shingles", "chunks", unit.alias("u"), none.alias("nodes"))
    dealt = by_group
    if (sizes.agg(F.max("chunks")).first()[0] or 0) > most_chunks:
        split = sizes.where(F.col("chunks") > most_chunks).select("component")
        dealt = dealt.unionByName(_by_node(sets, members.join(groups.withColumnRenamed("node", "digest").join(split, "component"), "digest"), size))
    dealt = dealt.withColumn("chunk", F.pmod(F.xxhash64("digest"), F.col("chunks")).cast("int"))
    others = F.transform(F.sequence(F.lit(0), F.col("chunks") - 1), lambda c: F.struct(F.least("chunk", c).alias("a"), F.greatest("chunk", c).alias("b")))
    dealt = dealt.select("*", F.explode(others).alias("block")).select("u.kind", "u.unit", "block.a", "block.b", "digest", "chunk", "weight", "nodes", "shingles")
    found = written(dealt.groupBy("kind", "unit", "a", "b").applyInPandas(_verify(similarity), "digest binary, links bigint, parent binary"), "links")
    links = found.groupBy("digest").agg(F.sum("links").alias("others"))
    roots = components(found.where(F.col("parent").isNotNull()).select(F.col("digest").alias("u"), F.col("parent").alias("v")), "near")
    done = known.drop("n_words").join(roots.withColumnRenamed("node", "digest"), "digest", "left")
    done = written(done.withColumn("component", F.coalesce("component", "digest")).join(links, "digest", "left"), "class-links")
    least = written(done.groupBy("component").agg(F.min("rep").alias("keeper"), F.min("rep.id").alias("component_id")), "least")
    facts = done.join(least, "component").select(
        "digest", F.col("rep.id").alias("copy_id"), (F.col("weight") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"), "component_id", F.struct("keeper.id", "keeper.h").alias("keeper")
    )
    return rows.select("id", "h", "digest"), written(facts, "facts")


def join(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``(id, class_id, n_links, copy_id, kept)`` per row, for links of Jaccard similarity >= ``similarity`` on word 5-grams.

    Words are lower-case and split at white space. ``class_id`` is the smallest id reachable by links, ``n_links`` counts the
    other rows linked, copies included, ``kept`` marks rows whose id is their class. Texts with the same words in the same
    order are copies, named by their smallest id ``copy_id`` and compared once. Null texts and texts without words link with
    nothing; texts below five words link with their copies alone. Repeated rows count as rows. Rows with a null id are compared
    like all others; their links count, their class is the smallest id of the group, null if none has one. Very long texts
    are compared whole. Other columns are not read; an empty table gives an empty result.

    Options: ``similarity``; the forest's ``trees``, ``depth`` and target ``recall``; ``block_docs``, ``block_words`` and
    ``most_chunks``, which bound the work of one task and the copies of a text.
    """
    rows, facts = _linked(docs, id_col=id_col, text_col=text_col, **options)
    out = rows.select("id", "digest").join(facts.hint("merge"), "digest", "left")
    component = F.coalesce("component_id", "id")
    return out.select(
        F.col("id").alias(id_col),
        component.alias("class_id"),
        F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"),
        F.coalesce("copy_id", "id").alias("copy_id"),
        F.coalesce(component == F.col("id"), F.lit(False)).alias("kept"),
    )


def representatives(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One row of each group, all columns: that with the smallest id, rows without id last, then by the text's hash.

    A row is known by its id and text: repeated ids with different texts are told apart, null ids are ids, and of rows that
    agree in both, one stays. Texts without words are groups of their own and stay, repeated or not. Columns may have any names.
    """
    rows, facts = _linked(docs, id_col=id_col, text_col=text_col, **options)
    known = rows.where(F.col("digest").isNotNull()).join(facts.select("digest", "keeper").hint("merge"), "digest")
    is_keeper = F.col("id").eqNullSafe(F.col("keeper.id")) & (F.col("h") == F.col("keeper.h"))
    counted = written(known.groupBy("id", "h").agg(F.max(is_keeper).alias("keeper"), F.count(F.lit(1)).alias("n")), "rows")
    id_key, text_key = fresh_names(docs, 2)
    keyed = docs.withColumns({id_key: F.col(id_col).cast("bigint"), text_key: F.xxhash64(text_col)})
    named = counted.select(F.col("id").alias("_id"), F.col("h").alias("_h"), "keeper", "n")
    same = keyed[id_key].eqNullSafe(F.col("_id")) & (keyed[text_key] == F.col("_h"))
    columns = [keyed[c] for c in docs.columns]
    gone = named.where("not keeper or n > 1").hint("merge")
    left = keyed.join(gone, same, "left_anti").select(*columns)
    repeated = written(named.where("keeper and n > 1"), "repeated")
    if repeated.isEmpty():
        return left
    one = keyed.join(repeated.hint("merge"), same, "left_semi").dropDuplicates([id_key, text_key])
    return left.unionByName(one.select(*(one[c] for c in docs.columns)))
