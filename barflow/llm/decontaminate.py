"""Benchmark decontamination: item-sized windows around shared shingles, each scored by exact weighted-shingle similarity.

Native. Only windows that share a five-word shingle with an item can be alike, so documents are reduced to the places of
such shingles. A place counts in a stretch of window starts: those at which the window covers it and holds fewer earlier
ones of the same shingle than the item has. The overlap of a window with an item as multisets is the number of stretches
that hold its start, so one sweep over the ends of the stretches scores all windows of a document and an item at once.

Items below five words are one shingle of their own length: their windows are the runs of so many words.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh_names, indices, let, written

WORDS = 5


def words(text: Column) -> Column:
    """Lower-case runs of letters, marks and digits."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{M}\p{N}]+"), lambda w: w != "")


def shingles(ws: Column, size: int = WORDS) -> Column:
    """64-bit hash of the ``size`` words from each position on; none in fewer words."""
    return F.transform(indices(F.size(ws) - (size - 1)), lambda i: F.xxhash64(F.slice(ws, i, size)))


def _bitmap(items: DataFrame, many: int, most_bits: int) -> tuple[Column, int]:
    """A literal bitmap of the items' shingles, 16 bits a shingle or more up to ``most_bits`` (2 MB), from 32 KB.

    It only spares the explosion of shingles that no item has; a full bitmap would still lose nothing.
    """
    most_bits = min(most_bits, 1 << max(18, (16 * many).bit_length()))
    slots = items.select(F.explode("shingles").alias("h")).select(F.pmod("h", F.lit(most_bits)).alias("s")).distinct()
    found = slots.groupBy((F.col("s") / 64).cast("int").alias("w")).agg(F.collect_set((F.col("s") % 64).cast("int")).alias("b")).collect()
    longs = [0] * (most_bits // 64)
    for r in found:
        value = sum(1 << b for b in r["b"])
        longs[r["w"]] = value - (1 << 64) if value >> 63 else value
    return F.split(F.lit(",".join(map(str, longs))), ",").cast("array<bigint>"), most_bits


def _marked(bitmap: Column, size: int, h: Column) -> Column:
    """Whether some item has the slot of hash ``h``."""
    slot = F.pmod(h, F.lit(size))
    return F.getbit(F.element_at(bitmap, (F.shiftright(slot, 6) + 1).cast("int")), slot.bitwiseAND(F.lit(63).cast("bigint")).cast("int")) == 1


def _short_items(docs: DataFrame, items: DataFrame, id_col: str, text_col: str, most_bits: int) -> DataFrame | None:
    """Pairs ``(id, item_id)`` of documents that hold the words of an item below five words in a row; None without such items."""
    counts = {r["words"]: r["n"] for r in items.where(F.col("words") < WORDS).groupBy("words").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not counts:
        return None
    wanted = items.where(F.col("words") < WORDS).select("item_id", F.col("shingles")[0].alias("h"), "shingles")
    bitmap, size = _bitmap(wanted, sum(counts.values()), most_bits)
    runs = lambda ws: F.array_distinct(F.filter(F.concat(*(shingles(ws, k) for k in sorted(counts))), lambda h: _marked(bitmap, size, h)))
    held = docs.select(F.col(id_col).alias("id"), F.explode(let(words(F.col(text_col)), runs)).alias("h"))
    wanted = wanted.select("item_id", "h")
    return held.join(F.broadcast(wanted) if sum(counts.values()) <= 200_000 else wanted, "h").select("id", "item_id")


def contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    similarity: float = 0.8,
    most_bits: int = 1 << 24,
) -> DataFrame:
    """Pairs ``(id, item_id, similarity)`` of documents with a window at least ``similarity`` alike to an item; the best window counts.

    A window has as many shingles as its item, or is the whole text where that is shorter; all windows are scored. Items below
    five words are held by each text with the same words in a row, at similarity 1; texts below five words hold no others.
    Items without words are in no text. Null texts hold nothing. Repeated
    rows count once; rows that share an id are one document, each text scored by itself; a null id is an id, and so is a null
    item id. Very long texts and items are scored whole. Empty tables give an empty result; other columns are not read.
    """
    one = lambda ws: F.when(F.size(ws) >= WORDS, shingles(ws)).otherwise(F.array(F.xxhash64(ws)))
    own = lambda ws: F.struct(F.size(ws).alias("words"), one(ws).alias("shingles"))
    items = benchmark.select(F.col(item_col).alias("item_id"), let(words(F.col(item_text_col)), own).alias("f")).select("item_id", "f.*").where(F.col("words") > 0)
    items = written(items.withColumn("item", F.xxhash64("item_id", "words", "shingles")).dropDuplicates(["item"]), "items")
    short = _short_items(docs, items, id_col, text_col, most_bits)
    items = items.where(F.col("words") >= WORDS)
    many = items.agg(F.sum(F.size("shingles"))).first()[0] or 0
    bitmap, size = _bitmap(items, many, most_bits)

    def present(hashes: Column) -> Column:
        """The text's number of shingles, and the places of those whose slot some item has."""
        places = F.filter(F.transform(hashes, lambda h, i: F.struct(i.alias("at"), h.alias("h"))), lambda p: _marked(bitmap, size, p["h"]))
        return F.struct(F.size(hashes).alias("n"), places.alias("places"))

    text = F.struct(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("text"))
    found = docs.select(text.alias("doc"), let(let(words(F.col(text_col)), lambda ws: shingles(ws)), present).alias("f"))
    places = found.select("doc", "f.n", F.explode("f.places").alias("p")).select("doc", "n", "p.at", "p.h")
    wanted = items.select("item", "item_id", F.size("shingles").alias("m"), F.explode("shingles").alias("h")).groupBy("item", "item_id", "m", "h").agg(F.count(F.lit(1)).cast("int").alias("c"))
    wanted = F.broadcast(wanted) if many <= 200_000 else wanted  # counted above
    per = places.join(wanted, "h").groupBy("doc", "n", "item", "item_id", "m", "h", "c").agg(F.sort_array(F.collect_set("at")).alias("at"))
    span = F.least("n", "m")  # shingles of a window
    last = F.col("n") - span  # its last start
    before = lambda i: F.when(i >= F.col("c"), F.element_at("at", (i - F.col("c") + 1).cast("int"))).otherwise(-1)
    stretch = F.transform("at", lambda p, i: F.struct(F.greatest(F.lit(0), p - span + 1, before(i) + 1).alias("lo"), F.least(p, last).alias("hi")))
    # An end is twice its start, plus one where a stretch begins: at equal starts those that are over go first.
    ends = F.flatten(F.transform(F.filter(stretch, lambda s: s["lo"] <= s["hi"]), lambda s: F.array(2 * s["lo"] + 1, 2 * s["hi"] + 2)))
    swept = per.select("doc", "n", "item", "item_id", "m", ends.alias("ends")).groupBy("doc", "n", "item", "item_id", "m").agg(F.sort_array(F.flatten(F.collect_list("ends"))).alias("ends"))
    step = lambda a, e: let(
        a["now"] + F.when(e % 2 == 1, 1).otherwise(-1), lambda now: F.struct(now.alias("now"), F.greatest(a["most"], now).alias("most"))
    )
    most = F.aggregate("ends", F.struct(F.lit(0).alias("now"), F.lit(0).alias("most")), step, lambda a: a["most"])
    scored = swept.select("doc.id", "item_id", span.alias("span"), "m", most.alias("both")).select(
        "id", "item_id", (F.col("both") / (F.col("span") + F.col("m") - F.col("both"))).alias("similarity")
    )
    alike = scored.where(F.col("similarity") >= similarity)
    if short is not None:
        alike = alike.unionByName(short.withColumn("similarity", F.lit(1.0)))
    return alike.groupBy("id", "item_id").agg(F.max("similarity").alias("similarity"))


def findings(docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", **options) -> DataFrame:
    """One row per contaminated document: id, contaminated (true), the number of items found in it and the best similarity."""
    found = contamination(docs, benchmark, id_col=id_col, **options)
    per = found.groupBy("id").agg(F.count(F.lit(1)).alias("n_items"), F.round(F.max("similarity"), 6).alias("similarity"))
    return per.select(F.col("id").alias(id_col), F.lit(True).alias("contaminated"), "n_items", "similarity")


def clean(docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", **options) -> DataFrame:
    """The documents without a match, all columns, whatever their names. Rows that share an id with a match go."""
    key, bad_key = fresh_names(docs, 2)
    bad = written(contamination(docs, benchmark, id_col=id_col, **options).select(F.col("id").alias(bad_key)).distinct(), "leaks")
    keyed = docs.withColumn(key, F.col(id_col))
    return keyed.join(bad, keyed[key].eqNullSafe(bad[bad_key]), "left_anti").select(*(keyed[c] for c in docs.columns))
