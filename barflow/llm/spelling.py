"""Spelling variants: blocked Gram matrices of letter counts, and the words that variants lead to.

Words one edit apart have letter counts whose squared distance is at most two, and lengths that differ by at most one. So
words lie in blocks of a length and the next, and the product of two blocks of letter counts gives all squared distances
at once; the few pairs at most two apart are verified letter by letter. Since an edit leaves either the first or the second
half of the shorter word alone, a block holds the words of its two lengths that share one half: no near pair is lost, and no
block is the whole vocabulary. Blocks of any size are cut into tiles. Tiles return counts and the best partner of each word,
never their pairs.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_batches, text_slices, written

LETTERS = "[a-z\u00c0-\u00ff]"
COUNTED = "word string, n bigint"
SIDES = "word string, n_near bigint, form_n bigint, form string"


def word_counts(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", noise: int | None = None, least_length: int = 7, least_count: int = 2) -> DataFrame:
    """``(word, n)``: maximal runs of letters (A-Z in lower case, U+00C0 to U+00FF as they are) of whole texts, counted over all rows.

    With ``noise`` the run loses the code point h % length where ``noise`` divides h, the CRC-32 of ``<id>:<run>``: a
    reproducible way of planting misspellings. Null texts have no words; a null id is written as nothing. Only words of
    ``least_length`` code points and ``least_count`` occurrences are returned.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[str] = Counter()
        runs = re.compile(f"{LETTERS}{{{least_length},}}")  # greedy, so runs are whole; shorter ones don't grow

        def flush() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], names=["word", "n"])
            seen.clear()
            return out

        for batch in batches:
            for part in text_slices(batch):
                for doc, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    # bytes change case in ASCII alone
                    low = text.encode().lower().decode() if text else ""
                    own = Counter(runs.findall(low) if len(low) < 1 << 20 else (m.group() for m in runs.finditer(low)))
                    head = b"" if doc is None else str(doc).encode()
                    for word, n in own.items():
                        if noise:
                            h = zlib.crc32(head + b":" + word.encode())
                            if h % noise == 0:
                                at = h % len(word)
                                word = word[:at] + word[at + 1 :]
                        if len(word) >= least_length:
                            seen[word] += n
                    if len(seen) > 100_000:
                        yield flush()
        if seen:
            yield flush()

    counted = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, COUNTED)
    return counted.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_count)


def _counts(words: list[str]) -> np.ndarray:
    """A row of letter counts for each word."""
    lengths = np.array([len(w) for w in words])
    codes = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
    letters, which = np.unique(codes, return_inverse=True)
    cells = np.repeat(np.arange(len(words)), lengths) * len(letters) + which
    kind = np.float32 if lengths.max() < 4096 else np.float64  # squares stay exact
    return np.bincount(cells, minlength=len(words) * len(letters)).astype(kind).reshape(len(words), -1)


def one_edit(u: str, v: str) -> bool:
    """Whether exactly one inserted, deleted or replaced code point lies between both."""
    if len(u) > len(v):
        u, v = v, u
    if len(v) - len(u) > 1 or u == v:
        return False
    k = next((i for i, c in enumerate(u) if c != v[i]), len(u))
    return u[k + 1 :] == v[k + 1 :] if len(u) == len(v) else u[k:] == v[k + 1 :]


def _bin(pdf: pd.DataFrame) -> pd.DataFrame:
    """The blocks of a bin, or tiles of theirs, one after another. Rows of side 2 stand left and right."""
    pdf = pdf.sort_values(["size_", "half", "key"], kind="stable", ignore_index=True)
    words, n, own, side = pdf.word.tolist(), pdf.n.to_numpy(), pdf.own.to_numpy(), pdf.side.to_numpy()
    counts = _counts(words)
    new = (pdf[["size_", "half", "key"]] != pdf[["size_", "half", "key"]].shift()).any(axis=1).to_numpy()
    cuts = [*np.nonzero(new)[0], len(pdf)]
    diagonal = bool((pdf.a == pdf.b).iloc[0])
    us, vs = [], []
    for low, high in zip(cuts, cuts[1:], strict=False):
        rows = np.arange(low, high)
        left, right = rows[own[low:high] & (side[low:high] != 1)], rows[side[low:high] != 0]
        if not len(left) or not len(right):
            continue
        cut, second = int(pdf.size_.iat[low]) // 2, pdf.half.iat[low] == "second"
        squares = (counts[low:high] ** 2).sum(1)
        for k in range(0, len(left), 512):
            part = left[k : k + 512]
            near = squares[part - low][:, None] + squares[right - low][None, :] - 2 * counts[part] @ counts[right].T <= 2
            for i, j in zip(*np.nonzero(near), strict=True):
                i, j = part[i], right[j]
                u, v = words[i], words[j]
                # Pairs of own words of one tile are met from both sides; pairs that share both halves are the first half's.
                if (diagonal and own[j] and u >= v) or (second and u[:cut] == v[:cut]):
                    continue
                if one_edit(u, v):
                    us.append(i)
                    vs.append(j)
    i, j = np.array(us, np.int64), np.array(vs, np.int64)
    names = pdf.word.to_numpy()
    out = pd.DataFrame({"word": np.concatenate([names[i], names[j]]), "n_near": 1, "form_n": np.concatenate([n[j], n[i]]), "form": np.concatenate([names[j], names[i]])})
    out = out.sort_values(["word", "form_n", "form"], ascending=[True, False, True])
    return out.groupby("word", as_index=False).agg({"n_near": "sum", "form_n": "first", "form": "first"})[["word", "n_near", "form_n", "form"]]


def near_words(words: DataFrame, *, tile_rows: int = 2048, bin_rows: int = 16_384) -> DataFrame:
    """``(word, n_near, form_n, form)`` for distinct ``words(word, n)`` that have near ones: how many, and the most frequent (ties: the
    smallest), in partial rows to be added up. Small blocks share a bin of about ``bin_rows`` rows; large ones are cut into tiles."""
    length = F.length("word")

    def key(size, half: str):
        cut = F.floor(size / 2).cast("int")
        text = F.substring("word", 1, cut) if half == "first" else F.substring("word", -(size - cut), size - cut)  # the longer word's end lines up
        return F.struct(size.alias("size_"), F.lit(half).alias("half"), text.alias("key"), (length == size).alias("own"))

    block = ["size_", "half", "key"]
    blocks = words.select("word", "n", F.explode(F.array(*[key(length - d, h) for d in (0, 1) for h in ("first", "second")])).alias("k")).select("word", "n", "k.*")
    sizes = blocks.groupBy(*block).agg(F.sum(F.col("own").cast("bigint")).alias("n_own"), F.count(F.lit(1)).alias("n_all")).where("n_own > 0 and n_all > 1")
    sizes = written(sizes, "word-blocks")
    rows = sizes.agg(F.sum("n_all")).first()[0] or 0
    # Left in a cut block are the words of its own length, in na tiles; right are all words, in na + nx tiles of which the first na hold those.
    known = sizes.select(
        *block,
        F.expr(f"n_all <= {tile_rows} as whole"),
        F.expr(f"cast(ceil(n_own / {tile_rows}) as int) as na"),
        F.expr(f"cast(ceil((n_all - n_own) / {tile_rows}) as int) as nx"),
        F.expr(f"pmod(xxhash64(size_, half, key), {rows // bin_rows + 1}) as bin"),
    )
    dealt = blocks.join(known, block).withColumn("tile", F.expr("cast(if(own, pmod(xxhash64(word), na), na + pmod(xxhash64(word), greatest(nx, 1))) as int)"))
    names = ["bin", "a", "b", "side", *block, "own", "word", "n"]
    whole = dealt.where("whole").selectExpr("*", "0 a", "0 b", "2 side").select(*names)
    cut = dealt.where("not whole")
    left = cut.where("own").selectExpr("*", "tile a", "0 side", "explode(sequence(tile, na + nx - 1)) b").select(*names)
    right = cut.selectExpr("*", "tile b", "1 side", "explode(sequence(0, least(tile, na - 1))) a").select(*names)
    tiles = left.unionByName(right).withColumn("bin", F.xxhash64(*block))
    out = whole.groupBy("bin").applyInPandas(_bin, SIDES)
    return out.unionByName(tiles.groupBy(*block, "a", "b").applyInPandas(_bin, SIDES))


def variants(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", noise: int | None = None, least_length: int = 7, least_count: int = 2, ratio: int = 10) -> DataFrame:
    """``(word, n, n_near, form, form_n, root)`` per word: how often, how many words are one edit apart, and the spelling it is a variant of.

    A word's form is its most frequent near word (ties: the smallest in code-point order) if that occurs ``ratio`` times as often
    at least, else null. The root is where forms lead to; counts rise along them, so they end. Repeated rows count as often as
    they are there. Empty tables give an empty result.
    """
    with arrow_batches(docs.sparkSession, 4 << 20):
        words = written(word_counts(docs, id_col=id_col, text_col=text_col, noise=noise, least_length=least_length, least_count=least_count), "words")
    best = F.min(F.struct((-F.col("form_n")).alias("m"), "form"))
    near = near_words(words).groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("best"))
    strong = -F.col("best.m") >= ratio * F.col("n")
    known = words.join(near, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near"), F.when(strong, F.col("best.form")).alias("form"), F.when(strong, -F.col("best.m")).alias("form_n")
    )
    known = written(known, "forms")
    roots = written(known.where("form is not null").select("word", F.col("form").alias("root")), "roots")
    while True:  # each round doubles the way that has been gone
        step = roots.join(roots.select(F.col("word").alias("root"), F.col("root").alias("next")), "root", "left")
        roots = written(step.select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        if not roots.where("moved").limit(1).count():
            break
        roots = roots.drop("moved")
    return known.join(roots.drop("moved"), "word", "left").select("word", "n", "n_near", "form", "form_n", F.coalesce("root", "word").alias("root"))
