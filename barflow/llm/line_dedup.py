"""Line dedup with content-defined chunks of lines, completed by the shortest runs at every line.

Native. A rolling hash over the hashes of two neighbouring lines decides whether a chunk ends between them, so that
boundaries move with the content; a line of many words is a chunk of its own. As a boundary need not fall where a repeated
passage begins or ends, the shortest runs that start and end at every line are candidates too: together they cover every
run of two lines or more, of the least number of characters, to its first and last line. What occurs more than once in
the corpus is removed but for its first occurrence, after its bytes are compared.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh_names, indices, let, written


def chunks(text: Column, *, divisor: int = 2, long_words: int = 50, long_chars: int = 200) -> Column:
    """The text's chunks in order, as array<struct<at, first, lines, text, big>>; joined by line feeds they are the text again.

    A boundary lies after a line if the rolling hash of it and the line before is 0 modulo ``divisor``, and on both sides of
    a long line (at least ``long_words`` words, of at least ``long_chars`` characters). ``first`` is the number of the
    chunk's first line, from 1; ``big`` tells a long line.
    """

    def cut(lines: Column) -> Column:
        facts = F.transform(
            lines,
            lambda x: F.struct(
                F.xxhash64(x).alias("h"),
                # words are counted as the spaces left when runs of white space are one space
                F.when(F.length(x) >= long_chars, F.size(F.split(F.trim(x), r"\s+")) >= long_words).otherwise(False).alias("big"),
            ),
        )

        def ends(fs: Column) -> Column:
            n = F.size(fs)
            at = lambda i: F.element_at(fs, i)
            is_end = lambda i: (
                F.when(i == n, True)
                .when(at(i)["big"], True)
                .when(at(i + 1)["big"], True)
                .when(i == 1, False)
                .otherwise(F.pmod(F.xxhash64(at(i - 1)["h"], at(i)["h"]), F.lit(divisor)) == 0)
            )
            stops = F.filter(F.sequence(F.lit(1), n), is_end)

            def pieces(es: Column) -> Column:
                def piece(e: Column, k: Column) -> Column:
                    before = F.when(k == 0, 0).otherwise(F.element_at(es, F.greatest(k, F.lit(1))))
                    return F.struct(
                        k.cast("int").alias("at"),
                        (before + 1).cast("int").alias("first"),
                        (e - before).alias("lines"),
                        F.array_join(F.slice(lines, before + 1, e - before), "\n").alias("text"),
                        F.element_at(fs, e)["big"].alias("big"),
                    )

                return F.transform(es, piece)

            return let(stops, pieces)

        return let(facts, ends)

    return let(F.split(text, "\n"), cut)


def removable(chunk: Column, least_chars: int) -> Column:
    return ((chunk["lines"] >= 2) | chunk["big"]) & (F.length(chunk["text"]) >= least_chars)


def shortest_runs(text: Column, big_lines: Column, least_chars: int) -> Column:
    """For every line the shortest run of lines that starts, and that ends, there, as array<struct<first, lines>>.

    A run has two lines or more, ``least_chars`` characters or more and none of ``big_lines``. Any such run is covered by
    the shortest ones inside it: the one from its first line, and for each later line the one to it.
    """

    def found(lines: Column) -> Column:
        n = F.size(lines)
        chars = lambda i, k: F.length(F.array_join(F.slice(lines, i, k), "\n"))
        enough = lambda i: F.length(F.element_at(lines, i)) + 1 + F.length(F.element_at(lines, i + 1)) >= least_chars
        # k lines have k - 1 line feeds at least, so no shortest run is longer than this
        sizes = lambda most: F.when(most >= 3, F.sequence(F.lit(3), F.least(most, F.lit(max(3, least_chars + 1))))).otherwise(F.array().cast("array<int>"))
        run = lambda i, k: F.struct(i.cast("int").alias("first"), k.cast("int").alias("lines"))
        start = lambda i: run(i, F.when(enough(i), 2).otherwise(F.get(F.filter(sizes(n - i + 1), lambda k: chars(i, k) >= least_chars), F.lit(0))))
        end = lambda j: let(F.get(F.filter(sizes(j), lambda k: chars(j - k + 1, k) >= least_chars), F.lit(0)), lambda k: run(j - k + 1, k))
        # where the pair of a line and the one before is long enough, the run to it is the run from the one before
        ends = F.filter(F.transform(indices(n - 1), lambda i: i + 1), lambda j: ~enough(j - 1))
        every = F.array_distinct(F.concat(F.transform(indices(n - 1), start), F.transform(ends, end)))
        crosses = lambda r: F.arrays_overlap(F.sequence(r["first"], r["first"] + r["lines"] - 1), big_lines)
        return F.filter(every, lambda r: r["lines"].isNotNull() & ~F.when(F.size(big_lines) > 0, crosses(r)).otherwise(False))

    return let(F.split(text, "\n"), found)


def candidates(text: Column, *, divisor: int, long_words: int, least_chars: int) -> Column:
    """What may go if it is a repeat: removable chunks and shortest runs, as array<struct<first, lines, text>>, each place once."""

    def both(cs: Column) -> Column:
        place = lambda c: F.struct(c["first"].alias("first"), c["lines"].cast("int").alias("lines"))
        big_lines = F.transform(F.filter(cs, lambda c: c["big"]), lambda c: c["first"])
        runs = let(big_lines, lambda bs: shortest_runs(text, bs, least_chars))
        places = F.array_distinct(F.concat(F.transform(F.filter(cs, lambda c: removable(c, least_chars)), place), runs))
        with_text = lambda lines: F.transform(
            places, lambda r: F.struct(r["first"].alias("first"), r["lines"].alias("lines"), F.array_join(F.slice(lines, r["first"], r["lines"]), "\n").alias("text"))
        )
        return let(F.split(text, "\n"), with_text)

    return let(chunks(text, divisor=divisor, long_words=long_words), both)


def dedup(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", divisor: int = 2, long_words: int = 50, least_chars: int = 20
) -> DataFrame:
    """The documents, all columns, with repeated runs of lines taken out of their texts.

    A line goes if it lies in a run of two lines or more and ``least_chars`` characters or more that occurs before, or is a
    long line that does; before is by document id, then text hash, then place. Long lines are chunks of their own, so no run
    goes across one. An occurrence that overlaps the first one stays. Every line's first occurrence stays. Null text stays
    null; a text that loses all lines becomes empty, the row stays. Null ids come first. Rows that agree in id and text
    count as one document and come out alike. Very long texts are cut whole. Repeats below ``least_chars`` characters (empty
    lines, brackets) stay. Other columns pass through, whatever their names. An empty table gives an empty result.
    """
    key = F.xxhash64(F.lit(1), text_col)
    place = F.struct(F.col(id_col).alias("id"), key.alias("k"))
    cut = candidates(F.col(text_col), divisor=divisor, long_words=long_words, least_chars=least_chars)
    found = docs.where(F.col(text_col).isNotNull()).select(place.alias("doc"), F.explode(cut).alias("c"))
    # 1. Hashes of runs that occur twice: counted before any text moves.
    hashes = found.select(F.xxhash64("c.text").alias("h"), F.length("c.text").alias("n"))
    repeated = written(hashes.groupBy("h", "n").agg(F.count(F.lit(1)).alias("times")).where(F.col("times") > 1).select("h", "n"), "line-hashes")
    # 2. Their occurrences, with the bytes. Joins that move texts are sort-merge at every size: no side is bounded, and
    # Spark splits skewed partitions of them.
    occurrence = found.select(
        F.xxhash64("c.text").alias("h"),
        F.length("c.text").alias("n"),
        F.struct("doc.id", "doc.k", "c.first").alias("place"),
        F.col("c.lines").alias("lines"),
        F.col("c.text").alias("text"),
    )
    occurrence = written(occurrence.join(repeated.hint("merge"), ["h", "n"]), "line-chunks")
    # 3. Equal bytes: the group is the text itself, the first place is kept.
    first = written(occurrence.groupBy("h", "n", "text").agg(F.min("place").alias("kept"), F.count(F.lit(1)).alias("times")).where(F.col("times") > 1), "line-firsts")
    gone = occurrence.join(first.withColumnRenamed("text", "same"), ["h", "n"]).where((F.col("text") == F.col("same")) & (F.col("place") != F.col("kept")))
    overlaps = F.col("place.id").eqNullSafe(F.col("kept.id")) & (F.col("place.k") == F.col("kept.k")) & (F.col("place.first") < F.col("kept.first") + F.col("lines"))
    gone = gone.where(~overlaps).select("place.id", "place.k", F.explode(F.sequence(F.col("place.first"), F.col("place.first") + F.col("lines") - 1)).alias("line"))
    lost, doc_key, text_key = fresh_names(docs, 3)
    per = gone.groupBy("id", "k").agg(F.collect_set("line").alias(lost))
    per = written(per.select(F.coalesce(F.xxhash64("id"), F.lit(0)).alias(doc_key), F.col("k").alias(text_key), lost), "line-gone")
    # 4. Documents lose those lines; texts travel once, by document.
    keyed = docs.withColumns({doc_key: F.coalesce(F.xxhash64(id_col), F.lit(0)), text_key: key})
    joined = keyed.join(per.hint("merge"), [doc_key, text_key], "left")
    stay = lambda lines: F.transform(F.array_except(indices(F.size(lines)), F.col(lost)), lambda i: F.element_at(lines, i))
    left = F.array_join(let(F.split(F.col(text_col), "\n"), stay), "\n")
    text = F.when(F.col(lost).isNull(), F.col(text_col)).otherwise(left)
    return joined.select(*(text.alias(c) if c == text_col else F.col(f"`{c}`") for c in docs.columns))
