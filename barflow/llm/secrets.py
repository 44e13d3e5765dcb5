"""Secret scan: base patterns plus a randomness test battery with false-discovery control.

A token is a discovery if the battery does not reject that it is random, and its evidence against written text is strong
enough: the null hypothesis that is controlled is "this is text", so what is reported by mistake is bounded, and a token
too short for any evidence is never reported. Native: one narrow pass over the texts, no shuffle of texts.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import indices, let, running_sum, written

#: Kinds in the order in which equal starts are listed, their patterns, the group that is tested and its least length.
BASE = (
    ("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    ("access", r"AKIA[A-Z0-9]+", 0, 20),
    ("hex", r"[0-9a-f]+", 0, 24),
)
RANDOM = ("random", r"[A-Za-z0-9+/_-]+=*")
#: Encodings tried in order: name, pattern of a whole token, alphabet (the position in it is the symbol's value).
ENCODINGS = (
    ("hex", "^([0-9a-f]+|[0-9A-F]+)$", "0123456789abcdef"),
    ("base32", "^[A-Z2-7]+=*$", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"),
    ("lower", "^[a-z0-9]+=*$", "abcdefghijklmnopqrstuvwxyz0123456789"),
    ("base62", "^[A-Za-z0-9]+=*$", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"),
    ("base64", "^[A-Za-z0-9+/_-]+=*$", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"),
)
#: Classes of characters whose shares are tested; what else an alphabet has is one more class.
CLASSES = ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789")
#: The model of written text (prose, identifiers, paths, dates): the chance of the next character's class, lower case, upper
#: case, digit or other (columns), after each of them (rows).
NEXT = ((0.80, 0.10, 0.04, 0.06), (0.60, 0.30, 0.05, 0.05), (0.08, 0.07, 0.75, 0.10), (0.40, 0.25, 0.25, 0.10))
#: Letters of English text in percent, a to z.
LETTERS = (8.2, 1.5, 2.8, 4.3, 12.7, 2.2, 2.0, 6.1, 7.0, 0.15, 0.77, 4.0, 2.4, 6.7, 7.5, 1.9, 0.095, 6.0, 6.3, 9.1, 2.8, 0.98, 2.4, 0.15, 2.0, 0.074)
EVERY = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
#: Upper ends of the length strata within which discoveries are controlled.
STRATA = (24, 32, 40, 64, 128)
OPEN, CLOSE, OTHER = "\ue000", "\ue001", "\ue002"


def matches(text: Column, pattern: str) -> Column:
    """Leftmost non-overlapping matches as array<struct<start, end, s>>; code points, end exclusive.

    Marks are put around every match, the text is cut at the marks and lengths are summed up. Marks that
    the text holds itself are first replaced by another character of the same length.
    """
    clean = F.translate(text, OPEN + CLOSE, OTHER + OTHER)
    parts = F.split(F.regexp_replace(clean, F.lit(pattern), F.lit(f"{OPEN}$0{CLOSE}")), OPEN)

    def spans(ps: Column) -> Column:
        lengths = F.transform(ps, lambda p: F.length(p) - F.when(F.instr(p, CLOSE) > 0, 1).otherwise(0))
        return let(
            running_sum(lengths),
            lambda at: F.transform(
                indices(F.size(ps) - 1),
                lambda i: let(
                    F.substring_index(F.element_at(ps, i + 1), CLOSE, 1),
                    lambda s: F.struct(
                        F.element_at(at, i + 1).alias("start"),
                        (F.element_at(at, i + 1) + F.length(s)).alias("end"),
                        s.alias("s"),
                    ),
                ),
            ),
        )

    none = F.array().cast("array<struct<start:bigint,end:bigint,s:string>>")
    return F.when(text.rlike(pattern), let(parts, spans)).otherwise(none)


def base_spans(text: Column, kind: int) -> Column:
    """Spans of one base kind as array<struct<start, order, kind, end>>; matches that fail the length rule are dropped."""
    name, pattern, group, least = BASE[kind]
    # A run that is too short can never pass, so the marks go only around runs of the least length where the
    # pattern is one class of characters; for the other patterns every match is marked, then tested.
    if name == "hex":
        pattern = f"[0-9a-f]{{{least},}}"
    found = matches(text, pattern)
    if group:
        value = lambda m: F.regexp_extract(m["s"], f"^{pattern}$", group)
        found = F.filter(found, lambda m: F.length(value(m)) >= least)
    elif name == "access":
        found = F.filter(found, lambda m: F.length(m["s"]) >= least)
    return F.transform(found, lambda m: _span(m["start"], F.lit(kind), F.lit(name), m["end"]))


def _span(start: Column, order: Column, kind: Column, end: Column) -> Column:
    return F.struct(start.alias("start"), order.alias("order"), kind.alias("kind"), end.alias("end"))


def _two_sided(z: Column) -> Column:
    """P(|Z| > |z|) for the standard normal distribution: erfc by a rational approximation with error below 1.2e-7."""

    def erfc(x: Column) -> Column:
        def at(t: Column) -> Column:
            #: Coefficients of the approximation, from the highest power down.
            poly: Column = F.lit(0.17087277)
            for c in (-0.82215223, 1.48851587, -1.13520398, 0.27886807, -0.18628806, 0.09678418, 0.37409196, 1.00002368, -1.26551223):
                poly = poly * t + c
            return t * F.exp(poly - x * x)

        return let(1 / (1 + 0.5 * x), at)

    return F.least(F.lit(1.0), let(F.abs(z) / math.sqrt(2), erfc))


def _held(text: Column, chars: str) -> Column:
    """How many characters of ``text`` are among ``chars``."""
    return (F.length(text) - F.length(F.translate(text, chars, ""))).cast("double")


def text_costs() -> list[float]:
    """Bits of each character of ``EVERY`` within its class in written text; letters are mixed with a tenth of uniform ones."""
    letters = [-math.log2(0.9 * x / sum(LETTERS) + 0.1 / 26) for x in LETTERS]
    return [*letters, *letters, *[math.log2(10)] * 10, 1.0, 1.0]


def battery(token: Column) -> Column:
    """struct<encoding, n, p, text_p>: the inferred encoding, the tested length, the battery's p-value under 'uniformly random'
    and the p-value under 'written text'.

    Chi-squared uniformity of the encoding's alphabet (both sides) and of its classes (upper case, lower case, digits,
    others), Wald-Wolfowitz runs of high and low symbols and lag-1 serial correlation; the least p-value times four. The
    classes are few, so that words and identifiers fail at lengths at which the whole alphabet has less than one symbol
    a cell. ``text_p`` is the token's likelihood as text over that as a random string of its encoding, 1 at most: by Markov's
    inequality no text model reaches a ratio of x or less more often than with chance x, at any length. Tokens of no encoding
    get null.
    """
    kind = lambda at: F.when(at <= 26, 1).when(at <= 52, 0).when(at <= 62, 2).otherwise(3)
    steps_cost = F.array(*(F.lit(-math.log2(p)) for row in NEXT for p in row))
    costs = F.array(*map(F.lit, text_costs()))

    def bits(text: Column) -> Column:
        """Bits of the text under the model of written text."""

        def walk(at: Column) -> Column:
            change = lambda i: F.element_at(steps_cost, 4 * kind(F.element_at(at, i)) + kind(F.element_at(at, i + 1)) + 1)
            own = F.aggregate(at, F.lit(2.0), lambda a, x: a + F.element_at(costs, x))  # two bits: the first one's class
            return F.aggregate(indices(F.size(at) - 1), own, lambda a, i: a + change(i))

        symbols = F.filter(F.split(text, ""), lambda c: c != "")
        return let(F.transform(symbols, lambda c: F.instr(F.lit(EVERY), c)), walk)

    def sums(text: Column, alphabet: Column, values: Column) -> Column:
        # One pass over the text per symbol of the alphabet, so that long tokens take linear time.
        size = F.length(alphabet).cast("double")
        symbols = F.filter(F.split(alphabet, ""), lambda c: c != "")
        counts = F.transform(symbols, lambda c: (F.length(text) - F.length(F.replace(text, c, F.lit("")))).cast("double"))
        classes = F.array(*(F.struct(_held(alphabet, c).alias("cells"), _held(text, c).alias("count")) for c in CLASSES))
        rest = F.struct(*((F.length(x) - sum((_held(x, c) for c in CLASSES), F.lit(0.0))).alias(n) for x, n in ((alphabet, "cells"), (text, "count"))))
        classes = F.filter(F.array_append(classes, rest), lambda c: c["cells"] > 0)
        mid = (size - 1) / 2
        high = lambda i: F.element_at(values, i) >= size / 2
        start = F.struct(*(F.lit(0.0).alias(x) for x in ("runs", "serial")))
        steps = F.aggregate(
            indices(F.size(values) - 1),
            start,
            lambda a, i: F.struct(
                (a["runs"] + F.when(high(i) == high(i + 1), 0.0).otherwise(1.0)).alias("runs"),
                (a["serial"] + (F.element_at(values, i) - mid) * (F.element_at(values, i + 1) - mid)).alias("serial"),
            ),
        )
        return F.struct(
            F.size(values).cast("double").alias("n"),
            F.aggregate(counts, F.lit(0.0), lambda a, c: a + c * c).alias("squares"),
            F.size(F.filter(values, lambda v: v >= size / 2)).cast("double").alias("ones"),
            steps.alias("steps"),
            size.alias("size"),
            F.size(classes).cast("double").alias("classes"),
            # sum of count^2 / share, the share being that of the class in the alphabet
            F.aggregate(classes, F.lit(0.0), lambda a, c: a + c["count"] * c["count"] * size / c["cells"]).alias("class_squares"),
        )

    def scores(s: Column) -> Column:
        n, k = s["n"], s["size"] - 1
        # The statistic's mean is k and its variance 2k (n - 1) / n, also with few symbols a cell; then the cube-root approximation.
        normal = lambda chi, k: (F.pow(F.greatest(F.lit(0.0), chi / k), F.lit(1 / 3)) - (1 - 2 / (9 * k))) / F.sqrt(2 / (9 * k))
        chi = (s["squares"] * s["size"] / n - n - k) / F.sqrt((n - 1) / n) + k
        mean_runs = 1 + 2 * s["ones"] * (n - s["ones"]) / n
        var_runs = (mean_runs - 1) * (mean_runs - 2) / (n - 1)
        return F.struct(
            normal(chi, k).alias("chi"),
            # one-sided: shares nearer to the expected ones than chance are no sign of order with so few cells
            F.greatest(F.lit(0.0), normal(s["class_squares"] / n - n, s["classes"] - 1)).alias("classes"),
            F.when(var_runs > 0, (1 + s["steps"]["runs"] - mean_runs) / F.sqrt(var_runs)).otherwise(F.sqrt(n)).alias("runs"),
            (s["steps"]["serial"] / ((s["size"] * s["size"] - 1) / 12 * F.sqrt(n - 1))).alias("serial"),
            n.cast("int").alias("n"),
            (n * F.log2(s["size"])).alias("random_bits"),
        )

    def tested(e: Column) -> Column:
        text = e["body"]
        values = F.transform(F.filter(F.split(text, ""), lambda c: c != ""), lambda c: (F.instr(e["alphabet"], c) - 1).cast("double"))
        least = lambda z: F.least(F.lit(1.0), 4 * F.least(*(_two_sided(z[x]) for x in ("chi", "classes", "runs", "serial"))))
        text_p = lambda z: F.pow(F.lit(2.0), F.least(F.lit(0.0), z["random_bits"] - bits(text)))
        made = lambda z: F.struct(e["name"].alias("encoding"), z["n"].alias("n"), least(z).alias("p"), text_p(z).alias("text_p"))
        return let(let(values, lambda v: let(sums(text, e["alphabet"], v), scores)), made)

    body = F.rtrim(F.translate(token, "_-", "/+"), F.lit("="))
    choice = F.lit(None).cast("struct<name:string,alphabet:string,body:string>")
    for name, pattern, alphabet in reversed(ENCODINGS):
        choice = F.when(token.rlike(pattern), F.struct(F.lit(name).alias("name"), F.lit(alphabet).alias("alphabet"), (F.lower(body) if name == "hex" else body).alias("body"))).otherwise(choice)
    return let(choice, lambda e: F.when(e["name"].isNotNull(), tested(e)))


def candidates(text: Column, least: int = 20) -> Column:
    """Tokens for the battery: every run of encoded characters, ``least`` long or longer, that some encoding can read.

    An equals sign belongs to a token as padding at its end alone; else it stands between a name and what the name is given, two
    tokens. Nothing else is asked of a token, neither digits nor a greatest length: prose, identifiers and paths are left to the tests.
    """
    some = "[A-Za-z0-9+/_-]"
    # A token begins where a run does, so no run is read from each of its characters.
    found = matches(text, f"(?<!{some}){some}{{{least - 2},}}+(?:={{1,2}}(?![A-Za-z0-9+/_=-]))?")
    found = F.filter(found, lambda m: m["end"] - m["start"] >= least)
    tested = F.transform(found, lambda m: F.struct(m["start"].alias("start"), m["end"].alias("end"), battery(m["s"]).alias("b")))
    return F.filter(tested, lambda m: m["b"].isNotNull())


def _stratum(n: Column) -> Column:
    out: Column = F.lit(len(STRATA))
    for i in reversed(range(len(STRATA))):
        out = F.when(n <= STRATA[i], i).otherwise(out)
    return out


def _bin(p: Column) -> Column:
    """Bins of -log10 p in hundredths, 1500 at most: the ranking needs no global sort."""
    return F.least(F.lit(1500), F.floor(-100 * F.log10(F.greatest(p, F.lit(1e-15))))).cast("int")


def evidence(tested: Column, alpha: float) -> Column:
    """A token's p-value under 'written text'; 1 if the battery rejects that it is random at level ``alpha``."""
    return F.when(tested["p"] < alpha, 1.0).otherwise(tested["text_p"])


def discovery_bins(tokens: DataFrame, q: float) -> dict[int, int]:
    """Per length stratum the least bin of ``tokens(n, p)`` that is discovered at false-discovery rate ``q``.

    Benjamini-Hochberg over a histogram: at most 6 strata x 1501 bins, however many tokens there are. A bin counts with
    its largest p-value, so the rate is held. Strata have thresholds of their own: long tokens with much evidence don't
    carry short ones with little, nor do many short ones drown the long.
    """
    rows = tokens.groupBy(_stratum(F.col("n")).alias("s"), _bin(F.col("p")).alias("bin")).count().collect()
    out: dict[int, int] = {}
    for s in {r["s"] for r in rows}:
        bins = sorted(((r["bin"], r["count"]) for r in rows if r["s"] == s), reverse=True)
        total, seen = sum(n for _, n in bins), 0
        for b, n in bins:
            seen += n
            if 10 ** (-b / 100) <= q * seen / total:
                out[s] = b
    return out


def scan(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", q: float = 0.05, alpha: float = 0.001, least: int = 20) -> DataFrame:
    """Spans of secrets in every row: ``(id, spans array<struct<start, order, kind, end>>)``, ordered by start, then kind.

    Base kinds come from fixed patterns. Tokens of ``least`` characters or more that the battery does not reject as random at
    level ``alpha`` and whose evidence against written text is discovered at false-discovery rate ``q`` within their length
    stratum are added as kind ``random`` where no base span overlaps them; base spans stay. Null text: as empty. Null ids and
    repeated rows: each row has its own result. Very long texts and tokens are tested whole. Other columns are not read; an
    empty table gives an empty result. Texts are read once: their spans and tested tokens are written, then judged.
    """
    base = F.concat(*(base_spans(F.col("text"), k) for k in range(len(BASE))))
    tested = F.transform(candidates(F.col("text"), least), lambda m: F.struct(m["start"].alias("start"), m["end"].alias("end"), m["b"]["n"].alias("n"), evidence(m["b"], alpha).alias("p")))
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    found = written(rows.select("id", base.alias("base"), tested.alias("tokens")), "secrets")
    limits = discovery_bins(found.select(F.explode("tokens").alias("t")).select("t.n", "t.p"), q)

    def is_secret(m: Column) -> Column:
        limit = F.lit(None).cast("int")
        for s, b in sorted(limits.items()):
            limit = F.when(_stratum(m["n"]) == s, b).otherwise(limit)
        return F.coalesce(_bin(m["p"]) >= limit, F.lit(False))

    free = lambda m: ~F.exists("base", lambda b: (b["start"] < m["end"]) & (m["start"] < b["end"]))
    added = F.transform(F.filter("tokens", lambda m: is_secret(m) & free(m)), lambda m: _span(m["start"], F.lit(len(BASE)), F.lit(RANDOM[0]), m["end"]))
    return found.select("id", F.array_sort(F.concat("base", added)).alias("spans"))


def joined(spans: Column) -> Column:
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ","
    )


def report(scanned: DataFrame, id_name: str = "doc_id") -> DataFrame:
    """Counts and digests of the spans, one row per scanned row."""
    spans = F.col("spans")
    count = lambda k: F.size(F.filter(spans, lambda s: s["kind"] == k)).cast("bigint")
    return scanned.select(
        F.col("id").alias(id_name),
        *(count(kind[0]).alias(f"n_{kind[0]}") for kind in BASE),
        F.sha2(joined(F.filter(spans, lambda s: s["kind"] != RANDOM[0])), 256).alias("base_sha256"),
        joined(spans).alias("spans"),
        count(RANDOM[0]).alias("n_random"),
    )
