import hashlib
import random
import re

from pyspark.sql import functions as F

from barflow.llm import secrets

KINDS = (
    ("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    ("access", r"AKIA[A-Z0-9]+", 0, 20),
    ("hex", r"[0-9a-f]+", 0, 24),
)


def brute(text):
    spans = []
    for k, (name, pattern, group, least) in enumerate(KINDS):
        spans += [(m.start(), k, name, m.end()) for m in re.finditer(pattern, text or "") if len(m.group(group)) >= least]
    return sorted(spans)


def texts():
    r = random.Random(4)
    hexes = ["".join(r.choice("0123456789abcdef") for _ in range(n)) for n in (23, 24, 64)]
    b64 = "".join(r.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/") for _ in range(48))
    return [
        None, "", "plain words only", f"é😀 Password = \"{hexes[0]}\" x", f"TOKEN: abcde api_key=abcdef\napikey : '{b64}'", "AKIA" + "A1" * 8 + " AKIA123",
        f"{hexes[1]}{hexes[2]} {hexes[0]}", "secret=secret=secret=abcdefg", f"𝔘 key {b64} end", " " + hexes[2], "a" * 200_000, (hexes[1] + " ") * 3000,
        "thequickbrownfoxjumpsoverthelazydogandrunsawayfromhome1", "2024010120240102202401032024", "passwd=ABC_DEF.123", "ab" * 40 + "1",
    ]


def test_base_spans_equal_brute_force(spark):
    rows = list(enumerate(texts())) + [(3, texts()[3])]
    df = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id bigint, text string, spans string")
    out = secrets.report(secrets.scan(df)).collect()
    assert len(out) == len(rows)
    for x in out:
        want = brute(texts()[x.doc_id])
        text = ",".join(f"{n}:{s}:{e}" for s, _, n, e in want)
        assert x.base_sha256 == hashlib.sha256(text.encode()).hexdigest(), x.doc_id
        assert (x.n_assign, x.n_access, x.n_hex) == tuple(sum(w[1] == k for w in want) for k in range(3))
        assert [s for s in x.spans.split(",") if s and not s.startswith("random")] == [s for s in text.split(",") if s]


def test_battery_tells_random_from_regular(spark):
    r = random.Random(9)
    alphabet = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
    good = ["".join(r.choice(alphabet) for _ in range(60)) for _ in range(100)]
    bad = ["Abcdefg1" * 8, "aB3" * 20, "0123456789" * 6 + "abc"]
    df = spark.createDataFrame([(t,) for t in good + bad], "t string")
    p = [row.b.p for row in df.select(secrets.battery(df.t).alias("b")).collect()]
    assert sum(x < 0.01 for x in p[:100]) <= 6 and all(x < 1e-4 for x in p[100:])
    assert df.limit(0).select(secrets.battery(df.t)).count() == 0


def test_random_tokens_are_added_and_prose_is_not(spark):
    r = random.Random(1)
    key = "".join(r.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789") for _ in range(40))
    df = spark.createDataFrame([(1, f"use {key} now"), (2, "averylongwordwithoutdigitsinit and more")], "doc_id bigint, text string")
    out = {x.doc_id: x.spans for x in secrets.report(secrets.scan(df)).collect()}
    assert out == {1: "random:4:44", 2: ""}


def test_empty_table(spark, no_docs):
    assert secrets.report(secrets.scan(no_docs)).count() == 0


def test_random_tokens_of_few_digits_and_long_ones_are_tested(spark):
    r = random.Random(6)
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
    drawn = ["".join(r.choice(letters + "0123456789") for _ in range(n)) for n in (20, 24, 32) for _ in range(300)]
    few = [t for t in drawn if sum(c.isdigit() for c in t) < 3]
    few.append("".join(r.choice(letters + "0123456789+/") for _ in range(3000)))
    few.append("".join(r.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567") for _ in range(600)))
    prose = ["thequickbrownfoxjumpsoverthelazydog", "a" * 3000, "abcdefgh" * 100, "-" * 40, "=" * 40]
    df = spark.createDataFrame(list(enumerate(few + prose)), "doc_id bigint, text string")
    assert df.where(F.size(secrets.candidates(F.col("text"))) == 1).count() == len(few) + len(prose) - 1
    out = {x.doc_id: x.n_random for x in secrets.report(secrets.scan(df)).collect()}
    assert len(few) > 150 and sum(out[i] for i in range(len(few))) >= 0.9 * len(few) and out[len(few) - 2] == out[len(few) - 1] == 1
    assert [out[i] for i in range(len(few), len(out))] == [0] * len(prose)


def test_tokens_around_equals_signs(spark):
    """A name, an equals sign and a key are two tokens; padding stays with its token; identifiers are none."""
    r = random.Random(12)
    alphabet = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    key = lambda n=40: "".join(r.choice(alphabet) for _ in range(n))
    shapes = ["DB_KEY={}", "https://host.example/get?sig={}&x=1", "x={}", "A_VERY_LONG_VARIABLE_NAME_OF_SORTS={}", "v={}==", "k=={}", "({}=)", "a={}=b"]
    rows = [(i, shape.format(key()), shape.index("{}")) for i, shape in enumerate(shapes * 5)]
    names = ["SOME_CONFIGURATION_OPTION_NAME=another_configuration_value", "averylongidentifierinprose=othervalueofwordstogether", "return_value=compute_the_result_of_this"]
    df = spark.createDataFrame([(i, t) for i, t, _ in rows] + [(1000 + i, t) for i, t in enumerate(names)], "doc_id bigint, text string")
    out = {x.doc_id: x.spans for x in secrets.report(secrets.scan(df)).collect()}
    hits = 0
    for i, text, at in rows:
        end = at + 40
        padded = end + len(re.match("=*", text[end:]).group()) if not re.match("=*[A-Za-z0-9]", text[end:]) else end
        hits += out[i] == f"random:{at}:{padded}"
        assert out[i] in (f"random:{at}:{padded}", ""), (text, out[i])
    assert hits >= 0.95 * len(rows) and [out[1000 + i] for i in range(3)] == [""] * 3
    found = df.where("doc_id = 4").select(F.explode(secrets.candidates(F.col("text"))).alias("c")).select("c.start", "c.end").collect()
    assert [tuple(x) for x in found] == [(2, 44)]
