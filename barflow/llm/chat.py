"""Chat formatting: schema fingerprints select declarative mappings to canonical turns; a reversible template with a loss mask.

Native: variants, higher-order functions and one grouping by conversation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let, running_sum

TURNS = "array<struct<role:string,text:string>>"
#: The template's control strings. Inside texts and roles they are escaped.
CONTROL = ("<s>", "</s>", "[INST]", "[/INST]")

#: Layouts by example; a layout's fingerprint is that of its example, so that mappings stay declarative. Each maps variant
#: paths to turns: either a list path with role and text fields, or (role, path) pairs of single texts.
LAYOUTS: dict[str, dict] = {
    "turn_row": {"example": '{"role":"","text":""}', "single": (("$.role", "$.text"),)},
    "messages": {"example": '{"messages":[{"role":"","content":""}]}', "list": ("$.messages", "role", "content")},
    "conversations": {"example": '{"conversations":[{"from":"","value":""}]}', "list": ("$.conversations", "from", "value")},
    "instruction": {"example": '{"instruction":"","output":""}', "fixed": (("user", ("$.instruction",)), ("assistant", ("$.output",)))},
    "instruction_input": {
        "example": '{"instruction":"","input":"","output":""}',
        "fixed": (("user", ("$.instruction", "$.input")), ("assistant", ("$.output",))),
    },
    "prompt_response": {"example": '{"prompt":"","response":""}', "fixed": (("user", ("$.prompt",)), ("assistant", ("$.response",)))},
    "prompt_completion": {"example": '{"prompt":"","completion":""}', "fixed": (("user", ("$.prompt",)), ("assistant", ("$.completion",)))},
    "question_answer": {"example": '{"question":"","answer":""}', "fixed": (("user", ("$.question",)), ("assistant", ("$.answer",)))},
}
#: Names of roles in other layouts.
ROLES = {"human": "user", "gpt": "assistant", "model": "assistant", "bot": "assistant"}


def field_paths(record: Column) -> Column:
    """The nested field paths of a variant as one string; leaf types are left out, so that null fields change nothing.

    Spark lists an object's fields by name, so layouts that differ in field order alone agree.
    """
    return F.regexp_replace(F.schema_of_variant(record), r": (STRING|VOID|BIGINT|DOUBLE|BOOLEAN|DECIMAL\(\d+,\d+\))", "")


def fingerprint(record: Column) -> Column:
    return F.xxhash64(field_paths(record))


def _text(record: Column, path: str) -> Column:
    return F.coalesce(F.try_variant_get(record, path, "string"), F.lit(""))


def _listed(found: Column, role: str, text: str) -> Column:
    known = F.create_map(*[F.lit(x) for pair in ROLES.items() for x in pair])
    return F.transform(
        found, lambda t: F.struct(F.coalesce(F.element_at(known, t[role]), t[role]).alias("role"), F.coalesce(t[text], F.lit("")).alias("text"))
    )


def canonical_turns(record: Column) -> Column:
    """Turns of a variant record, by the mapping that its fingerprint selects; null for an unknown layout."""
    out = F.lit(None).cast(TURNS)
    turn = lambda role, text: F.struct(role.cast("string").alias("role"), text.cast("string").alias("text"))
    for layout in LAYOUTS.values():
        if "single" in layout:
            turns = F.array(*(turn(F.try_variant_get(record, r, "string"), _text(record, t)) for r, t in layout["single"]))
        elif "fixed" in layout:
            joined = lambda paths: F.array_join(F.filter(F.array(*(_text(record, p) for p in paths)), lambda x: x != ""), "\n")
            turns = F.array(*(turn(F.lit(role), joined(paths)) for role, paths in layout["fixed"]))
        else:
            at, role, text = layout["list"]
            turns = _listed(F.try_variant_get(record, at, f"array<struct<`{role}`:string,`{text}`:string>>"), role, text)
        out = F.when(fingerprint(record) == fingerprint(F.parse_json(F.lit(layout["example"]))), turns).otherwise(out)
    return out


def normalized(records: DataFrame, *, record_col: str = "record") -> DataFrame:
    """Heterogeneous records to canonical turns: the input's columns plus ``layout_fingerprint`` and ``turns``.

    ``record_col`` is a variant or JSON text. Records whose nested field paths no mapping knows, and texts that are not JSON,
    get null turns and keep their fingerprint, so that unknown layouts can be counted. Null fields are empty texts; turns
    keep their order; columns of the two new names are replaced. An empty table gives an empty result.
    """
    record = F.col(record_col)
    record = record if dict(records.dtypes)[record_col] == "variant" else F.try_parse_json(record)
    return records.withColumns({"layout_fingerprint": fingerprint(record), "turns": canonical_turns(record)})


def escape(text: Column) -> Column:
    """A backslash before every backslash and after the first character of every control string."""
    out = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    for c in CONTROL:
        out = F.replace(out, F.lit(c), F.lit(c[0] + "\\" + c[1:]))
    return out


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def format_turns(turns: Column) -> tuple[Column, Column]:
    """The formatted text, and the loss mask as array<struct<start, end>> of code points (end exclusive): assistant texts only.

    A turn is ``<s>[INST] role [/INST]text</s>``; a null role is written as ``\\N``, which no escaped role equals.
    """
    head = lambda t: F.concat(F.lit("<s>[INST] "), F.coalesce(escape(t["role"]), F.lit("\\N")), F.lit(" [/INST]"))
    body = lambda t: escape(F.coalesce(t["text"], F.lit("")))
    text = F.array_join(F.transform(turns, lambda t: F.concat(head(t), body(t), F.lit("</s>"))), "")
    pieces = F.flatten(F.transform(turns, lambda t: F.array(F.length(head(t)), F.length(body(t)) + 4)))
    spans = let(
        running_sum(pieces),
        lambda starts: F.transform(
            turns, lambda t, i: F.struct(F.element_at(starts, 2 * i + 2).alias("start"), F.length(body(t)).alias("n"), t["role"].alias("role"))
        ),
    )
    mask = F.transform(
        F.filter(spans, lambda s: F.coalesce(s["role"] == "assistant", F.lit(False))),
        lambda s: F.struct(s["start"].alias("start"), (s["start"] + s["n"]).alias("end")),
    )
    return text, mask


def conversations(rows: DataFrame, *, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Turn rows to one row per conversation: ``(conv_id, turns)``, rows by turn, then role and text; null text as empty.

    Every row is first a record of its own, mapped to a canonical turn by its fingerprint. Repeated rows are turns of
    their own; null turns come first; a null conv_id is one conversation. Other columns are ignored.
    """
    record = F.to_variant_object(F.struct(F.col(role_col).cast("string").alias("role"), F.coalesce(F.col(text_col), F.lit("")).cast("string").alias("text")))
    mapped = rows.select(F.col(conv_col).alias("conv_id"), F.col(turn_col).alias("turn"), canonical_turns(record).alias("said"))
    items = mapped.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "said"))).alias("items"))
    return items.select("conv_id", F.flatten(F.transform("items", lambda t: t["said"])).alias("turns"))


def formatted(convs: DataFrame) -> DataFrame:
    """``(conv_id, formatted, loss_mask)``; a conversation without turns is an empty text."""
    text, mask = format_turns(F.col("turns"))
    return convs.select("conv_id", text.alias("formatted"), mask.alias("loss_mask"))


def parse(text: Column) -> Column:
    """Turns read back from a formatted text as array<struct<role, text, n, end>>; n and end are the escaped text's length
    and its end in code points of the formatted text."""
    one = lambda s, g: F.regexp_extract(s, r"(?s)^<s>\[INST\] (.*?) \[/INST\](.*)$", g)

    def turn(s: Column) -> Column:
        role = one(s, 1)
        return F.struct(
            F.when(role != "\\N", unescape(role)).alias("role"),
            unescape(one(s, 2)).alias("text"),
            F.length(one(s, 2)).cast("bigint").alias("n"),
            F.length(s).cast("bigint").alias("all"),
        )

    def placed(read: Column) -> Column:
        ends = lambda at: F.zip_with(
            read, at, lambda t, a: F.struct(t["role"].alias("role"), t["text"].alias("text"), t["n"].alias("n"), (a + t["all"]).alias("end"))
        )
        return let(running_sum(F.transform(read, lambda t: t["all"] + 4)), ends)

    pieces = let(F.split(text, "</s>"), lambda ps: F.slice(ps, 1, F.size(ps) - 1))
    return let(F.transform(pieces, turn), placed)


def digests(done: DataFrame) -> DataFrame:
    """What the formatted texts and their masks hold, read back: one row per conversation."""

    def masked(turns: Column, mask: Column) -> Column:
        """Texts at the masked places. A span that is not exactly one assistant text, one too many or too few, is an error."""
        spoken = F.filter(turns, lambda t: F.coalesce(t["role"] == "assistant", F.lit(False)))
        fits = lambda t, m: F.coalesce((t["end"] == m["end"]) & (t["n"] == m["end"] - m["start"]), F.lit(False))
        wrong = F.raise_error(F.lit("the loss mask does not cover the assistant texts")).cast("string")
        return F.zip_with(spoken, mask, lambda t, m: F.when(fits(t, m), t["text"]).otherwise(wrong))

    def read(turns: Column) -> Column:
        whole = F.transform(turns, lambda t: F.concat(F.coalesce(t["role"], F.lit("")), F.lit("\n"), t["text"], F.lit("\n")))
        return F.struct(
            F.size(turns).cast("bigint").alias("n_turns"),
            F.sha2(F.array_join(whole, ""), 256).alias("turns_sha256"),
            F.array_join(masked(turns, F.col("loss_mask")), "").alias("under"),
        )

    found = done.select(
        "conv_id", F.length("formatted").cast("bigint").alias("formatted_chars"), F.explode(F.array(let(parse(F.col("formatted")), read))).alias("r")
    )
    return found.select(
        "conv_id",
        "r.n_turns",
        "r.turns_sha256",
        F.length("r.under").cast("bigint").alias("loss_chars"),
        F.sha2("r.under", 256).alias("loss_sha256"),
        "formatted_chars",
    )
