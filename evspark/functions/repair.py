"""Objects in JSON out of texts that hold more or are damaged: found, repaired and parsed in column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from evspark.functions.text import let

# Patterns of fenced blocks, reasoning and trailing commas.
FENCE = r"(?s)```(?:json|python)?\s*\n?(.*?)```"
THINK = r"(?is)<think>(.*?)</think>"
TRAILING_COMMA = r",\s*([}\]])"


def reasoning_of(text: Column) -> Column:
    """The parts between <think> and </think>, trimmed, one a line."""
    parts = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(THINK), F.lit(1))
    return F.array_join(F.transform(parts, lambda p: F.trim(p)), "\n")


def answer_of(text: Column) -> Column:
    """What is outside of them."""
    return F.regexp_replace(F.regexp_replace(F.coalesce(text, F.lit("")), THINK, ""), r"^\s+|\s+$", "")


def first_object(text: Column) -> Column:
    """The first balanced {...}; braces in quotes and characters after a backslash don't count. Null if there is none. A fold
    over the characters with the depth, the open quote and where the object begins and ends."""

    def state(i: Column, depth: Column, quote: Column, escaped: Column, start: Column, end: Column) -> Column:
        return F.struct(i.cast("int").alias("i"), depth.cast("int").alias("depth"), quote.cast("string").alias("quote"), escaped.cast("boolean").alias("escaped"), start.cast("int").alias("start"), end.cast("int").alias("end"))

    def step(s: Column, c: Column) -> Column:
        quoted, done = s["quote"] != "", s["end"] > 0
        quote = F.when(quoted & ~s["escaped"] & (c == s["quote"]), "").when(~quoted & c.isin('"', "'"), c).otherwise(s["quote"])
        opens, closes = ~quoted & (c == "{"), ~quoted & (c == "}") & (s["depth"] > 0)
        depth = s["depth"] + F.when(opens, 1).when(closes, -1).otherwise(0)
        start = F.when(opens & (s["depth"] == 0), s["i"]).otherwise(s["start"])
        end = F.when(closes & (s["depth"] == 1), s["i"]).otherwise(0)
        return F.when(done, s).otherwise(state(s["i"] + 1, depth, quote, quoted & ~s["escaped"] & (c == "\\"), start, end))

    first = state(F.lit(1), F.lit(0), F.lit(""), F.lit(False), F.lit(0), F.lit(0))
    found = let(text, lambda t: let(F.aggregate(F.split(t, ""), first, step), lambda s: F.when(s["end"] > 0, F.substring(t, s["start"], s["end"] - s["start"] + 1))))
    return F.when(text.contains("{"), found)


def repaired(text: Column) -> Column:
    """Without a fence and trailing commas, with plain quotes, true, false and null."""
    out = F.when(text.rlike(FENCE), F.regexp_extract(text, FENCE, 1)).otherwise(text)
    out = F.regexp_replace(F.trim(out), TRAILING_COMMA, "$1")
    out = F.regexp_replace(out, "[\u201c\u201d]", '"')
    for old, new in (("True", "true"), ("False", "false"), ("None", "null")):
        out = F.regexp_replace(out, rf"\b{old}\b", new)
    return out


def object_of(text: Column) -> Column:
    """The text as a variant if it is an object in JSON, else null."""
    return let(F.try_parse_json(text), lambda v: F.when(F.schema_of_variant(v).startswith("OBJECT"), v))


def parsed(text: Column) -> Column:
    """The object that a text is or holds, as a variant, or null: the text as it is; else a fenced block, the first balanced
    object and the text, each as it is and repaired, last with single quotes read as double where it has no double ones. What
    Spark's parser takes at once goes no further."""

    def tried(t: Column) -> Column:
        fenced = F.when(t.rlike(FENCE), F.regexp_extract(t, FENCE, 1))
        candidates = [fenced, first_object(t), t]
        quoted = [F.when(~c.contains('"'), F.translate(c, "'", '"')) for c in candidates]
        return F.coalesce(*(object_of(x) for c, q in zip(candidates, quoted) for x in (c, repaired(c), repaired(q))))

    return let(text, lambda t: F.coalesce(object_of(t), tried(t)))
