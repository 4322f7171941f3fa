"""Text and token kernels as column expressions. All words are ASCII words; accented letters end a word."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Words that carry no content.
STOPWORDS = (
    "a an the and or but if then else of to in on for with without by from as at is are was were be been being it its this "
    "that these those we you they he she i not no do does did can could should would may might will shall must have has had "
    "there here when while which who whom whose what how why into over under above below than so such very more most some any each"
).split()

# Endings that a stem loses, longest meaning first, and spellings that are one.
SUFFIXES = ("ations", "ation", "ities", "ings", "edly", "ies", "ing", "ers", "es", "ed", "s")
SPELLINGS = (("ization", "isation"), ("ize", "ise"), ("yze", "yse"))

# Patterns of words, and of sentences that ask, refer to the reader or tell them what to do.
WORD = r"[A-Za-z_][A-Za-z0-9_]*|[0-9]+(?:\.[0-9]+)?"
QUESTION = r"\?\s*$"
SELF_REFERENCE = r"(?i)\b(your|you|line [0-9]+|iteration|trace|walk through|what happens|notice|compare|hand)\b"
INSTRUCTION = (
    r"(?i)^\s*(?:then\s+|now\s+|first\s+|next\s+)?(state|count|write|check|compare|draw|list|take|trace|name|identify|derive|"
    r"revisit|try|pick|substitute|iterate|multiply|assume|predict|work|step|walk|ask|read|explain|show|find|choose|consider|"
    r"note|observe|calculate|evaluate|verify|describe|record|follow|separate|distinguish|prove|reason|sketch|enumerate|treat|"
    r"track|hand-execute|re-read|look|examine|inspect|focus|recall|remember|imagine|suppose|think|reflect|run|re-run|rerun|"
    r"test|experiment|print)\b"
)


def let(value: Column, f) -> Column:
    """f of a value that is worked out once for each row, though f uses it within other functions' arguments."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def cut_end(word: Column, n: int) -> Column:
    return F.substring(word, F.lit(1), F.length(word) - n)


def british(word: Column) -> Column:
    """-ization, -ize and -yze as -isation, -ise and -yse, where more than two letters precede."""
    out = word
    for old, new in reversed(SPELLINGS):
        out = F.when(F.endswith(word, F.lit(old)) & (F.length(word) > len(old) + 2), F.concat(cut_end(word, len(old)), F.lit(new))).otherwise(out)
    return out


def suffix_of(word: Column) -> Column:
    """The longest suffix that leaves three letters; empty if there is none."""
    return F.regexp_extract(word, f"^.{{3,}}?({'|'.join(SUFFIXES)})$", 1)


def without(word: Column, suffix: Column) -> Column:
    """The word without its suffix, if it has more than four letters."""
    left = F.substring(word, F.lit(1), F.length(word) - F.length(suffix))
    out = F.when(suffix == "ies", F.concat(left, F.lit("y"))).when(suffix.isin("ation", "ations") & ~F.endswith(left, F.lit("e")), F.concat(left, F.lit("e"))).otherwise(left)
    return F.when((F.length(word) <= 4) | (suffix == ""), word).otherwise(out)


def stem(word: Column) -> Column:
    """The word without its first matching suffix, if it has more than four letters and three stay."""
    return without(british(word), suffix_of(british(word)))


def identifier_parts(word: Column) -> Column:
    """lowerBound_idx -> lower, bound, idx."""
    spaced = F.trim(F.translate(F.regexp_replace(word, "([a-z0-9])([A-Z])", "$1 $2"), "_", " "))
    plain = ~word.rlike("_|[a-z0-9][A-Z]")  # most words have one part
    return F.when(plain | (spaced == ""), F.array(F.lower(word))).otherwise(F.split(F.lower(spaced), " +"))


def prose_tokens(text: Column, stemmed: bool = True, keep_stopwords: bool = False) -> Column:
    """Terms of a text, in order and with repeats: parts of words of two letters or more, or digits, that aren't stopwords."""
    words = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(WORD), F.lit(0))
    parts = F.flatten(F.transform(words, identifier_parts))
    kept = F.filter(parts, lambda p: ((F.length(p) >= 2) | p.rlike("^[0-9]+$")) & (F.lit(True) if keep_stopwords else ~p.isin(STOPWORDS)))
    return F.transform(kept, stem) if stemmed else kept


def exploded_terms(rows: DataFrame, text: str, stemmed: bool = True) -> DataFrame:
    """A row for each term of prose_tokens, as `term` beside the other columns. Words are exploded first, so that parts and
    stems are plain expressions of a row, in generated code, rather than of an array's elements."""
    others = [c for c in rows.columns if c != text]
    words = rows.select(*others, F.explode(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(WORD), F.lit(0))).alias("word"))
    parts = words.select(*others, F.explode(identifier_parts(F.col("word"))).alias("part"))
    kept = parts.filter(((F.length("part") >= 2) | F.col("part").rlike("^[0-9]+$")) & ~F.col("part").isin(STOPWORDS))
    if not stemmed:
        return kept.withColumnRenamed("part", "term")
    spelt = kept.select(*others, british(F.col("part")).alias("part"))  # used more than once below, so Spark keeps the steps apart
    return spelt.select(*others, "part", suffix_of(F.col("part")).alias("suffix")).select(*others, without(F.col("part"), F.col("suffix")).alias("term"))


def sentences(text: Column) -> Column:
    """Trimmed sentences of more than two characters, cut after . ! ? before a capital or bracket, and at blank lines."""
    marked = F.regexp_replace(F.coalesce(text, F.lit("")), r"([.!?])\s+([A-Z(\[])", "$1\u0001$2")
    cut = F.split(F.regexp_replace(marked, r"\n{2,}", "\u0001"), "\u0001")
    return F.filter(F.transform(cut, lambda s: F.regexp_replace(s, r"^\s+|\s+$", "")), lambda s: F.length(s) > 2)


def ascii_ends(pattern: str) -> str:
    """The pattern with \\b between an ASCII word character and anything else, as all words are: Java's \\b takes accented
    letters for parts of a word up to version 18, and not from 19 on."""
    return pattern.replace(r"\b", r"(?:(?<=[A-Za-z0-9_])(?![A-Za-z0-9_])|(?<![A-Za-z0-9_])(?=[A-Za-z0-9_]))")


def claim_kind(sentence: Column) -> Column:
    told, done = ascii_ends(SELF_REFERENCE), ascii_ends(INSTRUCTION)
    return F.when(sentence.rlike(QUESTION), "question").when(sentence.rlike(told), "self-reference").when(sentence.rlike(done), "instruction").otherwise("assertion")


def ngrams(items: Column, n: int) -> Column:
    """All runs of n items; none if there are fewer."""
    if n <= 0:
        raise ValueError("n must be positive")

    def of(own: Column) -> Column:
        starts = F.when(F.size(own) >= n, F.sequence(F.lit(1), F.size(own) - n + 1)).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda i: F.slice(own, i, n))

    return let(items, of)


def char_ngrams(text: Column, n: int) -> Column:
    """Distinct n-grams of the text in lower case with single spaces; the whole text if it is shorter, none if it is empty."""

    def of(plain: Column) -> Column:
        grams = F.transform(F.sequence(F.lit(1), F.greatest(F.length(plain) - n + 1, F.lit(1))), lambda i: F.substring(plain, i, F.lit(n)))
        return F.when(plain == "", F.array().cast("array<string>")).otherwise(F.array_distinct(grams))

    return let(F.lower(F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " "))), of)


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays of distinct items; 0 for two empty ones."""
    common, union = F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b))
    return F.when(union == 0, 0.0).otherwise(common / union)


def containment(query: Column, corpus: Column) -> Column:
    """The share of query's distinct items that corpus has; 0 if there are none."""
    return F.when(F.size(query) == 0, 0.0).otherwise(F.size(F.array_intersect(query, corpus)) / F.size(query))


def edit_distance_ratio(a: Column, b: Column) -> Column:
    """Levenshtein distance over the longer length; 0 for equal texts."""
    return F.when(a == b, 0.0).otherwise(F.levenshtein(a, b) / F.greatest(F.length(a), F.length(b)))


def kgram_hashes(tokens: Column, k: int) -> Column:
    """Hashes of runs of k tokens; of all tokens if there are fewer, none if there are none."""

    def of(own: Column) -> Column:
        joined = F.transform(ngrams(own, k), lambda g: F.md5(F.array_join(g, "\x1f")))
        return F.when(F.size(own) == 0, F.array().cast("array<string>")).when(F.size(own) < k, F.array(F.md5(F.array_join(own, "\x1f")))).otherwise(joined)

    return let(tokens, of)


def truncated(text: Column, width: int, ellipsis: str = "…") -> Column:
    """The text, cut to width characters with an ellipsis if it is longer."""
    if width <= len(ellipsis):
        return F.substring(text, 1, width)
    cut = F.regexp_replace(F.substring(text, 1, width - len(ellipsis)), r"\s+$", "")
    return F.when(F.length(text) <= width, text).otherwise(F.concat(cut, F.lit(ellipsis)))
