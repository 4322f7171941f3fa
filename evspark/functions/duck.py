"""The SQL of the text kernels, written for DuckDB apart from the Spark expressions that it is compared with."""

from __future__ import annotations

from evspark.functions.text import INSTRUCTION, QUESTION, SELF_REFERENCE, SPELLINGS, STOPWORDS, SUFFIXES, WORD


def british(w: str) -> str:
    return "CASE " + " ".join(f"WHEN suffix({w}, '{old}') AND length({w}) > {len(old) + 2} THEN left({w}, length({w}) - {len(old)}) || '{new}'" for old, new in SPELLINGS) + f" ELSE {w} END"


def stem(w: str) -> str:
    """Of a word in British spelling."""
    def left(s: str) -> str:
        cut = f"left({w}, length({w}) - {len(s)})"
        return f"{cut} || 'y'" if s == "ies" else f"CASE WHEN suffix({cut}, 'e') THEN {cut} ELSE {cut} || 'e' END" if s in ("ation", "ations") else cut
    return f"CASE WHEN length({w}) <= 4 THEN {w} " + " ".join(f"WHEN suffix({w}, '{s}') AND length({w}) >= {len(s) + 3} THEN {left(s)}" for s in SUFFIXES) + f" ELSE {w} END"


def tokens(text: str, stemmed: bool = True) -> str:
    words = f"regexp_extract_all(coalesce({text}, ''), '{WORD}')"
    spaced = r"trim(replace(regexp_replace(w, '([a-z0-9])([A-Z])', '\1 \2', 'g'), '_', ' '))"
    parts = f"flatten(list_transform({words}, lambda w: CASE WHEN {spaced} = '' THEN [lower(w)] ELSE regexp_split_to_array(lower({spaced}), ' +') END))"
    stop = ", ".join(f"'{s}'" for s in STOPWORDS)
    kept = f"list_filter({parts}, lambda p: (length(p) >= 2 OR regexp_full_match(p, '[0-9]+')) AND p NOT IN ({stop}))"
    return f"list_transform(list_transform({kept}, lambda p: {british('p')}), lambda q: {stem('q')})" if stemmed else kept


def sentences(text: str) -> str:
    marked = rf"regexp_replace(regexp_replace(coalesce({text}, ''), '([.!?])\s+([A-Z(\[])', '\1' || chr(1) || '\2', 'g'), '\n{{2,}}', chr(1), 'g')"
    return rf"list_filter(list_transform(string_split({marked}, chr(1)), lambda s: regexp_replace(s, '^\s+|\s+$', '', 'g')), lambda s: length(s) > 2)"


def claim_kind(s: str) -> str:
    return f"CASE WHEN regexp_matches({s}, '{QUESTION}') THEN 'question' WHEN regexp_matches({s}, '{SELF_REFERENCE}') THEN 'self-reference' WHEN regexp_matches({s}, '{INSTRUCTION}') THEN 'instruction' ELSE 'assertion' END"


def grams(tokens_: str, k: int) -> str:
    return f"CASE WHEN len({tokens_}) = 0 THEN [] WHEN len({tokens_}) < {k} THEN [md5(array_to_string({tokens_}, chr(31)))] ELSE list_transform(range(1, len({tokens_}) - {k - 2}), lambda i: md5(array_to_string({tokens_}[i : i + {k - 1}], chr(31)))) END"


def trigrams(text: str, n: int = 3) -> str:
    plain = rf"lower(trim(regexp_replace(coalesce({text}, ''), '\s+', ' ', 'g')))"
    return f"CASE WHEN {plain} = '' THEN [] ELSE list_distinct(list_transform(range(1, greatest(length({plain}) - {n - 1}, 1) + 1), lambda i: substring({plain}, i, {n}))) END"
