"""License statements in texts, by MinHash bands over overlapping windows, in DataFrame functions alone.

A template is a statement as words; its tokens are its shingles of `width` words. A text's windows are all runs of as many
words as a template has, at every place; a text of fewer words is one window. A window's and a template's band keys are hashes of `rows` minima each; those
that share one of `bands` keys are compared by their exact shingles, and hold a match where at least `share` of the
template's are in the window. A window at the place of a statement with one word in ten changed has a similarity of
about 2/3 at least; 16 bands of 2 rows find it with a probability of 1 - (1 - 4/9)^16 = 0.9999, an unchanged one surely.

Equal minima mean an equal shingle, so windows without any template shingle can't be found and aren't hashed: words that
begin a template shingle are looked for first. The templates are a parameter of at most MOST_TEMPLATES statements, which
bounds what Spark may broadcast. Null and empty texts match nothing, nor do texts and templates of fewer than `width` words;
texts of any length are read whole; rows that repeat an id are reported together, as are those without id. Of windows that
tie the first is told. Without a match a document has no row, and an empty table gives none. Other columns aren't read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from evspark.llm.common import table

BANDS, ROWS, MOST_TEMPLATES = 16, 2, 10_000

# Common short license statements, by SPDX identifier.
TEMPLATES = {
    "AGPL-3.0": "This work is licensed under the GNU Affero General Public License, version 3.",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "BSD-2-Clause": "Licensed under the BSD 2-Clause License.",
    "BSD-3-Clause": "Licensed under the BSD 3-Clause License.",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0.",
    "CC0-1.0": "To the extent possible under law, the author has waived all copyright to this work.",
    "GPL-2.0": "This work is licensed under the GNU General Public License, version 2.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "ISC": "Released under the terms of the ISC License.",
    "LGPL-3.0": "This work is licensed under the GNU Lesser General Public License, version 3.",
    "MIT": "Released under the MIT License.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "Unlicense": "This is free and unencumbered software released into the public domain.",
}


def words_of(text: str) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(F.col(text), F.lit(""))), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def shingles_at(words: Column, starts: Column, width: int) -> Column:
    return F.transform(starts, lambda i: F.concat_ws(" ", *(F.get(words, i + k) for k in range(width))))


def band_keys(shingles: Column) -> Column:
    """A hash of ROWS minima for each band."""

    def least_by(n: int) -> Column:
        return F.array_min(F.transform(shingles, lambda s: F.xxhash64(s, F.lit(n))))

    least = [least_by(n) for n in range(BANDS * ROWS)]
    return F.array(*(F.xxhash64(F.lit(b), *least[b * ROWS : (b + 1) * ROWS]) for b in range(BANDS)))


def template_table(spark: SparkSession, templates: dict[str, str], width: int) -> DataFrame:
    """license, n_words, tokens (distinct shingles) of the templates that have a shingle."""
    if len(templates) > MOST_TEMPLATES:
        raise ValueError(f"more than {MOST_TEMPLATES} templates")
    rows = spark.createDataFrame(sorted(templates.items()), "license string, text string").select("license", words_of("text").alias("words"))
    rows = rows.filter(F.size("words") >= width).withColumn("n_words", F.size("words"))
    return rows.withColumn("tokens", F.array_distinct(shingles_at(F.col("words"), F.sequence(F.lit(0), F.col("n_words") - width), width)))


def license_matches(docs: DataFrame, templates: dict[str, str] = TEMPLATES, width: int = 5, share: float = 0.8, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, license, containment (of the best window), start_word (of the first such window), n_windows (that match)."""
    spark = docs.sparkSession
    known = template_table(spark, templates, width)
    listed = known.select("n_words", "tokens").collect()  # the templates: MOST_TEMPLATES at most
    tokens = sorted({t for r in listed for t in r.tokens})
    begins = sorted({t.partition(" ")[0] for t in tokens})
    lengths = sorted({r.n_words for r in listed})

    def hits(words: Column) -> Column:
        """Places of template shingles; words is bound once for each row."""
        places = F.when(F.size(words) >= width, F.sequence(F.lit(0), F.size(words) - width)).otherwise(F.array().cast("array<int>"))
        begun = F.filter(places, lambda i: F.get(words, i).isin(begins))
        return F.filter(begun, lambda i: F.concat_ws(" ", *(F.get(words, i + k) for k in range(width))).isin(tokens))

    found = docs.select(F.col(key).alias("_key"), F.transform(F.array(words_of(text)), lambda w: F.struct(w.alias("words"), hits(w).alias("hits")))[0].alias("_f"))
    found = found.filter(F.size("_f.hits") > 0).select("_key", F.col("_f.words").alias("words"), F.col("_f.hits").alias("hits"))
    windows = found.select("_key", "words", F.explode(F.array(*map(F.lit, lengths))).alias("n_words"), "hits").withColumn("n", F.least("n_words", F.size("words")))
    starts = F.array_distinct(F.flatten(F.transform("hits", lambda h: F.sequence(F.greatest(F.lit(0), h + width - F.col("n")), F.least(h, F.size("words") - F.col("n"))))))
    windows = windows.select("_key", "words", "n_words", "n", F.explode(starts).alias("start"))
    windows = windows.select("_key", "n_words", "start", F.array_distinct(shingles_at(F.col("words"), F.sequence(F.col("start"), F.col("start") + F.col("n") - width), width)).alias("seen"))
    banded = windows.select("_key", "n_words", "start", "seen", F.explode(F.array_distinct(band_keys(F.col("seen")))).alias("band"))
    wanted = known.select("license", "n_words", "tokens", F.explode(F.array_distinct(band_keys(F.col("tokens")))).alias("band"))
    pairs = banded.join(F.broadcast(wanted), ["band", "n_words"]).withColumn("containment", F.size(F.array_intersect("tokens", "seen")) / F.size("tokens"))
    matched = pairs.filter(F.col("containment") >= share).select("_key", "license", "start", "containment").distinct()
    best = matched.groupBy("_key", "license").agg(F.max(F.struct("containment", (-F.col("start")).alias("start"))).alias("best"), F.countDistinct("start").alias("n_windows"))
    return best.select(F.col("_key").alias(key), "license", F.col("best.containment").alias("containment"), (-F.col("best.start")).alias("start_word"), "n_windows")


def op9_license_scan(spark, sf_dir: str) -> DataFrame:
    return license_matches(table(spark, sf_dir, "documents"))


OP9_SQL = f"""
WITH t AS (
  SELECT license, regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]+') AS w
  FROM (VALUES {', '.join("('" + k + "', '" + v + "')" for k, v in TEMPLATES.items())}) AS x(license, text)
), k AS (
  SELECT license, len(w) AS n, list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i : i + 4], ' '))) AS tokens FROM t WHERE len(w) >= 5
), d AS (
  SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[\\p{{L}}\\p{{N}}]+') AS w FROM documents
), g AS (
  SELECT doc_id, p, array_to_string(w[p : p + 4], ' ') AS s, len(w) AS n_doc FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS p FROM d WHERE len(w) >= 5)
), h AS (
  SELECT g.doc_id, k.license, k.n, len(k.tokens) AS n_tokens, g.p, g.s, g.n_doc FROM g JOIN (SELECT license, n, tokens, unnest(tokens) AS s FROM k) k ON g.s = k.s
), s AS (
  SELECT doc_id, license, n_tokens, s, unnest(range(greatest(1, p + 5 - least(n, n_doc)), least(p, n_doc - least(n, n_doc) + 1) + 1)) AS start FROM h
), c AS (
  SELECT doc_id, license, start, CAST(count(DISTINCT s) AS DOUBLE) / n_tokens AS containment FROM s GROUP BY doc_id, license, n_tokens, start
), m AS (SELECT * FROM c WHERE containment >= 0.8)
SELECT doc_id, license, max(containment) AS containment, CAST(arg_max(start, containment * 1e9 - start) - 1 AS INTEGER) AS start_word, count(DISTINCT start) AS n_windows
FROM m GROUP BY doc_id, license
"""
