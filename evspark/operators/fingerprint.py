"""Fingerprints of token sequences, containment and the novelty gate built on them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from evspark.functions.text import kgram_hashes, prose_tokens


def exact_duplicates(docs: DataFrame, key: str, text: str) -> DataFrame:
    """fingerprint, n, first of the texts that occur more than once."""
    return docs.groupBy(F.md5(text).alias("fingerprint")).agg(F.count("*").alias("n"), F.min(key).alias("first")).filter("n > 1")


def fingerprints(docs: DataFrame, key: str, text: str, k: int = 5) -> DataFrame:
    """id, pos, hash of every k-gram."""
    return docs.select(F.col(key).alias("id"), F.posexplode(kgram_hashes(prose_tokens(F.col(text), stemmed=False, keep_stopwords=False), k)).alias("pos", "hash"))


def ladder_fingerprints(docs: DataFrame, key: str, text: str, short: int = 7) -> DataFrame:
    """id, k, pos, hash of every k-gram: three tokens in texts of fewer than `short`, else five."""
    tokens = prose_tokens(F.col(text), stemmed=False, keep_stopwords=False)
    rows = docs.select(F.col(key).alias("id"), tokens.alias("t"))
    small = F.size("t") < short
    hashes = F.when(small, kgram_hashes(F.col("t"), 3)).otherwise(kgram_hashes(F.col("t"), 5))
    return rows.select("id", F.when(small, 3).otherwise(5).alias("k"), F.posexplode(hashes).alias("pos", "hash"))


def winnowed(prints: DataFrame, window: int = 4) -> DataFrame:
    """The k-grams that winnowing selects: of each full window the smallest hash, the last such; all of up to `window` k-grams."""
    sized = prints.withColumn("n", F.count("*").over(Window.partitionBy("id")))
    ahead = Window.partitionBy("id").orderBy("pos").rowsBetween(0, window - 1)
    chosen = sized.withColumn("best", F.min(F.struct("hash", (-F.col("pos")).alias("back"))).over(ahead))
    full = chosen.filter((F.col("n") > window) & (F.col("pos") <= F.col("n") - window)).select("id", (-F.col("best.back")).alias("pos"), F.col("best.hash").alias("hash")).distinct()
    return full.unionByName(sized.filter(F.col("n") <= window).select("id", "pos", "hash"))


def contained(queries: DataFrame, corpus: DataFrame) -> DataFrame:
    """query, id, containment: the share of a query's distinct hashes that each id of corpus has; both are (id, hash)."""
    own = queries.select(F.col("id").alias("query"), "hash").distinct()
    size = own.groupBy("query").agg(F.count("*").alias("size"))
    shared = own.join(corpus.select("id", "hash").distinct(), "hash").groupBy("query", "id").agg(F.count("*").alias("shared"))
    return shared.join(size, "query").select("query", "id", (F.col("shared") / F.col("size")).alias("containment"))


def novelty(candidates: DataFrame, reference: DataFrame, own: DataFrame) -> DataFrame:
    """id, ref, self, score = ref * (1 - self): the shares of a candidate's distinct hashes that reference and own have (all: id, hash).

    What is known of a hash is one row, which candidates' rows meet by hash; there they are made distinct too, so that they
    are dealt out once.
    """
    none = F.lit(None).cast("int")
    known = reference.select("hash", F.lit(1).alias("r"), none.alias("o")).unionByName(own.select("hash", none.alias("r"), F.lit(1).alias("o")))
    known = known.groupBy("hash").agg(F.max("r").alias("r"), F.max("o").alias("o"))
    rows = candidates.select("id", "hash").join(known, "hash", "left").groupBy("id", "hash").agg(F.max("r").alias("r"), F.max("o").alias("o"))
    shares = rows.groupBy("id").agg((F.count("r") / F.count("*")).alias("ref"), (F.count("o") / F.count("*")).alias("self"))
    return shares.withColumn("score", F.col("ref") * (1 - F.col("self")))
