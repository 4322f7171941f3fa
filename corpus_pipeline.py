"""From raw documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and works on all rows that the stage before it kept. All but the last return the
columns of documents; a stage's result is written as Parquet and reread as the next one's docs.

Rows travel as one column through a stage, so their other columns may have any names, of columns that a stage makes too.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evspark.llm.common import named, table, written
from evspark.llm.decontamination import contamination
from evspark.llm.near_duplicates import near_duplicates
from evspark.llm.packing import pack
from evspark.llm.substrings import without_repeats
from evspark.llm.toxicity import learned, scores

TOKENIZER = "word_bpe_49k.json"


def _row(docs: DataFrame):
    """All columns of docs as one."""
    return F.struct(*map(named, docs.columns)).alias("_row")


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the model of their labels doesn't reject.

    Null and empty texts aren't toxic; a null doc_id only keeps a row from being learned from; texts of any length are
    scored whole; repeated rows and equal texts share one answer; an empty table stays empty, and without labels of both
    kinds all rows stay.
    """
    model = learned(docs, table(spark, sf_dir, "labels"))
    return docs.select(_row(docs), scores(model, F.col("text")).alias("_s")).filter("NOT _s.toxic").select("_row.*")


def _hash(docs: DataFrame):
    """A hash of all columns of a row; maps, which have none, count as JSON."""
    return F.xxhash64(*(F.to_json(F.struct(named(f.name).alias("x"))) if "map<" in f.dataType.simpleString() else named(f.name) for f in docs.schema.fields))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near duplicates: that of the smallest doc_id, rows without one last, then of the least hash
    of its text and of all its columns.

    Each text is judged by itself: a doc_id that comes with several texts links none of them. Null and empty texts, and
    texts without words, are duplicates of nothing and all stay, repeated rows too. Of rows that are equal in all columns,
    or tie in those hashes, one stays. Texts of any length count whole. An empty table stays empty.
    """
    number = F.col("doc_id").cast("long")
    worded = F.coalesce(F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    place = ["_bare", "_id", "_class", "_h"]
    rows = docs.select(number.isNull().alias("_bare"), F.coalesce(number, F.lit(0)).alias("_id"), F.md5("text").alias("_class"), _hash(docs).alias("_h"), worded.alias("_worded"), F.col("text").alias("_text"), _row(docs))
    idle, rows = rows.filter("NOT _worded").select("_row"), rows.filter("_worded")
    places = written(rows.select(place).distinct(), "places")
    # texts are keyed by their doc_id, but by a number of their own where it is null, negative or comes with other texts
    shared = written(places.filter("NOT _bare").groupBy("_id").agg(F.min("_class").alias("lo"), F.max("_class").alias("hi")).filter("lo <> hi OR _id < 0").select("_id"), "shared")
    own = written(places.filter("_bare").unionByName(places.filter("NOT _bare").join(shared, "_id", "left_semi")).select("_class").distinct().withColumn("_key", -1 - F.monotonically_increasing_id()), "own")

    def keyed(x: DataFrame) -> DataFrame:
        if own.isEmpty():
            return x.withColumn("_key", F.col("_id"))
        plain = x.filter("NOT _bare").join(shared, "_id", "left_anti").withColumn("_key", F.col("_id"))
        other = x.filter("_bare").unionByName(x.filter("NOT _bare").join(shared, "_id", "left_semi").select(x.columns))
        return plain.select(*x.columns, "_key").unionByName(other.join(own, "_class").select(*x.columns, "_key"))

    judged = near_duplicates(keyed(rows.select("_bare", "_id", "_class", "_text")), key="_key", text="_text")
    component = judged.groupBy("_key").agg(F.min("component_id").alias("_component"))  # one for all rows of a key
    least = keyed(places).groupBy("_key").agg(F.min(F.struct(place)).alias("m"))
    best = least.join(component, "_key").groupBy("_component").agg(F.min("m").alias("m")).select("m.*")
    kept = rows.select(*place, "_row").join(best, place, "left_semi").dropDuplicates(place)
    return kept.select("_row").unionByName(idle).select("_row.*")


def repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the bytes that repeat strings of 50 bytes of documents with smaller doc_id.

    Cuts are narrowed to whole characters: one of which only some bytes repeat stays. Null texts become empty, as do
    texts that repeat as a whole. Rows without doc_id come after all others and don't cut each other, nor do rows of one
    doc_id. n_chars, where there is one, tells the new text's length. Texts of any length are cut whole. An empty table
    stays empty.
    """
    rows = docs.select("doc_id", "text", F.struct(*(named(c) for c in docs.columns if c != "text")).alias("_row"))
    left = without_repeats(rows, keep=["_row"])
    made = {"text": F.col("kept_text"), "n_chars": F.length("kept_text").cast(docs.schema["n_chars"].dataType if "n_chars" in docs.columns else "long")}
    return left.select(*(made.get(c, F.col("_row").getField(c)).alias(c) for c in docs.columns))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any window of a benchmark item.

    Null and empty texts hold none and stay, whatever their doc_id; texts of any length are searched whole; repeated rows
    are judged each; items that tie count alike; an empty table of documents or of items changes nothing.
    """
    rows = docs.select("doc_id", "text", F.struct(*(named(c) for c in docs.columns if c != "text")).alias("_row"))
    judged = contamination(rows, table(spark, sf_dir, "benchmark"), keep=["_row", "text"])
    return judged.filter(~F.col("contaminated")).select(*(F.col("text") if c == "text" else F.col("_row").getField(c).alias(c) for c in docs.columns))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents with their places in sequences of 4096 tokens.

    Null and empty texts are one end token; rows with null or repeated doc_id are packed each; long texts are cut into
    several pieces; pieces that tie in all that is known of them are interchangeable; an empty table gives no rows.
    """
    import public_tokenizers

    return pack(docs, public_tokenizers.path(TOKENIZER))


STAGES = [
    ("toxicity", toxicity),
    ("near_dedup", near_dedup),
    ("repeats", repeats),
    ("decontamination", decontaminate),
    ("packing", packing),
]

#: SQL has no form of the fitted model or the packing program; tests hold the stages against planted cases and brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
