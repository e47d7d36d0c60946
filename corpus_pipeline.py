"""A corpus pipeline of five stages; each stage's result is written and read again as the next one's input."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm import minhash, mixing, quality_rules, sentencepiece_tok, toxicity
from corpusloom.llm.common import Tables, fold, table
from corpusloom.llm.queries import TOKENIZERS, read

#: Documents of at least this noisy-or score go.
TOXIC_FROM = 0.3


def numbered(docs: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """docs with its columns renamed by place, so that no name clashes with an operator's results; and the new names."""
    names = [f"c{i}" for i in range(len(docs.columns))]
    return docs.toDF(*names), dict(zip(docs.columns, names, strict=True))


def one_of_each(rows: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """One row of those equal in keys: the first by a hash of all other columns, the same on each run."""
    others = [c for c in columns if c not in keys]
    tie = F.xxhash64(F.to_json(F.struct(*others))) if others else F.lit(0)
    return rows.groupBy(*keys).agg(F.min_by(F.struct(*columns), tie).alias("row")).select(*keys, "row")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Learns from the labels outside the held-out fold and drops documents that score as toxic.

    A document's score depends on its text alone: null and empty texts are no reason to go, repeated rows and rows of null
    or repeated ids stay or go alike, texts are scored whole at any length. Without labels the prior decides for all; an
    empty table stays empty. All columns stay as they are, whatever their names.
    """
    model = toxicity.fit(docs, read(spark, sf_dir, "labels").where(fold(F.col("doc_id"), 4) != 2))
    rows, at = numbered(docs)
    return toxicity.score_texts(rows, model, text=at["text"], name="score").where(F.col("score") < TOXIC_FROM).select(rows.columns).toDF(*docs.columns)


def drop_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops what the base rules or the compression bands reject.

    Null, empty and short texts (under 20 words) go. Rows are judged one by one by their whole texts, so repeated rows and
    rows of null or repeated ids stay or go alike; an empty table stays empty. All columns stay as they are, whatever
    their names.
    """
    rows, at = numbered(docs)
    return quality_rules.apply_rules(rows, text=at["text"]).where("kept").select(rows.columns).toDF(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group linked by five-word shingles at a similarity of 0.8: the smallest id, one row of it.

    A group of null ids only keeps one row; rows of one id whose texts are in different groups are judged each by its own.
    Texts without words are in no group: of those that are equal in id and text one stays. Of equal candidates, the
    smallest text hash and then a hash of the other columns decide, the same on each run. Whole texts count, of any
    length; an empty table stays empty. All columns stay as they are, whatever their names.
    """
    rows, at = numbered(docs)
    doc_id, text = at["doc_id"], at["text"]
    found = minhash.near_duplicates(rows, doc_id=doc_id, text=text, words=5, percent=80)
    # a text without words has no root and is a group of its own
    alone = F.when(F.col("root").isNull(), F.col("text_hash"))
    one = found.where("kept").groupBy("doc_id", "root", alone.alias("alone")).agg(F.min("text_hash").alias("text_hash"))
    hashed = rows.withColumn("hash", F.xxhash64(text))
    kept = hashed.join(one, hashed[doc_id].eqNullSafe(one["doc_id"]) & hashed["hash"].eqNullSafe(one["text_hash"]), "left_semi")
    return one_of_each(kept, [doc_id, "hash"], rows.columns).select("row.*").toDF(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats and drops documents so that sources have their target shares of words.

    A null source is a source, null texts have no words, rows of null or repeated ids are told apart by source and whole
    text. Rows that are equal in all three (none come from the stage before) have their copies summed on one of them,
    chosen by a hash of the other columns, the same on each run. An empty table stays empty. All columns stay as they are,
    whatever their names.
    """
    rows, at = numbered(docs)
    keyed = rows.withColumn("digest", mixing.text_digest(F.col(at["text"])))
    keys = [at["doc_id"], at["source"], "digest"]
    sized = table(keyed.select(F.col(keys[0]).alias("doc_id"), F.col(keys[1]).alias("source"), "digest", mixing.n_words(F.col(at["text"])).alias("size")), "sizes")
    copies = mixing.mix_sized(sized, tie="digest").where("copies > 0").groupBy("doc_id", "source", "digest").agg(F.sum("copies").cast("int").alias("copies"))
    copies = copies.toDF("m0", "m1", "m2", "copies")
    same = [F.col(k).eqNullSafe(F.col(f"m{i}")) for i, k in enumerate(keys)]
    taken = one_of_each(keyed, keys, rows.columns).join(copies, same[0] & same[1] & same[2])
    return taken.select("row.*", F.explode(F.sequence(F.lit(1), "copies"))).select(rows.columns).toDF(*docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, decoded again and compared with the reference library.

    Whole texts of any length are encoded, row by row, so repeats and null ids need no care; a null text has null results,
    an empty one no tokens; an empty table stays empty. Columns other than id, source and text are not read.
    """
    coded = sentencepiece_tok.encode_texts(docs.select("doc_id", "source", "text"), f"{TOKENIZERS}/piece_bpe_32k.model")
    return coded.select("doc_id", "source", "n_tokens", "n_byte_tokens", "token_ids", "round_trip", "parity")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("quality_rules", drop_low_quality),
    ("minhash_near_dedup", drop_near_duplicates),
    ("mixing", mix_sources),
    ("sentencepiece", encode),
]

#: The trained and sequential stages have no SQL; tests hold the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, tables = read(spark, sf_dir, "documents"), Tables(spark)
    for name, stage in STAGES[:-1]:
        docs = tables.write(stage(spark, docs, sf_dir), name)
        tables.drop(docs)  # what the stage read is needed no more
    return STAGES[-1][1](spark, docs, sf_dir)
