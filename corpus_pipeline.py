"""Documents -> tokens: language, repeated lines, near duplicates, benchmark passages, token ids.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written and read again as the next one's docs;
all but the last return the columns of documents. n_chars follows the text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tillage.llm import bpe, decontaminate, language, linededup, simhash
from tillage.llm.common import cut, table
from tillage.llm.queries import WORD_BPE

#: Documents whose language is less clear than this are rejected.
MIN_SCORE = 0.5
#: Documents whose sets of five-word shingles have this Jaccard or more are near duplicates.
MIN_JACCARD = 0.8
#: Documents of which a larger share of words comes from the benchmark are dropped; else the passages are cut out.
MAX_COVER = 0.5


def _carried(docs: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """docs with its further columns under names that no operator uses, and those names."""
    names = {c: f"_carried_{c}" for c in docs.columns if c not in ("doc_id", "text")}
    return docs.withColumnsRenamed(names), names


def _shaped(found: DataFrame, docs: DataFrame, names: dict[str, str], **new: Column) -> DataFrame:
    """The columns of docs: new ones where given, else those carried along."""
    return found.select(*[new[c].alias(c) if c in new else F.col("id").alias(c) if c == "doc_id" else F.col(f"`{names.get(c, c)}`").alias(c) for c in docs.columns])


def _text(column: str) -> dict[str, Column]:
    return {"text": F.col(column), "n_chars": F.coalesce(F.char_length(column), F.lit(0)).cast("long")}


def keep_known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Learns from the labelled documents; drops documents without a clear language, labels the rest as predicted.

    Null, empty and letterless texts have no language. Repeated rows are kept or dropped alike.
    """
    model = language.train(docs)
    source, names = _carried(docs)
    found = language.identify(source, model, extra=["text", *names.values()])
    kept = found.where((F.col("lang_pred") != "und") & (F.col("score") >= MIN_SCORE))
    return _shaped(kept, docs, names, lang=F.col("lang_pred"))


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A line stays where it is first, among all lines alike or nearly alike; a document of which no word stays, goes.

    Rows that repeat id and text are treated alike; texts without repeated lines come out as they were.
    """
    source, names = _carried(docs)
    found = linededup.dedup_lines(source, extra=list(names.values()))
    return _shaped(found.where((F.col("n_removed") == 0) | F.col("text").rlike(r"\S")), docs, names, **_text("text"))


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays, the least id's: groups are linked fingerprints, as in op8, and exactly the
    documents whose sets of five-word shingles have a Jaccard of MIN_JACCARD or more. Of rows that repeat id and text one
    stays; null and empty texts are one group."""
    return simhash.drop_near_duplicates(docs, similarity=MIN_JACCARD, words=5)


def cut_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Benchmark passages of ten words or more, or whole shorter items, are cut out; a document that is mostly such, by
    MAX_COVER, goes. Documents without a passage come out as they were, null texts as empty ones."""
    source, names = _carried(docs)
    found = decontaminate.contamination(source, table(spark, sf_dir, "benchmark"), extra=list(names.values()), max_cover=MAX_COVER)
    return _shaped(found.where("cleaned is not null"), docs, names, **_text("cleaned"))


def to_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, tokens, the digests of the ids and of what they decode to, lang, source; a null text has none."""
    return bpe.encode(docs, WORD_BPE, extra=["lang", "source"], digests=True).withColumnRenamed("id", "doc_id")


STAGES = [
    ("language", keep_known_languages),
    ("line_dedup", drop_repeated_lines),
    ("near_duplicates", keep_one_of_each),
    ("decontamination", cut_benchmark),
    ("tokens", to_tokens),
]

#: The language model and the edit join are beyond SQL; tests/llm/test_pipeline.py has a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = cut(stage(spark, docs, sf_dir))
    return docs
