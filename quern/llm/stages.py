"""Stages of the corpus pipeline: documents in, documents (in the end packed pieces) out.

Every stage takes an empty table (it gives one of the same columns), repeated rows and columns of any names
beside doc_id, text and lang, and returns the columns that it got; only the last returns pieces. What it
does with nulls, empty and long texts is said below."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm import common, langid, packing, quality, simhash

#: A document whose language is less likely than this goes; of documents without a letter, all go.
LANG_LEAST = 0.5
QUALITY_LEAST = 0.3


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents whose text has a language; learned from lang of two thirds of the documents.

    A null, empty or letterless text goes. A null lang is not learned from; it says nothing about whether
    the document stays. Long texts are judged whole; of repeated rows all stay or all go."""
    model = langid.train(docs, common.crc_of("doc_id") % 3 != 1)
    lang, score = common.free_names(docs, "_lang_pred", "_lang_score")
    found = langid.predict(docs, model, docs.columns, (lang, score))
    return found.where((F.col(lang) != langid.UNDETERMINED) & (F.col(score) >= LANG_LEAST)).select(*docs.columns)


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents of a quality score of at least 0.3; learned from four fifths of the labels.

    A null text counts as empty and is scored like any other. A null doc_id has no label; its text is
    scored. Long texts are judged whole; of repeated rows all stay or all go. Without a label of either
    kind all scores are equal, and all documents stay or go together."""
    marked = common.cut(quality.sample_labels(common.table(spark, sf_dir, "labels"), common.crc_of("doc_id") % 5 != 0), "labels")
    labelled = docs.join(F.broadcast(marked.select("doc_id").distinct()), "doc_id", "left_semi")
    stats = common.cut(quality.with_statistics(labelled, ["doc_id"]), "statistics")
    model = quality.train(stats, marked)
    score = common.free_names(docs, "_quality")[0]
    return quality.score_texts(docs, model, score).where(F.col(score) >= QUALITY_LEAST).select(*docs.columns)


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each component of near duplicates, as simhash.representatives() says.

    Null and empty texts are near duplicates of each other; a null doc_id stays only where its component
    has no other; of repeated rows one stays."""
    return simhash.representatives(docs).select(*docs.columns)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs the tokens of all documents into sequences of 2048, as packing.pack_documents() says: null and
    empty texts give a piece of the end id, long ones are cut into pieces, repeated rows are each packed."""
    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))
