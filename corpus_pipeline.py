"""From raw documents to packed sequences, in five stages.

Each stage gets the rows that its predecessor kept, written as Parquet and read again, and returns rows with the columns of
`documents`; the last returns the pieces of packed sequences.

For all stages: other columns than doc_id, text, lang and n_chars are carried along whatever their names; an empty table gives an
empty result; texts of any length are read whole; equal rows are told apart by nothing but their place, so they go or stay together,
but for the near duplicates, of which one row stays.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.llm import decontaminate, language, near_copies, packing, suffix_dedup
from codeloom.llm.common import compact, cut, table
from codeloom.llm.queries import tokenizer_path

#: Words of a shingle, and least share of their shingles that near duplicates have in common.
SHINGLE_WORDS, SIMILARITY = 5, 0.8
#: Words that a passage has at least to be cut where it repeats; strings of 400 bytes go as in op6 whatever their words.
PASSAGE_WORDS = 51
#: Least probability with which a document's language must be found.
LEAST_LANGUAGE = 0.3


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a letter or with no language that is likely enough.

    Null and empty texts have no letter and go. Rows with a null lang are judged, not learned from. Ties between languages go to the
    first in order, which changes no decision here. Without any lang every document goes, as no language is known."""
    return compact(language.identified(docs, language.fit(docs, F.lit(True)), LEAST_LANGUAGE), docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near duplicates, that with the least id (null ids first; on a tie the least text hash,
    then any one of the equal rows).

    Texts are near duplicates from SIMILARITY of their SHINGLE_WORDS-word shingles, and so are those that a chain of such pairs
    connects. Null and empty texts are duplicates of each other; a text of fewer words is one shingle."""
    return near_copies.representatives(docs, SHINGLE_WORDS, SIMILARITY)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes passages of over 50 words and byte strings of op6's size that come more than once, at every place; documents of
    which nothing is left go.

    Null, empty and shorter texts keep all and stay. n_chars is counted anew where a text changes (a null one too), and a table
    without that column stays without. Equal rows repeat each other and so both lose what is long enough."""
    return suffix_dedup.without_repeats(docs, words=PASSAGE_WORDS)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold an item of the benchmark.

    Null and empty texts hold none and stay; null and empty items are in none. Ties between items change no decision."""
    return compact(decontaminate.clean(docs, table(spark, sf_dir, "benchmark")), docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs what is left into sequences; only doc_id and text are read.

    Null and empty texts are the one closing id. Pieces of one length are placed in an order of their own that only decides which
    of equal places each gets."""
    return packing.pack(docs, tokenizer_path())


STAGES = [
    ("language", identify_language),
    ("near_duplicates", drop_near_duplicates),
    ("repeats", cut_repeats),
    ("decontamination", drop_contaminated),
    ("packing", pack),
]

#: SQL has no trained classifier, trie join or tokenizer: the stages are tested against brute-force versions instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
