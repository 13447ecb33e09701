"""From raw documents to piece ids: judged, freed of near-duplicates and long repeats, mixed and encoded."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tributary.llm.mixing import mixed
from tributary.llm.near_dedup import keep_one
from tributary.llm.quality import keep_good
from tributary.llm.sentencepiece_lattice import encode_texts
from tributary.llm.store import documents, materialize
from tributary.llm.suffix_dedup import cut_repeats

STAGES = [
    ("quality", keep_good),
    ("near_dedup", keep_one),
    ("suffix_dedup", cut_repeats),
    ("mixing", mixed),
    ("sentencepiece", encode_texts),
]
ORACLE_SQL = None  # fitted models and file formats have no SQL; see the brute-force tests


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows; every other stage's result is a table in the shared folder."""
    docs = documents(spark, sf_dir)
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = materialize(docs)
    return docs
