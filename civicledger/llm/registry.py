"""All queries of this subpackage and their SQL."""

from __future__ import annotations

import corpus_pipeline

from . import alignment, ann, bpe, chroma, classlm, jaccard, langid, lines, mixing, spelling, substrings, toxicity, warc

MODULES = (langid, warc, substrings, lines, jaccard, toxicity, chroma, ann, mixing, bpe, classlm, alignment, spelling)

#: Queries that need the package of public tokenizers.
TOKENIZING = ("op10_bpe", "op12_alignment", "pipeline")


def queries() -> dict:
    return {name: f for m in MODULES for name, f in m.QUERIES.items()} | {"pipeline": corpus_pipeline.run}


def oracle_sql() -> dict:
    sql = {name: sql for m in MODULES for name, sql in m.ORACLE.items()}
    return sql | ({"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {})
