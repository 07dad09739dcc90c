"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

import corpus_pipeline
from nearfield.llm import exact_dedup, hosts, language, licenses, mixing, near_dup, neighbours, pieces, private, quality

QUERIES = {
    "op1_language": language.query,
    "op2_pieces": pieces.query,
    "op3_exact_dedup": exact_dedup.query,
    "op4_private": private.query,
    "op5_mixing": mixing.query,
    "op6_near_dup": near_dup.query,
    "op7_hosts": hosts.query,
    "op8_neighbours": neighbours.query,
    "op9_licenses": licenses.query,
    "op10_quality": quality.query,
    "pipeline": corpus_pipeline.run,
}

ORACLE_SQL = {
    "op3_exact_dedup": exact_dedup.SQL,
    "op7_hosts": hosts.SQL,
}

if corpus_pipeline.ORACLE_SQL is not None:
    ORACLE_SQL["pipeline"] = corpus_pipeline.ORACLE_SQL
