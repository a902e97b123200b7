"""Registry of this subpackage's queries and their SQL."""

from __future__ import annotations

import corpus_pipeline
from casewright.llm import ann, embedding_dedup, jaccard_join, licenses, mixing, packing, quality, sharding, toxicity, warc

QUERIES = {
    "op1_source_mixing": mixing.op1_source_mixing,
    "op2_license_scan": licenses.op2_license_scan,
    "op3_jaccard_join": jaccard_join.op3_jaccard_join,
    "op4_embedding_near_dedup": embedding_dedup.op4_embedding_near_dedup,
    "op5_sharding": sharding.op5_sharding,
    "op6_nearest_neighbours": ann.op6_nearest_neighbours,
    "op7_best_fit_packing": packing.op7_best_fit_packing,
    "op8_quality_classifier": quality.op8_quality_classifier,
    "op9_revisit_resolution": warc.op9_revisit_resolution,
    "op10_toxicity": toxicity.op10_toxicity,
    "pipeline": corpus_pipeline.run,
}
ORACLE_SQL = {"op1_source_mixing": mixing.ORACLE, "op9_revisit_resolution": warc.ORACLE}
if corpus_pipeline.ORACLE_SQL:
    ORACLE_SQL["pipeline"] = corpus_pipeline.ORACLE_SQL
