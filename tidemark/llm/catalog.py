"""The registered queries of the training-data operators."""

from __future__ import annotations

import corpus_pipeline

from . import alignment, decontam, embeddings, exact_dedup, hpylm, jaccard, langid, mixing, packing, phrases, pii, records, sharding
from .common import reachable

_QUERIES = {
    "op1_mix_sources": mixing.query,
    "op2_pii": pii.query,
    "op3_exact_dedup": exact_dedup.query,
    "op4_embedding_near_dedup": embeddings.query,
    "op5_hpylm_scores": hpylm.query,
    "op6_pack_windows": packing.query,
    "op7_language_id": langid.query,
    "op8_sharding": sharding.query,
    "op9_token_records": records.query,
    "op10_jaccard_join": jaccard.query,
    "op11_align_tokenizers": alignment.query,
    "op12_phrases": phrases.query,
    "op13_decontaminate": decontam.query,
    "pipeline": corpus_pipeline.run,
}


def _ready(query):
    def run(spark, sf_dir):
        reachable(spark)
        return query(spark, sf_dir)

    return run


def queries():
    return {name: _ready(q) for name, q in _QUERIES.items()}


def oracle_sql():
    return {"op3_exact_dedup": exact_dedup.SQL, "op12_phrases": phrases.SQL, "op13_decontaminate": decontam.SQL}
