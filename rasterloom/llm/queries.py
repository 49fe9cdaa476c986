"""The registered queries of this subpackage and the SQL of those that SQL can express."""

from __future__ import annotations

from . import collocations, conversations, embeddings, media, mixing, packing, pages, passages, private, quality, secrets, simhash, toxicity

QUERIES = {
    "op1_quality_rules": quality.op1,
    "op2_best_fit_packing": packing.op2,
    "op3_secret_scan": secrets.op3,
    "op4_page_text": pages.op4,
    "op5_repeated_passages": passages.op5,
    "op6_media_clips": media.op6,
    "op7_simhash_near_dedup": simhash.op7,
    "op8_embedding_range_join": embeddings.op8,
    "op9_toxicity": toxicity.op9,
    "op10_source_mixing": mixing.op10,
    "op11_conversation_repair": conversations.op11,
    "op12_collocations": collocations.op12,
    "op13_personal_data": private.op13,
}

ORACLE_SQL = {
    "op10_source_mixing": mixing.OP10_SQL,
    "op11_conversation_repair": conversations.OP11_SQL,
    "op12_collocations": collocations.OP12_SQL,
}
