"""The registered queries of this subpackage, and their SQL."""

from __future__ import annotations

from pagelattice.llm import embed_dedup, html_text, media, mixing, secrets, sentencepieces, sharding, simhash, token_counts, toxicity


def queries() -> dict:
    return {
        "op1_sentencepiece": sentencepieces.op1_sentencepiece,
        "op10_embed_dedup": embed_dedup.op10_embed_dedup,
        "op2_html_text": html_text.op2_html_text,
        "op3_sharding": sharding.op3_sharding,
        "op4_simhash": simhash.op4_simhash,
        "op5_toxicity": toxicity.op5_toxicity,
        "op6_secrets": secrets.op6_secrets,
        "op7_mixing": mixing.op7_mixing,
        "op8_media": media.op8_media,
        "op9_token_counts": token_counts.op9_token_counts,
    }


def oracle_sql() -> dict[str, str]:
    return {"op3_sharding": sharding.OP3_SQL, "op10_embed_dedup": embed_dedup.OP10_SQL}
