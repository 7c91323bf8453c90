"""The queries of this subpackage and the SQL of those that SQL can express."""

from __future__ import annotations

from . import bpe, chat, htmltext, mixing, pq, quality, simhash, suffixdedup, toxicity, warc

QUERIES = {
    "op1_bpe_encode_decode": bpe.op1,
    "op2_quality_rules": quality.op2,
    "op3_mixing": mixing.op3,
    "op4_chat_format": chat.op4,
    "op5_toxicity": toxicity.op5,
    "op6_warc_archives": warc.op6,
    "op7_main_text": htmltext.op7,
    "op8_simhash_near_duplicates": simhash.op8,
    "op9_suffix_array_dedup": suffixdedup.op9,
    "op10_embedding_near_duplicates": pq.op10,
}

#: The others (op1, op5, op7, op8, op9, op10) are tested against the library, held-out labels or brute force.
ORACLE: dict[str, str] = {
    "op2_quality_rules": quality.OP2_SQL,
    "op3_mixing": mixing.OP3_SQL,
    "op4_chat_format": chat.OP4_SQL,
    "op6_warc_archives": warc.OP6_SQL,
}
