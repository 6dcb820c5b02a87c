"""The corpus operators' queries and their SQL."""

from __future__ import annotations

from quire.llm import chat, decontaminate, embeddings, licences, lmscore, mixing, neardup, pii, suffixdedup, toxicity

QUERIES = {"op1_decontaminate": decontaminate.op1_decontaminate, "op2_mixing": mixing.op2_mixing, "op3_chat_format": chat.op3_chat_format, "op4_lm_score": lmscore.op4_lm_score, "op5_near_duplicates": neardup.op5_near_duplicates, "op6_toxicity": toxicity.op6_toxicity, "op7_embedding_dedup": embeddings.op7_embedding_dedup, "op8_pii": pii.op8_pii, "op9_licences": licences.op9_licences, "op10_suffix_dedup": suffixdedup.op10_suffix_dedup}
ORACLE_SQL = {"op1_decontaminate": decontaminate.SQL, "op2_mixing": mixing.SQL, "op3_chat_format": chat.SQL, "op5_near_duplicates": neardup.SQL, "op7_embedding_dedup": embeddings.SQL, "op8_pii": pii.SQL, "op10_suffix_dedup": suffixdedup.SQL}
