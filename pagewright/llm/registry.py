"""The queries of the corpus operators and their SQL."""

from pagewright.llm import chat, clustering, decontamination, embedding_dedup, html_extract, line_dedup, mixing, negatives, pii, quality, sharding, simhash, winnowing

QUERIES = {
    "op1_decontamination": decontamination.op1_decontamination,
    "op2_chat": chat.op2_chat,
    "op3_embedding_dedup": embedding_dedup.op3_embedding_dedup,
    "op4_mixing": mixing.op4_mixing,
    "op5_html": html_extract.op5_html,
    "op6_quality": quality.op6_quality,
    "op7_pii": pii.op7_pii,
    "op8_simhash": simhash.op8_simhash,
    "op9_sharding": sharding.op9_sharding,
    "op10_line_dedup": line_dedup.op10_line_dedup,
    "op11_clustering": clustering.op11_clustering,
    "op12_hard_negatives": negatives.op12_hard_negatives,
    "op13_fingerprints": winnowing.op13_fingerprints,
}

#: The others are tested against brute force, a round trip or held-out accuracy in tests/llm.
ORACLE_SQL = {
    "op1_decontamination": decontamination.OP1_SQL,
    "op2_chat": chat.OP2_SQL,
    "op3_embedding_dedup": embedding_dedup.OP3_SQL,
    "op4_mixing": mixing.OP4_SQL,
    "op7_pii": pii.OP7_SQL,
    "op10_line_dedup": line_dedup.OP10_SQL,
    "op11_clustering": clustering.OP11_SQL,
    "op12_hard_negatives": negatives.OP12_SQL,
}
