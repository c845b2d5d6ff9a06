"""The queries of the operators by name, and SQL for those that SQL can express."""

from tallyveil.llm import ann, htmltext, langid, mixing, neardup, packing, prefixtrie, quality, spelling, tokencount, topk, toxicity, warc

QUERIES = {
    "op1_quality_embeddings": quality.op1,
    "op2_arc_to_warc": warc.op2,
    "op3_pruned_graph_search": ann.op3,
    "op4_language_filters": langid.op4,
    "op5_lexical_packing": packing.op5,
    "op6_trie_token_counts": tokencount.op6,
    "op7_cube_mixing": mixing.op7,
    "op8_minhash_forest": neardup.op8,
    "op9_toxic_spans": toxicity.op9,
    "op10_branch_and_bound": topk.op10,
    "op11_prefix_bitmaps": prefixtrie.op11,
    "op12_block_field_text": htmltext.op12,
    "op13_count_trie_spelling": spelling.op13,
}
ORACLES = {"op2_arc_to_warc": warc.OP2_SQL, "op8_minhash_forest": neardup.OP8_SQL, "op10_branch_and_bound": topk.OP10_SQL, "op11_prefix_bitmaps": prefixtrie.OP11_SQL}
