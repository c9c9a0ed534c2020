"""The queries of this subpackage, and SQL for those that SQL can express."""

from tidemark.llm import chunked_bpe, decontamination, fertility, gru_langid, sharding, simhash, site_quality, style_tree, token_counts, warc

QUERIES = {
    "op1_warc": warc.query,
    "op2_token_counts": token_counts.query,
    "op3_rendezvous": sharding.query,
    "op4_decontamination": decontamination.query,
    "op5_chunked_bpe": chunked_bpe.query,
    "op6_fertility": fertility.query,
    "op7_style_tree": style_tree.query,
    "op8_site_quality": site_quality.query,
    "op9_gru_langid": gru_langid.query,
    "op10_simhash": simhash.query,
}

SQL = {"op1_warc": warc.SQL}
