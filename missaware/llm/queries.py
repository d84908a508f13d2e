"""The corpus queries of ``__spark_entry__.py`` and their DuckDB SQL."""

from missaware.llm import classlm, divergence, leaks, mixing, neardup, quality, rules, search, secrets, sharding, substrings, tokenids, warc

QUERIES = {
    "op1_mix_sources": mixing.op1,
    "op2_quality_classifier": quality.op2,
    "op3_quality_rules": rules.op3,
    "op4_substring_dedup": substrings.op4,
    "op5_minhash_dedup": neardup.op5,
    "op6_shard_tree": sharding.op6,
    "op7_class_lm": classlm.op7,
    "op8_warc": warc.op8,
    "op9_decontaminate": leaks.op9,
    "op10_secret_scan": secrets.op10,
    "op11_source_divergence": divergence.op11,
    "op12_token_ids": tokenids.op12,
    "op13_lexical_search": search.op13,
}

ORACLES = {
    "op1_mix_sources": mixing.OP1_SQL,
    "op4_substring_dedup": substrings.OP4_SQL,
    "op5_minhash_dedup": neardup.OP5_SQL,
    "op8_warc": warc.OP8_SQL,
    "op11_source_divergence": divergence.OP11_SQL,
    "op13_lexical_search": search.OP13_SQL,
}
