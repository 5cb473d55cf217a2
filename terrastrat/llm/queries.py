"""The corpus queries and the SQL of those that SQL can express."""

from __future__ import annotations

from terrastrat.llm import fingerprints, jaccard_join, middle, mixing, packing, pii, quality, resample, sharding, simhash, substring_dedup, tokencount, warc


def queries() -> dict:
    return {
        "op1_personal_data": pii.op1_personal_data,
        "op2_external_shuffle": sharding.op2_external_shuffle,
        "op3_chosen_path_join": jaccard_join.op3_chosen_path_join,
        "op4_systematic_mix": mixing.op4_systematic_mix,
        "op5_warc_transactions": warc.op5_warc_transactions,
        "op6_line_rules": quality.op6_line_rules,
        "op7_prefix_token_counts": tokencount.op7_prefix_token_counts,
        "op8_repeated_passages": substring_dedup.op8_repeated_passages,
        "op9_bin_slack_packing": packing.op9_bin_slack_packing,
        "op10_minhash_fingerprints": fingerprints.op10_minhash_fingerprints,
        "op11_fill_in_middle": middle.op11_fill_in_middle,
        "op12_importance_resampling": resample.op12_importance_resampling,
        "op13_simhash_near_dedup": simhash.op13_simhash_near_dedup,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op4_systematic_mix": mixing.OP4_SQL,
        "op5_warc_transactions": warc.OP5_SQL,
        "op6_line_rules": quality.OP6_SQL,
        "op11_fill_in_middle": middle.OP11_SQL,
    }
