"""Registry of the training-data queries."""

from tidemark.llm import decontaminate, license_scan, media, packing, ring_shard, simhash, substring_dedup, token_counts, toxicity, url_filter

QUERIES = {
    "op1_separator_scan": token_counts.op1_separator_scan,
    "op2_simhash": simhash.op2_simhash,
    "op3_repeated_phrases": substring_dedup.op3_repeated_phrases,
    "op4_progressive_jpeg": media.op4_progressive_jpeg,
    "op5_url_filter": url_filter.op5_url_filter,
    "op6_text_cnn": toxicity.op6_text_cnn,
    "op7_spaced_seeds": decontaminate.op7_spaced_seeds,
    "op8_license_scan": license_scan.op8_license_scan,
    "op9_ring_shard": ring_shard.op9_ring_shard,
    "op10_best_fit": packing.op10_best_fit,
}
ORACLES = {"op5_url_filter": url_filter.ORACLE, "op8_license_scan": license_scan.ORACLE}
