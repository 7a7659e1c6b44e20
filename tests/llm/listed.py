"""Queries that SQL cannot state; the tests beside this file hold them against brute force."""

WITHOUT_SQL = {
    "op3_quality_model", "op4_byte_bpe", "op5_private_data", "op6_quality_rules", "op7_secrets", "op9_simhash", "op11_turn_repair", "op12_whitening",
    "op13_fingerprints", "pipeline",
}
