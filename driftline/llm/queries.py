"""The queries of this subpackage and their SQL, as __spark_entry__.py registers them."""

from __future__ import annotations

from . import alignment, lines, minhash, mixing, packing, periodic, pii, pseudolikelihood, quality, rules, urls, vectors, warc

QUERIES = {
    "op1_pii_pseudonyms": pii.op1_pii_pseudonyms,
    "op2_mix_sources": mixing.op2_mix_sources,
    "op3_url_filter": urls.op3_url_filter,
    "op4_embedding_near_dedup": vectors.op4_embedding_near_dedup,
    "op5_quality_classifier": quality.op5_quality_classifier,
    "op6_lm_scoring": pseudolikelihood.op6_lm_scoring,
    "op7_line_dedup": lines.op7_line_dedup,
    "op8_quality_rules": rules.op8_quality_rules,
    "rule_ablations": rules.rule_ablations,
    "op9_best_fit_packing": packing.op9_best_fit_packing,
    "op10_minhash_near_dedup": minhash.op10_minhash_near_dedup,
    "op11_tokenizer_alignment": alignment.op11_tokenizer_alignment,
    "op12_periodic_runs": periodic.op12_periodic_runs,
    "op13_warc_archive": warc.op13_warc_archive,
}
ORACLE_SQL = {
    "op1_pii_pseudonyms": pii.OP1_SQL,
    "op2_mix_sources": mixing.OP2_SQL,
    "op3_url_filter": urls.OP3_SQL,
    "op4_embedding_near_dedup": vectors.OP4_SQL,
    "op7_line_dedup": lines.OP7_SQL,
    "op8_quality_rules": rules.OP8_SQL,
    "rule_ablations": rules.ABLATIONS_SQL,
    "op10_minhash_near_dedup": minhash.OP10_SQL,
    "op13_warc_archive": warc.OP13_SQL,
}
