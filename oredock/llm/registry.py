"""The queries of this subpackage and, where SQL can express them, their SQL."""

from oredock.llm import exact_dedup, licenses, line_dedup, lm_scoring, mixing, packing, quality_model, quality_rules, secrets, simhash

QUERIES = {
    f.__name__: f
    for f in (
        secrets.op1_secrets,
        quality_model.op2_quality,
        quality_rules.op3_quality_rules,
        packing.op4_best_fit_packing,
        line_dedup.op5_line_dedup,
        licenses.op6_licenses,
        exact_dedup.op7_exact_dedup,
        simhash.op8_simhash,
        mixing.op9_poisson_mixing,
        lm_scoring.op10_lm_scoring,
    )
}
SQL = {
    "op3_quality_rules": quality_rules.SQL,
    "op5_line_dedup": line_dedup.SQL,
    "op6_licenses": licenses.SQL,
    "op7_exact_dedup": exact_dedup.SQL,
    "op9_poisson_mixing": mixing.SQL,
}
