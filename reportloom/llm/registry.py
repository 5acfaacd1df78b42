"""The subpackage's queries and the SQL of those that SQL can express."""

from __future__ import annotations

from reportloom.llm import queries_decontaminate, queries_divergence, queries_html, queries_language, queries_licences, queries_mixing, queries_near, queries_periodic, queries_quality, queries_simhash, queries_spotsigs, queries_substring, queries_warc

QUERIES = {
    "op1_near_duplicates": queries_near.op1_near_duplicates,
    "op2_license_scan": queries_licences.op2_license_scan,
    "op3_language_id": queries_language.op3_language_id,
    "op4_mix_sources": queries_mixing.op4_mix_sources,
    "op5_substring_dedup": queries_substring.op5_substring_dedup,
    "op6_benchmark_leaks": queries_decontaminate.op6_benchmark_leaks,
    "op7_spotsigs_fingerprints": queries_spotsigs.op7_spotsigs_fingerprints,
    "op8_quality_grade": queries_quality.op8_quality_grade,
    "op9_warc_archive": queries_warc.op9_warc_archive,
    "op10_html_text": queries_html.op10_html_text,
    "op11_source_divergence": queries_divergence.op11_source_divergence,
    "op12_periodic_runs": queries_periodic.op12_periodic_runs,
    "op13_simhash_components": queries_simhash.op13_simhash_components,
}
ORACLES = {**queries_licences.ORACLE, **queries_mixing.ORACLE, **queries_substring.ORACLE, **queries_spotsigs.ORACLE, **queries_warc.ORACLE, **queries_divergence.ORACLE, **queries_periodic.ORACLE}
