"""The queries of this subpackage, with the SQL of those that SQL can express."""

from __future__ import annotations

from . import decontaminate, line_runs, packing, periodic_runs, pii, quality_ranker, quality_rules, simhash, source_tries, suffix_dedup, toxicity, warc, wrapper

QUERIES = {
    "op1_quality_ranker": quality_ranker.op1_quality_ranker,
    "op2_main_text": wrapper.op2_main_text,
    "op3_warc": warc.op3_warc,
    "op4_toxicity": toxicity.op4_toxicity,
    "op5_decontaminate": decontaminate.op5_decontaminate,
    "op6_packing": packing.op6_packing,
    "op7_pii": pii.op7_pii,
    "op8_simhash": simhash.op8_simhash,
    "op9_quality_rules": quality_rules.op9_quality_rules,
    "op10_suffix_dedup": suffix_dedup.op10_suffix_dedup,
    "op11_source_divergence": source_tries.op11_source_divergence,
    "op12_periodic_runs": periodic_runs.op12_periodic_runs,
    "op13_line_dedup": line_runs.op13_line_dedup,
}
ORACLES = {
    "op3_warc": warc.OP3_SQL,
    "op5_decontaminate": decontaminate.OP5_SQL,
    "op9_quality_rules": quality_rules.OP9_SQL,
    "op11_source_divergence": source_tries.OP11_SQL,
    "op13_line_dedup": line_runs.OP13_SQL,
}
