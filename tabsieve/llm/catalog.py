"""Registered queries of the pipeline operators and their DuckDB SQL (where SQL can express them)."""

from __future__ import annotations

from tabsieve.llm import (
    bpe, collocations, licences, line_rules, periods, resample, shards, simhash, simple8b, suffix, toxicity, warc, winnow,
)

QUERIES = {
    "op1_importance_resampling": resample.op1_importance_resampling,
    "op2_speculative_bpe": bpe.op2_speculative_bpe,
    "op3_revisits": warc.op3_revisits,
    "op4_simhash": simhash.op4_simhash,
    "op5_line_rules": line_rules.op5_line_rules,
    "op6_induced_suffixes": suffix.op6_induced_suffixes,
    "op7_winnowing": winnow.op7_winnowing,
    "op8_karmarkar_karp": shards.op8_karmarkar_karp,
    "op9_simple8b": simple8b.op9_simple8b,
    "op10_pattern_grammar": toxicity.op10_pattern_grammar,
    "op11_collocations": collocations.op11_collocations,
    "op12_rare_token_index": licences.op12_rare_token_index,
    "op13_periodic_runs": periods.op13_periodic_runs,
}

ORACLES: dict[str, str] = {
    "op3_revisits": warc.OP3_SQL,
    "op5_line_rules": line_rules.OP5_SQL,
    "op11_collocations": collocations.OP11_SQL,
    "op12_rare_token_index": licences.OP12_SQL,
}
