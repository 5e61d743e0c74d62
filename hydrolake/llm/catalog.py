"""The operators' queries and, where SQL can express them, their DuckDB SQL."""

from __future__ import annotations

from hydrolake.llm import decontaminate, langid, lines, mixing, neardup, passages, pii, quality, ranked, spelling, toxicity, urls, warc

QUERIES = {
    "op1_mix_sources": mixing.op1_mix_sources,
    "op2_toxicity": toxicity.op2_toxicity,
    "op3_quality_rules": quality.op3_quality_rules,
    "op4_neardup": neardup.op4_neardup,
    "op5_language": langid.op5_language,
    "op6_decontaminate": decontaminate.op6_decontaminate,
    "op7_line_dedup": lines.op7_line_dedup,
    "op8_url_filter": urls.op8_url_filter,
    "op9_warc": warc.op9_warc,
    "op10_passages": passages.op10_passages,
    "op11_ranked_search": ranked.op11_ranked_search,
    "op12_spelling": spelling.op12_spelling,
    "op13_pii": pii.op13_pii,
}

#: operators 2, 4, 5 and 10 have no SQL form that finishes on whole tables; tests/llm holds them against brute force
ORACLES = {
    "op1_mix_sources": mixing.OP1_SQL,
    "op3_quality_rules": quality.oracle_sql(),
    "op6_decontaminate": decontaminate.OP6_SQL,
    "op7_line_dedup": lines.OP7_SQL,
    "op8_url_filter": urls.OP8_SQL,
    "op9_warc": warc.OP9_SQL,
    "op11_ranked_search": ranked.OP11_SQL,
    "op12_spelling": spelling.OP12_SQL,
    "op13_pii": pii.OP13_SQL,
}
