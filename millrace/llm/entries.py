"""The queries of this subpackage and the SQL that states their rows."""

from __future__ import annotations

from millrace.llm import decontaminate, fingerprints, language_id, line_dedup, minhash_dedup, mixing, tool_calls, toxicity, url_filter, warc

QUERIES = {
    "op1_language_id": language_id.op1,
    "op2_toxicity": toxicity.op2,
    "op3_tool_calls": tool_calls.op3,
    "op4_line_dedup": line_dedup.op4,
    "op6_minhash_dedup": minhash_dedup.op6,
    "op7_decontaminate": decontaminate.op7,
    "op8_mixing": mixing.op8,
    "op5_warc": warc.op5,
    "op9_url_filter": url_filter.op9,
    "op10_fingerprints": fingerprints.op10,
}
ORACLE = {
    "op3_tool_calls": tool_calls.SQL,
    "op5_warc": warc.SQL,
    "op8_mixing": mixing.SQL,
    "op7_decontaminate": decontaminate.SQL,
    "op4_line_dedup": line_dedup.SQL,
}
