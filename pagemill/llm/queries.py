"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from pagemill.llm import chat, decontaminate, jaccard, lines, mixing, pitman_yor, repeats, rules, toxicity, warc

QUERIES = {
    "op8_pitman_yor": pitman_yor.op8_pitman_yor,
    "op1_warc": warc.op1_warc,
    "op3_substrings": repeats.op3_substrings,
    "op2_jaccard": jaccard.op2_jaccard,
    "op5_toxicity": toxicity.op5_toxicity,
    "op10_quality": rules.op10_quality,
    "op9_decontaminate": decontaminate.op9_decontaminate,
    "op4_mix": mixing.op4_mix,
    "op6_line_windows": lines.op6_line_windows,
    "op7_prefix_chat": chat.op7_prefix_chat,
}
ORACLES = {
    "op1_warc": warc.SQL,
    "op3_substrings": repeats.SQL,
    "op9_decontaminate": decontaminate.SQL,
    "op4_mix": mixing.SQL,
    "op6_line_windows": lines.SQL,
    "op7_prefix_chat": chat.SQL,
}
