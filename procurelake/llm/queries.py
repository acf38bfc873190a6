"""The queries of this subpackage, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from procurelake.llm import decontaminate, divergence, exact_dedup, fill_middle, near_join, url_filter, vector_dedup
from procurelake.llm.bpe import op1_bpe
from procurelake.llm.langid import op8_langid
from procurelake.llm.packing import op4_packing
from procurelake.llm.quality import op9_quality
from procurelake.llm.secrets import op5_secrets
from procurelake.llm.toxicity import op10_toxicity

QUERIES = {
    "op1_bpe": op1_bpe,
    "op2_near_join": near_join.op2_near_join,
    "op3_vector_dedup": vector_dedup.op3_vector_dedup,
    "op4_packing": op4_packing,
    "op5_secrets": op5_secrets,
    "op6_url_filter": url_filter.op6_url_filter,
    "op7_exact_dedup": exact_dedup.op7_exact_dedup,
    "op8_langid": op8_langid,
    "op9_quality": op9_quality,
    "op10_toxicity": op10_toxicity,
    "op11_decontaminate": decontaminate.op11_decontaminate,
    "op12_fill_in_middle": fill_middle.op12_fill_in_middle,
    "op13_source_divergence": divergence.op13_source_divergence,
}

ORACLE_SQL: dict[str, str] = {
    "op2_near_join": near_join.ORACLE,
    "op3_vector_dedup": vector_dedup.ORACLE,
    "op6_url_filter": url_filter.ORACLE,
    "op7_exact_dedup": exact_dedup.ORACLE,
    "op11_decontaminate": decontaminate.ORACLE,
    "op12_fill_in_middle": fill_middle.ORACLE,
    "op13_source_divergence": divergence.ORACLE,
}
