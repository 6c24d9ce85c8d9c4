"""The registered queries of the training-data operators."""

from __future__ import annotations

from tickloom.llm.conversations import op13_conversations
from tickloom.llm.decontamination import op6_decontamination
from tickloom.llm.language_id import op2_language_id
from tickloom.llm.lexical import op11_lexical
from tickloom.llm.main_text import op3_main_text
from tickloom.llm.mixing import op12_mixing
from tickloom.llm.near_dedup import op8_near_dedup
from tickloom.llm.nearest import op4_nearest
from tickloom.llm.oracles import oracle_sql
from tickloom.llm.packing import op9_packing
from tickloom.llm.sharding import op10_sharding
from tickloom.llm.substring_dedup import op5_substring_dedup
from tickloom.llm.token_counts import op7_token_counts
from tickloom.llm.toxicity import op1_toxicity

__all__ = ["oracle_sql", "queries"]


def queries():
    found = [
        op1_toxicity, op2_language_id, op3_main_text, op4_nearest, op5_substring_dedup,
        op6_decontamination, op7_token_counts, op8_near_dedup, op9_packing, op10_sharding,
        op11_lexical, op12_mixing, op13_conversations,
    ]
    return {f.__name__: f for f in found}
