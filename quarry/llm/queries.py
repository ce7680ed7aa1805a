"""The queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from quarry.llm.ann import op10_ann
from quarry.llm.byte_bpe import op8_byte_bpe
from quarry.llm.mixing import OP7_SQL, op7_mixing
from quarry.llm.near_dup import op2_near_dup
from quarry.llm.pii import op3_pii
from quarry.llm.quality import op5_quality
from quarry.llm.secrets import op6_secrets
from quarry.llm.token_count import op4_token_count
from quarry.llm.token_store import op1_token_store
from quarry.llm.toxicity import op9_toxicity

QUERIES = {
    "op1_token_store": op1_token_store,
    "op2_near_dup": op2_near_dup,
    "op3_pii": op3_pii,
    "op4_token_count": op4_token_count,
    "op5_quality": op5_quality,
    "op6_secrets": op6_secrets,
    "op7_mixing": op7_mixing,
    "op8_byte_bpe": op8_byte_bpe,
    "op9_toxicity": op9_toxicity,
    "op10_ann": op10_ann,
}

ORACLE_SQL = {"op7_mixing": OP7_SQL}
