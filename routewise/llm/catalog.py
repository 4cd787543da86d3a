"""Queries of the training-data operators, and DuckDB SQL where SQL can express them."""

from __future__ import annotations

from routewise.llm.conversation_repair import OP11_SQL, op11_conversation_repair
from routewise.llm.embedding_dedup import OP10_SQL, op10_embedding_dedup
from routewise.llm.line_dedup import OP6_SQL, op6_line_dedup
from routewise.llm.minhash_dedup import OP2_SQL, op2_minhash_dedup
from routewise.llm.mixing import op12_mixing
from routewise.llm.packing import op7_packing
from routewise.llm.pieces import op8_sentencepiece
from routewise.llm.pii import op3_pii
from routewise.llm.quality_classifier import op4_quality_classifier
from routewise.llm.quality_rules import op5_quality_rules
from routewise.llm.sharding import op1_sharding
from routewise.llm.spelling import OP13_SQL, op13_spelling
from routewise.llm.toxicity import op9_toxicity

QUERIES = {q.__name__: q for q in (
    op1_sharding, op2_minhash_dedup, op3_pii, op4_quality_classifier, op5_quality_rules, op6_line_dedup, op7_packing,
    op8_sentencepiece, op9_toxicity, op10_embedding_dedup, op11_conversation_repair,
    op12_mixing, op13_spelling,
)}

ORACLE_SQL: dict[str, str] = {
    "op2_minhash_dedup": OP2_SQL, "op6_line_dedup": OP6_SQL, "op10_embedding_dedup": OP10_SQL,
    "op11_conversation_repair": OP11_SQL, "op13_spelling": OP13_SQL,
}
