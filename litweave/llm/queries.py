"""The corpus queries and, where SQL can express them, their SQL."""

from __future__ import annotations

from .op1 import op1_token_counts
from .op2 import op2_secrets
from .op3 import op3_toxicity
from .op4 import SQL as OP4_SQL
from .op4 import op4_mixing
from .op5 import op5_licences
from .op6 import SQL as OP6_SQL
from .op6 import op6_embeddings
from .op7 import SQL as OP7_SQL
from .op7 import op7_minhash
from .op8 import op8_quality
from .op9 import op9_packing
from .op10 import op10_fingerprints
from .op11 import op11_lm_scoring
from .op12 import SQL as OP12_SQL
from .op12 import op12_prefix_trie
from .op13 import SQL as OP13_SQL
from .op13 import op13_divergence

QUERIES = {
    "op1_token_counts": op1_token_counts,
    "op2_secrets": op2_secrets,
    "op3_toxicity": op3_toxicity,
    "op4_mixing": op4_mixing,
    "op5_licences": op5_licences,
    "op6_embeddings": op6_embeddings,
    "op7_minhash": op7_minhash,
    "op8_quality": op8_quality,
    "op9_packing": op9_packing,
    "op10_fingerprints": op10_fingerprints,
    "op11_lm_scoring": op11_lm_scoring,
    "op12_prefix_trie": op12_prefix_trie,
    "op13_divergence": op13_divergence,
}
ORACLE_SQL = {"op4_mixing": OP4_SQL, "op6_embeddings": OP6_SQL, "op7_minhash": OP7_SQL, "op12_prefix_trie": OP12_SQL, "op13_divergence": OP13_SQL}
