"""The numbered queries and, where SQL can express them, their SQL."""

from .centroids import OP11_SQL, op11_centroids
from .conversation_repair import OP13_SQL, op13_conversations
from .decontaminate import OP2_SQL, op2_decontaminate
from .exact_dedup import OP6_SQL, op6_exact_dedup
from .language_id import op8_language_id
from .licenses import op3_licenses
from .mixing import OP9_SQL, op9_mix_sources
from .near_dedup import OP1_SQL, op1_near_dedup
from .neighbours import OP12_SQL, op12_neighbours
from .quality import op4_quality
from .secrets import OP10_SQL, op10_secrets
from .token_counts import op7_token_counts
from .toxicity import op5_toxicity

QUERIES = {
    "op1_near_dedup": op1_near_dedup,
    "op2_decontaminate": op2_decontaminate,
    "op3_licenses": op3_licenses,
    "op4_quality": op4_quality,
    "op5_toxicity": op5_toxicity,
    "op6_exact_dedup": op6_exact_dedup,
    "op7_token_counts": op7_token_counts,
    "op8_language_id": op8_language_id,
    "op9_mix_sources": op9_mix_sources,
    "op10_secrets": op10_secrets,
    "op11_centroids": op11_centroids,
    "op12_neighbours": op12_neighbours,
    "op13_conversations": op13_conversations,
}

SQL = {
    "op1_near_dedup": OP1_SQL,
    "op2_decontaminate": OP2_SQL,
    "op6_exact_dedup": OP6_SQL,
    "op9_mix_sources": OP9_SQL,
    "op10_secrets": OP10_SQL,
    "op11_centroids": OP11_SQL,
    "op12_neighbours": OP12_SQL,
    "op13_conversations": OP13_SQL,
}
