"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from .ann import op1_nearest_neighbours
from .audit import OP13_SQL, op13_filter_audit
from .bpe import op7_bpe
from .chat import OP4_SQL, op4_chat_format
from .decontaminate import op5_benchmark_decontamination
from .language import op11_language_id
from .ngram_join import OP6_SQL, op6_ngram_jaccard_join
from .pii import op8_personal_data
from .quality import op10_quality
from .ranked import OP12_SQL, op12_ranked_search
from .secrets import op2_secret_scan
from .shards import op3_training_order
from .toxicity import op9_toxicity

QUERIES = {
    "op1_nearest_neighbours": op1_nearest_neighbours,
    "op2_secret_scan": op2_secret_scan,
    "op3_training_order": op3_training_order,
    "op4_chat_format": op4_chat_format,
    "op5_benchmark_decontamination": op5_benchmark_decontamination,
    "op6_ngram_jaccard_join": op6_ngram_jaccard_join,
    "op7_bpe": op7_bpe,
    "op8_personal_data": op8_personal_data,
    "op9_toxicity": op9_toxicity,
    "op10_quality": op10_quality,
    "op11_language_id": op11_language_id,
    "op12_ranked_search": op12_ranked_search,
    "op13_filter_audit": op13_filter_audit,
}

ORACLE_SQL = {"op4_chat_format": OP4_SQL, "op6_ngram_jaccard_join": OP6_SQL, "op12_ranked_search": OP12_SQL, "op13_filter_audit": OP13_SQL}
