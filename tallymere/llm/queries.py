"""The registered queries of the corpus operators, and their SQL."""

from __future__ import annotations

from .align import op12_token_alignment
from .bpe import op11_bpe
from .decontaminate import OP7_SQL, op7_benchmark_decontamination
from .language import op10_language_id
from .line_dedup import OP4_SQL, op4_line_dedup
from .ngram_join import OP1_SQL, op1_ngram_jaccard_join
from .pieces import op6_sentencepiece
from .pii import op5_pii
from .sharding import op2_sharding
from .token_counts import op8_token_counts
from .topk import OP3_SQL, op3_exact_top_k
from .url_filter import op9_url_filter
from .whitening import op13_embedding_whitening

QUERIES = {
    "op1_ngram_jaccard_join": op1_ngram_jaccard_join,
    "op2_sharding": op2_sharding,
    "op3_exact_top_k": op3_exact_top_k,
    "op4_line_dedup": op4_line_dedup,
    "op5_pii": op5_pii,
    "op6_sentencepiece": op6_sentencepiece,
    "op7_benchmark_decontamination": op7_benchmark_decontamination,
    "op8_token_counts": op8_token_counts,
    "op9_url_filter": op9_url_filter,
    "op10_language_id": op10_language_id,
    "op11_bpe": op11_bpe,
    "op12_token_alignment": op12_token_alignment,
    "op13_embedding_whitening": op13_embedding_whitening,
}

ORACLES: dict[str, str] = {
    "op1_ngram_jaccard_join": OP1_SQL,
    "op3_exact_top_k": OP3_SQL,
    "op4_line_dedup": OP4_SQL,
    "op7_benchmark_decontamination": OP7_SQL,
}
