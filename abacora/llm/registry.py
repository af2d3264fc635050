"""The queries of the training-data operators and, where SQL can express them, their SQL."""

from __future__ import annotations

from .annulus import OP12_SQL, op12_annulus
from .byte_bpe import op10_byte_bpe
from .hard_negatives import OP13_SQL, op13_hard_negatives
from .minhash import OP11_SQL, op11_minhash
from .packing import op1_packing
from .quality_classifier import op4_quality_classifier
from .quality_rules import op2_quality_rules
from .simhash import op7_simhash
from .suffix_dedup import op9_suffix_dedup
from .token_counts import op8_token_counts
from .topk_search import op5_topk_search
from .url_filter import op3_url_filter
from .window_index import op6_window_index

QUERIES = {q.__name__: q for q in (op1_packing, op2_quality_rules, op3_url_filter, op4_quality_classifier, op5_topk_search, op6_window_index, op7_simhash, op8_token_counts, op9_suffix_dedup, op10_byte_bpe, op11_minhash, op12_annulus, op13_hard_negatives)}
ORACLES: dict[str, str] = {"op11_minhash": OP11_SQL, "op12_annulus": OP12_SQL, "op13_hard_negatives": OP13_SQL}
