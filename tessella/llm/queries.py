"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from .chat_format import OP5_SQL, op5
from .decontamination import OP13_SQL, op13
from .embedding_dedup import op4
from .exact_dedup import OP3_SQL, op3
from .filter_audit import OP12_SQL, op12
from .ngram_join import op2
from .packing import op1
from .sentence_pieces import op10
from .token_counts import op9
from .token_files import op6
from .toxicity import op8
from .url_filter import op7
from .vector_codes import OP11_SQL, op11

QUERIES = {
    "op1_best_fit_packing": op1,
    "op2_ngram_join": op2,
    "op3_exact_dedup": op3,
    "op4_embedding_dedup": op4,
    "op5_chat_format": op5,
    "op6_token_files": op6,
    "op7_url_filter": op7,
    "op8_toxicity": op8,
    "op9_token_counts": op9,
    "op10_sentence_pieces": op10,
    "op11_vector_codes": op11,
    "op12_filter_audit": op12,
    "op13_decontamination": op13,
}

ORACLES = {
    "op3_exact_dedup": OP3_SQL,
    "op5_chat_format": OP5_SQL,
    "op11_vector_codes": OP11_SQL,
    "op12_filter_audit": OP12_SQL,
    "op13_decontamination": OP13_SQL,
}
