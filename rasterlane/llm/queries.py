"""The subpackage's registered queries and their SQL."""

from __future__ import annotations

from .bpe import op4_bpe
from .chat import op3_chat
from .collocations import OP11_SQL, op11_collocations
from .decontaminate import op9_decontaminate
from .exact_dedup import OP5_SQL, op5_exact_dedup
from .hard_negatives import OP13_SQL, op13_hard_negatives
from .huffman import op10_token_files
from .language_id import op8_language_id
from .permutation_index import op12_permutation_index
from .quality import op1_quality
from .simhash import op6_simhash
from .subword_lm import op2_subword_lm
from .warc import op7_warc

QUERIES = {
    "op1_quality": op1_quality,
    "op2_subword_lm": op2_subword_lm,
    "op3_chat": op3_chat,
    "op4_bpe": op4_bpe,
    "op5_exact_dedup": op5_exact_dedup,
    "op6_simhash": op6_simhash,
    "op7_warc": op7_warc,
    "op8_language_id": op8_language_id,
    "op9_decontaminate": op9_decontaminate,
    "op10_token_files": op10_token_files,
    "op11_collocations": op11_collocations,
    "op12_permutation_index": op12_permutation_index,
    "op13_hard_negatives": op13_hard_negatives,
}
ORACLE_SQL = {"op5_exact_dedup": OP5_SQL, "op11_collocations": OP11_SQL, "op13_hard_negatives": OP13_SQL}
