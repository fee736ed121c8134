"""The registered queries of the training-data operators and their SQL."""

from __future__ import annotations

from .bpe import op6_bpe
from .chat import OP9_SQL, op9_chat
from .exact import OP8_SQL, op8_exact_dedup
from .html import op4_html
from .imatch import op10_imatch
from .language import op2_language
from .mixing import OP5_SQL, op5_mixing
from .quality import op7_quality
from .simhash import op1_simhash
from .suffixes import op3_suffixes

QUERIES = {
    f.__name__: f
    for f in (
        op1_simhash,
        op2_language,
        op3_suffixes,
        op4_html,
        op5_mixing,
        op6_bpe,
        op7_quality,
        op8_exact_dedup,
        op9_chat,
        op10_imatch,
    )
}

#: The others can't be expressed in SQL; tests hold them against brute force.
ORACLE_SQL = {"op5_mixing": OP5_SQL, "op8_exact_dedup": OP8_SQL, "op9_chat": OP9_SQL}
