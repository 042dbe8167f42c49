"""The registered queries of this subpackage, with SQL where SQL can express them."""

from __future__ import annotations

from .anisotropic_index import OP5_SQL, op5_anisotropic_index
from .chat_format import OP1_SQL, op1_chat_format
from .decontaminate import op4_decontaminate
from .language_id import op11_language_id
from .lm_score import OP9_SQL, op9_lm_score
from .merkle import OP13_SQL, op13_merkle_manifest
from .quality import op8_quality
from .simhash_dedup import op3_simhash_dedup
from .substring_dedup import OP2_SQL, op2_substring_dedup
from .token_alignment import op12_token_alignment
from .token_files import op7_token_files
from .toxicity import op6_toxicity
from .word_lexicon import op10_word_lexicon

QUERIES = {
    f.__name__: f
    for f in (
        op1_chat_format,
        op2_substring_dedup,
        op3_simhash_dedup,
        op4_decontaminate,
        op5_anisotropic_index,
        op6_toxicity,
        op7_token_files,
        op8_quality,
        op9_lm_score,
        op10_word_lexicon,
        op11_language_id,
        op12_token_alignment,
        op13_merkle_manifest,
    )
}

#: Where SQL can't express an operator, tests hold it against brute force instead.
ORACLES = {"op1_chat_format": OP1_SQL, "op2_substring_dedup": OP2_SQL, "op5_anisotropic_index": OP5_SQL, "op9_lm_score": OP9_SQL, "op13_merkle_manifest": OP13_SQL}
