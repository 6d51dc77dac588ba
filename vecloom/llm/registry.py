"""The queries of the ten training-data operators, and SQL for those that SQL can express."""

from __future__ import annotations

from .decontaminate import OP2_SQL, op2_decontaminate
from .exact_topk import OP1_SQL, op1_exact_topk
from .language_id import op10_language_id
from .license_scan import op7_license_scan
from .ngram_lm import op8_deleted_interpolation
from .sentencepiece_codec import op9_sentencepiece
from .simhash_dedup import op3_simhash_dedup
from .substring_dedup import OP5_SQL, op5_substring_dedup
from .token_binary import op6_token_binary
from .warc import OP4_SQL, op4_warc


def queries():
    return {
        "op1_exact_topk": op1_exact_topk,
        "op2_decontaminate": op2_decontaminate,
        "op3_simhash_dedup": op3_simhash_dedup,
        "op4_warc": op4_warc,
        "op5_substring_dedup": op5_substring_dedup,
        "op6_token_binary": op6_token_binary,
        "op7_license_scan": op7_license_scan,
        "op8_deleted_interpolation": op8_deleted_interpolation,
        "op9_sentencepiece": op9_sentencepiece,
        "op10_language_id": op10_language_id,
    }


def oracle_sql():
    return {"op1_exact_topk": OP1_SQL, "op2_decontaminate": OP2_SQL, "op4_warc": OP4_SQL, "op5_substring_dedup": OP5_SQL}
