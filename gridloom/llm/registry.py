"""The op queries and, where SQL can say the same, their SQL."""

from gridloom.llm.byte_bpe import op10_byte_bpe
from gridloom.llm.chat import OP8_SQL, op8_chat_format
from gridloom.llm.exact_dedup import OP2_SQL, op2_exact_dedup
from gridloom.llm.language import op7_language_id
from gridloom.llm.licenses import OP4_SQL, op4_license_scan
from gridloom.llm.mixing import OP1_SQL, op1_mix
from gridloom.llm.near_dedup import op5_near_dedup
from gridloom.llm.repeats import op6_remove_repeats
from gridloom.llm.token_count import op3_token_counts
from gridloom.llm.vector_dedup import op9_vector_dedup

QUERIES = {
    "op1_mix": op1_mix,
    "op2_exact_dedup": op2_exact_dedup,
    "op3_token_counts": op3_token_counts,
    "op4_license_scan": op4_license_scan,
    "op5_near_dedup": op5_near_dedup,
    "op6_remove_repeats": op6_remove_repeats,
    "op7_language_id": op7_language_id,
    "op8_chat_format": op8_chat_format,
    "op9_vector_dedup": op9_vector_dedup,
    "op10_byte_bpe": op10_byte_bpe,
}
ORACLE_SQL = {"op1_mix": OP1_SQL, "op2_exact_dedup": OP2_SQL, "op4_license_scan": OP4_SQL, "op8_chat_format": OP8_SQL}
