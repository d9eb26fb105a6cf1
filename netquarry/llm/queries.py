"""The registered queries of the text operators, and their SQL where SQL can express them."""

from .chat import OP3_SQL, op3_chat
from .decontaminate import op4_decontaminate
from .exact_dedup import OP7_SQL, op7_exact_dedup
from .line_dedup import OP10_SQL, op10_line_dedup
from .mixing import op8_mix
from .near_dedup import op2_near_dedup
from .pii import op9_pii
from .quality import op5_quality
from .token_parquet import op6_token_parquet
from .warc import OP1_SQL, op1_warc

QUERIES = {
    "op1_warc": op1_warc,
    "op2_near_dedup": op2_near_dedup,
    "op3_chat": op3_chat,
    "op4_decontaminate": op4_decontaminate,
    "op5_quality": op5_quality,
    "op6_token_parquet": op6_token_parquet,
    "op7_exact_dedup": op7_exact_dedup,
    "op8_mix": op8_mix,
    "op9_pii": op9_pii,
    "op10_line_dedup": op10_line_dedup,
}

ORACLE_SQL = {
    "op1_warc": OP1_SQL,
    "op3_chat": OP3_SQL,
    "op7_exact_dedup": OP7_SQL,
    "op10_line_dedup": OP10_SQL,
}
