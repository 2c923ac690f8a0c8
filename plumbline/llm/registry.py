"""The queries of this subpackage and the SQL of those that SQL can express."""

from .bpe import op8_bpe
from .ctw import op10_lm_scores
from .exact_dedup import OP7_SQL, op7_exact_dedup
from .langid import op9_langid
from .licences import OP3_SQL, op3_licences
from .merkle import op6_fingerprints
from .minhash import OP2_SQL, op2_minhash
from .mixing import OP4_SQL, op4_mixing
from .pii import OP1_SQL, op1_pii
from .urls import op5_url_filter

QUERIES = {
    "op1_pii": op1_pii,
    "op2_minhash": op2_minhash,
    "op3_licences": op3_licences,
    "op4_mixing": op4_mixing,
    "op5_url_filter": op5_url_filter,
    "op6_fingerprints": op6_fingerprints,
    "op7_exact_dedup": op7_exact_dedup,
    "op8_bpe": op8_bpe,
    "op9_langid": op9_langid,
    "op10_lm_scores": op10_lm_scores,
}

ORACLES = {
    "op1_pii": OP1_SQL,
    "op2_minhash": OP2_SQL,
    "op3_licences": OP3_SQL,
    "op4_mixing": OP4_SQL,
    "op7_exact_dedup": OP7_SQL,
}
