"""The queries of this subpackage and, where SQL can express one, its SQL."""

from .exact import EXACT_SQL, exact_query
from .language import language_query
from .lines import LINES_SQL, lines_query
from .mixing import mixing_query
from .near import NEAR_SQL, near_query
from .packing import packing_query
from .passages import PASSAGES_SQL, passages_query
from .quality import quality_query
from .secrets import SECRETS_SQL, secrets_query
from .vectors import VECTORS_SQL, vectors_query

QUERIES = {
    "op1_mixing": mixing_query,
    "op2_quality": quality_query,
    "op3_packing": packing_query,
    "op4_exact_dedup": exact_query,
    "op5_line_dedup": lines_query,
    "op6_vector_dedup": vectors_query,
    "op7_secrets": secrets_query,
    "op8_near_dedup": near_query,
    "op9_language": language_query,
    "op10_passage_dedup": passages_query,
}
ORACLE_SQL = {
    "op4_exact_dedup": EXACT_SQL,
    "op5_line_dedup": LINES_SQL,
    "op6_vector_dedup": VECTORS_SQL,
    "op7_secrets": SECRETS_SQL,
    "op8_near_dedup": NEAR_SQL,
    "op10_passage_dedup": PASSAGES_SQL,
}
