"""The corpus operators' registered queries, with DuckDB SQL where it can express them."""

from threadloom.llm.chat_format import op9_chat_format
from threadloom.llm.decontaminate import op5_decontaminate
from threadloom.llm.embedding_dedup import OP12_SQL, op12_embedding_dedup
from threadloom.llm.fingerprint import op3_fingerprint
from threadloom.llm.jaccard_join import OP7_SQL, op7_jaccard_join
from threadloom.llm.language_id import op10_language_id
from threadloom.llm.license_scan import op2_license_scan
from threadloom.llm.mixing import op6_mixing
from threadloom.llm.quality import op4_quality
from threadloom.llm.spelling import op13_spelling_variants
from threadloom.llm.suffix_dedup import op1_suffix_dedup
from threadloom.llm.url_filter import op8_url_filter
from threadloom.llm.vector_codes import OP11_SQL, op11_vector_codes

QUERIES = {
    "op1_suffix_dedup": op1_suffix_dedup,
    "op2_license_scan": op2_license_scan,
    "op3_fingerprint": op3_fingerprint,
    "op4_quality": op4_quality,
    "op5_decontaminate": op5_decontaminate,
    "op6_mixing": op6_mixing,
    "op7_jaccard_join": op7_jaccard_join,
    "op8_url_filter": op8_url_filter,
    "op9_chat_format": op9_chat_format,
    "op10_language_id": op10_language_id,
    "op11_vector_codes": op11_vector_codes,
    "op12_embedding_dedup": op12_embedding_dedup,
    "op13_spelling_variants": op13_spelling_variants,
}
ORACLE_SQL = {"op7_jaccard_join": OP7_SQL, "op11_vector_codes": OP11_SQL, "op12_embedding_dedup": OP12_SQL}
