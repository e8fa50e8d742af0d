"""The queries of this subpackage, one per operator, and SQL for those that SQL can express."""

from windgrid.llm.hamming import OP8_SQL, op8_multi_index_hashing
from windgrid.llm.id_store import op4_content_addressed_ids
from windgrid.llm.language import op3_ecoc_language
from windgrid.llm.media import op5_signature_sniffing
from windgrid.llm.near_dedup import OP1_SQL, op1_minhash_near_dedup
from windgrid.llm.packing import op9_best_fit_packing
from windgrid.llm.pieces import op7_sentencepiece_backtracking
from windgrid.llm.quality import op2_bradley_terry_quality
from windgrid.llm.toxicity import op6_pu_toxicity
from windgrid.llm.warc import OP10_SQL, op10_warc_index_merge

QUERIES = {
    "op1_minhash_near_dedup": op1_minhash_near_dedup,
    "op2_bradley_terry_quality": op2_bradley_terry_quality,
    "op3_ecoc_language": op3_ecoc_language,
    "op4_content_addressed_ids": op4_content_addressed_ids,
    "op5_signature_sniffing": op5_signature_sniffing,
    "op6_pu_toxicity": op6_pu_toxicity,
    "op7_sentencepiece_backtracking": op7_sentencepiece_backtracking,
    "op8_multi_index_hashing": op8_multi_index_hashing,
    "op9_best_fit_packing": op9_best_fit_packing,
    "op10_warc_index_merge": op10_warc_index_merge,
}

ORACLE: dict[str, str] = {
    "op1_minhash_near_dedup": OP1_SQL,
    "op8_multi_index_hashing": OP8_SQL,
    "op10_warc_index_merge": OP10_SQL,
}
