"""The queries of the corpus operators, and the SQL of those that SQL can express."""

from __future__ import annotations

from evspark.llm.alignment import op12_token_alignment
from evspark.llm.decontamination import op3_decontamination
from evspark.llm.jaccard_join import op13_jaccard_join
from evspark.llm.language import op5_language_id
from evspark.llm.licenses import OP9_SQL, op9_license_scan
from evspark.llm.near_duplicates import op2_minhash_near_dedup
from evspark.llm.packing import op4_best_fit_packing
from evspark.llm.resampling import OP11_SQL, op11_importance_resampling
from evspark.llm.substrings import op8_suffix_array_dedup
from evspark.llm.token_counts import op10_token_counts
from evspark.llm.toxicity import op6_toxicity
from evspark.llm.vectors import OP7_SQL, op7_exact_top_k
from evspark.llm.warc import op1_warc_dictionary

QUERIES = {
    "op1_warc_dictionary": op1_warc_dictionary,
    "op2_minhash_near_dedup": op2_minhash_near_dedup,
    "op3_decontamination": op3_decontamination,
    "op4_best_fit_packing": op4_best_fit_packing,
    "op5_language_id": op5_language_id,
    "op6_toxicity": op6_toxicity,
    "op7_exact_top_k": op7_exact_top_k,
    "op8_suffix_array_dedup": op8_suffix_array_dedup,
    "op9_license_scan": op9_license_scan,
    "op10_token_counts": op10_token_counts,
    "op11_importance_resampling": op11_importance_resampling,
    "op12_token_alignment": op12_token_alignment,
    "op13_jaccard_join": op13_jaccard_join,
}

ORACLE_SQL: dict[str, str] = {
    "op7_exact_top_k": OP7_SQL,
    "op9_license_scan": OP9_SQL,
    "op11_importance_resampling": OP11_SQL,
}
