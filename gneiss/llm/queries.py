"""Queries of this subpackage: opN_<name> over the whole intended table."""

from __future__ import annotations

from gneiss.llm.ann import op8_multi_index_hashing
from gneiss.llm.decontamination import op3_template_decontamination
from gneiss.llm.divergence import OP12_SQL, op12_source_divergence
from gneiss.llm.html_extraction import op6_html_extraction
from gneiss.llm.language_id import op4_language_id
from gneiss.llm.line_dedup import OP7_SQL, op7_line_dedup
from gneiss.llm.minhash_dedup import OP10_SQL, op10_minhash_dedup
from gneiss.llm.mixing import OP2_SQL, op2_source_mixing
from gneiss.llm.piece_encoding import op11_piece_encoding
from gneiss.llm.resampling import OP13_SQL, op13_importance_resampling
from gneiss.llm.substring_dedup import OP9_SQL, op9_substring_dedup
from gneiss.llm.suffix_dedup import OP1_SQL, op1_suffix_dedup
from gneiss.llm.token_counts import op5_token_counts

QUERIES = {
    "op1_suffix_dedup": op1_suffix_dedup,
    "op2_source_mixing": op2_source_mixing,
    "op3_template_decontamination": op3_template_decontamination,
    "op10_minhash_dedup": op10_minhash_dedup,
    "op5_token_counts": op5_token_counts,
    "op4_language_id": op4_language_id,
    "op6_html_extraction": op6_html_extraction,
    "op8_multi_index_hashing": op8_multi_index_hashing,
    "op7_line_dedup": op7_line_dedup,
    "op9_substring_dedup": op9_substring_dedup,
    "op11_piece_encoding": op11_piece_encoding,
    "op12_source_divergence": op12_source_divergence,
    "op13_importance_resampling": op13_importance_resampling,
}
ORACLES: dict[str, str] = {"op1_suffix_dedup": OP1_SQL, "op7_line_dedup": OP7_SQL, "op2_source_mixing": OP2_SQL, "op9_substring_dedup": OP9_SQL, "op10_minhash_dedup": OP10_SQL, "op12_source_divergence": OP12_SQL, "op13_importance_resampling": OP13_SQL}
