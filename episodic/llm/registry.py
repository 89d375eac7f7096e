"""Queries of this subpackage and the SQL of those that SQL can express."""

from __future__ import annotations

from episodic.llm.cross_polytope import op9_cross_polytope_dedup
from episodic.llm.exact_dedup import OP10_SQL, op10_exact_dedup
from episodic.llm.fm_dedup import op3_fm_index_dedup
from episodic.llm.lexical import OP11_SQL, op11_lexical_search
from episodic.llm.license_scan import op6_license_scan
from episodic.llm.minhash_dedup import op8_minhash_dedup
from episodic.llm.mixing import OP12_SQL, op12_source_mixing
from episodic.llm.packing import op4_best_fit_packing
from episodic.llm.sentencepiece_lattice import op2_sentencepiece
from episodic.llm.suffix_dedup import op5_suffix_array_dedup
from episodic.llm.toxicity import op1_toxicity
from episodic.llm.url_filter import op7_url_filter
from episodic.llm.whitening import op13_embedding_whitening

QUERIES = {
    "op1_toxicity": op1_toxicity,
    "op2_sentencepiece": op2_sentencepiece,
    "op3_fm_index_dedup": op3_fm_index_dedup,
    "op4_best_fit_packing": op4_best_fit_packing,
    "op5_suffix_array_dedup": op5_suffix_array_dedup,
    "op6_license_scan": op6_license_scan,
    "op7_url_filter": op7_url_filter,
    "op8_minhash_dedup": op8_minhash_dedup,
    "op9_cross_polytope_dedup": op9_cross_polytope_dedup,
    "op10_exact_dedup": op10_exact_dedup,
    "op11_lexical_search": op11_lexical_search,
    "op12_source_mixing": op12_source_mixing,
    "op13_embedding_whitening": op13_embedding_whitening,
}

ORACLE = {"op10_exact_dedup": OP10_SQL, "op11_lexical_search": OP11_SQL, "op12_source_mixing": OP12_SQL}
