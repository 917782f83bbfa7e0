"""The registered queries of this subpackage and their DuckDB twins where SQL can express them."""

from __future__ import annotations

from agewise.llm import collocations, licenses
from agewise.llm.collocations import op13_phrase_collocations
from agewise.llm.conversation_audit import op11_conversation_repair
from agewise.llm.decontaminate import op4_benchmark_decontamination
from agewise.llm.html_extract import op7_html_extraction
from agewise.llm.jaccard_join import op10_ngram_jaccard_join
from agewise.llm.licenses import op2_license_scan
from agewise.llm.mixing import op9_mixing_sources
from agewise.llm.quality_model import op6_quality_classifier
from agewise.llm.quality_rules import op8_quality_rules
from agewise.llm.simhash_index import op12_simhash_dedup
from agewise.llm.substring_dedup import op1_substring_dedup
from agewise.llm.suffix_dedup import op3_suffix_array_dedup
from agewise.llm.token_counts import op5_token_counts

QUERIES = {f.__name__: f for f in (
    op1_substring_dedup, op2_license_scan, op3_suffix_array_dedup, op4_benchmark_decontamination, op5_token_counts,
    op6_quality_classifier, op7_html_extraction, op8_quality_rules, op9_mixing_sources, op10_ngram_jaccard_join,
    op11_conversation_repair, op12_simhash_dedup, op13_phrase_collocations)}

ORACLE = {"op2_license_scan": licenses.oracle(), "op13_phrase_collocations": collocations.oracle()}
