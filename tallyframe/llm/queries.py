"""The queries of this subpackage and, where SQL expresses them, their oracles."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from tallyframe.llm import centroids, covertree, impacts

#: Query to its module; the function has the query's name.
MODULES = {
    "op1_toxicity_grammar": "toxicity",
    "op2_mixture": "mixing",
    "op3_cover_tree": "covertree",
    "op4_hilbert_packing": "packing",
    "op5_surrogates": "pii",
    "op6_minhash": "minhash",
    "op7_media_sniffing": "media",
    "op8_sentence_spans": "spans",
    "op9_binary_records": "records",
    "op10_html_template": "htmltemplate",
    "op11_lexicon_bpe": "lexicon",
    "op12_impact_search": "impacts",
    "op13_weighted_lloyd": "centroids",
}


def queries() -> dict[str, Callable]:
    return {name: getattr(import_module(f"tallyframe.llm.{module}"), name) for name, module in MODULES.items()}


def oracle_sql() -> dict[str, str]:
    """Vectors and ranked search: fitted scores, hashes, tokenizers and markup are not in SQL's reach, and pairs of whole shingle sets are too slow there."""
    return {"op3_cover_tree": covertree.ORACLE, "op12_impact_search": impacts.ORACLE, "op13_weighted_lloyd": centroids.ORACLE}
