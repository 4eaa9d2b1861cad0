"""Operators of a training-data pipeline: each is a function from DataFrames to a DataFrame, with its query and, where SQL can say it, its
checking SQL. Nothing else in the library imports this package."""
from __future__ import annotations

from fleetcost.llm import centroids, chat, fingerprints, fmindex, langid, mih, mixing, negatives, packing, quality, simhash, suffix, urls

_QUERIES = {"op1_quality_rules": quality, "op2_chat_formatting": chat, "op3_packing": packing, "op4_language_id": langid, "op5_url_filters": urls,
            "op6_mixing": mixing, "op7_simhash": simhash, "op8_suffix_dedup": suffix, "op9_topk_search": mih, "op10_substring_dedup": fmindex,
            "op11_fingerprints": fingerprints, "op12_hard_negatives": negatives, "op13_centroids": centroids}

QUERIES = {name: module.run for name, module in _QUERIES.items()}
SQL = {name: module.SQL for name, module in _QUERIES.items() if hasattr(module, "SQL")}
