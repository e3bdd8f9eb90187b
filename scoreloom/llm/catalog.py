"""Queries of this folder by name, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from .bpe import op4_bpe
from .exact_dedup import OP6_SQL, op6_exact_dedup
from .near_dedup import op2_near_dedup
from .packing import op8_packing
from .prefix_trie import OP12_SQL, op12_prefix_trie
from .quality_model import op9_quality_model
from .quality_rules import op3_quality_rules
from .secret_scan import op5_secret_scan
from .spelling import OP13_SQL, op13_spelling
from .substring_dedup import OP1_SQL, op1_substring_dedup
from .token_files import op7_token_files
from .toxicity import op11_toxicity
from .url_filter import OP10_SQL, op10_url_filter

QUERIES = {
    "op1_substring_dedup": op1_substring_dedup,
    "op2_near_dedup": op2_near_dedup,
    "op3_quality_rules": op3_quality_rules,
    "op4_bpe": op4_bpe,
    "op5_secret_scan": op5_secret_scan,
    "op6_exact_dedup": op6_exact_dedup,
    "op7_token_files": op7_token_files,
    "op8_packing": op8_packing,
    "op9_quality_model": op9_quality_model,
    "op10_url_filter": op10_url_filter,
    "op11_toxicity": op11_toxicity,
    "op12_prefix_trie": op12_prefix_trie,
    "op13_spelling": op13_spelling,
}

ORACLES: dict[str, str] = {
    "op1_substring_dedup": OP1_SQL,
    "op6_exact_dedup": OP6_SQL,
    "op10_url_filter": OP10_SQL,
    "op12_prefix_trie": OP12_SQL,
    "op13_spelling": OP13_SQL,
}
