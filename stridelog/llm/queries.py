"""The registered queries of this subpackage, and their SQL where SQL can say it."""

from __future__ import annotations

from . import exact_dedup, filter_audit, line_dedup, warc
from .bpe import op3_bpe
from .embeddings import op10_embedding_near_dedup
from .exact_dedup import op9_exact_dedup
from .filter_audit import op11_filter_audit
from .licenses import op6_license_scan
from .line_dedup import op12_line_dedup
from .packing import op4_best_fit_packing
from .periodic import op13_periodic_runs
from .simhash import op2_simhash
from .suffixes import op8_suffix_dedup
from .token_counts import op1_token_counts
from .toxicity import op5_toxicity
from .warc import op7_warc_derivatives

QUERIES = {
    "op1_token_counts": op1_token_counts,
    "op2_simhash": op2_simhash,
    "op3_bpe": op3_bpe,
    "op4_best_fit_packing": op4_best_fit_packing,
    "op5_toxicity": op5_toxicity,
    "op6_license_scan": op6_license_scan,
    "op7_warc_derivatives": op7_warc_derivatives,
    "op8_suffix_dedup": op8_suffix_dedup,
    "op9_exact_dedup": op9_exact_dedup,
    "op10_embedding_near_dedup": op10_embedding_near_dedup,
    "op11_filter_audit": op11_filter_audit,
    "op12_line_dedup": op12_line_dedup,
    "op13_periodic_runs": op13_periodic_runs,
}
SQL: dict[str, str] = {"op7_warc_derivatives": warc.SQL, "op9_exact_dedup": exact_dedup.SQL, "op11_filter_audit": filter_audit.SQL, "op12_line_dedup": line_dedup.SQL}
