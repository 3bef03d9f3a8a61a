"""The registered queries of this folder and their SQL."""

from __future__ import annotations

from .bpe_codec import op10_bpe_codec
from .fingerprints import op1_document_fingerprints
from .line_dedup import op5_line_dedup
from .mixing import MIXING_TOTALS_SQL, mixing_totals, op7_source_mixing
from .neardup import op8_simhash_neardup
from .quality_classifier import op6_quality_classifier
from .quality_rules import op4_quality_rules
from .token_counts import op9_token_counts
from .token_files import op2_token_files
from .warc import OP3_SQL, op3_warc_archives

QUERIES = {
    "op1_document_fingerprints": op1_document_fingerprints,
    "op2_token_files": op2_token_files,
    "op3_warc_archives": op3_warc_archives,
    "op4_quality_rules": op4_quality_rules,
    "op5_line_dedup": op5_line_dedup,
    "op6_quality_classifier": op6_quality_classifier,
    "op7_source_mixing": op7_source_mixing,
    "mixing_totals": mixing_totals,
    "op8_simhash_neardup": op8_simhash_neardup,
    "op9_token_counts": op9_token_counts,
    "op10_bpe_codec": op10_bpe_codec,
}
ORACLES: dict[str, str] = {"op3_warc_archives": OP3_SQL, "mixing_totals": MIXING_TOTALS_SQL}
