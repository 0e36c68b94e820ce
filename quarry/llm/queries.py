"""The queries of this subpackage and, where SQL can express them, their DuckDB equivalents."""

from __future__ import annotations

from quarry.llm.decontaminate import op3_decontamination
from quarry.llm.html_text import op9_html_extraction
from quarry.llm.licenses import op2_license_scan
from quarry.llm.near_dups import op10_near_duplicates
from quarry.llm.packing import op7_packing
from quarry.llm import oracles, secrets
from quarry.llm.quality import op4_quality_rules
from quarry.llm.secrets import op6_secret_scan
from quarry.llm.tokens import op1_token_counts
from quarry.llm.toxicity import op5_toxicity
from quarry.llm.warc import op8_warc

QUERIES = {f.__name__: f for f in (op1_token_counts, op2_license_scan, op3_decontamination, op4_quality_rules, op5_toxicity, op6_secret_scan, op7_packing, op8_warc, op9_html_extraction, op10_near_duplicates)}
ORACLE: dict[str, str] = {**secrets.ORACLE, **oracles.ORACLE}
