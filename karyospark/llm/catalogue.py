"""The operators' queries and the SQL that checks them, where SQL can express them."""

from __future__ import annotations

from karyospark.llm import licenses, topk, url_filter
from karyospark.llm.alignment import op12_alignment
from karyospark.llm.decontamination import op4_decontamination
from karyospark.llm.jaccard import op7_jaccard
from karyospark.llm.language import op8_language
from karyospark.llm.packing import op1_packing
from karyospark.llm.quality import op2_quality
from karyospark.llm.simhash import op13_simhash
from karyospark.llm.token_files import op10_token_files
from karyospark.llm.toxicity import op9_toxicity
from karyospark.llm.whitening import op11_whitening

QUERIES = {q.__name__: q for q in (
    op1_packing, op2_quality, licenses.op3_licenses, op4_decontamination, topk.op5_topk, url_filter.op6_url_filter, op7_jaccard, op8_language, op9_toxicity, op10_token_files,
    op11_whitening, op12_alignment, op13_simhash)}
SQL = {"op3_licenses": licenses.ORACLE_SQL, "op5_topk": topk.ORACLE_SQL, "op6_url_filter": url_filter.ORACLE_SQL}
