"""The registered queries of the corpus operators and their SQL."""

from __future__ import annotations

from .extraction import op5_extraction
from .licences import op2_licences
from .maxent import op9_maxent
from .media import op1_media
from .mixing import op6_mixing
from .packing import op7_packing
from .simhash import op3_simhash
from .spotsigs import op4_spotsigs
from .substring import OP8_SQL, op8_substring
from .toxicity import op10_toxicity

QUERIES = {f.__name__: f for f in (op1_media, op2_licences, op3_simhash, op4_spotsigs, op5_extraction, op6_mixing, op7_packing, op8_substring, op9_maxent, op10_toxicity)}
SQL = {"op8_substring": OP8_SQL}
