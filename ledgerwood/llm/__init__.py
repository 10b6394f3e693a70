"""Operators for training-data pipelines. Nothing else in the library imports them."""

from . import decontaminate, license_scan, minhash, multi_index, url_filter, vector_codes
from .alignment import op12_alignment
from .decontaminate import op2_decontamination
from .html_text import op8_html_text
from .license_scan import op3_license_scan
from .minhash import op1_minhash
from .multi_index import op6_multi_index
from .pitman_yor import op7_pitman_yor
from .quality import op9_quality
from .sentencepiece_lattice import op4_sentencepiece
from .token_counts import op10_token_counts
from .toxicity import op5_toxicity
from .url_filter import op11_url_filter
from .vector_codes import op13_vector_codes

QUERIES = {
    "op1_minhash": op1_minhash,
    "op2_decontamination": op2_decontamination,
    "op3_license_scan": op3_license_scan,
    "op4_sentencepiece": op4_sentencepiece,
    "op5_toxicity": op5_toxicity,
    "op6_multi_index": op6_multi_index,
    "op7_pitman_yor": op7_pitman_yor,
    "op8_html_text": op8_html_text,
    "op9_quality": op9_quality,
    "op10_token_counts": op10_token_counts,
    "op11_url_filter": op11_url_filter,
    "op12_alignment": op12_alignment,
    "op13_vector_codes": op13_vector_codes,
}
ORACLES = {"op6_multi_index": multi_index.ORACLE, "op1_minhash": minhash.ORACLE, "op2_decontamination": decontaminate.ORACLE, "op3_license_scan": license_scan.ORACLE, "op11_url_filter": url_filter.ORACLE, "op13_vector_codes": vector_codes.ORACLE}
