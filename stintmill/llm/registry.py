"""Queries of the training-data operators and the SQL that checks them."""

from __future__ import annotations

from .bpe import op12_bpe
from .centroids import OP11_SQL, op11_centroids
from .conversations import op13_conversations
from .decontam import op1_decontaminate
from .html import op7_extract_text
from .licences import op6_licences
from .lines import op5_line_dedup
from .mixing import OP8_SQL, op8_mix_sources
from .neardup import op2_near_duplicates
from .neighbours import op4_nearest
from .toxicity import op3_toxicity
from .urls import op9_url_filter
from .warc import op10_warc


def queries() -> dict:
    return {
        "op1_decontaminate": op1_decontaminate,
        "op2_near_duplicates": op2_near_duplicates,
        "op3_toxicity": op3_toxicity,
        "op4_nearest": op4_nearest,
        "op5_line_dedup": op5_line_dedup,
        "op6_licences": op6_licences,
        "op7_extract_text": op7_extract_text,
        "op8_mix_sources": op8_mix_sources,
        "op9_url_filter": op9_url_filter,
        "op10_warc": op10_warc,
        "op11_centroids": op11_centroids,
        "op12_bpe": op12_bpe,
        "op13_conversations": op13_conversations,
    }


def oracle_sql() -> dict[str, str]:
    return {"op8_mix_sources": OP8_SQL, "op11_centroids": OP11_SQL}
