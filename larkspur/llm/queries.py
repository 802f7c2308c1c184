"""The registered queries of this subpackage, and SQL where it can express them."""

from __future__ import annotations

from .chunk_codec import op13_chunk_codec
from .decontaminate import op4_decontamination
from .embedding_dedup import op8_embedding_dedup
from .jaccard_join import op10_jaccard_join
from .language_id import op5_language_id
from .merkle import op12_merkle_manifest, op12_sql
from .mixing import op9_mixing
from .quality import op1_quality
from .secrets import op3_secret_scan
from .substring_dedup import op7_suffix_array_dedup
from .token_alignment import op11_token_alignment
from .token_counts import op6_token_counts
from .url_filter import op2_sql, op2_url_filter

QUERIES = {f.__name__: f for f in (op1_quality, op2_url_filter, op3_secret_scan, op4_decontamination, op5_language_id, op6_token_counts, op7_suffix_array_dedup, op8_embedding_dedup, op9_mixing, op10_jaccard_join, op11_token_alignment, op12_merkle_manifest, op13_chunk_codec)}
SQL = {"op2_url_filter": op2_sql(), "op12_merkle_manifest": op12_sql()}
