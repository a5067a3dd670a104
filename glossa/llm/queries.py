"""The queries of this subpackage by name, and DuckDB SQL where SQL can express one."""

from __future__ import annotations

from .audit import OP11_SQL, op11_filter_audit
from .decontam import op4_decontaminate
from .langid import op10_language_id
from .linededup import OP2_SQL, op2_line_dedup
from .media import op8_media
from .merkle import OP13_SQL, op13_merkle_manifest
from .neardup import op7_near_duplicates
from .neighbours import op12_nearest_neighbours
from .packing import op6_packing
from .quality import op1_quality
from .sufdedup import op5_suffix_dedup
from .tokenbin import op9_token_binary
from .urlfilter import OP3_SQL, op3_url_filter

QUERIES = {
    "op1_quality": op1_quality,
    "op2_line_dedup": op2_line_dedup,
    "op3_url_filter": op3_url_filter,
    "op4_decontaminate": op4_decontaminate,
    "op5_suffix_dedup": op5_suffix_dedup,
    "op6_packing": op6_packing,
    "op7_near_duplicates": op7_near_duplicates,
    "op8_media": op8_media,
    "op9_token_binary": op9_token_binary,
    "op10_language_id": op10_language_id,
    "op11_filter_audit": op11_filter_audit,
    "op12_nearest_neighbours": op12_nearest_neighbours,
    "op13_merkle_manifest": op13_merkle_manifest,
}
ORACLES: dict[str, str] = {"op2_line_dedup": OP2_SQL, "op3_url_filter": OP3_SQL, "op11_filter_audit": OP11_SQL, "op13_merkle_manifest": OP13_SQL}
