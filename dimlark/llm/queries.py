"""The queries of this subpackage by name, and SQL for those that SQL can express."""

from __future__ import annotations

from .chatformat import OP11_SQL, op11_chat_formatting
from .decontam import OP6_SQL, op6_decontamination
from .langid import op2_language_id
from .license_scan import OP1_SQL, op1_license_scan
from .linededup import OP7_SQL, op7_line_dedup
from .merkle import OP12_SQL, op12_merkle_manifest
from .mixing import OP10_SQL, op10_mixing
from .prefixtrie import OP13_SQL, op13_prefix_trie
from .secrets import OP9_SQL, op9_secret_scan
from .simhash import op3_simhash_dedup
from .topk import OP8_SQL, op8_topk
from .urlfilter import op5_url_filter
from .warc import OP4_SQL, op4_warc

QUERIES = {
    "op1_license_scan": op1_license_scan,
    "op2_language_id": op2_language_id,
    "op3_simhash_dedup": op3_simhash_dedup,
    "op4_warc": op4_warc,
    "op5_url_filter": op5_url_filter,
    "op6_decontamination": op6_decontamination,
    "op7_line_dedup": op7_line_dedup,
    "op8_topk": op8_topk,
    "op9_secret_scan": op9_secret_scan,
    "op10_mixing": op10_mixing,
    "op11_chat_formatting": op11_chat_formatting,
    "op12_merkle_manifest": op12_merkle_manifest,
    "op13_prefix_trie": op13_prefix_trie,
}

ORACLE_SQL = {
    "op1_license_scan": OP1_SQL,
    "op4_warc": OP4_SQL,
    "op6_decontamination": OP6_SQL,
    "op7_line_dedup": OP7_SQL,
    "op8_topk": OP8_SQL,
    "op9_secret_scan": OP9_SQL,
    "op10_mixing": OP10_SQL,
    "op11_chat_formatting": OP11_SQL,
    "op12_merkle_manifest": OP12_SQL,
    "op13_prefix_trie": OP13_SQL,
}
