"""The queries of this folder's operators, and the SQL of those that SQL can express."""

from __future__ import annotations

from .bpe import op10_bpe
from .conversations import op11_conversation_repair
from .decontaminate import OP9_SQL, op9_decontaminate
from .embeddings import OP8_SQL, op8_embeddings
from .filter_audit import OP13_SQL, op13_filter_audit
from .html import op2_html
from .language import op5_language
from .licenses import OP1_SQL, op1_licenses
from .sharding import OP6_SQL, op6_shards
from .simhash import op7_simhash
from .token_store import op4_token_store
from .toxicity import op3_toxicity
from .urls import OP12_SQL, op12_url_filters

QUERIES = {f.__name__: f for f in (op1_licenses, op2_html, op3_toxicity, op4_token_store, op5_language, op6_shards, op7_simhash, op8_embeddings, op9_decontaminate, op10_bpe, op11_conversation_repair, op12_url_filters, op13_filter_audit)}
SQL = {"op1_licenses": OP1_SQL, "op6_shards": OP6_SQL, "op8_embeddings": OP8_SQL, "op9_decontaminate": OP9_SQL, "op12_url_filters": OP12_SQL, "op13_filter_audit": OP13_SQL}
