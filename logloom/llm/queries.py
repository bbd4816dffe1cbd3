"""Registered queries of this subpackage and their SQL."""

from __future__ import annotations

from .op1_license_scan import op1_license_scan
from .op10_lattice import op10_lattice
from .op11_whiten import op11_whiten
from .op12_decontaminate import OP12_SQL, op12_decontaminate
from .op13_audit import OP13_SQL, op13_audit
from .op2_chat_format import OP2_SQL, op2_chat_format
from .op3_suffix_dedup import op3_suffix_dedup
from .op4_additive import op4_additive
from .op5_sentencepiece import op5_sentencepiece
from .op6_shard import op6_shard
from .op7_quality import op7_quality
from .op8_jaccard import op8_jaccard
from .op9_pack import op9_pack

QUERIES = {f.__name__: f for f in (op1_license_scan, op2_chat_format, op3_suffix_dedup, op4_additive, op5_sentencepiece, op6_shard, op7_quality, op8_jaccard, op9_pack, op10_lattice, op11_whiten, op12_decontaminate, op13_audit)}
SQL = {"op2_chat_format": OP2_SQL, "op12_decontaminate": OP12_SQL, "op13_audit": OP13_SQL}
