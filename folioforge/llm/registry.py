"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from .bpe import op4_bpe
from .fim import OP12_SQL, op12_fim
from .licenses import op6_licenses
from .packing import op8_packing
from .pii import OP11_SQL, op11_pii
from .quality import OP7_SQL, op7_quality
from .sharding import op10_sharding
from .simhash import op2_simhash
from .topk import OP5_SQL, op5_topk
from .toxicity import op1_toxicity
from .trie import OP13_SQL, op13_trie
from .urlfilter import OP9_SQL, op9_urlfilter
from .warc import OP3_SQL, op3_warc

QUERIES = {
    f.__name__: f for f in (op1_toxicity, op2_simhash, op3_warc, op4_bpe, op5_topk, op6_licenses, op7_quality, op8_packing, op9_urlfilter, op10_sharding, op11_pii, op12_fim, op13_trie)
}
ORACLES = {"op3_warc": OP3_SQL, "op5_topk": OP5_SQL, "op7_quality": OP7_SQL, "op9_urlfilter": OP9_SQL, "op11_pii": OP11_SQL, "op12_fim": OP12_SQL, "op13_trie": OP13_SQL}
