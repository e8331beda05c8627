"""The queries of this subpackage and their SQL, for the registry at the repository's top."""

from .filteraudit import OP12_SQL, op12_filter_audit
from .langcrf import op11_language_id
from .linededup import OP1_SQL, op1_line_dedup
from .lm import op6_lm
from .mixing import OP5_SQL, op5_mixing
from .neardup import op7_neardup
from .pieces import op9_pieces
from .prefixtrie import OP13_SQL, op13_prefix_trie
from .quality import OP10_SQL, op10_quality_rules
from .secrets import op8_secrets
from .sharding import op3_sharding
from .topk import OP2_SQL, op2_topk
from .toxicity import op4_toxicity

QUERIES = {f.__name__: f for f in (op1_line_dedup, op2_topk, op3_sharding, op4_toxicity, op5_mixing, op6_lm, op7_neardup, op8_secrets, op9_pieces, op10_quality_rules, op11_language_id, op12_filter_audit, op13_prefix_trie)}
SQL = {"op1_line_dedup": OP1_SQL, "op2_topk": OP2_SQL, "op5_mixing": OP5_SQL, "op10_quality_rules": OP10_SQL, "op12_filter_audit": OP12_SQL, "op13_prefix_trie": OP13_SQL}
