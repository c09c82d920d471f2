"""The queries of this subpackage by name, and SQL that gives the same rows where SQL can."""

from .bpe import op5_bpe
from .chat import OP1_SQL, op1_chat
from .decontaminate import OP6_SQL, op6_decontaminate
from .fertility import op12_fertility
from .pages import op3_pages
from .passages import OP2_SQL, op2_passages
from .quality import op10_quality
from .runs import op11_runs
from .secrets import op7_secrets
from .shard import op4_shard
from .simhash import op9_simhash
from .vectors import OP8_SQL, op8_vectors
from .whitening import op13_whitening

QUERIES = {
    "op1_chat": op1_chat,
    "op2_passages": op2_passages,
    "op3_pages": op3_pages,
    "op4_shard": op4_shard,
    "op5_bpe": op5_bpe,
    "op6_decontaminate": op6_decontaminate,
    "op7_secrets": op7_secrets,
    "op8_vectors": op8_vectors,
    "op9_simhash": op9_simhash,
    "op10_quality": op10_quality,
    "op11_runs": op11_runs,
    "op12_fertility": op12_fertility,
    "op13_whitening": op13_whitening,
}
ORACLE_SQL = {"op1_chat": OP1_SQL, "op2_passages": OP2_SQL, "op6_decontaminate": OP6_SQL, "op8_vectors": OP8_SQL}
