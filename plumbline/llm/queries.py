"""The registered queries of this subpackage, one for each operator, and their SQL."""

from . import chat, cover_tree, repair, secrets, variants
from .bpe import op7_bpe
from .lines import op1_lines
from .ngram_join import op9_ngram_join
from .packing import op3_packing
from .pages import op6_pages
from .quality import op10_quality
from .token_files import op8_token_files
from .weighted_prints import op5_weighted_prints

QUERIES = {
    "op1_lines": op1_lines,
    "op2_secrets": secrets.op2_secrets,
    "op3_packing": op3_packing,
    "op4_cover_tree": cover_tree.op4_cover_tree,
    "op5_weighted_prints": op5_weighted_prints,
    "op6_pages": op6_pages,
    "op7_bpe": op7_bpe,
    "op8_token_files": op8_token_files,
    "op9_ngram_join": op9_ngram_join,
    "op10_quality": op10_quality,
    "op11_chat": chat.op11_chat,
    "op12_variants": variants.op12_variants,
    "op13_repair": repair.op13_repair,
}

ORACLE_SQL: dict[str, str] = {"op2_secrets": secrets.SQL, "op4_cover_tree": cover_tree.SQL, "op11_chat": chat.SQL, "op12_variants": variants.SQL}
