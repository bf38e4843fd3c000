"""The training-data queries by name, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from strandlake.llm import jaccard_join, mixing
from strandlake.llm.bpe_tree import op8_bpe_tree
from strandlake.llm.toxicity_fst import op5_toxicity_fst
from strandlake.llm.language_parse import op3_language_parse
from strandlake.llm.token_counts import op7_token_counts
from strandlake.llm.media_chunks import op2_media_chunks
from strandlake.llm.jaccard_join import op4_jaccard_join, op4_jaccard_links
from strandlake.llm.multi_index import op1_multi_index
from strandlake.llm.url_templates import op9_url_templates
from strandlake.llm.quality_cnn import op6_quality_cnn
from strandlake.llm.mixing import op10_curriculum_mix

QUERIES = {
    "op9_url_templates": op9_url_templates,
    "op1_multi_index": op1_multi_index,
    "op4_jaccard_join": op4_jaccard_join,
    "op4_jaccard_links": op4_jaccard_links,
    "op2_media_chunks": op2_media_chunks,
    "op7_token_counts": op7_token_counts,
    "op3_language_parse": op3_language_parse,
    "op5_toxicity_fst": op5_toxicity_fst,
    "op6_quality_cnn": op6_quality_cnn,
    "op8_bpe_tree": op8_bpe_tree,
    "op10_curriculum_mix": op10_curriculum_mix,
}

ORACLES: dict[str, str] = {
    "op4_jaccard_join": jaccard_join.ORACLE,
    "op4_jaccard_links": jaccard_join.LINKS_ORACLE,
    "op10_curriculum_mix": mixing.ORACLE,
}
