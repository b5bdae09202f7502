"""The training-data queries by name, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from mailstruct.llm.clustering import ORACLE as CLUSTERING_ORACLE
from mailstruct.llm.clustering import op11_centroid_clustering
from mailstruct.llm.divergence import ORACLE as DIVERGENCE_ORACLE
from mailstruct.llm.divergence import op13_divergence_audit
from mailstruct.llm.mixing import op9_budget_fit
from mailstruct.llm.near_duplicates import op5_jaccard_join
from mailstruct.llm.nearest import op6_collision_counting
from mailstruct.llm.packing import op2_hierarchical_packing
from mailstruct.llm.pieces import op12_piece_encoding
from mailstruct.llm.rules import op10_rule_ensemble
from mailstruct.llm.sharding import op3_kd_tree
from mailstruct.llm.token_cache import op4_digest_cache
from mailstruct.llm.toxicity import op8_nearest_examples
from mailstruct.llm.transport_stream import op1_transport_stream
from mailstruct.llm.warc_bundles import ORACLE as WARC_ORACLE
from mailstruct.llm.warc_bundles import op7_seekable_bundles

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_transport_stream": op1_transport_stream,
    "op2_hierarchical_packing": op2_hierarchical_packing,
    "op3_kd_tree": op3_kd_tree,
    "op4_digest_cache": op4_digest_cache,
    "op5_jaccard_join": op5_jaccard_join,
    "op6_collision_counting": op6_collision_counting,
    "op7_seekable_bundles": op7_seekable_bundles,
    "op8_nearest_examples": op8_nearest_examples,
    "op9_budget_fit": op9_budget_fit,
    "op10_rule_ensemble": op10_rule_ensemble,
    "op11_centroid_clustering": op11_centroid_clustering,
    "op12_piece_encoding": op12_piece_encoding,
    "op13_divergence_audit": op13_divergence_audit,
}

ORACLES: dict[str, str] = {
    "op7_seekable_bundles": WARC_ORACLE,
    "op11_centroid_clustering": CLUSTERING_ORACLE,
    "op13_divergence_audit": DIVERGENCE_ORACLE,
}
