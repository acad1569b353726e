"""The queries of this subpackage, and SQL for those that it can express."""

from __future__ import annotations

from .bpe import op10_bpe_speculate_verify
from .chat import op7_chat_prefix_targets
from .fingerprint import op13_weighted_sampling
from .html import op1_dom_tree_extraction
from .kmeans import op11_weighted_lloyd
from .merkle import op12_merkle_manifest
from .neardup import op9_probminhash_near_dedup
from .packing import op5_order_preserving_packing
from .pii import op8_pii_surrogates
from .quality import op4_quality_ledger
from .sharding import op6_rendezvous_sharding
from .sql import SQL
from .topk import op2_bit_sliced_topk
from .warc import op3_warc_zstd


def queries() -> dict:
    found = [
        op1_dom_tree_extraction,
        op2_bit_sliced_topk,
        op3_warc_zstd,
        op4_quality_ledger,
        op5_order_preserving_packing,
        op6_rendezvous_sharding,
        op7_chat_prefix_targets,
        op8_pii_surrogates,
        op9_probminhash_near_dedup,
        op10_bpe_speculate_verify,
        op11_weighted_lloyd,
        op12_merkle_manifest,
        op13_weighted_sampling,
    ]
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
