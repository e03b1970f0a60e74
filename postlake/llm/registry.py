"""The queries of this subpackage: each applies its operator to the whole of its table."""

from __future__ import annotations

from . import alignment, bpe, lm_scoring, mixing, packing, quality, quotes, simhash, token_counts, topk, toxicity, url_filter, variants
from .common import table


def queries() -> dict:
    return {
        "op1_url_filter": lambda s, d: url_filter.url_verdicts(table(s, d, "pages")),
        "op2_topk": lambda s, d: topk.top_k(table(s, d, "embeddings")),
        "op3_packing": lambda s, d: packing.piece_digests(packing.pack_documents(table(s, d, "documents"))),
        "op4_quality": lambda s, d: quality.quality(table(s, d, "documents")),
        "op5_token_counts": lambda s, d: token_counts.token_counts(table(s, d, "documents")),
        "op6_simhash": lambda s, d: simhash.components_of_documents(table(s, d, "documents")),
        "op7_toxicity": lambda s, d: toxicity.toxicity(table(s, d, "documents"), table(s, d, "labels")),
        "op8_quotes": lambda s, d: quotes.formatted(table(s, d, "conversations")),
        "op9_mixing": lambda s, d: mixing.mixture(table(s, d, "documents")),
        "op10_lm_scoring": lambda s, d: lm_scoring.pseudo_likelihood(table(s, d, "documents")),
        "op11_bpe": lambda s, d: bpe.digests(bpe.round_trip(table(s, d, "documents"))),
        "op12_variants": lambda s, d: variants.document_variants(table(s, d, "documents")),
        "op13_alignment": lambda s, d: alignment.align(table(s, d, "documents")),
    }


def oracle_sql() -> dict[str, str]:
    """Queries that SQL can express at the tables' size."""
    return {"op1_url_filter": url_filter.oracle(), "op2_topk": topk.oracle(), "op4_quality": quality.oracle(), "op8_quotes": quotes.oracle(), "op9_mixing": mixing.oracle()}
