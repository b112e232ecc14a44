"""All queries of this package; importing the modules registers them."""

from . import bag_minhash, byte_bpe, exact_dedup, hilbert_search, ktreap_search, licenses, line_quality, packing, phrase_trees, pivot_index, separator_scan, substring_dedup, token_store  # noqa: F401
from .common import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
