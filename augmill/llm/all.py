"""Import every operator so that its query registers."""

from . import bpe, decontaminate, divergence, html_text, jaccard, pieces, prefix_trie, quality, suffix_dedup, syncmers, token_counts, toxicity, warc  # noqa: F401
from .registry import ORACLE, QUERIES  # noqa: F401
