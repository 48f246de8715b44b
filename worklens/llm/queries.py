"""All queries of the subpackage; importing this module registers them."""

from worklens.llm import chunk_dedup, decontamination, edit_fingerprint, hidden_markov, language, line_dedup, ngram_join, packing, prefix_trie, quality, simhash, token_files, vector_codes  # noqa: F401
from worklens.llm.registry import ORACLES, QUERIES  # noqa: F401
