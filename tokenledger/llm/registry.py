"""The registered queries of the training-data operators and their DuckDB statements."""

from __future__ import annotations

from tokenledger.llm.chat import OP3_SQL, op3_chat_formatting
from tokenledger.llm.collocations import OP13_SQL, op13_collocation_mining
from tokenledger.llm.decontamination import op8_benchmark_decontamination
from tokenledger.llm.importance import op10_quality_classifier
from tokenledger.llm.language_id import op2_language_id
from tokenledger.llm.packing import op6_best_fit_packing
from tokenledger.llm.prefix_trie import OP12_SQL, op12_conversation_prefix_trie
from tokenledger.llm.repeats import op1_suffix_array_dedup
from tokenledger.llm.sharding import op9_sharding
from tokenledger.llm.simhash import op4_simhash_near_dedup
from tokenledger.llm.syncmers import op5_document_fingerprints
from tokenledger.llm.token_files import op7_token_files
from tokenledger.llm.top_products import OP11_SQL, op11_exact_top_k_search

QUERIES = {
    query.__name__: query
    for query in (
        op1_suffix_array_dedup,
        op2_language_id,
        op3_chat_formatting,
        op4_simhash_near_dedup,
        op5_document_fingerprints,
        op6_best_fit_packing,
        op7_token_files,
        op8_benchmark_decontamination,
        op9_sharding,
        op10_quality_classifier,
        op11_exact_top_k_search,
        op12_conversation_prefix_trie,
        op13_collocation_mining,
    )
}

ORACLES = {
    "op3_chat_formatting": OP3_SQL,
    "op11_exact_top_k_search": OP11_SQL,
    "op12_conversation_prefix_trie": OP12_SQL,
    "op13_collocation_mining": OP13_SQL,
}
