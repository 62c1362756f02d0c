"""The queries of the operators, and the SQL of those that SQL can express."""

from __future__ import annotations

from keystrata.llm import bpe, fingerprint, langid, mixing, quality, sharding, simhash, substring, suffix, urls

LLM_QUERIES = {f.__name__: f for f in (bpe.op1_bpe, sharding.op2_sharding, simhash.op3_simhash, urls.op4_urls, substring.op5_substring, suffix.op6_suffix, mixing.op7_mixing, quality.op8_quality, langid.op9_langid, fingerprint.op10_fingerprint)}

LLM_ORACLES = {"op2_sharding": sharding.oracle(), "op4_urls": urls.oracle(), "op5_substring": substring.ORACLE, "op6_suffix": suffix.ORACLE, "op7_mixing": mixing.ORACLE}
