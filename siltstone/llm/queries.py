"""The queries of this subpackage and their SQL, for __spark_entry__.py."""

from __future__ import annotations

from siltstone.llm import audit, neardup, resample, rules, substrings
from siltstone.llm.audit import op11_filter_audit
from siltstone.llm.bpe import op9_bpe_encode_decode
from siltstone.llm.idstore import op6_token_id_store
from siltstone.llm.jpeg import op10_jpeg_media
from siltstone.llm.mixing import op3_source_mixing
from siltstone.llm.neardup import op4_minhash_lsh_forest
from siltstone.llm.quality import op5_quality_classifier
from siltstone.llm.resample import op13_importance_resampling
from siltstone.llm.rules import op2_quality_rules
from siltstone.llm.substrings import op7_suffix_bucket_dedup
from siltstone.llm.tiered import op12_tiered_bpe
from siltstone.llm.toxicity import op8_toxicity
from siltstone.llm.unigram import op1_token_counts

QUERIES = {
    "op1_token_counts": op1_token_counts,
    "op2_quality_rules": op2_quality_rules,
    "op3_source_mixing": op3_source_mixing,
    "op4_minhash_lsh_forest": op4_minhash_lsh_forest,
    "op5_quality_classifier": op5_quality_classifier,
    "op6_token_id_store": op6_token_id_store,
    "op7_suffix_bucket_dedup": op7_suffix_bucket_dedup,
    "op8_toxicity": op8_toxicity,
    "op9_bpe_encode_decode": op9_bpe_encode_decode,
    "op10_jpeg_media": op10_jpeg_media,
    "op11_filter_audit": op11_filter_audit,
    "op12_tiered_bpe": op12_tiered_bpe,
    "op13_importance_resampling": op13_importance_resampling,
}

ORACLE: dict[str, str] = {
    "op2_quality_rules": rules.ORACLE,
    "op4_minhash_lsh_forest": neardup.ORACLE,
    "op7_suffix_bucket_dedup": substrings.ORACLE,
    "op11_filter_audit": audit.ORACLE,
    "op13_importance_resampling": resample.ORACLE,
}
