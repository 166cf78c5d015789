"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from lyrebird.llm import decontamination, jaccard, merkle, mixing, periodic, repeats
from lyrebird.llm.decontamination import op2_decontamination
from lyrebird.llm.extraction import op7_extraction
from lyrebird.llm.jaccard import op1_jaccard
from lyrebird.llm.merkle import op13_merkle
from lyrebird.llm.mixing import op3_source_mix
from lyrebird.llm.packing import op9_packed_ids
from lyrebird.llm.periodic import op11_runs
from lyrebird.llm.personal import op12_personal
from lyrebird.llm.quality import op4_quality
from lyrebird.llm.repeats import op8_repeated_passages
from lyrebird.llm.sharding import op6_kd_shards
from lyrebird.llm.telephony import op10_telephony
from lyrebird.llm.wordpieces import op5_token_counts


def queries() -> dict:
    return {
        "op1_jaccard": op1_jaccard,
        "op2_decontamination": op2_decontamination,
        "op3_source_mix": op3_source_mix,
        "op4_quality": op4_quality,
        "op5_token_counts": op5_token_counts,
        "op6_kd_shards": op6_kd_shards,
        "op7_extraction": op7_extraction,
        "op8_repeated_passages": op8_repeated_passages,
        "op9_packed_ids": op9_packed_ids,
        "op10_telephony": op10_telephony,
        "op11_runs": op11_runs,
        "op12_personal": op12_personal,
        "op13_merkle": op13_merkle,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_jaccard": jaccard.SQL,
        "op2_decontamination": decontamination.SQL,
        "op3_source_mix": mixing.SQL,
        "op8_repeated_passages": repeats.SQL,
        "op11_runs": periodic.SQL,
        "op13_merkle": merkle.SQL,
    }
