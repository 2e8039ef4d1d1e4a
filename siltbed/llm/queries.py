"""The registered queries of this subpackage and their SQL, by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from siltbed.llm.decontaminate import OP6_SQL, op6_decontamination
from siltbed.llm.language import op7_language
from siltbed.llm.merkle import OP2_SQL, op2_fixity
from siltbed.llm.packing import op10_packing
from siltbed.llm.pii import OP3_SQL, op3_personal_data
from siltbed.llm.quality import OP1_SQL, op1_quality
from siltbed.llm.secrets import OP8_SQL, op8_secrets
from siltbed.llm.simhash import OP5_SQL, op5_simhash
from siltbed.llm.substring_dedup import OP9_SQL, op9_substring_dedup
from siltbed.llm.tokens import op4_token_ids

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality": op1_quality,
    "op2_fixity": op2_fixity,
    "op3_personal_data": op3_personal_data,
    "op4_token_ids": op4_token_ids,
    "op5_simhash": op5_simhash,
    "op6_decontamination": op6_decontamination,
    "op7_language": op7_language,
    "op8_secrets": op8_secrets,
    "op9_substring_dedup": op9_substring_dedup,
    "op10_packing": op10_packing,
}

ORACLES: dict[str, str] = {
    "op1_quality": OP1_SQL,
    "op2_fixity": OP2_SQL,
    "op3_personal_data": OP3_SQL,
    "op5_simhash": OP5_SQL,
    "op6_decontamination": OP6_SQL,
    "op8_secrets": OP8_SQL,
    "op9_substring_dedup": OP9_SQL,
}
