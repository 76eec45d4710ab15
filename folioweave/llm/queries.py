"""The registered queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import bpe, decontamination, filter_audit, media, mixing, pii, pu_quality, quality_rules, secrets, simhash, tandem_runs, tool_calls, warc

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_secret_scans": secrets.scan,
    "op2_simhash_near_dedup": simhash.scan,
    "op3_quality_rules": quality_rules.scan,
    "op4_chat_formatting": tool_calls.scan,
    "op5_quality_classifier": pu_quality.scan,
    "op6_warc": warc.scan,
    "op7_bpe": bpe.scan,
    "op8_mixing": mixing.scan,
    "op9_pii": pii.scan,
    "op10_media_columns": media.scan,
    "op11_benchmark_decontamination": decontamination.scan,
    "op12_periodic_runs": tandem_runs.scan,
    "op13_filter_audit": filter_audit.scan,
}

ORACLES: dict[str, str] = {
    "op1_secret_scans": secrets.ORACLE, "op9_pii": pii.ORACLE, "op4_chat_formatting": tool_calls.ORACLE, "op6_warc": warc.ORACLE, "op8_mixing": mixing.ORACLE,
    "op11_benchmark_decontamination": decontamination.ORACLE, "op13_filter_audit": filter_audit.ORACLE,
}
