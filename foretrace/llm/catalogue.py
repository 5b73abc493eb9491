"""All queries of this subpackage."""

from foretrace.llm import (  # noqa: F401
    alignment,
    decontaminate,
    filter_audit,
    near_dup,
    pieces,
    pii,
    quality,
    secrets,
    sharding,
    substrings,
    token_file,
    urls,
    warc,
)
from foretrace.llm.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
