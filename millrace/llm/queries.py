"""The subpackage's queries and their SQL."""

from __future__ import annotations

from millrace.llm import bitplanes, chat, minhash, mixing, packing, quality, sharding, simhash, suffixes, topk
from millrace.llm.common import Query

MODULES = (topk, bitplanes, simhash, mixing, suffixes, quality, sharding, chat, minhash, packing)


def queries() -> dict[str, Query]:
    return {k: v for m in MODULES for k, v in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: v for m in MODULES for k, v in m.ORACLES.items()}
