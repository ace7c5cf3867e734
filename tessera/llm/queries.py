"""Queries of this subpackage, and the SQL that gives the same rows where SQL can."""

from __future__ import annotations

from tessera.llm import bpe, chat, decontam, langid, media, neardup, periods, quality, repeats, search, shards, urls, warc


def queries() -> dict:
    return {
        "op1_media": media.query,
        "op2_neardup": neardup.query,
        "op3_repeats": repeats.query,
        "op4_chat": chat.query,
        "op5_warc": warc.query,
        "op6_urls": urls.query,
        "op7_bpe": bpe.query,
        "op8_decontamination": decontam.query,
        "op9_language": langid.query,
        "op10_quality": quality.query,
        "op11_periods": periods.query,
        "op12_search": search.query,
        "op13_shards": shards.query,
    }


def oracle_sql() -> dict[str, str]:
    return {"op4_chat": chat.sql(), "op5_warc": warc.sql(), "op6_urls": urls.sql(), "op12_search": search.sql(), "op13_shards": shards.sql()}
