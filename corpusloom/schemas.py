"""Declared schemas and their fingerprints."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql.types import StructType

DDL = {
    "row": "page INT, row_index INT, en_text STRING, ar_text STRING, en_all_bold BOOLEAN, ar_all_bold BOOLEAN, en_highlighted ARRAY<STRING>, ar_highlighted ARRAY<STRING>",
    "article": "article_number INT, text_en STRING, text_ar STRING, heading_path ARRAY<STRING>, heading_path_ar ARRAY<STRING>, source_pages ARRAY<INT>, "
    "source_rows ARRAY<STRUCT<page:INT,row_index:INT>>, is_repealed BOOLEAN, only_in_en ARRAY<STRING>, only_in_ar ARRAY<STRING>",
    "chunk": "chunk_id STRING, article_number INT, citation STRING, heading_path ARRAY<STRING>, heading_path_ar ARRAY<STRING>, source_pages ARRAY<INT>, is_repealed BOOLEAN, "
    "part_index INT, part_count INT, paragraphs ARRAY<INT>, text_ar STRING, text_en STRING, only_in_en ARRAY<STRING>, only_in_ar ARRAY<STRING>, strategy STRING, range_end INT",
    "question": "id STRING, question STRING, language STRING, register STRING, kind STRING, expected_articles ARRAY<INT>, supporting_articles ARRAY<INT>, match STRING, "
    "legal_basis STRING, difficulty STRING, pair_id STRING, translated_from STRING",
}


def schema(name: str) -> StructType:
    return StructType.fromDDL(DDL[name])


def fingerprint(fields: StructType) -> str:
    """12 hex digits of the sorted JSON schema without metadata."""
    plain = [{k: v for k, v in f.jsonValue().items() if k != "metadata"} for f in fields.fields]
    return hashlib.sha256(json.dumps(sorted(plain, key=lambda f: f["name"]), sort_keys=True).encode()).hexdigest()[:12]
