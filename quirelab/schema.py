"""Schemas of the tables, for reads without inference."""

from __future__ import annotations

LINE_RECORD = "line_id bigint, page string, folio string, quire string, line_number int, tokens array<string>, raw_text string, transcription_source string, recorded_at timestamp_ntz, loaded_at timestamp_ntz"
RAW_LINE = "page_id string, line_number int, text string, text_clean string, quire string, source string"
PAGE = "page_id string, folio_id string, quire_id string, section_value string, illustration_type string"
FOLIO = "folio_id string, quire_id string, section_value string"
QUIRE = "quire_id string, folio_ids array<string>"
COORDINATE = "token_id string, page string, line string, x string, y string, width string, height string"
MISMATCH = "page_id string, line_number int, zl_text string, it_text string, cd_text string, fg_text string, gc_text string, eva_agreement boolean, similarity_score double, sources_present array<string>, sources_missing array<string>"
SOURCE_STATUS = "name string, source_type string, repo_id string, config string, status string, row_count bigint, schema map<string,string>, sha256 string, error string"
SIGNATURE = "field string, value double"
INTERVALS = "field string, observed double, bootstrap_mean double, sd double, lower double, upper double"
MANIFEST = "fold int, quires array<string>, n_rows bigint"
HYPOTHESIS = "id string, status string, threshold string, description string"
