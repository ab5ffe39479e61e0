"""Schemas of the data model: posts, attachments, state, responses, sources."""

from __future__ import annotations

ATTACHMENT = "struct<filename:string,url:string,size:bigint>"
DETAIL = "struct<label:string,value:string>"
POST = f"source_key string, source_name string, post_id string, title string, url string, date string, body string, summary array<string>, details array<{DETAIL}>, attachments array<{ATTACHMENT}>, proposal_status string, page int, pos int"
STATE = "source_key string, seen array<string>, baselined boolean"
SOURCE = "key string, name string, type string, list_url string, enabled boolean, supports_enrich boolean, supports_pagination boolean, ord int"
RESPONSE = "struct<candidates:array<struct<content:struct<parts:array<struct<text:string>>>,finishReason:string>>>"
#: Kinds of outcome of a detail page.
AVAILABLE, PENDING, ERROR = "AVAILABLE", "PENDING", "ERROR"
#: Seen ids kept for a source.
SEEN_CAP = 5000
