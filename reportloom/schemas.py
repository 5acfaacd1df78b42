"""Schemas of the tables that reports come in as."""

from __future__ import annotations

PAGES = "doc_id long, page_number int, text string, width double"
WORDS = "doc_id long, page_number int, word_no int, text string, x0 double, x1 double, top double, bottom double"
TABLE_ROWS = "doc_id long, page_number int, table_no int, row_no int, cells array<string>"
GLOSSARY = "en_norm string, zh_pref string, count int"
MEMORY = "source string, context string, en_raw string, zh_raw string, en_norm string, zh_norm string"
STYLE_RULES = "rules array<struct<pattern:string,replacement:string,flags:string>>"
TEMPLATES = "templates array<struct<id:string,name:string,filename:string,path:string,description:string,trf_patterns:array<string>,expected_clauses:array<string>,anchors:array<string>,signature:struct<table_count:int,paragraph_count:int,chapter_tables:array<string>,appendix_tables:array<string>,data_tables:array<string>>>>, default_template string"
