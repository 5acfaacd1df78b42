"""Optional adapters: pages, words and table rows of PDF files, and table rows of Word files.

The libraries are imported where they are used, on the executors; without them an adapter says so. A file that cannot be
read gives one row with its error instead of failing the job.
"""

from __future__ import annotations

import io
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

PAGE_ROWS = "path string, page_number int, text string, width double, words array<struct<text:string,x0:double,x1:double,top:double,bottom:double>>, tables array<array<array<string>>>, error string"
DOCX_ROWS = "path string, table_no int, row_no int, cells array<string>, error string"


def pdf_pages(files: DataFrame) -> DataFrame:
    """Pages of (path, content) rows, with word boxes and raw tables: one scan for all three."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import pdfplumber

        for batch in batches:
            for path, content in zip(batch["path"], batch["content"], strict=True):
                rows = []
                try:
                    with pdfplumber.open(io.BytesIO(content)) as pdf:
                        for number, page in enumerate(pdf.pages, 1):
                            words = [{k: w[k] for k in ("text", "x0", "x1", "top", "bottom")} for w in page.extract_words(use_text_flow=True, keep_blank_chars=False)]
                            rows.append((path, number, page.extract_text() or "", float(page.width), words, page.extract_tables(), None))
                except Exception as error:  # noqa: BLE001  a broken file is a row, not a failed job
                    rows.append((path, None, None, None, None, None, str(error)))
                yield pd.DataFrame(rows, columns=[c.split()[0] for c in ("path", "page_number", "text", "width", "words", "tables", "error")])

    return files.select("path", "content").mapInPandas(read, PAGE_ROWS)


def docx_rows(files: DataFrame) -> DataFrame:
    """Rows of all tables of (path, content) rows, with white space in cells collapsed."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import docx

        for batch in batches:
            for path, content in zip(batch["path"], batch["content"], strict=True):
                rows = []
                try:
                    for t, table in enumerate(docx.Document(io.BytesIO(content)).tables):
                        rows += [(path, t, r, [" ".join(c.text.split()) for c in row.cells], None) for r, row in enumerate(table.rows)]
                except Exception as error:  # noqa: BLE001
                    rows.append((path, None, None, None, str(error)))
                yield pd.DataFrame(rows, columns=["path", "table_no", "row_no", "cells", "error"])

    return files.select("path", "content").mapInPandas(read, DOCX_ROWS)
