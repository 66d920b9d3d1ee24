"""Pages and chunks as table functions for SQL, called with LATERAL.

    SELECT d.document_id, p.* FROM documents d, LATERAL split_pages(d.content, '\\f') p
    SELECT d.document_id, c.* FROM documents d, LATERAL recursive_chunks(d.content, 2000, 300) c

Rows travel in Arrow batches. The functions give the rows of the DataFrame forms in ``operators``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from sheaf.operators.chunks import recursive_spans


def page_function(page_fn: Callable[[bytes], list] | None = None):
    """``split_pages(content, separator)``: the pages with text, by their 1-based number.

    With ``page_fn``, ``content`` is handed to it instead of being cut; its entries are texts or
    callables that give them. A page that raises is blank, an object that raises has no page.
    """

    class SplitPages:
        def eval(self, content, separator: str) -> Iterator[tuple[int, str]]:
            for number, entry in enumerate(entries(content, separator), start=1):
                try:
                    page = ((entry() if callable(entry) else entry) or "").strip()
                except Exception:
                    page = ""
                if page:
                    yield number, page

    def entries(content, separator: str) -> list:
        if content is None:
            return []
        if page_fn is None:
            return content.split(separator)
        try:
            return page_fn(content)
        except Exception:
            return []

    return F.udtf(SplitPages, returnType="page_number int, text string", useArrow=True)


def chunk_function():
    """``recursive_chunks(page, size, overlap)``: the chunks of a page, numbered from 0."""

    class RecursiveChunks:
        def eval(self, page: str, size: int, overlap: int) -> Iterator[tuple[int, str]]:
            if not page or not page.strip():
                return
            page, index = page.strip(), 0
            spans = recursive_spans(page, size, overlap) if len(page) > size else [(0, len(page))]
            for start, end in spans:
                piece = page[start:end].strip()
                if piece:
                    yield index, piece
                    index += 1

    return F.udtf(RecursiveChunks, returnType="chunk_index int, content string", useArrow=True)


def register(spark: SparkSession, page_fn: Callable[[bytes], list] | None = None) -> None:
    spark.udtf.register("split_pages", page_function(page_fn))
    spark.udtf.register("recursive_chunks", chunk_function())
