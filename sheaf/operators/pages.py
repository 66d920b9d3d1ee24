"""Documents to pages of text.

A document is one row, and its pages are an array inside that row, so page
numbering, page counts and the joined text need no shuffle.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sheaf.functions import text

FORM_FEED = "\f"


def raw_pages(content, separator: str = FORM_FEED) -> Column:
    """All pages of a text, blank ones included; a null text is one blank page."""
    return F.split(F.coalesce(content, F.lit("")), f"\\Q{separator}\\E")


def decoded_pages(content, page_fn: Callable[[bytes], list]) -> Column:
    """Pages of a binary object through a caller's function, one Arrow batch at a time.

    ``page_fn`` turns the bytes into a list whose entries are page texts, or
    callables giving them. A page that raises becomes blank; an object that
    raises as a whole gives null.
    """

    def one(data) -> list[str] | None:
        if data is None:
            return None
        try:
            entries = page_fn(data)
        except Exception:
            return None
        texts = []
        for entry in entries:
            try:
                texts.append((entry() if callable(entry) else entry) or "")
            except Exception:
                texts.append("")
        return texts

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield pa.array([one(value.as_py()) for value in batch], pa.list_(pa.string()))

    run.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(run, T.ArrayType(T.StringType()))(content)


def numbered_pages(pages) -> Column:
    """Stripped, non-blank pages that keep their original 1-based number."""
    numbered = F.transform(
        pages,
        lambda page, i: F.struct(
            (i + 1).cast("int").alias("page_number"),
            text.strip_all(F.coalesce(page, F.lit(""))).alias("text"),
        ),
    )
    return F.filter(numbered, lambda page: page["text"] != "")


def with_pages(documents: DataFrame, content_col: str, separator: str = FORM_FEED) -> DataFrame:
    """Add ``num_pages`` (all pages) and ``pages`` (array of numbered non-blank pages)."""
    pages = raw_pages(F.col(content_col), separator)
    return documents.withColumns({"num_pages": F.size(pages), "pages": numbered_pages(pages)})


def explode_pages(documents: DataFrame, *keys: str) -> DataFrame:
    exploded = F.explode_outer("pages").alias("page")  # outer: see chunks.explode_chunks
    return (
        documents.select(*keys, exploded)
        .filter(F.col("page").isNotNull())
        .select(*keys, "page.*")
    )


def joined_text(pages) -> Column:
    """Every page under a ``[page N]`` line, separated by blank lines."""
    return F.array_join(
        F.transform(
            pages,
            lambda page: F.concat(
                F.lit("[page "), page["page_number"].cast("string"), F.lit("]\n"), page["text"]
            ),
        ),
        "\n\n",
    )
