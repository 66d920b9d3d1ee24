"""Pages to overlapping character chunks.

Both splitters work on the page array of one document row and give an array of
``(page_number, content)``. Its order is the document-wide chunk order, so
``posexplode`` numbers the chunks and nothing is shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sheaf.functions import text
from sheaf.schemas import PIECE
from sheaf.settings import ChunkKnobs

# Break points, coarsest first. Past the last one any character is.
SEPARATORS = ("\n\n", "\n", ". ", " ")


def stride_pieces(pages, knobs: ChunkKnobs = ChunkKnobs()) -> Column:
    """Fixed windows of ``size`` characters that share ``overlap`` characters."""
    step = knobs.size - knobs.overlap

    def windows(page):
        last = F.greatest(
            F.lit(0),
            F.ceil((F.length(page["text"]) - F.lit(knobs.overlap)) / F.lit(float(step))).cast("int")
            - 1,
        )
        return F.transform(
            F.sequence(F.lit(0), last),
            lambda i: F.struct(
                page["page_number"].alias("page_number"),
                text.strip_all(
                    F.substring(page["text"], i * step + 1, F.lit(knobs.size))
                ).alias("content"),
            ),
        )

    return _without_blanks(F.flatten(F.transform(pages, windows)))


def recursive_pieces(pages, knobs: ChunkKnobs = ChunkKnobs()) -> Column:
    """Chunks that end at the coarsest break point that fits.

    A page of at most ``size`` characters is one chunk and stays in the JVM. Only
    documents with a longer page go through the Arrow function.
    """
    has_long_page = F.exists(pages, lambda page: F.length(page["text"]) > knobs.size)
    whole_pages = F.transform(
        pages,
        lambda page: F.struct(
            page["page_number"].alias("page_number"), text.strip_all(page["text"]).alias("content")
        ),
    )
    split = _split_udf(knobs)(F.when(has_long_page, pages))
    return _without_blanks(F.when(has_long_page, split).otherwise(whole_pages))


def _without_blanks(pieces) -> Column:
    return F.filter(pieces, lambda piece: piece["content"] != "")


def _split_udf(knobs: ChunkKnobs):
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        arrow_type = pa.list_(pa.struct([("page_number", pa.int32()), ("content", pa.string())]))
        for batch in batches:
            rows = [
                None
                if pages is None
                else [
                    {"page_number": page["page_number"], "content": page["text"][start:end].strip()}
                    for page in pages
                    for start, end in recursive_spans(page["text"], knobs.size, knobs.overlap)
                ]
                for pages in batch.to_pylist()
            ]
            yield pa.array(rows, arrow_type)

    run.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(run, T.ArrayType(PIECE))


def recursive_spans(page: str, size: int, overlap: int) -> list[tuple[int, int]]:
    """The chunks of one page as ``(start, end)`` offsets, before stripping."""
    return _spans(page, 0, len(page), 0, size, overlap)


def _spans(page, start, end, level, size, overlap):
    while level < len(SEPARATORS) and page.find(SEPARATORS[level], start, end) < 0:
        level += 1
    if level == len(SEPARATORS):
        return _pack(range(start, end + 1), size, overlap)
    spans, run = [], []
    cuts = _cuts(page, start, end, SEPARATORS[level])
    for left, right in zip(cuts, cuts[1:]):
        if right - left < size:
            run = run or [left]
            run.append(right)
            continue
        spans += _pack(run, size, overlap)
        run = []
        spans += _spans(page, left, right, level + 1, size, overlap)
    return spans + _pack(run, size, overlap)


def _cuts(page, start, end, separator):
    """Offsets around the pieces; a separator belongs to the piece that follows it."""
    cuts, at = [start], page.find(separator, start, end)
    while at >= 0:
        if at > cuts[-1]:
            cuts.append(at)
        at = page.find(separator, at + len(separator), end)
    return cuts + [end]


def _pack(cuts, size, overlap):
    """Fill chunks with the adjacent pieces between ``cuts``, up to ``size`` characters.

    The next chunk starts at the first cut that leaves at most ``overlap``
    characters of the last one and room for the next piece.
    """
    if len(cuts) < 2:
        return []
    spans, first = [], 0
    for i in range(1, len(cuts)):
        if cuts[i] - cuts[first] > size and i - 1 > first:
            spans.append((cuts[first], cuts[i - 1]))
            while cuts[i - 1] - cuts[first] > overlap or (
                cuts[i] - cuts[first] > size and first < i - 1
            ):
                first += 1
    spans.append((cuts[first], cuts[-1]))
    return spans


def explode_chunks(documents: DataFrame, *keys: str) -> DataFrame:
    """One row per entry of ``pieces``, with its 0-based document-wide ``chunk_index``.

    The outer explode keeps Spark from testing the size of ``pieces`` in a filter of
    its own, which would compute them twice.
    """
    exploded = F.posexplode_outer("pieces").alias("chunk_index", "piece")
    return (
        documents.select(*keys, exploded)
        .filter(F.col("chunk_index").isNotNull())
        .select(*keys, "chunk_index", "piece.*")
    )


def number_pieces(pieces: DataFrame) -> DataFrame:
    """Number pieces that arrive as rows ``(document_id, page_number, piece_no, content)``.

    Blank pieces go first, so the index counts survivors only. Rows are ordered
    inside their page, and a page starts where the running count of the pages
    before it ends; no task has to hold a whole document.
    """
    page = ["document_id", "page_number"]
    kept = pieces.withColumn("content", text.strip_all("content")).filter(F.col("content") != "")
    before = Window.partitionBy("document_id").orderBy("page_number")
    starts = (
        kept.groupBy(*page)
        .agg(F.count("*").alias("n"))
        .withColumn("start", F.sum("n").over(before) - F.col("n"))
        .drop("n")
    )
    in_page = F.row_number().over(Window.partitionBy(*page).orderBy("piece_no"))
    return (
        kept.withColumn("in_page", in_page)
        .join(starts, page)
        .withColumn("chunk_index", (F.col("start") + F.col("in_page") - 1).cast("int"))
        .drop("start", "in_page")
    )
