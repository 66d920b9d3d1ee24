"""String expressions, all evaluated inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: every character Python's str.strip() removes.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    + "".join(map(chr, range(0x2000, 0x200B)))
    + "\u2028\u2029\u202f\u205f\u3000"
)

URI_SCHEME = "gs://"
URI_PATTERN = r"(?s)^gs://([^/]*)/(.*)$"
STEM_AND_EXTENSION = r"(?s)^(.*/)?(\.*[^/.][^/]*?)(\.[^./]*)?$"


def strip_all(col) -> Column:
    """Strip all leading and trailing whitespace (``F.trim`` alone strips spaces only)."""
    return F.trim(col, F.lit(WHITESPACE))


def is_blank(col) -> Column:
    return F.coalesce(F.length(strip_all(col)), F.lit(0)) == 0


def object_uri(bucket, name) -> Column:
    return F.concat(F.lit(URI_SCHEME), bucket, F.lit("/"), name)


def uri_bucket(uri) -> Column:
    return F.regexp_extract(uri, URI_PATTERN, 1)


def uri_name(uri) -> Column:
    return F.regexp_extract(uri, URI_PATTERN, 2)


def uri_problem(uri) -> Column:
    """Why a URI cannot be split into bucket and name; null when it can."""
    return F.when(
        ~F.coalesce(F.col(uri).startswith(URI_SCHEME), F.lit(False)), F.lit("not a gs:// uri")
    ).when(~F.col(uri).rlike(URI_PATTERN), F.lit("missing object name"))


def file_name(name) -> Column:
    return F.substring_index(name, "/", -1)


def text_name(name) -> Column:
    """The same path with ``.txt`` in place of its extension."""
    return F.concat(F.regexp_replace(name, STEM_AND_EXTENSION, "$1$2"), F.lit(".txt"))


def page_label(page_number) -> Column:
    return F.coalesce(F.concat(F.lit("p."), page_number.cast("string")), F.lit("p.?"))


def document_key(uri) -> Column:
    """Deterministic document id, so that a replayed batch writes the same rows."""
    return F.sha2(uri, 256)


def chunk_key(document_id, chunk_index) -> Column:
    return F.sha2(F.concat_ws("#", document_id, chunk_index.cast("string")), 256)
