from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sheaf.operators import chunks, pages
from sheaf.settings import ChunkKnobs


def brute_force_split(text, size, overlap, separators=("\n\n", "\n", ". ", " ", "")):
    """The splitter's contract on plain strings: split, keep separators in front, fill, recurse."""
    level = next(i for i, s in enumerate(separators) if s == "" or s in text)
    separator, finer = separators[level], separators[level + 1 :]
    if separator:
        parts = text.split(separator)
        pieces = [p for p in [parts[0]] + [separator + p for p in parts[1:]] if p]
    else:
        pieces = list(text)
    out, small = [], []
    for piece in pieces + [None]:
        if piece is not None and (len(piece) < size or not finer and not separator):
            small.append(piece)
            continue
        window = []
        for p in small:
            if sum(map(len, window)) + len(p) > size and window:
                out.append("".join(window))
                while sum(map(len, window)) > overlap or (
                    window and sum(map(len, window)) + len(p) > size
                ):
                    window.pop(0)
            window.append(p)
        if window:
            out.append("".join(window))
        small = []
        if piece is not None:
            out += brute_force_split(piece, size, overlap, finer)
    return [c.strip() for c in out if c.strip()]


texts = st.text(alphabet="ab. \nc", max_size=120)


@given(texts, st.integers(2, 30), st.integers(0, 10))
@settings(max_examples=400, deadline=None)
def test_recursive_spans_match_brute_force(text, size, overlap):
    overlap = min(overlap, size - 1)
    spans = chunks.recursive_spans(text, size, overlap)
    got = [text[a:b].strip() for a, b in spans if text[a:b].strip()]
    assert got == brute_force_split(text, size, overlap)
    assert all(b - a <= size for a, b in spans)
    covered = set().union(*[range(a, b) for a, b in spans]) if spans else set()
    assert covered == set(range(len(text)))


def chunked(spark, rows, piece_fn, knobs, separator="\f"):
    frame = spark.createDataFrame(rows, "id string, body string")
    frame = pages.with_pages(frame, "body", separator)
    frame = frame.withColumn("pieces", piece_fn(F.col("pages"), knobs))
    return chunks.explode_chunks(frame, "id").orderBy("id", "chunk_index").collect()


def test_recursive_chunks_of_documents(spark):
    knobs = ChunkKnobs(20, 5)
    body = "Short page.\f   \fA longer page with words. And one more sentence here.\fxxxxxxxxxxxxxxxxxxxxxxxxxxxx"
    rows = chunked(spark, [("d", body), ("e", "tiny"), ("f", " \f ")], chunks.recursive_pieces, knobs)
    expected = [
        (number, piece)
        for number, page in enumerate(body.split("\f"), start=1)
        if page.strip()
        for piece in brute_force_split(page.strip(), 20, 5)
    ]
    mine = [r for r in rows if r.id == "d"]
    assert [(r.page_number, r.content) for r in mine] == expected
    assert [r.chunk_index for r in mine] == list(range(len(expected)))
    assert [(r.chunk_index, r.content) for r in rows if r.id == "e"] == [(0, "tiny")]
    assert not [r for r in rows if r.id == "f"]


def test_stride_equals_recursion_without_break_points(spark):
    knobs = ChunkKnobs(10, 3)
    for n in (1, 3, 9, 10, 11, 17, 18, 40):
        rows = chunked(spark, [("d", "x" * n)], chunks.stride_pieces, knobs)
        assert [r.content for r in rows] == brute_force_split("x" * n, 10, 3)


def test_pages_keep_their_numbers(spark):
    frame = spark.createDataFrame([("d", " one \f\f\tthree\n"), ("n", None)], "id string, body string")
    rows = {r.id: r for r in pages.with_pages(frame, "body").collect()}
    assert rows["d"].num_pages == 3 and rows["n"].num_pages == 1
    assert [(p.page_number, p.text) for p in rows["d"].pages] == [(1, "one"), (3, "three")]
    assert rows["n"].pages == []
    joined = pages.with_pages(frame, "body").select("id", pages.joined_text(F.col("pages")).alias("t"))
    texts_by_id = {r.id: r.t for r in joined.collect()}
    assert texts_by_id == {"d": "[page 1]\none\n\n[page 3]\nthree", "n": ""}


def test_page_function_survives_bad_pages(spark):
    def bad():
        raise ValueError("page")

    def page_fn(data):
        if data == b"broken":
            raise ValueError("object")
        return [data.decode(), bad, None, lambda: "lazy"]

    frame = spark.createDataFrame([("a", b"x"), ("b", b"broken")], "id string, body binary")
    rows = {r.id: r.p for r in frame.select("id", pages.decoded_pages(F.col("body"), page_fn).alias("p")).collect()}
    assert rows == {"a": ["x", "", "", "lazy"], "b": None}


def test_number_pieces_across_pages(spark):
    rows = [("d", 2, 0, "c"), ("d", 1, 1, " \t"), ("d", 1, 2, "b"), ("d", 1, 0, "a "), ("e", 5, 9, "z")]
    frame = spark.createDataFrame(rows, "document_id string, page_number int, piece_no int, content string")
    got = {(r.document_id, r.chunk_index): r.content for r in chunks.number_pieces(frame).collect()}
    assert got == {("d", 0): "a", ("d", 1): "b", ("d", 2): "c", ("e", 0): "z"}
