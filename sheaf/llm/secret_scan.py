"""Secret scans by a trigram inverted index (operator 9). DataFrame functions only.

From each rule's regular expression a Boolean trigram query is derived: a set of
alternatives, each a set of trigrams that any match contains in lower case. The inverted
index has an entry for every document and trigram that some rule asks for; alternatives are
answered by intersecting postings, and only the candidate documents are read again and
verified with the rule itself. A rule without mandatory trigrams (runs of hex digits)
scans every document; its rule is the only one that does.

Matches are leftmost and do not overlap within a rule. Their places follow from the lengths
of the matches and of what lies between them, in code points.

Defined results: a null or empty text has no spans. Rows are known by their place, not by their
id, so rows that repeat, that share an id or have none are each scanned by themselves. An empty
table gives no rows. Texts of any length are scanned whole. Other columns are ignored.
"""

from __future__ import annotations

import dataclasses
import itertools

from re import _constants as op
from re import _parser

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sheaf.llm.common import with_row_key
from sheaf.session import stored


@dataclasses.dataclass(frozen=True)
class Rule:
    """Matches of ``pattern`` whose group ``group`` has at least ``least`` characters."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1


# What the base rules must find.
BASE = (
    Rule(
        "assign",
        r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
        group=2,
        least=6,
    ),
    Rule("access", "AKIA[A-Z0-9]+", least=20),
    Rule("hex", "[0-9a-f]{24,}", least=24),  # the runs of 24 and more among all maximal runs
)
# Well-known public key formats, beyond the base.
FURTHER = (
    Rule("github", "gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", "xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", "AIza[A-Za-z0-9_-]{35}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("private", "-----BEGIN [A-Z ]*PRIVATE KEY-----"),
)
RULES = BASE + FURTHER


MOST = 64  # literal variants kept while a query is derived


def literals(pattern: str) -> list[list[str]]:
    """The alternatives of a pattern, each as the lower-case texts every match has in this order."""
    def joined(parts) -> list[list[str]]:
        """Variants as lists of pieces; "" within a list parts what need not be adjacent."""
        out = [[""]]
        for kind, value in parts:
            found = variants(kind, value)
            if len(out) * len(found) > MOST:
                found = [["", ""]]
            out = [[*a[:-1], a[-1] + b[0], *b[1:]] for a, b in itertools.product(out, found)]
        return out

    def variants(kind, value) -> list[list[str]]:
        if kind is op.LITERAL:
            return [[chr(value).lower()]]
        if kind is op.SUBPATTERN:
            return joined(value[3])
        if kind is op.BRANCH:
            return [variant for branch in value[1] for variant in joined(branch)]
        if kind is op.MAX_REPEAT:
            least, most, parts = value
            if most == 1 and least == 0:
                return [[""], *joined(parts)]
            if least == 0:
                return [["", ""]]
            once = joined(parts)
            return once if most == 1 else [[*variant, ""] for variant in once]
        if kind is op.IN and all(item[0] is op.LITERAL for item in value) and len(value) <= 8:
            return [[chr(item[1]).lower()] for item in value]
        return [["", ""]]

    return joined(_parser.parse(pattern))


def trigram_query(pattern: str) -> set[frozenset[str]] | None:
    """Alternatives, each a set of mandatory trigrams; None if some alternative has none."""
    out = set()
    for pieces in literals(pattern):
        grams = frozenset(piece[i : i + 3] for piece in pieces for i in range(len(piece) - 2))
        if not grams:
            return None
        out.add(grams)
    return {grams for grams in out if not any(other < grams for other in out)}


def spans(text: Column, rule: Rule) -> Column:
    """The rule's matches in ``text`` as an array of (start, end), end exclusive."""
    regex = F.lit(rule.pattern)
    between = F.transform(F.split(text, rule.pattern, -1), F.char_length)
    inside = F.transform(F.regexp_extract_all(text, regex, 0), F.char_length)
    measured = F.regexp_extract_all(text, regex, rule.group)
    starts = F.zip_with(between, inside, lambda gap, size: F.struct(gap.alias("gap"), F.coalesce(size, F.lit(0)).alias("size")))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("found"))
    walked = F.aggregate(
        starts,
        start,
        lambda state, x: F.struct(
            (state["at"] + x["gap"] + x["size"]).alias("at"),
            F.concat(
                state["found"],
                F.array(
                    F.struct(
                        (state["at"] + x["gap"]).alias("start"), (state["at"] + x["gap"] + x["size"]).alias("end")
                    )
                ),
            ).alias("found"),
        ),
    )["found"]
    return F.when(
        F.regexp_like(text, regex),
        F.filter(walked, lambda x, i: F.char_length(F.get(measured, i)) >= rule.least),
    )


def any_of(grams: list[str]) -> str:
    """A pattern that finds the trigrams at every place, also where they overlap."""
    def plain(text: str) -> str:
        return "".join(char if char.isalnum() else "\\" + char for char in text)

    by_first = itertools.groupby(sorted(grams), key=lambda gram: gram[0])
    ways = (f"{plain(first)}(?:{'|'.join(plain(gram[1:]) for gram in rest)})" for first, rest in by_first)
    return f"(?=({'|'.join(ways)}))"


def postings(docs: DataFrame, grams: list[str]) -> DataFrame:
    """The inverted index: trigram, row for the trigrams asked for. A text is read once for all of them."""
    found = F.regexp_extract_all(F.lower("text"), F.lit(any_of(grams)), 1)
    return docs.select("row", F.explode(F.array_distinct(found)).alias("trigram"))


def candidates(index: DataFrame, queries: dict[str, set[frozenset[str]]]) -> DataFrame:
    """kind, row: the documents whose postings satisfy a rule's query.

    An alternative is met where the number of its trigrams with a posting for the document
    is its size. Counting is by document and alternative, so a frequent trigram is no hot key.
    """
    wanted = [
        (kind, number, len(grams), gram)
        for kind, query in queries.items()
        for number, grams in enumerate(sorted(query, key=sorted))
        for gram in sorted(grams)
    ]
    table = index.sparkSession.createDataFrame(wanted, "kind string, number int, size int, trigram string")
    return (
        index.join(F.broadcast(table), "trigram")  # the rules' own trigrams
        .groupBy("row", "kind", "number", "size")
        .count()
        .filter("count = size")
        .select("kind", "row")
    )


def all_spans(text: Column, kinds: Column | None, rules: tuple[Rule, ...]) -> Column:
    """(start, rank of the kind, end) of the rules' matches; of those named in ``kinds`` if given."""
    found = []
    for rank, rule in rules:
        here = spans(text, rule)
        if kinds is not None:
            here = F.when(F.array_contains(kinds, rule.kind), here)
        found.append(
            F.transform(
                F.coalesce(here, F.array().cast("array<struct<start:int,end:int>>")),
                ranked(rank),
            )
        )
    return F.concat(*found)


def ranked(rank: int):
    return lambda x: F.struct(x["start"].alias("start"), F.lit(rank).alias("rank"), x["end"].alias("end"))


def of_rank(rank: int):
    return lambda x: x["rank"] == rank


def joined_spans(found: Column, rules: tuple[Rule, ...]) -> Column:
    kinds = F.array(*(F.lit(rule.kind) for rule in rules))
    text = F.transform(found, lambda x: F.concat_ws(":", F.get(kinds, x["rank"]), x["start"], x["end"]))
    return F.array_join(text, ",")


def scan(docs: DataFrame, rules: tuple[Rule, ...] = RULES, n_base: int = len(BASE)) -> DataFrame:
    """doc_id, n_<kind> of the base rules, base_sha256 and spans of every document."""
    queries = {rule.kind: trigram_query(rule.pattern) for rule in rules}
    indexed = {kind: query for kind, query in queries.items() if query}
    numbered = list(enumerate(rules))
    everywhere = [(i, rule) for i, rule in numbered if rule.kind not in indexed]
    chosen = [(i, rule) for i, rule in numbered if rule.kind in indexed]
    texts = with_row_key(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")), "row")

    empty = F.array().cast("array<struct<start:int,rank:int,end:int>>")
    found = all_spans(F.col("text"), None, everywhere) if everywhere else empty
    scanned = texts.select("row", "doc_id", found.alias("found"))
    grams = sorted(set().union(*(grams for query in indexed.values() for grams in query)))
    index = stored(postings(texts, grams), "postings")
    listed = candidates(index, indexed).groupBy("row").agg(F.collect_set("kind").alias("kinds"))  # kinds are few
    verified = texts.join(listed, "row").select("row", all_spans(F.col("text"), F.col("kinds"), chosen).alias("more"))
    found = F.array_sort(F.concat("found", F.coalesce("more", empty)))
    rows = scanned.join(verified, "row", "left").select("doc_id", found.alias("found"))
    base = F.filter("found", lambda x: x["rank"] < n_base)
    counts = [
        F.size(F.filter("found", of_rank(i))).cast("long").alias(f"n_{rule.kind}")
        for i, rule in enumerate(rules[:n_base])
    ]
    return rows.select(
        "doc_id",
        *counts,
        F.sha2(joined_spans(base, rules), 256).alias("base_sha256"),
        joined_spans(F.col("found"), rules).alias("spans"),
    )
