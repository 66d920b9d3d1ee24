"""Term normalisation shared by postings, web-style questions and hashed vectors."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WORD = r"[\p{L}\p{M}\p{N}]+"

# The usual English stop words.
STOP_WORDS = tuple(
    """
    i me my myself we our ours ourselves you your yours yourself yourselves he him his himself
    she her hers herself it its itself they them their theirs themselves what which who whom
    this that these those am is are was were be been being have has had having do does did
    doing a an the and but if or because as until while of at by for with about against between
    into through during before after above below to from up down in out on off over under again
    further then once here there when where why how all any both each few more most other some
    such no nor not only own same so than too very s t can will just don should now
    """.split()
)


def words(text) -> Column:
    """Lower-cased runs of letters, marks and digits, in text order."""
    return F.regexp_extract_all(F.lower(text), F.lit(WORD), 0)


def stem(term: Column) -> Column:
    """Harman's S-stemmer: the first ending that applies decides."""
    size = F.length(term)
    plural_y = term.endswith("ies") & ~term.endswith("eies") & ~term.endswith("aies")
    plural_e = (
        term.endswith("es")
        & ~term.endswith("aes")
        & ~term.endswith("ees")
        & ~term.endswith("oes")
    )
    plural = term.endswith("s") & ~term.endswith("us") & ~term.endswith("ss")
    return (
        F.when(plural_y, F.concat(F.substring(term, F.lit(1), size - 3), F.lit("y")))
        .when(plural_e, F.substring(term, F.lit(1), size - 1))
        .when(plural, F.substring(term, F.lit(1), size - 1))
        .otherwise(term)
    )


def stem_word(word: str) -> str:
    """The same rule for a Python string, for code that runs inside Arrow batches."""
    if word.endswith("ies") and word[-4:-3] not in ("e", "a"):
        return word[:-3] + "y"
    if word.endswith("es") and word[-3:-2] not in ("a", "e", "o"):
        return word[:-1]
    if word.endswith("s") and word[-2:-1] not in ("u", "s"):
        return word[:-1]
    return word


def is_stop_word(term: Column) -> Column:
    return term.isin(*STOP_WORDS)
