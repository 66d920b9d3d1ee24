"""The Merkle manifest: log order, proofs, tampering, edge cases."""

import collections
import hashlib
import zlib

import pytest

from sheaf.llm import merkle_manifest as mm

COLUMNS = "doc_id long, source string, lang string, n_chars long, text string"


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def brute_leaf(row, add=0):
    doc_id, source, lang, n_chars, text = row
    fields = (doc_id, source, lang, None if n_chars is None else n_chars + add, text)
    return sha(*("-" if f is None else f"{len(str(f).encode())}:{f}" for f in fields))


def levels_of(leaves):
    out = [leaves]
    while len(out[-1]) > 1:
        out.append([sha(*out[-1][i : i + 2]) for i in range(0, len(out[-1]), 2)])
    return out


def way(levels, i):
    """(left, sibling) per level; None where a node is alone."""
    return [
        (i >> q & 1, level[i >> q ^ 1] if i >> q ^ 1 < len(level) else None) for q, level in enumerate(levels[:-1])
    ]


def brute(rows):
    by_lang = collections.defaultdict(list)
    for row in rows:
        by_lang[row[2]].append(row)
    langs = sorted(by_lang, key=lambda x: (x is not None, (x or "").encode()))
    trees = {}
    for lang in langs:
        by_lang[lang].sort(key=lambda r: (r[0] is not None, r[0] or 0, brute_leaf(r)))
        trees[lang] = levels_of([brute_leaf(r) for r in by_lang[lang]])
    roots = levels_of([trees[lang][-1][0] for lang in langs])
    out = []
    for place, lang in enumerate(langs):
        for i, row in enumerate(by_lang[lang]):
            steps = way(trees[lang], i) + way(roots, place)
            hit = row[0] is not None and zlib.crc32(str(row[0]).encode()) % 7 == 0
            digest = brute_leaf(row, int(hit))
            for left, sibling in steps:
                digest = sha(digest) if sibling is None else sha(sibling, digest) if left else sha(digest, sibling)
            proof = sha(*(sibling for _, sibling in steps if sibling is not None))
            root = roots[-1][0]
            out.append((row[0], brute_leaf(row), trees[lang][-1][0], root, proof, digest, digest == root))
    return out


def key(rows):
    return sorted(rows, key=repr)


def table(spark, rows):
    return spark.createDataFrame(rows, COLUMNS).selectExpr("*", "'x' AS tree", "1 AS idx", "2 AS row", "3 AS digest")


def test_manifest_against_brute_force(spark):
    rows = [(i, f"s{i % 3}", "en" if i % 3 else "fr", i, f"text {i} é") for i in range(150)]
    rows += [(1000 + i, "s", "en", 5, "copy") for i in range(75)]
    rows += [(2000, None, None, None, None), (2001, "", None, 0, ""), (7, "s", "en", 2**63 - 1, "x" * 100_000)]
    rows += [rows[3], rows[3], (None, "s", "en", 1, "no id"), (None, None, "", None, "empty lang"), (14, "a", "ß", None, "lone")]
    rows += [(3000 + i, "s", f"lang {i}", 1, "many langs") for i in range(21)]
    for bits in (2, 12):
        got = mm.manifest(table(spark, rows), mm.tampered_leaf(), bits=bits).collect()
        assert key(map(tuple, got)) == key(brute(rows))
    assert not all(r.verified for r in got) and any(r.verified for r in got)


@pytest.mark.parametrize("n", [1, 2, 3, 5, 8, 13])
def test_small_trees(spark, n):
    rows = [(i, "s", "en", i, str(i)) for i in range(n)]
    assert key(map(tuple, mm.manifest(table(spark, rows), mm.tampered_leaf(), bits=1).collect())) == key(brute(rows))


def test_untampered_rows_verify_and_empty_table(spark):
    rows = [(i, "s", "en", i, str(i)) for i in range(20)]
    assert all(r.verified for r in mm.manifest(table(spark, rows), bits=3).collect())
    assert mm.manifest(table(spark, rows).limit(0)).collect() == []


def test_log_is_the_postorder(spark, tmp_path):
    """Positions have no gaps, children come before parents, and all builders write in order."""
    for n in (1, 6, 21, 64):
        path = f"{tmp_path}/{n}"
        rows = mm.numbered(mm.leaves(table(spark, [(i, "s", "en", i, str(i)) for i in range(n)])), "doc_id")
        levels = mm.build(rows, path, bits=2)
        log = sorted(mm.entries(spark, path, levels, bits=2).collect(), key=lambda r: r.pos)
        assert [r.pos for r in log] == list(range(len(log)))
        want = []

        def visit(level, i):
            for child in (2 * i, 2 * i + 1):
                if level and child << (level - 1) < n:
                    visit(level - 1, child)
            want.append((level, i))

        visit(mm.height(n), 0)
        assert [(r.level, r.idx) for r in log] == want
        place = {(r.level, r.idx): r for r in log}
        for (level, i), r in place.items():
            children = [place[level - 1, c].digest for c in (2 * i, 2 * i + 1) if (level - 1, c) in place]
            assert not level or r.digest == mm.parent(*children)
