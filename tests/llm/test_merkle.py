"""The manifest against trees built in memory."""

import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from webloom.llm import merkle

SCHEMA = "text string, doc_id bigint, source string, lang string, n_chars bigint, tree string, place string, level string, way int"


def H(s):
    return hashlib.sha256(s.encode()).hexdigest()


def leaf(doc_id, source, lang, n_chars, text):
    return H("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc_id, source, lang, n_chars, text)))


def ways(run):
    """The root, and of each member its siblings on the way there."""
    out = [[] for _ in run]
    under = [[k] for k in range(len(run))]
    while len(run) > 1:
        for at, members in enumerate(under):
            low = at - at % 8
            for k in members:
                out[k].append(("".join(run[low:at]), "".join(run[at + 1 : low + 8])))
        under = [sum(under[k : k + 8], []) for k in range(0, len(run), 8)]
        run = [H("".join(run[k : k + 8])) for k in range(0, len(run), 8)]
    return run[0], out


def lower(text):
    return text if text is None else "".join(c.lower() if "A" <= c <= "Z" else c for c in text)


def brute(rows):
    """(doc_id, leaf, subroot, root, proof, folded, verified) of rows (doc_id, source, lang, n_chars, text)."""
    trees = {}
    for r in rows:
        changed = lower(r[4]) if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0 else r[4]
        trees.setdefault(r[2], []).append((r[0] is not None, r[0] or 0, leaf(*r), leaf(*r[:4], changed), r[0]))
    names = sorted(trees, key=lambda x: (x is not None, (x or "").encode()))
    found = {}
    for name in names:
        trees[name].sort(key=lambda x: x[:4])
        found[name] = ways([x[2] for x in trees[name]])
    root, over = ways([found[name][0] for name in names])
    out = []
    for i, name in enumerate(names):
        for (_, _, own, offered, doc_id), way in zip(trees[name], found[name][1], strict=True):
            way = [*way, *over[i]]
            at = offered
            for a, b in way:
                at = H(a + at + b)
            out.append((doc_id, own, found[name][0], root, H("".join(a + b for a, b in way)), at, at == root))
    return out


def table(spark, rows):
    return spark.createDataFrame([(t, k, s, lang, n, "clash", "clash", "clash", 1) for k, s, lang, n, t in rows], SCHEMA)


def audited(df):
    return [tuple(r) for r in merkle.audit(df, merkle.tampered(F.col("doc_id"), F.col("text"))).collect()]


def corpus(n, langs):
    return [(k * 7 % n, f"s{k % 3}", langs[k * k % len(langs)], k, f"Text {k} É") for k in range(n)]


@pytest.mark.parametrize(("n", "langs"), [(1, ["en"]), (9, ["en"]), (75, ["en", "de"]), (600, ["en", "en", None, "", "é", "z", "Z", "a", "b", "c", "d"])])
def test_trees(spark, n, langs):
    rows = corpus(n, langs)
    assert sorted(audited(table(spark, rows).repartition(5)), key=str) == sorted(brute(rows), key=str)


def test_odd_rows(spark):
    rows = [(None, None, None, None, None), (None, "s", "en", 0, ""), (3, "s", "en", None, "A"), (3, "s", "en", None, "A"), (3, "s", "en", None, None), (0, "s", "en", 1, "x" * 2_000_000 + "A"), (6, "s", "en", 1, None)]
    got = audited(table(spark, rows))
    assert sorted(got, key=str) == sorted(brute(rows), key=str)
    assert audited(table(spark, [])) == []


@pytest.mark.parametrize("steps", [1, 2])
def test_blocks_of_several_rounds(spark, steps):
    """Smaller blocks, so that trees take several rounds and end between and at their ends."""
    rows = corpus(700, ["en", "en", "en", "de", None]) + [(1000 + k, "s", "fr", k, "t") for k in range(64)]
    got = [tuple(r) for r in merkle.audit(table(spark, rows), merkle.tampered(F.col("doc_id"), F.col("text")), steps).collect()]
    assert sorted(got, key=str) == sorted(brute(rows), key=str)


def test_manifest(spark):
    rows = corpus(100, ["en", "de", None])
    want = {r[0]: r for r in brute(rows)}
    for r in merkle.manifest(table(spark, rows)).collect():
        assert (r.leaf, r.subroot, r.root, H("".join(x.left + x.right for x in r.way))) == want[r.doc_id][1:5]
