"""Collocations against brute force over every phrase."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from webloom.llm import collocations as C

SCHEMA = "doc_id bigint, text string, lang string, phrase string, f string, k string, n string"


def brute(rows, longest, least, first):
    counts = defaultdict(Counter)
    for text, lang in rows:
        small = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", small):
            w = re.findall("[^\x20\x09]+", piece)
            counts["und" if lang is None else lang].update(tuple(w[i : i + k]) for k in range(1, longest + 1) for i in range(len(w) - k + 1))
    out = []
    for lang, f in counts.items():
        n = sum(c for p, c in f.items() if len(p) == 1)
        often = {p: c for p, c in f.items() if len(p) > 1 and c >= least}
        inside = {p[i : i + k] for p, c in often.items() for k in range(2, len(p)) for i in range(len(p) - k + 1) if c >= often[p[i : i + k]]}
        found = []
        for p, a in often.items():
            if p not in inside:
                score, _, left, right = min((1000 * a * n // (f[p[:k]] * f[p[k:]]), k, f[p[:k]], f[p[k:]]) for k in range(1, len(p)))
                found.append((-score, -a, " ".join(p).encode(), left, right))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(found)[:first], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, n, -score))
    return sorted(out)


def mined(spark, rows, longest, least, first, **more):
    df = spark.createDataFrame([(k, t, lang, "clash", "clash", "clash", "clash") for k, (t, lang) in enumerate(rows)], SCHEMA).repartition(5)
    return sorted(tuple(r) for r in C.collocations(df, longest, least, first, **more).collect())


def corpus(seed):
    r = random.Random(seed)
    vocabulary = ["New", "york", "of", "The", "a", "été", "ÉTÉ", "x\x1cy", "日本"]
    text = lambda: "".join(r.choice(vocabulary) + r.choices([" ", "\t", "  ", ". ", "\n", "!", "\x0b,"], [30, 3, 3, 2, 2, 1, 1])[0] for _ in range(r.choice([0, 1, 5, 60])))
    rows = [(text(), r.choice(["en", "en", "de", None, "und", "", "a\tb"])) for _ in range(150)]
    return [*rows, *[("new york city hall of the", "en")] * 30, (None, "en"), ("", "xx"), (None, None), ("!!..", "en")]


@pytest.mark.parametrize(("seed", "longest", "least", "first"), [(1, 5, 8, 2000), (2, 3, 3, 7), (3, 2, 1, 2000)])
def test_collocations(spark, seed, longest, least, first):
    rows = corpus(seed)
    assert mined(spark, rows, longest, least, first) == brute(rows, longest, least, first)


def test_a_full_bitmap_changes_nothing(spark):
    rows = corpus(4)
    assert mined(spark, rows, 4, 5, 2000, filter_bits=C._CHUNK) == brute(rows, 4, 5, 2000)


def test_empty_table(spark):
    assert mined(spark, [], 5, 1, 10) == [] and mined(spark, [(None, None)], 5, 1, 10) == []


def test_long_texts(spark):
    """Texts of several stretches: no phrase is lost or counted twice where one ends, and words longer than a stretch are whole."""
    r = random.Random(5)
    long = "".join(r.choice(["alpha", "b", "gamma-delta"]) + r.choices([" ", "  ", "."], [50, 5, 1])[0] for _ in range(600_000))
    rows = [(long, "en"), ("x" * 2_500_000 + " b " + "y" * 1_200_000, "en"), ("alpha b", "en")]
    assert mined(spark, rows, 5, 50, 100) == brute(rows, 5, 50, 100)


def test_stretches_take_the_words_before_them(monkeypatch):
    monkeypatch.setattr(C, "STRETCH", 7)
    data = C._AS[np.frombuffer(b"aa bb cc dd. ee ff gg hh ii jj kk", np.uint8)]
    got = [(bytes(data[a:c]), b - a) for a, b, c in C._segments(data, 2)]
    assert b"".join(t[k:] for t, k in got) == bytes(data)
    assert all(len(re.findall(rb"[^ \n]+", t[:k])) <= 3 for t, k in got)
