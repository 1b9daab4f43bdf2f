"""Substring dedup, line dedup and the n-gram join against brute force."""

import random
import re

import pytest
from pyspark.sql import functions as F

from webloom.llm import line_dedup, ngram_join, substring_dedup
from webloom.llm.components import components

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def documents(spark, texts, first=0):
    return spark.createDataFrame([(first + k, t, "en", "s", len(t or "")) for k, t in enumerate(texts)], SCHEMA)


def corpus(seed, n=60):
    r = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(40)] + ["é", "Ω x", "日本"]
    texts = [" ".join(r.choices(vocabulary, k=r.choice([0, 3, 12, 13, 14, 40, 120]))) for _ in range(n)]
    passage = " ".join(r.choices(vocabulary, k=30))
    for k in range(0, n, 7):
        words = texts[k].split(" ")
        at = r.randrange(len(words))
        texts[k] = " ".join([*words[:at], *passage.split(" ")[r.randrange(10) :], *words[at:]])
    return [*texts, texts[0], texts[7] + "\n\t" + texts[14], None, "", " \n ", passage]


def brute_substrings(rows, width=13):
    words = {k: WORD.findall(t or "") for k, t in rows}
    first = {}
    for k in sorted(words):
        for i in range(len(words[k]) - width + 1):
            first.setdefault(tuple(words[k][i : i + width]), k)
    out = {}
    for k, w in words.items():
        gone = {j for i in range(len(w) - width + 1) if first[tuple(w[i : i + width])] < k for j in range(i, i + width)}
        kept = [x for i, x in enumerate(w) if i not in gone]
        out[k] = (len(w), len(gone), " ".join(kept))
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_substrings(spark, seed):
    rows = list(enumerate(corpus(seed)))
    got = substring_dedup.substring_dedup(documents(spark, [t for _, t in rows]).repartition(5)).collect()
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_text) for r in got} == brute_substrings(rows)


def test_substrings_odd_rows(spark):
    passage = " ".join(f"p{k}" for k in range(20))
    df = spark.createDataFrame([(None, passage), (1, passage), (1, passage), (2, "x " + passage), (3, None)], "doc_id bigint, text string").withColumn("payload", F.lit(1)).withColumn("kept_text", F.lit("z"))
    got = sorted(((r.doc_id if r.doc_id is not None else -1), r.n_words, r.n_removed) for r in substring_dedup.substring_dedup(df).collect())
    assert got == [(-1, 20, 0), (1, 20, 0), (1, 20, 0), (2, 21, 20), (3, 0, 0)]
    assert substring_dedup.substring_dedup(df.limit(0)).count() == 0
    with pytest.raises(ValueError):
        substring_dedup.substring_dedup(df, 12)


def shingles(text):
    w = WORD.findall(re.sub("[A-Z]+", lambda m: m[0].lower(), text or ""))
    return {" ".join(w[i : i + 3]) for i in range(len(w) - 2)} if len(w) >= 3 else {" ".join(w)} if w else set()


def brute_components(rows):
    sets = {k: shingles(t) for k, t in rows}
    root = {k: k for k in sets}

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 90 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {k: (len(sets[k]), find(k)) for k in ids}


def near_copies(seed, groups=6, copies=12):
    r = random.Random(seed)
    texts = []
    for g in range(groups):
        base = [f"g{g}x{r.randrange(300)}" for _ in range(r.choice([5, 12, 30, 60, 130, 260]))]
        for _ in range(copies):
            words = list(base)
            for _ in range(r.choice([0, 0, 1, 1, 2, 3, 5])):
                words[r.randrange(len(words))] = f"n{r.randrange(10**6)}"
            texts.append(" ".join(words).upper() if r.random() < 0.2 else " ".join(words))
    return [*texts, None, "", "one two", "One  TWO", "one"]


@pytest.mark.parametrize("seed", [1, 2])
def test_ngram_classes(spark, seed):
    rows = list(enumerate(near_copies(seed)))
    got = ngram_join.ngram_classes(documents(spark, [t for _, t in rows]).repartition(5)).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute_components(rows)


def test_large_families_are_cut_into_blocks(spark, monkeypatch):
    """With small row blocks the largest component's rest is held against every block."""
    monkeypatch.setattr(ngram_join, "BLOCK", 4)
    rows = list(enumerate(near_copies(3, groups=3, copies=30)))
    got = ngram_join.ngram_classes(documents(spark, [t for _, t in rows])).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute_components(rows)


def test_pipeline_drops_near_copies_by_five_words(spark):
    """The pipeline's stage takes 5-word shingles and 80 of 100; 3 words and 90 of 100 would keep other documents."""
    import corpus_pipeline

    base = [f"b{k}" for k in range(60)]
    spread = [*base[:20], "x", *base[21:40], "y", *base[41:]]  # 46 of 66 five-word shingles, so it stays
    once = [*base[:30], "z", *base[31:]]  # 51 of 61 with five words, 55 of 61 with three
    ends = ["p", "q", *base[2:58], "r", "s"]  # 52 of 60 with five words, 54 of 62 with three
    rows = list(enumerate(" ".join(w) for w in (base, spread, once, ends)))
    out = corpus_pipeline.one_of_near_copies(spark, documents(spark, [t for _, t in rows]), "")
    assert sorted(x.doc_id for x in out.collect()) == [0, 1]
    rows = list(enumerate(near_copies(4)))
    sets = {}
    for k, t in rows:
        w = WORD.findall((t or "").lower())
        sets[k] = {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()
    root = {k: k for k in sets}
    links = [(a, b) for a in sets for b in sets if sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    for _ in sets:
        for a, b in links:
            root[a] = root[b] = min(root[a], root[b])
    out = corpus_pipeline.one_of_near_copies(spark, documents(spark, [t for _, t in rows]).repartition(5), "")
    assert sorted(x.doc_id for x in out.collect()) == sorted(k for k in root if root[k] == k)


def test_ngram_odd_rows(spark):
    text = " ".join(f"a{k}" for k in range(30))
    df = spark.createDataFrame([(None, text), (5, text), (5, text), (7, text), (9, None)], "doc_id bigint, text string").withColumn("label", F.lit(1)).withColumn("side", F.lit(2))
    got = sorted((r.doc_id if r.doc_id is not None else -1, r.n_shingles, r.component_id) for r in ngram_join.ngram_classes(df).collect() if r.doc_id is not None)
    assert got == [(5, 28, 5), (5, 28, 5), (7, 28, 5), (9, 0, 9)]
    assert [r.component_id for r in ngram_join.ngram_classes(df).where("doc_id IS NULL").collect()] == [None]
    assert ngram_join.ngram_classes(df.limit(0)).count() == 0


def brute_lines(rows):
    lines = [(k, i, WORD.findall(x)) for k, t in rows if t is not None for i, x in enumerate(t.split("\n"))]
    first = {}
    for k, i, w in sorted(lines, key=lambda x: x[:2]):
        if w:
            first.setdefault(tuple(w), (k, i))

    def near(a, b):
        if abs(len(a) - len(b)) > 1 or min(len(a), len(b)) < 8:
            return False
        n = min(len(a), len(b))
        head = next((i for i in range(n) if a[i] != b[i]), n)
        tail = next((i for i in range(n) if a[-1 - i] != b[-1 - i]), n)
        return head + tail >= max(len(a), len(b)) - 1

    best = {a: min([p, *(q for b, q in first.items() if near(a, b))]) for a, p in first.items()}
    gone = {(k, i) for k, i, w in lines if w and best[tuple(w)] < (k, i)}
    return {k: None if t is None else "\n".join(x for i, x in enumerate(t.split("\n")) if (k, i) not in gone) for k, t in rows}


@pytest.mark.parametrize("seed", [1, 2])
def test_lines(spark, seed):
    r = random.Random(seed)
    base = [[f"v{r.randrange(12)}" for _ in range(r.choice([1, 2, 3, 7, 8, 9, 15, 16, 17, 33]))] for _ in range(12)]
    texts = []
    for _ in range(40):
        lines = []
        for _ in range(r.randrange(6)):
            words = list(r.choice(base))
            for _ in range(r.choice([0, 0, 1, 1, 2])):
                at = r.randrange(len(words))
                words[at : at + r.randrange(2)] = [f"v{r.randrange(12)}"] * r.randrange(2)
                words = words or ["v"]
            lines.append(r.choice([" ", "  ", "\t"]).join(words))
        texts.append("\n".join(lines))
    rows = list(enumerate([*texts, None, "", "\n\n", "  "]))
    got = line_dedup.line_dedup(documents(spark, [t for _, t in rows]).repartition(3))
    assert got.columns == [*documents(spark, []).columns, "n_lines", "n_removed"]
    assert {x.doc_id: x.text for x in got.collect()} == brute_lines(rows)


def test_lines_of_the_same_word_pairs(spark):
    """Variants that hold the same neighbouring words in another order are told apart."""
    texts = [
        "we saw the cat and the dog and the cow today", "we saw the dog and the cat and the cow again today", "we saw the dog and the cat and the cow today",
        "| x | y | z | w |", "| z | x | w | y |", "| z | x | w | y | q", "a b " * 300 + "c", "a b " * 299 + "b a c", "a b " * 299 + "b c",
    ]
    rows = list(enumerate(texts))
    assert {x.doc_id: x.text for x in line_dedup.line_dedup(documents(spark, texts)).collect()} == brute_lines(rows)


def test_lines_odd_rows(spark):
    line = "one two three four five six seven eight nine"
    df = spark.createDataFrame([(None, line), (1, line), (2, line), (2, f"{line}\nx"), (3, line.replace("four", "4"))], "doc_id bigint, text string").withColumn("_gone", F.lit("kept")).withColumn("first", F.lit(1)).withColumn("n_lines", F.lit(9))
    got = sorted((r.doc_id if r.doc_id is not None else -1, r.text, r.n_lines, r.n_removed) for r in line_dedup.line_dedup(df.withColumn("gone", F.lit(3)).withColumn("id", F.lit(4))).collect())
    assert got == [(-1, line, 1, 0), (1, line, 1, 0), (2, "", 1, 1), (2, "x", 2, 1), (3, "", 1, 1)]
    assert line_dedup.line_dedup(df.limit(0)).count() == 0


def test_components(spark):
    r = random.Random(5)
    edges = [(k, k + 1) for k in range(100, 160)] + [(r.randrange(40), r.randrange(40)) for _ in range(30)] + [(7, 7), (None, 3)]
    got = {x.node: x.root for x in components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    root = {k: k for e in edges for k in e}
    for _ in root:
        for a, b in edges:
            if a is not None:
                root[a] = root[b] = min(root[a], root[b])
    ends = {k for a, b in edges if a is not None and a != b for k in (a, b)}
    assert got == {k: root[k] for k in ends}




@pytest.mark.parametrize("seed", [4, 5])
def test_near_copies_take_five_words(spark, seed):
    """Against all pairs of sets of distinct five-word shingles, linked from 80 of 100 on."""
    rows = list(enumerate(near_copies(seed)))
    sets = {}
    for k, t in rows:
        w = WORD.findall(re.sub("[A-Z]+", lambda m: m[0].lower(), t or ""))
        sets[k] = {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()
    root = {k: k for k in sets}
    for a in sets:
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 80 * len(sets[a] | sets[b]):
                low, high = sorted((root[a], root[b]))
                root = {k: low if r == high else r for k, r in root.items()}
    got = ngram_join.near_copies(documents(spark, [t for _, t in rows]).repartition(5)).collect()
    assert {r.doc_id: r.component_id for r in got} == root and len(set(root.values())) < len(root)
