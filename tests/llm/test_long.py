"""Texts of several megabytes, longer than any piece that the operators read at a time, against brute force."""

import random
import time

import pytest

from tests.llm.test_dedup import brute_components, brute_lines, brute_substrings, documents
from tests.llm.test_texts import brute_quality
from webloom.llm import chat, html_text, line_dedup, mixing, ngram_join, packing, quality, substring_dedup, words


@pytest.fixture(scope="module")
def texts():
    r = random.Random(5)
    vocabulary = [f"w{k}" for k in range(5000)] + ["Größe", "日本", "É"]
    long = r.choices(vocabulary, k=400_000)
    near = list(long)
    near[7] = "other"
    passage = r.choices(vocabulary, k=60)
    tail = [*r.choices(vocabulary, k=300_000), *passage]
    huge = "x" * (3 * words.SEGMENT)
    return [
        "\n".join(" ".join(long[k : k + 40]) for k in range(0, len(long), 40)), " ".join(passage), " ".join(tail), "\n".join(" ".join(near[k : k + 40]) for k in range(0, len(near), 40)),
        f"a {huge} b c d", f"a {huge} b c d", f"a {huge[1:]} b c d", None, "",
    ]


def test_lengths(texts):
    assert sum(len(t or "") > 2 * words.SEGMENT for t in texts) >= 5


def test_long_substrings(spark, texts):
    got = substring_dedup.substring_dedup(documents(spark, texts)).collect()
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_text) for r in got} == brute_substrings(list(enumerate(texts)))


def test_long_ngram_classes(spark, texts):
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.ngram_classes(documents(spark, texts)).collect()}
    assert got == brute_components(list(enumerate(texts))) and got[3][1] == 0 and got[5][1] == 4


def test_long_lines(spark, texts):
    """Many lines in one text, a line of one long word, and a line of many words."""
    rows = list(enumerate([*texts[:2], *texts[3:], " ".join(texts[0].split()[:2000]), " ".join(["new", *texts[0].split()[:2000]])]))
    assert len(rows[0][1].split("\n")) == 10_000
    got = {x.doc_id: x.text for x in line_dedup.line_dedup(documents(spark, [t for _, t in rows])).collect()}
    # Brute force over all pairs of 20,000 lines is too slow: rows that share no line with the others are held against it.
    small = [(k, t) for k, t in rows if k not in (0, 2)]
    want = brute_lines(small)
    assert {k: got[k] for k, _ in small} == want
    assert got[0] == rows[0][1] and got[2] == ""  # every line of the copy, the edited one too, comes earlier


def test_long_quality(spark, texts):
    book = {r.doc_id: r for r in quality.ledger(documents(spark, texts)).collect()}
    for k, text in enumerate(texts):
        r = book[k]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == brute_quality(text)


def test_long_mixing(spark, texts):
    out = mixing.mix(documents(spark, texts)).collect()
    assert sorted(r.doc_id for r in out) == list(range(len(texts))) and {r.doc_id: r.tokens for r in out}[0] == 400_000


def test_long_chat(spark, texts):
    turns = [(1, k, "assistant" if k % 2 else "user", t) for k, t in enumerate(texts)]
    last = [e for e in chat.format_chat(spark.createDataFrame(turns, "conv_id bigint, turn bigint, role string, text string")).collect() if e.is_last][0]
    assert chat.read_turns(last.text) == [(role, t or "") for *_, role, t in turns]


def test_long_pages():
    """Long blocks, many blocks, and deep nesting, in time that grows with the page."""
    block = "plain words of the text " * 100_000
    blocks = [f"block {k} with a few words of its own" for k in range(50_000)]
    page = f"<html><body><nav><a href=x>menu</a></nav><article><p>{block}</p>" + "".join(f"<p>{b}</p>" for b in blocks) + "</article></body></html>"
    start = time.time()
    assert html_text.main_text(page) == "\n".join([block.strip(), *blocks])
    deep = "<div>" * 20_000 + "text" + "</div>" * 20_000
    assert html_text.main_text(deep) == "text" and time.time() - start < 60


def test_long_packing(spark, texts):
    import public_tokenizers
    from tokenizers import Tokenizer

    slow = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    pieces = {}
    for p in packing.pack(documents(spark, texts)).collect():
        pieces.setdefault(p.doc_id, []).append((p.start, p.length, p.ids))
    for k, text in enumerate(texts):
        ids = [*slow.encode(text or "", add_special_tokens=False).ids, 0]
        got = sorted(pieces[k])
        assert [s for s, *_ in got] == [sum(n for _, n, _ in got[:i]) for i in range(len(got))]
        assert b"".join(raw for *_, raw in got) == b"".join(x.to_bytes(4, "little") for x in ids)
