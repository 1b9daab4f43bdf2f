"""Batches of pages are rewritten without being Python objects as a whole."""

import tracemalloc

import pyarrow as pa

from webloom.operators import rewrite

REF = pa.struct([(name, pa.string()) for name in ("raw", "absolute", "page", "asset")])


def _peak(run, batch: pa.RecordBatch) -> tuple[list[pa.RecordBatch], float]:
    tracemalloc.start()
    out = list(run(iter([batch, batch])))
    peak = tracemalloc.get_traced_memory()[1] / 1e6
    tracemalloc.stop()
    return out, peak


def test_pages_one_at_a_time():
    n = 1500
    refs = [[{"raw": f"/a{k}-{i}", "absolute": f"http://h/a{k}-{i}", "page": f"../a{k}-{i}.html", "asset": None} for k in range(60)] for i in range(n)]
    html = ["<a href=/a1-%d>x</a>" % i + "y" * 4000 for i in range(n)]
    columns = [pa.array(range(n), pa.int64()), pa.array(["http://h/"] * n), pa.array(["index.html"] * n), pa.array(html), pa.array(refs, pa.list_(REF))]
    batch = pa.RecordBatch.from_arrays(columns, names=["page_id", "url", "home", "html", "refs"])
    del refs, html
    out, peak = _peak(rewrite._rewrite(False), batch)
    ids = [i for b in out for i in b.column("page_id").to_pylist()]
    assert ids == [*range(n)] * 2 and all(f"../a1-{i}.html" in page for b in out for i, page in zip(b.column("page_id").to_pylist(), b.column("html").to_pylist(), strict=True))
    assert len(out) > 2 and max(b.column("html").nbytes for b in out) < 2 * rewrite.HELD
    assert peak < 20


def test_sheets_one_at_a_time():
    n = 1500
    refs = [[{"raw": f"a{k}-{i}.png", "absolute": f"http://h/a{k}-{i}.png", "asset": f"a{k}-{i}.png"} for k in range(60)] for i in range(n)]
    names = [f"k{i}" for i in range(n)]
    batch = pa.RecordBatch.from_arrays([pa.array(names), pa.array(names), pa.array(["p{background:url(a1-%d.png)}" % i for i in range(n - 1)] + [None]), pa.array(refs)], names=["key", "path", "css", "refs"])
    del refs
    out, peak = _peak(rewrite._rewrite_sheets, batch)
    assert [k for b in out for k in b.column("key").to_pylist()] == names * 2
    assert [c for b in out for c in b.column("css").to_pylist()] == (['p{background:url("a1-%d.png")}' % i for i in range(n - 1)] + [""]) * 2
    assert peak < 10


def test_many_batches_take_no_more_than_few():
    n = 600
    refs = [[{"raw": f"/a{k}-{i}", "absolute": f"http://h/a{k}-{i}", "page": None, "asset": None} for k in range(60)] for i in range(n)]
    html = ["<body><a href=/a1-%d>x</a>" % i + "y" * 8000 for i in range(n)]
    columns = [pa.array(range(n), pa.int64()), pa.array(["http://h/"] * n), pa.array(["index.html"] * n), pa.array(html), pa.array(refs, pa.list_(REF))]
    batch = pa.RecordBatch.from_arrays(columns, names=["page_id", "url", "home", "html", "refs"])
    del refs, html, columns

    def peak(times: int) -> float:
        tracemalloc.start()
        rows = sum(b.num_rows for b in rewrite._rewrite(True)(iter([batch] * times)))  # taken as Spark does, none kept
        most = tracemalloc.get_traced_memory()[1] / 1e6
        tracemalloc.stop()
        assert rows == n * times
        return most

    few, many = peak(2), peak(6)
    assert many < few + 1 and many < 10
