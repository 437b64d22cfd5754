"""Vector codes against SQL and a plain k-means over lists."""

import hashlib
import math

import numpy as np
import pytest
from oracle import SF, assert_same

from apexframe.llm import queries, vector_codes
from apexframe.session import ship

SCHEMA = "vec_id long, embedding array<float>, label int, v string, codes string"


def plain(rows, parts=4, entries=256, rounds=4):
    """(vec_id, label, codes, error) and codebooks by exhaustive comparison of Python integers."""
    kept = [(i, lab, [max(-vector_codes.LIMIT, min(vector_codes.LIMIT, math.floor(1024 * x))) for x in v]) for i, v, lab in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0], r[2]))
    width = len(kept[0][2]) // parts
    cut = [[v[p * width : (p + 1) * width] for p in range(parts)] for _, _, v in kept]
    books = [[c[p] for c in cut[:entries]] for p in range(parts)]
    nearest = lambda part, book: min((sum((a - b) ** 2 for a, b in zip(part, e, strict=True)), k) for k, e in enumerate(book))
    for _ in range(rounds):
        for p in range(parts):
            members = {}
            for c in cut:
                members.setdefault(nearest(c[p], books[p])[1], []).append(c[p])
            books[p] = [[sum(col) // len(members[k]) for col in zip(*members[k], strict=True)] if k in members else e for k, e in enumerate(books[p])]
    out = []
    for (i, lab, _), c in zip(kept, cut, strict=True):
        near = [nearest(c[p], books[p]) for p in range(parts)]
        out.append((i, lab, [k for _, k in near], sum(d for d, _ in near)))
    return out, books


def table_of(spark, rows):
    ship(spark)
    return spark.createDataFrame([(i, v, lab, "clash", "clash") for i, v, lab in rows], SCHEMA)


@pytest.mark.parametrize("cell", [1, 16, 64, 1000])
def test_codes_equal_exhaustive_search(spark, cell):
    rng = np.random.default_rng(cell)
    rows = [(int(i), np.float32(rng.normal(size=16) * 0.2).tolist(), int(i) % 3 if i % 5 else None) for i in rng.permutation(260)]
    rows += [(1000 + i, rows[3][1], 1) for i in range(40)] + [(3, rows[4][1], 2), (None, rows[5][1], 0)]
    rows += [(2000, None, 1), (2001, [1.0] * 15 + [None], 1), (2002, [1.0] * 15 + [float("nan")], 1), (2003, [1.0] * 15 + [float("inf")], 1), (2004, [3e38, -3e38] + [0.0] * 14, 7)]
    df = table_of(spark, rows).repartition(5)
    scaled = vector_codes.materialize(vector_codes.quantise(df), "test")
    books = vector_codes.train(scaled, entries=32, cell=cell)
    want, want_books = plain([(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v], lab) for i, v, lab in rows], entries=32)
    assert books.tolist() == want_books
    got = vector_codes.encode(scaled, books, cell)
    key = lambda r: (r[0] is None, r[0] or 0, r[3], r[2])
    assert sorted(((r["vec_id"], r["label"], r["codes"], r["error"]) for r in got.collect()), key=key) == sorted(want, key=key)
    restored = vector_codes.decode(got, books).select("codes", vector_codes.F.col("v").alias("x")).limit(20).collect()
    assert all(list(r["x"]) == [x for p, k in enumerate(r["codes"]) for x in want_books[p][k]] for r in restored)


def test_cells_drop_entries_but_not_the_nearest():
    rng = np.random.default_rng(5)
    book = rng.integers(-500, 500, (256, 16))
    memo = vector_codes.CellMemo(book, 32)
    parts = rng.integers(-500, 500, (500, 16))
    parts[100:200] = parts[0]
    entry, least = memo.nearest(parts)
    exact = ((parts[:, None] - book[None]) ** 2).sum(axis=2)
    assert (entry == exact.argmin(axis=1)).all() and (least == exact.min(axis=1)).all()
    assert len(memo.known) == 400 and np.mean([len(x) for x in memo.known.values()]) < 128


def test_empty_and_odd_lengths(spark):
    none = vector_codes.materialize(vector_codes.quantise(table_of(spark, [(1, None, 1)])), "test")
    assert vector_codes.train(none).shape == (4, 0, 0)
    assert vector_codes.encode(none, vector_codes.train(none)).count() == 0
    for v in ([1.0] * 6, []):
        with pytest.raises(ValueError, match="one length"):
            vector_codes.train(vector_codes.materialize(vector_codes.quantise(table_of(spark, [(1, v, 1)])), "test"))


def test_query_equals_sql(spark):
    table_of(spark, [])
    assert_same(spark, SF, queries.queries()["op11_cell_codes"], queries.oracle_sql()["op11_cell_codes"])


def test_digest_is_that_of_the_entries(spark):
    rows = spark.read.parquet(f"{SF}/embeddings.parquet")
    scaled = vector_codes.materialize(vector_codes.quantise(rows), "test")
    digest = hashlib.sha256(",".join(str(x) for p in vector_codes.train(scaled).tolist() for e in p for x in e).encode()).hexdigest()
    assert {r[0] for r in queries.queries()["op11_cell_codes"](spark, SF).select("codebooks_sha256").distinct().collect()} == {digest}
