"""Search, nearest vectors and vector codes against plain Python, on odd inputs."""

import hashlib
import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from plumbline.llm import codes, lexical, neighbours
from plumbline.llm.common import Written

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def put(spark, df):
    return Written(spark, "test").put(df)[0]


# ranked lexical search


def ranked(docs, items, k=10):
    terms = [(d, Counter(TERM.findall((t or "").translate(LOWER)))) for d, t in docs]
    terms = [(d, c) for d, c in terms if c]
    n_docs, n_terms, df = len(terms), sum(c.total() for _, c in terms), Counter(t for _, c in terms for t in c)
    asked: dict = {}
    for item, text in items:
        asked.setdefault(item, Counter()).update(TERM.findall((text or "").translate(LOWER)))
    out = []
    for item, q in asked.items():
        scores = []
        for d, c in terms:
            m = 25 + 75 * c.total() * n_docs // n_terms
            s = sum(n * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (1_000_000_000 * c[t] // (1000 * c[t] + 8 * m)) for t, n in q.items() if t in c)
            if s > 0:
                scores.append((-s, d is None, d))
        out += [(item, rank, d, -s) for rank, (s, _, d) in enumerate(sorted(scores, key=lambda x: (x[0], x[1], x[2] or 0))[:k], 1)]
    return sorted(out, key=str)


DOCS = [
    (7, "The cat sat"), (3, "the cat sat"), (3, "the cat sat"), (None, "the cat sat"), (5, None), (6, ""), (8, " \n--"), (9, "THE é日本 cat\x00dog É" * 3), (10, "x " * 40000 + "rare"),
    *((100 + i, "the " * (i % 7) + f"w{i % 13} cat_dog w{i % 5}é") for i in range(300)), (2**40, "dog " * 3),
]
ITEMS = [(1, "cat the THE the"), (2, "w1 w2é nothing"), (3, None), (4, ""), (None, "rare x"), (5, "dog"), (5, "cat dog"), (6, "É"), (7, "é日本" + " the" * 70)]


def test_lexical_search(spark):
    docs = spark.createDataFrame(DOCS, "doc_id long, text string").withColumns({c: F.lit(1) for c in ("term", "block", "docs", "n", "items", "score", "rank", "item_id")}).repartition(3)
    items = spark.createDataFrame(ITEMS, "item_id long, text string").withColumns({c: F.lit("x") for c in ("term", "doc_id", "n", "part")})
    built = put(spark, lexical.index(docs))
    got = sorted(map(tuple, lexical.search(built, items).collect()), key=str)
    assert got == ranked(DOCS, ITEMS)
    assert sorted(map(tuple, lexical.search(built, items, 3).collect()), key=str) == ranked(DOCS, ITEMS, 3)
    assert lexical.search(built, items.limit(0)).count() == 0
    none = put(spark, lexical.index(docs.limit(0)))
    assert lexical.search(none, items).columns == ["item_id", "rank", "doc_id", "score"] and lexical.search(none, items).count() == 0


def test_lexical_blocks_and_groups(spark, monkeypatch):
    """Small blocks, pieces and groups of items, and a shuffled join, give the same rows."""
    docs, items = spark.createDataFrame(DOCS, "doc_id long, text string").repartition(2), spark.createDataFrame(ITEMS, "item_id long, text string")
    monkeypatch.setattr(lexical, "ITEMS", 2)
    built = put(spark, lexical.index(docs))
    assert built.where("term IS NULL").count() == 2
    assert sorted(map(tuple, lexical.search(built, items).collect()), key=str) == ranked(DOCS, ITEMS)


def test_lexical_kernels(monkeypatch):
    rng = np.random.default_rng(1)
    sums, want = np.zeros((63, 3), "<u8"), np.zeros(192, np.int64)
    for _ in range(50):
        docs = np.sort(rng.choice(192, rng.integers(1, 192), replace=False))
        values, n = rng.integers(0, 1 << rng.integers(1, 40), len(docs)), int(rng.integers(1, 9))
        values[0] += 1
        words, rows = lexical.bitmaps(docs, values)
        for shift in (b for b in range(4) if n >> b & 1):
            lexical.add(sums, words, rows, shift)
        want[docs] += n * values
    for k in (1, 5, 191, 500):
        order = sorted((d for d in range(192) if want[d] > 0), key=lambda d: (-want[d], d))[:k]
        assert lexical.best(sums, k) == [(d, want[d]) for d in order]
    monkeypatch.setattr(lexical, "PIECE", 5)
    assert lexical.term_counts("Aa bb-aA ccccccccccc\x7fÉ".encode()) == Counter({b"aa": 2, b"bb": 1, b"ccccccccccc": 1, "É".encode(): 1})
    monkeypatch.setattr(lexical, "BLOCK", 2)
    monkeypatch.setattr(lexical.TaskContext, "get", lambda: type("T", (), {"partitionId": lambda self: 3})())
    batch = pa.RecordBatch.from_arrays([pa.array([5, 4, None, 1, 2]), pa.array(["b a", "a", "a a c", None, "z"])], ["doc_id", "text"])
    made = list(lexical.index_blocks(iter([batch])))
    assert [b.column("doc_ids")[0].as_py() for b in made] == [[4, 5], [2, None]] and len({b.column("block")[0].as_py() for b in made}) == 2


# nearest vectors


def vectors(seed=0, n=400, d=24):
    rng = np.random.default_rng(seed)
    rows = rng.normal(size=(n, d)).astype(np.float32)
    rows[100:220] = rows[100]  # copies
    rows[220:240] = np.float32(0.5)  # ties that codes can't tell apart
    rows[240:260] = rows[100] + rng.normal(size=(20, d)).astype(np.float32) * np.float32(1e-6)
    out = [(i, r.tolist(), None if i % 11 == 0 else i % 3) for i, r in enumerate(rows)]
    odd = [[0.0] * d, [float("nan")] * d, [1.0] * (d - 1) + [float("inf")], [None] + [1.0] * (d - 1), None, [], [1.0, 2.0, 3.0]]
    out += [(1000 + 20 * i, v, 1) for i, v in enumerate(odd)] + [(None, rows[0].tolist(), 1), out[40], out[40], (40, rows[41].tolist(), 2), (2000, [2.0, 1.0, 1.0], 0), (2001, [2.0, 1.0, 1.0], 0)]
    return out


def usable(v):
    return v is not None and len(v) > 0 and all(x is not None and math.isfinite(x) for x in v)


def test_nearest(spark):
    data = vectors()
    df = spark.createDataFrame(data, "vec_id long, vector array<float>, label int").withColumns({c: F.lit("x") for c in ("strip", "asks", "query_id", "ids", "scores", "rank")}).repartition(3)
    got = sorted(map(tuple, neighbours.search(df, df.where(F.col("vec_id") % 20 == 0)).collect()))
    rows = sorted({(i, tuple(v)) for i, v, _ in data if i is not None and usable(v) and any(v)})
    asked: dict = {}
    for i, v in rows:
        if i % 20 == 0:
            asked.setdefault(i, v)
    want = []
    for q, v in asked.items():
        scores = []
        for i, w in rows:
            if i != q and len(w) == len(v):
                total = 0.0
                for a, b in zip(v, w, strict=True):
                    total += a * b
                scores.append((-total, i))
        want += [(q, rank, i, -s) for rank, (s, i) in enumerate(sorted(scores)[:20], 1)]
    assert got == sorted(want)
    assert neighbours.search(df.limit(0), df).count() == 0 and neighbours.search(df, df.limit(0)).count() == 0


def test_nearest_tiles(monkeypatch):
    """Bounds hold and tiles of any size give what sorting all products gives, large and tiny components included."""
    rng = np.random.default_rng(5)
    rows = rng.normal(size=(300, 16)) * 10.0 ** rng.integers(-160, 120, size=(300, 1))
    rows[:150] = rng.normal(size=(150, 16))
    rows[150:170] = 5e-324
    near, error = (q := neighbours.Codes(np.arange(300), rows)).products(q)
    exact = np.array([neighbours.inner(np.broadcast_to(r, rows.shape), rows) for r in rows])
    assert (np.abs(near - exact) <= error).all()
    strip = neighbours.candidates(np.arange(300), rows, 7)
    monkeypatch.setattr(neighbours, "CANDIDATES", 32)
    for i, best in enumerate(neighbours.nearest(neighbours.Codes(np.arange(300), rows), strip, 7)):
        assert [name for _, name in best] == sorted((j for j in range(300) if j != i and (j < 150 or j >= 170 or j <= 157)), key=lambda j: (-exact[i, j], j))[:7] or 150 <= i < 170


def test_few_exact_products(monkeypatch):
    """The bounds leave few pairs to compute again."""
    rng = np.random.default_rng(2)
    rows = rng.normal(size=(4000, 64))
    made, inner = [], neighbours.inner
    monkeypatch.setattr(neighbours, "inner", lambda a, b: made.append(len(a)) or inner(a, b))
    neighbours.nearest(neighbours.Codes(np.arange(0, 2000, 20), rows[:2000:20]), neighbours.candidates(np.arange(4000), rows, 20), 20)
    assert sum(made) < 100 * 80


# vector codes


def compressed(data, parts=4, entries=256, rounds=4):
    kept = [(i, [max(min(math.floor(1024 * x), 2**63 - 1), -(2**63)) for x in v], label) for i, v, label in data if usable(v)]
    if not kept:
        return [], ""
    first = min(kept, key=lambda r: (r[0] is None, r[0] or 0, len(r[1])))
    d = len(first[1])
    kept = sorted((r for r in kept if len(r[1]) == d and d % parts == 0), key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    w = d // parts
    cut = [[v[p * w : p * w + w] for p in range(parts)] for _, v, _ in kept]
    books = [[c[p] for c in cut[:entries]] for p in range(parts)]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))

    def assign():
        return [[min(((far(c[p], b), e) for e, b in enumerate(books[p]))) for p in range(parts)] for c in cut]

    for _ in range(rounds):
        codes_ = assign()
        for p in range(parts):
            for e in range(len(books[p])):
                mine = [c[p] for c, a in zip(cut, codes_, strict=True) if a[p][1] == e]
                if mine:
                    books[p][e] = [sum(x) // len(mine) for x in zip(*mine, strict=True)]
    rows = [(i, label, "".join(f"{e:02x}" for _, e in a), min(sum(f for f, _ in a), 2**63 - 1)) for (i, _, label), a in zip(kept, assign(), strict=True)]
    totals = Counter()
    for _, label, _, error in rows:
        totals[label] += error
    sha = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest() if kept else ""
    return sorted(((i, label, c, e, min(totals[label], 2**63 - 1)) for i, label, c, e in rows), key=str), sha


def run_codes(spark, data, entries=256, parts=4):
    df = spark.createDataFrame(data, "vec_id long, vector array<double>, label int").withColumns({c: F.lit("x") for c in ("row", "pos", "part", "code", "error", "weight", "cut", "salt", "of")}).repartition(3)
    rows, books = codes.compress(df, parts, entries)
    rows = codes.with_label_error(rows).select("vec_id", "label", "code", "error", "label_error")
    return sorted(map(tuple, rows.collect()), key=str), codes.sha256(books)


def test_codes(spark):
    data = vectors(3, 300)
    assert run_codes(spark, data, 16) == compressed(data, entries=16)
    assert run_codes(spark, data[:30]) == compressed(data[:30])  # fewer rows than entries


def test_codes_odd(spark):
    assert run_codes(spark, []) == ([], hashlib.sha256(b"").hexdigest())
    assert run_codes(spark, [(1, [1.0, 2.0, 3.0], 0)])[0] == []  # three components have no four parts
    huge = [(i, [1e6 * i, -3e17 * (i % 3), 0.25, 1e300], i % 2) for i in range(40)]
    assert run_codes(spark, huge, 5) == compressed(huge, entries=5)
    same = [(i, [0.1, 0.2, 0.3, 0.4], None) for i in range(600)] + [(1000 + i, [0.1 * i, 0.2, 0.3, -0.4], 1) for i in range(50)]
    assert run_codes(spark, same, 8) == compressed(same, entries=8)  # a hot part


@pytest.mark.parametrize("scale", [1, 2**20, 2**40])
def test_code_kernel(scale):
    rng = np.random.default_rng(4)
    rows, book = rng.integers(-50, 50, (200, 4)) * scale, rng.integers(-50, 50, (16, 4)) * scale
    book[3] = book[1]
    code, error = codes.nearest(rows, book)
    want = [min((sum((int(a) - int(b)) ** 2 for a, b in zip(r, b_, strict=True)), e) for e, b_ in enumerate(book)) for r in rows]
    assert [(min(f, 2**63 - 1), e) for f, e in want] == list(zip(error.tolist(), code.tolist(), strict=True))
