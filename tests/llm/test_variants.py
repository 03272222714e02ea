"""Operators 11 to 13 against brute force, and over awkward rows."""

import re
import zlib
from collections import Counter
from pathlib import Path

import duckdb
import numpy as np
import pytest
import xxhash

from quillstack.llm import registry
from quillstack.llm.simhash_trie import fingerprint, links_of, simhash_components, simhash_near_duplicates
from quillstack.llm.spelling import spelling_variants
from quillstack.llm.whitening import whiten

LOWER = {i: i + 32 for i in range(65, 91)}


def _sorted(rows):
    return sorted((tuple(r) for r in rows), key=repr)


# ---- spelling variants


def _near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def _variants(rows, shortest=6, least=5, factor=5):
    n = Counter()
    for id_, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{id_}:{run}".encode())
            if id_ is not None and h % 199 == 0:
                i = h % len(run)
                run = run[:i] + run[i + 1 :]
            n[run] += 1
    n = {w: c for w, c in n.items() if len(w) >= shortest and c >= least}
    near = {w: [v for v in n if _near(v, w)] for w in n}
    form = {w: min(v, key=lambda x: (-n[x], x)) for w, v in near.items() if v}
    form = {w: f for w, f in form.items() if n[f] >= factor * n[w]}
    out = []
    for w in n:
        root = w
        while root in form:
            root = form[root]
        out.append((w, form.get(w), root, n[w], len(near[w]), n[form[w]] if w in form else None))
    return _sorted(out)


@pytest.fixture(scope="module")
def misspelt():
    """Chains of rarer and rarer variants, letters that repeat, accents, ties, and one crowded block."""
    rng = np.random.default_rng(5)
    words = {"garden": 700, "garten": 100, "gartin": 15, "gardenn": 15, "ggarden": 15, "aaaaaa": 40, "aaaaaaa": 8, "aaaaaaaa": 5, "élevés": 30, "éléves": 30, "eleves": 6, "Ünited": 9, "ünited": 50, "short": 90}
    for a in "abcdefgh":
        for b in "abcdefgh":
            words[f"common{a}{b}"] = 5 + int(rng.integers(0, 60))
    text = [w for w, c in words.items() for _ in range(c)]
    rng.shuffle(text)
    parts = np.array_split(np.array(text), 7)
    seps = [" ", "\n", "1", "×", ", "]
    return [(i, "".join(w + seps[j % 5].replace("×", "!") for j, w in enumerate(p.tolist()))) for i, p in enumerate(parts)] + [(None, "garden " * 9), (8, None), (9, ""), (1, "garten garten")]


@pytest.mark.parametrize("most", [2, 8, 128])
def test_spelling_equals_brute_force(spark, misspelt, most):
    df = spark.createDataFrame([(*r, "x", 1) for r in misspelt], "doc_id long, text string, word string, n int").repartition(3)
    assert _sorted(spelling_variants(df, most=most).collect()) == _variants(misspelt)


def test_spelling_slips_and_odd_rows(spark, odd, none, rows):
    texts = [(i, " ".join(["variant"] * 8 + ["Zürich"])) for i in range(400)]
    want = _variants(texts)
    assert any(r[1] for r in want)
    assert _sorted(spelling_variants(spark.createDataFrame(texts, "doc_id long, text string")).collect()) == want
    assert _sorted(spelling_variants(odd, least=1, shortest=1).collect()) == _variants([r[:2] for r in rows], 1, 1)
    assert spelling_variants(none).collect() == []


def test_spelling_sql(spark, sf_dir):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{Path(sf_dir) / 'documents.parquet'}')")
    want = con.execute(registry.ORACLE_SQL["op11_spelling_variants"]).fetchall()
    assert want and _sorted(registry.QUERIES["op11_spelling_variants"](spark, sf_dir).collect()) == _sorted(want)


# ---- SimHash


def _simhash(text):
    words = [w for w in re.split(r"[\x20\x09-\x0d]+", (text or "").translate(LOWER)) if w]
    k = min(4, len(words))
    h = [xxhash.xxh64_intdigest(" ".join(words[i : i + k]).encode(), 42) for i in range(len(words) - k + 1)] if words else []
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def _components(prints, ids):
    """Smallest id reachable over links of at most 4 bits, by comparing all pairs."""
    f, label = np.array(prints, dtype=np.uint64), np.array(ids)
    close = np.bitwise_count(f[:, None] ^ f[None, :]) <= 4
    while True:
        least = np.where(close, label[None, :], np.iinfo(np.int64).max).min(axis=1)
        if (least == label).all():
            return label.tolist()
        label = least


def test_fingerprint_of_long_and_odd_texts():
    for text in ("", " \n", "one", "Four words, no more", "É É É É É", "a b " * 40_000, "x" * 100_000):
        assert fingerprint(text.encode()) == _simhash(text)


def test_unit_links_every_component():
    rng = np.random.default_rng(3)
    # A dense group of copies that differ in few bits, groups at exact distances of 4 and 5, and noise.
    base = int(rng.integers(0, 1 << 62))
    values = {base ^ sum(1 << int(b) for b in rng.choice(64, rng.integers(0, 4), replace=False)) for _ in range(1500)}
    far = int(rng.integers(0, 1 << 62))
    values |= {far, far ^ 0b1111, far ^ (0b11111 << 30)} | {int(x) for x in rng.integers(0, 1 << 62, 300)}
    f = np.array(sorted(values), dtype=np.uint64)
    ids = np.arange(len(f))
    want = _components(f, ids)
    got = ids.copy()
    swapped = (f << np.uint64(32)) | (f >> np.uint64(32))
    order = np.argsort(swapped)
    links = [links_of(f, len(f), 0, 2, 4, ids), links_of(swapped[order], len(f), 0, 1, 4, ids[order])]
    assert all(len(a) < len(f) for a, _ in links)
    for _ in range(len(f)):
        before = got.copy()
        for a, b in links:
            for x, y in zip(a, b, strict=True):
                got[[x, y]] = min(got[x], got[y])
        if (got == before).all():
            break
    assert got.tolist() == want


@pytest.mark.parametrize("unit", [100, 4096])
def test_trie_join_equals_brute_force(spark, unit):
    rng = np.random.default_rng(1)
    values = set()
    for b in rng.integers(0, 1 << 62, 12):
        for _ in range(60):
            values.add(int(b) ^ sum(1 << int(q) for q in rng.choice(64, rng.integers(0, 7), replace=False)))
    f = sorted(values)
    ids = rng.permutation(len(f)).tolist()
    df = spark.createDataFrame([(int(np.uint64(x).view(np.int64)), i) for x, i in zip(f, ids, strict=True)], "f long, rep long")
    got = {int(np.int64(r.f).view(np.uint64)): r.root for r in simhash_components(df, unit=unit).collect()}
    assert got == dict(zip(f, _components(f, ids), strict=True))


def test_simhash_odd_rows(spark, odd, none, rows):
    got = _sorted(simhash_near_duplicates(odd).collect())
    known = [(r[0], _simhash(r[1])) for r in rows if r[0] is not None]
    least = dict(zip([f for _, f in known], _components([f for _, f in known], [i for i, _ in known]), strict=True))
    two = {least[f] for i, f in known if i == 12}
    least = {f: min(two) if c in two else c for f, c in least.items()}
    want = [(r[0], f"{_simhash(r[1]):016x}", None if r[0] is None else least[_simhash(r[1])]) for r in rows]
    assert got == _sorted(want)
    assert simhash_near_duplicates(none).collect() == []


def test_simhash_query(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    prints = [_simhash(r.text) for r in docs]
    root = _components(prints, [r.doc_id for r in docs])
    want = [(r.doc_id, f"{f:016x}", c) for r, f, c in zip(docs, prints, root, strict=True)]
    assert _sorted(registry.QUERIES["op12_simhash_near_dedup"](spark, sf_dir).collect()) == _sorted(want)


# ---- whitening


def _checked(got, vectors, most=32):
    """got against the eigenvectors of the covariance, computed with exact integers."""
    x = np.floor(np.array([v for _, v in vectors], dtype=np.float64) * 64).astype(np.int64) + 1_000_000
    n, sums = len(x), x.sum(axis=0)
    y = (n * x - sums).astype(np.float64) / n
    values, axes = np.linalg.eigh(y.T @ y / n)
    values, axes = values[::-1], axes[:, ::-1]
    k = min(most, int((values > 1e-9 * values[0]).sum()))
    assert len(got) == n * k
    assert max(r.identity_error for r in got) <= 1e-4 and {r.n for r in got} == {n}
    by = {}
    for r in got:
        by.setdefault(r.vec_id, {})[r.component] = r
    for c in range(k):
        want = y @ axes[:, c] / np.sqrt(values[c])
        have = np.array([by[i][c + 1].whitened for i, _ in vectors])
        assert min(np.abs(have - want).max(), np.abs(have + want).max()) < 1e-6
        assert abs(by[vectors[0][0]][c + 1].explained / (values[c] / values.sum()) - 1) < 1e-4
    for (i, _), row in zip(vectors, x.tolist(), strict=True):
        assert by[i][1].deviation == sum((n * a - s) ** 2 for a, s in zip(row, sums.tolist(), strict=True))


SCHEMA = "vec_id long, embedding array<float>, n long, component string"


def test_whitening_equals_eigenvectors(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(400, 12)) @ np.diag(np.linspace(3, 0.5, 12)) @ np.linalg.qr(rng.normal(size=(12, 12)))[0] + 7
    x = x.astype(np.float32).tolist()
    bad = [(1000, None), (1001, [None] * 12), (1002, [float("nan")] * 12), (1003, [float("inf")] * 12), (1004, []), (1005, [1.0] * 5), (1006, [1.0] * 11 + [None])]
    rows = [(i, v, 1, "x") for i, v in enumerate(x)] + [(i, v, None, None) for i, v in bad]
    for parts in (1, 40):  # one triangle, and a tree of more than one level
        got = whiten(spark.createDataFrame(rows, SCHEMA).repartition(parts)).collect()
        _checked(got, [(i, v) for i, v, *_ in rows[: len(x)]])
    assert len(whiten(spark.createDataFrame(rows, SCHEMA), components=3).collect()) == 3 * len(x)


def test_whitening_of_ties_and_few_rows(spark):
    def run(vectors):
        return whiten(spark.createDataFrame([(i, v, 1, "x") for i, v in enumerate(vectors)], SCHEMA)).collect()

    assert run([]) == [] and run([[1.0, 2.0]]) == [] and run([[1.0, 2.0]] * 5) == []
    # Fewer rows than dimensions, a direction without variance, and repeated rows.
    few = [[0.0, 1.0, 5.0, 2.0], [1.0, 1.0, 5.0, 7.0], [3.0, 1.0, 5.0, 2.0], [3.0, 1.0, 5.0, 2.0]]
    _checked(run(few), list(enumerate(few)))
    got = spark.createDataFrame([(None, [1.0, 2.0], 1, "x"), (None, [2.0, 0.0], 1, "x")], SCHEMA)
    assert [r.vec_id for r in whiten(got).collect()] == [None, None]


def test_whitening_query(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()
    _checked(registry.QUERIES["op13_embedding_whitening"](spark, sf_dir).collect(), [(r.vec_id, r.embedding) for r in rows])
