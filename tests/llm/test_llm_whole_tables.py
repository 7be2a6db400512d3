"""License scan, spelling variants and whitening against brute force on hand-made tables."""

from __future__ import annotations

import math
import random
import re
import string
import zlib
from collections import Counter

import numpy as np
import pytest
from millrace.llm import licenses, spelling, whitening
from millrace.llm.frames import reach_workers
from millrace.llm.queries import QUERIES

LOW = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


@pytest.fixture(scope="module", autouse=True)
def workers(spark):
    reach_workers(spark)


@pytest.fixture(scope="module")
def as_tables(spark, tmp_path_factory):
    """Writes tables to a folder that the registered queries read."""

    def write(**tables):
        folder = tmp_path_factory.mktemp("tables")
        for name, df in tables.items():
            df.write.parquet(f"{folder}/{name}.parquet")
        return str(folder)

    return write


def documents(spark, rows):
    return spark.createDataFrame(
        [(i, t, 1, "x", 2.0, 3) for i, t in rows], "doc_id long, text string, n int, word string, score double, id int"
    )


# -- licences ------------------------------------------------------------------------------------------------------

PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}


def base_of(text):
    words = WORD.findall((text or "").translate(LOW))
    places = [
        (k, label) for phrase, label in PHRASES.items() for k in range(len(words)) if words[k : k + len(phrase.split())] == phrase.split()
    ]
    return len(words), sorted(places)


def licence_texts():
    rng = random.Random(8)
    pieces = "Under the MIT license LICENSE, apache License version 2 2.0 cc by nc BY-NC é ünder . ; \n - cc/by/nc MITs".split(" ")
    out = [" ".join(rng.choices(pieces, k=rng.randint(0, 60))) for _ in range(150)]
    return [*out, None, "", "under the mit license", "junder the mit license", "Cc by Nc", "é" * 500, out[0], "x " * 3000 + "under\n\n the... MIT license"]


def test_license_query_counts_every_place(spark, as_tables):
    texts = licence_texts()
    rows = [*enumerate(texts), (None, "CC BY NC"), (3, "cc by nc cc by nc")]
    got = QUERIES["op11_license_scan"](spark, as_tables(documents=documents(spark, rows))).collect()

    def digest(i, text):
        n, places = base_of(text)
        starts, labels = [k for k, _ in places], sorted({x for _, x in places})
        return i, n, len(places), min(starts, default=None), max(starts, default=None), ",".join(labels)

    assert Counter((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in got) == Counter(
        digest(i, t) for i, t in rows
    )
    for r in got:
        assert set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) and 0 <= r.score <= 1


@pytest.mark.parametrize("chunk", [7, 50, 1 << 20])
def test_license_matches_do_not_depend_on_the_chunk(monkeypatch, chunk):
    texts = [t or "" for t in licence_texts()]
    monkeypatch.setattr(licenses, "CHUNK", chunk)
    raw = np.frombuffer("".join(texts).encode(), np.uint8)
    ends = np.r_[0, np.cumsum([len(t.encode()) for t in texts])]
    words, found = licenses.matches(raw, ends, licenses.automaton())
    for k, text in enumerate(texts):
        assert (int(words[k]), sorted((w, label) for t, w, kind, label, _ in found if t == k and kind == "base")) == base_of(text)


@pytest.mark.parametrize(
    "written, labels, burden",
    [
        ("MIT", ["mit"], licenses.PERMISSIVE),
        ("MIT OR GPL-3.0-only", ["mit", "gpl-3"], licenses.PERMISSIVE),
        ("MIT AND GPL-3.0-or-later", ["mit", "gpl-3"], licenses.STRONG),
        ("MIT OR GPL-2.0+ AND AGPL-3.0", ["mit", "gpl-2", "agpl-3"], licenses.PERMISSIVE),
        ("(MIT OR GPL-2.0) AND MPL-2.0", ["mit", "gpl-2", "mpl-2"], licenses.WEAK),
        ("GPL-2.0-only WITH Classpath-exception-2.0", ["gpl-2"], licenses.WEAK),
        ("MIT AND GPL-2.0 with Classpath-exception-2.0 */ int x", ["mit", "gpl-2"], licenses.WEAK),
        ("((((ISC))))", ["isc"], licenses.PERMISSIVE),
        ("LicenseRef-Own", ["licenseref-own"], licenses.UNKNOWN),
    ],
)
def test_license_expressions(written, labels, burden):
    steps = licenses.postfix(licenses.tokens(written.encode(), 0, len(written)))
    assert licenses.evaluate(steps, any_name=True)[:2] == (labels, burden)


@pytest.mark.parametrize("broken", ["", "MIT AND", "(MIT", "OR MIT", "()", "MIT OR (", "AND"])
def test_broken_expressions_say_nothing(broken):
    steps = licenses.postfix(licenses.tokens(broken.encode(), 0, len(broken)))
    assert not steps


def test_license_tags_in_texts(spark):
    rows = [
        (1, "// SPDX-License-Identifier: Apache-2.0 OR MIT\nint main;"), (2, '{"license": "BSD-3-Clause", "x": 1}'),
        (3, "license: see the file"), (4, "SPDX-License-Identifier: Foo-1.0"), (5, "GNU General Public License, version 3."),
        (6, "license = ISC\nSPDX-License-Identifier: (MIT"), (7, "nothing here"),
    ]
    got = {r.doc_id: (r.labels, r.expressions, r.score) for r in licenses.scan(documents(spark, rows)).collect()}
    assert got == {
        1: (["apache-2", "mit"], ["(apache-2.0 or mit)"], 0.25), 2: (["bsd-3"], ["bsd-3-clause"], 0.25), 3: ([], [], 0.0),
        4: (["foo-1.0"], ["foo-1.0"], licenses.UNKNOWN), 5: (["gpl-3"], [], 0.75), 6: (["isc"], ["isc"], 0.25), 7: ([], [], 0.0),
    }
    assert licenses.scan(documents(spark, [])).count() == 0


# -- spelling ------------------------------------------------------------------------------------------------------


def variants_of(n):
    """Brute force: every pair of words is compared."""

    def close(a, b):
        if abs(len(a) - len(b)) > 1 or a == b:
            return False
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b)) == 1
        a, b = sorted((a, b), key=len)
        return any(b[:k] + b[k + 1 :] == a for k in range(len(b)))

    near = {a: [b for b in n if close(a, b)] for a in n}
    form = {}
    for a, others in near.items():
        if others:
            best = min(others, key=lambda b: (-n[b], b))
            if n[best] >= 10 * n[a]:
                form[a] = best
    rows = set()
    for a in n:
        root = a
        while root in form:
            root = form[root]
        rows.add((a, form.get(a), root, n[a], len(near[a]), n[form[a]] if a in form else None))
    return rows


@pytest.mark.parametrize("part", [5, 40, 100_000])
def test_variants_of_words(spark, part):
    rng = random.Random(part)
    n = {}
    for base in ["aaaaaaa", "aaaaaaaa", "abababab", "kittenish", "bananas", "éàÿéàÿé", "aaaaaaab", "x" * 300]:
        n[base] = rng.choice([2, 50, 500, 5000])
        for _ in range(25):
            word = base
            for _ in range(rng.randint(1, 2)):
                k = rng.randrange(len(word))
                word = rng.choice([word[:k] + word[k + 1 :], word[:k] + rng.choice("abxé") + word[k:], word[:k] + rng.choice("abxé") + word[k + 1 :]])
            n[word] = rng.choice([2, 5, 20, 50, 200])
    rows = [(w, c // 2, 7) for w, c in n.items()] + [(w, c - c // 2, 8) for w, c in n.items()] + [(None, 3, 1)]
    got = spelling.variants(spark.createDataFrame(rows, "word string, n long, id int"), part=part).collect()
    assert len(got) == len(n) and {tuple(r) for r in got} == variants_of(n)


def test_chain_of_forms_and_hot_alphabet(spark):
    n = {"wordless": 10**9, "wordlesx": 10**7, "wordleyx": 10**5, "wordzeyx": 10**3, "qordzeyx": 2}
    n |= {"pattern" + c: 3 for c in string.ascii_lowercase}
    rows = list(n.items())
    assert {tuple(r) for r in spelling.variants(spark.createDataFrame(rows, "word string, n long"), part=3).collect()} == variants_of(n)


def test_spelling_query(spark, as_tables):
    rng = random.Random(2)
    words = ["Strasse", "straßen", "MITTELALTER", "mittelalter", "Ärgerlich", "international", "short", "don't", "überall", "été"]
    texts = [" ".join(rng.choices(words, k=rng.randint(0, 200))) for _ in range(40)] + [None, "", "z" * 5000, "z" * 5000]
    rows = [*enumerate(texts), (None, "international"), (3, "international international")]
    n = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            word = run.translate(LOW)
            h = zlib.crc32(f"{'' if i is None else i}:{word}".encode())
            if h % 31 == 0:
                word = word[: h % len(word)] + word[h % len(word) + 1 :]
            n[word] += len(word) >= 7
    n = {w: c for w, c in n.items() if c >= 2}
    got = QUERIES["op12_spelling_variants"](spark, as_tables(documents=documents(spark, rows))).collect()
    assert {tuple(r) for r in got} == variants_of(n) and len(n) > 8
    assert spelling.variants(spelling.noisy_words(documents(spark, []))).count() == 0


# -- whitening -----------------------------------------------------------------------------------------------------


def embeddings(spark, rows):
    return spark.createDataFrame([(i, v, 1, 2) for i, v in rows], "vec_id long, embedding array<float>, label int, n int")


def expected(vectors, k=8):
    x = np.floor(1024 * np.array(vectors, np.float32).astype(float)) + 100000
    n, sums = len(x), x.sum(0)
    apart = x - sums / n
    e, v = np.linalg.eigh(apart.T @ apart / n)
    e, v = e[::-1][:k], v[:, ::-1][:, :k]
    deviation = [sum((n * int(a) - int(s)) ** 2 for a, s in zip(row, sums)) for row in x]
    return n, deviation, apart @ v / np.sqrt(e), e / (np.square(apart).sum() / n)


def test_whitening_query(spark, as_tables):
    rng = np.random.default_rng(3)
    scale = np.logspace(0, -2, 20)
    vectors = (rng.normal(size=(300, 20)) * scale).astype(np.float32).tolist()
    vectors += [vectors[0]] * 150  # one vector holds a third of all rows
    bad = [None, [], [None] * 20, [math.nan] * 20, [math.inf] + [0.0] * 19, [1.0, 2.0]]
    rows = [*enumerate(vectors), *((1000 + k, v) for k, v in enumerate(bad)), (None, vectors[1]), (7, vectors[2])]
    good = [*vectors, vectors[1], vectors[2]]
    folder = as_tables(embeddings=embeddings(spark, rows).repartition(5))
    got = QUERIES["op13_embedding_whitening"](spark, folder).toPandas()
    n, deviation, whitened, explained = expected(good)
    ids = [*range(len(vectors)), None, 7]
    want = Counter((None if i is None else float(i), d) for i, d in zip(ids, deviation))
    for component, part in got.groupby("component"):
        assert len(part) == n and (part["n"] == n).all() and (part.identity_error < 1e-10).all()
        assert part.explained.iloc[0] == pytest.approx(explained[component - 1], rel=1e-9)
        assert Counter((None if math.isnan(i) else float(i), d) for i, d in zip(part.vec_id, part.deviation)) == want
        key = lambda pairs: np.array([w for _, w in sorted(pairs)])
        ours, theirs = key(zip(part.deviation, part.whitened)), key(zip(deviation, whitened[:, component - 1]))
        assert min(np.abs(ours - theirs).max(), np.abs(ours + theirs).max()) < 1e-8
    assert sorted(got.component.unique()) == list(range(1, 9))


@pytest.mark.parametrize("vectors", [[], [[1.0, 2.0]], [[1.0, 2.0]] * 5, [None, [math.nan]]])
def test_whitening_without_variance_gives_no_rows(spark, vectors):
    assert whitening.whiten(embeddings(spark, list(enumerate(vectors)))).count() == 0


def test_whitening_of_dependent_dimensions(spark):
    rng = np.random.default_rng(5)
    two = rng.normal(size=(50, 2))
    vectors = np.c_[two, two[:, 0], np.ones(50)].astype(np.float32)
    got = whitening.whiten(embeddings(spark, [(k, v.tolist()) for k, v in enumerate(vectors)])).collect()
    n, deviation, whitened, explained = expected(vectors, 2)
    assert {len(r.whitened) for r in got} == {2} and [int(r.deviation) for r in sorted(got)] == deviation
    ours = np.array([r.whitened for r in sorted(got)])
    assert np.abs(np.abs(ours) - np.abs(whitened)).max() < 1e-8 and got[0].identity_error < 1e-10
    assert got[0].explained == pytest.approx(list(explained))


def test_deviations_beyond_a_long_stay_exact(spark):
    rows = [(k, [float(v), 0.5]) for k, v in enumerate([0, 2**19, 2**20, 5])]
    wide = whitening.whiten(embeddings(spark, rows * 300))
    x = [1024 * v + 100000 for v in (0, 2**19, 2**20, 5)]
    total = 300 * sum(x)
    assert sorted({int(r.deviation) for r in wide.collect()}) == sorted((1200 * a - total) ** 2 for a in x)
    longs = whitening.per_component(wide).select("deviation").distinct().collect()
    assert {r[0] for r in longs} == {d if (d := (1200 * a - total) ** 2) < 2**63 else None for a in x}


def test_pivoted_cholesky_stops_at_the_rank():
    rng = np.random.default_rng(1)
    half = rng.normal(size=(3, 6))
    kept, rows = whitening.pivoted_cholesky(half.T @ half)
    assert len(kept) == 3 and np.allclose(rows.T @ rows, half.T @ half)
    assert np.allclose(np.tril(rows[:, kept], -1), 0)
    assert len(whitening.pivoted_cholesky(np.zeros((2, 2)))[0]) == 0
