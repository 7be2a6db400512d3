"""Operators over hand-made tables: nulls, empty and long texts, ties, repeated rows, empty tables, clashing columns."""

from __future__ import annotations

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

import corpus_pipeline
from millrace.llm import decontaminate, languages, mixing, ngram_join, pages, paragraphs, shingles, suffixes, token_ids, toxicity, vectors
from millrace.llm.components import components
from millrace.llm.frames import reach_workers
from test_llm_kernels import shingle_set

DOCS = "doc_id long, text string, lang string, source string, n_chars long, score double, at int, size string"


@pytest.fixture(scope="module", autouse=True)
def workers(spark):
    reach_workers(spark)


def table(spark, rows):
    full = [(i, t, lang, src, len(t or ""), 0.5, 1, "x") for i, t, lang, src in rows]
    return spark.createDataFrame(full, DOCS)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(4)
    vocabulary = ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=rng.randint(2, 9))) for _ in range(600)]
    say = lambda n: " ".join(rng.choices(vocabulary, k=n)).capitalize() + "."
    passage, long = say(70), "\n".join(say(40) for _ in range(60))
    out = [(0, None, "en", "a"), (1, "", "en", None), (2, "Hi.", None, "b"), (3, say(80), "en", "a")]
    base = say(120)
    for k in range(12):  # near copies and exact copies
        words = base.split()
        words[5 * k + 3] = "changed"
        out.append((10 + k, " ".join(words) if k % 3 else base, "en", "abc"[k % 3]))
    out += [(30 + k, f"{say(50)}\n{passage}\n{say(30)}", "de", "hot") for k in range(5)]
    out += [(40, long, "en", "hot"), (41, long, "en", "hot"), (3, out[3][1], "en", "a"), (42, "é" * 400, "fr", "a"), (43, "!!! ??", "fr", "a")]
    return out


def test_components(spark):
    links = [(k, k + 1) for k in range(20, 0, -1)] + [(50, 60), (60, 70), (5, 5)]
    got = {r.id: r.root for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**{k: 1 for k in range(1, 22)}, 50: 50, 60: 50, 70: 50}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_mixing(spark, rows):
    docs = table(spark, rows)
    got = mixing.plan(docs).collect()
    assert len(got) == len(rows)
    sizes = Counter()
    for _, t, _, s in rows:
        sizes[s] += len((t or "").split())
    names = sorted((s for s in sizes if s is not None)) + [None]
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(names)}
    goal, open_ = {}, set(names)
    left = 1.5 * sum(sizes.values())
    while open_:  # share by weight, take out what is full, share the rest again
        level = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if level * weight[s] >= 2 * sizes[s]}
        for s in full or open_:
            goal[s] = 2 * sizes[s] if full else level * weight[s]
        left -= sum(2 * sizes[s] for s in full)
        open_ = open_ - full if full else set()
    taken = Counter()
    for r in got:
        assert r.target == pytest.approx(goal[r.source]) and r.source_size == sizes[r.source] and 0 <= r.taken <= 2 * r.size
        taken[r.source] += r.taken
    assert all(taken[s] == int(goal[s] + 1e-9) for s in names)
    again = mixing.plan(docs.repartition(7)).collect()
    assert Counter(map(tuple, got)) == Counter(map(tuple, again))
    mixed = mixing.mixed(docs)
    assert mixed.columns == docs.columns
    words = Counter()
    for r in mixed.collect():
        words[r.source] += len(r.text.split())
    assert all(abs(words[s] - taken[s]) <= 1 for s in names)
    assert mixing.plan(table(spark, [])).count() == 0 and mixing.mixed(table(spark, [])).count() == 0


def test_language(spark, rows):
    docs = table(spark, rows)
    model = languages.train(docs)
    got = languages.predict(docs, model).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)
    by_id = {r.doc_id: r.lang_pred for r in got}
    assert {by_id[k] for k in (0, 1, 43)} == {"und"} and by_id[40] == "en"
    nothing = languages.predict(docs, languages.train(table(spark, [])))
    assert {r.lang_pred for r in nothing.collect()} == {"und"}


def test_token_files(spark, rows):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    tok = Tokenizer.from_file(path)
    rows = [*rows, (90, "end <|endoftext|> of", "en", "a"), (91, "<|endoftext|>\n <|endoftext|>  x", "en", "a"), (92, " " * 3000, "en", "a")]
    got = sorted(token_ids.round_trip(table(spark, rows), path).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in got] == sorted(i for i, *_ in rows)
    texts, start = {i: t for i, t, *_ in rows}, 0
    for r in got:
        ids = [*tok.encode(texts[r.doc_id] or "", add_special_tokens=False).ids, 2]
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    assert token_ids.round_trip(table(spark, []), path).count() == 0


def test_vectors(spark):
    rng = np.random.default_rng(3)
    base = rng.normal(size=(40, 8))
    data = [(k, v.tolist(), 1) for k, v in enumerate(np.r_[base, base[:20] * 3, base[5:9] + rng.normal(scale=0.05, size=(4, 8))])]
    data += [(100, None, 1), (101, [0.0] * 8, 1), (102, [float("nan")] * 8, 1), (103, [1.0, None], 1), (104, [], 1), (105, [1.0, 2.0], 1),
             (106, [2.0, 4.0], 0), (5, data[5][1], 1), (None, [1.0, 2.0], 1), (107, [float("inf"), 1.0], 1)]
    frame = spark.createDataFrame(data, "vec_id long, embedding array<double>, label int")
    got = {r.vec_id: r for r in vectors.near_vectors(frame).collect()}
    fine = {i: np.array(v) / np.linalg.norm(v) for i, v, _ in data if i is not None and (i < 100 or i in (105, 106))}
    links = {i: {j for j in fine if j != i and len(fine[i]) == len(fine[j]) and fine[i] @ fine[j] >= 0.95} for i in fine}
    assert set(got) == {i for i, *_ in data}
    for i, r in got.items():
        reach, todo = {i}, [i]
        while todo:
            for j in links.get(todo.pop(), ()):
                if j not in reach:
                    reach.add(j)
                    todo.append(j)
        want = None if i is None else min(reach)
        assert (r.n_links, r.component_id, r.kept) == (len(links.get(i, ())), want, want == i), i
    assert vectors.near_vectors(frame.limit(0)).count() == 0


def test_pages(spark):
    page = "<body><nav><a>Menu</a></nav><article><h1>Top</h1><p>It is &lt;so&gt;, and long enough to read.</p></article></body>"
    frame = spark.createDataFrame([(1, "u", page, "t"), (2, None, None, "t"), (3, "v", "", "t"), (1, "u", page, "t")], "page_id long, url string, html string, text string")
    got = sorted(map(tuple, pages.main_texts(frame, pages.train(frame)).collect()))
    text = "Top\nIt is <so>, and long enough to read."
    assert got == [(1, "u", text, len(text))] * 2 + [(2, None, "", 0), (3, "v", "", 0)]
    assert pages.main_texts(frame.limit(0), pages.train(frame.limit(0))).count() == 0


def test_suffixes(spark, rows):
    unique = [r for k, r in enumerate(rows) if r[0] not in {x[0] for x in rows[:k]}] + [(60, "ab" * 300, "en", "a"), (None, rows[3][1], "en", "a")]
    got = {r.doc_id: r for r in suffixes.remove_repeats(table(spark, unique)).collect()}
    seen: set[bytes] = set()
    for i, text, *_ in sorted(unique, key=lambda r: (r[0] is not None, r[0])):
        body = (text or "").encode()
        gone = bytearray(len(body))
        for p in range(len(body) - 99):
            if body[p : p + 100] in seen:
                gone[p : p + 100] = b"\1" * 100
            seen.add(body[p : p + 100])
        kept = bytes(b for b, g in zip(body, gone) if not g)
        spans = sum(1 for p in range(len(gone)) if gone[p] and not (p and gone[p - 1]))
        r = got[i]
        assert (r.n_bytes, r.n_removed, r.n_spans, hashlib.sha256(r.kept).digest()) == (len(body), sum(gone), spans, hashlib.sha256(kept).digest()), i
    twice = suffixes.remove_repeats(table(spark, [(3, rows[3][1], "en", "a")] * 2)).collect()
    assert sorted(r.n_removed == r.n_bytes for r in twice) == [False, True]
    assert suffixes.remove_repeats(table(spark, [])).count() == 0


def jaccard_classes(sets):
    links = {i: {j for j in sets if j != i and sets[i] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])} for i in sets}
    root = {}
    for i in sorted(sets):
        if i not in root:
            todo = [i]
            while todo:
                k = todo.pop()
                if k not in root:
                    root[k] = i
                    todo += links[k]
    return links, root


def test_ngram_join(spark, rows):
    got = {r.doc_id: r for r in ngram_join.join(table(spark, [*rows, (None, "x y z", "en", "a")])).collect()}
    links, root = jaccard_classes({i: shingle_set(t) for i, t, *_ in rows})
    assert set(got) == set(root)
    for i, r in got.items():
        assert (r.n_links, r.component_id, r.kept) == (len(links[i]), root[i], root[i] == i), i
    kept = ngram_join.keep_one(table(spark, rows)).collect()
    assert {r.doc_id for r in kept} == {i for i in root if root[i] == i}
    assert ngram_join.join(table(spark, [])).count() == 0


def test_decontaminate(spark, rows):
    texts = {i: t for i, t, *_ in rows}
    inner = " ".join(texts[3].split()[20:45])
    items = [(7, inner.upper(), 1), (8, "Hi", 1), (9, None, 1), (10, "", 1), (None, inner, 1), (70, inner, 1), (11, "never seen in any text at all, not once, really", 1)]
    bench = spark.createDataFrame(items, "item_id long, text string, doc_id int")
    got = decontaminate.report(table(spark, rows), bench).collect()
    assert len(got) == len(rows)
    for r in got:
        words = [w.decode() for w in _words(texts[r.doc_id])]
        hit, found = set(), set()
        for i, t, _ in items:
            mine = [w.decode() for w in _words(t)]
            n = min(10, len(mine))
            wins = {tuple(mine[k : k + n]) for k in range(len(mine) - n + 1)} if n and i is not None else set()
            for k in range(len(words) - n + 1):
                if tuple(words[k : k + n]) in wins:
                    hit |= set(range(k, k + n))
                    found.add(str(i))
        digest = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
        assert (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) == (len(words), len(hit), len(found), digest, bool(hit)), r.doc_id
    clean = decontaminate.keep_clean(table(spark, rows), bench).collect()
    assert Counter(r.doc_id for r in clean) == Counter(i for i, *_ in rows if i not in (2, 3))
    assert not any(r.contaminated for r in decontaminate.report(table(spark, rows), bench.limit(0)).collect())
    assert decontaminate.report(table(spark, []), bench).count() == 0


def _words(text):
    from test_llm_kernels import words

    return words(text)


def test_paragraphs(spark, rows):
    unique = {i: t for i, t, *_ in rows}
    got = {r.doc_id: r for r in paragraphs.remove_near_copies(table(spark, [*((i, t, "en", "a") for i, t in unique.items()), (None, "q r s", "en", "a")])).collect()}
    parts = {i: stretches(t) for i, t in unique.items()}
    sets = {(i, k): shingle_set(part) for i, held in parts.items() for k, part in enumerate(held) if len(_words(part)) >= 5}
    _, root = jaccard_classes(sets)
    copies = defaultdict(list)
    for (i, k), first in root.items():
        if first != (i, k):
            copies[i].append(k)
    for i, t in unique.items():
        gone, run = [], []
        for k in [*sorted(copies[i]), 10**9]:  # runs of neighbouring copies
            if run and k != run[-1] + 1:
                gone += run if sum(len(_words(parts[i][x])) for x in run) >= 20 else []
                run = []
            run.append(k)
        kept = "".join(x for k, x in enumerate(parts[i]) if k not in gone)
        assert (got[i].n_paragraphs, list(got[i].removed), got[i].kept) == (len(parts[i]), gone, kept), i
    assert any(r.n_removed for r in got.values()) and paragraphs.remove_near_copies(table(spark, [])).count() == 0


def stretches(text):
    """The paragraphs of a text; ``test_paragraphs_are_cut_by_their_own_words`` holds the cuts themselves."""
    if text is None:
        return []
    raw = text.encode()
    edges = paragraphs.paragraphs(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))[0].tolist() if raw else [0, 0]
    return [raw[i:j].decode() for i, j in zip(edges, edges[1:])]


def test_passages_over_lines_and_inside_lines_are_found(spark):
    rng = random.Random(12)
    vocabulary = ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=rng.randint(2, 9))) for _ in range(3000)]
    say = lambda n: rng.choices(vocabulary, k=n)
    rows = []
    for p in range(24):
        passage = say(60)
        over_lines = [*passage[:20], "\n", *passage[20:40], "\n", *passage[40:]]
        for k in range(2):  # on lines of its own, or inside a line of 200 words
            words = over_lines if p % 2 else [*say(70), *passage, *say(70)]
            rows.append((10 * p + k, f"{' '.join(say(30))}\n{' '.join(words)}\n{' '.join(say(25))}", "en", "a"))
    stock = " ".join(say(8))
    rows += [(500 + k, f"{' '.join(say(40))}\n{stock}\n{' '.join(say(40))}", "en", "a") for k in range(30)]
    texts = {i: t for i, t, *_ in rows}
    got = {r.doc_id: r for r in paragraphs.remove_near_copies(table(spark, rows)).collect()}
    later = [got[10 * p + 1] for p in range(24)]
    assert sum(r.n_removed > 0 for r in later) >= 0.9 * len(later)
    assert all(got[10 * p].n_removed == 0 for p in range(24)) and all(got[500 + k].n_removed == 0 for k in range(30))
    assert all(r.keepers == [r.doc_id - 1] and len(r.kept) < len(texts[r.doc_id]) for r in later if r.n_removed)


def test_toxicity(spark):
    rng = random.Random(9)
    vocabulary = ["".join(rng.choices("aeioustrnl", k=rng.randint(3, 8))) for _ in range(200)]
    say = lambda n: rng.choices(vocabulary, k=n)
    rows, labels = [], []
    for k in range(400):
        bad = k % 5 == 0
        words = say(60)
        if bad:
            for at in (10, 25, 40):
                words.insert(at, "vexgrumble")
        rows.append((k, " ".join(words), "en", "a"))
        labels.append((k, 1, int(bad)))
    rows += [(900, None, "en", "a"), (901, "", "en", "a"), (5, rows[5][1], "en", "a")]
    marks = spark.createDataFrame([*labels, (None, 0, 1), (7, 0, None)], "doc_id long, quality int, toxic int")
    docs = table(spark, rows)
    model = toxicity.train(docs, marks)
    got = toxicity.score(docs, model).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)
    right = [(r.score >= 0.5) == (r.doc_id % 5 == 0) for r in got if r.doc_id < 900 and zlib.crc32(str(r.doc_id).encode()) % 5 == 0]
    assert sum(right) >= 0.95 * len(right)
    kept = toxicity.keep_ordinary(docs, model)
    assert kept.columns == docs.columns and {900, 901} <= {r.doc_id for r in kept.collect()}
    assert toxicity.keep_ordinary(docs, toxicity.train(docs, marks.limit(0))).count() == len(rows)


def test_pipeline_stages_chain(spark):
    sf = "/root/testdata/sf0.001"
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "ngram_jaccard_join", "benchmark_decontamination", "mixing", "token_ids"]
    docs = first = spark.read.parquet(f"{sf}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:3]:
        after = stage(spark, docs, sf)
        assert sorted(after.columns) == sorted(first.columns)
        docs = corpus_pipeline.cut(after, name)
    kept = {r.doc_id: r.text for r in docs.collect()}
    links, _ = jaccard_classes({i: shingle_set(t) for i, t in kept.items()})
    assert not any(links.values())
    assert not any(r.contaminated for r in decontaminate.report(docs, spark.read.parquet(f"{sf}/benchmark.parquet")).collect())
    want = {r.doc_id for r in mixing.plan(docs).collect() if r.taken}
    assert {r.doc_id for r in corpus_pipeline.run(spark, sf).collect()} == want


def _marked(spark, n):
    rng = random.Random(12)
    vocabulary = ["".join(rng.choices("aeioustrnl", k=rng.randint(3, 8))) for _ in range(200)]
    rows, labels = [], []
    for k in range(n):
        words = rng.choices(vocabulary, k=30)
        if k % 10 == 0:
            words.insert(9, "vexgrumble")
        rows.append((k, " ".join(words), "en", "a"))
        labels.append((k, 1, int(k % 10 == 0)))
    return table(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_toxicity_odds_do_not_follow_the_caps(spark, monkeypatch):
    def share_only(rows, wanted):
        share = float(wanted.mean())
        return [float(np.log(share / (1 - share)))] + [0.0] * rows.shape[1], [0.0, 1.0] * rows.shape[1]

    monkeypatch.setattr(toxicity, "_calibrate", share_only)
    docs, marks = _marked(spark, 300)
    for cap in (10_000, 30):
        monkeypatch.setattr(toxicity, "TRAIN_ORDINARY", cap)
        scores = [r.score for r in toxicity.score(docs.limit(3), toxicity.train(docs, marks)).collect()]
        assert scores == pytest.approx([0.1] * 3, abs=0.02), cap


def test_training_takes_long_texts_where_short_ones_are_too_few(spark, monkeypatch):
    docs, marks = _marked(spark, 200)
    monkeypatch.setattr(toxicity, "TRAIN_BYTES", 50)
    assert toxicity.train(docs, marks).trained
    assert not toxicity.train(docs, marks.filter("toxic = 0")).trained
    monkeypatch.setattr(languages, "TRAIN_BYTES", 50)
    assert languages.train(docs).languages == ["en"]


def test_paragraph_bands_are_shuffled_one_at_a_time(spark, rows, monkeypatch):
    written, plain = [], paragraphs.cut

    def watched(df, label="cut"):
        written.append((label, df._jdf.queryExecution().toString()))
        return plain(df, label)

    monkeypatch.setattr(paragraphs, "cut", watched)
    assert paragraphs.remove_near_copies(table(spark, rows)).count() == len(rows)
    count = paragraphs.SKETCH // paragraphs.bands(0.8, paragraphs.RECALL)
    assert [label for label, _ in written].count("shared") == count > 1
    assert not any("Generate explode" in text for label, text in written if label == "shared")


def test_stages_leave_texts_in_place_when_few_documents_go(spark, rows):
    docs = table(spark, [(k, t, *rest) for k, (_, t, *rest) in enumerate(rows)])
    benchmark = spark.createDataFrame([("x", rows[3][1])], "item_id string, text string")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for kept in (ngram_join.keep_one(docs), decontaminate.keep_clean(docs, benchmark)):
            assert 0 < kept.count() < len(rows)
            plan = kept._jdf.queryExecution().executedPlan().toString()
            assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def phrase_sets(groups=2, size=420):
    """(root, id, codes): sets of a group share a phrase and hardly anything else; some are near copies."""
    rng, out, sets = random.Random(11), [], {}
    for g in range(groups):
        phrase, last = rng.sample(range(10**6), 10), []
        for k in range(size):
            if k % 6 == 5:  # near the one before: one or two shingles of twenty differ
                own = last[: -rng.randint(1, 2)] + [rng.randrange(10**6, 10**9)]
            elif k % 2:  # alike but for one shingle, and there are many of them
                own = [*range(g * 100, g * 100 + 19), rng.randrange(10**6, 10**9)]
            else:
                own = phrase + [rng.randrange(10**6, 10**9) for _ in range(10)]
            last = own
            sets[g * 1000 + k] = set(own)
            out.append((g, g * 1000 + k, np.sort(np.array(list(set(own)), np.uint64)).tobytes()))
    return out, sets


def test_large_groups_meet_by_their_rare_shingles_and_lose_no_pair(spark):
    rows, sets = phrase_sets()
    rows += [(7, 7000, rows[0][2]), (7, 7001, rows[0][2]), (8, 8000, rows[0][2])]  # groups of their own
    table = spark.createDataFrame(rows, "root long, id long, codes binary")
    table = paragraphs.cut(table)
    buckets = defaultdict(set)
    for r in paragraphs._places(table, 0.8).collect():
        buckets[r.bucket].add(r.id)
    near = {
        (a, b) for a in sets for b in sets
        if a < b and a // 1000 == b // 1000 and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])
    }
    met = {(a, b) for held in buckets.values() for a in held for b in held if a < b}
    assert near | {(7000, 7001)} <= met and (0, 7000) not in met
    phrased = [i for i in sets if i % 1000 % 6 != 5 and i % 2 == 0]
    assert not any(a in phrased and b in phrased for a, b in met)  # a phrase alone brings no two sets together
    blocks = shingles.in_blocks(paragraphs._places(table, 0.8), "bucket", 50).join(table.select("id", "codes"), "id")
    roots = {r.id: r.root for r in components(shingles.near_links(blocks, "bucket", 0.8)).collect()}
    assert roots == {r.id: r.root for r in components(spark.createDataFrame(sorted(near | {(7000, 7001)}), "a long, b long")).collect()}


def test_a_stock_phrase_does_not_compare_all_paragraphs_that_hold_it(spark, monkeypatch):
    rng, dealt, plain = random.Random(3), [], shingles.in_blocks
    word = lambda: "".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=9))
    phrase = " ".join(word() for _ in range(14))
    docs = [(k, f"{phrase} {' '.join(word() for _ in range(5))}", "en", "a") for k in range(200)]
    docs.append((200, docs[0][1] + " " + word(), "en", "a"))

    def watched(members, group, *size):
        dealt.append(Counter(r[group] for r in members.collect()))
        return plain(members, group, *size)

    monkeypatch.setattr(shingles, "in_blocks", watched)
    got = {r.doc_id: r for r in paragraphs.remove_near_copies(table(spark, docs)).collect()}
    assert len(got) == 201 and sum(n * n for n in dealt[0].values()) < 64 * 201


def test_classes_and_band_links_are_those_of_a_grouping(spark):
    rng = random.Random(8)
    ones = [rng.randrange(-(2**63), 2**63) for _ in range(60)]
    feats = []
    for k in range(3000):
        one = ones[rng.randrange(60)] if k % 3 else ones[0]
        two = one ^ (5 if k % 50 == 7 else 0)  # the first code alone does not make a class
        feats.append((rng.randrange(-3, 400), rng.randrange(2), rng.randrange(9), one, two, [-5, -6, 2**62, one][ones.index(one) % 4]))
    made = spark.createDataFrame(feats, "doc_id long, row long, line int, one long, two long, band0 long")
    made = paragraphs.cut(made.repartition(7))
    held = defaultdict(list)
    for doc_id, row, line, one, two, _ in feats:
        held[one, two].append((doc_id, row, line))
    got = {(r.one, r.two): (r.copies, tuple(r.first)) for r in paragraphs._classes(made).collect()}
    assert got == {k: (len(v), min(v)) for k, v in held.items()}
    values = defaultdict(set)
    for *_, one, _, band in feats:
        values[band].add(one)
    links = [tuple(r) for r in paragraphs._met(made, "band0").collect()]
    assert sorted(links) == sorted((min(v), one) for v in values.values() for one in v if one != min(v))
    assert paragraphs._met(paragraphs.cut(made.limit(0)), "band0").count() == 0
