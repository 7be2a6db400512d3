"""Building blocks against plain Python, without Spark."""

from __future__ import annotations

import math
import random

import numpy as np
import pyarrow as pa
import pytest

from millrace.llm import bytesets, languages, ngram_join, pages, paragraphs, shingles, suffixes, token_ids, toxicity, vectors

TEXTS = ["", "a", "One two, three four five six.", "one TWO three\nfour five six", "é è " * 9, None, "x" * 300, "  ", "a b c d"]


def words(text):
    out, word = [], b""
    for b in (text or "").encode():
        b = b + 32 if 65 <= b <= 90 else b
        if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128:
            word += bytes([b])
        elif word:
            out.append(word)
            word = b""
    return out + ([word] if word else [])


def shingle_set(text):
    w = words(text)
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def test_text_buffer_reads_slices_and_nulls():
    column = pa.array(TEXTS).slice(2, 5)
    raw, offsets = bytesets.text_buffer(column)
    got = [raw[s:e].tobytes().decode() for s, e in zip(offsets, offsets[1:])]
    assert got == [t or "" for t in TEXTS[2:7]]


def test_pieces_cover_all_rows_once():
    offsets = np.array([0, 5, 5, 900, 905, 910])
    spans = list(bytesets.pieces(offsets, 10))
    assert spans[0][0] == 0 and spans[-1][1] == 5 and all(a[1] == b[0] for a, b in zip(spans, spans[1:]))


@pytest.mark.parametrize("length", [1, 2, 5, 32, 100])
def test_gram_hashes_name_equal_bytes_alike(length):
    raw = np.frombuffer(b"abcabcabd" * 40, np.uint8)
    codes = bytesets.gram_hashes(raw, length)
    names = {}
    for i, c in enumerate(codes.tolist()):
        assert names.setdefault(raw[i : i + length].tobytes(), c) == c
    assert len(set(names.values())) == len(names)


def test_shingles_equal_the_word_sets():
    raw, offsets = bytesets.text_buffer(pa.array(TEXTS))
    codes, where = shingles.shingle_codes(raw, offsets)
    sets = [set(codes[s:e].tolist()) for s, e in zip(where, where[1:])]
    assert [len(s) for s in sets] == [len(shingle_set(t)) for t in TEXTS]
    assert sets[2] == sets[3]


def test_exact_near_is_jaccard():
    rng = random.Random(1)
    sets = [sorted(rng.sample(range(60), 40)) for _ in range(30)] + [list(range(50)), list(range(50)), list(range(1, 50))]
    near = shingles.exact_near([np.array(s, np.uint64).tobytes() for s in sets], 0.8)
    for i, a in enumerate(sets):
        for j, b in enumerate(sets):
            assert near[i, j] == (len(set(a) & set(b)) >= 0.8 * len(set(a) | set(b)))


def test_near_pairs_are_jaccard():
    rng = random.Random(1)
    sets = [sorted(rng.sample(range(60), rng.randint(30, 50))) for _ in range(40)] + [list(range(50)), list(range(50)), list(range(1, 50)), []]
    cells = pa.chunked_array([[np.array(s, np.uint64).tobytes() for s in sets]], pa.binary())
    left, right = shingles._pairs(np.array([0, 20]), np.array([20, len(sets) - 20]))
    assert len(left) == 20 * 19 // 2 + 24 * 23 // 2
    a, b = shingles.near_pairs(cells, left, right, 0.8, 1000)
    jaccard = lambda i, j: len(set(sets[i]) & set(sets[j])) / max(1, len(set(sets[i]) | set(sets[j])))
    near = {(i, j) for i, j in zip(left.tolist(), right.tolist()) if jaccard(i, j) >= 0.8}
    assert set(zip(a.tolist(), b.tolist())) == near and (40, 41) in near


def test_shingles_do_not_depend_on_who_finds_the_words():
    raw, edges = bytesets.text_buffer(pa.array(TEXTS))
    ends, text, _, start, codes = paragraphs._cut_up(raw, edges)
    got = shingles.gram_sets(codes, np.searchsorted(ends, start, "right") - 1, len(text), short=False)
    for x, y in zip(got, shingles.shingle_codes(raw, ends, short=False)):
        assert x.tolist() == y.tolist()


def test_shingle_order_holds_where_leading_bits_agree(monkeypatch):
    monkeypatch.setattr(shingles, "mix", lambda h: h & np.uint64(7))
    raw, edges = bytesets.text_buffer(pa.array([" ".join(f"w{k}" for k in range(300)), "a b c d e f g"]))
    codes, where = shingles.shingle_codes(raw, edges)
    assert codes[: where[1]].tolist() == sorted(set(codes[: where[1]].tolist())) and where[1] > 1 and where[-1] == len(codes)


def test_chosen_paths_reach_the_recall():
    rng = np.random.default_rng(5)
    missed = 0
    for _ in range(300):
        both = rng.integers(0, 2**63, 160).astype(np.uint64)
        a, b = (np.sort(np.r_[both, rng.integers(0, 2**63, 20).astype(np.uint64)]) for _ in range(2))
        tokens, ends = ngram_join.chosen(np.r_[a, b], np.array([0, 180, 360]), 0.8, 0.9999)
        missed += not set(tokens[: ends[1]].tolist()) & set(tokens[ends[1] :].tolist())
    assert missed <= 1


def test_bands_hold_the_recall():
    rows = paragraphs.bands(0.8, 0.9995)
    assert 1 - (1 - 0.8**rows) ** (shingles.SKETCH // rows) >= 0.9995


def test_anchors_choose_every_start_once_and_alike():
    rng = random.Random(2)
    text = bytes(rng.choices(b"abcd ", k=700))
    raw = np.frombuffer(text + b"#" + text[200:500] + b"x" * 250, np.uint8)
    doc, anchor, first, last, _ = suffixes.anchors(raw, np.array([0, len(text) + 1, len(raw)]))
    starts = [p for f, l in zip(first, last) for p in range(f, l + 1)]
    assert starts == [p for lo, hi in ((0, len(text) + 1), (len(text) + 1, len(raw))) for p in range(lo, hi - 99)]
    offset = {}
    for a, f, l in zip(anchor, first, last):
        for p in range(f, l + 1):
            assert offset.setdefault(raw[p : p + 100].tobytes(), a - p) == a - p


def test_multikey_order_groups_equal_strings_stably():
    raw = np.frombuffer(bytes(random.Random(3).choices(b"ab", k=400)), np.uint8)
    heads, owner = np.arange(300), np.arange(300) % 2
    order, fresh = suffixes.multikey_order(heads, owner, raw, 7)
    keys = [(owner[k], raw[heads[k] : heads[k] + 7].tobytes()) for k in order]
    assert keys == sorted(keys)
    assert [bool(f) for f in fresh] == [i == 0 or keys[i] != keys[i - 1] for i in range(300)]
    assert all(order[i] > order[i - 1] for i in range(1, 300) if not fresh[i])


def test_pack_is_undone_by_unpack():
    ranks = np.array([0, 255, 256, 65535, 65536, 2**24 - 1, 2**24, 2**32 - 1, 7])
    for n in range(len(ranks) + 1):
        assert token_ids.unpack(*token_ids.pack(ranks[:n]), n).tolist() == ranks[:n].tolist()


def test_paragraphs_are_cut_by_their_own_words():
    rng = random.Random(6)
    texts = [" ".join(rng.choices("aa b cc d ee f gg h".split(), k=rng.randint(0, 90))) for _ in range(30)] + ["", "  ", "one", "a\n\nb\n", "é é é é é é\n" * 20]
    raw = "".join(texts).encode()
    edges = np.r_[0, np.cumsum([len(t.encode()) for t in texts])]
    found, owner, place, words = paragraphs.paragraphs(np.frombuffer(raw, np.uint8), edges)
    assert found[0] == 0 and found[-1] == len(raw) and set(edges[:-1][np.diff(edges) > 0]) <= set(found.tolist())
    for k, text in enumerate(texts):
        want, total, at = [], 0, 0
        for line in text.split("\n"):
            one = line.encode()
            start, _, codes = paragraphs._words(np.frombuffer(one, np.uint8), np.array([0, len(one)]))
            after = [*codes.tolist()[1:], 0]
            pair = [int(bytesets.mix(np.array([(c * bytesets.BASE + n) % 2**64], np.uint64))[0]) for c, n in zip(codes.tolist(), after)]
            r, total = paragraphs.REACH, total + len(start)
            inside = [start[i] for i in range(r, len(pair) - r) if all(pair[i] < x for x in pair[i - r : i]) and all(pair[i] <= x for x in pair[i + 1 : i + 1 + r])]
            if at < len(text.encode()):
                want += [at, *(at + x for x in inside)]
            at += len(one) + 1
        mine = np.flatnonzero(owner == k)
        assert (found[mine] - edges[k]).tolist() == want
        assert place[mine].tolist() == list(range(len(mine))) and int(words[mine].sum()) == total


def test_runs_count_the_words_of_neighbours():
    words = np.array([12, 9, 9, 30, 5, 10, 10])
    assert paragraphs.runs(np.array([0, 1, 3, 5, 6]), words).tolist() == [True, True, True, True, True]
    assert paragraphs.runs(np.array([0, 2, 4, 5]), words).tolist() == [False] * 4
    assert paragraphs.runs(np.zeros(0, np.int64), words).tolist() == []


def test_cells_are_undone_per_document():
    rng = np.random.default_rng(4)
    for counts in ([0, 1, 5, 4, 0, 7], [0], [3], [8, 0, 0, 1]):
        edges = np.r_[0, np.cumsum(counts)]
        ranks = (2 ** rng.uniform(0, 32, edges[-1])).astype(np.uint32)
        raw, offsets = bytesets.text_buffer(token_ids.pack_each(ranks, edges))
        assert token_ids.unpack_each(raw, offsets, np.array(counts)).tolist() == ranks.tolist()
        for k in range(len(counts)):
            one = token_ids.unpack_each(raw[offsets[k] : offsets[k + 1]], np.array([0, offsets[k + 1] - offsets[k]]), np.array(counts[k : k + 1]))
            assert one.tolist() == ranks[edges[k] : edges[k + 1]].tolist()


def test_encoder_equals_the_whole_text_tokenizer():
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    encode, plain = token_ids.Encoder(path, cache=5), Tokenizer.from_file(path)
    odd = ["  a  b \n c", "\n  x \t y  ", "a\n b", " ", "x  ", "don't 's  b", "a　b\x1c c", "1 2  3\n\n4 <|endoftext|> z",
           "Straße, été... ÀÖ!? word's a,b ß. ×a ÷ b", "end.\nNext, one.\n\nThird", "中文 字 ok", *[t for t in TEXTS if t]]
    for text in odd:
        assert np.frombuffer(encode(text), "<u4").tolist() == plain.encode(text, add_special_tokens=False).ids, text


def test_encoder_learns_each_unit_of_many_texts_once(monkeypatch):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    plain, learnt = Tokenizer.from_file(path), []
    held = token_ids.Encoder._learn
    monkeypatch.setattr(token_ids.Encoder, "_learn", lambda self, units, simple: learnt.extend(units.to_pylist()) or held(self, units, simple))
    texts = ["the end. The end, the\nend", "", "The end.\nthe end", "'", "the end"]
    signs = ["a", "The", "é", "×", " ", " ", "\n", "\t", "\x1c", "\x85", "\u2003", "\u3000", "’", "'", "'s", ".", ",", "1", "中", "<|endoftext|>", "\x7f"]
    rng = random.Random(8)
    for limit, some in ((1000, texts), *((9, ["".join(rng.choices(signs, k=rng.randint(0, 25))) for _ in range(6)]) for _ in range(200))):
        encode = token_ids.Encoder(path, cache=limit)
        for _ in range(2):
            raw = "".join(some).encode()
            edges = np.r_[0, np.cumsum([len(t.encode()) for t in some])]
            ids, counts = encode.batch(np.frombuffer(raw, np.uint8), edges)
            ends = np.r_[0, np.cumsum(counts)]
            for k, text in enumerate(some):
                assert ids[ends[k] : ends[k + 1]].tolist() == plain.encode(text, add_special_tokens=False).ids, text
            if some is texts:
                assert len(learnt) == len(set(learnt)) and {b"the", b" end", b".", b"\n"} <= set(learnt)


def test_code_lengths_are_those_of_the_context_tree():
    samples = {"x": [b"abab abc"], "y": [b"zzz yz"]}
    model = languages.fit(samples)
    raw = np.frombuffer(b"abq", np.uint8)
    got = languages.code_lengths(model, raw, np.array([0, 3]))[0]
    assert got[0] < got[1]
    counts = {c: b"abab abc".count(c) for c in (b"a", b"b", b" ", b"c")}
    lone = languages.code_lengths(model, np.frombuffer(b"c", np.uint8), np.array([0, 1]))[0][0]
    # Only "a" was seen at the start of a text: escape from that context (one visit, one byte), twice deeper ones alike.
    order0 = -math.log2(counts[b"c"] / (8 + 4))
    assert lone == pytest.approx(-2 * math.log2(1 / 2) + order0, abs=1e-4)


def test_windows_keep_every_word():
    text = ("The quick. brown fox! " * 20).encode()
    joined = b"".join(w[:-1] for w in toxicity.windows(text)) + b" "
    assert joined == toxicity.folded(text)


def test_main_text_leaves_the_rest_out():
    page = (
        "<html><head><title>T</title><style>p{}</style></head><body><nav><a href=/>Home</a></nav><article><h1>A &amp; B</h1>"
        "<p><b>First one.<br><p>Second\n  one <a href=x>here</a>.</p><div class='comments'><p>Nice post, really.</p></div>"
        "<aside>More</aside></article><div class=ad>Buy this now, please.</div><footer>&copy; x</footer>"
    )
    assert pages.extract(page, pages.fit([page] * 3)) == "A & B\nFirst one.\nSecond one here."
    assert pages.extract("", pages.Model()) == "" and pages.extract("<p", pages.Model()) == ""


def test_messages_are_exact_marginals():
    page = "<body><div><p>Some words are here, indeed.</p><a>x</a></div><nav>y</nav></body>"
    tree, model = pages.parse(page), pages.Model()
    n = len(tree.parent)
    mass = np.zeros((n, 2))
    for state in range(2 ** (n - 1)):
        s = [0, *(state >> k & 1 for k in range(n - 1))]
        logp = sum(model.step[tree.kind[k], s[tree.parent[k]], s[k]] + model.looks[s[k], tree.look[k]] for k in range(1, n))
        for k in range(n):
            mass[k, s[k]] += math.exp(logp)
    odds = pages.marginals(tree, model)
    assert np.allclose(odds[1:], np.log(mass[1:, 1] / mass[1:, 0]))


def test_near_cells_lose_no_pair():
    rng = np.random.default_rng(8)
    base = rng.normal(size=(60, 4))
    points = np.r_[base, base + rng.normal(scale=0.05, size=base.shape)]
    points /= np.linalg.norm(points, axis=1, keepdims=True)
    pivots = points[:7]
    home, near = vectors._near_cells(points, pivots, math.sqrt(2 - 2 * 0.95))
    cells = [{int(h), *n.tolist()} for h, n in zip(home, near)]
    for i in range(120):
        for j in range(i):
            if points[i] @ points[j] >= 0.95:
                assert min(home[i], home[j]) in cells[i] & cells[j]


def test_coincident_pivots_lose_no_pair():
    rng = np.random.default_rng(9)
    lost = 0
    for _ in range(40):
        one = rng.normal(size=64).astype(np.float32)
        twins = np.repeat(one[None, :], 4, 0)
        twins[[1, 2, 3], rng.integers(0, 64, 3)] *= np.float32(1) + np.finfo(np.float32).eps
        pivots = twins.astype(float)
        pivots /= np.linalg.norm(pivots, axis=1, keepdims=True)
        points = one + rng.normal(scale=0.1, size=(40, 64))
        points /= np.linalg.norm(points, axis=1, keepdims=True)
        home, near = vectors._near_cells(points, pivots, math.sqrt(2 - 2 * 0.95))
        cells = [{int(h), *n.tolist()} for h, n in zip(home, near)]
        for i, j in zip(*np.nonzero(points @ points.T >= 0.95)):
            lost += min(home[i], home[j]) not in cells[i] & cells[j]
        assert len(vectors._distinct(np.r_[pivots, -pivots])) == 2
    assert lost == 0


@pytest.mark.parametrize("before", [
    "<head><title>T</title><meta name=a content=b>",
    "<head><title>T</title><body>",
    "<head><script>for(;i<n;i++){f()}</script></head>",
    "<head><script>for(;i<n;i++){f()}</script>",
    "<head><style>a:after{content:'<!--'}</style></head>",
    "<script>if(a<b)x='<p';</SCRIPT\n>",
    "<script>s='</scripts>'</script>",
    "<svg><svg><text>No label.</text></svg><text>No label either.</text></svg>",
    "<svg><foreignObject><p>No label.</p></foreignObject></svg>",
    "<svg><path d=''>", "<svg/>", "<noscript>", "<template><p>No.</p><template></template><p>No.</p></template>",
    "<select><option>No.</select>", "<textarea>if a<b then</textarea>",
])
def test_skipped_elements_end_where_they_should(before):
    said = "Some words of the main text stand here, and they are long enough."
    page = f"<html>{before}<article><p>{said}</p></article>"
    assert pages.extract(page, pages.Model()) == said


def test_unpaired_hidden_elements_hide_no_more_than_one_end_tag():
    said = "Some words of the main text stand here, and they are long enough."
    page = "<object><object>x</object>" + f"<article><p>{said}</p></article>" + "<object>" * 3000
    assert pages.extract(page, pages.Model()) == said
    assert pages.extract("<script>var a = 1 < 2;", pages.Model()) == ""
