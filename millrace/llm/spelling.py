"""Spelling variant grouping by a dictionary of trie-node pairs.

Two words are near if one inserted, deleted or replaced code point turns one into the other. The nodes of a trie of all
words and of a trie of all reversed words get integers. A word is then a row of pairs (prefix node, suffix node):
"skip" pairs leave out the code point between the two, "gap" pairs leave out none. Words that share a skip pair differ
by a replacement there; a skip pair of one word that is a gap pair of another is a deletion. No string is compared and
every pair is exact. Of a run of equal code points only the first is skipped as a deletion, so each near pair meets once.

Tries are numbered in sorted order, where a word adds only the nodes past its common start with the word before it.
Sampled splitters cut that order into parts of bounded size. Words on both sides of a splitter can only share proper
prefixes of the splitter itself, so those nodes (a bounded list on the driver) get common numbers and all other nodes
are numbered inside their part. A pair is shared by at most one word per code point of the alphabet and one word with
a gap there, so no group grows with the table; counts and the best neighbour are taken per group and then per word.

Defined cases: a null word is ignored and repeated rows of a word add up (``variants``); a null text has no words and
a null doc_id counts as empty text (``noisy_words``); words shorter than ``LEAST`` code points or met less than twice
are no words; ties between neighbours of equal n fall to the smaller word in code-point order; an empty table gives no
rows. Other columns are not read. Words of any length take part; a splitter is cut at ``SPLITTER`` code points, which
moves rows between tasks and never changes a result.
"""

from __future__ import annotations

import string
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.bytesets import tidy
from millrace.llm.frames import cut, tidy_shuffles

LEAST = 7
TWICE = 2
NOISE = 31
FACTOR = 10
#: Words per part of a trie, sampled words per part, and code points of a splitter.
PART = 20_000
SAMPLES = 8
SPLITTER = 256
ROWS_OUT = 50_000
_LOCAL = 40  # bits of a number inside a part
GAP, SKIP, DELETE = 0, 1, 2


def noisy_words(documents: DataFrame, *, least: int = LEAST, twice: int = TWICE, noise: int = NOISE) -> DataFrame:
    """(word, n): lower-cased letter runs; where ``noise`` divides the code of id and run, one code point is left out."""
    letters = rf"[A-Za-zÀ-ÿ]{{{least},}}"
    runs = documents.select(
        F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"),
        F.explode(F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(letters), F.lit(0))).alias("run"),
    )
    low = runs.select("id", F.translate("run", string.ascii_uppercase, string.ascii_lowercase).alias("run"))
    coded = low.select("run", F.crc32(F.concat_ws(":", "id", "run").cast("binary")).alias("h"), F.char_length("run").alias("len"))
    at = (F.col("h") % F.col("len")).cast("int")
    without = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.col("len")))
    words = coded.select(F.when(F.col("h") % noise == 0, without).otherwise(F.col("run")).alias("word"))
    return (
        words.filter(F.char_length("word") >= least).groupBy("word").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= twice)
    )


class Trie:
    """Where a sorted order of words is cut, and the numbers of the nodes that several parts share."""

    def __init__(self, splitters: list[str]) -> None:
        self.splitters = sorted(set(splitters))
        prefixes = {""} | {s[:k] for s in self.splitters for k in range(1, len(s))}
        self.shared = {p: k for k, p in enumerate(sorted(prefixes))}

    def part(self, word: str) -> int:
        return bisect_right(self.splitters, word)


class Path:
    """Node numbers along the words of a part, given in sorted order."""

    def __init__(self, trie: Trie, part: int) -> None:
        self.trie, self.base = trie, (part + 1) << _LOCAL
        self.word, self.made = "", 0
        self.nodes = [trie.shared[""]]

    def down(self, word: str) -> list[int]:
        """Nodes of the prefixes of ``word``, from the empty one on."""
        common, most = 0, min(len(word), len(self.word))
        while common < most and word[common] == self.word[common]:
            common += 1
        del self.nodes[common + 1 :]
        inside = self.nodes[common] < 1 << _LOCAL  # below a node of one part, all nodes are of that part
        for k in range(common + 1, len(word) + 1):
            number = self.trie.shared.get(word[:k]) if inside else None
            if number is None:
                inside = False
                number = self.base + self.made
                self.made += 1
            self.nodes.append(number)
        self.word = word
        return self.nodes


def _numbered(words: DataFrame, forward: Trie, backward: Trie) -> DataFrame:
    """(id, word, n, back, reversed, path): ids follow the order of the words, ``path`` holds the prefix nodes."""

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            parts = [forward.part(w) for w in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(parts, pa.int32())], ["word", "n", "part"])

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, path, row = -1, None, 0
        for b in batches:
            ids, backs, turned, nodes, ends = [], [], [], [], [0]
            for word, p in zip(b.column(0).to_pylist(), b.column(2).to_pylist()):
                if p != part:
                    part, path, row = p, Path(forward, p), 0
                ids.append(p << _LOCAL | row)
                row += 1
                turned.append(word[::-1])
                backs.append(backward.part(turned[-1]))
                nodes.append(np.array(path.down(word), np.int64))
                ends.append(ends[-1] + len(nodes[-1]))
            held = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(nodes) if nodes else np.zeros(0, np.int64)))
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), b.column(0), b.column(1), pa.array(backs, pa.int32()), pa.array(turned, pa.string()), held],
                ["id", "word", "n", "back", "reversed", "path"],
            )

    dealt = words.select("word", "n").mapInArrow(tidy(place), "word string, n long, part int")
    laid = dealt.repartition(len(forward.splitters) + 1, "part").sortWithinPartitions("part", "word")
    return laid.mapInArrow(tidy(number), "id long, word string, n long, back int, reversed string, path array<long>")


def _pairs(numbered: DataFrame, backward: Trie) -> DataFrame:
    """(f, b, kind, id, n): the gap and skip pairs of every word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, path = -1, None
        for b in batches:
            made: list[tuple[np.ndarray, ...]] = []
            size = 0
            prefix_ends = b.column(4).offsets.to_numpy() - b.column(4).offsets[0].as_py()
            prefixes = b.column(4).flatten().to_numpy()
            rows = zip(*(b.column(k).to_pylist() for k in range(4)))
            for k, (back, turned, ident, n) in enumerate(rows):
                if back != part:
                    part, path = back, Path(backward, back)
                suffix = np.array(path.down(turned), np.int64)[::-1]  # by the place where the suffix starts
                prefix = prefixes[prefix_ends[k] : prefix_ends[k + 1]]
                points = np.frombuffer(turned[::-1].encode("utf-32-le"), np.uint32)
                kinds = np.where(np.r_[True, points[1:] != points[:-1]], DELETE, SKIP).astype(np.int8)
                made.append((prefix, suffix, np.full(len(prefix), GAP, np.int8), ident, n))
                made.append((prefix[:-1], suffix[1:], kinds, ident, n))
                size += 2 * len(prefix)
                if size >= ROWS_OUT:
                    yield _stack(made)
                    made, size = [], 0
            if made:
                yield _stack(made)

    laid = (
        numbered.select("back", "reversed", "id", "n", "path").repartition(len(backward.splitters) + 1, "back")
        .sortWithinPartitions("back", "reversed")
    )
    return laid.mapInArrow(tidy(run), "f long, b long, kind tinyint, id long, n long")


def _stack(made: list[tuple]) -> pa.RecordBatch:
    counts = [len(m[0]) for m in made]
    cells = [np.concatenate([m[k] for m in made]) for k in range(3)]
    cells += [np.repeat(np.array([m[k] for m in made], np.int64), counts) for k in (3, 4)]
    return pa.RecordBatch.from_arrays([pa.array(c) for c in cells], ["f", "b", "kind", "id", "n"])


def meet(kinds: list[int], ids: list[int], ns: list[int]) -> Iterator[tuple[int, int, int, int]]:
    """(id, near words, n of the best, id of the best) of the members of one pair."""
    order = sorted(range(len(ids)), key=lambda k: (-ns[k], ids[k]))
    skips = [k for k in order if kinds[k] != GAP]
    deletes = [k for k in order if kinds[k] == DELETE]
    gap = next((k for k in order if kinds[k] == GAP), None)
    for k in skips:
        near = [skips[0] if skips[0] != k else skips[1]] if len(skips) > 1 else []
        count = len(skips) - 1
        if gap is not None and kinds[k] == DELETE:
            near.append(gap)
            count += 1
        if near:
            best = min(near, key=lambda j: (-ns[j], ids[j]))
            yield ids[k], count, ns[best], ids[best]
    if gap is not None and deletes:
        yield ids[gap], len(deletes), ns[deletes[0]], ids[deletes[0]]


def _met(pairs: DataFrame) -> DataFrame:
    """(id, near, best_n, best): what each shared pair says of each of its words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["f", "b", "kind", "id", "n"]
        held = [np.zeros(0, np.int64)] * 5

        def settle(cells: list[np.ndarray], ends: np.ndarray) -> Iterator[pa.RecordBatch]:
            sizes = np.diff(ends)
            out: list[tuple] = []
            for i, size in zip(ends[:-1][sizes > 1].tolist(), sizes[sizes > 1].tolist()):
                out.extend(meet(*(c[i : i + size].tolist() for c in cells[2:])))
            if out:
                columns = np.array(out, np.int64).T
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["id", "near", "best_n", "best"])

        for b in batches:
            cells = [np.r_[h, b.column(k).to_numpy()] for k, h in zip(range(len(names)), held)]
            fresh = np.flatnonzero((cells[0][1:] != cells[0][:-1]) | (cells[1][1:] != cells[1][:-1])) + 1
            if len(fresh):  # the last pair may go on in the next batch
                yield from settle(cells, np.r_[0, fresh])
                cells = [c[fresh[-1] :] for c in cells]
            held = cells
        if len(held[0]):
            yield from settle(held, np.array([0, len(held[0])]))

    laid = pairs.repartition("f", "b").sortWithinPartitions("f", "b")
    return laid.mapInArrow(tidy(run), "id long, near long, best_n long, best long")


def splitters(words: DataFrame, part: int) -> list[str]:
    """Sampled words (by their hash, so reruns agree), about ``SAMPLES`` for each part of ``part`` words."""
    parts = -(-words.count() // part)
    if parts <= 1:
        return []
    chosen = words.filter(F.pmod(F.xxhash64("word"), F.lit(max(1, part // SAMPLES))) == 0)
    return [r[0] for r in chosen.select(F.substring("word", 1, SPLITTER)).collect()]


def _tries(sample: list[str], words: DataFrame, part: int) -> tuple[Trie, Trie]:
    def every(ordered: list[str]) -> list[str]:
        return ordered[SAMPLES::SAMPLES]

    tails = [s[::-1] for s in sample]
    return Trie(every(sorted(sample))), Trie(every(sorted(tails)))


def ends(forms: DataFrame) -> DataFrame:
    """(id, up) with ``up`` the last of the chain of forms; n grows tenfold a step, so chains are short."""
    last = cut(forms.select("id", "up"), "ends")
    while True:
        over = last.select(F.col("id").alias("_id"), F.col("up").alias("_up"))
        joined = last.join(over, last["up"] == over["_id"], "left")
        if joined.filter("_up is not null").isEmpty():
            return last
        last = cut(joined.select("id", F.coalesce("_up", "up").alias("up")), "ends")


def variants(words: DataFrame, *, factor: int = FACTOR, part: int = PART) -> DataFrame:
    """Per word: word, form (its near word of largest n, if that is ``factor`` times its own), root, n, n_near, form_n."""
    with tidy_shuffles(words.sparkSession):
        whole = words.filter("word is not null").groupBy("word").agg(F.sum("n").cast("long").alias("n"))
        known = cut(whole, "words")
        forward, backward = _tries(splitters(known, part), known, part)
        numbered = cut(_numbered(known, forward, backward), "numbered")
        met = _met(_pairs(numbered, backward))
        near = met.groupBy("id").agg(F.sum("near").alias("n_near"), F.max(F.struct("best_n", (-F.col("best")).alias("best"))).alias("top"))
        best = numbered.select("id", "word", "n").join(near, "id", "left")
        strong = F.col("top.best_n") >= factor * F.col("n")
        chosen = cut(
            best.select(
                "id", "word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"),
                F.when(strong, -F.col("top.best")).alias("up"), F.when(strong, F.col("top.best_n")).alias("form_n"),
            ), "near",
        )
        forms = chosen.filter("up is not null")
        last = ends(forms)
        names = chosen.select("id", "word")
        named = (
            forms.select("id", "up").join(names.select(F.col("id").alias("up"), F.col("word").alias("form")), "up")
            .join(last.select("id", F.col("up").alias("_end")), "id")
            .join(names.select(F.col("id").alias("_end"), F.col("word").alias("_root")), "_end").select("id", "form", "_root")
        )
        return chosen.join(named, "id", "left").select(
            "word", "form", F.coalesce("_root", "word").alias("root"), "n", "n_near", "form_n"
        )
