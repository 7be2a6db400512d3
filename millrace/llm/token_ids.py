"""Token ids in frequency-ranked, byte-aligned variable-length binary files.

Ids are ranked by how often the corpus uses them, so frequent ids become small numbers. A block of documents
stores its ranks as 1 to 4 little-endian bytes each; two bits per rank, four ranks to a control byte, give the
lengths and lie in a run of their own, so that numpy decodes a block with one table lookup per control byte.

File format (``<path>/blocks``, Parquet as the container so that every store and a lost executor are handled by
Spark's committer): one row per block with ``shard`` (its place in ascending doc_id order), ``block`` (its place in
the shard), ``n_ids``, ``doc_ids`` and ``lengths`` (the documents and their id counts, in order), ``control`` and
``data``. ``<path>/ranks`` has (rank, token_id), at most one row per entry of the tokenizer's vocabulary.

Units of text are encoded once per worker and remembered (a bounded cache): a blank after a visible
character always starts a new pre-token of this byte-level tokenizer, so encoding the units apart and joining
them gives the ids of the whole text. ``tests/llm`` holds that against whole-text encoding.

On the way to the files a document is one binary cell: first its token ids, 2 or 4 bytes each, as the ranks are not
known before all texts are encoded, then its ranks in the coding above, so that the shuffle into doc_id order moves
about 1.5 bytes an id.

Defined cases: null text counts as empty (only the end id); a text that holds an added token of the tokenizer (such as
``<|endoftext|>``) is encoded in one call, which gives that token's id; a null doc_id sorts first; rows with equal
doc_id stand next to each other, ordered by a code of their ids; no rows give an empty file set. Other columns are not
read.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections.abc import Callable, Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.llm.bytesets import pieces, text_buffer, tidy
from millrace.llm.frames import cut, tidy_shuffles
from millrace.plans.durable import fresh_path

END_ID = 2
BLOCK_IDS = 1 << 18
CACHE_UNITS = 600_000
ENCODE_BYTES = 1 << 22

BLOCKS = "shard int, block int, n_ids long, doc_ids array<long>, lengths array<long>, control binary, data binary"

#: For every control byte, the byte lengths of its four ranks.
_LENGTHS = (np.arange(256)[:, None] >> (2 * np.arange(4)) & 3).astype(np.uint8) + np.uint8(1)


def _low_bytes(ranks: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The ``size`` + 1 low bytes of each rank, end to end."""
    width = 2 if size.max(initial=0) < 2 else 4
    held = ranks.astype(f"<u{width}").view(np.uint8)
    return held[(np.arange(width, dtype=np.uint8) <= size[:, None]).ravel()]


def _from_low_bytes(data: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The ranks whose low bytes, ``lengths`` of each, lie end to end."""
    width = 2 if lengths.max(initial=1) < 3 else 4
    out = np.zeros(len(lengths) * width, np.uint8)
    out[(np.arange(width, dtype=np.uint8) < lengths[:, None]).ravel()] = data
    return out.view(f"<u{width}").astype("<u4")


def pack(ranks: np.ndarray) -> tuple[bytes, bytes]:
    """Control bytes and data bytes of a run of ranks (below 2^32)."""
    ranks = ranks.astype("<u4")
    size = (ranks > 0xFF).astype(np.uint8) + (ranks > 0xFFFF) + (ranks > 0xFFFFFF)
    padded = np.zeros(-(-len(ranks) // 4) * 4, np.uint8)
    padded[: len(ranks)] = size
    quads = padded.reshape(-1, 4)
    control = quads[:, 0] | quads[:, 1] << 2 | quads[:, 2] << 4 | quads[:, 3] << 6
    return control.astype(np.uint8).tobytes(), _low_bytes(ranks, size).tobytes()


def unpack(control: bytes, data: bytes, count: int) -> np.ndarray:
    """The ranks of a block; the inverse of ``pack``."""
    lengths = _LENGTHS[np.frombuffer(control, np.uint8)].ravel()[:count]
    return _from_low_bytes(np.frombuffer(data, np.uint8), lengths)


def pack_each(ranks: np.ndarray, offsets: np.ndarray) -> pa.Array:
    """One cell per document: the control bytes of its ranks, then their data bytes."""
    ranks = ranks.astype("<u4")
    counts = np.diff(offsets)
    size = (ranks > 0xFF).astype(np.uint8) + (ranks > 0xFFFF) + (ranks > 0xFFFFFF)
    quads = np.r_[0, np.cumsum(-(-counts // 4))]
    padded = np.zeros(4 * int(quads[-1]), np.uint8)
    padded[np.arange(len(ranks)) + np.repeat(4 * quads[:-1] - offsets[:-1], counts)] = size
    padded = padded.reshape(-1, 4)
    control = padded[:, 0] | padded[:, 1] << 2 | padded[:, 2] << 4 | padded[:, 3] << 6
    data = _low_bytes(ranks, size)
    ends = np.r_[0, np.cumsum(size + np.int64(1))][offsets]  # of the data bytes of each document
    cells = np.zeros(len(control) + len(data), np.uint8)
    cells[np.arange(len(control)) + np.repeat(ends[:-1], np.diff(quads))] = control
    cells[np.arange(len(data)) + np.repeat(quads[1:], np.diff(ends))] = data
    return pa.Array.from_buffers(
        pa.large_binary(), len(counts), [None, pa.py_buffer((quads + ends).astype(np.int64).tobytes()), pa.py_buffer(cells.tobytes())]
    ).cast(pa.binary())


def unpack_each(cells: np.ndarray, edges: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The ranks of the documents whose cells lie end to end, with ``counts`` ranks each; the inverse of ``pack_each``."""
    quads = -(-counts // 4)
    where = np.arange(int(quads.sum())) + np.repeat(edges[:-1] - np.r_[0, np.cumsum(quads)[:-1]], quads)
    real = np.ones(len(cells), bool)
    real[where] = False
    lengths = _LENGTHS[cells[where]].ravel()
    inside = np.ones(len(lengths), bool)
    last = 4 * np.cumsum(quads)
    for k in range(1, 4):  # up to three places of a document's last control byte stand for no rank
        inside[(last - k)[(4 * quads - counts) >= k]] = False
    lengths = lengths[inside]
    return _from_low_bytes(cells[real], lengths)


class Encoder:
    """Whole texts to ids through the tokenizer, remembering the units it has met.

    Texts are cut into units end to end (``units``); a unit is one pre-token, or a stretch between places where any
    byte-level text may be cut. Distinct units of all the texts at hand are looked up at once among at most ``cache``
    remembered ones; a new pre-token goes straight to the tokenizer's model, any other new unit through the whole
    tokenizer. When too many are known, the half met most often stays.
    """

    def __init__(self, path: str, cache: int = CACHE_UNITS) -> None:
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.added = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        spell = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False).pre_tokenize_str
        self.shown = str.maketrans({chr(i): spell(chr(i))[0][0] for i in range(0x250)})
        self.blank, self.line = spell(" ")[0][0], spell("\n")[0][0]
        self.limit = cache
        self.known = pa.array([], pa.binary())
        self.ids, self.begin, self.count, self.met = np.zeros(0, "<u4"), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def _new(self, units: pa.Array, plain: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the units end to end, and how many each has."""
        tokenize, texts = self.tokenizer.model.tokenize, units.cast(pa.string())
        spelled = pc.replace_substring(pc.replace_substring(texts, " ", self.blank), "\n", self.line).to_pylist()
        for k in np.flatnonzero(plain & ~pc.string_is_ascii(texts).to_numpy(zero_copy_only=False)).tolist():
            spelled[k] = texts[k].as_py().translate(self.shown)
        odd = np.flatnonzero(~plain).tolist()
        whole = self.tokenizer.encode_batch(texts.take(pa.array(odd, pa.int64())).to_pylist(), add_special_tokens=False)
        rest, ids, count = iter(whole), array("I"), array("q")
        for unit, simple in zip(spelled, plain.tolist()):
            found = [t.id for t in tokenize(unit)] if simple else next(rest).ids
            ids.extend(found)
            count.append(len(found))
        return np.array(ids, "<u4"), np.array(count, np.int64)

    def _learn(self, units: pa.Array, plain: np.ndarray) -> None:
        """Remember new units."""
        ids, count = self._new(units, plain)
        self.begin = np.r_[self.begin, len(self.ids) + np.cumsum(count) - count]
        self.count, self.met = np.r_[self.count, count], np.r_[self.met, np.zeros(len(count), np.int64)]
        self.ids, self.known = np.r_[self.ids, ids], pa.concat_arrays([self.known, units])

    def _forget(self) -> None:
        keep = np.sort(np.argsort(-self.met, kind="stable")[: self.limit // 2])
        self.ids = self.ids[_ranges(self.begin[keep], self.count[keep])]
        self.known, self.count, self.met = self.known.take(pa.array(keep)), self.count[keep], self.met[keep] // 2
        self.begin = np.cumsum(self.count) - self.count

    def batch(self, raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the texts end to end, and how many each has."""
        held = raw.tobytes()
        whole = [m.start() for token in self.added for m in re.finditer(re.escape(token), held)]
        starts, plain = units(raw, offsets, np.unique(np.searchsorted(offsets, whole, "right") - 1))
        if not len(starts):
            return np.zeros(0, "<u4"), np.zeros(len(offsets) - 1, np.int64)
        ends = np.r_[starts, len(raw)].astype(np.int32)
        seen = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(held)]).dictionary_encode()
        which = seen.indices.to_numpy()
        places = pc.fill_null(pc.index_in(seen.dictionary, value_set=self.known), -1).to_numpy().astype(np.int64)
        new = np.flatnonzero(places < 0)
        if len(new):
            # A unit is plain or not by its own bytes, or because its text holds an added token and is one unit.
            simple = np.zeros(len(seen.dictionary), bool)
            simple[which] = plain
            places[new] = len(self.known) + np.arange(len(new))
            self._learn(seen.dictionary.take(pa.array(new)), simple[new])
        self.met += np.bincount(places, np.bincount(which), len(self.known)).astype(np.int64)
        at = places[which]
        counts = self.count[at]
        ids = self.ids[_ranges(self.begin[at], counts)]
        ends = np.r_[0, np.cumsum(counts)]
        if len(self.known) > self.limit:
            self._forget()
        return ids, np.diff(ends[np.searchsorted(starts, offsets)])

    def __call__(self, text: str) -> bytes:
        """Little-endian 32-bit ids of a text."""
        raw = np.frombuffer(text.encode(), np.uint8)
        return self.batch(raw, np.array([0, len(raw)]))[0].tobytes()


def _ranges(begin: np.ndarray, count: np.ndarray) -> np.ndarray:
    """The numbers of the ranges, range after range."""
    ends = np.cumsum(count)
    return np.repeat(begin - ends + count, count) + np.arange(int(ends[-1]) if len(ends) else 0)


_BLANK, _LINE, _LETTER, _MARK, _ODD = 1, 2, 3, 4, 5
_KIND = np.full(256, _ODD, np.uint8)
_KIND[0x21:0x7F] = _MARK
_KIND[0x30:0x3A] = _ODD
_KIND[0x41:0x5B] = _KIND[0x61:0x7B] = _LETTER
_KIND[0xC3:0xC9] = _KIND[0x80:0xC0] = _LETTER  # U+00C0 to U+023F are letters but for two signs
_KIND[0x20], _KIND[0x0A] = _BLANK, _LINE


def _wide_space(raw: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Whether the character that ends at each of these bytes may be white space, its bytes being above ASCII."""
    last, one, two = raw[at], raw[np.maximum(at - 1, 0)], raw[np.maximum(at - 2, 0)]
    return (
        (one == 0xC2) | (two == 0xE1) | ((two == 0xE3) & (one == 0x80) & (last == 0x80)) | ((two == 0xE2) & (one == 0x81))
        | ((two == 0xE2) & (one == 0x80) & ((last <= 0x8F) | ((last >= 0xA8) & (last <= 0xAF))))
    )


def units(raw: np.ndarray, offsets: np.ndarray, whole: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts of the units of the texts end to end, and which are one pre-token whatever stands around them.

    A blank or line break after a visible character always starts a new pre-token of this byte-level tokenizer. What
    stands between two such places is cut further, where letters meet marks or a line break ends, if it holds only
    Latin letters, ASCII marks other than an apostrophe before a letter, one blank in front or single line breaks.
    A text of ``whole`` is one unit.
    """
    heads = np.unique(offsets[:-1][np.diff(offsets) > 0])
    if not len(heads):
        return heads, np.zeros(0, bool)
    kind = _KIND[raw]
    before = np.r_[np.uint8(0), kind[:-1]]
    before[heads] = 0
    space = (kind == _BLANK) | (kind == _LINE)
    # Control characters never count as visible, wide ones if they are no white space.
    visible = (before >= _LETTER) & (np.r_[np.uint8(0), raw[:-1]] > 0x20) & (np.r_[np.uint8(0), raw[:-1]] != 0x7F)
    here = space & visible
    wide = np.flatnonzero(here & (np.r_[np.uint8(0), raw[:-1]] >= 0x80))
    here[wide[_wide_space(raw, wide - 1)]] = False
    here[heads] = True
    odd = kind == _ODD
    odd |= space & ((before == _BLANK) | (before == _LINE))
    quote = np.flatnonzero(raw[:-1] == 0x27)
    odd[quote[kind[quote + 1] == _LETTER]] = True
    sign = np.flatnonzero(raw[:-1] == 0xC3)
    odd[sign[(raw[sign + 1] == 0x97) | (raw[sign + 1] == 0xB7)]] = True
    coarse = np.flatnonzero(here)
    part = np.zeros(len(coarse), bool)
    part[np.searchsorted(coarse, np.flatnonzero(odd), "right") - 1] = True
    fine = np.flatnonzero((kind != before) & (before >= _LINE) & (kind >= _LETTER))
    here[fine[~part[np.searchsorted(coarse, fine, "right") - 1]]] = True
    starts = np.flatnonzero(here)
    plain = np.ones(len(starts), bool)
    plain[np.searchsorted(starts, coarse[part])] = False
    if len(whole):
        text = np.searchsorted(offsets, starts, "right") - 1
        single = np.isin(text, whole)
        first = np.r_[True, text[1:] != text[:-1]]
        plain = plain & ~single
        starts, plain = starts[first | ~single], plain[first | ~single]
    return starts, plain


_encoders: dict[tuple[str, int], Encoder] = {}


def _encoder(path: str, cache: int) -> Encoder:
    if (path, cache) not in _encoders:
        _encoders[path, cache] = Encoder(path, cache)
    return _encoders[path, cache]


CELLS = "doc_id long, code long, n int, cell binary"


def _with_ends(ids: np.ndarray, counts: np.ndarray, end_id: int) -> np.ndarray:
    """The ids of each document with the end id behind them."""
    out = np.full(len(ids) + len(counts), end_id, "<u4")
    inside = np.ones(len(out), bool)
    inside[np.cumsum(counts + 1) - 1] = False
    out[inside] = ids
    return out


def encoded(
    documents: DataFrame, tokenizer_path: str, *, end_id: int = END_ID, cache: int = CACHE_UNITS, piece: int = ENCODE_BYTES
) -> DataFrame:
    """(doc_id, code, n, cell): each whole text's ids with the end id appended, 2 or 4 bytes each, and a code of them.

    A worker remembers ``cache`` units and encodes ``piece`` bytes of texts at a time: less of both takes less memory
    and more time, with the same ids.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        encode = _encoder(tokenizer_path, cache)
        for b in batches:
            raw, offsets = text_buffer(b.column(1))
            for i, j in pieces(offsets, piece):
                found, counts = encode.batch(raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                ids, edges = _with_ends(found, counts, end_id), np.r_[0, np.cumsum(counts + 1)]
                held, ends = memoryview(ids.tobytes()), (4 * edges).tolist()
                codes = [
                    int.from_bytes(blake2b(held[s:e], digest_size=8).digest(), "little", signed=True)
                    for s, e in zip(ends, ends[1:])
                ]
                short = ids.astype("<u2") if ids.max() < 1 << 16 else ids
                cells = pa.Array.from_buffers(
                    pa.large_binary(), j - i,
                    [None, pa.py_buffer((edges * short.itemsize).astype(np.int64).tobytes()), pa.py_buffer(short.tobytes())],
                ).cast(pa.binary())
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(i, j - i), pa.array(codes, pa.int64()), pa.array(np.diff(edges).astype(np.int32)), cells],
                    ["doc_id", "code", "n", "cell"],
                )

    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(tidy(run), CELLS)


def _fixed(cells: np.ndarray, edges: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The ids of cells of 2 or 4 bytes an id (a cell holds one at least)."""
    width = np.diff(edges) // counts
    if (width == width[:1]).all():
        return np.ascontiguousarray(cells).view(f"<u{width[0]}")
    return np.concatenate([np.frombuffer(cells[s:e].tobytes(), f"<u{w}") for s, e, w in zip(edges, edges[1:], width)])


def _some(
    batches: Iterator[pa.RecordBatch], values: Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray] = unpack_each
) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """(rows, values, counts) of cells, a bounded number of bytes at a time."""
    for b in batches:
        raw, edges = text_buffer(b.column(b.num_columns - 1))
        counts = b.column(b.num_columns - 2).to_numpy().astype(np.int64)
        for i, j in pieces(edges):
            yield b.slice(i, j - i), values(raw[edges[i] : edges[j]], edges[i : j + 1] - edges[i], counts[i:j]), counts[i:j]


def _counted(cells: DataFrame) -> DataFrame:
    """(token_id, n): summed in each task before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0, np.int64)
        for _, values, _ in _some(batches, _fixed):
            here = np.bincount(values)
            if len(here) > len(total):
                here[: len(total)] += total
                total = here
            else:
                total[: len(here)] += here
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at], pa.int64())], ["token_id", "n"])

    return cells.select("n", "cell").mapInArrow(tidy(run), "token_id long, n long").groupBy("token_id").agg(F.sum("n").alias("n"))


def write_files(
    documents: DataFrame, tokenizer_path: str, path: str, *, end_id: int = END_ID, cache: int = CACHE_UNITS, piece: int = ENCODE_BYTES
) -> None:
    """Encode every text and write the file set at ``path``."""
    spark = documents.sparkSession
    with tidy_shuffles(spark):
        cells = cut(encoded(documents, tokenizer_path, end_id=end_id, cache=cache, piece=piece), "ids")
        # One row per id in use: bounded by the vocabulary, which the tokenizer fixes.
        used = sorted(_counted(cells).collect(), key=lambda r: (-r["n"], r["token_id"]))
        spark.createDataFrame([(i, r["token_id"]) for i, r in enumerate(used)], "rank int, token_id long").coalesce(
            1
        ).write.parquet(f"{path}/ranks")
        table = np.zeros(max([r["token_id"] for r in used], default=0) + 1, np.uint32)
        table[[r["token_id"] for r in used]] = np.arange(len(used), dtype=np.uint32)

        def ranked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for rows, values, counts in _some(batches, _fixed):
                packed = pack_each(table[values], np.r_[0, np.cumsum(counts)])
                yield pa.RecordBatch.from_arrays([*rows.columns[:-1], packed], rows.schema.names)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            from pyspark import TaskContext

            shard, block = TaskContext.get().partitionId(), 0
            for rows, values, counts in _some(batches):
                keys, edges, i = rows.column(0), np.r_[0, np.cumsum(counts)], 0
                while i < len(counts):
                    j = max(i + 1, int(np.searchsorted(edges, edges[i] + BLOCK_IDS, "right")) - 1)
                    control, data = pack(values[edges[i] : edges[j]])
                    row = [shard, block, int(edges[j] - edges[i]), keys.slice(i, j - i).to_pylist(), counts[i:j].tolist(), control, data]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([v], t) for v, t in zip(row, _BLOCK_TYPES)], _BLOCK_NAMES
                    )
                    i, block = j, block + 1

        # The sample behind the ranges holds ids and codes, never a text's ids.
        laid = cells.mapInArrow(tidy(ranked), CELLS).repartitionByRange("doc_id", "code").sortWithinPartitions("doc_id", "code")
        laid.select("doc_id", "n", "cell").mapInArrow(tidy(run), BLOCKS).write.parquet(f"{path}/blocks")


_BLOCK_NAMES = ["shard", "block", "n_ids", "doc_ids", "lengths", "control", "data"]
_BLOCK_TYPES = [pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary(), pa.binary()]


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """Per document: doc_id, start, n_tokens, ids_crc32, from the files alone."""
    ranks = spark.read.parquet(f"{path}/ranks").collect()  # bounded by the vocabulary
    back = np.zeros(max(1, len(ranks)), "<u4")
    for r in ranks:
        back[r["rank"]] = r["token_id"]
    blocks = spark.read.schema(BLOCKS).parquet(f"{path}/blocks")
    # Where each block starts: shards are few (one per task), blocks are summed inside their shard.
    shards = blocks.groupBy("shard").agg(F.sum("n_ids").alias("_ids"))
    earlier = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    bases = shards.select("shard", F.coalesce(F.sum("_ids").over(earlier), F.lit(0)).alias("_base"))
    inside = Window.partitionBy("shard").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    starts = cut(
        blocks.select("shard", "block", "n_ids")
        .withColumn("_in", F.coalesce(F.sum("n_ids").over(inside), F.lit(0)))
        .join(bases, "shard").select("shard", "block", (F.col("_base") + F.col("_in")).alias("_start")),
        "starts",
    )
    placed = blocks.join(starts, ["shard", "block"]).select("_start", "n_ids", "doc_ids", "lengths", "control", "data")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in b.to_pylist():
                ids = back[unpack(row["control"], row["data"], row["n_ids"])]
                ends = np.cumsum(row["lengths"])
                raw = memoryview(np.ascontiguousarray(ids)).cast("B")
                begins = ends - np.array(row["lengths"])
                crcs = [zlib.crc32(raw[4 * i : 4 * j]) for i, j in zip(begins.tolist(), ends.tolist())]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(row["doc_ids"], pa.int64()), pa.array(begins + row["_start"], pa.int64()),
                     pa.array(row["lengths"], pa.int64()), pa.array(crcs, pa.int64())],
                    ["doc_id", "start", "n_tokens", "ids_crc32"],
                )

    return placed.mapInArrow(tidy(run), "doc_id long, start long, n_tokens long, ids_crc32 long")


def round_trip(
    documents: DataFrame, tokenizer_path: str, *, end_id: int = END_ID, cache: int = CACHE_UNITS, piece: int = ENCODE_BYTES
) -> DataFrame:
    """Write the files to the shared folder and report what they hold."""
    path = fresh_path(documents.sparkSession, "tokens")
    write_files(documents, tokenizer_path, path, end_id=end_id, cache=cache, piece=piece)
    return read_files(documents.sparkSession, path)
