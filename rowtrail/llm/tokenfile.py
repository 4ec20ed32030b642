"""Token ids in Huffman-coded blocks.

Texts are encoded with a public tokenizer file, the global count of every id gives a canonical
length-limited Huffman code, and documents are written in ascending id order as independent blocks.
The file format is a Parquet folder ``blocks`` (one row per block: shard, number, ids and sizes of its
documents, bit offsets of every ``STEP``-th token, and the bit stream) and a folder ``code`` with the
code length of every id. Codes are canonical, so the lengths alone restore them. Reading decodes all
checkpoints of a block side by side through one table lookup per token.
"""

from __future__ import annotations

import re
import zlib
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T
from pyspark.taskcontext import TaskContext

from rowtrail.llm.common import batches, texts, with_fields, written
from rowtrail.plans import scratch

STEP = 128
BLOCK = 1 << 16
CACHE = 300_000  # words of one generation
KNOWN = 1 << 19  # pieces of words
SHORT = 64  # bytes of a word or piece that is kept
SLICE = 8 << 20  # bytes of text that are encoded together

# --- encoding -------------------------------------------------------------------------------------

# The letters below U+0250; with the file's own pattern this splits words of these characters.
_LATIN = "A-Za-zªµºÀ-ÖØ-öø-ɏ"
_DIGITS = "0-9²³¹¼-¾"
PIECES = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{_LATIN}]+|[{_DIGITS}]|[^\t-\r \x85\xa0{_LATIN}{_DIGITS}]+")


def _byte_letters() -> dict[int, int]:
    """The printable letter that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {b: b for b in plain} | {b: 256 + i for i, b in enumerate(rest)}


# What takes the whole tokenizer: words with other characters, with capitals whose lower case PIECES
# does not know, and words that may hold a special token, which is found in the raw text.
_FAR = "".join(c for c in map(chr, range(0x250)) if max(c.lower()) >= "ɐ")
LONG = rf"[^\x{{0}}-\x{{24f}}]|[{_FAR}]|<\|"
LINES = re.compile(PIECES.pattern + "|\n")


def _joined(parts: pa.BinaryArray, bounds: np.ndarray) -> pa.BinaryArray:
    """The values of ``parts`` from each bound to the next, end to end."""
    _, ends, data = parts.buffers()
    ends = np.frombuffer(ends, np.int32, len(parts) + 1, 4 * parts.offset)
    return pa.BinaryArray.from_buffers(pa.binary(), len(bounds) - 1, [None, pa.py_buffer(ends[bounds]), data or pa.py_buffer(b"")])


class WordIds(dict):
    """Ids of white-space separated words, as little-endian bytes, by the word's bytes.

    The tokenizer drops white space and splits inside words only, so the ids of a text are those of
    its words. Texts are encoded together: every distinct word is split once, and pieces that are not
    known yet take the model alone. Words that ``LONG`` finds take the whole tokenizer one by one;
    those are the items kept here.
    """

    def __init__(self, file: str, width: str):
        super().__init__()
        from tokenizers import Tokenizer

        self.old: dict[bytes, bytes] = {}  # the generation before; what is met again moves up, so frequent words stay

        self.all, self.width = Tokenizer.from_file(file), width
        self.model, self.letters = self.all.model, _byte_letters()
        self.known, self.ids = pa.array([], pa.string()), pa.array([], pa.binary())  # pieces and their ids, the last used first

    def __missing__(self, word: bytes) -> bytes:
        if len(word) > SHORT:
            return self._encoded(word)
        found = self.old.get(word)
        if len(self) >= CACHE:
            self.old = dict(self)
            self.clear()
        if found is None:
            found = self._encoded(word)
        self[word] = found
        return found

    def _encoded(self, word: bytes) -> bytes:
        return np.array(self.all.encode(word.decode("utf-8", "surrogatepass"), add_special_tokens=False).ids, self.width).tobytes()

    def _modelled(self, pieces: list[str]) -> pa.BinaryArray:
        if not pieces:
            return pa.array([], pa.binary())
        mapped = "\n".join(pieces).encode().decode("latin-1").translate(self.letters).split(chr(self.letters[10]))
        ids = [[t.id for t in tokens] for tokens in map(self.model.tokenize, mapped)]
        raw = np.fromiter(chain.from_iterable(ids), self.width).tobytes()
        ends = np.cumsum([0, *map(len, ids)]) * np.dtype(self.width).itemsize
        return pa.BinaryArray.from_buffers(pa.binary(), len(ids), [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(raw)])

    def _pieces(self, pieces: pa.StringArray) -> pa.BinaryArray:
        """The ids of each of some distinct pieces; the last ``KNOWN`` short ones are kept."""
        at = pc.index_in(pieces, value_set=self.known)
        new = np.asarray(at.is_null())
        at = np.asarray(at.fill_null(0)).astype(np.int64)
        rest = np.ones(len(self.known), bool)
        rest[at[~new]] = False
        at[new] = len(self.known) + np.arange(new.sum())
        ids = pa.concat_arrays([self.ids, self._modelled(pieces.filter(pa.array(new)).to_pylist())]).take(pa.array(at))
        short, rest = pc.less_equal(pc.binary_length(pieces), SHORT), pa.array(rest)
        self.known = pa.concat_arrays([pieces.filter(short), self.known.filter(rest)])[:KNOWN]
        self.ids = pa.concat_arrays([ids.filter(short), self.ids.filter(rest)])[:KNOWN]
        return ids

    def _words(self, words: pa.StringArray) -> pa.BinaryArray:
        """The ids of each of some distinct words."""
        far = pc.match_substring_regex(words, LONG)
        low = pc.utf8_lower(pc.if_else(far, "", words)).dictionary_encode()
        lines = pc.binary_join(pa.ListArray.from_arrays([0, len(low.dictionary)], low.dictionary), "\n")[0].as_py() + "\n"
        found = pa.array(LINES.findall(lines), pa.string()).dictionary_encode()
        end = pc.index(found.dictionary, "\n").as_py()
        ends = np.flatnonzero(np.asarray(found.indices) == end) + 1
        known = self._pieces(pa.concat_arrays([found.dictionary[:end], found.dictionary[end + 1 :]]))
        known = pa.concat_arrays([known[:end], pa.array([b""]), known[end:]])
        ids = _joined(known.take(found.indices), np.concatenate([[0], ends])).take(low.indices)
        long = words.filter(far).cast(pa.binary()).to_pylist()
        return pc.replace_with_mask(ids, far, pa.array([self[w] for w in long], pa.binary())) if long else ids

    def encode(self, texts: pa.StringArray) -> list[bytes]:
        """The ids of each text."""
        words = pc.ascii_split_whitespace(texts)  # may hold empty words, which have no ids
        each = words.flatten().dictionary_encode()
        if not len(each):
            return [b""] * len(texts)
        return _joined(self._words(each.dictionary).take(each.indices), np.asarray(words.offsets)).to_pylist()


_CACHES: dict[tuple[str, str], WordIds] = {}  # of this worker process


def word_ids(file: str, width: str) -> WordIds:
    if (file, width) not in _CACHES:
        _CACHES[file, width] = WordIds(file, width)
    return _CACHES[file, width]


def encode(df: DataFrame, file: str, vocabulary: int, end_id: int | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids, n_tokens): the ids of each row's text as one binary, ``end_id`` appended.

    Two bytes an id where ``vocabulary`` allows, else four. A null or empty text is the end id alone.
    """
    rows, width = texts(df, id_col, text_col), "<u2" if vocabulary <= 1 << 16 else "<u4"
    schema = with_fields(rows, ids=T.BinaryType(), n_tokens=T.LongType())
    end = b"" if end_id is None else np.array([end_id], width).tobytes()

    def run(batch: pa.RecordBatch) -> dict:
        ids = [x + end for x in word_ids(file, width).encode(batch.column("text"))]
        size = np.dtype(width).itemsize
        return {"id": batch.column("id"), "ids": ids, "n_tokens": [len(x) // size for x in ids]}

    return rows.mapInArrow(batches(run, schema, SLICE), schema)


# --- code -----------------------------------------------------------------------------------------


def code_lengths(counts: np.ndarray, limit: int) -> np.ndarray:
    """Lengths of an optimal prefix code of at most ``limit`` bits by package-merge; 0 for unused ids."""
    used = np.flatnonzero(counts)
    lengths = np.zeros(len(counts), np.int64)
    if len(used) < 2:
        lengths[used] = 1
        return lengths
    if len(used) > 1 << limit:
        raise ValueError("more ids than codes of this length")
    order = used[np.argsort(counts[used], kind="stable")]
    weights = counts[order].astype(np.int64)
    levels, packages = [], np.zeros(0, np.int64)
    for _ in range(limit):
        both = np.concatenate([weights, packages])
        leaf = np.arange(len(both)) < len(weights)
        rank = np.argsort(both, kind="stable")
        both, leaf = both[rank], leaf[rank]
        levels.append(leaf)
        packages = both[: len(both) // 2 * 2].reshape(-1, 2).sum(1)
    take = 2 * len(order) - 2
    for leaf in reversed(levels):
        leaves = int(leaf[:take].sum())
        lengths[order[:leaves]] += 1
        take = 2 * (take - leaves)
    return lengths


def canonical(lengths: np.ndarray) -> np.ndarray:
    """The code of every id: ascending by (length, id), each the successor of the last, shifted."""
    codes, code, before = np.zeros(len(lengths), np.uint32), 0, 0
    for length in range(1, int(lengths.max(initial=0)) + 1):
        own = np.flatnonzero(lengths == length)
        code <<= length - before
        codes[own] = code + np.arange(len(own))
        code, before = code + len(own), length
    return codes


def lookup(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """For every value of the next ``bits`` bits: the id that it starts with, and its length."""
    bits = max(1, int(lengths.max(initial=0)))
    codes, used = canonical(lengths), np.flatnonzero(lengths)
    ids, sizes = np.zeros(1 << bits, np.uint32), np.ones(1 << bits, np.uint8)
    order = used[np.lexsort((used, lengths[used]))]
    span = 1 << (bits - lengths[order])
    first = (codes[order].astype(np.int64) << (bits - lengths[order]))
    at = np.repeat(first - np.concatenate([[0], np.cumsum(span)[:-1]]), span) + np.arange(span.sum())
    ids[at], sizes[at] = np.repeat(order, span), np.repeat(lengths[order], span)
    return ids, sizes, bits


def pack(ids: np.ndarray, lengths: np.ndarray, codes: np.ndarray) -> tuple[bytes, np.ndarray]:
    """The bit stream of ``ids`` and the bit offset of every ``STEP``-th one."""
    size = lengths[ids]
    ends = np.cumsum(size)
    at = ends - size
    word = codes[ids].astype(np.uint64) << (40 - size - (at & 7)).astype(np.uint64)
    n = (int(ends[-1]) + 7) // 8 if len(ids) else 0
    out = np.zeros(n + 5)
    for k in range(5):  # the bits of a code lie in five bytes at most; those of two codes never overlap
        part = (word >> np.uint64(32 - 8 * k)) & np.uint64(255)
        out += np.bincount((at >> 3) + k, weights=part, minlength=n + 5)
    return out[:n].astype(np.uint8).tobytes(), at[::STEP]


def unpack(stream: bytes, offsets: np.ndarray, n: int, table: tuple[np.ndarray, np.ndarray, int]) -> np.ndarray:
    """The ``n`` ids of a bit stream: every checkpoint is decoded in step with the others."""
    ids, sizes, bits = table
    raw = np.frombuffer(stream + bytes(8), np.uint8).astype(np.uint64)
    words = sum(raw[k : len(raw) - 4 + k] << np.uint64(32 - 8 * k) for k in range(5))
    at, out = offsets.astype(np.int64).copy(), np.zeros((len(offsets), STEP), np.uint32)
    mask, last = np.uint64((1 << bits) - 1), len(words) - 1
    for k in range(min(STEP, n)):
        here = np.minimum(at >> 3, last)  # beyond its end, the last checkpoint reads padding
        value = (words[here] >> (np.uint64(40 - bits) - (at & 7).astype(np.uint64))) & mask
        out[:, k] = ids[value]
        at += sizes[value]
    return out.reshape(-1)[:n]


# --- files ----------------------------------------------------------------------------------------


def count_ids(encoded: DataFrame, width: str) -> DataFrame:
    """(token, n): the global count of every id. Counts are summed per task before the exchange."""
    schema = T.StructType([T.StructField("token", T.LongType()), T.StructField("n", T.LongType())])

    def run(it):
        total = np.zeros(0, np.int64)
        for batch in it:
            own = np.bincount(np.frombuffer(b"".join(batch.column("ids").to_pylist()), width))
            total = np.pad(total, (0, max(0, len(own) - len(total))))
            total[: len(own)] += own
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], ["token", "n"])

    return encoded.select("ids").mapInArrow(run, schema).groupBy("token").agg(F.sum("n").alias("n"))


def write_ids(encoded: DataFrame, path: str, vocabulary: int, limit: int = 16) -> None:
    """Write (id, ids, n_tokens) rows below ``path`` in ascending id order, null ids first.

    Rows that repeat an id follow each other in the order of their ids' checksum. Counting and coding
    both read ``encoded``, so hand in a written table. Only the counts come to the driver: at most one
    row per id of the vocabulary.
    """
    spark, width = encoded.sparkSession, "<u2" if vocabulary <= 1 << 16 else "<u4"
    counts = np.zeros(vocabulary, np.int64)
    for row in count_ids(encoded, width).collect():
        counts[row["token"]] = row["n"]
    used = int((counts > 0).sum())
    lengths = code_lengths(counts, max(limit, used.bit_length()))
    codes, kind = canonical(lengths), encoded.schema["id"].dataType
    spark.createDataFrame([(int(i), int(lengths[i])) for i in np.flatnonzero(lengths)], "token long, length int").coalesce(1).write.parquet(f"{path}/code")
    schema = T.StructType([
        T.StructField("shard", T.IntegerType()), T.StructField("number", T.IntegerType()), T.StructField("first", T.LongType()),
        T.StructField("n_tokens", T.LongType()), T.StructField("doc_ids", T.ArrayType(kind)), T.StructField("sizes", T.ArrayType(T.IntegerType())),
        T.StructField("offsets", T.ArrayType(T.LongType())), T.StructField("stream", T.BinaryType()),
    ])

    def run(it):
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow, shard, number, first = to_arrow_schema(schema), TaskContext.get().partitionId(), 0, 0
        docs, sizes, parts, size = [], [], [], 0

        def block():
            ids = np.frombuffer(b"".join(parts), width)
            stream, offsets = pack(ids, lengths, codes)
            row = {"shard": shard, "number": number, "first": first, "n_tokens": len(ids), "doc_ids": docs, "sizes": sizes, "offsets": offsets.tolist(), "stream": stream}
            return pa.RecordBatch.from_pylist([row], schema=arrow)

        for batch in it:
            for doc, ids, n in zip(*(batch.column(c).to_pylist() for c in ("id", "ids", "n_tokens")), strict=True):
                docs.append(doc)
                sizes.append(n)
                parts.append(ids)
                size += n
                if size >= BLOCK:
                    yield block()
                    number, first = number + 1, first + size
                    docs, sizes, parts, size = [], [], [], 0
        if docs:
            yield block()

    order = ["id", F.crc32("ids")]
    encoded.repartitionByRange(*order).sortWithinPartitions(*order, "ids").mapInArrow(run, schema).write.parquet(f"{path}/blocks")


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids, ids_crc32) of every document in the files below ``path``.

    ``start`` counts the ids of all documents before it. Only one total per shard and one length per
    id of the vocabulary come to the driver.
    """
    code = {r["token"]: r["length"] for r in spark.read.parquet(f"{path}/code").collect()}
    lengths = np.zeros(max(code, default=0) + 1, np.int64)
    lengths[list(code)] = list(code.values())
    blocks = spark.read.parquet(f"{path}/blocks")
    totals = {r["shard"]: r["n"] for r in blocks.groupBy("shard").agg(F.sum("n_tokens").alias("n")).collect()}
    starts, before = {}, 0
    for shard in sorted(totals):
        starts[shard], before = before, before + totals[shard]
    schema = T.StructType([
        T.StructField("doc_id", blocks.schema["doc_ids"].dataType.elementType), T.StructField("start", T.LongType()),
        T.StructField("n_tokens", T.LongType()), T.StructField("ids", T.BinaryType()), T.StructField("ids_crc32", T.LongType()),
    ])

    def run(it):
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow, tables = to_arrow_schema(schema), lookup(lengths)
        for batch in it:
            for row in range(batch.num_rows):
                get = lambda c: batch.column(c)[row]  # noqa: B023, E731
                ids = unpack(get("stream").as_py(), np.asarray(get("offsets").values), get("n_tokens").as_py(), tables).astype("<u4").tobytes()
                sizes = np.asarray(get("sizes").values, np.int64)
                ends = np.cumsum(sizes)
                own = [ids[4 * (e - n) : 4 * e] for e, n in zip(ends.tolist(), sizes.tolist(), strict=True)]
                start = starts[get("shard").as_py()] + get("first").as_py() + ends - sizes
                yield pa.RecordBatch.from_arrays(
                    [get("doc_ids").values, pa.array(start), pa.array(sizes), pa.array(own, pa.binary()), pa.array([zlib.crc32(x) for x in own], pa.int64())], schema=arrow
                )

    return blocks.mapInArrow(run, schema)


def round_trip(df: DataFrame, file: str, vocabulary: int, end_id: int | None = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode ``df``, write it to a new folder of the shared folder, and read the files back."""
    path = scratch(df.sparkSession, "token-file")
    write_ids(written(encode(df, file, vocabulary, end_id, id_col, text_col), "token-ids"), path, vocabulary)
    return read_ids(df.sparkSession, path)
