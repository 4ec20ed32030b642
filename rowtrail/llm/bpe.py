"""Byte-level BPE through a global shuffle of distinct words.

Documents are grouped into chunks of neighbouring rows. Each chunk's texts are split into words
(pre-tokens with what trails them up to the next single space), every distinct word of a chunk goes
once through a shuffle by word, is encoded once, and its ids return to the chunk, where they are put
back by position. Decoding joins the ids with the table of token bytes.
"""

from __future__ import annotations

import base64
import json
import zlib
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, functions as F, types as T

from rowtrail.llm.common import named, release, written

CHUNK_DOCS = 4000
CHUNK_BYTES = 32 << 20
MAX_CUTS = 1024
BUCKETS, MANY_CHUNKS = 256, 1 << 14
FLUSH = 500_000
CODEC = pa.Codec("zstd", compression_level=3)
# White space other than blank and line feed, and the mark that cuts are made at.
OTHER_SPACE = ["\0", *(c for c in map(chr, range(0x3001)) if c.isspace() and c not in " \n")]


def load_ranks(file: str) -> dict[bytes, int]:
    """Token bytes and ranks of a ``.tiktoken`` file."""
    with open(file, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


def split_words(text: str) -> list[str]:
    """``text`` in parts that the pre-token pattern never spans, and that it splits alike on their own.

    A pre-token crosses a space only inside a run of white space, or as that space and what follows.
    So a text may be cut before each space, unless white space stands on both of its sides.
    """
    if "  " in text or "\n " in text or any(c in text for c in OTHER_SPACE):
        words = []
        for part in text.split(" "):
            if words and words[-1][-1:].isspace() and (not part or part[0].isspace()):
                words[-1] += " " + part
            else:
                words.append(" " + part if words else part)
    else:
        words = text.replace(" ", "\0 ").split("\0")
    return words if words[0] else words[1:]


def _placed(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, text, file, at): the row's place in its file, or, where ``df`` is no plain scan, one by its id."""
    rows = df.select(named(id_col).alias("id"), F.coalesce(named(text_col), F.lit("")).alias("text"), *_place(df))
    if "at" in rows.columns:
        return rows
    # Ids at even shares of the rows, at most ``MAX_CUTS``; a binary search over them, as nested comparisons.
    n = rows.count()
    shares = min(MAX_CUTS, max(1, -(-n // CHUNK_DOCS)))
    cuts = rows.select(F.percentile_approx("id", [k / shares for k in range(1, shares)], 10_000)).first()[0] if shares > 1 else []
    cuts = sorted(set(cuts or []))

    def search(lo: int, hi: int):
        if lo == hi:
            return F.lit(lo)
        mid = (lo + hi) // 2
        return F.when(F.col("id") > F.lit(cuts[mid]), search(mid + 1, hi)).otherwise(search(lo, mid))

    return rows.select("id", "text", F.lit("").alias("file"), (search(0, len(cuts)) * F.lit(max(1, n // shares))).cast("long").alias("at"))


def _place(df: DataFrame) -> list:
    try:
        df.select("_metadata.row_index", "_metadata.file_path")
    except AnalysisException:
        return []
    return [F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("at")]


def with_chunks(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, int]:
    """(id, text, chunk) and about how many chunks there are.

    A chunk is a run of neighbouring rows of one file, so a task meets few chunks and a chunk few tasks,
    in whatever order the ids lie. Rows and bytes of an average run stay below ``CHUNK_DOCS`` and
    ``CHUNK_BYTES``; a run beyond, as of long texts or of one id, is dealt out by a hash of the row.
    """
    rows = _placed(df, id_col, text_col)
    size = F.octet_length("text").cast("long")
    n, total = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum(size), F.lit(0))).first()
    each = max(1, min(CHUNK_DOCS, int(CHUNK_BYTES / 2 / max(1.0, total / max(1, n)))))
    run = F.floor(F.col("at") / F.lit(each))
    sizes = rows.groupBy("file", run.alias("run")).agg(F.count(F.lit(1)).alias("docs"), F.sum(size).alias("bytes"))
    parts = F.greatest(F.ceil(F.col("docs") / (1.5 * CHUNK_DOCS)), F.ceil(F.col("bytes") / CHUNK_BYTES))
    # Only runs that are too large.
    over = written(sizes.withColumn("parts", parts).filter("parts > 1").select("file", "run", "parts"), "large-runs")
    rows = rows.withColumn("run", run).join(over, ["file", "run"], "left")
    part = F.pmod(F.xxhash64("id", "text"), F.coalesce("parts", F.lit(1)))
    return rows.select("id", "text", F.xxhash64("file", "run", part).alias("chunk")), max(1, n // each)


def _squeezed(value) -> bytes:
    raw = json.dumps(value, ensure_ascii=False).encode() if not isinstance(value, bytes) else value
    return len(raw).to_bytes(8, "little") + CODEC.compress(raw, asbytes=True)


def _raw(packed: bytes) -> bytes:
    return CODEC.decompress(packed[8:], int.from_bytes(packed[:8], "little"), asbytes=True)


def _groups(batch: pa.RecordBatch, key: str):
    """(key, rows of it) for each key of a batch."""
    keys = batch.column(key).to_numpy()
    order = np.argsort(keys, kind="stable")
    for part in np.split(order, np.flatnonzero(np.diff(keys[order])) + 1) if len(order) else []:
        yield int(keys[part[0]]), pa.array(part)


def by_bucket(words: set[str], buckets: int) -> dict[int, list[str]]:
    """The words of each bucket in order; a word's bucket is a hash of it."""
    parts: dict[int, list[str]] = {}
    for word in sorted(words):
        parts.setdefault(zlib.crc32(word.encode()) % buckets, []).append(word)
    return parts


def distinct_words(rows: DataFrame, buckets: int) -> DataFrame:
    """(bucket, chunk, words): the words of each chunk, once per task that meets it.

    The words of one chunk and bucket travel as one compressed list.
    """

    def run(it):
        seen: dict[int, set[str]] = {}

        def flush():
            while seen:
                chunk, own = seen.popitem()
                parts = by_bucket(own, buckets)
                columns = [pa.array(list(parts), pa.int64()), pa.array([chunk] * len(parts), pa.int64()), pa.array(map(_squeezed, parts.values()), pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, ["bucket", "chunk", "words"])

        for batch in it:
            for chunk, part in _groups(batch, "chunk"):
                own = seen.setdefault(chunk, set())
                for text in batch.column("text").take(part):
                    own.update(split_words(text.as_py()))
            if sum(map(len, seen.values())) > FLUSH:
                yield from flush()
        yield from flush()
        release()

    return rows.select("chunk", "text").mapInArrow(run, "bucket long, chunk long, words binary")


def encode_words(words: DataFrame, file: str, pattern: str) -> DataFrame:
    """(chunk, bucket, ids): for each chunk and bucket the ids of its words, in the order of the words.

    The rows of a bucket follow each other in one task, so each word is encoded once.
    """

    def run(it):
        import tiktoken

        ranks = load_ranks(file)
        encode = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        width = "<u2" if max(ranks.values()) < 1 << 16 else "<u4"
        known: dict[str, list[int]] = {}
        rows = (row for batch in it for row in zip(*(c.to_pylist() for c in batch.columns), strict=True))
        last = None
        for (bucket, chunk), own in groupby(rows, key=lambda r: r[:2]):
            if bucket != last:
                last = bucket
                known.clear()
            ids = []
            for word in sorted({w for _, _, packed in own for w in json.loads(_raw(packed))}):
                if (found := known.get(word)) is None:
                    found = known[word] = encode(word)
                ids.append(found)
            sizes = np.array([len(x) for x in ids], "<u4").tobytes()
            flat = np.array([i for x in ids for i in x], width).tobytes()
            packed = _squeezed(len(ids).to_bytes(8, "little") + sizes + flat)
            yield pa.RecordBatch.from_arrays([pa.array([chunk], pa.int64()), pa.array([bucket], pa.int64()), pa.array([packed], pa.binary())], ["chunk", "bucket", "ids"])

    # A bucket has at most one row per chunk and task, however often its words occur.
    return words.repartition("bucket").sortWithinPartitions("bucket", "chunk").mapInArrow(run, "chunk long, bucket long, ids binary")


def _ids_of(words: list[str], packed: bytes) -> dict[str, bytes]:
    """The ids of each word, as little-endian integers of four bytes."""
    raw = _raw(packed)
    n = int.from_bytes(raw[:8], "little")
    sizes = np.frombuffer(raw, "<u4", n, 8).astype(np.int64)
    rest, total = raw[8 + 4 * n :], int(sizes.sum())
    flat = np.frombuffer(rest, "<u2" if len(rest) == 2 * total else "<u4").astype("<u4").tobytes()
    ends = 4 * np.cumsum(sizes)
    return dict(zip(words, [flat[a:b] for a, b in zip((ends - 4 * sizes).tolist(), ends.tolist(), strict=True)], strict=True))


def encode(df: DataFrame, file: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids): the token ids of every row's whole text, in reading order.

    A null or empty text has no ids. Ids may be null or repeat; every row comes back once. Words are
    shuffled once per chunk and task, texts once, both compressed. A missing word would be an error.
    """
    rows, chunks = with_chunks(df, id_col, text_col)
    kind = rows.schema["id"].dataType
    # More of them only beyond many chunks, so that what tasks send grows with the input.
    buckets = BUCKETS * (1 + chunks // MANY_CHUNKS)
    ids = encode_words(distinct_words(rows, buckets), file, pattern)
    schema = T.StructType([T.StructField("id", kind), T.StructField("ids", T.ArrayType(T.IntegerType()))])
    packed_schema = T.StructType([T.StructField("chunk", T.LongType()), T.StructField("doc_ids", T.ArrayType(kind)), T.StructField("texts", T.BinaryType())])

    def squeeze(it):
        for batch in it:
            for chunk, part in _groups(batch, "chunk"):
                own = batch.column("id").take(part)
                packed = _squeezed(batch.column("text").take(part).to_pylist())
                doc_ids = pa.ListArray.from_arrays(pa.array([0, len(own)], pa.int32()), own)
                yield pa.RecordBatch.from_arrays([pa.array([chunk], pa.int64()), doc_ids, pa.array([packed], pa.binary())], ["chunk", "doc_ids", "texts"])

    def assemble(docs: pa.Table, ids: pa.Table) -> pa.Table:
        blocks = list(zip(docs.column("doc_ids").combine_chunks(), docs.column("texts").to_pylist(), strict=True))
        own: set[str] = set()
        for _, packed in blocks:
            for text in json.loads(_raw(packed)):
                own.update(split_words(text))
        parts, known = by_bucket(own, buckets), {}
        for bucket, packed in zip(ids.column("bucket").to_pylist(), ids.column("ids").to_pylist(), strict=True):
            known.update(_ids_of(parts.pop(bucket), packed))
        get, out = known.__getitem__, []
        for doc_ids, packed in blocks:
            found = [b"".join(map(get, split_words(text))) for text in json.loads(_raw(packed))]
            offsets = np.concatenate([[0], np.cumsum([len(x) // 4 for x in found])]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(found), "<i4")))
            out.append(pa.table([doc_ids.values, lists], names=["id", "ids"]))
        return pa.concat_tables(out) if out else pa.table([pa.array([], docs.schema.field("doc_ids").type.value_type), pa.array([], pa.list_(pa.int32()))], names=["id", "ids"])

    docs = rows.mapInArrow(squeeze, packed_schema)
    return docs.groupBy("chunk").cogroup(ids.groupBy("chunk")).applyInArrow(assemble, schema).withColumnRenamed("id", id_col)


def decode(df: DataFrame, file: str, ids_col: str = "ids") -> DataFrame:
    """``df`` with ``decoded``: the bytes of its ids, joined with the table of token bytes.

    The table has one row per id of the vocabulary, whatever the data, so every task loads it.
    """
    schema = T.StructType([*df.schema, T.StructField("decoded", T.BinaryType())])

    def run(it):
        by_rank = {rank: token for token, rank in load_ranks(file).items()}
        for batch in it:
            column = batch.column(ids_col)
            decoded = [b"".join(map(by_rank.__getitem__, x.values.to_numpy().tolist())) if x.is_valid else b"" for x in column]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(decoded, pa.binary())], [*batch.schema.names, "decoded"])

    return df.mapInArrow(run, schema)
