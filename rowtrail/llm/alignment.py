"""Alignment of the tokens that two tokenizers make of the same texts.

Both tokenizers cover the same bytes. Byte offsets where tokens of both end cut a text into groups; a
token of one is linked with every token of the other whose bytes overlap. For every id A that some id
B spells alike, an identity map holds that B: pairs of it are counted in vectors as long as the
vocabulary, and only the pairs of irregular groups are exploded, shuffled, counted and joined back.

Texts are cut into units that neither tokenizer's tokens span, so each unit's ids are looked up or
made once per task. All offsets, links and groups of a slice of texts are then found by arrays.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T
from pyspark.taskcontext import TaskContext

from rowtrail.llm.common import Recent, release, texts, written
from rowtrail.llm.tokenfile import _byte_letters

SLICE_BYTES = 1 << 20
CHUNK_BYTES = 8 << 20
CHUNK_DOCS = 50_000
MISSES = 4096  # units encoded in one call
# A unit starts at a blank or line feed after other text, so tokens of both vocabularies end before it.
UNITS = re.compile(r"[ \n]\s*\S*(?:[^\S \n]\s*\S*)*")
CUT = re.compile(r"(?<=\S)[ \n]")
BYTE = re.compile(r"<0x([0-9A-Fa-f]{2})>")
MARK = "▁"


class Vocabularies:
    """Both tokenizers, the bytes of their ids, and the identity map from A's ids to B's."""

    def __init__(self, file_a: str, file_b: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(file_a)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=file_b)
        letters = {chr(letter): byte for byte, letter in _byte_letters().items()}
        self.bytes_a = [b""] * self.a.get_vocab_size()
        for token, i in self.a.get_vocab().items():
            self.bytes_a[i] = bytes(map(letters.__getitem__, token)) if all(c in letters for c in token) else token.encode()
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        unusable = [self.b.is_control(i) or self.b.is_unknown(i) for i in range(len(pieces))]
        self.bytes_b = [
            b"" if bad else bytes([int(m.group(1), 16)]) if self.b.is_byte(i) and (m := BYTE.fullmatch(p)) else p.replace(MARK, " ").encode()
            for i, (p, bad) in enumerate(zip(pieces, unusable, strict=True))
        ]
        # What UNITS relies on: tokens of B hold blanks only in front, and no line feed beside other characters.
        if any(re.search(f"[^{MARK}]{MARK}", p) or "\n" in p and p != "\n" for p in pieces):
            raise ValueError("a token of this vocabulary spans units")
        self.blank = self.b.piece_to_id(MARK)
        self.size_a = np.array([len(x) for x in self.bytes_a], np.int64)
        self.size_b = np.array([len(x) for x in self.bytes_b], np.int64)
        # Byte tokens first, so that a piece of the same bytes takes their place.
        spelled = {self.bytes_b[i]: i for i in sorted(range(len(pieces)), key=lambda i: (not self.b.is_byte(i), -i)) if self.bytes_b[i]}
        self.same = np.array([spelled.get(x, -1) if x else -1 for x in self.bytes_a], np.int64)

    def _ids(self, text: str) -> tuple[np.ndarray, np.ndarray] | None:
        """Ids of both for a text that starts a unit; None if their bytes are not the text's."""
        a = self.a.encode(text, add_special_tokens=False).ids
        if text == " ":
            b = [self.blank]
        elif text[0] == " ":
            b = self.b.encode(text[1:], num_threads=1)
        else:  # the blank put before a line feed is a token of its own
            b = self.b.encode(text, num_threads=1)
            if b[:1] != [self.blank]:
                return None
            b = b[1:]
        raw = text.encode("utf-8", "surrogatepass")
        if MARK in text or b"".join(map(self.bytes_a.__getitem__, a)) != raw or b"".join(map(self.bytes_b.__getitem__, b)) != raw:
            return None
        return np.array(a, "<u4"), np.array(b, "<u4")

    def encode(self, units: list[str]) -> list[tuple[bytes, bytes] | None]:
        """Ids of both for each unit, as little-endian bytes; None where bytes differ from the unit's."""
        out: dict[str, tuple[bytes, bytes] | None] = {}
        # Units that end in text can be encoded behind each other in one call.
        solid = [u for u in units if not u[-1].isspace() and MARK not in u]
        for lo in range(0, len(solid), MISSES):
            some = solid[lo : lo + MISSES]
            found = self._ids("".join(some))
            if found is None:
                continue
            ends = np.cumsum([len(u.encode("utf-8", "surrogatepass")) for u in some])
            parts = []
            for ids, size in zip(found, (self.size_a, self.size_b), strict=True):
                at = np.cumsum(size[ids])
                stop = np.searchsorted(at, ends) + 1
                if (at[stop - 1] != ends).any():
                    break
                raw, stop = ids.tobytes(), (4 * stop).tolist()
                parts.append([raw[x:y] for x, y in zip([0, *stop], stop)])  # noqa: B905
            if len(parts) == 2:
                out.update(zip(some, zip(*parts, strict=True), strict=True))
        for u in units:
            if u not in out:
                found = self._ids(u)
                out[u] = None if found is None else (found[0].tobytes(), found[1].tobytes())
        return [out[u] for u in units]


def sections(text: str) -> Iterator[str]:
    """A blank and the text, cut between units into parts of about ``SLICE_BYTES`` characters."""
    text, lo = " " + text, 0
    while len(text) - lo > SLICE_BYTES and (cut := CUT.search(text, lo + SLICE_BYTES)):
        yield text[lo : cut.start()]
        lo = cut.start()
    yield text[lo:] if lo else text


class Aligner:
    """Aligns slices of sections; a task's units are encoded once while they are in use."""

    def __init__(self, vocabularies: Vocabularies):
        self.v = vocabularies
        self.known = Recent(vocabularies.encode)
        digits = len(str(max(len(vocabularies.bytes_a), len(vocabularies.bytes_b))))
        each = np.arange(max(len(vocabularies.bytes_a), len(vocabularies.bytes_b)))
        self.digits = np.array([list(f"{i:<{digits}}".encode()) + [0] for i in each.tolist()], np.uint8)
        self.digits[self.digits == 32] = 0
        self.width = (self.digits > 0).sum(1) + 1

    def slice(self, parts: list[str]) -> dict[str, np.ndarray | list]:
        """Of each section: valid, n_a, n_b, n_groups, n_links, groups (bytes); of all: (section, code, times) of its distinct links."""
        units = [UNITS.findall(p) for p in parts]
        found = iter(self.known.fetch([u for own in units for u in own]))
        valid, raw_a, raw_b = [], [], []
        for own in units:
            got = list(islice(found, len(own)))
            good = None not in got
            valid.append(good)
            raw_a.append(b"".join([a for a, _ in got]) if good else b"")
            raw_b.append(b"".join([b for _, b in got]) if good else b"")
        n_a, n_b = (np.array([len(x) // 4 for x in raw], np.int64) for raw in (raw_a, raw_b))
        a, b = (np.frombuffer(b"".join(raw), "<u4").astype(np.int64) for raw in (raw_a, raw_b))
        end_a, end_b = np.cumsum(self.v.size_a[a]), np.cumsum(self.v.size_b[b])
        total = int(end_a[-1]) if len(a) else 0
        is_a, is_b = np.zeros(total + 1, bool), np.zeros(total + 1, bool)
        is_a[end_a], is_b[end_b] = True, True
        both = is_a & is_b
        # Between two neighbouring ends lie bytes of one token of each: one link.
        up_a, up_b, up_g = np.cumsum(is_a), np.cumsum(is_b), np.cumsum(both)
        at = np.flatnonzero(is_a | is_b)
        left, right = a[up_a[at] - is_a[at]], b[up_b[at] - is_b[at]]
        stop_a, stop_b = np.cumsum(n_a), np.cumsum(n_b)
        stop = np.concatenate([[0], end_a])[stop_a]  # bytes up to the end of each section
        n_groups, n_links = (np.diff(np.concatenate([[0], up[stop]])) for up in (up_g, np.cumsum(is_a | is_b)))
        out = {"valid": valid, "n_a": n_a, "n_b": n_b, "n_groups": n_groups, "n_links": n_links, "groups": self._groups(a, b, end_a, end_b, both, up_a, up_b, up_g, stop_a + stop_b)}
        codes = len(self.v.size_a) * len(self.v.size_b)
        section = np.repeat(np.arange(len(parts)), n_links)
        key, times = np.unique(section * codes + left * len(self.v.size_b) + right, return_counts=True)
        return out | {"section": key // codes, "code": key % codes, "times": times}

    def _groups(self, a, b, end_a, end_b, both, up_a, up_b, up_g, stops) -> list[bytes]:
        """The groups of each section as text: A's ids, a bar, B's ids; semicolons between groups."""
        cuts = np.flatnonzero(both)
        before_b, after_a = np.concatenate([[0], up_b[cuts]]), np.concatenate([[0], up_a[cuts]])
        last_a, last_b = both[end_a], both[end_b]
        place_a = np.arange(len(a)) + before_b[up_g[end_a] - last_a]
        place_b = np.arange(len(b)) + after_a[up_g[end_b] - last_b + 1]
        ids, mark = np.empty(len(a) + len(b), np.int64), np.empty(len(a) + len(b), np.uint8)
        ids[place_a], ids[place_b] = a, b
        mark[place_a], mark[place_b] = np.where(last_a, ord("|"), ord(",")), np.where(last_b, ord(";"), ord(","))
        shown = self.digits[ids]
        shown[:, -1] = mark
        text = shown[shown > 0].tobytes()
        ends = np.concatenate([[0], np.cumsum(self.width[ids])])[stops].tolist()
        return [text[lo : max(lo, hi - 1)] for lo, hi in zip([0, *ends], ends)]  # noqa: B905


class Chunk:
    """What is known of one chunk's documents until it is written as one row."""

    def __init__(self):
        self.ids, self.rows, self.hashes, self.valid, self.parts, self.bytes, self.split = [], [], [], [], [], 0, False

    def open(self, doc_id) -> None:
        self.ids.append(doc_id)
        self.rows.append(np.zeros(4, np.int64))
        self.hashes.append(None)
        self.valid.append(True)

    def add(self, docs: list[int], found: dict) -> None:
        for k, doc in enumerate(docs):
            self.valid[doc] &= found["valid"][k]
            self.rows[doc] += [found[c][k] for c in ("n_a", "n_b", "n_groups", "n_links")]
            if self.hashes[doc] is None:
                self.hashes[doc] = hashlib.sha256(found["groups"][k])
            else:
                self.split = True
                self.hashes[doc].update(b";" + found["groups"][k])
        self.parts.append((np.array(docs, np.int64)[found["section"]], found["code"], found["times"]))

    def row(self, number: int, same: np.ndarray, n_b: int, schema: pa.Schema) -> pa.RecordBatch:
        empty = np.zeros(0, np.int64)
        doc, code, times = (np.concatenate(x) for x in zip(*self.parts, strict=True)) if self.parts else (empty, empty, empty)
        good = np.array([v and h is not None for v, h in zip(self.valid, self.hashes, strict=True)], bool)
        keep = good[doc]
        doc, code, times = doc[keep], code[keep], times[keep]
        if self.split:  # links of one document from several slices
            order = np.lexsort((code, doc))
            doc, code, times = doc[order], code[order], times[order]
            first = np.flatnonzero(np.concatenate([[True], (np.diff(doc) != 0) | (np.diff(code) != 0)])[: len(doc)])
            doc, code, times = doc[first], code[first], np.add.reduceat(times, first) if len(first) else times
        counts = np.where(good[:, None], np.array(self.rows).reshape(-1, 4), 0)
        plain = same[code // n_b] == code % n_b
        codes, place = np.unique(code[~plain], return_inverse=True)
        per_doc = lambda x: np.bincount(x, minlength=len(good)).astype("<i4").tobytes()
        row = {
            "chunk": number, "ids": self.ids, "counts": counts.astype("<i8").tobytes(),
            "hashes": [h.hexdigest() if ok else "" for h, ok in zip(self.hashes, good.tolist(), strict=True)],
            "plain_docs": per_doc(doc[plain]), "plain": (code[plain] // n_b).astype("<u4").tobytes(), "plain_times": times[plain].astype("<u4").tobytes(),
            "codes": codes, "docs": np.bincount(place, minlength=len(codes)),
            "odd_docs": per_doc(doc[~plain]), "odd": place.astype("<u4").tobytes(), "odd_times": times[~plain].astype("<u4").tobytes(),
        }
        return pa.RecordBatch.from_arrays([pa.array([row[f.name]], f.type) for f in schema], schema=schema)


def link_tokens(df: DataFrame, file_a: str, file_b: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per chunk of neighbouring documents: their counts, group digests and distinct links."""
    from pyspark.sql.pandas.types import to_arrow_schema

    rows = texts(df, id_col, text_col)
    fields = {
        "chunk": T.LongType(), "ids": T.ArrayType(rows.schema["id"].dataType), "counts": T.BinaryType(), "hashes": T.ArrayType(T.StringType()),
        "plain_docs": T.BinaryType(), "plain": T.BinaryType(), "plain_times": T.BinaryType(), "codes": T.ArrayType(T.LongType()),
        "docs": T.ArrayType(T.LongType()), "odd_docs": T.BinaryType(), "odd": T.BinaryType(), "odd_times": T.BinaryType(),
    }
    schema = T.StructType([T.StructField(n, t) for n, t in fields.items()])
    arrow = to_arrow_schema(schema)

    def run(it):
        v = Vocabularies(file_a, file_b)
        aligner, n_b = Aligner(v), len(v.bytes_b)
        chunk, number = Chunk(), TaskContext.get().partitionId() << 32
        docs, parts, size = [], [], 0
        for batch in it:
            for i, text in zip(batch.column("id"), batch.column("text"), strict=True):
                chunk.open(i.as_py())
                for part in sections(text.as_py()) if len(text.as_buffer() or b"") else ():
                    docs.append(len(chunk.ids) - 1)
                    parts.append(part)
                    size += len(part)
                    if size >= SLICE_BYTES:
                        chunk.add(docs, aligner.slice(parts))
                        chunk.bytes += size
                        docs, parts, size = [], [], 0
                if chunk.bytes >= CHUNK_BYTES or len(chunk.ids) >= CHUNK_DOCS:
                    if parts:
                        chunk.add(docs, aligner.slice(parts))
                    yield chunk.row(number, v.same, n_b, arrow)
                    chunk, number, docs, parts, size = Chunk(), number + 1, [], [], 0
        if parts:
            chunk.add(docs, aligner.slice(parts))
        if chunk.ids:
            yield chunk.row(number, v.same, n_b, arrow)
        del aligner, chunk, docs, parts
        release()

    return rows.mapInArrow(run, schema)


def count_plain(linked: DataFrame, size: int) -> np.ndarray:
    """How many documents link each id of A with the B of the same bytes: one vector per task, summed by id."""

    def run(it):
        total = np.zeros(size, np.int64)
        for batch in it:
            for raw in batch.column("plain").to_pylist():
                total += np.bincount(np.frombuffer(raw, "<u4"), minlength=size)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.array(total[used], pa.int64())], ["a", "n"])

    out = np.zeros(size, np.int64)
    for r in linked.select("plain").mapInArrow(run, "a long, n long").groupBy("a").agg(F.sum("n").alias("n")).collect():
        out[r["a"]] = r["n"]
    return out


def align(df: DataFrame, file_a: str, file_b: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) for every row of ``df``.

    A (a ``tokenizers`` file, byte level) encodes a blank and the text, B (a ``sentencepiece`` model that adds
    the blank itself) the text. The count of a pair of ids is the number of rows that hold it linked;
    ``n_best`` counts the links whose count is the highest of their A id. Null and empty texts, and texts
    that either tokenizer does not give back byte for byte, have no tokens: zeros and an empty digest. Ids
    may be null or repeat, each row counts by itself; other columns are ignored. What comes to the driver
    is bounded by A's vocabulary.
    """
    v = Vocabularies(file_a, file_b)
    n_b = len(v.bytes_b)
    linked = written(link_tokens(df, file_a, file_b, id_col, text_col), "linked")
    plain = count_plain(linked, len(v.bytes_a))
    odd = linked.select("chunk", F.explode(F.arrays_zip("codes", "docs")).alias("x")).select("chunk", "x.codes", "x.docs").withColumnRenamed("codes", "code")
    counts = written(odd.groupBy("code").agg(F.sum("docs").alias("n")), "pair-counts")
    best = plain.copy()
    for r in counts.groupBy(F.expr(f"code div {n_b}").alias("a")).agg(F.max("n").alias("n")).collect():
        best[r["a"]] = max(best[r["a"]], r["n"])
    kind = linked.schema["ids"].dataType.elementType
    schema = T.StructType([T.StructField("id", kind), *(T.StructField(n, T.LongType()) for n in ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")), T.StructField("groups_sha256", T.StringType())])

    def finish(chunks: pa.Table, pairs: pa.Table) -> pa.Table:
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(schema)
        if not len(chunks):
            return arrow.empty_table()
        get = lambda c: chunks.column(c)[0]
        ints = lambda c, kind: np.frombuffer(get(c).as_py(), kind).astype(np.int64)
        code, n = (pairs.column(c).combine_chunks().to_numpy(zero_copy_only=False).astype(np.int64) for c in ("code", "n"))
        order = np.argsort(code)
        code, n = code[order], n[order]
        if not np.array_equal(code, np.asarray(get("codes").values)):
            raise RuntimeError("pairs of a chunk are missing")
        sums = np.zeros((2, len(get("ids"))), np.int64)
        a, odd = ints("plain", "<u4"), ints("odd", "<u4")
        for sizes, times, count, top in ((ints("plain_docs", "<i4"), ints("plain_times", "<u4"), plain[a], best[a]), (ints("odd_docs", "<i4"), ints("odd_times", "<u4"), n[odd], best[code[odd] // n_b])):
            stop = np.cumsum(sizes)
            for k, own in enumerate((times * (count == top), times * count)):
                up = np.concatenate([[0], np.cumsum(own)])
                sums[k] += up[stop] - up[stop - sizes]
        counted = ints("counts", "<i8").reshape(-1, 4).T
        return pa.table([get("ids").values, *(pa.array(x, pa.int64()) for x in (*counted, *sums)), get("hashes").values], schema=arrow)

    pairs = odd.select(F.col("chunk").alias("of"), "code").join(counts, "code")
    return linked.groupBy("chunk").cogroup(pairs.groupBy("of")).applyInArrow(finish, schema).withColumnRenamed("id", id_col)
