"""Benchmark decontamination: rare word-pair seeds, then Smith-Waterman alignment of words.

An alignment of m matched words and e errors has at most e + 1 runs of matches, so at least m - e - 1
of the item's word pairs stand in the document: a score of s words takes s - 1 pairs. One pass over the
whole corpus counts the document frequency of every pair of the benchmark and keeps the documents that
may hold an alignment: whichever s - 1 - h pairs of an item are left aside, h of the others must be there.
The pairs of an item that are rarest in the corpus, all but s - 2 of them, are its seeds: no alignment
from the threshold on is without one. A kept document that holds a seed, and s - 1 of the item's pairs
around it, is aligned with the item. The best local alignment, relative to the item's length, is the
score: copies have 1, edited ones what their edits leave.
"""

from __future__ import annotations

import math
import re
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F, types as T

from rowtrail.llm.common import mix64, release, texts, with_fields, written

GRAM = 2
FACTORS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], np.uint64)
BLOCK_WORDS = 1_000_000
MATCH, MISMATCH, GAP = 1, -1, -1
WORD = re.compile(r"[^\W_]+")
FILTER_BITS = 18
HITS = 8
PLACES = 1_000_000

# Every ASCII character that is no letter or digit, as a blank.
BLANKED = {c: " " for c in range(128) if not chr(c).isalnum()}


def split_words(text: str) -> list[str]:
    """The words of ``text`` (runs of letters and digits, in lower case) in order."""
    text = text.lower()
    return text.translate(BLANKED).split() if text.isascii() else WORD.findall(text)


def _of_size(words: np.ndarray, at: np.ndarray, size: int) -> np.ndarray:
    """Hashes of the runs of ``size`` words that begin at ``at``; each place in a run has a factor of its own."""
    total = np.full(len(at), size, np.uint64)
    for k in range(size):
        total += words[at + k] * FACTORS[k]
    return mix64(total)


def least_score(size: int, threshold: float) -> int:
    """The least whole score from ``threshold`` on of an item of ``size`` words."""
    return max(1, math.ceil(threshold * MATCH * size))


def gram_size(size: int, threshold: float) -> int:
    """Words a gram of an item has: a pair; all of a shorter item; one, if one word is enough of an item."""
    return size if size <= GRAM else GRAM if least_score(size, threshold) > 1 else 1


class Items:
    """Words and grams of one block of the benchmark; travels to every task."""

    def __init__(self, rows: list[tuple[object, str]], threshold: float):
        self.ids = [i for i, _ in rows]
        listed = [split_words(t) for _, t in rows]
        # 64-bit hashes of the block's words; 0 stands for every other word.
        self.hashes = {w: xxhash.xxh3_64_intdigest(w.encode("utf-8", "surrogatepass")) or 1 for words in listed for w in words}
        self.words = [self.hashed(words) for words in listed]
        sizes = [gram_size(len(w), threshold) for w in self.words]
        grams = [_of_size(w, np.arange(len(w) - n + 1), n) if n else w for w, n in zip(self.words, sizes, strict=True)]
        # The least grams that an alignment from the threshold on keeps.
        self.least = np.array([least_score(len(w), threshold) - 1 if len(w) > GRAM == n else 1 for w, n in zip(self.words, sizes, strict=True)], np.int64)
        # As many of them are asked of a row to be kept, among the grams that are rarest in the block.
        self.hits = np.minimum(self.least, HITS)
        self.sizes = sorted({n for n in sizes if n})
        self.known = np.unique(np.concatenate([*grams, np.zeros(0, np.uint64)]))
        # Per item, the index in ``known`` of the gram at each of its positions.
        self.grams = [np.searchsorted(self.known, g) for g in grams]

    def hashed(self, words: list[str]) -> np.ndarray:
        """The hash of each word, 0 for words that no item of the block has."""
        return np.fromiter(map(self.hashes.get, words, repeat(0)), np.uint64, len(words))

    def lookup(self):
        """A function that gives (position, index into ``known``) of a document's grams that are in it."""
        wanted = self.known
        seen = np.zeros(1 << FILTER_BITS, bool)
        seen[wanted >> np.uint64(64 - FILTER_BITS)] = True

        def find(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            ats, found, known = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], words != 0
            for n in self.sizes:
                at = np.flatnonzero(np.logical_and.reduce([known[k : len(known) - n + 1 + k] for k in range(n)]))
                g = _of_size(words, at, n)
                likely = seen[g >> np.uint64(64 - FILTER_BITS)]
                at, g = at[likely], g[likely]
                index = np.minimum(np.searchsorted(wanted, g), max(0, len(wanted) - 1))
                hit = wanted[index] == g if len(wanted) else np.zeros(0, bool)
                ats.append(at[hit])
                found.append(index[hit])
            return np.concatenate(ats), np.concatenate(found)

        return find


def align(item: np.ndarray, passage: np.ndarray) -> tuple[int, int, int]:
    """(score, start, end) of the best local alignment in ``passage``; end exclusive, leftmost end on ties.

    One row per word of the item. Gaps along the row are a running maximum, as each word costs the same.
    """
    n = len(passage)
    steps = np.arange(n + 1) * -GAP
    row, best = np.zeros(n + 1, np.int64), (0, 0, 0)
    begin = np.arange(n + 1)  # where the alignment that ends here began
    for word in item:
        step = np.where(passage == word, MATCH, MISMATCH)
        diagonal, up = row[:-1] + step, row[1:] + GAP
        now, start = np.zeros(n + 1, np.int64), np.arange(n + 1)
        take = diagonal >= up
        now[1:] = np.maximum(np.where(take, diagonal, up), 0)
        start[1:] = np.where(now[1:] > 0, np.where(take, begin[:-1], begin[1:]), start[1:])
        lifted = now + steps
        top = np.maximum.accumulate(lifted)
        source = np.maximum.accumulate(np.where(lifted == top, np.arange(n + 1), 0))
        row, begin = top - steps, np.where(top > lifted, start[source], start)
        end = int(row.argmax())
        if row[end] > best[0]:
            best = (int(row[end]), int(begin[end]), end)
    return best


def _windows(at: np.ndarray, size: int, slack: int, length: int) -> list[tuple[int, int]]:
    """Merged stretches of the document where an item of ``size`` words can lie, from its seeds' shifts.

    ``slack`` is the number of words that can be put in between.
    """
    found: list[list[int]] = []
    for shift in np.unique(at).tolist():
        lo, hi = max(0, shift - slack), min(length, shift + size + slack)
        if found and lo <= found[-1][1]:
            found[-1][1] = max(hi, found[-1][1])
        else:
            found.append([lo, hi])
    return [(a, b) for a, b in found]


def _seeds(items: Items, counts: np.ndarray, hits: np.ndarray | int = 1) -> list[np.ndarray]:
    """Per item, the positions of its rarest grams, as many as no kept alignment can be without ``hits`` of them.

    Grams without a count match nothing and are left out.
    """
    found = []
    for grams, most in zip(items.grams, (hits - items.least).tolist(), strict=True):
        order = np.lexsort((np.arange(len(grams)), counts[grams]))[: max(0, len(grams) + most)]
        found.append(np.sort(order[counts[grams[order]] > 0]))
    return found


class Places:
    """(item, position) of the grams at some positions of the items, by the gram's index."""

    def __init__(self, items: Items, positions: list[np.ndarray]):
        gram = np.concatenate([*(g[p] for g, p in zip(items.grams, positions, strict=True)), np.zeros(0, np.int64)])
        item = np.repeat(np.arange(len(positions)), [len(p) for p in positions])
        order = np.argsort(gram, kind="stable")
        self.item, self.position = item[order], np.concatenate([*positions, np.zeros(0, np.int64)])[order].astype(np.int64)
        self.first = np.searchsorted(gram[order], np.arange(len(items.known) + 1))

    def of(self, at: np.ndarray, grams: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(at, item, position) of each place of each gram that was found at ``at``."""
        n = self.first[grams + 1] - self.first[grams]
        index = np.repeat(self.first[grams] - np.cumsum(n) + n, n) + np.arange(n.sum())
        return np.repeat(at, n), self.item[index], self.position[index]


def _promising(items: Items, rare: Places, doc: np.ndarray, gram: np.ndarray) -> np.ndarray:
    """The documents that hold enough of an item's rare grams, from (document, gram) in order, each once.

    Some ``PLACES`` places are listed at a time, or those of one document.
    """
    if not len(doc):
        return doc
    begin = np.flatnonzero(np.r_[True, np.diff(doc) > 0])
    sizes = np.cumsum(np.add.reduceat(rare.first[gram + 1] - rare.first[gram], begin)) // PLACES
    cuts, n, found = begin[np.r_[True, np.diff(sizes) > 0]].tolist(), len(items.ids), []
    for lo, hi in zip(cuts, [*cuts[1:], len(doc)], strict=True):
        own, item, _ = rare.of(doc[lo:hi], gram[lo:hi])
        pair, hits = np.unique(own * n + item, return_counts=True)
        found.append(np.unique(pair[hits >= items.hits[pair % n]] // n))
    return np.concatenate(found)


def _scan(rows: DataFrame, items: Items) -> tuple[np.ndarray, DataFrame]:
    """In how many rows of the corpus each known gram occurs, and the rows that may hold an item, written.

    Both come from one pass over the corpus: a task's counts follow its rows, summed.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    n = len(items.known)
    rare = Places(items, _seeds(items, np.bincount(np.concatenate([*items.grams, np.zeros(0, np.int64)]), minlength=n), items.hits))
    fields = [("id", rows.schema["id"].dataType), ("text", T.StringType()), ("gram", T.LongType()), ("n", T.LongType())]
    schema = T.StructType([T.StructField(*f) for f in fields])

    def run(it):
        arrow, find, total, other = to_arrow_schema(schema), items.lookup(), np.zeros(n, np.int64), np.zeros(1, np.uint64)
        for batch in it:
            # An unknown word after each text: no gram reaches into the next one.
            parts = [x for text in batch.column("text") for x in (items.hashed(split_words(text.as_py())), other)]
            ends = np.cumsum([len(x) + 1 for x in parts[::2]], dtype=np.int64)
            at, gram = find(np.concatenate([*parts, other]))
            doc, gram = np.divmod(np.unique(np.searchsorted(ends, at, side="right") * n + gram), max(1, n))
            total += np.bincount(gram, minlength=n)
            kept = pa.array(_promising(items, rare, doc, gram), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("id").take(kept), batch.column("text").take(kept), *[pa.nulls(len(kept), pa.int64())] * 2], schema=arrow)
            del batch, parts
        release()
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([*(pa.nulls(len(used), arrow.field(c).type) for c in range(2)), pa.array(used, pa.int64()), pa.array(total[used], pa.int64())], schema=arrow)

    both, counts = written(rows.select("id", "text").mapInArrow(run, schema), "decontam"), np.zeros(n, np.int64)
    for row in both.filter("gram IS NOT NULL").groupBy("gram").agg(F.sum("n").alias("n")).collect():
        counts[row["gram"]] = row["n"]
    return counts, both.filter("gram IS NULL").select("id", "text")


def find_leaks(
    df: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text",
    threshold: float = 0.5, block_words: int = BLOCK_WORDS,
) -> DataFrame:
    """(id, item, score, start, end): each row's best alignment with each item, from ``threshold`` on.

    ``start`` and ``end`` count words of the document. Every alignment from ``threshold`` on is found,
    whatever its edits; seeds have no upper frequency. Null and empty texts, of documents and of
    items, match nothing; an item of fewer than three words is looked up whole. Ids may be null or
    repeat; equal rows of the result are merged. The benchmark is read in blocks of about
    ``block_words`` words, each of which passes over the corpus once without shuffling texts; documents that
    may hold an item are written to the session's shared folder and read again.
    """
    rows, listed = texts(df, id_col, text_col), texts(benchmark, item_col, item_text)
    kind, spark = listed.schema["id"].dataType, df.sparkSession
    schema = with_fields(rows, item=kind, score=T.DoubleType(), start=T.LongType(), end=T.LongType())
    words = listed.agg(F.sum(F.size(F.split("text", r"\s+")))).first()[0] or 0
    n_blocks, out = max(1, math.ceil(words / block_words)), None
    for k in range(n_blocks):
        block = listed.filter(F.pmod(F.xxhash64("id", "text"), F.lit(n_blocks)) == k).distinct()
        items = Items([(r["id"], r["text"]) for r in block.collect()], threshold)  # a block of bounded size
        counts, kept = _scan(rows, items)
        places = Places(items, _seeds(items, counts))
        found = kept.mapInArrow(_searcher(items, places, threshold, schema), schema).distinct()
        out = found if out is None else out.unionByName(found)
    return out.select(F.col("id").alias(id_col), F.col("item").alias(item_col), "score", "start", "end")


def _searcher(items: Items, places: Places, threshold: float, schema: T.StructType):
    def leaks(words: np.ndarray, find, present: np.ndarray):
        at, gram = find(words)
        seeded, number, offset = places.of(at, gram)
        if not len(seeded):
            return
        order = np.argsort(number, kind="stable")
        shifts, number = (seeded - offset)[order], number[order]
        present[gram] = True
        kept = [(k, own) for k, own in zip(number[np.r_[True, np.diff(number) > 0]].tolist(), np.split(shifts, np.flatnonzero(np.diff(number)) + 1), strict=True) if np.count_nonzero(present[items.grams[k]]) >= items.least[k]]
        present[gram] = False
        for k, own in kept:
            item, best = items.words[k], (0, 0, 0)
            least = least_score(len(item), threshold)
            for lo, hi in _windows(own, len(item), max(0, len(item) - least), len(words)):
                near = gram[(at >= lo) & (at < hi)]
                present[near] = True
                enough = np.count_nonzero(present[items.grams[k]]) >= items.least[k]
                present[near] = False
                if enough:
                    score, start, end = align(item, words[lo:hi])
                    if score > best[0]:
                        best = (score, lo + start, lo + end)
            if best[0] >= threshold * MATCH * len(item):
                yield items.ids[k], best[0] / (MATCH * len(item)), best[1], best[2]

    def run(it):
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow, find, present = to_arrow_schema(schema), items.lookup(), np.zeros(len(items.known), bool)
        for batch in it:
            owner, found = [], []
            for i, text in enumerate(batch.column("text")):
                for leak in leaks(items.hashed(split_words(text.as_py())), find, present):
                    owner.append(i)
                    found.append(leak)
            columns = [batch.column("id").take(pa.array(owner, pa.int64())), *(pa.array([x[c] for x in found], arrow.field(c + 1).type) for c in range(4))]
            yield pa.RecordBatch.from_arrays(columns, schema=arrow)

    return run
