"""Language identification by Bayesian evidence fusion.

Four kinds of evidence meet in one posterior: the text's likelihood under character n-gram models, the
language that the markup declares, the suffix of the address, and the host's prior. The reliability
of declarations and suffixes and the priors come from grouped sums of text posteriors over all rows;
a host's prior is smoothed by its registered domain's, and that by the whole table's. A row's own
share is taken out of its host's sums before they judge it.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from html import unescape
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from rowtrail.llm.common import Recent, batches, named, written
from rowtrail.llm.toxicity import STRIP

BUCKETS = 1 << 14
LONGEST = 4
CACHE = 100_000
SLICE_WORDS = 1 << 17
TEMPER = 200.0  # n-grams that a longer text counts as: neighbouring ones are no independent evidence
HOST_WEIGHT, DOMAIN_WEIGHT, TABLE_WEIGHT, TRUST_WEIGHT = 8.0, 20.0, 4.0, 2.0
FLOOR = 0.5

# Elements whose content is not shown, comments, and what ends each.
HIDDEN = re.compile(r"(?i)<(?:(script|style|head|nav)\b|!--)")
CLOSING = {tag: re.compile(rf"(?i)</{tag}\s*>") for tag in ("script", "style", "head", "nav")} | {"": re.compile("-->")}
TAG = re.compile(r"<[^>]*>")
HTML = re.compile(r"(?i)<html\b")
DECLARED = re.compile(r"""(?i)\blang\s*=\s*["']?([A-Za-z]+)""")
# Labels that stand between a name and a country in public suffixes.
SECOND_LEVEL = ["ac", "co", "com", "edu", "gob", "gov", "mil", "ne", "net", "or", "org"]


@dataclass
class Model:
    """Languages, log probability of each n-gram bucket, and the least mean log likelihood of a known text."""

    languages: list[str]
    logs: np.ndarray  # buckets x languages
    least: float


def _grams(word: str) -> list[int]:
    """Buckets of the 1- to 4-grams of a word between marks."""
    marked = f" {word} "
    return [
        crc32(marked[i : i + n].encode("utf-8", "surrogatepass")) % BUCKETS for n in range(1, LONGEST + 1) for i in range(len(marked) - n + 1)
    ]


def words_of(text: str) -> list[str]:
    """Words that hold a letter, in lower case, without punctuation around them."""
    return [w for x in text.lower().split() if (w := x.strip(STRIP)) and any(map(str.isalpha, w))]


def train(df: DataFrame, label_col: str, id_col: str = "doc_id", text_col: str = "text", per_language: int = 1500) -> Model:
    """N-gram counts by language from at most ``per_language`` labelled rows of each, by hash of the row.

    Rows without text or label teach nothing, equal rows teach once. Every label that has text is a
    language; the model takes 128 KB for each.
    """
    rows = df.select(F.xxhash64(named(id_col), named(text_col)).alias("h"), F.lower(named(label_col)).alias("y"), named(text_col).alias("text"))
    rows = rows.filter(F.col("y").isNotNull() & F.col("text").rlike(r"\p{L}"))
    # Three times the rows wanted of a label pass by their hash, so its window is small however common it is.
    sizes = rows.groupBy("y").agg(F.approx_count_distinct("h").alias("size"))
    passed = rows.join(F.broadcast(sizes), "y").filter(F.col("h") / 2.0**64 + 0.5 <= 3.0 * per_language / F.col("size")).dropDuplicates(["y", "h"])
    sample = passed.withColumn("at", F.row_number().over(Window.partitionBy("y").orderBy("h"))).filter(F.col("at") <= per_language)

    def run(it):
        sums, grams = {}, Recent(lambda words: [np.array(_grams(w), np.int16).tobytes() for w in words], CACHE)
        for batch in it:
            for text, y in zip(batch.column("text"), batch.column("y").to_pylist(), strict=True):
                if words := words_of(text.as_py()):
                    own = sums.setdefault(y, np.zeros(BUCKETS, "<i8"))
                    own += np.bincount(np.frombuffer(b"".join(grams.fetch(words)), np.int16), minlength=BUCKETS)
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.string()), pa.array([zlib.compress(x.tobytes()) for x in sums.values()], pa.binary())], ["y", "counts"])

    found: dict[str, np.ndarray] = {}
    for r in sample.select("text", "y").mapInArrow(run, "y string, counts binary").collect():
        found[r["y"]] = found.get(r["y"], 0) + np.frombuffer(zlib.decompress(r["counts"]), "<i8")
    if not found:
        return Model([], np.zeros((BUCKETS, 0)), 0.0)
    labels = sorted(found)
    counts = np.stack([found[y] for y in labels], 1)
    logs = np.log((counts + 0.5) / (counts + 0.5).sum(0))
    # A text less likely than noise over all buckets is of none of the languages.
    return Model(labels, logs, float(np.log(1 / BUCKETS)))


def visible(html: str) -> str:
    """The text of a page, by one scan from left to right; what is never closed hides nothing."""
    parts, at, open_, lo = [], 0, set(CLOSING), 0
    while found := HIDDEN.search(html, lo):
        kind, lo = (found.group(1) or "").lower(), found.end()
        if kind in open_:
            if end := CLOSING[kind].search(html, lo):
                parts.append(html[at : found.start()])
                at = lo = end.end()
            else:  # nor can any later one of its kind
                open_.discard(kind)
    html = " ".join([*parts, html[at:]])
    last = html.rfind(">") + 1  # beyond it no tag ends
    return unescape(TAG.sub(" ", html[:last]) + html[last:])


def declared_language(html: str) -> str | None:
    """The language in the first ``html`` tag that names one."""
    lo = 0
    while found := HTML.search(html, lo):
        end = html.find(">", found.end())
        end = len(html) if end < 0 else end
        if named_ := DECLARED.search(html, found.end(), end):
            return named_.group(1).lower()
        lo = end  # a tag within this one holds no more than it
    return None


def page_evidence(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(id, text, declared, suffix, host, domain) of web pages; what is absent is null."""
    rows = pages.select(named(id_col).alias("id"), named(url_col).alias("url"), F.coalesce(named(html_col), F.lit("")).alias("html"))
    schema = T.StructType([rows.schema["id"], T.StructField("url", T.StringType()), T.StructField("text", T.StringType()), T.StructField("declared", T.StringType())])

    def run(batch: pa.RecordBatch) -> dict:
        text, declared = [], []
        for page in batch.column("html"):
            html = page.as_py()
            text.append(visible(html))
            declared.append(declared_language(html))
        return {"id": batch.column("id"), "url": batch.column("url"), "text": text, "declared": declared}

    found = rows.mapInArrow(batches(run, schema), schema)
    host = F.lower(F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?(\[[^\]]*\]|[^/?#:]+)", 1))
    found = found.withColumn("host", F.nullif(F.rtrim(host, F.lit(".")), F.lit("")))
    suffix = F.nullif(F.regexp_extract("host", r"\.([a-z][a-z0-9-]*)$", 1), F.lit(""))
    # An address of numbers is its own domain; below a public suffix of two parts the domain has three.
    number = F.col("host").rlike(r"^\[|^[0-9]+(\.[0-9]+){3}$")
    domain = F.regexp_extract("host", rf"([^.]+\.(?:(?:{'|'.join(SECOND_LEVEL)})\.[a-z]{{2}}|[^.]+))$", 1)
    return found.select("id", "text", "declared", suffix.alias("suffix"), "host", F.when(number, F.col("host")).otherwise(F.nullif(domain, F.lit(""))).alias("domain"))


def row_evidence(df: DataFrame, declared: str | None = None, host: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The same of plain rows: ``declared`` and ``host`` name columns."""
    get = lambda c: named(c).cast("string") if c else F.lit(None).cast("string")
    text = F.coalesce(named(text_col), F.lit("")).alias("text")
    return df.select(named(id_col).alias("id"), text, F.lower(get(declared)).alias("declared"), F.lit(None).cast("string").alias("suffix"), get(host).alias("host"), get(host).alias("domain"))


def likelihoods(evidence: DataFrame, model: Model) -> DataFrame:
    """``evidence`` without text, with ``n_grams``, ``logs`` (log likelihood by language) and ``known``."""
    rest = ["id", "declared", "suffix", "host", "domain"]
    schema = T.StructType([*(evidence.schema[c] for c in rest), T.StructField("n_grams", T.LongType()), T.StructField("logs", T.ArrayType(T.DoubleType())), T.StructField("known", T.BooleanType())])
    logs, least, n = model.logs, model.least, len(model.languages)

    def word_logs(words: list[str]) -> list[bytes]:
        """Log likelihood by language and number of n-grams of each word."""
        return [np.append(logs[own := _grams(word)].sum(0), len(own)).tobytes() for word in words]

    def run(it):
        known = Recent(word_logs, CACHE)

        def some(texts: list[list[str]]) -> Iterator[tuple[int, list[float], bool]]:
            sizes = np.array([len(words) for words in texts])
            total, used = np.zeros((len(texts), n + 1)), np.flatnonzero(sizes)
            if n and len(used):
                found = np.frombuffer(b"".join(known.fetch([w for words in texts for w in words]))).reshape(-1, n + 1)
                total[used] = np.add.reduceat(found, (np.cumsum(sizes) - sizes)[used])
            for row in total:
                grams, own = int(row[-1]), row[:-1]
                yield (grams, (own * min(1.0, TEMPER / grams)).tolist(), bool(own.max() / grams >= least)) if grams else (0, [0.0] * n, False)

        def make(batch: pa.RecordBatch) -> dict:
            got, held, size = [], [], 0
            for text in batch.column("text"):
                held.append(words_of(text.as_py()))
                size += len(held[-1])
                if size >= SLICE_WORDS:
                    got += some(held)
                    held, size = [], 0
            got += some(held)
            return {c: batch.column(c) for c in rest} | {"n_grams": [g for g, _, _ in got], "logs": [x for _, x, _ in got], "known": [k for _, _, k in got]}

        yield from batches(make, schema)(it)

    text = F.coalesce("text", F.lit("")).alias("text")
    return evidence.select(*rest, text).mapInArrow(run, schema)


def _once(value: Column, use) -> Column:
    """``use(value)`` with ``value`` computed once, though ``use`` names it inside of a lambda."""
    return F.transform(F.array(value), use)[0]


def _total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda x, y: x + y)


def _softmax(logs: Column) -> Column:
    shifted = lambda x: _once(F.array_max(x), lambda top: F.transform(x, lambda y: F.exp(y - top)))
    shared = lambda x: _once(_total(x), lambda total: F.transform(x, lambda y: y / total))
    return _once(_once(logs, shifted), shared)


def identify(evidence: DataFrame, model: Model) -> DataFrame:
    """(id, lang, confidence, text_lang, declared, host, n_grams, rejected) for every row of ``evidence``.

    ``lang`` is the likeliest language, the earlier in the alphabet on ties; it is ``und`` and the row
    ``rejected`` where no word has a letter, where the text is unlike all known languages, or where
    the posterior stays under one half. Null texts, declarations, suffixes and hosts are no evidence. Ids
    may be null or repeat. Without any language known, all rows are rejected.
    """
    names = sorted(model.languages)
    model = Model(names, model.logs[:, [model.languages.index(y) for y in names]], model.least)
    rows = written(likelihoods(evidence, model).withColumn("own", _softmax(F.col("logs"))), "evidence")
    n = len(names)
    if not n:
        return rows.select("id", F.lit("und").alias("lang"), F.lit(0.0).alias("confidence"), F.lit("und").alias("text_lang"), "declared", "host", "n_grams", F.lit(True).alias("rejected"))
    sums = [F.sum(F.when(F.col("known"), F.col("own")[k]).otherwise(0.0)).alias(f"s{k}") for k in range(n)]
    packed = lambda name: F.array(*[f"s{k}" for k in range(n)]).alias(name)
    whole = rows.agg(*sums).select(packed("x")).first()["x"]
    whole = [((s or 0.0) + TABLE_WEIGHT / n) / (sum(x or 0.0 for x in whole) + TABLE_WEIGHT) for s in whole]
    base = F.array(*[F.lit(x) for x in whole])
    # One sum per key and task goes through the exchange, however many rows a host has.
    grouped = lambda key, name: rows.filter(F.col(key).isNotNull()).groupBy(key).agg(*sums).select(key, packed(name))
    nothing = F.array(*[F.lit(0.0)] * n)
    joined = rows
    for key in ("host", "domain", "declared", "suffix"):
        joined = joined.join(grouped(key, f"by_{key}"), key, "left")
    mine = F.when(F.col("known"), F.col("own")).otherwise(nothing)
    # All sums without the row's own share.
    for key in ("host", "domain", "declared", "suffix"):
        left = F.zip_with(F.coalesce(f"by_{key}", nothing), mine, lambda a, b: F.greatest(a - b, F.lit(0.0)))
        joined = joined.withColumn(f"by_{key}", F.when(F.col(key).isNull(), nothing).otherwise(left))

    def smoothed(sums: Column, prior: Column, weight: float) -> Column:
        return _once(sums, lambda own: _once(_total(own), lambda total: F.zip_with(own, prior, lambda s, p: (s + F.lit(weight) * p) / (total + F.lit(weight)))))

    joined = joined.withColumn("p_domain", smoothed(F.col("by_domain"), base, DOMAIN_WEIGHT))
    joined = joined.withColumn("p_host", smoothed(F.col("by_host"), F.col("p_domain"), HOST_WEIGHT))
    # P(sign | language) up to a factor: P(language | sign) / P(language).
    for key in ("declared", "suffix"):
        joined = joined.withColumn(f"l_{key}", F.zip_with(smoothed(F.col(f"by_{key}"), base, TRUST_WEIGHT), base, lambda p, q: F.log(p / q)))
    add = lambda a, b: F.zip_with(a, b, lambda x, y: x + y)
    logs = add(add(F.col("logs"), F.transform("p_host", lambda p: F.log(p))), add(F.col("l_declared"), F.col("l_suffix")))
    joined = joined.withColumn("posterior", _softmax(logs))
    languages = F.array(*[F.lit(y) for y in names])
    best = lambda a: F.element_at(languages, F.array_position(a, F.array_max(a)).cast("int"))
    confidence = F.array_max("posterior")
    rejected = (F.col("n_grams") == 0) | ~F.col("known") | (confidence < FLOOR)
    return joined.select(
        "id", F.when(rejected, "und").otherwise(best(F.col("posterior"))).alias("lang"), confidence.alias("confidence"),
        F.when(F.col("n_grams") == 0, "und").otherwise(best(F.col("own"))).alias("text_lang"), "declared", "host", "n_grams", rejected.alias("rejected"),
    )
