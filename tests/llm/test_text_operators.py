"""Secret scan, token files, BPE, line dedup: against the libraries and brute force."""

import base64
import hashlib
import json
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from checks.compare import compare, duck_tables
from rowtrail.llm import bpe, common, lines, queries, secrets, tokenfile

# Texts with nulls, empty and very long ones, repeated rows, and columns that clash with the operators' own.
EDGES = [
    (1, "Alpha beta gamma delta.\n  The same long line here \nlast", "x"),
    (2, None, "x"),
    (3, "", None),
    (4, "the same LONG line here\nÉtoile des neiges à l'été\n\nthe same long line here", "y"),
    (4, "the same LONG line here\nÉtoile des neiges à l'été\n\nthe same long line here", "y"),
    (None, "the same long line here\nno id", "y"),
    (5, "word " * 30_000 + "\nthe same long line here\t", "z"),
    (6, "short\nshort", "z"),
]
SCHEMA = "doc_id long, text string, id string"


@pytest.fixture(scope="module")
def edges(spark):
    return spark.createDataFrame([(i, t, e) for i, t, e in EDGES], SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def tlv(tag, body):
    size = bytes([len(body)]) if len(body) < 128 else b"\x81" + bytes([len(body)]) if len(body) < 256 else b"\x82" + len(body).to_bytes(2, "big")
    return bytes([tag]) + size + body


def part(data):
    return base64.urlsafe_b64encode(data).decode().rstrip("=")


RSA = tlv(48, b"".join(tlv(2, x) for x in (b"\0", b"\x01" * 64, b"\3", *[b"\x05" * 32] * 6)))
EC = tlv(48, tlv(2, b"\1") + tlv(4, b"k" * 32))
PKCS8 = tlv(48, tlv(2, b"\0") + tlv(48, tlv(6, b"\x2a\x03") + tlv(5, b"")) + tlv(4, EC))
field = lambda b: len(b).to_bytes(4, "big") + b
OPENSSH = b"openssh-key-v1\0" + field(b"none") + field(b"none") + field(b"") + (1).to_bytes(4, "big") + field(b"p" * 51) + field(b"s" * 144)
JWT = ".".join([part(json.dumps({"alg": "HS256", "typ": "JWT"}).encode()), part(b'{"sub":"1"}'), part(b"m" * 32)])


@pytest.mark.parametrize(
    ("text", "kind"),
    [
        (base64.b64encode(RSA).decode(), "rsa_key"),
        (RSA.hex().upper(), "rsa_key"),
        (base64.b64encode(EC + b"").decode(), "ec_key"),
        (base64.urlsafe_b64encode(PKCS8).decode(), "pkcs8_key"),
        (base64.b64encode(OPENSSH).decode(), "openssh_key"),
        (JWT, "jwt"),
        ("-----BEGIN EC PRIVATE KEY-----\n" + base64.encodebytes(EC).decode() + "-----END EC PRIVATE KEY-----", "ec_key"),
    ],
)
def test_structures_are_confirmed(text, kind):
    spans = secrets.find_spans(f"é {text} tail")
    assert (kind, 2, 2 + len(text)) in spans


def test_keys_of_random_bytes_in_both_alphabets():
    rng, mixed = random.Random(14), 0
    for _ in range(300):
        ec = tlv(48, tlv(2, b"\1") + tlv(4, rng.randbytes(32)))
        rsa = tlv(48, b"".join(tlv(2, x) for x in (b"\0", b"\1" + rng.randbytes(64), b"\3", *[b"\5" + rng.randbytes(31) for _ in range(6)])))
        pkcs8 = tlv(48, tlv(2, b"\0") + tlv(48, tlv(6, b"\x2a\x86\x48\xce\x3d\x02\x01") + tlv(5, b"")) + tlv(4, ec))
        ssh = b"openssh-key-v1\0" + field(b"none") + field(b"none") + field(b"") + (1).to_bytes(4, "big") + field(rng.randbytes(51)) + field(rng.randbytes(144))
        for data, kind in ((ec, "ec_key"), (rsa, "rsa_key"), (pkcs8, "pkcs8_key"), (ssh, "openssh_key")):
            safe, plain = base64.urlsafe_b64encode(data).decode(), base64.b64encode(data).decode()
            mixed += "-" not in safe[:40] and "_" not in safe[:40] and safe.rstrip("=") != plain.rstrip("=")
            for text in (safe, safe.rstrip("="), plain, plain.rstrip("=")):
                assert (kind, 2, 2 + len(text)) in secrets.find_spans(f"é {text} tail")
            assert (kind, 5, 5 + len(plain)) in secrets.find_spans(f"key_-{plain}") and (kind, 4, 4 + len(safe)) in secrets.find_spans(f"key/{safe}")
    assert mixed > 100


def test_structures_that_do_not_parse_are_not_reported():
    cut = base64.b64encode(RSA[:-3]).decode()
    long = base64.b64encode(RSA + b"\0\0\0").decode()
    wrong = ".".join([part(b'{"alg":"HS256"}'), part(b"{}"), part(b"m" * 31)])
    for text in (cut, long, wrong, base64.b64encode(bytes(range(90))).decode(), base64.b64encode(OPENSSH + b"x").decode()):
        assert not [s for s in secrets.find_spans(text) if s[0] not in secrets.BASE_KINDS]


def armoured(data, kind, end="\n", headers=""):
    return f"-----BEGIN {kind}-----{end}{headers}" + base64.encodebytes(data).decode().replace("\n", end) + f"-----END {kind}-----"


@pytest.mark.parametrize(
    ("text", "kind"),
    [
        (armoured(PKCS8, "PRIVATE KEY", "\\n"), "pkcs8_key"),
        (armoured(RSA, "RSA PRIVATE KEY", "\\r\\n"), "rsa_key"),
        (armoured(RSA, "RSA PRIVATE KEY", headers="Comment: mine\n\n"), "rsa_key"),
        (armoured(b"\x77" * 96, "RSA PRIVATE KEY", headers="Proc-Type: 4,ENCRYPTED\nDEK-Info: AES-128-CBC," + "0A" * 16 + "\n\n"), "encrypted_key"),
        *((wrap(base64.b64encode(data).decode()), kind) for data, kind in ((RSA, "rsa_key"), (PKCS8, "pkcs8_key"), (OPENSSH, "openssh_key")) for wrap in (lambda x: "\n".join(x[i : i + 64] for i in range(0, len(x), 64)), lambda x: "\r\n  ".join(x[i : i + 76] for i in range(0, len(x), 76)), lambda x: "\\n".join(x[i : i + 40] for i in range(0, len(x), 40))) if len(wrap(base64.b64encode(data).decode())) > len(base64.b64encode(data))),
    ],
)
def test_keys_over_several_lines(text, kind):
    for before in ("é ", "é\n" + "A" * 64 + "\n"):
        spans = [s for s in secrets.find_spans(f"{before}{text}\ntail of the text") if s[0] not in secrets.BASE_KINDS]
        assert spans == [(kind, len(before), len(before) + len(text))]
    assert not [s for s in secrets.find_spans(text[:60] + text[64:]) if s[0] == kind]


@pytest.mark.parametrize("alg", [["HS256"], {"a": 1}, None, 1])
def test_a_token_whose_algorithm_is_no_text_is_none(alg):
    text = ".".join([part(json.dumps({"alg": alg, "typ": "JWT"}).encode()), part(b'{"sub":"1"}'), part(b"m" * 32)])
    assert not secrets.find_spans(text) and ("jwt", len(text) + 1, len(text) + 1 + len(JWT)) in secrets.find_spans(f"{text} {JWT}")


def plain_spans(text):
    """The base patterns, straight from their definition."""
    assign = r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
    found = [("assign", m.start(), m.end()) for m in re.finditer(assign, text) if len(m[2]) >= 6]
    found += [("access", m.start(), m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    return found + [("hex", m.start(), m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]


def test_base_spans_against_plain_patterns():
    rng = random.Random(3)
    bits = ["token", "Password", "api_key", "apikey", "ſecret", "=", ": ", '"', "AKIA", "ABCDEFGH12345678", "deadbeef" * 3, "abc", "é", " ", "\n", "x1.y_", "token=token:abcdef"]
    for _ in range(4000):
        text = "".join(rng.choice(bits) for _ in range(rng.randint(0, 12)))
        got = [s for s in secrets.find_spans(text) if s[0] in secrets.BASE_KINDS]
        assert sorted(got) == sorted(plain_spans(text)), text


def test_op1_digest(spark, sf, edges, empty):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    order = {k: i for i, k in enumerate(secrets.BASE_KINDS)}
    for r in queries.op1_secret_scan(spark, sf).collect():
        want = sorted(plain_spans(docs[r["doc_id"]] or ""), key=lambda s: (s[1], order[s[0]]))
        joined = ",".join(f"{k}:{a}:{b}" for k, a, b in want)
        assert r["base_sha256"] == hashlib.sha256(joined.encode()).hexdigest()
        assert [r["n_assign"], r["n_access"], r["n_hex"]] == [sum(k == x for k, _, _ in want) for x in secrets.BASE_KINDS]
    got = secrets.digest(secrets.scan_secrets(edges)).collect()
    assert len(got) == len(EDGES) and all(r["spans"] == "" for r in got)
    assert secrets.digest(secrets.scan_secrets(empty)).count() == 0


@pytest.mark.parametrize("n", [1, 2, 127, 129, 5000])
def test_huffman_round_trip(n):
    ids = np.minimum(np.random.default_rng(n).zipf(1.3, n), 40_000).astype("<u2")
    lengths = tokenfile.code_lengths(np.bincount(ids), 16)
    assert sum(2.0**-x for x in lengths[lengths > 0]) <= 1 and lengths.max() <= 16
    stream, offsets = tokenfile.pack(ids, lengths, tokenfile.canonical(lengths))
    assert (tokenfile.unpack(stream, offsets, n, tokenfile.lookup(lengths)) == ids).all()


def test_package_merge_is_optimal_where_the_limit_does_not_bind():
    import heapq

    counts = np.array([1, 1, 2, 3, 5, 8, 13, 0, 21])
    heap, total = [int(c) for c in counts if c], 0
    heapq.heapify(heap)
    while len(heap) > 1:
        x = heapq.heappop(heap) + heapq.heappop(heap)
        total += x
        heapq.heappush(heap, x)
    assert int((tokenfile.code_lengths(counts, 16) * counts).sum()) == total
    tight = tokenfile.code_lengths(counts, 3)
    assert tight.max() == 3 and sum(2.0**-x for x in tight[tight > 0]) == 1 and tight[7] == 0


WORD_FILE = public_tokenizers.path("word_bpe_49k.json")
PIECES = [" ", " ", "\n", "a", "'s", "'", "The", "1", "²", "é", "!", "\t", "\xa0", " ", "\x1c", "\0", "中", "😀", "é", "Σ", "İ", "<|endoftext|>", "A", "_", "\u0085", "ﬁ", "Ⅷ", "ẞ", "  "]


def noise(seed, n):
    rng = random.Random(seed)
    return ["".join(rng.choice(PIECES) for _ in range(rng.randint(0, 14))) for _ in range(n)]


def test_words_have_the_ids_of_the_whole_text():
    words = tokenfile.WordIds(WORD_FILE, "<u2")
    for text in noise(5, 5000):
        got = np.frombuffer(b"".join(map(words.__getitem__, text.encode().split())), "<u2").tolist()
        assert got == words.all.encode(text, add_special_tokens=False).ids, text


def test_letters_whose_lower_case_lies_beyond_the_fast_path():
    words = tokenfile.WordIds(WORD_FILE, "<u2")
    far = [c for c in map(chr, range(0x250)) if max(c.lower()) >= "ɐ"]
    assert len(far) == 24 and "Ə" in far  # the capitals of the finding, and U+0130
    rng = random.Random(12)
    for text in [x for c in map(chr, range(0x21, 0x250)) for x in (c, c + "li", "a" + c + "1", "É" + c + "'s")] + ["".join(rng.choice(far + PIECES) for _ in range(rng.randint(1, 9))) for _ in range(3000)]:
        got = np.frombuffer(b"".join(map(words.__getitem__, text.encode().split())), "<u2").tolist()
        assert got == words.all.encode(text, add_special_tokens=False).ids, text


def whole(words, texts):
    return [np.array(words.all.encode(t, add_special_tokens=False).ids, "<u2").tobytes() for t in texts]


@pytest.mark.parametrize("kept", [0, 3, 1 << 19])
def test_texts_encoded_together_have_their_own_ids(monkeypatch, kept):
    monkeypatch.setattr(tokenfile, "KNOWN", kept)
    words = tokenfile.WordIds(WORD_FILE, "<u2")
    far = [c for c in map(chr, range(0x250)) if max(c.lower()) >= "ɐ"]
    rng = random.Random(21)
    letters = [x for c in map(chr, range(0x250)) for x in (c, f" {c}li ", f"a{c}1", f"É{c}'s")]
    mixed = ["".join(rng.choice(far + PIECES) for _ in range(rng.randint(0, 14))) for _ in range(2000)]
    for texts in (["", " \n", ""], [], letters, mixed, letters[::-1], ["\xa0", "\x85 \xa0"], ["W\u030a A\u0301 I\u0307 İ ſ K"]):
        assert words.encode(pa.array(texts, pa.string())) == whole(words, texts)
    assert len(words.known) == len(words.ids) <= kept


def test_a_slice_of_texts_is_encoded_by_its_own_rows():
    words, texts = tokenfile.WordIds(WORD_FILE, "<u2"), pa.array(["one two", "Three", "", "four's 5"])
    assert words.encode(texts[1:3]) == whole(words, ["Three", ""]) and words.encode(texts[3:]) == whole(words, ["four's 5"])


def test_a_piece_of_many_words_takes_the_model_once(monkeypatch):
    words, made = tokenfile.WordIds(WORD_FILE, "<u2"), []
    own = words._modelled
    monkeypatch.setattr(words, "_modelled", lambda pieces: made.extend(pieces) or own(pieces))
    for text in ("Word word. WORD, (word) Été", "word! été, other"):
        assert words.encode(pa.array([text])) == whole(words, [text])
    assert sorted(made) == sorted({"word", ".", ",", "(", ")", "été", "!", "other"})


def test_long_words_are_not_kept():
    words, texts = tokenfile.WordIds(WORD_FILE, "<u2"), ["ab " + "x" * 70 + " 中 " + "中" * 30, "é" * 33]
    for _ in range(2):
        assert words.encode(pa.array(texts)) == whole(words, texts)
    assert words.known.to_pylist() == ["ab"] and list(words) == ["中".encode()]


def test_batches_of_a_size():
    rows = pa.record_batch({"text": ["x" * n for n in (5, 1, 90, 4, 0, 300, 2)]})
    for step in (1, 3, 7):
        for most in (1, 60, 10_000):
            got = list(common.sized(iter([rows[i : i + step] for i in range(0, 7, step)]), most))
            assert pa.Table.from_batches(got).equals(pa.Table.from_batches([rows]).combine_chunks()) and (most > 1 or len(got) == 7)
    assert len(got) == 1 and list(common.sized(iter([]), 5)) == list(common.sized(iter([rows[:0]]), 5)) == []


def test_token_file(spark, sf, edges, empty):
    tok = Tokenizer.from_file(WORD_FILE)
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for frame, got in ((docs, queries.op2_token_file(spark, sf)), (edges, tokenfile.round_trip(edges, WORD_FILE, 49_408))):
        want, start = [], 0
        texts = [(r["doc_id"], r["text"] or "") for r in frame.collect()]
        for doc, text in sorted(texts, key=lambda x: (x[0] is not None, x[0] or 0)):
            ids = [*tok.encode(text, add_special_tokens=False).ids, 1]
            want.append((doc, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
            start += len(ids)
        rows = [(r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) for r in got.select("doc_id", "start", "n_tokens", "ids_crc32").collect()]
        assert sorted(rows, key=str) == sorted(want, key=str)
    assert tokenfile.round_trip(empty, WORD_FILE, 49_408).count() == 0


BYTE_FILE = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def library():
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.load_ranks(BYTE_FILE), special_tokens={})


def test_cuts_never_change_the_ids():
    encode = library().encode_ordinary
    for text in noise(7, 8000):
        words = bpe.split_words(text)
        assert "".join(words) == text and [i for w in words for i in encode(w)] == encode(text), text


def test_byte_bpe(spark, sf, edges, empty, monkeypatch):
    encode = library().encode_ordinary
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    for r in queries.op7_byte_bpe(spark, sf).collect():
        ids = encode(docs[r["doc_id"]] or "")
        assert r["n_tokens"] == len(ids) and r["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256((docs[r["doc_id"]] or "").encode()).hexdigest()
    monkeypatch.setattr(bpe, "CHUNK_DOCS", 2)  # several chunks
    got = bpe.decode(bpe.encode(edges, BYTE_FILE, public_tokenizers.PATTERN), BYTE_FILE).collect()
    assert sorted((str(r["doc_id"]), bytes(r["decoded"]).decode(), list(r["ids"])) for r in got) == sorted((str(i), t or "", encode(t or "")) for i, t, _ in EDGES)
    assert bpe.encode(empty, BYTE_FILE, public_tokenizers.PATTERN).count() == 0


def test_chunks_of_repeated_ids_and_long_texts_are_bounded(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(bpe, "CHUNK_DOCS", 50)
    monkeypatch.setattr(bpe, "CHUNK_BYTES", 4000)
    rows = [(None, f"no id {k}", "") for k in range(300)] + [(7, f"one id {k}", "") for k in range(300)] + [(k, f"text {k}", "") for k in range(100, 400)]
    rows += [(k, f"long {k} " * 100, "") for k in range(400, 440)]
    df = spark.createDataFrame(rows, SCHEMA)
    dealt, chunks = bpe.with_chunks(df)
    sizes = [r["count"] for r in dealt.groupBy("chunk").count().collect()]
    assert len(sizes) <= 3 * chunks and max(sizes) <= 110
    assert max(r["b"] for r in dealt.selectExpr("chunk", "octet_length(text) b").groupBy("chunk").agg({"b": "sum"}).toDF("chunk", "b").collect()) <= 12_000
    encode = library().encode_ordinary
    got = bpe.encode(df, BYTE_FILE, public_tokenizers.PATTERN).collect()
    want = sorted((str(i), encode(t)) for i, t, _ in rows)
    path = str(tmp_path / "shuffled")
    df.repartition(3, F.xxhash64("text")).write.parquet(path)
    stored = spark.read.parquet(path)  # chunks are runs of its files, in whatever order the ids lie
    file, met = {r["text"]: r["file"] for r in stored.select("text", F.input_file_name().alias("file")).collect()}, {}
    for r in bpe.with_chunks(stored)[0].collect():
        met.setdefault(r["chunk"], set()).add(file[r["text"]])
    assert max(map(len, met.values())) == 1 < len(met) and sorted((str(r["doc_id"]), list(r["ids"])) for r in bpe.encode(stored, BYTE_FILE, public_tokenizers.PATTERN).collect()) == want
    assert sorted((str(r["doc_id"]), list(r["ids"])) for r in got) == sorted((str(i), encode(t)) for i, t, _ in rows)


def plain_lines(rows):
    """Line dedup by its definition; rows without an id keep all."""
    strip = " \t\n\x0b\x0c\r"
    key = lambda x: x.strip(strip).translate({c: c + 32 for c in range(65, 91)})
    first = {}
    for doc, text, _ in rows:
        for line in (text or "").split("\n"):
            if doc is not None and len(key(line)) >= 10:
                first[key(line)] = min(first.get(key(line), doc), doc)
    out = []
    for doc, text, _ in rows:
        all_ = (text or "").split("\n")
        kept = [x for x in all_ if doc is None or len(key(x)) < 10 or first[key(x)] == doc]
        out.append((str(doc), "\n".join(kept), len(all_), len(all_) - len(kept)))
    return sorted(out)


def test_line_dedup(spark, sf, edges, empty):
    good, text = compare(queries.op9_line_dedup(spark, sf), queries.ORACLES["op9_line_dedup"], duck_tables(sf))
    assert good, text
    for n_batches, fanout in ((1, 2), (4, 2), (5, 3)):
        got = lines.dedup_lines(edges, n_batches=n_batches, fanout=fanout).collect()
        assert sorted((str(r["doc_id"]), r["text"], r["n_lines"], r["n_dropped"]) for r in got) == plain_lines(EDGES)
    assert lines.dedup_lines(empty).count() == 0
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("line_run")]


def test_runs_are_compacted_and_stay_disjoint(spark):
    runs = lines.LineRuns(spark, buckets=2, fanout=2)
    for k in range(5):
        keys = spark.createDataFrame([(10 * k + i, h, h) for i in range(3) for h in (i, 100 + k)], "id long, h1 long, h2 long")
        drops = {(r["id"], r["h1"]) for r in runs.add(keys).collect()}
        want = {(10 * k + i, 100 + k) for i in (1, 2)} | ({(10 * k + i, i) for i in range(3)} if k else set())
        assert drops == want
    assert [level for level, _ in runs.runs] == [2, 0]
    held = [r["h1"] for _, name in runs.runs for r in spark.table(name).collect()]
    assert sorted(held) == [0, 1, 2, 100, 101, 102, 103, 104]
    runs.close()
