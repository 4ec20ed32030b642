"""Token alignment, embedding near-duplicates and conversation repair."""

import hashlib
import itertools
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest

from rowtrail.llm import alignment, conversations, neighbours, queries

# --- token alignment ------------------------------------------------------------------------------

FILES = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def vocabularies():
    return alignment.Vocabularies(*FILES)


def plain_alignment(v, text):
    """Tokens of the whole text by both libraries, groups and links by two loops; None without tokens."""
    raw = (" " + (text or "")).encode()
    ids = v.a.encode(" " + (text or ""), add_special_tokens=False).ids, v.b.encode(text or "")
    spelled = [v.bytes_a[i] for i in ids[0]], [v.bytes_b[i] for i in ids[1]]
    if not text or b"".join(spelled[0]) != raw or b"".join(spelled[1]) != raw:
        return None
    spans = []
    for own in spelled:
        at, out = 0, []
        for x in own:
            out.append((at, at + len(x)))
            at += len(x)
        spans.append(out)
    links, j = [], 0
    for i, (lo, hi) in enumerate(spans[0]):
        while spans[1][j][1] <= lo:
            j += 1
        k = j
        while k < len(spans[1]) and spans[1][k][0] < hi:
            links.append((ids[0][i], ids[1][k]))
            k += 1
    groups, at = [], [0, 0]
    for cut in sorted({e for _, e in spans[0]} & {e for _, e in spans[1]}):
        own = []
        for side in (0, 1):
            lo = at[side]
            while at[side] < len(ids[side]) and spans[side][at[side]][1] <= cut:
                at[side] += 1
            own.append(",".join(map(str, ids[side][lo : at[side]])))
        groups.append("|".join(own))
    return len(ids[0]), len(ids[1]), len(groups), links, hashlib.sha256(";".join(groups).encode()).hexdigest()


def plain_table(v, rows):
    found = [(i, plain_alignment(v, t)) for i, t in rows]
    count = Counter(pair for _, f in found if f for pair in set(f[3]))
    top = defaultdict(int)
    for (a, _), n in count.items():
        top[a] = max(top[a], n)
    out = []
    for i, f in found:
        if f is None:
            out.append((str(i), 0, 0, 0, 0, 0, 0, ""))
        else:
            out.append((str(i), *f[:3], len(f[3]), sum(count[x] == top[x[0]] for x in f[3]), sum(count[x] for x in f[3]), f[4]))
    return sorted(out)


def alignment_rows(df):
    names = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
    return sorted((str(r["doc_id"]), *(r[c] for c in names)) for r in df.collect())


def test_op13(spark, sf, vocabularies):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    assert alignment_rows(queries.op13_token_alignment(spark, sf)) == plain_table(vocabularies, rows)


def test_alignment_of_odd_texts(spark, vocabularies, monkeypatch):
    monkeypatch.setattr(alignment, "SLICE_BYTES", 300)  # tasks get it with the function's module
    texts = [
        None, "", " ", "  ", "\n", "a  b", "x \n\n y \n", "a\r\nb;\r\n c", "▁x ok", "<|endoftext|> <s>", "a\tb \t c　d", "é" * 9,
        "\x00 \x1c\n z", "foo ​ bar baz   q", " \r x", "a \r\n\r\n b", "it's we'll 'S", "aaaa" * 50, "\U0001f600 你好 " * 5,
        "the cat sat on the mat\n" * 40, "same text", "same text",
    ]
    rows = [(k if k % 7 else None, t) for k, t in enumerate(texts)]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, chunk int, code string")
    assert alignment_rows(alignment.align(df, *FILES)) == plain_table(vocabularies, rows)
    empty = alignment.align(df.filter("false"), *FILES)
    assert empty.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"] and empty.count() == 0


def test_long_texts_are_aligned_in_slices(vocabularies, monkeypatch):
    text = "some words, and\nlines of them " * 4000 + "x" * 5000
    whole = plain_alignment(vocabularies, text)
    monkeypatch.setattr(alignment, "SLICE_BYTES", 1000)
    parts = list(alignment.sections(text))
    assert len(parts) > 50 and "".join(parts) == " " + text
    aligner, chunk = alignment.Aligner(vocabularies), alignment.Chunk()
    chunk.open(1)
    for part in parts:
        chunk.add([0], aligner.slice([part]))
    assert tuple(chunk.rows[0]) == (*whole[:3], len(whole[3])) and chunk.hashes[0].hexdigest() == whole[4]


def test_frequent_units_are_kept():
    from rowtrail.llm.common import Recent

    made = Counter()

    def make(keys):
        made.update(keys)
        return [k.upper() for k in keys]

    known = Recent(make, limit=10)
    for k in range(100):
        assert known.fetch(["hot", f"cold{k}", "hot"]) == ["HOT", f"COLD{k}", "HOT"]
    assert made["hot"] == 1 and len(known.young) + len(known.old) <= 22


# --- conversation repair --------------------------------------------------------------------------

WHITE = " \t\n\x0b\x0c\r"


def plain_damage(rows):
    """(conv, turn, role, text) after damage, by conversation, in order."""
    out = defaultdict(list)
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        own = out[conv]
        if kind:
            text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
            own += [(turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    for own in out.values():
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
    return out


def plain_faults(rows):
    found, seen = [], set()
    for _, role, text in rows:
        body = text.strip(WHITE)
        found.append("blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else "")
        seen.add((role, text))
    return found


def plain_repair(rows):
    """Forwards over rows and states: the least (cost, letters) that leaves each role string's state."""
    faults = plain_faults(rows)
    step = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}
    states = ["", "s", "u", "a"]
    lacks = {"": "u", "s": "u", "u": "a", "a": "u"}
    full = {"u": "user", "a": "assistant"}

    def inserted(now):
        for _ in range(4):
            for q in list(now):
                cost, letters, kept = now[q]
                to = lacks[q]
                new = (cost + 5, letters + "I", kept + [full[to] + ":"])
                if to not in now or new < now[to]:
                    now[to] = new
        return now

    now = inserted({"": (0, "", [])})
    for (_, role, text), fault in zip(rows, faults, strict=True):
        after = {}
        for q in states:
            if q not in now:
                continue
            cost, letters, kept = now[q]
            moves = [(q, cost + 2, "D", [])]
            if fault not in ("blank", "duplicate"):
                cut = 5 * (fault == "truncated")
                if (q, role[:1]) in step:
                    moves.append((step[q, role[:1]], cost + cut, "K", [f"{role}:{text}"]))
                moves.append((lacks[q], cost + cut + 1, "R", [f"{full[lacks[q]]}:{text}"]))
            for to, c, letter, line in moves:
                new = (c, letters + letter, kept + line)
                if to not in after or new[:2] < after[to][:2]:
                    after[to] = new
        now = inserted(after)
    return min((now[q] for q in ("", "a") if q in now), key=lambda x: x[:2])


def plain_conversations(rows):
    out = []
    for conv, own in plain_damage(rows).items():
        faults, turns = plain_faults(own), [t for t, _, _ in own if t is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        initials = [r[:1] for _, r, _ in own]
        illegal = sum(x + y not in ("su", "ua", "au") for x, y in itertools.pairwise(initials))
        cost, audit, kept = plain_repair(own)
        digest = hashlib.sha256("\n".join(kept).encode()).hexdigest()
        out.append((str(conv), gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit, digest))
    return sorted(out)


def conversation_rows(df):
    names = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")
    return sorted((str(r["conv_id"]), *(r[c] for c in names)) for r in df.collect())


def random_conversations(seed, conversations_, longest):
    rng, rows = random.Random(seed), []
    texts = ["Yes.", "no", "", " \t", "Well!", "Hm?", "a.b", "x " * 30 + ".", None, "Yes.\n", "é…", "So."]
    for conv in [None, *range(conversations_)]:
        role = 0
        for turn in range(rng.randint(1, longest)):
            role = rng.choice([role ^ 1, role ^ 1, role ^ 1, 0, 1])
            name = rng.choice([("user", "assistant")[role]] * 8 + ["system", "tool", "", None, "umpire"])
            rows.append((conv, turn + rng.choice([0, 0, 0, 3]) if rng.random() < 0.97 else None, name, rng.choice([f"Turn {turn}.", rng.choice(texts)])))
    return rows + rows[:5]


CONVERSATION = "conv_id long, turn long, role string, text string"


def test_op12(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert conversation_rows(queries.op12_conversation_repair(spark, sf)) == plain_conversations(rows)


def test_repair_of_odd_conversations(spark):
    rows = random_conversations(5, 150, 12)
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], CONVERSATION + ", part int, codes string")
    assert conversation_rows(conversations.repair(conversations.damage(df))) == plain_conversations(rows)
    assert conversations.repair(conversations.damage(df.filter("false"))).count() == 0


@pytest.mark.parametrize("passes", [0, 1, 4])
def test_long_conversations_converge_or_take_matrices(spark, monkeypatch, passes):
    rng = random.Random(9)
    rows = [r for r in random_conversations(6, 6, 300) if r[0] is not None]
    # One without any two states of one rank (all but its ends are repeats), one of a single row many times.
    rows += [(100, t, "user", "Same.") for t in range(200)] + [(100, 200, "assistant", "End.")]
    rows += [(101, 1, "assistant", "Again.")] * 60 + [(102, t, ("user", "assistant")[t % 2], f"Fine {t}.") for t in range(400)]
    rows += [(103, t, "assistant", rng.choice(["cut", "Cut."]) + " " * (t % 7)) for t in range(90)]
    blocks = conversations.blocks_of
    monkeypatch.setattr(conversations, "blocks_of", lambda rows: cut_blocks(spark, blocks(rows), 7))
    monkeypatch.setattr(conversations, "joints", lambda b, own=conversations.joints: own(b, passes))
    df = spark.createDataFrame(rows, CONVERSATION)
    assert conversation_rows(conversations.repair(conversations.damage(df))) == plain_conversations(rows)
    kept = conversations.repaired_rows(conversations.damage(df)).orderBy("conv_id", "part", "no", "place").collect()
    own = [f"{r['role']}:{r['text']}" for r in kept if r["conv_id"] == 102]
    assert own == plain_repair(plain_damage(rows)[102])[2]


def cut_blocks(spark, blocks, size):
    """Blocks of at most ``size`` rows."""
    out = []
    for r in blocks.collect():
        whole = r.asDict()
        n = len(whole["copies"])
        if n <= size:
            out.append(whole | {"no": whole["no"] * 1000})
            continue
        seen = list(zip(whole["roles"], whole["texts"], whole["copies"], list(whole["codes"]), strict=True))
        for lo in range(0, n, size):
            b = conversations.Block(whole["conv_id"])
            for role, text, copies, code in seen[lo : lo + size]:
                body = text.strip(WHITE)
                b.add(None, role, text, copies, bool(body) and code == conversations.GONE)
            row = b.row(whole["part"], whole["no"] * 1000 + lo)
            # The turns are those of the whole block, told once.
            row |= {"low": whole["low"], "high": whole["low"], "turns": min(1, whole["turns"])}
            if lo + size >= n:
                row |= {"high": whole["high"], "turns": whole["turns"]}
            out.append(row)
    return spark.createDataFrame(out, blocks.schema)


def test_least_letters_against_all_letters():
    """Every string of edits of short conversations, tried one by one."""
    rng = random.Random(12)
    good = re.compile("(s?(ua)+)?")
    for _ in range(60):
        rows = [(t, rng.choice(["user", "assistant", "system", "tool"]), rng.choice([f"T {t}.", "cut", " ", "So."])) for t in range(rng.randint(0, 4))]
        faults, best = plain_faults(rows), None
        for n_inserts in range(3):
            for places in itertools.combinations_with_replacement(range(len(rows) + 1), n_inserts):
                for letters in itertools.product("DKR", repeat=len(rows)):
                    for new in itertools.product("ua", repeat=n_inserts + letters.count("R")):
                        left, out, audit, cost = iter(new), "", "", 5 * n_inserts
                        for at in range(len(rows) + 1):
                            for _ in range(places.count(at)):
                                out, audit = out + next(left), audit + "I"
                            if at == len(rows):
                                break
                            letter, fault = letters[at], faults[at]
                            if letter != "D" and fault in ("blank", "duplicate"):
                                cost += 1000
                            out += "" if letter == "D" else rows[at][1][0] if letter == "K" else next(left)
                            cost += {"D": 2, "K": 0, "R": 1}[letter] + 5 * (letter != "D" and fault == "truncated")
                            audit += letter
                        if good.fullmatch(out):
                            best = min(best or (cost, audit), (cost, audit))
        block = conversations.Block(1)
        for (t, role, text), fault in zip(rows, faults, strict=True):
            block.add(t, role, text, 1, fault == "duplicate")
        letters, cost, _ = conversations.trace(block.codes, block.copies, conversations.END, 0, True)
        assert (cost, "".join(letters)) == best == plain_repair(rows)[:2]


# --- vector near-duplicates -----------------------------------------------------------------------


def plain_vectors(rows, threshold=0.9):
    """(id, n_links, component, kept) by comparing all pairs of rows."""
    good = [k for k, (i, v) in enumerate(rows) if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    links, up = defaultdict(set), {}

    def root(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for dim in {len(rows[k][1]) for k in good}:
        own = [k for k in good if len(rows[k][1]) == dim]
        x = np.array([rows[k][1] for k in own], float)
        x /= np.abs(x).max(1, keepdims=True)
        x /= np.sqrt((x * x).sum(1, keepdims=True))
        for a, b in zip(*np.nonzero(np.triu(x @ x.T >= threshold, 1)), strict=True):
            links[own[a]].add(own[b])
            links[own[b]].add(own[a])
            p, q = sorted((root(own[a]), root(own[b])), key=lambda k: rows[k][0])
            up[q] = p
    return sorted((str(i), len(links[k]), str(i if i is None else rows[root(k)][0]), i is None or rows[root(k)][0] == i) for k, (i, _) in enumerate(rows))


def vector_rows(df):
    return sorted((str(r["vec_id"]), r["n_links"], str(r["component_id"]), r["kept"]) for r in df.collect())


def test_op11(spark, sf):
    rows = [(r["vec_id"], list(r["embedding"])) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    assert vector_rows(queries.op11_vector_near_dups(spark, sf)) == plain_vectors(rows)


def test_cliques_chains_and_odd_vectors(spark):
    rng = np.random.default_rng(5)
    near = lambda v, cosine: cosine * v + np.sqrt(1 - cosine**2) * unit(rng.standard_normal(len(v)))
    unit = lambda v: v / np.sqrt((v * v).sum())
    rows, i = [], itertools.count(10)
    rows += [(next(i), rng.standard_normal(24).tolist()) for _ in range(300)]
    middle = unit(rng.standard_normal(24))
    rows += [(next(i), near(middle, 0.985).tolist()) for _ in range(130)]  # links enough to saturate the longest lists
    other = near(middle, 0.93)
    rows += [(next(i), near(other, 0.985).tolist()) for _ in range(70)]  # a second group, some of whose links lead to the first
    for _ in range(25):
        v = rng.standard_normal(24)
        rows += [(next(i), v.tolist()), (next(i), near(unit(v), rng.uniform(0.85, 0.99)).tolist())]
    step = unit(rng.standard_normal(24))
    for _ in range(20):  # a chain: neighbours are linked, ends are not
        rows.append((next(i), (3 * step).tolist()))
        step = unit(near(step, 0.95))
    same = rng.standard_normal(24).tolist()
    rows += [(next(i), same) for _ in range(60)] + [(5, same), (5, same), (7, [2 * x for x in same])]
    nan, inf = float("nan"), float("inf")
    rows += [(1, None), (2, []), (3, [0.0] * 24), (4, [nan] * 24), (6, [inf] + [1.0] * 23), (8, [None] + [1.0] * 23), (None, same), (9, [1.0, 2.0]), (900, [1.0, 2.0]), (901, [1e300, 2e300]), (902, [1e-300, 2e-300])]
    df = spark.createDataFrame([(k, v, "x", 1) for k, v in rows], "vec_id long, embedding array<double>, vec string, node int")
    assert vector_rows(neighbours.near_vectors(df)) == plain_vectors(rows)
    assert neighbours.near_vectors(df.filter("false")).count() == 0
    bad = neighbours.near_vectors(df.filter("vec_id IN (1, 2, 3, 4)"))
    assert vector_rows(bad) == [(str(k), 0, str(k), True) for k in (1, 2, 3, 4)]


def test_audit_sees_what_is_missing(spark):
    rng = np.random.default_rng(2)
    v = rng.standard_normal((50, 8))
    rows = [(k, k, 1, 8, bytearray(np.append(v, v[:25] * 1.001, 0)[k].astype("<f8").tobytes())) for k in range(75)]
    nodes = spark.createDataFrame(rows, "node long, lead long, copies long, dim int, vec binary")
    half = spark.createDataFrame([(k, 1) for k in range(13)] + [(50 + k, 1) for k in range(12)], "node long, n long")
    assert neighbours.audit(nodes, half, "<f8", 0.999, 100) == pytest.approx(0.5)
    assert neighbours.audit(nodes.limit(0), half, "<f8", 0.999) == 1.0
