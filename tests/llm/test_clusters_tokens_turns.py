"""Operators 11 to 13 against brute force, the tokenizer's own library and odd inputs."""

import hashlib
import itertools
import math
import random
import re
import zlib

import duckdb
import numpy as np
import public_tokenizers as P
import pytest
import tiktoken

from stintmill.llm import bpe, centroids, conversations
from stintmill.llm.registry import oracle_sql


# --- 11: clusters

def plain_clusters(vectors, k, rounds, seed=2, width=64, scale=256):
    """(ids, clusters, distances, centroids) by distances of Python integers."""
    kept = [(i, [math.floor(scale * float(x)) for x in v]) for i, v in vectors if v is not None and len(v) == width and all(x is not None and math.isfinite(x) for x in v)]
    order = sorted((hashlib.sha256(f"{seed}:{i}".encode()).hexdigest(), v) for i, v in kept if i is not None)
    cents = [v for _, v in order[:k]]

    def assign():
        return [min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), n) for n, c in enumerate(cents)) for _, v in kept]

    for _ in range(rounds):
        near = assign()
        for c in range(len(cents)):
            own = [v for (_, v), (_, n) in zip(kept, near, strict=True) if n == c]
            if own:
                cents[c] = [sum(col) // len(own) for col in zip(*own, strict=True)]
    near = assign()
    return sorted(((i is None, i or 0), n, d) for (i, _), (d, n) in zip(kept, near, strict=True)), cents


def clustered(spark, rows, kind="array<double>", **options):
    df = spark.createDataFrame(rows, f"vec_id long, embedding {kind}")
    got, cents = centroids.cluster(df, **options)
    return sorted(((r.vec_id is None, r.vec_id or 0), r.cluster, r.distance) for r in got.collect()), cents


@pytest.mark.parametrize("size", [1.0, 3e4, 3e8])  # doubles, 64-bit integers, Python's integers
def test_clusters_equal_plain_distances(spark, size):
    rng = np.random.default_rng(5)
    rows = [(i, (rng.normal(size=8) * size).tolist()) for i in range(300)]
    rows += [(1000 + i, rows[7][1]) for i in range(40)]  # copies, ties
    got, cents = clustered(spark, rows, k=12, rounds=3, width=8)
    want, want_cents = plain_clusters(rows, 12, 3, width=8)
    assert cents == want_cents
    assert got == [(i, n, d if d < 1 << 63 else None) for i, n, d in want]


def test_zero_favours_the_smaller_number():
    planes = centroids.Bisectors([[2, 0], [-2, 0], [0, 2], [2, 0]])
    won, far = planes.assign(np.array([[0.0, 0.0], [0.0, 5.0], [3.0, 0.0], [-1.0, -1.0]]))
    assert won.tolist() == [0, 2, 0, 1] and far.tolist() == [4, 9, 1, 2]


def test_floor_of_negative_means_and_large_components():
    assert centroids.grid(np.array([[-0.001, 0.001, -1.0]]), 256).tolist() == [[-1, 0, -256]]
    assert centroids.grid(np.array([[1e30]]), 256).tolist() == [[int(1e30) * 256]]


def test_clusters_of_odd_rows(spark):
    ok = [float(i) for i in range(4)]
    rows = [(1, ok), (2, None), (3, []), (4, [*ok, 1.0]), (5, [None, 1.0, 2.0, 3.0]), (6, [float("nan"), *ok[1:]]), (7, [float("inf"), *ok[1:]]), (None, [9.0] * 4), (1, ok), (8, [0.0] * 4)]
    got, cents = clustered(spark, rows, k=40, rounds=2, width=4)
    want, want_cents = plain_clusters(rows, 40, 2, width=4)
    assert got == want and cents == want_cents and len(got) == 4
    assert clustered(spark, [], width=4) == ([], [])
    wide = spark.createDataFrame([(1, ok, 3, "x")], "vec_id long, embedding array<float>, cluster int, distance string")
    assert [tuple(r) for r in centroids.cluster(wide, width=4)[0].collect()] == [(1, 0, 0)]


def test_clusters_equal_sql(spark):
    from stintmill.llm.centroids import op11_centroids

    got = sorted(map(tuple, op11_centroids(spark, "/root/testdata/sf0.001").collect()))
    con = duckdb.connect()
    con.sql("create view embeddings as select * from '/root/testdata/sf0.001/embeddings.parquet'")
    assert got == sorted(con.sql(oracle_sql()["op11_centroids"]).fetchall())


# --- 12: tokens

RANKS = bpe.read_ranks(P.path("byte_bpe_50k.tiktoken"))
TOKENS = bpe.Tokenizer(RANKS, P.PATTERN)
OWN = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=RANKS, special_tokens={})


def ids_of(data):
    return np.frombuffer(data, "<u4").tolist()


def odd_texts():
    rng = random.Random(3)
    letters = "aàáeißñ你好мирЖ0123 9\n\t 　'\"!?.,-_=<>|🙂👩‍💻é"
    texts = ["", " ", "   x", "a" * 1000, "ab" * 700, " " * 333 + "x", "\n" * 90, "=" * 777, "don't we'll I'M 'sabc ''s !!'s", "<|endoftext|>", "0" * 500, "🙂" * 200, "x\u0000y"]
    return texts + ["".join(rng.choice(letters) for _ in range(rng.randint(1, 300))) for _ in range(400)]


def test_ids_equal_the_library():
    for text in odd_texts():
        assert ids_of(TOKENS.encode(text)) == OWN.encode_ordinary(text), text
        assert TOKENS.decode(TOKENS.encode(text)) == text.encode()


def test_code_points_are_cut_alike():
    chars = [chr(c) for c in [*range(0x3100), *range(0x3100, 0x110000, 37)] if not 0xD800 <= c < 0xE000]
    for i in range(0, len(chars), 500):
        text = "".join(f"b{c}1{c}{c} {c}x " for c in chars[i : i + 500])
        if ids_of(TOKENS.encode(text)) != OWN.encode_ordinary(text):
            for c in chars[i : i + 500]:
                assert ids_of(TOKENS.encode(f"b{c}1{c}{c} {c}x ")) == OWN.encode_ordinary(f"b{c}1{c}{c} {c}x "), hex(ord(c))


def test_windows_grow_until_tokens_are_stable():
    rng = random.Random(4)
    for _ in range(300):
        data = bytes(rng.choice(b"aab the") for _ in range(rng.randint(2, 400)))
        cut = rng.randint(0, len(data))
        whole = TOKENS.merged(data)
        assert TOKENS.joined(TOKENS.merged(data[:cut]), TOKENS.merged(data[cut:])) == whole
        assert TOKENS.reduced(data) == whole == TOKENS._merged_long(data)


def test_leaves_are_cut_between_matches():
    for text in odd_texts():
        parts = bpe.leaves(text, 20)
        assert "".join(parts) == text
        assert b"".join(map(TOKENS.encode, parts)) == TOKENS.encode(text)


def test_texts_longer_than_a_leaf(spark, monkeypatch):
    monkeypatch.setattr(bpe, "LEAF_CHARS", 4)
    rows = [(i, t) for i, t in enumerate(odd_texts()[:60])] + [(7, None), (None, "a b c" * 50), (3, "a b c" * 50), (3, "a b c" * 50)]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'x' as out", "1 as part", "2 as _row", "3 as `all`")
    got = bpe.decode(bpe.encode(df, TOKENS, leaf_chars=16), TOKENS)
    assert got.columns == [*df.columns, "ids", "decoded"]
    key = lambda r: (r[0] is None, r[0] or 0, r[1] or "")
    for r, (i, t) in zip(sorted(got.collect(), key=key), sorted(rows, key=key), strict=True):
        assert (r.doc_id, r.text, r.out, r.part, r._row) == (i, t, "x", 1, 2)
        assert ids_of(bytes(r.ids)) == OWN.encode_ordinary(t or "") and bytes(r.decoded) == (t or "").encode()
    assert bpe.encode(df.limit(0), TOKENS).count() == 0


def test_op12_over_documents(spark):
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()}
    got = bpe.op12_bpe(spark, "/root/testdata/sf0.001").collect()
    assert len(got) == len(docs)
    for r in got:
        ids = OWN.encode_ordinary(docs[r.doc_id])
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(docs[r.doc_id].encode()).hexdigest()


# --- 13: turns

def plain_repair(rows):
    """The cheapest (cost, audit, messages) by all edit strings, state by state, as whole strings."""
    best = {"": (0, "", ())}  # by initials so far, folded to the state

    def state(roles):
        return "" if not roles else roles[-1]

    def keep(found, roles, cost, audit, out):
        if re.fullmatch("s?(ua)*u?", roles):
            s = state(roles)
            if s not in found or (cost, audit) < found[s][:2]:
                found[s] = (cost, audit, out)

    def grown(found):
        for _ in range(3):
            for s, (cost, audit, out) in list(found.items()):
                for role in ("user", "assistant"):
                    keep(found, f"{s}{role[0]}" if s != "a" else f"ua{role[0]}", cost + 5, audit + "I", (*out, f"{role}:"))
        return found

    best = grown(best)
    for role, text, fault in rows:
        new = {}
        for s, (cost, audit, out) in best.items():
            before = {"a": "ua", "": "", "s": "s", "u": "u"}[s]
            keep(new, before, cost + 2, audit + "D", out)
            if fault in ("blank", "duplicate"):
                continue
            more = 5 if fault == "truncated" else 0
            keep(new, before + role[:1] if role[:1] in "sua" and role else "x", cost + more, audit + "K", (*out, f"{role}:{text}"))
            for to in ("user", "assistant"):
                keep(new, before + to[0], cost + 1 + more, audit + "R", (*out, f"{to}:{text}"))
        best = grown(new)
    return min(best[s] for s in ("", "a") if s in best)


def plain_report(rows):
    """rows in order: (turn, role, text)."""
    seen, faults = set(), []
    for _, role, text in rows:
        kept = text.strip(" \t\n\v\f\r")
        faults.append("blank" if not kept else "duplicate" if (role, text) in seen else "truncated" if kept[-1] not in ".!?" else "")
        seen.add((role, text))
    turns = {t for t, _, _ in rows if t is not None}
    gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(rows))
    cost, audit, out = plain_repair([(r, t, f) for (_, r, t), f in zip(rows, faults, strict=True)])
    return (gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit, hashlib.sha256("\n".join(out).encode()).hexdigest())


def plain_damage(rows):
    convs = {}
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        way = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        kept = convs.setdefault(conv, [])
        text = "" if way == 1 else re.sub("[.!?]", "", text) if way == 2 else text
        kept += [(turn, "user" if way == 4 else role, text)] * (0 if way == 0 else 2 if way == 3 else 1)
    return {c: sorted(r, key=lambda x: (x[0] is not None, x[0] or 0, x[1], x[2])) for c, r in convs.items()}


def reports(spark, rows, damaged=True):
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = conversations.repair(conversations.damage(df) if damaged else df.selectExpr("*", "1L as copies"))[0].collect()
    assert len({r.conv_id for r in got}) == len(got)
    return {r.conv_id: tuple(r)[1:] for r in got}


def random_rows(seed, convs=120, longest=14):
    rng = random.Random(seed)
    rows = []
    for c in range(convs):
        for t in range(rng.randint(1, longest)):
            role = rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None, "ux"])
            rows.append((c, rng.choice([t, t, t, t + 2, None]), role, rng.choice(["Yes.", "No!", "cut", " ", "", None, "a\nb?", f"Say {t}.", "x. \t\n", "é "])))
    return rows + rows[:20] + [(None, 1, "user", "Hi."), (None, None, "assistant", "Ho.")]


@pytest.mark.parametrize("block", [2000, 3])
def test_repair_equals_plain_search(spark, monkeypatch, block):
    monkeypatch.setattr(conversations, "BLOCK_ROWS", block)
    rows = random_rows(block)
    assert reports(spark, rows) == {c: plain_report(r) for c, r in plain_damage(rows).items()}


def test_conversation_over_many_partitions(spark):
    rng = random.Random(9)
    rows = [(5, t, rng.choice(["user", "assistant", "system"]), rng.choice(["Same.", f"Say {t}.", f"cut {t}"])) for t in range(9000)] + [(6, 0, "user", "Same."), (5, 3, "user", "Twice.")] + [(5, 3, "user", "Twice.")] * 5000
    got = reports(spark, rows, damaged=False)
    plain = {c: sorted(((t, r, x) for k, t, r, x in rows if k == c), key=lambda x: x) for c in (5, 6)}
    assert got == {c: plain_report(r) for c, r in plain.items()}


def test_turns_of_damage(spark):
    assert reports(spark, []) == {}
    gone = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    assert reports(spark, [(gone, 0, "user", "Hi.")]) == {gone: (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())}


def test_equal_hashes_are_verified(monkeypatch):
    monkeypatch.setattr(conversations.Audits, "_rolled", lambda self, before, char: (before + ord(char)) % 3)
    rng = random.Random(1)
    audits = conversations.Audits()
    nodes = {"": 0}
    for _ in range(400):
        at = rng.choice(list(nodes))
        new = at + rng.choice("DIKR")
        nodes.setdefault(new, audits.add(nodes[at], new[-1]))
    for a, b in itertools.product(rng.sample(list(nodes), 60), repeat=2):
        assert audits.less(nodes[a], nodes[b]) == (a < b), (a, b)


def test_op13_over_conversations(spark):
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.01/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = {r.conv_id: tuple(r)[1:] for r in conversations.op13_conversations(spark, "/root/testdata/sf0.01").collect()}
    assert got == {c: plain_report(r) for c, r in plain_damage(rows).items()}
