"""Near-duplicates, lines, decontamination and mixing against brute force."""

import collections
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from stintmill.llm import bytehash, decontam, lines, linking, mixing, neardup

WORDS = [f"w{i:03d}" for i in range(400)]
DOCS = "doc_id long, text string, lang string, source string, n_chars long, id string, keys int"


def frame(spark, texts):
    """Rows with columns that clash with the operators' own names."""
    return spark.createDataFrame([(k, t, "en", "s", 0, "x", 1) for k, t in texts], DOCS)


def near_texts():
    rng = random.Random(5)
    base = [rng.choices(WORDS, k=80) for _ in range(30)]
    out = [(i, " ".join(b)) for i, b in enumerate(base)]
    for i in range(30, 130):  # one large group of copies of text 0, edited more and less
        words = list(base[0])
        for _ in range(rng.randrange(4)):
            words[rng.randrange(80)] = rng.choice(WORDS)
        out.append((i, " ".join(words)))
    out += [(200 + k, " ".join(base[1]).upper() + "  ") for k in range(40)]
    return out + [(300, None), (301, ""), (302, "  "), (303, "one two"), (304, "One  two"), (305, "long " * 5000)]


def true_groups(texts, threshold=0.8):
    bags = {}
    for k, t in texts:
        w = (t or "").lower().split()
        grams = [tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))] if w else []
        bags[k] = collections.Counter(grams)
    group = {k: k for k, _ in texts}

    def find(x):
        while group[x] != x:
            x = group[x]
        return x

    ids = sorted(k for k, b in bags.items() if b)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            both = sum((bags[a] & bags[b]).values())
            if both >= threshold * (sum(bags[a].values()) + sum(bags[b].values()) - both):
                x, y = sorted((find(a), find(b)))
                group[y] = x
    return {k: find(k) for k, _ in texts}


def test_documents_equal_brute_force(spark):
    texts = near_texts()
    got = {r.doc_id: r.group_id for r in neardup.group_documents(frame(spark, texts)).collect()}
    assert got == true_groups(texts)
    left = neardup.dedup_documents(frame(spark, texts))
    assert {r.doc_id for r in left.collect()} == set(true_groups(texts).values())
    assert left.columns == frame(spark, []).columns


def test_documents_of_an_empty_table(spark):
    assert neardup.group_documents(frame(spark, [])).count() == 0
    assert neardup.dedup_documents(frame(spark, [])).count() == 0


def test_signatures_agree_as_often_as_weighted_jaccard(spark):
    rng = np.random.default_rng(2)
    doc, h, w = [], [], []
    for d in (0, 1):
        for e in range(60):
            weight = int(rng.integers(1, 40)) if d == 0 else (w[e] if rng.random() < 0.6 else int(rng.integers(1, 40)))
            doc.append(d), h.append(e * 7919 + 11), w.append(weight)
    a, b = np.array(w[:60]), np.array(w[60:])
    true = np.minimum(a, b).sum() / np.maximum(a, b).sum()
    times = neardup.bag_signatures(np.array(doc), np.array(h, np.uint64), np.array(w), 2, 4096)
    assert (times[0] == times[1]).mean() == pytest.approx(true, abs=0.03)


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + k) for k in range(1, 30)] + [(7, 7)]
    got = {r.id: r.component for r in linking.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, **{100 + k: 100 for k in range(30)}}


def test_links_of_second_generation_copies_beside_a_large_hub(spark):
    hub = list(range(100))
    sets = {0: hub} | {k: hub[:-1] + [1000 + k] for k in range(1, 300)}
    for k in range(20):  # b is alike the hub; c is alike b alone, and shares one key with it
        sets[400 + k] = hub[10:] + [2000 + 100 * k + j for j in range(10)]
        sets[500 + k] = sets[400 + k][8:] + [9000 + 100 * k + j for j in range(8)]
    def sketch(s):
        turns = bytehash.mixed(np.arange(1, 33, dtype=np.uint64) * bytehash.P)
        least = bytehash.mixed(np.array(s, np.uint64)[:, None] * bytehash.Q ^ turns[None, :]).min(axis=0)
        return [int(x) for x in linking.packed(bytehash.mixed(least)[None, :])[0]]

    rows = [(i, [7] + [1_000_000 + (0 if i < 300 else 10 * i + j) for j in range(7)], *sketch(s)) for i, s in sets.items()]
    members = linking.staged(spark.createDataFrame(rows, "id long, keys array<long>, s0 long, s1 long, s2 long, s3 long"), "members")
    table = spark.createDataFrame(list(sets.items()), "id long, h array<int>")
    alike = lambda x, y: F.size(F.array_intersect(x, y)) >= 0.8 * F.size(F.array_union(x, y))
    links = linking.leader_links(members, lambda asked: table.join(asked, "id"), alike, list, 0.8)
    near = lambda a, b: len(set(sets[a]) & set(sets[b])) >= 0.8 * len(set(sets[a]) | set(sets[b]))
    assert all(near(0, 400 + k) and near(400 + k, 500 + k) and not near(0, 500 + k) for k in range(20))
    got = {r.id: r.component for r in linking.components(links).collect()}
    assert got == dict.fromkeys(sets, 0)


def test_bitmap_splits_rows_without_loss(spark):
    rows = spark.range(5000).select(F.xxhash64("id").alias("v"), "id")
    marks = linking.bitmap(rows.where("id % 50 = 0").select("v"), "v")
    inside, outside = linking.maybe_in(rows, "v", marks), linking.surely_out(rows, "v", marks)
    assert inside.count() + outside.count() == 5000
    assert inside.where("id % 50 = 0").count() == 100


def test_lines_keep_the_first_of_each_component(spark):
    rng = random.Random(9)
    long = " ".join(rng.choices(WORDS, k=40))
    near = long.replace(long.split()[20], "changed", 1)
    other = " ".join(rng.choices(WORDS, k=40))
    texts = [(1, f"{long}\nshort\n\n{other}"), (2, f"{near}\nshort\nfresh line here"), (3, long), (4, None), (5, ""), (6, "short"), (7, "x" * 3000 + "\n" + "x" * 3000)]
    out = {r.doc_id: r.text for r in lines.dedup_lines(frame(spark, texts)).collect()}
    assert out == {1: f"{long}\nshort\n\n{other}", 2: "fresh line here", 3: "", 4: None, 5: "", 6: "", 7: "x" * 3000}
    assert lines.dedup_lines(frame(spark, [])).count() == 0


def test_line_links_equal_brute_force(spark):
    rng = random.Random(11)
    base = [" ".join(rng.choices(WORDS, k=rng.randrange(12, 60))) for _ in range(40)]
    every = list(base)
    for b in base[:20]:
        w = b.split()
        w[rng.randrange(len(w))] = "edited"
        every.append(" ".join(w))
    texts = [(i, t) for i, t in enumerate(every)]

    sets = [{t[k : k + 5] for k in range(max(1, len(t) - 4))} for t in every]
    gone = {j for j in range(len(every)) for i in range(j) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])}
    got = {r.doc_id for r in lines.duplicate_lines(frame(spark, texts)).collect()}
    assert got == gone


def test_line_typos_equal_brute_force_on_characters(spark):
    rng = random.Random(23)
    letters = "abcdefghijklmnopqrstuvwxyz"
    every = [" ".join("".join(rng.choices(letters, k=rng.randrange(2, 10))) for _ in range(n)) for n in (8, 10, 12, 15, 18, 30) for _ in range(15)]
    for line in list(every):
        at = rng.choice([k for k, c in enumerate(line) if c != " "])
        every.append(line[:at] + ("q" if line[at] != "q" else "z") + line[at + 1 :])
    every += ["-" * 30, "-" * 31, "abc", "abd"]
    sets = [{t[k : k + 5] for k in range(max(1, len(t) - 4))} for t in every]
    gone = {j for j in range(len(every)) for i in range(j) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])}
    got = {r.doc_id for r in lines.duplicate_lines(frame(spark, list(enumerate(every)))).collect()}
    assert len(gone) > 70 and got == gone


def test_leaks_copy_changed_and_inconsistent(spark):
    item = "a train leaves the old station with 120 people and then meets Maria Lopez who counts 7 bags near the river before 120 birds arrive there"
    changed = item.replace("120", "350").replace("Maria Lopez", "Ann Lee").replace("7 bags", "9 bags")
    mixed = item.replace("120 people", "350 people").replace("7 bags", "9 bags")  # 120 is 350 here and 120 there
    texts = [(1, "before " + item + " after"), (2, f"Well. We read: {changed}!"), (3, mixed), (4, " ".join(WORDS[:60])), (5, None), (6, ""), (7, "word " * 30000 + item)]
    bench = spark.createDataFrame([(9, item), (9, item), (10, None), (11, "too short"), (None, item)], "item_id long, text string")
    got = {(r.doc_id, r.item_id): r.kind for r in decontam.leaks(frame(spark, texts), bench).collect()}
    assert got == {(1, 9): "copy", (2, 9): "reparameterised", (7, 9): "copy"}
    left = {r.doc_id for r in decontam.decontaminate(frame(spark, texts), bench).collect()}
    assert left == {3, 4, 5, 6}
    assert decontam.leaks(frame(spark, []), bench).count() == 0
    assert decontam.leaks(frame(spark, texts), bench.limit(0)).count() == 0


def test_leaks_of_runs_at_edges_altered_values_and_short_items(spark):
    ends = "the teacher asks Maria Lopez how many apples are left in the basket and then the answer is read aloud by Maria Lopez"
    twice = "a farmer sells 40 eggs at the market in the morning and carries the rest of them home by the old road where " \
        "the miller of the village later buys exactly 40 eggs"
    texts = [
        (1, f"so {ends} And Others"), (2, twice.replace("40 eggs at", "41 eggs at")), (3, "we saw 3 5 8 13 21 34 55 89 144 233 there"),
        (4, "they said capital of france twice"), (5, "capital of spain"), (6, "we saw 3 5 9 there"), (7, f"so {ends.replace('Maria Lopez how', 'Ann Lee how')} And Others"),
    ]
    bench = spark.createDataFrame([(1, ends), (2, twice), (3, "3 5 8 13 21 34 55 89 144 233"), (4, "capital of France"), (5, ""), (6, None)], "item_id long, text string")
    got = {(r.doc_id, r.item_id): (r.kind, r.share) for r in decontam.leaks(frame(spark, texts), bench).collect()}
    assert {k for k in got if k[0] < 7} == {(1, 1), (2, 2), (3, 3), (4, 4)}
    assert all(got[k, k][0] == "copy" for k in range(1, 5)) and got[1, 1][1] == got[3, 3][1] == 1.0


def plain_templates(text):
    """Template tokens (kind, identity, value) and plain words of a text, token by token."""
    found, plain = [], []
    last_end, last_number = None, False
    for m in re.finditer(r"[A-Za-z]+|[0-9]+", text):
        word, low = m.group(), m.group().lower()
        plain.append(low)
        inside = last_end is not None and not re.search(r"[\n\r!.:?]", text[last_end : m.start()])
        kind = "number" if word[0].isdigit() else "unit" if last_number and low in decontam.UNITS else "name" if word[0].isupper() and inside else None
        last_end, last_number = m.end(), word[0].isdigit()
        if kind and found and found[-1][0] == kind:
            found[-1] = (kind, kind, text[found[-1][3] : m.end()], found[-1][3])
        else:
            found.append((kind, kind or low, word, m.start()))
    return found, plain


def brute_leaks(texts, items, copied_share=0.3, changed_share=0.5):
    norm = lambda v: " ".join(v.lower().split())
    docs = {}
    for k, t in texts:
        docs[k] = plain_templates(t or "")
    out = {}
    for item, text in items:
        toks, plain = plain_templates(text or "")
        n = len(toks)
        length = 8 if n >= 8 else n
        starts = [a for a in range(n - length + 1) if length >= 4 and 2 * sum(not t[0] for t in toks[a : a + length]) >= length]
        words = not starts
        if words:
            toks = [(None, w, w, 0) for w in plain]
            n, length = len(toks), min(8, len(toks))
            starts = list(range(n - length + 1)) if n else []
        windows = collections.defaultdict(list)
        for a in starts:
            windows[tuple(t[1] for t in toks[a : a + length])].append(a)
        for k, (doc, doc_plain) in docs.items():
            mine = [(None, w, w, 0) for w in doc_plain] if words else doc
            by_shift = collections.defaultdict(lambda: [set(), set(), set()])
            for b in range(len(mine) - length + 1):
                key = tuple(t[1] for t in mine[b : b + length])
                for a in windows.get(key, ()):
                    keys, copied, slots = by_shift[b - a]
                    keys.add(key)
                    own = True
                    for j in range(length):
                        kind, _, value, _ = toks[a + j]
                        if not kind:
                            continue
                        i, d = norm(value), norm(mine[b + j][2])
                        if j not in (0, length - 1):
                            slots.add(((kind, i), d))
                        first, last = j == 0 and a == 0, j == length - 1 and a + length == n
                        own &= i == d or (last and d.startswith(i + " ")) or (first and d.endswith(" " + i))
                    if own:
                        copied.add(key)
            agreed = [(keys if len(slots) == len({i for i, _ in slots}) else copied, copied) for keys, copied, slots in by_shift.values()]
            share, same = (len(set().union(*[p[q] for p in agreed])) / len(windows) if windows else 0 for q in (0, 1))
            if same >= copied_share or share >= changed_share:
                out[k, item] = ("copy" if same >= copied_share else "reparameterised", round(share, 9))
    return out


def test_a_sentence_that_many_items_and_documents_share_makes_no_product(spark):
    rng = random.Random(8)
    shared = " ".join(rng.choices(WORDS, k=16))
    own = [" ".join(rng.choices(WORDS, k=40)) for _ in range(1000)]
    items = spark.createDataFrame([(k, f"{shared} {w}") for k, w in enumerate(own)], "item_id long, text string")
    texts = [(k, f"{' '.join(rng.choices(WORDS, k=20))} {shared} {' '.join(rng.choices(WORDS, k=20))}") for k in range(990)]
    texts += [(k, f"{shared} {own[k]}") for k in range(990, 1000)]
    docs = frame(spark, texts)
    windows = decontam.item_windows(items)
    hits = linking.staged(decontam.window_hits(docs, windows), "hits")
    assert hits.count() > 9000
    assert decontam._met(hits, windows, 0.3).count() < 50_000
    got = {(r.doc_id, r.item_id, r.kind) for r in decontam.leaks(docs, items).collect()}
    assert got == {(k, k, "copy") for k in range(990, 1000)}


@pytest.mark.parametrize("least", [0.05, 0.3, 0.5, 0.9])
def test_candidates_hold_every_pair_that_reaches_the_share(spark, least):
    rng = random.Random(9)
    keys = {i: set(rng.sample(range(30), rng.randint(1, 12))) for i in range(40)}  # few keys, so most are shared
    held = {d: set(rng.sample(range(35), rng.randint(0, 14))) for d in range(60)}
    items = spark.createDataFrame([(i, k, 0, 8, []) for i, s in keys.items() for k in s], "item_id long, key long, item_pos int, length int, item_slots array<string>")
    hits = spark.createDataFrame([(d, k, 0, []) for d, s in held.items() for k in s for _ in range(1 + k % 2)], "doc_id long, key long, doc_pos int, doc_slots array<string>")
    got = [(r.doc_id, r.item_id) for r in decontam.candidates(hits, items, least).collect()]
    reach = {(d, i) for d, h in held.items() for i, k in keys.items() if h & k and len(h & k) / len(k) >= least}
    assert len(got) == len(set(got)) and reach <= set(got) <= {(d, i) for d, h in held.items() for i, k in keys.items() if h & k}


def test_leaks_equal_brute_force(spark):
    rng = random.Random(31)
    names = ["Maria Lopez", "Ann Lee", "Otto", "Kim"]
    def sentence():
        words = rng.choices(WORDS[:60], k=rng.randrange(6, 14))
        for _ in range(rng.randrange(5)):
            words[rng.randrange(len(words))] = rng.choice([rng.choice(names), str(rng.randrange(30)), f"{rng.randrange(9)} km", f"{rng.randrange(9)} hours"])
        return " ".join(words) + rng.choice([".", "?", ",", ""])
    items = [(k, " ".join(sentence() for _ in range(rng.randrange(1, 4)))) for k in range(30)]
    items += [(k, f"so w{k:03d} has {k} of w001 and Otto {k + 3} km of w002 but Kim w003 {k + 5} on w004 days") for k in range(30, 40)] + [(90, "w001 w002"), (91, "7 9 11"), (92, ""), (93, None)]
    texts = []
    for k in range(160):
        words = items[rng.randrange(40)][1].split()
        for _ in range(rng.choice([0, 0, 1, 2, 5])):
            at = rng.randrange(len(words))
            words[at] = rng.choice([rng.choice(names), str(rng.randrange(30)), words[at], rng.choice(WORDS)])
        said = " ".join(words)
        if k % 3 == 0:  # other values throughout, most of them consistent
            said = re.sub(r"[0-9]+", lambda m: str(int(m.group()) + 40 + (rng.random() < 0.05)), said)
            for a, b in zip(names, ["Zoe", "Lin Po", "Max", "Eve Adams"], strict=True):
                said = said.replace(a, b)
        texts.append((k, f"{sentence()} {said} {sentence()}"))
    got = {(r.doc_id, r.item_id): (r.kind, round(r.share, 9)) for r in decontam.leaks(frame(spark, texts), spark.createDataFrame(items, "item_id long, text string")).collect()}
    want = brute_leaks(texts, items)
    assert got == want
    assert {kind for kind, _ in want.values()} == {"copy", "reparameterised"} and len(want) > 80


def test_equal_new_values_are_a_changed_question(spark):
    item = "a baker makes 120 rolls and sells 7 boxes to 4 inns before 3 bells ring 5 times at 8 gates"
    texts = [(1, re.sub("[0-9]+", "9", item)), (2, item.replace("120", "9")), (3, item.replace("120", "9").replace("7", "120"))]
    got = {r.doc_id: r.kind for r in decontam.leaks(frame(spark, texts), spark.createDataFrame([(1, item)], "item_id long, text string")).collect()}
    assert got == {1: "reparameterised", 2: "copy", 3: "copy"}


def test_near_duplicates_of_repeated_and_null_ids(spark):
    text = " ".join(WORDS[:30])
    rows = [(1, text), (1, text), (1, " ".join(WORDS[40:90])), (2, text + " more"), (None, text), (3, None), (3, "")]
    got = collections.Counter((r.doc_id, r.group_id) for r in neardup.group_documents(frame(spark, rows)).collect())
    assert got == {(1, 1): 3, (2, 1): 1, (3, 3): 2}
    left = collections.Counter(r.doc_id for r in neardup.dedup_documents(frame(spark, rows)).collect())
    assert left == {1: 3, None: 1, 3: 2}


def test_mix_of_equal_hashes_and_white_space(spark):
    rows = [(7, "a  b\nc d", "en", "s", 0, "x", 1)] * 4 + [(None, "a b", "en", "s", 0, "x", 1)] * 2
    df = spark.createDataFrame(rows, DOCS)
    one, two = ([tuple(r) for r in mixing.mix(d).orderBy("doc_id", "taken").collect()] for d in (df, df.repartition(3)))
    assert one == two and sum(r[-1] for r in one) == 30
    texts = [r.text for r in mixing.mixed_texts(df, share=1.1).collect()]
    assert all(t in ("a  b\nc d", "a  b\nc", "a  b", "a", "a b") for t in texts)


def test_mix_meets_targets(spark):
    rng = random.Random(1)
    rows = [(i, " ".join(["w"] * rng.randrange(0, 30)), "en", s, 0, "x", 1) for i, s in enumerate(rng.choices(["a", "b", "c", None, "hot"], [1, 1, 3, 1, 12], k=400))]
    rows += [(5, None, "en", "empty", 0, "x", 1), (None, "w w w", "en", "b", 0, "x", 1)]
    out = mixing.mix(spark.createDataFrame(rows, DOCS)).toPandas()
    assert len(out) == len(rows)
    assert (out["taken"] <= 2 * out["size"]).all() and (out["taken"] >= 0).all()
    by = out.fillna({"source": "-"}).groupby("source").agg(taken=("taken", "sum"), target=("target", "first"), size=("size", "sum"), whole=("source_size", "first"))
    assert (abs(by["taken"] - by["target"]) <= 0.5 + 1e-6).all()
    assert (by["size"] == by["whole"]).all()
    assert by["target"].sum() == pytest.approx(1.5 * by["size"].sum())
    texts = mixing.mixed_texts(spark.createDataFrame(rows, DOCS)).withColumn("n", F.regexp_count("text", F.lit(mixing.WORD))).groupBy("source").agg(F.sum("n").alias("n"))
    assert {r.source: r.n for r in texts.collect()} == {(None if k == "-" else k): v for k, v in by["taken"].items() if v}
    assert mixing.mix(spark.createDataFrame([], DOCS)).count() == 0


def test_families_of_edited_copies_lose_no_links(spark):
    rng = random.Random(77)
    texts, parent = [], {}
    for family in range(12):
        own = [rng.choices(WORDS, k=90)]
        for _ in range(59):  # each is an earlier one with a run of words changed
            words = list(own[rng.randrange(len(own))])
            at = rng.randrange(85)
            words[at : at + 4] = rng.choices(WORDS, k=4)
            own.append(words)
        for k, w in enumerate(own):
            texts.append((family * 100 + k, " ".join(w)))
    got = {r.doc_id: r.group_id for r in neardup.group_documents(frame(spark, texts)).collect()}
    want = true_groups(texts)
    def pairs(groups):
        by = collections.defaultdict(list)
        for k, g in groups.items():
            by[g].append(k)
        return sum(len(m) * (len(m) - 1) // 2 for m in by.values())
    assert len(set(want.values())) < 60
    assert all(want[k] == want[g] for k, g in got.items())
    assert pairs(got) >= 0.99 * pairs(want)


def test_repeated_rows_keep_one_copy_and_shared_ids_are_told_apart(spark):
    same, other = "the same line stands here twice over", "another line that nothing else is like"
    texts = [(5, same), (5, same), (1, f"{same} and more words behind it to differ by much"), (1, f"{same}\n{other}"), (None, same), (9, "\n\n"), (9, "\n\n")]
    out = collections.Counter((r.doc_id, r.text) for r in lines.dedup_lines(frame(spark, texts)).collect())
    assert out == collections.Counter([(5, ""), (5, ""), (1, texts[2][1]), (1, f"{same}\n{other}"), (None, same), (9, "\n\n"), (9, "\n\n")])
    out = [r.text for r in lines.dedup_lines(frame(spark, [(5, f"{same}\n\n{other}")] * 3)).collect()]
    assert sorted(out) == ["", "", f"{same}\n\n{other}"]


def test_line_sketches_of_long_and_odd_lines():
    rng = random.Random(3)
    odd = ["a", "", "abcd", "abcde", "x" * 300_000, "".join(rng.choices("abcdé€😀", k=290_000))]
    want = [{t.ljust(5, "\0")[k : k + 5] for k in range(max(1, len(t) - 4))} for t in odd]
    assert [len(s) for s in lines.line_sets(odd)] == [len(s) for s in want]
    both, either = lines.overlaps(odd, odd[1:] + odd[:1])
    assert list(both) == [len(a & b) for a, b in zip(want, want[1:] + want[:1])]
    assert list(either) == [len(a | b) for a, b in zip(want, want[1:] + want[:1])]
    minima = lines.line_minima(odd)
    assert (minima == np.vstack([lines.line_minima([t]) for t in odd])).all()
    assert lines.line_keys(minima).shape == (len(odd), len(lines.BANDS))


def test_lines_are_found_by_dataframe_operations_alone(spark, monkeypatch):
    """No Python on the executors, also where leaders leave pairs open and nearest ones are tested first."""

    def refused(*_, **__):
        raise AssertionError("Python on the executors")

    from pyspark.sql import DataFrame

    for name in ("mapInArrow", "mapInPandas"):
        monkeypatch.setattr(type(spark.range(1)), name, refused)
        monkeypatch.setattr(DataFrame, name, refused)
    monkeypatch.setattr(linking, "MANY", 0)
    rng = random.Random(3)
    every = []
    for _ in range(6):  # families of which each line is an edited copy of another
        family = ["".join(rng.choices("abcdefgh ", k=rng.choice([60, 150, 400]))).strip()]
        for _ in range(12):
            line = rng.choice(family)
            at = rng.randrange(len(line) - 6)
            family.append((line[:at] + "".join(rng.choices("xyz", k=3)) + line[at + 3 :]).strip())
        every += family
    every += ["x" * 3000, "x" * 7, "ab"]
    sets = lines.line_sets(every)
    sizes = frame(spark, list(enumerate(every))).select("doc_id", F.size(lines.shingle_set(F.col("text"))).alias("n")).collect()
    assert {r.doc_id: r.n for r in sizes} == {k: len(s) for k, s in enumerate(sets)}
    group = list(range(len(every)))
    for a in range(len(every)):
        for b in range(a):
            both = len(np.intersect1d(sets[a], sets[b]))
            if both >= 0.8 * (len(sets[a]) + len(sets[b]) - both) and group[a] != group[b]:
                low, high = sorted((group[a], group[b]))
                group = [low if g == high else g for g in group]
    found = lines.duplicate_lines(frame(spark, list(enumerate(every))))
    assert not any(word in found._jdf.queryExecution().toString() for word in ("Python", "Pandas", "Arrow"))
    got, want = {r.doc_id for r in found.collect()}, {k for k, g in enumerate(group) if g != k}
    assert got <= want and len(want - got) <= 0.02 * len(want)


def test_pairs_are_screened_before_the_exact_test_without_loss(spark, monkeypatch):
    """Edited copies of lines that come near each other but not to 0.8 meet no exact test, and no alike pair is screened out."""
    rng = random.Random(8)
    every = []
    for size in (40, 90, 300, 900):
        for _ in range(3):
            base = rng.choices("abcdefgh ", k=size)
            for edits in (0, 1, 2, size // 60, size // 45, size // 30, size // 20, size // 15):
                line = list(base)
                for at in rng.sample(range(1, size - 1), edits):
                    line[at] = rng.choice("xyz")
                every.append("".join(line).strip() + ".")
    every += ["x" * 2000, "abc", "漢字" * 40, "漢字" * 41, ""]
    named = frame(spark, list(enumerate(every))).select(F.col("doc_id").alias("id"), F.col("text").alias("line"))
    bits = lines.shingle_bits(named)
    may = lines.may_be_alike(0.8)
    sides = [bits.select(F.col("id").alias(s), F.col("n").alias(f"{s}_n"), F.col("bits").alias(f"{s}_bits")) for s in ("a", "b")]
    passed = {(r.a, r.b) for r in sides[0].crossJoin(sides[1]).where("a < b").where(may("a_", "b_")).select("a", "b").collect()}
    sets = lines.line_sets(every)
    similar = {}
    for b in range(len(every)):
        for a in range(b):
            both = len(np.intersect1d(sets[a], sets[b]))
            similar[a, b] = both / (len(sets[a]) + len(sets[b]) - both)
    assert {p for p, s in similar.items() if s >= 0.8} <= passed
    assert len(similar) > 5000 and sum(s < 0.7 for p, s in similar.items() if p in passed) <= 5
    # what duplicate_lines hands to the exact test of open pairs
    tested, exact = [], linking._tested

    def counted(pairs, sets_of, alike):
        tested.append(pairs.count())
        return exact(pairs, sets_of, alike)

    monkeypatch.setattr(linking, "_tested", counted)
    family = []
    for _ in range(4):
        words = [rng.choices("abcdefgh", k=5) for _ in range(40)]
        for _ in range(12):  # pairs of about 0.6 share keys, but are not alike
            family.append(" ".join("".join(rng.choices("xyz", k=5) if rng.random() < 0.11 else w) for w in words))
    lines.duplicate_lines(frame(spark, list(enumerate(family)))).collect()
    assert sum(tested[1:]) <= 12
    before = len(tested)
    monkeypatch.setattr(linking, "_screened", lambda pairs, marks, may: pairs)
    lines.duplicate_lines(frame(spark, list(enumerate(family)))).collect()
    assert sum(tested[before + 1 :]) >= 40


def test_lines_with_some_empty_bins_equal_brute_force(spark):
    """Lines of 30 to 300 characters, where bins begin to stay empty, lose no more pairs than others."""
    rng = random.Random(2)
    texts = []
    for k in range(300):
        line = rng.choices("abcdefghijklmnopqrstuvwxyz ", k=rng.randrange(30, 300))
        line[0], line[-1] = "a", "z"
        texts.append((2 * k, "".join(line)))
        at = rng.randrange(1, len(line) - 1)
        for _ in range(max(1, len(line) // 60)):
            line[(at + rng.randrange(len(line) - 2)) % (len(line) - 2) + 1] = "é"
        texts.append((2 * k + 1, "".join(line)))
    sets = lines.line_sets([t for _, t in texts])
    want = set()
    for k in range(0, len(texts), 2):
        both = len(np.intersect1d(sets[k], sets[k + 1]))
        if both >= 0.8 * (len(sets[k]) + len(sets[k + 1]) - both):
            want.add(k + 1)
    empty = [r.empty for r in lines._filled(lines.bin_minima(frame(spark, texts).select(F.col("doc_id").alias("id"), F.col("text").alias("line")))).collect()]
    assert sum(0 < e <= lines.FEW for e in empty) > 50 and sum(lines.FEW < e <= lines.MOST for e in empty) > 50
    got = {r.doc_id for r in lines.duplicate_lines(frame(spark, texts)).collect()}
    assert got <= want and len(want) > 100 and len(want - got) <= 0.02 * len(want)
