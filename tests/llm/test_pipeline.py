"""The pipeline's stages keep clean documents and act on what they are given."""

import collections
import random

import pytest
from pyspark.sql import functions as F
from test_text_operators import WORDS, brute_leaks, true_groups

corpus_pipeline = pytest.importorskip("corpus_pipeline")
SF = "/root/testdata/sf0.001"


def test_stages_keep_columns_and_pass_on_their_rows(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    sizes = [docs.count()]
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        if name != "mixing":
            assert out.columns == columns
            out = out.cache()
            sizes.append(out.count())
            assert out.join(docs, "doc_id", "left_anti").count() == 0
        else:
            words = F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+"))
            have, taken = (d.agg(F.sum(words)).first()[0] for d in (docs, out))
            assert taken == pytest.approx(1.5 * have, rel=0.01)
        docs = out
    assert sizes == sorted(sizes, reverse=True)
    assert sizes[-1] > 0.6 * sizes[0]


def test_names():
    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "line dedup", "near dedup", "decontamination", "mixing"]


def test_stages_take_null_empty_and_repeated_rows(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    text = "a line of its own that no other document says in this table\nand one more of them"
    odd = [(900001, None, "en", None, None), (900002, "", None, "s", 0), (900003, text, "en", "s", len(text)), (900003, text, "en", "s", len(text)), (None, "the row without an id keeps what it says", "en", "s", 40)]
    odd = spark.createDataFrame(odd, "doc_id long, text string, lang string, source string, n_chars long")
    odd = odd.select([F.col(c).cast(docs.schema[c].dataType) for c in docs.columns])
    for name, stage in corpus_pipeline.STAGES:
        small = docs.limit(60).unionByName(odd)
        out = stage(spark, small, SF)
        rows = out.collect()
        if name != "mixing":
            assert out.columns == docs.columns
            kept = [r.text for r in rows if r.doc_id == 900003]
            assert text in kept
            assert any(r.doc_id is None for r in rows)
        assert stage(spark, docs.limit(0), SF).count() == 0


def corpus(rng):
    """Documents of lines, with toxic ones, repeated and altered lines, altered copies and benchmark items."""
    line = lambda n: " ".join(rng.choices(WORDS, k=n))
    common = [line(rng.randrange(8, 20)) for _ in range(6)]
    items = [(k, f"so {line(3)} has {k} of {line(4)} and {line(6)} with {k + 3} more {line(5)}") for k in range(5)]
    docs = []
    for k in range(150):
        lines = [line(rng.randrange(3, 25)) for _ in range(rng.randrange(1, 7))]
        for c in rng.sample(common, rng.randrange(3)):
            words = c.split()
            if rng.random() < 0.3:
                words[rng.randrange(len(words))] += "x"
            lines.insert(rng.randrange(len(lines) + 1), " ".join(words))
        if k % 3 == 0:
            lines = [" ".join(w if rng.random() > 0.2 else rng.choice(["vile", "rotten", "foul"]) for w in x.split()) for x in lines]
        if k % 13 == 5:
            lines[0] = f"{line(4)} {rng.choice(items)[1]} {line(4)}"
        text = "\n".join(lines)
        if k % 10 == 9 and docs[-1][1]:  # one word more on each line of the document before
            text = "\n".join(x + " and" for x in docs[-1][1].split("\n"))
        docs.append((k, text, "en", rng.choice(["a", "b", "c"]), len(text)))
    return docs, items


def without_repeated_lines(texts):
    spots = [(k, pos, x.strip(" \t\r")) for k, t in texts for pos, x in enumerate(t.split("\n"))]
    lines = sorted({x for _, _, x in spots if x})
    sets = [{x[j : j + 5] for j in range(max(1, len(x) - 4))} for x in lines]
    group = list(range(len(lines)))

    def find(a):
        while group[a] != a:
            a = group[a]
        return a

    for a in range(len(lines)):
        for b in range(a):
            if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                group[find(a)] = find(b)
    of, first = {x: find(n) for n, x in enumerate(lines)}, {}
    for k, pos, x in sorted(spots):
        if x:
            first.setdefault(of[x], (k, pos))
    return {k: "\n".join(x for pos, x in enumerate(t.split("\n")) if not (y := x.strip(" \t\r")) or first[of[y]] == (k, pos)) for k, t in texts}


def test_pipeline_equals_brute_force(spark, tmp_path):
    docs, items = corpus(random.Random(12))
    labels = [(k, int(any(w in t for w in ("vile", "rotten", "foul")))) for k, t, *_ in docs]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    tables = {"documents": spark.createDataFrame(docs, schema), "labels": spark.createDataFrame(labels, "doc_id long, toxic int"), "benchmark": spark.createDataFrame(items, "item_id long, text string")}
    for name, rows in tables.items():
        rows.write.parquet(f"{tmp_path}/{name}.parquet")
    model = corpus_pipeline.train(tables["documents"], tables["labels"])
    left = [(k, t) for k, t, *_ in docs if model.score(t) < 0.5]
    assert {k for k, _ in left} == {k for k, y in labels if not y}
    slim = [(k, t) for k, t in without_repeated_lines(left).items() if t.strip()]
    assert len(slim) < len(left) or dict(slim) != dict(left)
    groups = true_groups(slim)
    alone = [(k, t) for k, t in slim if groups[k] == k]
    leaked = {k for k, _ in brute_leaks(alone, items)}
    want = {k: t for k, t in alone if k not in leaked}
    assert leaked and len(want) > 50
    source = {k: s for k, _, _, s, _ in docs}
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in out} <= want.keys()
    words, have, taken = lambda t: len(t.split()), collections.Counter(), collections.Counter()
    for k, t in want.items():
        have[source[k]] += words(t)
    for r in out:
        assert r.text == want[r.doc_id] or want[r.doc_id].startswith(r.text)
        assert (r.source, r.n_chars) == (source[r.doc_id], len(r.text))
        taken[r.source] += words(r.text)
    # targets by clamping in rounds
    weight, total, open_ = {"a": 3, "b": 1, "c": 2}, 1.5 * sum(have.values()), set(have)
    target = {}
    while open_:
        share = {s: (total - sum(target.values())) * weight[s] / sum(weight[o] for o in open_) for s in open_}
        over = {s for s in open_ if share[s] >= 2 * have[s]}
        if not over:
            target |= share
            break
        target |= {s: 2 * have[s] for s in over}
        open_ -= over
    assert all(abs(taken[s] - target[s]) <= 1 for s in have)
    per = collections.Counter(r.doc_id for r in out)
    assert max(per.values()) <= 3


ODD_NAMES = ("_k", "_K2", "_lines", "_id", "_r", "_c", "_slot", "_bucket", "_bit", "_bits", "_twins", "_dropped", "_nth", "_salt", "score", "id", "id2", "key", "keys", "component", "gone", "h", "n", "s0", "out", "row", "all", "part")


def test_no_column_name_clashes_with_a_stage(spark, tmp_path):
    rows = [(i, f"Line number {i} about nothing much at all, said {i * 37 % 101} times.\nShared closing words that everyone repeats here.") for i in range(30)]
    rows += [(40, rows[3][1]), (40, rows[3][1]), (None, "no id"), (41, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'en' as lang", "'a' as source", "length(text) as n_chars", *[f"concat('{c}', doc_id) as `{c}`" for c in ODD_NAMES])
    for name, schema in (("labels", "doc_id long, toxic int"), ("benchmark", "item_id long, text string")):
        spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/{name}.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns, name
        kept = out.collect()
        assert kept and all(r[c] == (None if r.doc_id is None else f"{c}{r.doc_id}") for r in kept for c in ODD_NAMES), name
    assert corpus_pipeline.mixing(spark, docs, str(tmp_path)).columns[-1] == "n_chars"
    assert corpus_pipeline.mixing(spark, docs, str(tmp_path)).count() > 30
