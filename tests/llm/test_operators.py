"""Operators as a whole: odd inputs, held-out accuracy, recall, archives, mixes and the pipeline."""

import hashlib
import itertools
import os
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tidewater.llm import jaccard_join, license_rules, media_columns, multiprobe_lsh, quality_crf, source_mixing, suffix_pieces, toxicity_grammar, url_rules
from tidewater.llm import queries as Q
from tidewater.llm import warc_salvage as W

SF = "/root/testdata/sf0.01"
needs_tables = pytest.mark.skipif(not os.path.isdir(SF), reason="the test tables are not here")


@pytest.fixture(scope="module")
def folder(spark, odd, tmp_path_factory):
    """The odd documents as tables of a directory, with odd labels, pages and vectors."""
    path = str(tmp_path_factory.mktemp("odd"))
    odd.write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(1, 1, 0), (2, 0, 1), (2, 1, 1), (None, 1, 1), (8, None, None), (9, 0, 0), (99, 1, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    page = "<p>" + "x" * 200 + "</p>"
    rows = [(1, "http://A.example.com/en/x?y", page), (2, None, page), (2, None, page), (None, "no scheme", page), (3, "https://net/fr/#a", None), (4, "https://x.net/fr", "short"), (5, "ftp://www.Example.com:80/en/", "short"), (6, "http://", "")]
    spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 as digest", "2 as first", "'q' as host", "3 as refers_to").write.parquet(f"{path}/pages.parquet")
    v = [(0, [1.0, 0.0]), (50, [1.0, 0.1]), (50, [1.0, 0.1]), (1, [0.0, 1.0]), (2, None), (3, [0.0, 0.0]), (4, [float("nan"), 1.0]), (5, [None, 1.0]), (6, [1.0, 0.0]), (7, [2.0, 0.0]), (None, [1.0, 1.0]), (100, [1.0, 2.0, 3.0])]
    spark.createDataFrame(v, "vec_id long, embedding array<float>").selectExpr("*", "0.5 as score", "1 as id").write.parquet(f"{path}/embeddings.parquet")
    return path


@pytest.fixture(scope="module")
def empty_folder(spark, folder, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("empty"))
    for t in ("documents", "labels", "pages", "embeddings"):
        spark.read.parquet(f"{folder}/{t}.parquet").where("false").write.parquet(f"{path}/{t}.parquet")
    return path


@pytest.mark.parametrize("name", sorted(Q.QUERIES))
def test_odd_rows(spark, folder, name):
    rows = Q.QUERIES[name](spark, folder).collect()
    if not name.startswith("op9"):
        table = "pages" if name[:4] in ("op7_", "op8_") else "documents"
        assert len(rows) == spark.read.parquet(f"{folder}/{table}.parquet").count()
    assert all(r["score"] is None or 0 <= r["score"] <= 1 for r in rows if "score" in r and not name.startswith("op9"))


@pytest.mark.parametrize("name", sorted(Q.QUERIES))
def test_no_rows(spark, empty_folder, name):
    assert Q.QUERIES[name](spark, empty_folder).collect() == []


def test_pipeline_of_odd_rows(spark, folder, empty_folder):
    assert corpus_pipeline.run(spark, empty_folder).collect() == []
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, folder).columns == docs.columns
    assert corpus_pipeline.run(spark, folder).count() > 0


def test_odd_near_duplicates(odd):
    rows = {(r.doc_id, r.component_id, r.n_shingles) for r in jaccard_join.near_duplicates(odd).collect()}
    by = {d: (c, n) for d, c, n in rows}
    assert by[1][0] == by[2][0] == by[None][0] == 1 and by[9][0] == 8 and by[7] == (6, 1)
    assert by[3] == (3, 0) and by[4] == (4, 0) and by[5] == (5, 0)


@needs_tables
@pytest.mark.parametrize(("module", "label", "least"), [(quality_crf, "quality", 0.98), (toxicity_grammar, "toxic", 0.8)])
def test_held_out_accuracy(spark, module, label, least):
    documents, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    run = module.op1 if label == "quality" else module.op2
    found = run(spark, SF).join(labels, "doc_id").where(f"held_out and {label} is not null").select("score", "predicted", label).collect()
    right = np.mean([r.predicted == r[label] for r in found])
    assert len(found) > 30 and right >= least and documents.count() == run(spark, SF).count()


def plain_toxicity(text, weights):
    """A text's clause scores by the grammar's definition, word by word, with given insult weights."""
    X = toxicity_grammar
    classes = {w: c for c in X.WORDS for w in X.WORDS[c].split()}
    scores = []
    for clause in re.split(r"[.,;:!?\n()\"]", text.lower()):
        words = re.findall(r"[a-z\x80-\U0010ffff]+", clause)
        if not words:
            continue
        kinds = ["insult" if w in weights else classes.get(w) for w in words]
        total = 0.0
        for i, kind in enumerate(kinds):
            if kind not in ("insult", "threat"):
                continue
            aimed = "target" in kinds[:i] or "target" in kinds[i:]
            factor = X.AIMED if aimed else X.BARE if kind == "insult" else X.BARE_THREAT
            factor *= X.NEGATED if "negation" in kinds[max(0, i - X.REACH) : i] else 1
            factor *= X.QUOTED if "reported" in kinds[:i] else 1
            total += factor * (weights[words[i]] if kind == "insult" else X.LISTED_WEIGHT)
        scores.append(total)
    return np.log1p(sum(scores)), sum(x > 0 for x in scores) / max(1, len(scores))


def test_toxicity_equals_the_plain_grammar():
    rng, X = random.Random(6), toxicity_grammar
    weights = {w: X.LISTED_WEIGHT for w in X.WORDS["insult"].split()} | {"zork": 5.5}
    model = X.Model({X.word_hash("zork"): 5.5})
    pool = [w for c in X.WORDS.values() for w in c.split()] + ["zork", "the", "cat", "sat", "été"] * 8
    texts = ["", "...", "idiot", "You aren't an idiot, but I will KILL you"] + ["".join(rng.choice(pool) + rng.choice([" ", " ", " ", ", ", "\n", ". "]) for _ in range(rng.randrange(1, 60))) for _ in range(150)]
    found = model.features(pa.array(texts))
    assert np.abs(found - np.array([plain_toxicity(t, weights) for t in texts])).max() < 1e-9


def test_clauses_outrank_words():
    model = toxicity_grammar.Model({})
    score = dict(zip(texts := ["idiot", "I will kill you", "you are an idiot", "you are not an idiot", "you aren't an idiot", "not an idiot like you", "she said you are an idiot", "kill the process"], model.score(pa.array(texts)), strict=True))
    assert all((score[t] >= toxicity_grammar.THRESHOLD) == (t in ("I will kill you", "you are an idiot")) for t in texts)
    assert score["not an idiot like you"] > score["idiot"]


def plain_quality(text, model):
    """A text's score from enumerated labellings of its lines."""
    lines = (text or "").encode().split(b"\n")
    rows = []
    for line in lines:
        n, words = max(1, len(line)), re.findall(rb"[^\x20\x09-\x0D]+", bytes(c + 32 if 65 <= c <= 90 else c for c in line))
        share = [sum(c in members for c in line) / n for members in (range(65, 91), [*range(65, 91), *range(97, 123), *range(128, 256)], range(48, 58), b"#$%&*@^~+=<>{}[]\\_", b"|!", b".,;:?")]
        again = sum(a == b for a, b in zip(words, words[1:])) / max(1, len(words))
        rows.append([*share, again, 1 - len(set(words)) / max(1, len(words)) if words else 0, min(sum(map(len, words)) / max(1, len(words)) / 20, 2), not line, np.log1p(len(line)) / 8, share[0] > 0.5 * max(share[1], 1e-6), share[3] > 0.1, share[4] > 0.03])
    none = [0.0] * quality_crf.BASE
    x = np.array([[*r, *(rows[i - 1] if i else none), *(rows[i + 1] if i + 1 < len(rows) else none), i == 0, i + 1 == len(rows)] for i, r in enumerate(rows)], float)
    e = (x - model.mean) / model.scale @ model.w + model.bias
    n, m = len(rows), model.m
    p, z = np.zeros(n), 0.0
    for labels in itertools.product((0, 1), repeat=n):
        weight = np.exp(sum(e[i] * y for i, y in enumerate(labels)) + sum(m[a, b] for a, b in zip(labels, labels[1:])))
        z, p = z + weight, p + weight * np.array(labels)
    size = np.array([len(line) for line in lines]) + 1e-3
    share = np.clip((p / z * size).sum() / size.sum(), 1e-4, 1 - 1e-4)
    return 1 / (1 + np.exp(-(np.log(share / (1 - share)) / 4 * model.curve[0] + share * model.curve[1] + model.curve[2])))


def test_quality_equals_enumeration(spark, tmp_path):
    rng = random.Random(8)

    def line(good):
        return " ".join(rng.choice(["the", "House", "of", "12", "green,", "tea."] if good else ["|||", "BUY", "BUY", "##", "$$$", "9"]) for _ in range(rng.randrange(0, 9)))

    texts = [(i, "\n".join(line(i % 2 or rng.random() < 0.4) for _ in range(rng.randrange(1, 8)))) for i in range(120)] + [(500, None), (501, ""), (502, "\n\n")]
    documents = spark.createDataFrame(texts, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(120)], "doc_id long, quality int")
    model = quality_crf.fit(documents, labels, quality_crf.HELD_OUT)
    batch = pa.RecordBatch.from_arrays([pa.array([t for _, t in texts], pa.string())], ["text"])
    found = next(quality_crf._scores(model)(iter([batch]))).column(1).to_numpy()
    assert model.trained and np.abs(found - [plain_quality(t, model) for _, t in texts]).max() < 1e-4


def test_fit_is_bounded_and_whole(spark, monkeypatch):
    """One row of an id, whole texts, and no more rows or bytes than allowed."""
    from tidewater.llm import fitting

    rows = [(i, f"text {i} " + "x" * (10_000 if i == 3 else 10)) for i in range(40)] + [(1, "another text of that id")] * 5_000
    documents, labels = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(i, i % 2) for i in range(40)] * 2, "doc_id long, toxic int")
    every = lambda d: F.lit(False)
    assert len(fitting.labelled_sample(documents, labels, "toxic", every, 2).collect()) == 2
    sample = fitting.labelled_sample(documents, labels, "toxic", every, 100).collect()
    assert sorted(r.doc_id for r in sample) == list(range(40)) and all((r.doc_id, r.text) in set(rows) for r in sample)
    monkeypatch.setattr(fitting, "SAMPLE_BYTES", 2000)
    small = fitting.labelled_sample(documents, labels, "toxic", every, 100).collect()
    assert 30 < len(small) < 40 and 3 not in {r.doc_id for r in small} and {(r.doc_id, r.text) for r in small} <= set(rows)


def test_crf_marginals():
    """Forward-backward against enumeration."""
    rng = np.random.default_rng(0)
    m = rng.normal(size=(2, 2))
    first = np.array([0, 3, 4, 9])
    e = rng.normal(size=9)
    f, b = quality_crf.marginals(e, first, m)
    for a, z in zip(first[:-1], first[1:]):
        n = z - a
        weights = np.array([np.exp(sum(e[a + t] for t in range(n) if s >> t & 1) + sum(m[s >> t & 1, s >> (t + 1) & 1] for t in range(n - 1))) for s in range(1 << n)])
        for t in range(n):
            p = sum(w for s, w in enumerate(weights) if s >> t & 1) / weights.sum()
            assert abs(1 / (1 + np.exp(-(f + b)[a + t])) - p) < 1e-9


def test_targets():
    goal = source_mixing.targets([("b", 100), (None, 10), ("a", 10), ("c", 1000)])
    assert goal["a"] == 20 and abs(sum(goal.values()) - 1.5 * 1120) < 1e-6
    assert all(goal[s] <= 2 * n + 1e-9 for s, n in (("b", 100), (None, 10), ("a", 10), ("c", 1000)))
    assert source_mixing.targets([]) == {}


def test_splitting_tree():
    quota = np.array([1000, 37, 0, 5000])
    parts = source_mixing.split(quota, 13)
    assert (parts.sum(0) == quota).all() and np.ptp(parts.sum(1)) <= 1 and (parts == source_mixing.split(quota, 13)).all()


def test_mix(spark):
    rng = random.Random(1)
    rows = [(i, " ".join(["w"] * rng.randrange(0, 60)), rng.choice(["a", "b", "c", "d", None])) for i in range(3000)]
    documents = spark.createDataFrame(rows, "doc_id long, text string, source string")
    planned, _ = source_mixing.plan(documents)
    planned = planned.collect()
    taken, goal = {}, {}
    for r in planned:
        assert r.copies in (0, 1, 2)
        taken[r.source], goal[r.source] = taken.get(r.source, 0) + r.copies * r["size"], r.target
    assert all(abs(taken[s] - goal[s]) <= 60 for s in goal)
    out = source_mixing.mixed(documents).collect()
    assert len(out) == sum(r.copies for r in planned) == len({(r.doc_id, r.copy) for r in out})
    again, _ = source_mixing.plan(documents.repartition(7))
    assert sorted(tuple(r) for r in again.collect()) == sorted(tuple(r) for r in planned)


def test_dealt_rows(spark, tmp_path):
    """op4's rows and the pipeline's mix are the tree's draws."""
    rng = random.Random(2)
    rows = [(i, " ".join(["w"] * rng.randrange(1, 60)), "en", rng.choice(["a", "b", "c", None]), i) for i in range(2000)]
    documents = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    documents.write.parquet(f"{tmp_path}/documents.parquet")
    out = source_mixing.mixed(documents).orderBy("shard", "sort_key").collect()
    _, draws = source_mixing.plan(documents)
    source = {i: s for i, _, _, s, _ in rows}
    ranges = {(r.of, r.shard): (r.low, r.high) for r in draws.collect()}
    op4 = source_mixing.op4(spark, str(tmp_path)).collect()
    assert sorted((r.doc_id, c, s) for r in op4 for c, s in enumerate(r.shards)) == sorted((r.doc_id, r["copy"], r.shard) for r in out)
    for r in op4:
        assert r.copies == len(r.shards) and r.taken == r.copies * r["size"]
        assert all(low <= c * source_mixing.BINS + r.block < high for c, s in enumerate(r.shards) for low, high in [ranges[source[r.doc_id], s]])
    for partitions in ("4", "100"):
        spark.conf.set("spark.sql.shuffle.partitions", partitions)
        try:
            mix = corpus_pipeline.mixing(spark, documents, "")
            assert [r.doc_id for r in mix.collect()] == [r.doc_id for r in out]
            assert mix.rdd.getNumPartitions() == (32 if partitions == "4" else 128)
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_mix_carries_every_row(spark):
    """Rows without an id and rows that share one are mixed by what they are, up to a document of the target."""
    rng = random.Random(3)
    rows = [(rng.choice([None, i, i % 50]), f"t{i} " + " ".join(["w"] * rng.randrange(0, 59)), rng.choice(["a", "b", None])) for i in range(1500)]
    documents = spark.createDataFrame(rows, "doc_id long, text string, source string")
    out = corpus_pipeline.mixing(spark, documents, "").collect()
    planned = source_mixing.plan(documents)[0].collect()
    taken = {}
    for r in out:
        taken[r.source] = taken.get(r.source, 0) + len(r.text.split())
    assert all(abs(taken.get(r.source, 0) - r.target) <= 60 for r in planned)
    assert set(out) <= set(documents.collect())
    assert sum(r.doc_id is None for r in out) == sum(r.copies for r in planned if r.doc_id is None) > 300


def test_mix_equals_sorting(spark):
    """Which documents are taken once more, against sorting each source by place."""
    rng = random.Random(9)
    rows = [(rng.choice([i, i % 40, None]), " ".join(["w"] * rng.randrange(1, 30)), rng.choice("abc")) for i in range(900)] + [(7, "one two three", "a")] * 400 + [(None, "x y", "b")] * 300
    documents = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)
    planned = source_mixing.plan(documents)[0].collect()
    goal = source_mixing.targets([(s, sum(r["size"] for r in planned if r.source == s)) for s in "abc"])
    for s in "abc":
        own = sorted((r for r in planned if r.source == s), key=lambda r: (r.place, r["size"]))
        total = sum(r["size"] for r in own)
        whole, rest, ahead, want = int(goal[s] // total), goal[s] % total, 0, Counter()
        for r in own:
            want[r.place, r["size"], whole + (ahead + r["size"] / 2 < rest)] += 1
            ahead += r["size"]
        assert want == Counter((r.place, r["size"], r.copies) for r in own)


def test_rows_of_one_place_are_numbered(spark):
    rows = [("a", 5, 2, 10.0, i * 40_000) for i in range(30)] + [("a", 9, 3, 10.0, 7), (None, 1, 4, 5.0, 8), (None, 1, 0, 5.0, 9)]
    edge = spark.createDataFrame(rows, "source string, place long, size long, inside double, nth long")
    extra = {}
    for r in source_mixing._ranked(edge).collect():
        extra.setdefault((r.source, r["size"]), []).append(r.extra)
    assert sum(extra["a", 2]) == 5 and len(extra["a", 2]) == 30 and extra["a", 3] == [0] and extra[None, 4] == [1] and extra[None, 0] == [1]


def brute_neighbours(v, ids, i, k):
    s = (v @ v[i]) / (np.linalg.norm(v, axis=1) * np.linalg.norm(v[i]))
    return [j for j in np.lexsort((ids, -s)) if j != i][:k], s


def test_recall(spark):
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(20, 32))
    v = (centres[rng.integers(0, 20, 3000)] + 0.4 * rng.normal(size=(3000, 32))).astype(np.float32)
    frame = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<float>")
    found = {}
    for r in multiprobe_lsh.search(frame, lambda i: i % 50 == 0, 5).collect():
        found.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    hits, ids = 0, np.arange(3000)
    for q, got in found.items():
        near, s = brute_neighbours(v.astype(np.float64), ids, q, 5)
        hits += len(set(near) & {x[1] for x in got})
        assert [x[0] for x in sorted(got)] == [1, 2, 3, 4, 5] and all(abs(x[2] - s[x[1]]) < 1e-12 for x in got)
    assert len(found) == 60 and hits / 300 >= 0.9


def test_recall_of_mixed_density(spark):
    """Near copies in most rows leave the recall of the others as it is."""
    rng = np.random.default_rng(5)
    tight = np.repeat(rng.normal(size=(60, 64)), 40, axis=0) + 0.005 * rng.normal(size=(2400, 64))
    v = rng.permutation(np.concatenate([tight, rng.normal(size=(1600, 64))])).astype(np.float32).astype(np.float64)
    frame = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<float>")
    found = {}
    for r in multiprobe_lsh.search(frame, lambda i: i % 40 == 0, 5).collect():
        found.setdefault(r.query_id, set()).add(r.vec_id)
    recall = {True: [], False: []}
    for q in range(0, 4000, 40):
        near, s = brute_neighbours(v, np.arange(4000), q, 5)
        recall[bool(s[near[-1]] > 0.9)].append(len(set(near) & found.get(q, set())) / 5)
    assert all(len(x) > 20 and np.mean(x) >= 0.9 for x in recall.values())


def test_repeated_ids_leave_room_for_others(spark):
    rows = [(0, [1.0, 0.0])] + [(1, [1.0, 0.01])] * 9 + [(i, [1.0, 0.1 * i]) for i in range(2, 9)]
    found = multiprobe_lsh.search(spark.createDataFrame(rows, "vec_id long, embedding array<float>").coalesce(1), lambda i: i == 0, 3).collect()
    assert sorted((r["rank"], r.vec_id) for r in found) == [(1, 1), (2, 2), (3, 3)]


def test_odd_vectors(spark, folder):
    rows = [tuple(r) for r in multiprobe_lsh.op9(spark, folder).orderBy("query_id", "rank").collect()]
    first = [(r[0], r[1], r[2]) for r in rows if r[0] == 0]
    assert first == [(0, 1, 6), (0, 2, 7), (0, 3, 50), (0, 4, 1)] and {r[0] for r in rows} == {0, 50}


@pytest.mark.parametrize("n", [1, 2, 3, 4])
def test_all_of_few_candidates(spark, n):
    rows = [(0, [1.0, 0.0])] + [(i, [-1.0, 0.1 * i]) for i in range(1, n + 1)]
    found = multiprobe_lsh.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), lambda i: i == 0, 5).collect()
    assert sorted((r["rank"], r.vec_id) for r in found) == [(k, n + 1 - k) for k in range(1, n + 1)]


def test_a_query_far_from_all(spark):
    rng = np.random.default_rng(7)
    v = rng.normal(size=(300, 16)) * 0.05 + 1
    rows = [(0, (-np.ones(16)).tolist())] + [(i + 1, x.tolist()) for i, x in enumerate(v)]
    found = multiprobe_lsh.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), lambda i: i == 0, 5).collect()
    near, _ = brute_neighbours(np.array([r[1] for r in rows]), np.arange(301), 0, 5)
    assert [r.vec_id for r in sorted(found, key=lambda r: r["rank"])] == near


def test_dimensions_apart_and_shuffled_probes(spark, monkeypatch):
    rng = np.random.default_rng(8)
    rows = [(i, rng.normal(size=4 + i % 2).tolist()) for i in range(400)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    one = sorted(tuple(r) for r in multiprobe_lsh.search(frame, lambda i: i % 20 < 2, 5).collect())
    monkeypatch.setattr(multiprobe_lsh, "BROADCAST_BYTES", -1)
    assert one == sorted(tuple(r) for r in multiprobe_lsh.search(frame, lambda i: i % 20 < 2, 5).collect())
    assert len(one) == 200 and all(r[0] % 2 == r[2] % 2 for r in one)


@needs_tables
def test_recall_of_the_table(spark):
    table = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    table = [(i, x) for i, x in table if x and None not in x and np.isfinite(x).all() and np.any(x)]
    ids, v = np.array([i for i, _ in table]), np.array([x for _, x in table], float)
    found, hits, asked = {}, 0, np.flatnonzero(ids % 5 == 0)
    for r in multiprobe_lsh.search(spark.read.parquet(f"{SF}/embeddings.parquet"), lambda i: i % 5 == 0, 5).collect():
        found.setdefault(r.query_id, set()).add(r.vec_id)
    for i in asked:
        near, _ = brute_neighbours(v, ids, i, 5)
        hits += len({int(ids[j]) for j in near} & found[int(ids[i])])
    assert hits / (5 * len(asked)) >= 0.9


def archive(n=6):
    return [W.member(W.record(i, f"http://x/{i}", f"<p>page {i}</p>".encode() * 20, None)) for i in range(n)]


def test_salvage_whole():
    out = list(W.salvage(b"".join(archive())))
    assert [x["page_id"] for k, x in out if k == "record"] == list(range(6)) and all(k == "record" for k, _ in out)
    plain = b"".join(W.record(i, None, b"x" * i, None) for i in range(5))
    assert [x["bytes"] for _, x in W.salvage(plain)] == list(range(5))


@pytest.mark.parametrize("damage", ["flip", "cut", "junk", "torn", "head"])
def test_salvage_damaged(damage):
    parts = archive()
    at = len(parts[0]) + len(parts[1])
    if damage == "flip":
        parts[2] = parts[2][:60] + bytes([parts[2][60] ^ 0xFF]) + parts[2][61:]
    elif damage == "cut":
        parts[2] = parts[2][:-20]
    elif damage == "junk":
        parts[2] = W.MAGIC + b"not a member" + os.urandom(50)
    elif damage == "torn":
        parts = [*parts[:5], parts[5][: len(parts[5]) // 2]]
    else:
        parts = [b"\0" * 100, *parts]
    out = list(W.salvage(b"".join(parts)))
    lost = {"flip": {2}, "cut": {2}, "junk": {2}, "torn": {5}, "head": set()}[damage]
    assert [x["page_id"] for k, x in out if k == "record"] == [i for i in range(6) if i not in lost]
    gaps = [x for k, x in out if k == "gap"]
    assert len(gaps) == 1 and (damage in ("torn", "head") or gaps[0][0] == at)
    assert list(W.salvage(b"")) == [] and list(W.salvage(b"\x1f\x8b\x08")) == [("gap", (0, 3))]


def test_salvage_of_quoted_and_inner_records():
    """A version line inside a page is no record, and a member's records survive one bad among them."""
    good, quoted = W.record(1, "http://x", b"y" * 300, None), W.record(77, "http://q", b"z" * 10, None)
    bad = W.record(5, "http://o", b"says: " + quoted + b" so", None).replace(b"says", b"sayz")
    assert [(k, x if k == "gap" else x["page_id"]) for k, x in W.salvage(good + bad + good)] == [("record", 1), ("gap", (len(good), len(good + bad))), ("record", 1)]
    several = W.member(good + good.replace(b"yyy", b"yzy", 1) + good)
    assert [k for k, _ in W.salvage(several)] == ["gap", "record", "record"]
    torn = W.member(b"".join(W.record(i, "u", os.urandom(20_000), None) for i in range(4)))
    out = list(W.salvage(torn[: len(torn) * 3 // 5]))
    assert [x["page_id"] for k, x in out if k == "record"] == [0, 1] and sum(k == "gap" for k, _ in out) == 1


def test_digests_of_other_kinds():
    import base64

    good = W.record(1, "http://x", b"y" * 300, None)
    old = re.search(rb"sha256:[0-9a-f]+", good)[0]
    sha1 = b"sha1:" + base64.b32encode(hashlib.sha1(b"y" * 300).digest())
    for value, kept in ((sha1, True), (b"sha1:" + b"A" * 32, False), (b"blake3:00", True), (old[:-1] + b"x", False)):
        assert [k for k, _ in W.salvage(good.replace(old, value))] == ["record" if kept else "gap"]
    bare = W.record(1, "http://x", b"", None).replace(b"Content-Length: 0\r\n\r\n", b"X-Length: none\r\n\r\n")
    length = int(re.search(rb"msgtype=response\r\nContent-Length: (\d+)", bare)[1])
    bare = bare.replace(b"Content-Length: %d" % length, b"Content-Length: %d" % (bare.index(b"\r\n\r\n\r\n\r\n") + 4 - bare.index(b"HTTP/1.1")))
    assert [k for k, _ in W.salvage(bare)] == ["record"]


def test_salvage_is_linear():
    import time

    for junk in (W.MAGIC * 100_000, (W.MAGIC + b"\x08" + b"n" * 9) * 20_000, b"\nWARC/1.1\r\n" * 50_000):
        began = time.perf_counter()
        assert [k for k, _ in W.salvage(junk)] == ["gap"]
        assert time.perf_counter() - began < 10


def test_long_pages(spark, tmp_path):
    rows = [(i, f"http://example.com/{'a/' * 20_000}", "<p>" + f"{i % 2}" * 3_000_000) for i in range(4)]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    assert sorted((r.page_id, r.payload_bytes, r.record_type, r.refers_to) for r in W.op7(spark, str(tmp_path)).collect()) == [(0, 3_000_003, "response", None), (1, 3_000_003, "response", None), (2, 3_000_003, "revisit", 0), (3, 3_000_003, "revisit", 1)]
    assert {(len(r.path), r.verdict) for r in url_rules.op8(spark, str(tmp_path)).collect()} == {(40_001, "allow")}


@pytest.mark.parametrize("salted", [False, True])
def test_warc_rows_equal_sql(spark, folder, salted, monkeypatch):
    import duckdb

    if salted:
        monkeypatch.setattr("tidewater.llm.tables.BROADCAST_ROWS", 0)
    con = duckdb.connect()
    con.execute(f"create view pages as select page_id, html from read_parquet('{folder}/pages.parquet/*.parquet')")
    got = W.op7(spark, folder)
    assert sorted(map(repr, (tuple(r) for r in got.collect()))) == sorted(map(repr, con.sql(W.ORACLE).fetchall())) and got.columns == con.sql(W.ORACLE).columns


def test_bad_digest_is_a_gap():
    good = W.record(1, "http://x", b"y" * 300, None)
    out = list(W.salvage(W.member(good.replace(b"yyy", b"yzy", 1)) + W.member(good)))
    assert [k for k, _ in out] == ["gap", "record"]


def test_warc_rows(spark, folder):
    page = "<p>" + "x" * 200 + "</p>"
    rows = sorted((tuple(r) for r in W.op7(spark, folder).collect()), key=repr)
    big, digest = len(page), hashlib.sha256(page.encode()).hexdigest()
    assert rows.count((2, big, digest, "revisit", 1)) == 2 and (1, big, digest, "response", None) in rows and (None, big, digest, "revisit", 1) in rows
    assert (3, 0, hashlib.sha256(b"").hexdigest(), "response", None) in rows and sum(r[3] == "response" and r[1] == 5 for r in rows) == 2


def test_url_rules(spark, folder):
    import duckdb

    got = sorted((tuple(r) for r in url_rules.op8(spark, folder).collect()), key=repr)
    con = duckdb.connect()
    con.execute(f"create view pages as select page_id, url from read_parquet('{folder}/pages.parquet/*.parquet')")
    assert got == sorted(con.sql(url_rules.ORACLE).fetchall(), key=repr)
    assert (1, "a.example.com", "/en/x", "example.com/en/", "block") in got and (5, "www.example.com:80", "/en/", None, "allow") in got


@needs_tables
def test_pipeline(spark):
    """Each stage's rows against its operator's decisions, one after the other."""
    small = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    docs = small
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, "/root/testdata/sf0.001")
        before, after = [r.doc_id for r in docs.select("doc_id").collect()], [r.doc_id for r in out.select("doc_id").collect()]
        assert set(after) <= set(before)
        if name == "near_duplicates":
            labels = jaccard_join.near_duplicates(docs).collect()
            assert sorted(after) == sorted({r.component_id for r in labels})
        if name == "mixing":
            copies = {r.doc_id: r.copies for r in source_mixing.plan(docs)[0].collect()}
            assert sorted(after) == sorted(d for d, n in copies.items() for _ in range(n))
        docs = spark.createDataFrame(out.collect(), small.schema)
    whole = corpus_pipeline.run(spark, "/root/testdata/sf0.001").collect()
    assert sorted(r.doc_id for r in whole) == sorted(r.doc_id for r in docs.collect()) and all(r.round_trip for r in whole)


def test_direct_calls(odd, no_rows):
    for run in (license_rules.scan, media_columns.text_images, suffix_pieces.encoded_digests):
        assert run(odd).count() == odd.count() and run(no_rows).count() == 0


def test_documents_without_an_id_link_others(spark):
    words = [f"w{i}" for i in range(60)]
    left, middle, right = words[:56], words, words[4:]
    texts = [(1, " ".join(left)), (None, " ".join(middle)), (None, " ".join(middle)), (3, " ".join(right)), (None, "quite alone here"), (3, "another text of that id")]
    rows = jaccard_join.near_duplicates(spark.createDataFrame(texts, "doc_id long, text string")).collect()
    assert sorted(((r.doc_id, r.component_id, r.n_shingles) for r in rows), key=repr) == sorted([(1, 1, 52), (None, 1, 56), (None, 1, 56), (3, 1, 52), (None, None, 1), (3, 3, 1)], key=repr)


def test_near_duplicates_without_an_id(spark, folder):
    """One row of each component stays, with or without an id, and the pipeline keeps rows without one."""
    words = [f"w{i}" for i in range(60)]
    named, alone, other = " ".join(words), " ".join(words[::-1]), "of another kind altogether"
    rows = [(4, named), (2, named + " end"), (None, named), (None, named + " end"), (None, alone), (None, alone), (None, alone + " end"), (3, other), (3, named), (None, ""), (None, None), (None, None)]
    docs = spark.createDataFrame([(i, t, "en", "a", 1) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    kept = corpus_pipeline.near_duplicates(spark, docs, folder)
    got = [(r.doc_id, r.text) for r in kept.collect()]
    assert sorted(x for x in got if x[0]) == [(2, named + " end"), (3, other)]
    assert sum(t in (alone, alone + " end") for _, t in got) == 1 and sum(i is None and not t for i, t in got) == 3 and len(got) == 6
    unnamed = spark.createDataFrame(corpus_pipeline.near_duplicates(spark, docs.where("doc_id is null"), folder).collect(), docs.schema)
    assert unnamed.count() == 5
    copies = sum(r.copies for r in source_mixing.plan(unnamed)[0].collect())
    assert corpus_pipeline.mixing(spark, unnamed, folder).where("doc_id is null").count() == copies > 0


def kept_by_brute_force(rows):
    """Of each component of (doc_id, text) rows the least by id (null last) and text hash, wordless ones all."""
    sets = [shingle_set(t) for _, t in rows]
    label = list(range(len(rows)))

    def find(i):
        while label[i] != i:
            i = label[i]
        return i

    for i, j in itertools.combinations(range(len(rows)), 2):
        if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
            a, b = find(i), find(j)
            label[max(a, b)] = min(a, b)
    members = {}
    for i, s in enumerate(sets):
        if s:
            members.setdefault(find(i), []).append(rows[i])
    return members.values(), Counter(r for r, s in zip(rows, sets, strict=True) if not s)


def shingle_set(text):
    words = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} if len(words) >= 5 else {tuple(words)} if words else set()


def test_near_duplicates_keep_one_of_each_component(spark, folder):
    """Null, repeated and clashing ids: no text of its own is lost, and no copy stays."""
    rng = random.Random(11)
    families = [[f"f{k}w{i}" for i in range(40)] for k in range(14)]
    rows = []
    for _ in range(160):
        words = list(rng.choice(families))
        if rng.random() < 0.5:
            words[rng.choice([0, 39])] = rng.choice(["x", "y"])
        rows.append((rng.choice([None, 5, 5, *range(8)]), " ".join(words)))
    rows += [(5, "a clean text"), (5, "quite another text"), (3, " ".join(families[0])), (5, ""), (5, ""), (None, None), (6, "  ")] + [(2, "a row that is there"), (2, "a row that is there")]
    docs = spark.createDataFrame([(i, t, rng.choice("abc"), "s", 1) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").repartition(5)
    kept = corpus_pipeline.near_duplicates(spark, docs, folder).collect()
    components, wordless = kept_by_brute_force(rows)
    got = Counter((r.doc_id, r.text) for r in kept)
    for members in components:
        own = [x for x in got.elements() if x in members]
        least = min((i is None, i or 0) for i, _ in members)
        assert len(own) == 1 and (own[0][0] is None, own[0][0] or 0) == least
    assert sum(got.values()) == len(components) + sum(wordless.values()) and all(got[r] == n for r, n in wordless.items())
    assert sorted(map(repr, kept)) == sorted(map(repr, corpus_pipeline.near_duplicates(spark, docs.repartition(2), folder).collect()))


def test_mixing_loses_no_row(spark, folder):
    """Every null-id row that the plan takes is there, as often as it is taken."""
    docs = spark.createDataFrame([(None, "one two three", "en", "a", 3), (None, "four five", "en", "a", 2), (1, "six", "en", "b", 1), (1, "seven eight", "en", "b", 2)], "doc_id long, text string, lang string, source string, n_chars long")
    planned = source_mixing.plan(docs)[0].collect()
    taken = Counter()
    for r in planned:
        taken[r.doc_id, r["size"]] += r.copies
    out = Counter((r.doc_id, len(r.text.split())) for r in corpus_pipeline.mixing(spark, docs, folder).collect())
    assert out == +taken and out[None, 3] >= 1


def test_urls_without_a_scheme_are_dealt(spark):
    """They join nothing, and equal keys of page ids can't meet a rule."""
    rows = [(i, "no scheme") for i in range(50)] + [(100, None), (None, ""), (101, "http://example.com/en/"), (102, "http:///en/"), (103, "x://")]
    got = {r.page_id: (r.host, r.path, r.rule) for r in url_rules.judge(spark.createDataFrame(rows, "page_id long, url string")).collect()}
    assert got.pop(101) == ("example.com", "/en/", "example.com/en/") and got.pop(102) == ("", "/en/", None)
    assert set(got.values()) == {("", "", None)} and len(got) == 53


def test_the_pipeline_keeps_what_it_needs_only(spark, folder):
    from tidewater.llm import tables

    out = corpus_pipeline.run(spark, folder)
    assert [p.rsplit("/", 1)[-1].rsplit("-", 1)[0] for p in tables._written.paths[-1:]] == ["stage-mixing"] and out.count() > 0
    assert all(len(r.ids) == r.n_pieces for r in out.collect())


def test_tasks_hold_bounded_bytes_of_long_texts(spark, tmp_path):
    """Batches for Python workers, rows decoded at once and row groups, whatever the length of texts."""
    import pyarrow.parquet as pq

    letters = np.random.default_rng(5).integers(97, 123, 1 << 18, dtype=np.uint8).tobytes().decode()
    long = spark.range(200).select(F.col("id").alias("doc_id"), F.concat(F.lit(letters), F.col("id").cast("string")).alias("text")).coalesce(1)

    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows]), pa.array([batch.nbytes])], ["n", "size"])

    got = long.mapInArrow(sizes, "n long, size long").collect()
    assert sum(r.n for r in got) == 200 and max(r["size"] for r in got) < 12 << 20
    long.write.parquet(str(tmp_path / "long"))
    files = [pq.ParquetFile(p).metadata for p in (tmp_path / "long").glob("*.parquet")]
    assert sum(f.num_rows for f in files) == 200 and sum(f.num_row_groups for f in files) > 1
    assert int(spark.conf.get("spark.sql.parquet.columnarReaderBatchSize")) <= 512


def test_a_users_batch_sizes_stay(spark):
    from tidewater.llm import tables

    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name)
    try:
        spark.conf.set(name, str(3 << 20))
        tables.importable(spark)
        assert spark.conf.get(name) == str(3 << 20)
    finally:
        spark.conf.set(name, before)


def test_large_row_groups_are_read_by_few_tasks(spark, tmp_path, monkeypatch):
    """As many as fit the heap at once; rows stay, and tables in small row groups keep their tasks."""
    from tidewater.llm import tables

    rng = np.random.default_rng(1)
    texts = [rng.bytes(500).hex() for _ in range(4000)]
    table = pa.table({"doc_id": list(range(4000)), "text": texts})
    for name, rows in (("large", 1000), ("small", 10)):
        pq.write_table(table, tmp_path / f"{name}.parquet", row_group_size=rows, use_dictionary=False)
    monkeypatch.setattr(tables, "READ_SHARE", 2_500_000 / spark._jvm.Runtime.getRuntime().maxMemory(), raising=False)
    size = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "500000")
        found = {name: tables.read(spark, str(tmp_path), name) for name in ("large", "small")}
        assert found["large"].rdd.getNumPartitions() == 2  # of 1 MB each in 2.5 MB
        assert found["small"].rdd.getNumPartitions() >= 4
        for df in found.values():
            assert sorted(map(tuple, df.collect())) == list(zip(range(4000), texts, strict=True))
        for df in (spark.range(3), found["small"].union(found["small"])):  # no table, more than one
            assert tables.bounded(df) is df
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)


def test_frequent_elements_are_counted_across_batches():
    text = " ".join(f"word{i}" for i in range(300))
    rows = [pa.RecordBatch.from_arrays([pa.array([i]), pa.array([f"{text} own{i} end{i}"]), pa.array([i])], ["doc_id", "text", "handle"]) for i in range(40)]
    out = pa.Table.from_batches(list(jaccard_join._nodes(iter(rows))))
    assert sum(x is None for x in out["holders"].to_pylist()) == 40
    assert max(x or 0 for x in out["holders"].to_pylist()) == 40


def test_copies_give_their_elements_once():
    """Also those of different batches of a task."""
    batch = pa.RecordBatch.from_arrays([pa.array([" ".join(f"word{i}" for i in range(300))])], ["text"])
    none = type("Broadcast", (), {"value": np.zeros(0, np.uint64)})
    once = list(jaccard_join._packed(4, none)(iter([batch])))
    assert len(once) == 1 and list(jaccard_join._packed(4, none)(iter([batch] * 3))) == once


def test_the_drivers_rows_start_no_workers(spark, folder):
    """Pickled rows would run through Python workers of their own beside those of the operators."""
    from tidewater.llm import tables

    sizes = tables.stored(source_mixing.sized(tables.read(spark, folder, "documents")), "sizes")
    for frame in source_mixing._dealt(sizes, 4, 1):
        assert "ExistingRDD" not in frame._jdf.queryExecution().executedPlan().toString() and frame.count() > 0
