"""The near-copy stage of the pipeline: the links of op7 and those by similarity, and what its components cost the driver."""

import random

import pytest
import xxhash

import corpus_pipeline
from kvloom.llm import components as graphs
from kvloom.llm import similar


def shingles(text, k):
    words = (text or "").encode().lower().split()
    k = min(k, len(words))
    return [b" ".join(words[i : i + k]) for i in range(len(words) - k + 1)] if k else []


def fingerprint(text):
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles(text, 3)]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def roots(n, pairs):
    up = list(range(n))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in pairs:
        x, y = sorted((find(a), find(b)))
        up[y] = x
    return [find(x) for x in range(n)]


def test_stage_links_fingerprints_and_similar_sets(spark):
    """Texts of a phrase said twenty times share a fingerprint, whatever else they hold once; their sets of shingles are far apart."""
    rng = random.Random(8)
    words = lambda n: [f"w{rng.randrange(9000)}" for _ in range(n)]
    texts = [" ".join(words(50)) for _ in range(8)]
    for _ in range(4):
        phrase = words(61) * 20
        for _ in range(3):
            texts.append(" ".join([*phrase, *words(60)]))
        near = [*phrase, *texts[-1].split()[len(phrase) :]]  # by similarity of the last only
        near[-30] = "neu"
        texts.append(" ".join(near))
    texts += [None, "", texts[0], texts[1].upper(), "kurz"]
    sets, prints = [frozenset(shingles(t, 5)) for t in texts], [fingerprint(t) for t in texts]
    pairs = [(b, a) for a in range(len(texts)) for b in range(a)]
    alike = [(b, a) for b, a in pairs if sets[a] == sets[b] or len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    close = [(b, a) for b, a in pairs if (prints[a] ^ prints[b]).bit_count() <= 3]
    want = roots(len(texts), alike + close)
    assert len(set(want)) < len(set(roots(len(texts), alike)))
    df = spark.createDataFrame([(i, t, "en", "s", None) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    kept = corpus_pipeline.drop_near_copies(spark, df, "")
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(want))
    got = {r.doc_id: r.component_id for r in similar.near_copies(df, max_distance=3, block=2).collect()}
    assert got == dict(enumerate(want))


@pytest.mark.parametrize("one_task", [1 << 20, 0])
def test_components_of_random_graphs(spark, monkeypatch, one_task):
    monkeypatch.setattr(graphs, "ONE_TASK", one_task)
    rng = random.Random(2)
    edges = [(rng.randrange(400), rng.randrange(400)) for _ in range(260)] + [(i, i + 1) for i in range(400, 460)] + [(480, i) for i in range(460, 500)]
    want = roots(500, edges)
    nodes = {x for a, b in edges if a != b for x in (a, b)}
    got = [(r.node, r.component) for r in graphs.components(spark.createDataFrame(edges, "a long, b long").repartition(3)).collect()]
    assert sorted(got) == sorted((x, want[x]) for x in nodes)


def test_components_cost_the_driver_few_jobs(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(300)], "a long, b long")
    spark.sparkContext.setJobGroup("components", "")
    try:
        assert graphs.components(edges).count() == 301
    finally:
        spark.sparkContext._jsc.clearJobGroup()
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup("components")) <= 8
