"""Operators on awkward rows, against brute force, round trips or held-out accuracy."""

import hashlib
import math
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from kvloom.llm import decontaminate, language, mixing, nearest, oracles, quality, queries, shared, similar, simhash, substring, toxicity, urlfilter, warc
from kvloom.llm.components import components
from kvloom.llm.kernel import SPACES, Words

SF = "/root/testdata/sf0.001"
LAST = (1 << 63) - 1


def joined(pairs):
    """Union-find over (a, b): a name for each node."""
    up = {}

    def find(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in pairs:
        up[find(a)] = find(b)
    return find


def test_words_are_bytes_split():
    texts = ["a b  c", None, "", "héllo\x85x y\n\tz " + "q" * 200, "x" * 64 + " " + "x" * 65, " c"]
    w = Words(pa.array(texts), SPACES)
    got = [[bytes(w.data[a:b]) for a, b in zip(w.start[x:y], w.end[x:y], strict=True)] for x, y in zip(w.first[:-1], w.first[1:], strict=True)]
    assert got == [(t or "").encode().split() for t in texts]
    flat = [x for r in got for x in r]
    assert len(set(zip(flat, w.hashes().tolist(), strict=True))) == len(set(flat)) == len(set(w.hashes().tolist()))


def test_components(spark):
    edges = [(1, 2), (2, 3), (10, 11), (5, 5), (20, 3), (30, 31), (31, 32), (32, 33), (33, 34), (2, 1)]
    find = joined(edges)
    got = {(r.node, r.component) for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    least = defaultdict(lambda: LAST)
    nodes = {x for e in edges if e[0] != e[1] for x in e}
    for n in nodes:
        least[find(n)] = min(least[find(n)], n)
    assert got == {(n, least[find(n)]) for n in nodes}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize("hot_rows", [0, 3, 1 << 16])
def test_joins_of_hot_keys(spark, monkeypatch, hot_rows):
    monkeypatch.setattr(shared, "HOT_ROWS", hot_rows)
    monkeypatch.setattr(shared, "HOT_SHARE", 10)
    rows = [(k, i) for i, k in enumerate([1] * 30 + [2] * 9 + [3, 4, None, 5])]
    left = spark.createDataFrame(rows, "k long, i long")
    right = spark.createDataFrame([(1, "a", 30), (2, "b", 9), (3, "c", 1), (9, "d", 0)], "k long, v string, n long")
    got = shared.joined_by(left, right, "k", "n", len(rows))
    assert got.columns == ["k", "i", "v"]
    names = {1: "a", 2: "b", 3: "c"}
    assert sorted(map(tuple, got.collect())) == sorted((k, i, names[k]) for k, i in rows if k in names)


def test_decoding_restores_obfuscated_words():
    words = {"idiot": 5.0, "stupid": 5.0, "worthless": 5.0}
    model = toxicity.Model(words, -2.0, toxicity.log_model(np.zeros(toxicity.LETTERS**3), list(words)))
    scorer = toxicity.Scorer(model)
    for hidden, word in [("1d10t", "idiot"), ("i d i o t", "idiot"), ("i.d.i.o.t", "idiot"), ("stuuuupid", "stupid"), ("5tup1d", "stupid"), ("w0rthl3ss", "worthless"), ("idi0t!", "idiot")]:
        assert scorer.hidden(f"you {hidden}") == {word}, hidden
        assert scorer(pa.array([f"you {hidden}"]))[0] > 0.9
    assert scorer.restore("you 1D10T") == "you idiot"
    assert scorer(pa.array(["a clean text", None, ""])).max() < 0.2


@pytest.mark.parametrize(
    "hidden, word",
    [(x, "idiot") for x in ("idio+", "iiddiioott", "i   d   i   o   t", "id io t", "i/d/i/o/t", "i,d,i,o,t", "i\nd\ni\no\nt", "i+d+i+o+t", "1d!ot", "i / d / 1 / 0 / t", "id\u200biot")]
    + [(x, "stupid") for x in ("ssttuuppiidd", "stu pid", "s t u\np i d", "$tupid")]
    + [(x, "stupid") for x in ("st.u.pid", "sstupidd", "\uff53\uff54\uff55\uff50\uff49\uff44", "\u24e2\u24e3\u24e4\u24df\u24d8\u24d3", "s\u0301tu\u0301pid", "s\nt\nu\np\ni\nd", "\U0001d42c\U0001d42d\U0001d42epid")]
    + [("m\u03bfr\u03bfn", "moron"), ("m\u014dr\u0151n", "moron")]
    + [(x, "moron") for x in ("mo ron", "mo.ron", "m o\tr o n", "m0 r0n")],
)
def test_decoding_restores_every_form(hidden, word):
    words = {"idiot": 5.0, "stupid": 5.0, "moron": 5.0}
    scorer = toxicity.Scorer(toxicity.Model(words, -2.0, toxicity.log_model(np.zeros(toxicity.LETTERS**3), list(words))))
    assert scorer.hidden(f"you {hidden} now") == {word}
    assert scorer(pa.array([f"you {hidden} now"]))[0] > 0.9
    assert not scorer.hidden("a letter to all good people (see 12/3), more on that! did i, or to")


def best_reading(logs, span, apart, symbols):
    """The best (score, reading) over all ways to write a span, each scored by itself; None if two readings tie."""
    ways = [(0.0, (0, 0, ""), "")]
    for i, ch in enumerate(span):
        choices = [(x, toxicity.SYMBOL_COST) for x in toxicity.STANDS_FOR.get(ch, "")] + [(ch, 0.0)] * ch.isalpha()
        letters_only = symbols == "letters" and ch in toxicity.STANDS_FOR
        if not ch.isalnum() and (apart or not ch.isspace()) and (symbols == "nothing" or ch not in toxicity.STANDS_FOR or ch == "*") and not letters_only:
            choices.append(("", toxicity.DROP_COST))
        if not ch.isalpha() and not letters_only:
            inner = 0 < i < len(span) - 1 and span[i - 1].isalnum() and span[i + 1].isalnum()
            choices.append((" ", toxicity.INNER_COST if inner or ch.isdigit() else toxicity.EDGE_COST))
        more = []
        for score, (a, b, last), text in ways:
            for out, cost in choices:
                if out:
                    d = toxicity.code(out)
                    more.append((score + cost + logs[a][b][d], (b, d, out), text + out))
                if out == "" or out == last:
                    more.append((score + cost + (toxicity.REPEAT_COST if out else 0), (a, b, last), text))
        ways = more
    ends = sorted(((s + logs[a][b][0], text) for s, (a, b, _), text in ways), reverse=True)
    return ends[0][1] if all(t == ends[0][1] for s, t in ends if s > ends[0][0] - 1e-9) else None


def test_viterbi_finds_the_best_of_all_readings():
    rng = np.random.default_rng(8)
    logs = toxicity.log_model(rng.integers(0, 50, toxicity.LETTERS**3).astype(float), ["idiot", "stupid", "scum"])
    decoder, tried = toxicity.Decoder(logs), 0
    spans = ["1d!ot", "ssc*m", "s c u", "id-io", "$tu p", "a@@1", "((x", "öß 1", "ii ii"] + ["".join(rng.choice(list("ist1!$* -.a@ö"), 5)) for _ in range(60)]
    for span in spans:
        for apart in (False, True):
            for symbols in ("", "letters", "nothing"):
                want = best_reading(logs.tolist(), span, apart, symbols)
                if want is not None:
                    tried += 1
                    assert decoder.decode(span, apart, symbols) == want, (span, apart, symbols)
    assert tried > 200


def test_words_of_one_class_and_across_texts():
    """Words whose letters are all of one class may lie anywhere in a run; nothing is read across two texts."""
    words = {"ill": 5.0, "idiot": 5.0}
    scorer = toxicity.Scorer(toxicity.Model(words, -2.0, toxicity.log_model(np.zeros(toxicity.LETTERS**3), list(words))))
    texts = ["a 1ll e", "idi", "ot", "id\nio t", "", "x 1d1ot"]
    assert scorer.hidden_in(texts) == [scorer.hidden(t) for t in texts]
    assert scorer.hidden_in(texts)[0] == {"ill"} and scorer.hidden_in(texts)[1:] == [set(), set(), {"idiot"}, set(), {"idiot"}]


def test_toxicity_rows_and_accuracy(spark, docs, no_docs):
    model = toxicity.Model({"idiot": 5.0}, -2.0, toxicity.log_model(np.zeros(toxicity.LETTERS**3), ["idiot"]))
    got = toxicity.score(docs, model).collect()
    assert Counter(r.doc_id for r in got) == Counter(r.doc_id for r in docs.collect())
    assert {r.doc_id for r in got if r.predicted} == {14}
    kept = toxicity.rejected_out(docs, model)
    assert kept.columns == docs.columns and kept.count() == docs.count() - 1
    assert toxicity.score(no_docs, model).count() == 0
    empty = toxicity.train(no_docs, spark.createDataFrame([], "doc_id long, toxic int"))
    assert not empty.words and toxicity.score(docs, empty).where("predicted = 1").count() == 0
    d = "/root/testdata/sf0.01"
    r = queries.op1_toxicity(spark, d).join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id").where("held_out").toPandas()
    assert ((r.score >= 0.7) == (r.predicted == 1)).all() and r.score.between(0, 1).all()
    assert r[r.toxic == 1].predicted.mean() > 0.6 and r[r.toxic == 0].predicted.mean() < 0.02


def test_mixing(spark, docs, no_docs, texts):
    got = mixing.mix(docs)
    rows = sorted(map(repr, got.collect()))
    assert rows == sorted(map(repr, mixing.mix(docs.repartition(2)).collect()))
    size = sorted(len((t or "").encode().split()) for _, t in texts)
    assert sorted(r["size"] for r in got.collect()) == size
    assert all(0 <= r.taken <= 2 * r["size"] for r in got.collect())
    # a, b, é, null weigh 5, 2, 1, 5; water-filling by hand
    total = Counter()
    for (_, t), s in zip(texts, ["a", "b", None, "a", "a", "é"] * 3, strict=True):
        total[s] += len((t or "").encode().split())
    names = ["a", "b", "é", None]
    weight, cap, full = dict(zip(names, (5, 2, 1, 5), strict=True)), {n: 2 * total[n] for n in names}, set()
    while True:
        level = (1.5 * sum(total.values()) - sum(cap[n] for n in full)) / sum(weight[n] for n in names if n not in full)
        new = {n for n in names if n not in full and level * weight[n] > cap[n]}
        if not new:
            break
        full |= new
    want = sorted({round(cap[n] if n in full else level * weight[n], 6) for n in names})
    assert sorted({round(r.target, 6) for r in got.collect()}) == want
    assert mixing.mix(no_docs).count() == 0


def taken_words(rows, targets, block, seed_order):
    """Plain Python of what a mix takes of one source that is one shard: rows (id, size) in their order, the words owed, blocks in theirs."""
    total = sum(n for _, n in rows)
    passes, rest = divmod(targets, total)
    lines, at = [], 0
    given = {}
    for b in seed_order(-(-total // block)):
        give = min(rest, block, total - b * block)
        given[b] = give
        rest -= give
    for i, n in rows:
        extra = sum(1 for w in range(at, at + n) if w % block < given.get(w // block, 0))
        lines.append((i, passes * n + extra))
        at += n
    return lines


def test_mixing_takes_what_plain_python_takes(spark):
    """The words of each document, from seeded orders that Spark's hash gives, in one shard a source."""
    rng = np.random.default_rng(4)
    table = [(i, f"s{rng.integers(0, 4)}", " ".join("w" * int(rng.integers(0, 300)))) for i in range(120)]
    df = spark.createDataFrame(table, "doc_id long, source string, text string")
    got = {r.doc_id: r for r in mixing.mix(df, seed=9).collect()}
    h = {r.doc_id: r.h for r in df.select("doc_id", F.xxhash64(F.lit(9), "doc_id", F.size(F.filter(F.split("text", " "), lambda x: x != "")).cast("long"), F.lit(0).cast("long")).alias("h")).collect()}
    for source in ("s0", "s1", "s2", "s3"):
        own = sorted(((h[i], i, len(t.split())) for i, s, t in table if s == source and t.split()))
        owed = sum(got[i].taken for _, i, _ in own)
        order = lambda n, s=source: [r.b for r in spark.range(n).select(F.col("id").alias("b"), F.xxhash64(F.lit(9), F.lit("0" + s), F.lit(0).cast("long"), "id").alias("k")).orderBy("k").collect()]
        assert [(i, got[i].taken) for _, i, _ in own] == taken_words([(i, n) for _, i, n in own], owed, 64, order)


@pytest.mark.parametrize("sizes", [{"a": [5], "b": [5], "c": [5], "d": [5]}, {"a": [100], "b": [9, 30, 900], "c": [1, 1, 1], "é": [40] * 50}, {"x": [3], "y": [200_000]}, {None: [70] * 40, "a": [1], "b": [7, 0, 0]}])
def test_mixing_takes_near_the_target_of_every_source(spark, sizes):
    rows = [(i, s, " ".join("w" * n)) for i, (s, n) in enumerate((s, n) for s, all_of in sizes.items() for n in all_of)]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string")
    for shard_words in (1 << 19, 500):
        taken, target = Counter(), {}
        source = {i: s for i, s, _ in rows}
        for r in mixing.mix(df, shard_words=shard_words).collect():
            assert 0 <= r.taken <= 2 * r["size"]
            taken[source[r.doc_id]] += r.taken
            target[source[r.doc_id]] = r.target
        assert all(abs(taken[s] - t) <= max(1.0, 0.01 * t) for s, t in target.items()), (taken, target)
        assert abs(sum(taken.values()) - 1.5 * sum(map(sum, sizes.values()))) <= len(sizes) + 1


def test_mixing_of_many_equal_rows(spark, monkeypatch):
    monkeypatch.setattr(mixing, "CHUNK", 7)
    df = spark.createDataFrame([(None, "a b c", "s")] * 100 + [(1, "x", "t")] * 3 + [(None, None, "s")] * 5, "doc_id long, text string, source string")
    for shard_words in (1 << 19, 40):
        got = mixing.mix(df, shard_words=shard_words).collect()
        assert len(got) == 108 and abs(sum(r.taken for r in got if r["size"] == 3) - 449) <= 2
        assert sorted(map(str, got)) == sorted(map(str, mixing.mix(df.repartition(5), shard_words=shard_words).collect()))


@pytest.mark.parametrize("values, seats", [([5, 3, 1], 9), ([100, 1, 1, 1, 1, 1], 3), ([0, 7, 7], 5), ([1, 1, 1], 0), ([10**9, 3, 2], 1000)])
def test_sainte_lague_by_highest_quotients(spark, values, seats):
    t = spark.createDataFrame([(0, i, v, seats) for i, v in enumerate(values)], "g int, i int, v long, n long")
    got = {r.i: r.won for r in mixing.sainte_lague(t, ["g"], "v", "n", ["i"], "won").collect()}
    want = dict.fromkeys(range(len(values)), 0)
    for _ in range(seats):
        best = min((i for i in want if values[i]), key=lambda i: (-values[i] / (2 * want[i] + 1), i))
        want[best] += 1
    assert got == want


def test_url_filter(spark):
    urls = ["http://a.example.org/es/1", "HTTP://EXAMPLE.org/en/12?x", "http://org", "http://org/", "x://b.com/fr/", "no-scheme/com/de/", None, "", "http://evil.com/de/x#f", "http://evil.com?/de/", "x://notorg/y", "http://a..org/"]
    pages = spark.createDataFrame([(i % 10, u, "h", "r") for i, u in enumerate(urls + urls[:1])], "page_id long, url string, host string, rule string")

    def one(url):
        rest = url.split("://", 1)[1] if url and "://" in url else ""
        before = re.match(r"[^?#]*", rest)[0]
        host = "".join(c.lower() if c.isascii() else c for c in before.split("/")[0])
        path = before[len(host) :]
        fits = [(len(h + p), h + p, a) for h, p, a in queries.URL_RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        return (host, path, *(max(fits)[1:] if fits else (None, "allow")))

    got = urlfilter.filter_urls(pages, urlfilter.rules_frame(spark, queries.URL_RULES))
    want = sorted((i % 10, *one(u)) for i, u in enumerate(urls + urls[:1]))
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)
    assert urlfilter.filter_urls(pages, urlfilter.rules_frame(spark, [])).where("verdict = 'allow'").count() == len(urls) + 1
    assert urlfilter.filter_urls(pages.limit(0), urlfilter.rules_frame(spark, queries.URL_RULES)).count() == 0


def test_ordinal_regression(spark, docs, no_docs):
    rng = np.random.default_rng(0)
    n = 600
    grade = rng.integers(0, 4, n)
    row = np.repeat(np.arange(n), 2)
    feature = np.stack([grade, rng.integers(10, 40, n)], axis=1).ravel()
    names, w, t = quality.fit(row, feature, np.ones(2 * n), grade, 4)
    assert (np.diff(t) > 0).all()
    z = np.bincount(row, weights=w[np.searchsorted(names, feature)], minlength=n)
    expected = (1 / (1 + np.exp(-(z[:, None] - t)))).sum(axis=1)
    assert np.abs(np.rint(expected) - grade).mean() < 0.05
    none = quality.train(docs, spark.createDataFrame([], "doc_id long, grade int"), grades=3)
    assert quality.score(docs, none).count() == docs.count() and quality.score(no_docs, none).count() == 0
    d = "/root/testdata/sf0.01"
    r = queries.op4_quality_classifier(spark, d).join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id").where("held_out").toPandas()
    assert (r.selected == (r.quality == 1)).mean() > 0.95


def test_ordinal_gradient_by_finite_differences():
    rng = np.random.default_rng(6)
    for grades in (2, 3, 5):
        n, m = 40, 7
        row, at, value, grade = rng.integers(0, n, 120), rng.integers(0, m, 120), rng.normal(size=120), rng.integers(0, grades, n)
        p = rng.normal(size=m + grades - 1) * 0.5
        _, slope = quality.loss(p, row, at, value, grade, grades, 0.01)
        for k in range(len(p)):
            step = np.zeros_like(p)
            step[k] = 1e-6
            high, low = (quality.loss(p + s, row, at, value, grade, grades, 0.01)[0] for s in (step, -step))
            assert math.isclose((high - low) / 2e-6, slope[k], rel_tol=1e-4, abs_tol=1e-7)
        # The loss itself from the tails that scoring gives.
        t = quality.ordered(p, m)
        z = np.zeros(n)
        np.add.at(z, row, p[at] * value)
        tails = [[1.0, *(1 / (1 + np.exp(-(x - t)))), 0.0] for x in z]
        want = -np.mean([math.log(x[g] - x[g + 1]) for x, g in zip(tails, grade.tolist(), strict=True)]) + 0.005 * (p[:m] ** 2).sum()
        assert math.isclose(quality.loss(p, row, at, value, grade, grades, 0.01)[0], want, rel_tol=1e-9)


def test_language_scores(spark, docs, no_docs):
    ids = spark.createDataFrame([(1,), (2,), (None,), (1,)], "doc_id long")
    known, target, background = language.train(docs, ids, vocabulary=100, bits=12)
    words = Counter(w for r in docs.collect() for w in re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (r.text or "").lower()))
    assert background.words.sum() == sum(words.values()) and len(known.words) == 100
    r = {x.doc_id: x for x in language.score(docs, known, target, background).collect()}
    assert r[1].score < 0 < r[4].score and r[5].score == r[6].score == 0 and r[5].n_words == 0
    assert language.score(no_docs, *language.train(no_docs, ids)).count() == 0


def exact_scores(texts, target):
    """Scores by (id, text) from plain counts; target: ids."""
    split = [(i, re.findall(rb"[0-9a-z\x80-\xff]+", (t or "").encode().lower())) for i, t in texts]
    models = []
    for some in ([w for i, w in split if i in target], [w for _, w in split]):
        models.append((Counter(x for w in some for x in w), Counter(x for w in some for x in [None, *w][:-1] if w), Counter(x for w in some for x in zip([None, *w], w))))
    sizes = [sum(m[0].values()) for m in models]
    vocabulary, scales = len(models[1][0]), (1.0, min(1.0, sizes[0] / sizes[1]) if sizes[0] else 1.0)

    def loss(m, n, k, a, b):
        single = (k * m[0][b] + 0.5) / (k * n + 0.5 * vocabulary)
        return -math.log2((k * m[2][a, b] + 50 * single) / (k * m[1][a] + 50))

    out = []
    for i, w in split:
        bits = [sum(loss(m, n, k, a, b) for a, b in zip([None, *w], w)) / max(1, len(w)) for m, n, k in zip(models, sizes, scales, strict=True)]
        out.append((i, len(w), bits[0] - bits[1]))
    return out


@pytest.mark.parametrize("block_bytes", [1 << 24, 500])
def test_language_scores_by_exact_counts(spark, docs, no_docs, texts, block_bytes):
    ids = spark.createDataFrame([(1,), (2,), (10,), (None,), (1,)], "doc_id long")
    # More words than 2**15, each of them rare: none may be thrown together with others.
    rare = [(100 + k, " ".join(f"{'uv'[k % 2]}{k}x{j}" for j in range(1000)) + " ein ende") for k in range(40)]
    more = docs.select("doc_id", "text").unionAll(spark.createDataFrame(rare, "doc_id long, text string"))
    for target in (ids, ids.unionAll(spark.createDataFrame([(100 + k,) for k in range(0, 40, 2)], "doc_id long")), ids.where("doc_id < 0")):
        got = language.cross_entropy_difference(more, target, block_bytes=block_bytes).collect()
        want = exact_scores(texts + rare, {r[0] for r in target.collect()} - {None})
        order = lambda x: (x[0] is None, x[0] or 0, x[1], x[2])
        for g, w in zip(sorted(((r.doc_id, r.n_words, r.score) for r in got), key=order), sorted(want, key=order), strict=True):
            assert g[:2] == w[:2] and math.isclose(g[2], w[2], rel_tol=1e-9, abs_tol=1e-9)
    assert language.cross_entropy_difference(no_docs, ids).count() == 0


def test_language_query_counts_every_word(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    good = {r.doc_id for r in labels.where(~toxicity.held_out()).where("quality = 1 AND toxic = 0").collect()}
    want = {i: x for i, _, x in exact_scores([(r.doc_id, r.text) for r in docs.collect()], good)}
    got = {r.doc_id: r.score for r in queries.op5_lm_scoring(spark, SF).collect()}
    assert got.keys() == want.keys() and all(math.isclose(got[i], want[i], rel_tol=1e-9, abs_tol=1e-9) for i in want)


def test_substring_dedup(spark, docs, no_docs, texts):
    seen, want = {}, []
    for i, t in sorted(texts, key=lambda x: LAST if x[0] is None else x[0]):
        words, at = (t or "").encode().split(), LAST if i is None else i
        keep = [True] * len(words)
        for a in range(len(words) - 19):
            first = seen.setdefault(tuple(words[a : a + 20]), (at, a))
            if first != (at, a):
                keep[a : a + 20] = [False] * 20
        kept = b" ".join(w for w, k in zip(words, keep, strict=True) if k).decode()
        want.append((i, len(words), keep.count(False), kept))
    out = substring.dedup_substrings(docs)
    got = [(r.doc_id, r.n_words, r.n_removed, r.kept) for r in out.collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    by = {i: (t or "").split() for i, t in texts}
    for r in out.where("n_removed > 0").collect():
        for f in r.factors:
            if f.ref_doc < LAST and r.doc_id is not None:
                assert by[r.doc_id][f.start : f.start + f.words] == by[f.ref_doc][f.ref_start : f.ref_start + f.words]
    assert substring.dedup_substrings(no_docs).count() == 0


def test_substring_dedup_over_random_texts(spark):
    rng = np.random.default_rng(5)
    texts = [(i, " ".join(rng.choice(list("abc"), rng.integers(0, 90)) if i % 3 else rng.choice(list("ab"), 40))) for i in range(60)]
    texts += [(100 + i, texts[i][1][:70] + " " + texts[i + 1][1]) for i in range(30)]
    seen, want = {}, []
    for i, t in texts:
        words = t.split()
        gone = set()
        for a in range(len(words) - 19):
            if seen.setdefault(tuple(words[a : a + 20]), (i, a)) != (i, a):
                gone.update(range(a, a + 20))
        want.append((i, len(gone)))
    got = substring.dedup_substrings(spark.createDataFrame(texts, "doc_id long, text string").repartition(4))
    assert sorted((r.doc_id, r.n_removed) for r in got.collect()) == want


def brute_fingerprint(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    ones = [sum(xxhash.xxh64_intdigest(s, 42) >> b & 1 for s in shingles) for b in range(64)]
    return sum(1 << b for b in range(64) if 2 * ones[b] > len(shingles))


@pytest.mark.parametrize("block", [2048, 2])
def test_simhash(spark, docs, no_docs, texts, block):
    fps = [brute_fingerprint(t) for _, t in texts]
    find = joined((a, b) for a in range(len(fps)) for b in range(a) if (fps[a] ^ fps[b]).bit_count() <= 3)
    groups = defaultdict(list)
    for n, (i, _) in enumerate(texts):
        groups[find(n)].append(i)
    want = [(i, f"{fps[n]:016x}", min((x for x in groups[find(n)] if x is not None), default=None)) for n, (i, _) in enumerate(texts)]
    got = list(map(tuple, simhash.near_duplicates(docs, block=block).collect()))
    assert sorted(got, key=str) == sorted(want, key=str)
    if block == 2:
        assert simhash.near_duplicates(no_docs).count() == 0


def test_simhash_links_of_random_fingerprints(spark):
    rng = np.random.default_rng(3)
    base = rng.integers(0, 1 << 63, 40, dtype=np.uint64)
    fps = {int(b) for b in base}
    for b in base:
        for _ in range(6):
            x = int(b)
            for bit in rng.choice(64, rng.integers(1, 6), replace=False):
                x ^= 1 << int(bit)
            fps.add(x)
    fps = sorted(fps)
    find = joined((a, b) for i, a in enumerate(fps) for b in fps[:i] if (a ^ b).bit_count() <= 3)
    df = spark.createDataFrame([(x - (1 << 64) if x >> 63 else x,) for x in fps], "fp long")
    for block in (2048, 4):
        links = [(r.a & (1 << 64) - 1, r.b & (1 << 64) - 1) for r in simhash.links(df, 3, block).collect()]
        assert all((a ^ b).bit_count() <= 3 for a, b in links)
        found = joined(links)
        assert {(find(a) == find(b)) for a, b in links} <= {True}
        assert len({found(x) for x in fps}) == len({find(x) for x in fps})


def test_near_copies(spark, docs, no_docs, texts):
    def shingles(t):
        words = (t or "").encode().lower().split()
        k = min(5, len(words))
        return frozenset(tuple(words[i : i + k]) for i in range(len(words) - k + 1)) if k else frozenset()

    sets = [shingles(t) for _, t in texts]
    find = joined((a, b) for a in range(len(sets)) for b in range(a) if sets[a] == sets[b] or (sets[a] | sets[b] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])))
    kept = similar.keep_one(docs)
    assert kept.columns == docs.columns
    assert kept.count() == len({find(n) for n in range(len(sets))})
    for block in (1024, 2):
        got = similar.near_copies(docs, block=block).where("stays")
        assert got.select("doc_id", "th").distinct().count() == len({find(n) for n in range(len(sets))})
    assert similar.keep_one(no_docs).count() == 0


@pytest.mark.parametrize("block", [1024, 8])
def test_near_copies_at_the_threshold(spark, block):
    """Families of texts whose similarities lie around 0.8, so that links of forests fail where others hold."""
    rng = np.random.default_rng(11)
    texts = []
    for family in range(6):
        base = [f"w{family}x{i}" for i in range(80)]
        for _ in range(25):
            words = list(base)
            for i in rng.choice(80, rng.integers(0, 4), replace=False):
                words[i] = f"z{rng.integers(0, 50)}"
            texts.append(" ".join(words))
    sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in map(str.split, texts)]
    find = joined((a, b) for a in range(len(sets)) for b in range(a + 1) if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]))
    first: dict = {}
    for n in range(len(sets)):
        first.setdefault(find(n), n)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {r.doc_id: r.component_id for r in similar.near_copies(df, block=block).collect()}
    assert got == {n: first[find(n)] for n in range(len(sets))}


def test_warc_round_trip(spark, monkeypatch):
    monkeypatch.setattr(warc, "BLOCK_LINES", 2)
    big, other = "ä" * 80, "x" * 150
    rows = [(1, "http://b.org/x", other), (2, "https://a.b.org/y?q", big), (3, "http://b.org/x", big), (4, None, big), (5, "http://c/\t\n", "tiny"), (6, "http://c/", "tiny"), (7, "http://c/", None), (None, "", other), (8, "http://b.org/x", ""), (1, "http://b.org/x", other)]
    pages = spark.createDataFrame([(*r, "d") for r in rows], "page_id long, url string, html string, digest string").repartition(3)
    archive = warc.write_archive(pages)
    got = [(r.id, r.payload_length, r.digest, r.record_type, r.refers_to, r.payload and bytes(r.payload)) for r in warc.lookup(spark, archive, pages).collect()]
    first, want = {}, []
    for i, _, html in rows:
        raw = (html or "").encode()
        if i is not None and len(raw) >= 100:
            first[raw] = min(first.get(raw, i), i)
    for i, _, html in rows:
        raw = (html or "").encode()
        later = raw in first and (i is None or i > first[raw])
        want.append((i, len(raw), hashlib.sha256(raw).hexdigest(), "revisit" if later else "response", first[raw] if later else None, None if later else raw or None))
    blank = [tuple(x or None if n == 5 else x for n, x in enumerate(r)) for r in got]
    assert sorted(blank, key=str) == sorted(want, key=str)
    asked = spark.createDataFrame([("HTTP://B.org/x#frag",), ("http://nowhere/",)], "url string")
    assert sorted(r.id for r in warc.lookup(spark, archive, asked).collect()) == [1, 1, 3, 8]
    empty = warc.write_archive(pages.limit(0))
    assert warc.lookup(spark, empty, asked).count() == 0


def test_nearest_neighbours(spark):
    rng = np.random.default_rng(1)
    vectors = [(i, list(map(float, np.float32(rng.normal(size=8))))) for i in range(200)] + [(i, [1.0] * 8) for i in range(200, 260)]
    odd = [(300, None), (301, [0.0] * 8), (302, [math.nan] * 8), (303, [math.inf] + [1.0] * 7), (304, [None] + [1.0] * 7), (None, [1.0] * 8), (320, [1.0, 2.0]), (20, vectors[20][1])]
    table = spark.createDataFrame([(*v, 1.0) for v in vectors + odd], "vec_id long, embedding array<float>, score double").repartition(4)
    got = nearest.search(table, F.col("id") % 20 == 0, k=5, row_block=4, column_block=64)
    want = []
    for q, a in vectors:
        if q % 20 == 0:
            ranked = sorted((-sum(np.cumsum(np.array(a) * np.array(b))[-1:]), v) for v, b in vectors if v != q)[:5]
            want += [(q, n + 1, v) for n, (_, v) in enumerate(ranked)]
    assert sorted((r.query_id, r["rank"], r.vec_id) for r in got.collect()) == sorted(want)
    assert nearest.search(table.limit(0), F.col("id") % 20 == 0).count() == 0


@pytest.mark.parametrize("flip", [False, True])
def test_nearest_neighbours_keeps_repeated_ids(spark, flip):
    """Against the query's own SQL, on a table with repeated ids, rows and queries, and groups of equal vectors."""
    rng = np.random.default_rng(2)
    rows = [(1, [1.0, 0.0]), (1, [5.0, 0.0]), (2, [2.0, 0.0]), (20, [1.0, 0.0]), (20, [1.0, 0.0]), (20, [0.0, 1.0]), (3, [2.0, 0.0])]
    rows += [(40, [3.0, 1.0])] * 30 + [(int(i), [3.0, 1.0]) for i in rng.integers(0, 90, 80)] + [(int(i), rng.normal(size=2).tolist()) for i in rng.integers(0, 200, 300)]
    table = pa.table({"vec_id": pa.array([r[0] for r in rows], pa.int64()), "embedding": pa.array([r[1] for r in rows], pa.list_(pa.float32()))})
    con = duckdb.connect()
    con.register("embeddings", table)
    want = sorted(map(tuple, con.sql(oracles.OP9).select("query_id, rank, vec_id, score").fetchall()))
    df = spark.createDataFrame(rows[::-1] if flip else rows, "vec_id long, embedding array<float>").repartition(3)
    for blocks in ({}, {"row_block": 3, "column_block": 50}):
        got = nearest.search(df, F.col("id") % 20 == 0, **blocks).collect()
        assert sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in got) == want


def test_decontamination(spark, docs, no_docs, texts):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if c.isascii() else c for c in t or ""))
    items = [(1, " ".join(f"wort{i}" for i in range(20, 45))), (10, "Wort3 wort4"), (2, "EIN zwei"), (3, ""), (4, None), (None, "you"), (5, " ".join(f"wort{i}" for i in range(100, 110))), (5, "x x x x x x x x x x x")]
    bench = spark.createDataFrame([(*i, 1) for i in items], "item_id long, text string, n_words long")
    want = []
    for d, t in texts:
        w, hit, named = words(t), set(), set()
        for i, text in items:
            x = words(text)
            n = min(10, len(x))
            for a in range(len(x) - n + 1) if n else ():
                for s in range(len(w) - n + 1):
                    if w[s : s + n] == x[a : a + n]:
                        hit.update(range(s, s + n))
                        named |= {str(i)} - {"None"}
        want.append((d, len(w), len(hit), len(named), hashlib.sha256(",".join(sorted(named)).encode()).hexdigest(), bool(hit)))
    got = decontaminate.decontaminate(docs, bench)
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)
    assert decontaminate.decontaminate(no_docs, bench).count() == 0
    assert decontaminate.decontaminate(docs, bench.limit(0)).where("contaminated").count() == 0
