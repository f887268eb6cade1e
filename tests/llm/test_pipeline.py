"""The pipeline, stage by stage: on the smallest table, and against plain Python on a fixture with planted cases."""

import random
import re
from collections import Counter

import pyarrow as pa
import pytest

import corpus_pipeline
from kvloom.llm import mixing, toxicity

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id string, th string, fp long, digest long, size long, rest string, block long"
LAST = (1 << 63) - 1


def planted():
    """(id, text, source) with toxic texts, copies, near-copies, passages, benchmark windows, nulls, empties, repeats, a long text; and the labels and items."""
    rng = random.Random(4)
    text = lambda n: [f"w{rng.randrange(3000)}" for _ in range(n)]
    rows, labels = [], []
    clean = [text(60) for _ in range(70)]
    for i, words in enumerate(clean):
        rows.append((i, " ".join(words)))
        labels.append((i, 1, 0))
    for i in range(100, 140):
        rows.append((i, " ".join([*text(40), "idiot", "stupid", *text(3)])))
        labels.append((i, 0, 1))
    rows += [(150, " ".join([*text(30), "i d i o t", "STUP1D"])), (151, " ".join([*text(30), "1d1ot,", "$tupid!"]))]
    rows += [(200, rows[3][1]), (201, rows[3][1]), (2, rows[2][1])]  # copies, and a repeated row
    near = list(clean[5])
    near[30] = "neu"
    rows += [(210, " ".join(near)), (211, " ".join(near).upper())]
    passage, item = text(25), text(14)
    rows += [(n, " ".join([*text(30), *passage, *text(30)])) for n in (220, 221, 222)]
    rows += [(230, " ".join([*text(30), *(w.upper() for w in item[2:]), *text(9)])), (231, ", ".join([*text(5), *item[:9], *text(5)])), (232, " ".join(passage))]
    rows += [(240, None), (241, ""), (242, " \n\t"), (None, "ein text"), (None, None), (243, "kurz"), (244, "Kurz"), (245, " ".join(text(30_000)))]
    rng.shuffle(rows)
    items = [(1, " ".join(item)), (2, "zwei wörter"), (3, None), (4, "")]
    return [(i, t, f"s{0 if i is None else i % 3}") for i, t in rows], labels, items


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    out = str(tmp_path_factory.mktemp("sf"))
    rows, labels, items = planted()
    docs = [(i, t, "en", s, None if t is None else len(t), "c", "c", 1, 1, 1, "c", 1) for i, t, s in rows]
    spark.createDataFrame(docs, SCHEMA).repartition(3).write.parquet(f"{out}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{out}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{out}/benchmark.parquet")
    return out


def plain_words(text):
    return (text or "").encode().split()


def without_toxic(rows, spark, folder):
    """The rows whose texts score less than 0.7 one by one; the planted ones are among those that go."""
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    scorer = toxicity.Scorer(toxicity.train(docs, labels.where(~toxicity.held_out())))
    kept = [r for r in rows if scorer(pa.array([r[1]], pa.string()))[0] < 0.7]
    assert {r[0] for r in rows} - {r[0] for r in kept} == {*range(100, 140), 150, 151}
    return kept


def one_of_each(rows, spark, folder):
    """The first row of each group linked by a similarity of 0.8 of five-word shingles."""
    def shingles(text):
        words = plain_words(text.lower() if text else text)
        k = min(5, len(words))
        return frozenset(tuple(words[i : i + k]) for i in range(len(words) - k + 1)) if k else frozenset()

    sets = [shingles(t) for _, t, *_ in rows]
    up = list(range(len(rows)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if sets[a] == sets[b] or len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                up[find(a)] = find(b)
    groups = {}
    for n, r in enumerate(rows):
        groups.setdefault(find(n), []).append(r)
    assert {2, 3, 4} <= {len(g) for g in groups.values()}
    return list(groups.values())  # which of equal ids stays follows from a hash


def without_passages(rows, spark, folder):
    seen, out = {}, []
    for i, t, lang, source, _ in sorted(rows, key=lambda r: LAST if r[0] is None else r[0]):
        words, at = plain_words(t), LAST if i is None else i
        gone = set()
        for a in range(len(words) - 19):
            if seen.setdefault(tuple(words[a : a + 20]), (at, a)) != (at, a):
                gone.update(range(a, a + 20))
        if gone:
            t = b" ".join(w for n, w in enumerate(words) if n not in gone).decode()
        if not gone or t:
            out.append((i, t, lang, source, None if t is None else len(t)))
    assert sum(a != b for a, b in zip(sorted(map(str, rows)), sorted(map(str, out)), strict=False)) and len(out) < len(rows)
    return out


def without_benchmark(rows, spark, folder):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if c.isascii() else c for c in t or ""))
    windows = set()
    for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect():
        x = words(r.text)
        windows |= {tuple(x[a : a + min(10, len(x))]) for a in range(len(x) - min(10, len(x)) + 1) if x}
    sizes = {len(w) for w in windows}
    kept = [r for r in rows if not any(tuple(words(r[1])[a : a + n]) in windows for n in sizes for a in range(len(words(r[1])) - n + 1))]
    assert {r[0] for r in rows} - {r[0] for r in kept} == {230}
    return kept


CHECKS = [without_toxic, one_of_each, without_passages, without_benchmark]


def test_stages_equal_plain_python(spark, folder, tmp_path):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    shown = lambda df: [(r.doc_id, r.text, r.lang, r.source, None if r.text is None else len(r.text)) for r in df.collect()]
    rows = shown(docs)
    for n, (name, stage) in enumerate(corpus_pipeline.STAGES[:4]):
        want = CHECKS[n](rows, spark, folder)
        stage(spark, docs, folder).write.parquet(f"{tmp_path}/{n}")
        docs = spark.read.parquet(f"{tmp_path}/{n}")
        assert docs.columns == corpus_pipeline.COLUMNS
        rows = shown(docs)
        assert all(r.n_chars == (None if r.text is None else len(r.text)) for r in docs.collect())
        if name == "simhash near-dedup":
            assert len(rows) == len(want)
            left = Counter(rows)
            for group in want:  # the smallest id stays
                least = min(LAST if r[0] is None else r[0] for r in group)
                stays = {r for r in group if (LAST if r[0] is None else r[0]) == least}
                assert sum(left[r] for r in stays) == 1
        else:
            assert Counter(rows) == Counter(want), name
    got = corpus_pipeline.STAGES[4][1](spark, docs, folder).collect()
    sizes = {(r[0], len(plain_words(r[1]))): r[3] for r in rows}
    total, target, taken = Counter(), {}, Counter()
    for (_, n), s in sizes.items():
        total[s] += n
    for r in got:
        assert 0 < r.taken <= 2 * r["size"]
        taken[sizes[r.doc_id, r["size"]]] += r.taken
        target[sizes[r.doc_id, r["size"]]] = r.target
    assert all(abs(taken[s] - target[s]) <= max(1, 0.01 * target[s]) for s in target)
    assert sum(n for (_, n) in sizes) * 1.5 == pytest.approx(sum(target.values()))


def test_stages_of_empty_tables(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, folder).count() == 0


def test_stages_keep_the_columns_and_only_lose_rows(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, kept = docs.columns, docs.count()
    for n, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, SF).write.parquet(f"{tmp_path}/{n}")
        docs = spark.read.parquet(f"{tmp_path}/{n}")
        assert 0.7 * kept < docs.count() <= kept, name
        if n < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == columns
        kept = docs.count()
    assert docs.where("taken > 2 * size").count() == 0


def test_every_query_is_registered():
    import __spark_entry__

    names = set(__spark_entry__.queries())
    assert "pipeline" in names and {f"op{n}" for n in range(1, 11)} <= {x.split("_")[0] for x in names}
    assert set(__spark_entry__.oracle_sql()) <= names
    assert mixing.WEIGHTS == (5, 2, 1)
