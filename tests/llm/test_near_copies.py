"""The pipeline's near copies against all pairs of texts."""

from __future__ import annotations

import random

import corpus_pipeline
import numpy as np
from test_similarity import prose, roots, rows_of

from cueline.llm.decontamination import decontaminated
from cueline.llm.nearcopies import buckets, prefix_pairs
from cueline.llm.toxicity import without_toxic


def plain_set(text):
    words = (text or "").encode().lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def plain_similarity(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def copy_rows():
    r = random.Random(6)
    texts = []
    for k in range(40):
        words = prose(700 + k, 60 + 10 * k)
        texts.append((10 * k, " ".join(words)))
        for i in range(1, 4):  # one to eight words replaced
            edited = list(words)
            for at in r.sample(range(len(words)), r.randrange(1, 9)):
                edited[at] = f"e{i}x{at}"
            texts.append((10 * k + i, " ".join(edited)))
    chain = prose(5, 300)
    for i in range(30):  # neighbours are alike, the ends are not
        texts.append((1000 + i, " ".join(chain)))
        for at in (7 * i % 300, (7 * i + 3) % 300, 299 - 6 * i):
            chain[at] = f"c{i}x{at}"
    for i in range(20):  # half of the words alike: candidates at most
        texts.append((2000 + i, " ".join(prose(4, 120) + prose(900 + i, 60))))
    return texts + [(3000, None), (3001, " "), (None, ""), (3002, "x y"), (3003, "X  Y"), (3004, "x z"), (None, texts[0][1]), (None, "lone")]


def test_the_stage_leaves_no_near_copy(spark):
    texts = copy_rows()
    sets = [plain_set(t) for _, t in texts]
    alike = [(i, j) for i in range(len(texts)) for j in range(i) if plain_similarity(sets[i], sets[j]) >= 0.8]
    top = roots(range(len(texts)), alike)
    groups = {}
    for i, root in top.items():
        groups.setdefault(root, []).append(texts[i][0])
    want = sorted((min((x for x in g if x is not None), default=None) for g in groups.values()), key=str)
    kept = corpus_pipeline.simhash(spark, rows_of(spark, texts).repartition(4), "")
    assert kept.columns == ["doc_id", "text", "fp", "uid", "root", "score"]
    assert sorted((r.doc_id for r in kept.collect()), key=str) == want
    assert corpus_pipeline.simhash(spark, rows_of(spark, []), "").count() == 0


def test_pairs_at_the_limit_share_a_bucket():
    """Sets of a similarity of 0.8, or just above."""
    r = np.random.default_rng(12)
    met, n = 0, 2000
    for _ in range(n):
        common = int(r.integers(40, 400))
        own = common // 8  # c / (c + 2 * c / 8) = 0.8
        a = r.integers(0, 1 << 64, common + 2 * own, dtype=np.uint64)
        met += bool(set(buckets(a[: common + own])) & set(buckets(np.concatenate((a[:common], a[common + own :])))))
    assert met >= n - 2


def keyed(spark, texts):
    """(entries, texts) with every text a root of its own."""
    table = spark.createDataFrame([(i, i, t.encode()) for i, t in enumerate(texts)], "key bigint, root bigint, text binary").repartition(3)
    return table.select("key", "root"), table.select("key", "text")


def test_prefix_pairs_lack_no_similar_pair(spark):
    texts = [t for _, t in copy_rows() if t and t.strip()]
    sets = [plain_set(t) for t in texts]
    near = {(j, i) for i in range(len(texts)) for j in range(i) if sets[i] != sets[j] and plain_similarity(sets[i], sets[j]) >= 0.8}
    found = {(r.a, r.b) for r in prefix_pairs(*keyed(spark, texts)).collect()}
    assert len(near) > 100 and near <= found
    # what is known to belong together is passed over
    entries, held = keyed(spark, texts)
    assert prefix_pairs(entries.withColumn("root", entries["root"] * 0), held).count() == 0


def test_texts_with_much_in_common_meet_in_no_pair(spark):
    r = random.Random(8)
    base = prose(77, 300)
    texts = []
    for i in range(300):
        own = list(base)
        for at in r.sample(range(300), 16):
            own[at] = f"o{i}x{at}"
        texts.append(" ".join(own))
    entries, held = keyed(spark, texts)
    assert prefix_pairs(entries, held).count() <= len(texts)
    rows = rows_of(spark, list(enumerate(texts)))
    kept = corpus_pipeline.simhash(spark, rows.repartition(4), "")
    sets = [plain_set(t) for t in texts]
    alike = [(i, j) for i in range(len(texts)) for j in range(i) if plain_similarity(sets[i], sets[j]) >= 0.8]
    assert kept.count() == len(set(roots(range(len(texts)), alike).values()))


def test_stages_take_columns_of_any_name_and_judge_rows_apart(spark):
    rows = [(i, " ".join(prose(i, 40)), 1) for i in range(20)] + [(3, "what is the old name of the river by the hill\nthe amber water of the north", 2)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, `a key` int").withColumnRenamed("a key", "key of `it`, x")
    labels = spark.createDataFrame([(1, 0, 1), (2, 1, 0)], "doc_id bigint, quality int, toxic int")
    items = spark.createDataFrame([(1, rows[-1][1])], "item_id bigint, text string")
    assert without_toxic(docs.withColumnRenamed("key of `it`, x", "a key"), labels, 1.1).columns == ["doc_id", "text", "a key"]
    left = decontaminated(docs.withColumnRenamed("key of `it`, x", "__key"), items)
    assert left.columns == ["doc_id", "text", "__key"]
    # the clean row that shares an id with a leaking one stays
    assert sorted(tuple(r) for r in left.collect()) == sorted(rows[:-1])


def test_shingles_of_a_text_are_hashed_once(monkeypatch):
    """key, fingerprint and buckets of a sketch come from one pass over the text."""
    import pyarrow as pa

    from cueline.llm import nearcopies as nc
    from cueline.llm import simhash as sh

    class Texts:
        def select(self, *_):
            return self

        def mapInArrow(self, each, _):
            texts = pa.array([b"", b"a b c", b"the plan for today is that we go on as the plan for today is"], pa.binary())
            return list(each(iter([pa.RecordBatch.from_arrays([pa.array([1, 2, 3]), texts], names=["uid", "text"])])))

    hashed, hashes = [], sh.shingle_hashes
    counting = lambda text, *a: (hashed.append(text), hashes(text, *a))[1]
    monkeypatch.setattr(nc, "shingle_hashes", counting)
    monkeypatch.setattr(sh, "shingle_hashes", counting)
    monkeypatch.setattr(nc, "utf8", lambda c: c)
    monkeypatch.setattr(nc.F, "col", lambda name: type("C", (), {"alias": lambda self, _: self})())
    (found,) = nc.sketches(Texts())
    texts = list(hashed)
    assert len(texts) == 3
    for row, text in zip(found.to_pylist(), texts, strict=True):
        assert np.uint64(row["fp"] % (1 << 64)) == sh.fingerprint(text, nc.SHINGLE)
        assert row["buckets"] == (nc.buckets(nc.shingle_set(text)) if text else [])
