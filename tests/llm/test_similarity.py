"""SimHash components, repeated passages and decontamination, against all pairs."""

from __future__ import annotations

import random
from collections import defaultdict

import numpy as np
import pytest
import xxhash

from cueline.llm import decontamination as d
from cueline.llm.components import components
from cueline.llm.repeats import owners, repeated_passages
from cueline.llm.simhash import fingerprint, forest, links, near_components, near_deduplicated, position_sets, simhash_components

SCHEMA = "doc_id bigint, text string, fp string, uid int, root string, score double"


def rows_of(spark, texts):
    return spark.createDataFrame([(i, t, "fp", 0, "r", 0.5) for i, t in texts], SCHEMA)


def prose(seed, n=120):
    r = random.Random(seed)
    return [f"w{r.randrange(4000)}" for _ in range(n)]


def plain_fingerprint(text):
    words = text.encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def roots(nodes, edges):
    parent = {x: x for x in nodes}

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = top(a), top(b)
        parent[max(a, b)] = min(a, b)
    return {x: top(x) for x in nodes}


def test_fingerprints_are_those_of_the_rule():
    for text in ["", "  \n ", "One", "one TWO three", "a b c d", "a b a b a b a b", "É é x\ty  Z q", " ".join(prose(1, 500))]:
        assert fingerprint(text.encode()) == plain_fingerprint(text)


def test_spark_hashes_alike(spark):
    """The shingle hash is the one that Spark's xxhash64 gives with its default seed."""
    got = spark.sql("SELECT xxhash64('one two three four') AS h").first().h
    assert got % (1 << 64) == xxhash.xxh64_intdigest(b"one two three four", 42)


def test_every_linked_pair_shares_an_indexed_set():
    from itertools import combinations

    sets = [set(s) for s in position_sets(4)]
    assert len(sets) == 20
    assert all(any(s <= set(four) for s in sets) for four in combinations(range(8), 4))


def test_forest_connects_what_is_linked():
    r = random.Random(5)
    fps = {r.getrandbits(64) for _ in range(40)}
    for f in list(fps):
        for _ in range(6):
            fps.add(f ^ sum(1 << r.randrange(64) for _ in range(r.randrange(6))) & (1 << 64) - 1)
    fps = sorted(fps)
    a, b = forest(np.array(fps, dtype=np.uint64))
    linked = [(x, y) for i, x in enumerate(fps) for y in fps[:i] if (x ^ y).bit_count() <= 4]
    assert roots(fps, zip(a.tolist(), b.tolist(), strict=True)) == roots(fps, linked)
    assert len(a) < len(fps)


def test_links_over_random_fingerprints(spark):
    r = random.Random(7)
    fps = {r.getrandbits(64) for _ in range(150)}
    for f in list(fps):
        fps.add(f ^ sum({1 << r.randrange(64) for _ in range(4)}))
        fps.add(f ^ sum({1 << r.randrange(64) for _ in range(5)}))
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    edges = links(spark.createDataFrame([(f,) for f in signed], "fp bigint")).collect()
    linked = [(x, y) for i, x in enumerate(signed) for y in signed[:i] if ((x ^ y) & (1 << 64) - 1).bit_count() <= 4]
    assert roots(signed, [(e.a, e.b) for e in edges]) == roots(signed, linked)


def test_components_of_chains_stars_and_loops(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 160)] + [(200, 200), (300, 301), (301, 300)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    want = roots({x for e in edges for x in e}, edges)
    want.pop(200)  # a node with no link but to itself
    assert got == want
    assert components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def near_rows():
    base = prose(3, 400)
    edited = [base[:200] + [f"e{i}"] + base[201:] for i in range(12)]
    texts = [(20 + i, " ".join(t)) for i, t in enumerate(edited)] + [(2, " ".join(base)), (3, " ".join(base).upper())]
    texts += [(40, None), (41, ""), (42, " \n"), (None, " ".join(base)), (50, "x"), (51, "x"), (51, "x"), (None, None)]
    return texts + [(60 + i, " ".join(prose(100 + i, 60))) for i in range(30)]


def test_near_components(spark):
    texts = near_rows()
    fps = {t: plain_fingerprint(t or "") for _, t in texts}
    distinct = sorted(set(fps.values()))
    top = roots(distinct, [(x, y) for i, x in enumerate(distinct) for y in distinct[:i] if (x ^ y).bit_count() <= 4])
    least = defaultdict(list)
    for i, t in texts:
        if i is not None:
            least[top[fps[t]]].append(i)
    want = sorted(((i, f"{fps[t]:016x}", min(least[top[fps[t]]], default=None)) for i, t in texts), key=str)
    got = simhash_components(rows_of(spark, texts)).select("doc_id", "fingerprint", "component_id").collect()
    assert sorted(map(tuple, got), key=str) == want
    kept = near_deduplicated(rows_of(spark, texts))
    assert kept.columns == ["doc_id", "text", "fp", "uid", "root", "score"]
    rows = kept.collect()
    assert sorted(top[fps[r.text]] for r in rows) == sorted({top[f] for f in fps.values()})
    assert all(r.doc_id == min(least[top[fps[r.text]]], default=None) for r in rows)


def test_nothing_in_nothing_out(spark):
    none = rows_of(spark, [])
    items = spark.createDataFrame([], "item_id bigint, text string")
    assert near_components(none).count() == near_deduplicated(none).count() == repeated_passages(none).count() == 0
    assert d.contaminations(none, items).count() == 0
    docs = rows_of(spark, [(1, "some text")])
    assert d.contaminations(docs, items).count() == 0
    assert d.decontaminated(docs, items).count() == 1
    assert d.decontaminated(none, items.union(spark.createDataFrame([(1, "some text")], items.schema))).count() == 0


def test_owners_are_leftmost_minima():
    r = random.Random(2)
    for width in (1, 2, 5, 43):
        values = np.array([r.randrange(9) for _ in range(200)])
        want = [s + int(np.argmin(values[s : s + width])) for s in range(len(values) - width + 1)]
        assert owners(values, width).tolist() == want


def plain_passages(texts, n):
    words = {(i, t): (t or "").encode().split() for i, t in texts}
    seen = defaultdict(list)
    for key, w in words.items():
        for s in range(len(w) - n + 1):
            seen[tuple(w[s : s + n])].append((key[0], s))
    least = {k: min((i for i, _ in v if i is not None), default=None) for k, v in seen.items() if len(v) > 1}
    out = []
    for key, w in words.items():
        spans = []
        for s in range(len(w) - n + 1):
            k = tuple(w[s : s + n])
            if k in least:
                if spans and s <= spans[-1][1]:
                    spans[-1][1] = s + n
                    spans[-1][2].append(least[k])
                else:
                    spans.append([s, s + n, [least[k]]])
        out += [(key[0], a, b, b - a, min((x for x in f if x is not None), default=None)) for a, b, f in spans]
    return sorted(out, key=str)


def passage_rows(length=70):
    shared, other = prose(1, length), prose(2, 200)
    texts = [(i, " ".join(prose(500 + i, 30 + i) + shared + prose(600 + i, 20))) for i in range(12)]
    texts += [(30, " ".join(other)), (31, " ".join(other[:90] + ["edit"] + other[91:])), (32, " ".join(other[40:]))]
    texts += [(40, " ".join(shared[:49])), (41, " ".join(shared[10:61])), (42, None), (43, ""), (None, " ".join(shared)), (44, "a " * 120)]
    texts += [(50, " ".join(shared + prose(9, 5) + shared)), (51, " ".join(other)), (51, " ".join(other)), (60, "tick tock " * 40), (61, "tick tock " * 30)]
    return texts


@pytest.mark.parametrize("n,gram", [(50, 8), (12, 3), (5, 5), (6, 1)])
def test_passages_against_all_windows(spark, n, gram):
    texts = passage_rows()
    got = sorted(map(tuple, repeated_passages(rows_of(spark, texts), n, gram).collect()), key=str)
    assert got == plain_passages(dict.fromkeys(texts), n)


def test_chance_repeats_over_few_words(spark):
    """Very small vocabularies give neighbours that part at every place."""
    r = random.Random(11)
    texts = [(i, " ".join(r.choice("ab") for _ in range(60))) for i in range(25)]
    got = sorted(map(tuple, repeated_passages(rows_of(spark, texts), 9, 3).collect()), key=str)
    assert got == plain_passages(texts, 9)


def index_of(items):
    from collections import Counter

    known = [(i, t.encode()) for i, t in items if d.plain_words((t or "").encode())]
    counts = Counter(w for _, t in known for w in set(d.plain_words(t)))
    return d.Index(known, counts, len(known), float(np.mean([len(d.plain_words(t)) for _, t in known])))


def test_wand_returns_all_at_or_above_the_threshold():
    r = random.Random(4)
    items = [(i, " ".join(f"w{int(r.paretovariate(0.6)) % 300}" for _ in range(r.randrange(4, 30)))) for i in range(400)]
    old, d.BLOCK = d.BLOCK, 4
    try:
        index = index_of(items)
        for share in (0.05, 0.2, 0.5, 0.9):
            for _ in range(60):
                terms = sorted({t for t in (r.randrange(len(index.terms)) for _ in range(r.randrange(1, 40)))})
                scores = np.zeros(len(index.ids))
                for t in terms:
                    scores[index.items[t]] += index.weights[t]
                got = sorted(index.search(terms, share))
                want = [(i, s) for i, s in enumerate(scores.tolist()) if s >= share - 1e-9]
                assert [i for i, _ in got] == [i for i, _ in want]
                assert np.allclose([s for _, s in got], [s for _, s in want])
    finally:
        d.BLOCK = old


def test_items_are_found_wherever_they_stand(spark):
    items = [(i, " ".join(prose(i, 15 + i)) + ("\nthe answer is " + f"a{i} b{i} c{i}" if i % 2 else "")) for i in range(20)]
    items += [(90, None), (91, " "), (92, items[3][1]), (93, "Short one")]
    docs = []
    for k in range(120):
        fill = prose(1000 + k, 20 + 7 * k)
        item = items[k % 20][1]
        at = (k * 13) % len(fill)
        docs.append((k, " ".join(fill[:at]) + "\n" + (item.upper() if k % 3 else item.replace(" ", ", ")) + ". " + " ".join(fill[at:])))
    docs += [(500 + k, " ".join(prose(9000 + k, 300))) for k in range(40)]
    docs += [(700, None), (701, ""), (702, items[1][1].rpartition("\n")[0]), (None, items[5][1]), (703, items[4][1]), (703, items[4][1]), (704, "a SHORT one")]
    table = spark.createDataFrame(items, "item_id bigint, text string")
    for shard_words in (1_000_000, 100):
        found = {(r.doc_id, r.item_id) for r in d.contaminations(rows_of(spark, docs), table, shard_words=shard_words).collect()}
        want = {(k, k % 20) for k in range(120)} | {(k, 92) for k in range(120) if k % 20 == 3} | {(None, 5), (703, 4), (704, 93)}
        assert found == want  # 702 lacks the answer
    clean = d.decontaminated(rows_of(spark, docs), table).collect()
    assert sorted(r.doc_id for r in clean) == [500 + k for k in range(40)] + [700, 701, 702]


def test_overlap_counts_words_in_shared_runs():
    part = [b"a", b"b", b"c", b"d", b"e", b"f", b"g", b"h", b"i", b"j"]
    assert d.run_overlap(part, part) == 1
    assert d.run_overlap(part, part[:7]) == 0.7
    assert d.run_overlap(part, part[::-1]) == 0
    assert d.run_overlap([], part) == 1


def test_edited_items_are_found_at_every_position():
    items = [(i, " ".join(prose(i, 18 + i)) + (f"\nthe answer is a{i} b{i} c{i} d{i}" if i % 2 else "")) for i in range(12)]
    index = index_of(items)
    fill = " ".join(prose(5000, 150))
    for i, text in items:
        words = text.replace("\n", " \n ").split(" ")
        for at in (k for k, w in enumerate(words) if w != "\n"):
            for edits in (1, 2, 3):
                edited = list(words)
                for k in range(edits):
                    place = (at + 5 * k) % len(words)
                    if words[place] != "\n":
                        edited[place] = ("zz", "", words[place] + " zz")[(at + k) % 3]
                found = d.match(index, f"{fill} {' '.join(edited)} {fill}".encode(), d.SHARE, d.OVERLAP)
                assert [index.ids[m[0]] for m in found] == [i], (i, at, edits)
    asked = items[11][1].rpartition("\n")[0]
    assert d.match(index, f"{fill} {asked} {fill}".encode(), d.SHARE, d.OVERLAP) == []  # without its answer
    assert d.match(index, " ".join(reversed(items[6][1].split())).encode(), d.SHARE, d.OVERLAP) == []


def test_alignment_is_that_of_the_longest_common_subsequence():
    def longest(x, y):
        row = [0] * (len(y) + 1)
        for a in x:
            last = row
            row = [0]
            for j, b in enumerate(y):
                row.append(last[j] + 1 if a == b else max(last[j + 1], row[j]))
        return row[-1]

    r = random.Random(8)
    for _ in range(300):
        item = [b"%d" % r.randrange(12) for _ in range(r.randrange(2, 16))]
        cut = r.randrange(1, len(item) + 1)
        passage = [w if r.random() < 0.9 else b"x" for _ in range(3) for w in [*item, b"y", b"z"]]
        question, answer = d.aligned_overlap(item[:cut], item[cut:], passage, 0.8)
        wide = d.stretch(len(item))
        most = max(longest(item, passage[s : s + wide]) for s in range(len(passage)))
        held = question * cut + (answer * (len(item) - cut))
        assert round(held) == (most if most >= 0.8 * len(item) - 1e-9 else 0)
        assert question <= 1 and answer <= 1
