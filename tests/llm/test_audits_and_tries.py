"""Source divergence, quality and the prefix trie, against plain Python."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np

from cueline.llm import divergence, prefixes, quality

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
CLASHING = "doc_id bigint, text string, lang string, source string, w0 string, count int, block string, stats int, score string"
LABELS = "doc_id bigint, quality int, toxic int"


def documents(spark, rows):
    return spark.createDataFrame([(*r, "x", 1, "y", 2, "z") for r in rows], CLASHING)


# source divergence


def audited_rows():
    r = random.Random(3)
    terms = ["a", "of", "Straße", "été", "eightlet", "ninelette", "sixteenbyteslong", "seventeenbyteslon", "ABCDEFGHabcdefghi", "z" * 40, "Z" * 41, "ab", "abc"]
    terms += [f"w{chr(97 + i)}{chr(97 + j)}" for i in range(6) for j in range(6)]
    rows = []
    for i in range(160):
        lang = ["en", "de", None, ""][i % 4]
        source = ["s1", "s2", "s3", None][r.choice((0, 0, 0, 1, 2, 3))]
        own = r.sample(terms, 12) if source != "s2" else r.sample(terms[:20], 12)
        rows.append((i, r.choice((" ", ", ", "\n", "1")).join(r.choices(own, k=r.randrange(40))), lang, source))
    return rows + [(7, rows[7][1], "en", "s1"), (None, None, "fr", "only"), (900, "", "fr", "other"), (901, "...", "it", None), (902, "of " * 3000, "en", "s9")]


def plain_divergence(rows, least, top):
    counts, in_docs, groups = defaultdict(Counter), defaultdict(Counter), set()
    for _, text, lang, source in rows:
        lang, source = lang or "", source or ""
        found = [re.sub("[A-Z]", lambda m: m[0].lower(), t) for t in TERM.findall(text or "")]
        groups.add((lang, source))
        counts[lang, source].update(found)
        in_docs[lang].update(set(found))
    out = set()
    for lang in {g[0] for g in groups}:
        kept = {t for t, n in in_docs[lang].items() if n >= least}
        own = {s: {t: counts[lang, s][t] for t in kept} for g, s in groups if g == lang}
        whole = {t: sum(c[t] for c in own.values()) for t in kept}

        def share(c):
            total = sum(c.values()) + 2 * len(kept)
            return {t: 1 + 10**9 * (n + 2) // total for t, n in c.items()}

        p, q = {s: share(c) for s, c in own.items()}, share(whole)
        for s in own:
            pairs = [(sum((p[s][t] - p[o][t]) ** 2 // (p[s][t] + p[o][t]) for t in kept), o) for o in own if o != s]
            terms = [((p[s][t] - q[t]) ** 2 // (p[s][t] + q[t]), t) for t in kept if own[s][t] and p[s][t] > q[t]]
            for part, found in (("pair", pairs), ("term", terms)):
                ranked = sorted(found, key=lambda f: (-f[0], f[1].encode()))
                out |= {(lang, s, part, item, v, i) for i, (v, item) in enumerate(ranked, 1) if part == "pair" or i <= top}
    return out


def test_divergence_is_that_of_plain_counting(spark, monkeypatch):
    rows = audited_rows()
    want = plain_divergence(rows, 5, 4)
    for cells in (divergence.CELLS, 40):  # one block of terms, and many
        monkeypatch.setattr(divergence, "CELLS", cells)
        found = divergence.divergence(documents(spark, rows).repartition(3), least_docs=5, top=4).collect()
        assert {(r.lang, r.source, r.part, r.item, r.value, r.rank) for r in found} == want
        assert len(found) == len(want)
    assert {r[4] for r in want if r[0] == "fr"} == {0}
    none = divergence.divergence(documents(spark, []))
    assert none.count() == 0 and none.columns == ["lang", "source", "part", "item", "value", "rank"]


def test_slices_of_any_size_give_the_same_counts(spark):
    docs = documents(spark, audited_rows()).repartition(2)

    def added(size):
        found = Counter(), Counter()
        for r in divergence.term_counts(docs, size).collect():
            for place, n in enumerate((r["count"], r["docs"])):
                found[place][r.lang, r.source, r.w0, r.w1, bytes(r.tail)] += n
        return found

    assert added(60) == added(1 << 20)


def test_radix_order_is_stable():
    r = np.random.default_rng(5)
    high, low = r.integers(0, 1 << 63, 500, dtype=np.uint64) >> np.uint64(58), r.integers(0, 1 << 40, 500, dtype=np.uint64) >> np.uint64(36)
    assert divergence.radix_order([low, high]).tolist() == sorted(range(500), key=lambda i: (high[i], low[i], i))


# quality


def test_held_out_quality(spark):
    folder = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    found = quality.quality(docs, labels).join(labels, "doc_id").where("held_out").collect()
    assert sum(r.predicted == r.quality for r in found) / len(found) > 0.98
    low = [r for r in found if not r.quality]
    assert sum(not r.predicted for r in low) / len(low) > 0.95


def test_sums_and_curve_are_those_of_dense_arithmetic(spark):
    r = np.random.default_rng(1)
    stats = r.integers(-5_000_000, 5_000_000, (300, quality.STATISTICS))
    label, fold = r.integers(0, 2, 300), r.integers(0, quality.FOLDS, 300)
    rows = spark.createDataFrame([(s.tolist(), int(y), int(f)) for s, y, f in zip(stats, label, fold, strict=True)], "stats array<bigint>, label bigint, fold int").repartition(3)
    scaling = quality.scaling_of(rows)
    assert np.allclose(scaling.mean, stats.mean(axis=0)) and np.allclose(scaling.spread, stats.std(axis=0))
    for f, (square, product) in quality.normal_sums(rows, scaling).items():
        z = quality.fourier(stats[fold == f], scaling) * quality.COS_UNIT
        assert np.allclose(square, z.T @ z) and np.allclose(product, z.T @ label[fold == f])
    # cosines approximate the kernel: their mean product is half of it
    z = quality.fourier(stats, scaling)[:, :-1] * quality.COS_UNIT
    scaled = (stats - scaling.mean) / scaling.spread
    apart = ((scaled[:, None] - scaled[None]) ** 2).sum(axis=2)
    assert np.abs(2 * z @ z.T / quality.FEATURES - np.exp(-apart / (2 * quality.WIDTH**2))).max() < 0.25


def test_isotonic_curve():
    r = random.Random(2)
    for _ in range(50):
        n = [r.randrange(1, 5) for _ in range(12)]
        hits = [r.randrange(x + 1) for x in n]
        steps, values = quality.isotonic(np.arange(12), np.array(n), np.array(hits))
        # the greatest of the least means over all spans that hold the place
        best = [max(min(sum(hits[a:b]) / sum(n[a:b]) for b in range(i + 1, 13)) for a in range(i + 1)) for i in range(12)]
        assert np.all(np.diff(values) > 0) and np.all(np.diff(steps) > 0)
        assert np.allclose(sorted(set(np.round(best, 9))), np.round(values, 9))


def test_quality_of_messy_rows(spark):
    good = [(i, " ".join(random.Random(i).choices(["plain", "words", "of", "prose"], k=50)) + ".", "a", "s") for i in range(0, 200, 2)]
    bad = [(i, "#$% " * 40 + str(i), "a", "s") for i in range(1, 200, 2)]
    odd = [(300, None, None, None), (301, "", "b", "c"), (None, "#$% " * 40, None, "d"), (302, "é" * 100_000, "a", "s"), (0, "#$% " * 30, "a", "s")]
    rows = good + bad + odd
    known = [(i, 1 - i % 2, 0) for i in range(200)] + [(1, None, 1), (None, 1, 1), (3, 0, 1)]
    found = quality.quality(documents(spark, rows), spark.createDataFrame(known, LABELS)).collect()
    assert len(found) == len(rows)
    for r in found:
        assert r.held_out == (zlib.crc32(str("" if r.doc_id is None else r.doc_id).encode()) % 4 == 2)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7)
    assert all(r.predicted == 1 - r.doc_id % 2 for r in found if r.doc_id is not None and 0 < r.doc_id < 200)
    assert [r.predicted for r in found if r.doc_id is None] == [0]
    lie = [(i, q if q is None or zlib.crc32(str(i).encode()) % 4 != 2 else 1 - q, 0) for i, q, _ in known]
    again = quality.quality(documents(spark, rows), spark.createDataFrame(lie, LABELS)).collect()
    assert sorted(map(str, again)) == sorted(map(str, found))
    assert {r.score for r in quality.quality(documents(spark, rows), spark.createDataFrame([], LABELS)).collect()} == {0.5}
    assert quality.quality(documents(spark, []), spark.createDataFrame(known, LABELS)).count() == 0


def test_pieces_of_a_long_text_are_its_whole(monkeypatch):
    text = b"one two three.\n" * 500
    whole = quality.statistics(text)
    monkeypatch.setattr(quality, "PIECE", 1500)
    parts = quality.statistics(text)
    # what is compressed piece by piece differs, all else is the same
    assert whole[:-1].tolist() == parts[:-1].tolist()


# prefix trie


def said_rows():
    r = random.Random(9)
    rows = []
    for conv in range(-30, 420):
        depth = r.choice((1, 1, 2, 3, 5, 8))
        for turn in range(depth):
            text = f"t{r.randrange(2)}" if turn else "hello"
            rows.append((conv, None if turn == 0 and conv % 5 == 0 else turn, ["user", "assistant", None][turn % 3], text if r.random() < 0.97 else None))
    for conv in range(500, 800):  # one conversation very often
        rows += [(conv, t, "user", "same") for t in range(7)]
    rows += [(1000 + t, 0, "u", "x") for t in range(3)]
    rows += [(900, 1, "a", "tie b"), (900, 1, "a", "tie a"), (900, 1, "a", "tie a"), (901, None, None, None), (None, 0, "u", "lost")]
    return rows + [(902, t, "u", f"long {t}") for t in range(400)] + [(903, t, "u", f"long {t}" if t < 390 else "else") for t in range(400)]


def plain_trie(rows):
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            own[conv].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [(role, text) for _, _, role, text in sorted(ts)] for c, ts in own.items()}
    members, ends = defaultdict(list), defaultdict(list)
    for c in sorted(own):
        h = zlib.crc32(str(c).encode()) % 6
        base = c - (abs(c) % 100) * (1 if c >= 0 else -1)
        whole = tuple(own.get(base, [])[:h] + own[c][h:])
        ends[whole].append(c)
        for d in range(len(whole) + 1):
            members[whole[:d]].append(c)
    children = Counter(n[:-1] for n in members if n)
    leaves, saved = Counter(), Counter()
    for node, ids in members.items():
        for d in range(len(node) + 1):
            leaves[node[:d]] += not children[node]
            saved[node[:d]] += (len(ids) - 1) * len(node[-1][1]) if node else 0
    return sorted(
        (min(ids), len(n), min(members[n[:-1]]) if n else None, len(ids), children[n], leaves[n], saved[n], hashlib.sha256(",".join(map(str, ends[n])).encode()).hexdigest())
        for n, ids in members.items()
    )


def test_the_trie_is_that_of_plain_prefixes(spark):
    rows = said_rows()
    table = spark.createDataFrame([(*r, 1, "y", b"k") for r in rows], "conv_id bigint, turn bigint, role string, text string, seq int, depth string, parent_key binary").repartition(3)
    want = plain_trie(rows)
    for block in (prefixes.BLOCK, 40, 3):
        found = prefixes.conversation_prefixes(table, block)
        assert sorted(map(tuple, found.collect()), key=lambda r: r[:2]) == want
    assert found.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    assert prefixes.conversation_prefixes(table.where("false")).count() == 0


def test_medians_balance_siblings():
    tree = prefixes.TernaryTree()
    for i in prefixes.medians(1023):
        tree.insert([i], [1], i)
    depth, front = 0, [tree.same[0]]
    while front:
        depth += 1
        front = [n for m in front for n in (tree.low[m], tree.high[m]) if n >= 0]
    assert depth == 10
    assert sorted(n for n, _, _ in tree.walk()) == list(range(1024))
