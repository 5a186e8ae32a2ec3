"""Toxicity, language model, token counts, mixing, chat formatting and the pipeline, against plain Python."""

from __future__ import annotations

import base64
import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict
from itertools import product
from pathlib import Path

import numpy as np
import pytest
import xxhash

from cueline.llm import chat, katz, mixing, tokens, toxicity
from cueline.llm.mixing import fit, knapsack, mix_documents, mixed_documents

SCHEMA = "doc_id bigint, text string, source string, score double, size string, times int"


def rows_of(spark, rows):
    return spark.createDataFrame([(i, t, s, 0.5, "z", 1) for i, t, s in rows], SCHEMA)


def prose(seed, n=60, words=400):
    r = random.Random(seed)
    return [f"w{int(r.paretovariate(0.7)) % words}" for _ in range(n)]


# toxicity


def test_held_out_accuracy(spark):
    folder = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    found = toxicity.toxicity(docs, labels).join(labels, "doc_id").where("held_out").collect()
    hit = sum(r.predicted and r.toxic for r in found)
    # 2 600 labelled documents to learn from; with the 20 000 of a larger table 95 of 100 toxic ones are found
    assert hit / max(1, sum(r.predicted for r in found)) > 0.95
    assert hit / sum(r.toxic for r in found) > 0.65
    order = sorted(found, key=lambda r: r.score)
    ranks = [i for i, r in enumerate(order) if r.toxic]
    n1 = len(ranks)
    assert (sum(ranks) - n1 * (n1 - 1) / 2) / (n1 * (len(order) - n1)) > 0.97


def test_toxicity_of_messy_rows(spark):
    docs = [(i, " ".join(prose(i) + (["vile"] if i % 4 == 0 else [])), "a") for i in range(300)]
    docs += [(400, None, None), (401, "", "b"), (None, "vile", None), (402, "Vile!", "c"), (0, docs[0][1], "a")]
    labels = [(i, 0, int(i % 4 == 0)) for i in range(300)] + [(7, 0, None), (None, 0, 1), (9, 1, 0)]
    table = spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")
    found = toxicity.toxicity(rows_of(spark, docs), table).collect()
    assert len(found) == len(docs)
    for r in found:
        name = "" if r.doc_id is None else str(r.doc_id)
        assert r.held_out == (zlib.crc32(name.encode()) % 3 == 1)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7)
    score = {r.doc_id: r.score for r in found}
    toxic = {i: t for i, t, _ in docs if i is not None and t and "vile" in t.lower()}
    assert min(score[i] for i in toxic) > max(score[i] for i in score if i is not None and i not in toxic)
    kept = toxicity.without_toxic(rows_of(spark, docs), table)
    assert kept.columns == ["doc_id", "text", "source", "score", "size", "times"]
    rejected = {i for i in score if score[i] >= 0.7}
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(i) for i, _, _ in docs if i not in rejected)
    assert {r.score for r in kept.collect()} == {0.5}


def plain_ftrl(docs, labels):
    """Scores by FTRL-proximal over dictionaries, one number at a time."""
    top, mask = 1 << 64, (1 << 64) - 1
    kinds = [int(k) for k in toxicity.KINDS]

    def coordinates(text):
        found = re.findall("[a-z0-9]+", text.lower())
        h = [xxhash.xxh64_intdigest(w) for w in found]
        out = {(x * kinds[0] & mask) >> 44 for x in h}
        for gap in (1, 2):
            out |= {((x * kinds[gap] + (y ^ (y >> 29))) * kinds[0] & mask) >> 44 for x, y in zip(h, h[gap:])}
        return sorted(out)

    def turn(i):
        h = xxhash.xxh64_intdigest(i.to_bytes(8, "little", signed=True), seed=42)
        return (h - top if h >> 63 else h), i

    known = sorted((i for i in labels if zlib.crc32(str(i).encode()) % 3 != 1 and i in docs), key=turn)
    z, n, z0, n0 = defaultdict(float), defaultdict(float), 0.0, 0.0
    positive = sum(labels[i] for i in known)
    heavier = math.sqrt(max(1.0, (len(known) - positive) / max(1, positive)))

    def weight(k):
        if abs(z[k]) <= toxicity.L1:
            return 0.0
        return -(z[k] - math.copysign(toxicity.L1, z[k])) / ((toxicity.BETA + math.sqrt(n[k])) / toxicity.ALPHA + toxicity.L2)

    def bias():
        return -z0 / ((toxicity.BETA + math.sqrt(n0)) / toxicity.ALPHA)

    def score(own):
        return 1 / (1 + math.exp(-max(-30, min(30, sum(map(weight, own)) + bias()))))

    for _ in range(toxicity.ROUNDS):
        for i in known:
            own = coordinates(docs[i])
            g = (score(own) - labels[i]) * (heavier if labels[i] else 1.0)
            before = {k: weight(k) for k in own}
            for k in own:
                z[k] += g - (math.sqrt(n[k] + g * g) - math.sqrt(n[k])) / toxicity.ALPHA * before[k]
                n[k] += g * g
            z0 += g - (math.sqrt(n0 + g * g) - math.sqrt(n0)) / toxicity.ALPHA * bias()
            n0 += g * g
    return {i: score(coordinates(t)) for i, t in docs.items()}


def test_toxicity_is_that_of_a_plain_loop(spark):
    r = random.Random(6)
    docs = {i: " ".join(prose(i, 30, 60) + (["Vile", r.choice("xyz"), "rot!"] if i % 3 == 0 else [])) for i in range(240)} | {900: ""}
    labels = {i: int((i % 3 == 0) != (r.random() < 0.05)) for i in range(200)}
    table = spark.createDataFrame([(i, 0, t) for i, t in labels.items()], "doc_id bigint, quality int, toxic int")
    found = toxicity.toxicity(rows_of(spark, [(i, t, None) for i, t in docs.items()]), table).collect()
    want = plain_ftrl(docs, labels)
    assert {r.doc_id for r in found} == set(want)
    assert max(want.values()) > 0.7 > 0.3 > min(want.values())
    for row in found:
        assert row.score == pytest.approx(want[row.doc_id], abs=1e-6)


def test_labels_that_are_held_out_teach_nothing(spark):
    docs = rows_of(spark, [(i, " ".join(prose(i)), None) for i in range(60)])
    scores = []
    for lie in (0, 1):
        labels = [(i, 0, lie if zlib.crc32(str(i).encode()) % 3 == 1 else int(i % 2)) for i in range(60)]
        found = toxicity.toxicity(docs, spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int"))
        scores.append(sorted((r.doc_id, r.score) for r in found.collect()))
    assert scores[0] == scores[1]
    none = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    assert {r.score for r in toxicity.toxicity(docs, none).collect()} == {0.5}
    assert toxicity.toxicity(rows_of(spark, []), none).count() == 0


# language model


def plain_katz(rows):
    texts = [(i, (t or "").encode().lower().split() + [None]) for i, t, _ in rows]
    learnt = [zlib.crc32(("" if i is None else str(i)).encode()) % 5 != 1 for i, _ in texts]
    words, pairs, histories, followers = Counter(), Counter(), Counter(), defaultdict(set)
    for (_, ws), use in zip(texts, learnt, strict=True):
        for v, w in zip(["^", *ws], ws, strict=False):
            if use:
                words[w] += 1
                pairs[v, w] += 1
                histories[v] += 1
                followers[v].add(w)
    n = sum(words.values())

    def ranks(counts):
        out = np.zeros(katz.TRUSTED + 3, dtype=np.int64)
        for c in counts.values():
            out[min(c, katz.TRUSTED + 2)] += 1
        return out

    d1, d2 = katz.discounts(ranks(words)), katz.discounts(ranks(pairs))
    cut = lambda c, d: c * (d[c] if c <= katz.TRUSTED else 1)
    mass = sum(cut(c, d1) for c in words.values())
    total = n if mass < n else n + 1
    p = {w: cut(c, d1) / total for w, c in words.items()}
    unknown = 1 - sum(p.values())
    back = {}
    for v, ws in followers.items():
        kept = sum(cut(pairs[v, w], d2) for w in ws)
        size = histories[v] if kept < histories[v] - 1e-9 else histories[v] + 1
        back[v] = size, (size - kept) / size / (1 - sum(p[w] for w in ws))
        # known words and the unknown class sum to one after every history
        assert abs(kept / size + back[v][1] * (1 - sum(p[w] for w in ws)) - 1) < 1e-9
    out = []
    for (i, ws), use in zip(texts, learnt, strict=True):
        score = base = 0.0
        for v, w in zip(["^", *ws], ws, strict=False):
            if pairs[v, w]:
                x = cut(pairs[v, w], d2) / back[v][0]
            else:
                x = (back[v][1] if v in back else 1.0) * p.get(w, unknown)
            score += math.log10(x)
            base += math.log10((words[w] + 0.5) / (n + 0.5 * (len(words) + 1)))
        out.append((i, not use, len(ws), sum(words[w] > 0 for w in ws), n, round(base, 6), round(score, 6)))
    return sorted(out, key=str)


def katz_rows():
    rows = [(i, " ".join(prose(i, 20 + 3 * (i % 9), 80)), None) for i in range(150)]
    return rows + [(500, None, None), (501, "", "x"), (None, "w1 w2", "y"), (502, " new words only ", None), (3, rows[3][1], None), (503, "W1 É é\x0bw1", None), (504, "the " * 300, "z")]


@pytest.mark.parametrize("chunk,bucket,hot", [(1_600_000, 1_000_000, 100_000), (150, 200, 1000), (300, 100, 3), (1, 30, 500)])
def test_katz_in_any_split(spark, monkeypatch, chunk, bucket, hot):
    monkeypatch.setattr(katz, "HOT", hot)
    rows = katz_rows()
    found = katz.katz_scores(rows_of(spark, rows).repartition(3), chunk, bucket).collect()
    assert sorted(((*r[:5], round(r[5], 6), round(r[6], 6)) for r in found), key=str) == plain_katz(rows)


def test_katz_without_training_rows(spark):
    rows = [(i, "a b", None) for i in range(40) if zlib.crc32(str(i).encode()) % 5 == 1]
    found = katz.katz_scores(rows_of(spark, rows)).collect()
    assert len(found) == len(rows) and {(r.train_tokens, r.n_known, r.score) for r in found} == {(0, 0, 0.0)}
    assert katz.katz_scores(rows_of(spark, [])).count() == 0


@pytest.mark.parametrize("kind", ["<u8", "<i4", "<u1", "<f8"])
def test_packing(kind):
    for n in (0, 1, 7):
        values = np.arange(n).astype(kind)
        assert katz.unpacked(katz.packed(values), kind).tolist() == values.tolist()
    big = np.array([3, 2**40 - 1, 2**50 + 7], dtype=np.uint64)
    assert katz.unpacked(katz.packed(big, rising=True), "<u8", rising=True).tolist() == big.tolist()
    assert katz.unpacked(katz.packed(big, 5), "<u8", 5).tolist() == [3, 2**40 - 1, 7]


def test_the_model_beats_the_base(spark):
    found = katz.katz_scores(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).where("held_out").collect()
    assert sum(r.score for r in found) > sum(r.base_score for r in found) * 0.9


# token counts


def test_scan_of_flat_files_in_any_block(spark, tmp_path):
    r = random.Random(1)
    streams = [[r.choice([0, 1, 2, 9, 9]) for _ in range(n)] for n in (0, 1, 2, 50, 333, 1000)] + [[9] * 20, [1] * 40, [9], [0x0900, 9, 0x0009]]
    for i, s in enumerate(streams):
        (tmp_path / f"{i}.bin").write_bytes(np.array(s, dtype="<u2").tobytes())
    files = tokens.flat_files(spark, str(tmp_path))
    want = []
    for i, s in enumerate(streams):
        n = 0
        place = 0
        for t in s:
            if t == 9:
                want.append((i, place, n, True))
                n, place = 0, place + 1
            else:
                n += 1
        if n:
            want.append((i, place, n, False))
    for block in (1, 3, 64, 1 << 20):
        got = tokens.count_tokens(files, separator=9, block_tokens=block).collect()
        assert sorted((int(Path(x.path).stem), x.position, x.n_tokens, x.ended) for x in got) == want


def test_token_counts_of_documents(spark):
    import tiktoken

    rows = [(i, " ".join(prose(i)) + " ünï\n\n", "s") for i in range(30)] + [(90, None, None), (91, "", None), (None, "x", None), (92, "y z", None), (92, "y z", None), (93, "long " * 30_000, None)]
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, Path(tokens.VOCABULARY).read_bytes().splitlines())}
    plain = tiktoken.Encoding("plain", pat_str=tokens.PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = tokens.document_tokens(rows_of(spark, rows).repartition(4)).collect()
    assert Counter((r.doc_id, r.n_tokens) for r in got) == Counter((i, len(plain.encode_ordinary(t or ""))) for i, t, _ in rows)
    assert tokens.document_tokens(rows_of(spark, [])).count() == 0


# mixing


def test_knapsack_reaches_the_largest_sum():
    r = random.Random(3)
    for _ in range(60):
        sizes = r.sample(range(1, 30), 4)
        spare = [r.randrange(4) for _ in sizes]
        room = r.randrange(80)
        sums = {sum(n * s for n, s in zip(c, sizes, strict=True)) for c in product(*(range(m + 1) for m in spare))}
        got = knapsack(sizes, spare, room)
        assert sum(s * n for s, n in got.items()) == max(x for x in sums if x <= room)
        assert all(n <= spare[sizes.index(s)] for s, n in got.items())


def test_fit_stays_within_counts():
    r = random.Random(8)
    for _ in range(40):
        sizes = np.array(sorted(r.sample(range(0, 5000), 60)))
        counts = np.array([r.randrange(1, 40) for _ in sizes])
        total = int((sizes * counts).sum())
        target = r.random() * 3 * total
        passes, extra = fit(sizes, counts, target)
        assert (extra >= 0).all() and (extra <= counts).all() and passes + (extra > 0).any() <= 3
        assert abs(passes * total + int((sizes * extra).sum()) - target) <= 1


def test_few_long_documents_are_fitted():
    passes, extra = fit(np.array([40000, 40001, 40002]), np.array([1, 1, 1]), 42000.0)
    assert (passes, extra.tolist()) == (0, [0, 0, 1])
    r = random.Random(15)
    for _ in range(80):
        sizes = np.array(sorted(r.sample(range(30000, 60000), r.randrange(3, 8))))
        counts = np.array([r.randrange(1, 3) for _ in sizes])
        target = int(r.random() * int((sizes * counts).sum()))
        sums = {0}
        for s, n in zip(sizes.tolist(), counts.tolist(), strict=True):
            sums = {x + s * i for x in sums for i in range(n + 1)}
        passes, extra = fit(sizes, counts, float(target))
        assert passes == 0 and (extra >= 0).all() and (extra <= counts).all()
        assert int((sizes * extra).sum()) == max(x for x in sums if x <= target)


def test_a_large_knapsack_wastes_less_than_a_unit_a_document(monkeypatch):
    monkeypatch.setattr(mixing, "BITS", 1 << 16)
    r = random.Random(16)
    for _ in range(40):
        sizes = np.array(sorted(r.sample(range(30000, 60000), r.randrange(3, 9))))
        room = r.randrange(30000, int(sizes.sum()))
        sums = {0}
        for s in sizes.tolist():
            sums |= {x + s for x in sums}
        taken = mixing.subset(sizes, np.ones_like(sizes), room)
        got, unit = int((sizes * taken).sum()), -(-room * len(sizes) // mixing.BITS)
        assert (taken <= 1).all() and max(x for x in sums if x <= room) - unit * len(sizes) < got <= room


def plain_targets(sizes):
    names = sorted((s for s in sizes if s is not None), key=str.encode) + ([None] if None in sizes else [])
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    target, free, left = {}, set(names), float(sum(sizes.values()))
    while free:
        level = left / sum(weight[s] for s in free)
        over = {s for s in free if level * weight[s] > 3 * sizes[s]}
        if not over:
            target |= {s: level * weight[s] for s in free}
            break
        for s in over:
            target[s] = 3.0 * sizes[s]
            left -= target[s]
        free -= over
    return target


def mixing_rows():
    r = random.Random(6)
    rows = []
    for s, n in (("b", 300), ("a", 4), ("é", 30), ("B", 60), (None, 10), ("", 25), ("empty", 0)):
        rows += [(len(rows) + i, " ".join(["x"] * r.randrange(0, 40)), s) for i in range(n)]
    return rows + [(9000, None, "only null"), (9001, " \x0b\n ", "a"), (None, "x y", "b"), (9500, "x", "a"), (9500, "x", "a")]


def test_mix(spark):
    rows = mixing_rows()
    sizes = defaultdict(int)
    for _, t, s in rows:
        sizes[s] += len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    want = plain_targets(sizes)
    got = mix_documents(rows_of(spark, rows)).collect()
    again = mix_documents(rows_of(spark, rows).repartition(5)).collect()
    assert Counter(map(tuple, got)) == Counter(map(tuple, again))
    text = defaultdict(list)
    for i, t, s in rows:
        text[i].append((len(re.findall(r"[^\x20\x09-\x0D]+", t or "")), s))
    assert Counter((r.doc_id, r.size) for r in got) == Counter((i, n) for i, v in text.items() for n, _ in v)
    assert all(r.taken <= 3 * r.size for r in got)
    taken = defaultdict(int)
    source = {i: v[0][1] for i, v in text.items()}
    for r in got:
        s = source[r.doc_id]
        assert r.source_size == sizes[s] and abs(r.target - want[s]) < 1e-6
        taken[s] += r.taken
    assert all(abs(taken[s] - want[s]) <= max(2, 0.01 * want[s]) for s in taken)
    mixed = mixed_documents(rows_of(spark, rows))
    assert mixed.columns == ["doc_id", "text", "source", "score", "size", "times"] and {r.size for r in mixed.collect()} == {"z"}
    words = Counter()
    for r in mixed.collect():
        words[r.source] += len((r.text or "").split())
    assert {s: n for s, n in words.items() if n} == {s: n for s, n in taken.items() if n}
    assert mix_documents(rows_of(spark, [])).count() == mixed_documents(rows_of(spark, [])).count() == 0


def test_a_third_of_the_rows_has_one_source_and_length(spark):
    rows = [(i, "x y z" if i % 3 else " ".join(["x"] * (i % 50)), f"s{i % 7}" if i % 3 == 0 else "hot") for i in range(9000)]
    got = mix_documents(rows_of(spark, rows)).collect()
    taken, target = defaultdict(int), {}
    for r in got:
        s = rows[r.doc_id][2]
        taken[s] += r.taken
        target[s] = r.target
    assert all(abs(taken[s] - target[s]) <= 2 for s in target)


# chat

SAID = ["plain", "", None, "\\", "<", ">", "\\b\\l\\g", "</turn>\n", "<turn user>x</turn>\n", "\\### Assistant: </turn> ok", "a\nb\\", "é😀", "x" * 5000]


def test_conversations_are_read_back(spark):
    turns, conv = [], 0
    for roles in (["user", "assistant"], ["system", "user", "assistant", "user", "assistant"], ["assistant"], ["user"], ["system"], [None, "us<er"], ["user", "user"], ["user", "assistant", "tool", "assistant"]):
        for k in range(len(SAID)):
            conv += 1
            turns += [(conv, i, r, SAID[(k + i) % len(SAID)]) for i, r in enumerate(roles)]
    turns += [(900, i, ("user", "assistant")[i % 2], f"t{i}") for i in range(300)] + [(None, 0, "user", "hi"), (901, None, "assistant", "last"), (901, 2, "user", "first"), (902, 1, "user", "b"), (902, 1, "user", "a"), (902, 1, "user", "a")]
    table = spark.createDataFrame([(*t, "x", True) for t in turns], "conv_id bigint, turn bigint, role string, text string, formatted string, valid boolean")
    got = {r.conv_id: r for r in chat.chat_digest(table).collect()}
    both = "\\### Assistant: </turn> ok"
    by = defaultdict(list)
    for c, n, r, t in [*turns, (-7, 0, "user", both), (-7, 1, "assistant", both)]:
        by[c].append((n is None, n or 0, r or "", t or ""))
    assert set(got) == set(by)
    for c, ts in by.items():
        ts.sort()
        lines = "".join(f"{r}\n{t}\n" for _, _, r, t in ts)
        loss = "".join(t for _, _, r, t in ts if r == "assistant")
        seen = got[c]
        assert (seen.n_turns, seen.turns_sha256) == (len(ts), hashlib.sha256(lines.encode()).hexdigest())
        assert (seen.loss_chars, seen.loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
        state = "start"
        for _, _, r, _ in ts:
            state = chat.MOVES.get((state, r), "failed")
        assert (seen.state, seen.valid) == (state, state in chat.COMPLETE)
    assert chat.chat_digest(table.limit(0)).count() == 1  # the trial conversation alone


def test_segments_carry_loss_for_assistants_alone(spark):
    table = spark.createDataFrame([(1, 0, "system", "s"), (1, 1, "user", "<u>"), (1, 2, "assistant", "a\\")], "conv_id bigint, turn bigint, role string, text string")
    row = chat.format_conversations(table).first()
    assert [(s.text, s.loss) for s in row.segments] == [
        ("<turn system>", False), ("s", False), ("</turn>\n", False), ("<turn user>", False), ("\\lu\\g", False), ("</turn>\n", False),
        ("<turn assistant>", False), ("a\\b", True), ("</turn>\n", False),
    ]
    assert row.formatted == "".join(s.text for s in row.segments) and row.valid


# pipeline


def test_pipeline_stages(spark):
    import corpus_pipeline as pipeline

    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, sizes = docs.columns, [docs.count()]
    from cueline.llm.common import stored

    for name, stage in pipeline.STAGES[:-1]:
        before = {r.doc_id for r in docs.collect()}
        docs = stored(stage(spark, docs, folder))
        after = [r.doc_id for r in docs.collect()]
        assert docs.columns == columns and set(after) <= before, name
        sizes.append(len(after))
    assert sizes[0] > sizes[1] > sizes[2] > sizes[3] > 0
    found = pipeline.run(spark, folder).collect()
    assert len(found) == sizes[-1]
    assert set(found[0].asDict()) == {*columns, "shard", "slot"}
    places = Counter(r.shard for r in found)
    assert len(places) == pipeline.SHARDS and max(places.values()) - min(places.values()) <= 1


def test_pipeline_on_messy_and_empty_rows(spark, tmp_path):
    import corpus_pipeline as pipeline

    rows = [(i, " ".join(prose(i)), "en", f"s{i % 3}", None) for i in range(20)] + [(None, None, None, None, None), (3, "", "en", "s1", 0), (3, "", "en", "s1", 0)]
    for name, kept in (("messy", rows), ("none", [])):
        folder = f"{tmp_path}/{name}"
        spark.createDataFrame(kept, "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(f"{folder}/documents.parquet")
        spark.createDataFrame([], "doc_id bigint, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
        spark.createDataFrame([(1, "no such text"), (2, None)], "item_id bigint, text string").write.parquet(f"{folder}/benchmark.parquet")
        found = pipeline.run(spark, folder).collect()
        assert bool(found) == bool(kept)


def test_words_are_counted_once_for_a_mix(spark, tmp_path):
    """sizes, plan and ranks come from one written table, with the count of words as before."""
    from pyspark.sql import functions as F

    from cueline.llm.common import word_count, words

    texts = [None, "", " ", "a", "\x0b a\tb\n", "à\u0085b  c d", "𝄞 x\r\ny", " \x1f \x0c", "one two  three "]
    rows = [(i, t, ["s", "t", None][i % 3], "en", len(t or "")) for i, t in enumerate(texts * 4)]
    schema = "doc_id bigint, text string, source string, lang string, n_chars bigint"
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    assert all(a == b for a, b in docs.select(word_count(F.col("text")), F.size(words(F.col("text")))).collect())
    for mixed in (mix_documents(docs), mixed_documents(docs)):
        assert not any("documents" in f for f in mixed.inputFiles())
