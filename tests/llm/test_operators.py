"""The training-data operators on small tables with every odd case, against brute force."""

import collections
import hashlib
import math
import os
import random
import re
import zlib

import numpy as np
import pytest
from marginalia.llm import common, embedding_dup, flac, licenses, mixing, near_dup, packing, quality, token_count, toxicity, training_order

DOCS = "doc_id long, text string, source string, length int, shard string, score double, n int"
WORDS = [f"w{i}" for i in range(400)]


def _text(r, n):
    return " ".join(r.choice(WORDS) for _ in range(n))


def _mutate(r, text, share):
    words = text.split()
    for i in range(len(words)):
        if r.random() < share:
            words[i] = r.choice(WORDS)
    return " ".join(words)


@pytest.fixture(scope="module")
def rows():
    r = random.Random(11)
    out = [(None, "no id", "a"), (1, None, "a"), (2, "", None), (3, " \t\n", "b"), (4, "one two", "b"), (5, "One  TWO", "b"), (6, "É é", None), (7, "é É", "c")]
    n = 10
    for _ in range(10):
        base = _text(r, r.randint(20, 120))
        for k in range(r.choice([1, 2, 6])):
            out.append((n, base if k == 1 else _mutate(r, base, 0.004 * k), r.choice(["a", "a", "b", None])))
            n += 1
    out.append((n, _text(r, 6000), "a"))
    out += [out[-1], out[12]]
    return out


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame([(i, t, s, 7, "x", 0.5, 9) for i, t, s in rows], DOCS)


def _shingles(text):
    low = (text or "").translate({c: c + 32 for c in range(65, 91)})
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def _components(nodes, edges):
    label = {n: n for n in nodes}
    changed = True
    while changed:
        changed = False
        for a, b in edges:
            m = min(label[a], label[b])
            changed |= label[a] != m or label[b] != m
            label[a] = label[b] = m
    return label


def test_near_duplicates_equal_brute_force(docs, rows):
    got = near_dup.near_duplicates(docs).collect()
    assert len(got) == len(rows)
    sets = {i: _shingles(t) for i, t, _ in rows if i is not None}
    ids = sorted(sets)
    edges = [(a, b) for a in ids for b in ids if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 70 * len(sets[a] | sets[b])]
    label = _components(ids, edges)
    assert edges
    for r in got:
        if r.doc_id is None:
            assert r.n_shingles == 0 and r.component_id is None
        else:
            assert (r.n_shingles, r.component_id, r.kept) == (len(sets[r.doc_id]), label[r.doc_id], label[r.doc_id] == r.doc_id), r


def test_long_texts_in_pieces_equal_brute_force(spark, docs, rows, monkeypatch):
    monkeypatch.setattr(near_dup, "LONG", 400)
    monkeypatch.setattr(near_dup, "PIECE", 90)
    r = random.Random(12)
    base = [r.choice(WORDS) + str(r.randrange(30)) for _ in range(300)]
    near = base[:]
    near[40] = near[200] = "Anders"
    # copies that differ in space and case, a repeated passage, a near copy twice, few giant words, nothing but space, a shorter near copy
    texts = [" ".join(base), " \n" * 99 + "\t\t".join(base).upper() + " " * 200, " ".join(base + base[:90]), " ".join(near), " ".join(near), "x" * 900 + " y", " " * 900, " ".join(base[:230]), ("z" * 95 + " ") * 9]
    more = [(5000 + i, t) for i, t in enumerate(texts)] + [(5003, " ".join(near)), (None, " ".join(base))]
    table = docs.select("doc_id", "text").unionByName(spark.createDataFrame(more, "doc_id long, text string"))
    whole, pieces = near_dup._split(table)
    assert pieces.count() > 30 and whole.where("octet_length(text) > 400 and text rlike '(\\\\S+\\\\s+){4}\\\\S'").count() == 0
    sets = {i: _shingles(t) for i, t in [x[:2] for x in rows] + more if i is not None}
    assert max(map(len, sets.values())) > 300 > 90 > max(len(x.s) for x in pieces.collect())
    ids = sorted(sets)
    label = _components(ids, [(a, b) for a in ids for b in ids if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 70 * len(sets[a] | sets[b])])
    assert len({label[5000 + i] for i in (0, 1, 2, 3, 4, 7)}) < 3
    got = near_dup.near_duplicates(table).collect()
    assert len(got) == len(rows) + len(more)
    for x in got:
        if x.doc_id is not None:
            assert (x.n_shingles, x.component_id) == (len(sets[x.doc_id]), label[x.doc_id]), x


def test_hot_buckets_in_chunks_lose_no_link(docs):
    _, plain = near_dup.components(docs)
    _, split = near_dup.components(docs, first_bands=1, chunk=2)
    assert sorted(map(tuple, plain.collect())) == sorted(map(tuple, split.collect()))


def test_classes_apart_meet_once_in_every_bucket(spark):
    # one bucket: a component of forty, one of seven and three alone; all alike, but one in its size and one in its sketch
    r = random.Random(2)
    ids = [(i, 100, 0) for i in range(40)] + [(i, 100, 50) for i in range(50, 57)] + [(60, 100, 60), (61, 10, 61), (62, 100, 62)]
    known = spark.createDataFrame([(5, i, n, c) for i, n, c in ids], "h long, cid long, n long, label long")
    same, other = [r.getrandbits(62) for _ in range(6)], [r.getrandbits(62) for _ in range(6)]
    sketches = spark.createDataFrame([(i, other if i == 62 else same) for i, _, _ in ids], "cid long, sketch array<long>")
    want = {(a, b) for a, n, c in ids for b, m, d in ids if a < b and c != d and n == m and 62 not in (a, b)}
    for chunk in (1, 3, 1000):
        got = near_dup._apart(known, sketches, 96, 70, chunk).collect()
        assert sorted((r.a, r.b) for r in got) == sorted(want)


def test_components_of_a_chain_and_a_star(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, j) for j in range(101, 140)] + [(7, 7)]
    got = {r.node: r.label for r in common.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, **{j: 100 for j in range(100, 140)}}


def test_packing_is_whole_and_gapless(docs, rows):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(packing.default_path())
    cap = 256
    want = collections.Counter()
    for i, text, _ in rows:
        ids = t.encode(text or "", add_special_tokens=False).ids + [1]
        for k in range(0, len(ids), cap):
            part = ids[k : k + cap]
            want[(i, k // cap, k, len(part), zlib.crc32(np.array(part, "<u4").tobytes()))] += 1
    got = packing.pack(docs, capacity=cap).collect()
    assert collections.Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    bins = collections.defaultdict(list)
    for r in got:
        bins[r.sequence_id].append((r.offset, r.length))
    for items in bins.values():
        at = 0
        for offset, length in sorted(items):
            assert offset == at
            at += length
        assert at <= cap
    decreasing = []  # no worse than first-fit decreasing
    for n in sorted((r.length for r in got), reverse=True):
        k = next((k for k, room in enumerate(decreasing) if room >= n), None)
        if k is None:
            decreasing.append(cap - n)
        else:
            decreasing[k] -= n
    assert len(bins) <= len(decreasing)


def test_mix_comes_near_its_targets(docs, rows):
    got = mixing.mix(docs).collect()
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    assert sorted((r.doc_id or -1, r["size"]) for r in got) == sorted((i or -1, size(t)) for i, t, _ in rows)
    own = collections.Counter()
    for i, t, s in rows:
        own[s] += size(t)
    order = sorted((s for s in own if s is not None)) + [None]
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    target, free, rest = {}, set(order), 1.5 * sum(own.values())
    while True:
        share = rest / sum(weight[s] for s in free)
        full = [s for s in free if share * weight[s] >= 2 * own[s]]
        if not full:
            target |= {s: share * weight[s] for s in free}
            break
        for s in full:
            target[s] = 2.0 * own[s]
            rest -= target[s]
            free.discard(s)
        if not free:
            break
    by_target = {round(target[s], 6): s for s in order}
    taken = collections.Counter()
    for r in got:
        s = by_target[round(r.target, 6)]
        assert r.source_size == own[s] and r.taken % max(1, r["size"]) == 0 and r.taken <= 2 * r["size"]
        taken[s] += r.taken
    for s in order:
        assert target[s] - max(size(t) for _, t, q in rows if q == s) <= taken[s] <= target[s] + 1
    assert sorted(map(tuple, got), key=str) == sorted(map(tuple, mixing.mix(docs.repartition(7)).collect()), key=str)
    copies = mixing.mixed(docs.withColumnRenamed("n", "mix_shard"))
    assert copies.columns == ["doc_id", "text", "source", "length", "shard", "score", "mix_shard", "mix_shard_", "mix_position"]
    mixed = copies.collect()
    assert len(mixed) == sum(r.taken // r["size"] for r in got if r["size"]) and {(r.shard, r.score, r.mix_shard) for r in mixed} == {("x", 0.5, 9)}
    # every document lies in the shards that drew it, and each partition is one shard in the order of positions
    drawn = collections.Counter((r.doc_id, int(s)) for r in got for s in r.shards.split(",") if s)
    assert collections.Counter((r.doc_id, r["mix_shard_"]) for r in mixed) == drawn
    assert [(r["mix_shard_"], r.mix_position) for r in mixed] == sorted((r["mix_shard_"], r.mix_position) for r in mixed)


def test_mix_takes_what_the_leaves_draw(docs, monkeypatch):
    # leaves that are left out are words that aren't taken: the tree alone decides
    whole = mixing.split_tree
    monkeypatch.setattr(mixing, "BLOCK_DOCS", 3)
    before = sum(r.taken for r in mixing.mix(docs).collect())
    monkeypatch.setattr(mixing, "split_tree", lambda *a: [leaf for leaf in whole(*a) if leaf[1] % 2])
    kept = mixing.mix(docs).collect()
    assert 0 < sum(r.taken for r in kept) < before and {int(s) % 2 for r in kept for s in r.shards.split(",") if s} == {1}
    leaves = whole({0: 1000, 1: 7}, 5, 3)
    for key, n in ((0, 1000), (1, 7)):
        runs = sorted(leaf[2:] for leaf in leaves if leaf[0] == key)
        assert runs[0][0] == 0 and runs[-1][1] == n and all(a[1] == b[0] for a, b in zip(runs, runs[1:]))
    by_shard = collections.Counter()
    for _, shard, first, end in leaves:
        by_shard[shard] += end - first
    assert max(by_shard.values()) - min(by_shard.values()) <= 1


def test_mix_of_equal_rows(spark):
    # half of all rows are the same one, and sources are many
    rows = [(1, "a b c", "hot")] * 300 + [(i, "d e", f"s{i % 40}") for i in range(2, 302)]
    got = mixing.mix(spark.createDataFrame(rows, "doc_id int, text string, source string")).collect()
    taken = collections.Counter()
    for r in got:
        taken[r.target, r.source_size] += r.taken
    hot = next(r for r in got if r.doc_id == 1)
    assert len(got) == 600 and hot.target - 3 <= taken[hot.target, 900] <= hot.target + 1


def test_training_order_shards(docs, rows, tmp_path, monkeypatch):
    out = f"file://{tmp_path}/shards"
    got = training_order.write_shards(docs, out=out, sequence=64, shard_slots=32).collect()
    assert sorted(r.slot for r in got) == list(range(len(got)))
    ids = training_order.read_slots(out, 0, len(got))
    assert sorted(os.listdir(f"{tmp_path}/shards")) == ["manifest.json", *sorted({f"shard-{r.shard:08d}.bin" for r in got})]
    sizes = collections.Counter(r.shard for r in got)
    assert len(sizes) > 3 and all(os.path.getsize(f"{tmp_path}/shards/shard-{k:08d}.bin") == 128 * n for k, n in sizes.items())
    from tokenizers import Tokenizer

    # the tokenizer's own ids, cut by hand, are what the slots hold
    t, want = Tokenizer.from_file(packing.default_path()), collections.Counter()
    for i, text, _ in rows:
        whole = t.encode(text or "", add_special_tokens=False).ids + [1]
        want.update((i, k // 64, tuple(whole[k : k + 64])) for k in range(0, len(whole), 64))
    assert collections.Counter((r.doc_id, r.chunk, tuple(ids[r.slot][: r.n_tokens].tolist())) for r in got) == want
    for r in got:
        record = ids[r.slot]
        assert zlib.crc32(record[: r.n_tokens].tobytes()) == r.ids_crc32 and not record[r.n_tokens :].any()
    assert (training_order.read_slots(out, 20, 30) == ids[20:50]).all()
    # fewer writers than shards: each writes several in turn
    monkeypatch.setattr(training_order, "WRITERS", 3)
    training_order.write_shards(docs.coalesce(1), out=out + "-few", sequence=64, shard_slots=32).collect()
    assert len(os.listdir(f"{tmp_path}/shards-few")) > 4 and len(training_order.read_slots(out + "-few", 0, len(got))) == len(got)
    by_doc = collections.Counter(r.doc_id for r in got)
    assert by_doc[1] == 1 and by_doc[rows[-3][0]] > 100


def test_media_digests(docs, rows):
    got = flac.media(docs, keep_media=True).collect()
    assert len(got) == len(rows)
    texts = {i: t for i, t, _ in rows}
    for r in got:
        raw = (texts[r.doc_id] or "").encode()
        payload = raw + bytes(-len(raw) % 64 if raw else 64)
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
        assert r.media_sha256 == hashlib.sha256(r.media).hexdigest() and r.media_bytes == len(r.media)
        assert bytes(v + 128 for v in flac.decode(bytes(r.media))[0][0]) == payload


def test_pcm_blocks_of_a_column(spark, docs):
    from pyspark.sql import functions as F

    made = flac.media(docs.where("doc_id is not null").dropDuplicates(["doc_id"]), keep_media=True).select("doc_id", "media", F.lit(1).alias("pcm"))
    whole = made.unionByName(spark.createDataFrame([(-1, None, 1), (-2, b"no stream", 1)], made.schema))
    got = flac.pcm_blocks(whole).collect()
    by_doc = collections.defaultdict(list)
    for r in got:
        by_doc[r.doc_id].append(r)
    assert -1 not in by_doc and [r.error is not None for r in by_doc.pop(-2)] == [True]
    streams = {r.doc_id: bytes(r.media) for r in made.collect()}
    assert by_doc.keys() == streams.keys() and max(map(len, by_doc.values())) > 5
    for i, found in by_doc.items():
        found.sort(key=lambda r: r.block)
        x = [v - 256 * (v > 127) for r in found for v in r.pcm]
        assert x == flac.decode(streams[i])[0][0] and all(r.error is None for r in found)
        last = found[-1]
        assert flac.seek(streams[i], last.first_sample, last.n_samples) == x[last.first_sample :]


def test_token_counts(docs, rows):
    c = token_count.UnigramCounter(*token_count.vocabulary(token_count.default_path()))
    assert sorted((r.doc_id or -1, r.n_tokens) for r in token_count.token_counts(docs).collect()) == sorted((i or -1, c.best("▁" + t.replace(" ", "▁"))[0] if t else 0) for i, t, _ in rows)


def _cosines(rows, got, cosine=0.9):
    """Compare (vec_id, vector) rows of finite vectors with brute force, in any width."""
    unit = {i: np.array(v) / np.abs(v).max() for i, v in rows}
    unit = {i: v / np.sqrt((v**2).sum()) for i, v in unit.items()}
    ids = sorted(unit)
    edges = [(a, b) for k, a in enumerate(ids) for b in ids[:k] if len(unit[a]) == len(unit[b]) and unit[a] @ unit[b] >= cosine]
    label, degree = _components(ids, edges), collections.Counter(v for e in edges for v in e)
    for i in ids:
        assert (got[i].n_links, got[i].component_id, got[i].kept) == (degree[i], label[i], label[i] == i), i
    return edges


@pytest.mark.parametrize("block_bytes, tiles", [(64 * 64, 256), (64 * 64, 3), (1 << 24, 256)])
def test_embeddings_equal_brute_force(spark, block_bytes, tiles):
    r = np.random.default_rng(4)
    base = r.normal(size=(15, 8))
    x = [(base[k % 15] + (0.12 * r.normal(size=8) if k > 40 else 0.0)).tolist() for k in range(300)]
    x += [(base[0] + 0.01 * r.normal(size=8)).tolist() for _ in range(150)]  # a third of all rows near one another
    odd = [(900, None), (901, [0.0] * 8), (902, [float("nan")] + [1.0] * 7), (903, [None] + [1.0] * 7), (None, x[0]), (904, []), (907, [float("inf")] + [1.0] * 7)]
    # components far beyond the squares that a double holds
    plain = [*enumerate(x), (905, [1.0, 2.0]), (906, [2.0, 4.0]), (910, [1e-200, 0.0]), (911, [1e-200, 0.0]), (912, [1.0, 0.0]), (913, [1.0, 0.1]), (914, [1e200, 0.0]), (915, [1e200, 1e199]), (916, [5e-324, 5e-324])]
    rows = [(i, v, 1) for i, v in odd + plain]
    found = embedding_dup.embedding_near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, copies int"), block_bytes=block_bytes, tiles=tiles).collect()
    got = {q.vec_id: q for q in found}
    assert len(found) == len(rows) and len(_cosines(plain, got)) > 5000
    for i, _ in odd:
        assert (got[i].n_links, got[i].component_id) == (0, i)


def test_embedding_tiles_prune_separate_clusters():
    r = np.random.default_rng(6)
    c = embedding_dup.units(r.normal(size=(6, 32)))
    x = embedding_dup.units(np.repeat(c, 50, 0) + 0.02 * r.normal(size=(300, 32)))
    own, mask = embedding_dup.reached(x, embedding_dup.centres(x, 6), 0.9)
    assert len(set(own)) == 6 and mask.sum() == 300  # each vector goes to its own tile only


def test_hypergeometric_law_beyond_enumeration():
    r, good, bad, n = random.Random(3), 200, 999_800, 3_000
    p = [math.comb(good, k) * math.comb(bad, n - k) / math.comb(good + bad, n) for k in range(4)]
    got = [mixing.hypergeometric(r, good, bad, n) for _ in range(20_000)]
    for k, share in enumerate(p):
        assert abs(got.count(k) / len(got) - share) < 5 * (share / len(got)) ** 0.5
    big = [mixing.hypergeometric(r, 400_000, 600_000, 500_000) for _ in range(100)]
    assert abs(sum(big) / 100 - 200_000) < 5 * 245 / 10 and all(abs(x - 200_000) < 6 * 245 for x in big)
    assert mixing.hypergeometric(r, 60_000, 5, 60_000) >= 59_995 and mixing.hypergeometric(r, 60_000, 0, 30_000) == 30_000


def test_licenses(spark):
    mit = [t for i, t in licenses.KNOWN if i == "MIT"][-1]
    rows = [(1, "Copyright (c) 2020 Someone\n\n" + mit.upper().replace("COPYRIGHT HOLDERS", "Copyright Holder"), 0), (2, "text\nreleased under the MIT licence\nmore", 0), (3, None, 0), (4, "...", 0), (None, "x", 0), (2, "text\nreleased under the MIT licence\nmore", 0)]
    got = {r.doc_id: r for r in licenses.license_scan(spark.createDataFrame(rows, "doc_id long, text string, digest int")).collect()}
    assert got[1].license_id == "MIT" and got[2].license_id is None and got[2].notices == "MIT" and got[3].digest is None and got[4].digest is None and got[None].notices == ""


def test_licenses_whole_texts(spark):
    from marginalia.llm.license_registry import TEXTS

    mit = [t for i, t in licenses.KNOWN if i == "MIT"][-1]
    files = {"Apache-2.0": "Apache-2.0", "GPL-2": "GPL-2.0", "GPL-3": "GPL-3.0", "LGPL-2.1": "LGPL-2.1", "LGPL-3": "LGPL-3.0", "MPL-2.0": "MPL-2.0", "CC0-1.0": "CC0-1.0", "BSD": "BSD-3-Clause"}
    cases = [((TEXTS / f).read_text(), i) for f, i in files.items()]
    cases += [(" ".join(t.split()), i) for t, i in cases if i in ("Apache-2.0", "MPL-2.0", "CC0-1.0")]
    cases += [(t.partition("END OF TERMS AND CONDITIONS")[0] + "END OF TERMS AND CONDITIONS\n", i) for t, i in cases[:4]]
    cases += [(f"{title}\n\nCopyright (c) 2020-2024 Jane Doe, Inc. <j@x.org>\n\n{mit}", "MIT") for title in ("MIT License", "The MIT License (MIT)")]
    cases += [(" ".join(f"Copyright (c) 2020 Acme, Inc. All rights reserved. {mit}".split()), "MIT"), (f"Copyright The Project Authors\n{mit}", "MIT"), ("Copyright 2021 A. Author. Licensed under the MIT License.", "MIT")]
    got = {r.doc_id: r for r in licenses.license_scan(spark.createDataFrame([(k, t) for k, (t, _) in enumerate(cases)], "doc_id long, text string")).collect()}
    assert [got[k].license_id for k in range(len(cases))] == [i for _, i in cases]
    kept = [(0, "Copyright law differs between the two states."), (1, "(c) You must retain all notices"), (2, "Copyright (c) 2020 X\nAll rights reserved."), (3, "COPYRIGHT OWNER OR CONTRIBUTORS BE LIABLE FOR ANY")]
    digests = {r.doc_id: r.digest for r in licenses.license_scan(spark.createDataFrame(kept, "doc_id long, text string")).collect()}
    assert digests[0] and digests[1] and digests[2] is None and digests[3]


def test_licenses_ties_long_texts_and_telling_words(spark):
    mit = [t for i, t in licenses.KNOWN if i == "MIT"][-1]
    known = spark.createDataFrame([("B", "Some notice about a licence."), ("A", "some NOTICE, about a license"), ("C", "4 0 by nc")], "license_id string, text string")
    long = "filler words go on\n" * 120_000
    rows = [(1, "Some notice about a licence", "x"), (2, long + "some notice: about a licence!\n" + long, "y"), (3, "x\n4.0 by-nc\n", "z"), (4, long, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, license_id string")
    got = {r.doc_id: r for r in licenses.license_scan(docs, known).collect()}
    assert got[1].license_id == "A" and got[2].notices == "A" and got[2].license_id is None and got[3].notices == "C" and got[4].notices == ""
    from pyspark.sql import functions as F

    # the texts have telling words, and each of these occurs in lower case in every way to write the text
    from marginalia.llm.license_registry import registry

    texts = registry(licenses.KNOWN)
    df = spark.createDataFrame(texts, "license_id string, text string")
    told = licenses.telling_words([r.c for r in df.select(licenses.canonical(F.col("text")).alias("c")).collect()])
    assert told and len(told) < 12 and df.where(~licenses._holds(F.col("text"), told)).count() == 0
    assert licenses.telling_words(["under the license", "4 0"]) is None
    whole = licenses.license_scan(spark.createDataFrame([(1, long + mit)], "doc_id long, text string")).first()
    assert whole.license_id is None


def _labelled(spark):
    r = random.Random(8)
    rows, labels = [], []
    for i in range(400):
        toxic, poor = i % 5 == 0, i % 7 == 0
        words = [r.choice(WORDS[:60]) for _ in range(30)]
        if toxic:
            words[r.randrange(30)] = r.choice(["vilefoo", "vilebar", "vilebaz"])
        text = " ".join(words) + "."
        rows.append((i, text.upper().replace(" ", "!! ") if poor else text, "s", 1, "x", 0.1, 2))
        labels.append((i, int(not poor), int(toxic)))
    rows += [(None, None, None, 1, "x", 0.1, 2), (1000, "", None, 1, "x", 0.1, 2), rows[3]]
    labels += [(None, 1, 1), (5, None, None), (1, 0, 1), (1, 1, 0)]
    return spark.createDataFrame(rows, DOCS), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


@pytest.mark.parametrize("function, label, divisor, held", [(quality.quality, 1, 5, 0), (toxicity.toxicity, 2, 4, 2)])
def test_classifiers_on_held_out_rows(spark, function, label, divisor, held):
    docs, labels = _labelled(spark)
    got = function(docs, labels).collect()
    assert len(got) == 403
    truth = {r[0]: r[label] for r in labels.where("doc_id <> 1 and doc_id <> 5").collect()}
    right = [r.predicted == truth[r.doc_id] for r in got if r.held_out and r.doc_id in truth]
    assert sum(right) / len(right) > 0.97
    for r in got:
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % divisor == held)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3)
    # labels of held-out rows teach nothing
    from pyspark.sql import functions as F

    flipped = labels.withColumn("toxic", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, 1 - F.col("toxic")).otherwise(F.col("toxic"))).withColumn("quality", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, 1 - F.col("quality")).otherwise(F.col("quality")))
    assert sorted((r.doc_id or -1, r.score) for r in function(docs, flipped).collect()) == sorted((r.doc_id or -1, r.score) for r in got)


def test_quality_learns_from_every_labelled_row(spark):
    import numpy as np

    r = random.Random(4)
    rows = [(i, " ".join(r.choice(WORDS[:60]) + r.choice(["", "", "!!", "7"]) * (i % 4 == 0) for _ in range(r.randrange(1, 9))), int(i % 4 != 0 or i % 3 == 0)) for i in range(19_000)]
    texts = {i: t for i, t, _ in rows}
    texts[2] = min(texts[2], "A b c")
    docs = spark.createDataFrame([x[:2] for x in rows] + [(2, "A b c"), (2, None), (3, texts[3]), (None, "x y"), (99_999, "not labelled")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows] + [(5, 0), (5, 1), (None, 1), (88_888, 1)], "doc_id long, quality int")
    used = [(y, texts[i]) for i, _, y in rows if i != 5 and zlib.crc32(str(i).encode()) % 5 != 0]
    assert sum(y for y, _ in used) > 12_500
    x, y = np.array([quality.features(t) for _, t in used]), [y for y, _ in used]
    want, got = quality.fit(x, y), quality.train(docs, labels)
    assert np.allclose(got.mean, x.mean(0), rtol=1e-9) and np.allclose(got.spread, want.spread, rtol=1e-9)
    assert np.allclose(got.weights, want.weights, atol=3e-6)
    assert got.cut == pytest.approx(want.cut, abs=1e-4) and got.scale == pytest.approx(want.scale, rel=1e-4)


def test_python_batches_are_bounded_by_bytes(spark):
    class Counted:
        def score(self, rows):
            return [float(len(rows))] * len(rows)

    docs = spark.range(40, numPartitions=1).selectExpr("id as doc_id", "if(id = 7, repeat('ab ', 2000000), repeat('ab ', 200000)) as text")
    bound = spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch", None)
    try:
        spark.conf.unset("spark.sql.execution.arrow.maxBytesPerBatch")
        sizes = {r.doc_id: r.score for r in quality.scored(docs, Counted()).select("doc_id", "score").collect()}
        assert len(sizes) == 40 and max(sizes.values()) <= 8  # of 0.6 MB, in 4 MB
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "1000000")  # a session's own bound stands
        assert max(r.score for r in quality.scored(docs, Counted()).collect()) == 2
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxBytesPerBatch")
        if bound:
            spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", bound)


def test_workers_drop_encoders_for_other_work(spark):
    def held(batches):
        import pyarrow as pa
        from marginalia.llm import tokens

        for _ in batches:
            yield pa.RecordBatch.from_arrays([pa.array([len(tokens._ENCODERS)])], ["n"])

    docs = spark.range(8, numPartitions=4).selectExpr("id as doc_id", "concat('some words ', id) as text")
    assert packing.pack(docs).count() == 8
    assert {r.n for r in docs.mapInArrow(held, "n long").collect()} == {1}
    labels = docs.selectExpr("doc_id", "cast(doc_id % 2 as int) as quality")
    assert quality.quality(docs, labels).count() == 8
    assert {r.n for r in docs.mapInArrow(held, "n long").collect()} == {0}


def test_tables_made_by_the_driver_start_no_python_workers(spark):
    made = common.local_table(spark, [(1, None), (2, 0.5)], "a int, b double")
    assert made.dtypes == [("a", "int"), ("b", "double")] and sorted(map(tuple, made.collect())) == [(1, None), (2, 0.5)]
    assert common.local_table(spark, [], "a int, b string").count() == 0
    docs = spark.range(50).selectExpr("id as doc_id", "concat('some words ', id) as text", "cast(id % 3 as string) as source")
    for df in (packing.pack(docs), mixing.mixed(docs)):
        assert "LogicalRDD" not in df._jdf.queryExecution().optimizedPlan().toString()


def test_empty_tables(spark, docs):
    none = docs.limit(0)
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert near_dup.near_duplicates(none).count() == 0
    assert packing.pack(none).count() == 0
    assert mixing.mix(none).count() == 0 and mixing.mixed(none).count() == 0
    assert training_order.write_shards(none).count() == 0
    assert flac.media(none).count() == 0
    assert token_count.token_counts(none).count() == 0
    assert licenses.license_scan(none).count() == 0
    assert quality.quality(none, labels).count() == 0 and toxicity.toxicity(none, labels).count() == 0
    assert quality.quality(docs, labels).count() == docs.count() and toxicity.toxicity(docs, labels).count() == docs.count()
    assert embedding_dup.embedding_near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0
