"""The parts of the training-data operators that need no Spark."""

import collections
import itertools
import random
import struct

import numpy as np
import pytest
from marginalia.llm import embedding_dup, flac, packing, quality, token_count, tokens, toxicity, training_order
from marginalia.llm.mixing import split_tree

TEXTS = ["", "It's we'll 12½ 3", "a  b\n\tc", "Çà et là, ÉTÉ!", "ΣΑΣ İx", "a\x1cb", "é́ x", "日本 語", "<|endoftext|> x", "don't ***what*** | a | b", "a b c", "“quote” – dash…"]


def test_word_encoder_equals_the_tokenizer():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokens.default_path())
    e = tokens.WordEncoder(tokens.default_path(), memo_words=3)
    for text in TEXTS * 2:
        assert np.frombuffer(e.encode(text), "<u4").tolist() == t.encode(text, add_special_tokens=False).ids, text
    assert e.encode(None) == b""


def test_unigram_counts_equal_the_libraries():
    from tokenizers import Tokenizer, models

    pieces, fallback = token_count.vocabulary(token_count.default_path())
    c = token_count.UnigramCounter(pieces, fallback)
    u = Tokenizer(models.Unigram([("<unk>", 0.0)] + [(f"<0x{i:02X}>", -1e12) for i in range(256)] + list(pieces.items()), unk_id=0, byte_fallback=True))
    for text in TEXTS + ["the quick brown fox " * 50, "🎉x🎉🎉", "aaaaaaaaaaaaa"]:
        want = len(u.encode(token_count.SPACE + text.replace(" ", token_count.SPACE)).ids) if text else 0
        assert c.count(text)[0] == want, text


def test_viterbi_keeps_the_first_of_equal_ways():
    c = token_count.UnigramCounter({"a": -1.0, "b": -1.0, "ab": -2.0, "▁": -1.0}, False)
    assert c.best("ab") == (1, -2.0)  # two pieces score the same but start later
    assert c.best("axb")[0] == 3


def test_maximal_segments_equal_brute_force():
    def slow(scores):
        # Ruzzo and Tompa: the best segment, then the same on both sides
        if not scores or max(scores) <= 0:
            return []
        best = max(((sum(scores[i:j]), -(j - i), -i) for i in range(len(scores)) for j in range(i + 1, len(scores) + 1)))
        i, j = -best[2], -best[2] - best[1]
        left, right = slow(scores[:i]), slow(scores[j:])
        return left + [(i, j - 1, best[0])] + [(a + j, b + j, s) for a, b, s in right]

    r = random.Random(1)
    for _ in range(200):
        scores = [r.choice([2.0, 3.5, 5.25, -0.75, -0.75, -0.75]) for _ in range(r.randrange(0, 14))]
        got = toxicity.segments([(i, s) for i, s in enumerate(scores) if s > 0], other=-0.75)
        assert sorted(s for *_, s in got) == pytest.approx(sorted(s for *_, s in slow(scores)))


def test_log_odds_need_evidence():
    odds = toxicity.log_odds([("bad", 40, 0), ("the", 50, 500), ("once", 1, 0)], 50, 500)
    assert "bad" in odds and "the" not in odds and "once" not in odds


def test_ranking_learns_and_survives_one_class():
    good = ["A plain sentence, as people write it. And another one follows here."] * 30
    bad = ["BUY!! NOW!! CHEAP!! " * 5] * 30
    x = [quality.features(t) for t in good + bad]
    m = quality.fit(x, [1] * 30 + [0] * 30)
    s = m.score(x)
    assert (s[:30] >= 0.3).all() and (s[30:] < 0.3).all()
    assert quality.fit(x[:30], [1] * 30).score(x)[0] == pytest.approx(0.5)
    assert len(quality.features(None)) == len(quality.FEATURES)


def test_ranking_equals_all_pairs_one_by_one():
    import numpy as np

    draw, k = np.random.default_rng(3), len(quality.FEATURES)
    x, y = np.r_[draw.normal(0.4, 1, (90, k)), draw.normal(-0.2, 1.3, (60, k))], np.r_[np.ones(90, int), np.zeros(60, int)]
    x[:, 5] = 3
    m = quality.fit(x, y)
    z = np.clip((x - x.mean(0)) / np.where(x.std(0) < 1e-9, 1, x.std(0)), -8, 8)
    d, w = (z[y == 1][:, None] - z[y == 0][None]).reshape(-1, k), np.zeros(k)
    for _ in range(30):
        p = 1 / (1 + np.exp(d @ w))
        w += np.linalg.solve((d * (p * (1 - p))[:, None]).T @ d / len(d) + 1e-3 * np.eye(k), d.T @ p / len(d) - 1e-3 * w)
    assert np.abs(m.weights - w).max() < 2e-4
    s = m.raw(x)
    errors = lambda cut: (s[y == 1] < cut).mean() + (s[y == 0] >= cut).mean()
    assert errors(m.cut) == pytest.approx(min(map(errors, [*s, s.max() + 1])))
    assert m.scale == pytest.approx(s.std() / 4, rel=1e-3)


def test_decode_in_bounded_groups(monkeypatch):
    r = random.Random(4)
    payloads = [bytes(r.randrange(97, 123) for _ in range(n)) for n in (64, 9000, 40_000, 128)]
    streams = [flac.encode(np.frombuffer(p, dtype=np.uint8).astype(np.int16) - 128) for p in payloads]
    monkeypatch.setattr(flac, "GROUP_BYTES", 5000)
    for p, x in zip(payloads, flac.decode_many(streams)):
        assert (x + 128).astype(np.uint8).tobytes() == p
    # blocks one by one, each with its place in the samples and in the stream
    blocks = list(flac.blocks(streams[2]))
    assert b"".join(b for *_, b in blocks) == bytes(v ^ 0x80 for v in payloads[2])
    assert [first for first, *_ in blocks] == list(range(0, 40_000, flac.BLOCK))
    for first, n, at, pcm in blocks:
        x, _ = flac.decode_frame(streams[2], at, flac.header(streams[2]))
        assert len(pcm) == n and [v - 256 * (v > 127) for v in pcm] == x[0]


@pytest.mark.parametrize("n", [0, 1, 2, 9, 60, 700])
def test_packing_places_everything(n):
    r = random.Random(n)
    counts = collections.Counter(r.choice([r.randint(1, 100), r.randint(30, 60)]) for _ in range(n))
    patterns = packing.plan(dict(counts), 100)
    got = collections.Counter()
    for p, times in patterns:
        assert sum(p) <= 100 and times > 0
        for x in p:
            got[x] += times
    assert got == counts
    if n == 9:  # exact, by brute force over bins
        items = sorted(counts.elements(), reverse=True)
        best = n

        def place(i, bins):
            nonlocal best
            if len(bins) >= best:
                return
            if i == len(items):
                best = len(bins)
                return
            for k in range(len(bins)):
                if bins[k] + items[i] <= 100:
                    place(i + 1, bins[:k] + [bins[k] + items[i]] + bins[k + 1 :])
            place(i + 1, bins + [items[i]])

        place(0, [])
        assert sum(t for _, t in patterns) == best


def test_search_beats_best_fit():
    improved = 0
    r = random.Random(5)
    for _ in range(60):
        counts = collections.Counter(r.randint(15, 45) for _ in range(24))
        first, best = sum(t for _, t in packing.best_fit(dict(counts), 100)), sum(t for _, t in packing.plan(dict(counts), 100))
        assert -(-sum(n * c for n, c in counts.items()) // 100) <= best <= first
        improved += best < first
    assert improved


def test_fillings_are_undominated():
    r = random.Random(9)
    for _ in range(100):
        left = [0] * 61
        for _ in range(r.randint(1, 10)):
            left[r.randint(3, 60)] += 1
        room = r.randint(1, 60)
        pieces = [n for n in range(61) for _ in range(left[n])]
        every = {c for k in range(4) for c in itertools.combinations(pieces, k) if sum(c) <= room}
        got = packing.fillings(room, left, width=99)
        for f in got:
            rest = list(pieces)
            for n in f:
                rest.remove(n)
            waste = room - sum(f)
            assert waste >= 0 and not any(n <= waste for n in rest) and not any(p < n <= p + waste for p in f for n in rest)
        # the fullest filling of at most three pieces is never missed
        assert room - sum(got[0]) <= min(room - sum(c) for c in every)


def test_segments_take_linear_time():
    import time

    for gap in (2, 9, 40):
        began = time.process_time()
        toxicity.segments([(gap * i, 1.0 + i % 3) for i in range(200_000)])
        assert time.process_time() - began < 5


def test_feistel_is_a_permutation():
    for n in (1, 2, 3, 100, 1000, 4097):
        assert sorted(training_order.feistel(np.arange(n), n).tolist()) == list(range(n))
    assert training_order.feistel(np.arange(1000), 1000).tolist() != training_order.feistel(np.arange(1000), 1000, key=5).tolist()


def test_splitting_tree_is_exact():
    counts = {0: 1000, 1: 3, 2: 0, 3: 77}
    leaves = split_tree(counts, levels=3)
    for k, n in counts.items():
        runs = sorted((a, b) for s, _, a, b in leaves if s == k)
        assert [x for a, b in runs for x in range(a, b)] == list(range(n))
    sizes = collections.Counter()
    for _, shard, a, b in leaves:
        sizes[shard] += b - a
    assert max(sizes.values()) - min(sizes.values()) <= 1
    assert leaves == split_tree(counts, levels=3)


def _samples():
    r = np.random.default_rng(2)
    return [np.zeros(64, int), r.integers(-128, 128, 5000), np.clip(np.cumsum(r.integers(-2, 3, 9000)), -128, 127), (100 * np.sin(np.arange(9000) / 30)).astype(int), np.array([5]), np.array([-128, 127])]


def test_flac_round_trips():
    streams = [flac.encode(x) for x in _samples()]
    for x, s, many in zip(_samples(), streams, flac.decode_many(streams)):
        assert flac.decode(s)[0][0] == x.tolist() == many.tolist()
        assert flac.seek(s, len(x) // 2, 7) == x.tolist()[len(x) // 2 :][:7]
    wide = (3000 * np.sin(np.arange(5000) / 9)).astype(int)
    assert flac.decode(flac.encode(wide, bits=16))[0][0] == wide.tolist()


def test_flac_damage_is_found():
    stream = bytearray(flac.encode(_samples()[2]))
    for at in (len(stream) - 1, len(stream) // 2, flac.header(bytes(stream))["frames"] + 3):
        broken = bytearray(stream)
        broken[at] ^= 0x10
        with pytest.raises((flac.FlacError, StopIteration)):
            flac.decode(bytes(broken))
    with pytest.raises(flac.FlacError):
        flac.decode(b"RIFF")


def test_crc16_equals_the_bitwise_one():
    def slow(data):
        c = 0
        for b in data:
            c ^= b << 8
            for _ in range(8):
                c = (c << 1 ^ 0x8005 if c & 0x8000 else c << 1) & 0xFFFF
        return c

    r = random.Random(3)
    for n in (0, 1, 2, 100, 4606, 4607, 9300):
        data = bytes(r.randrange(256) for _ in range(n))
        assert flac.crc16(data) == slow(data)


def test_flac_decodes_lpc_with_partitions_and_escapes():
    """A hand-made LPC frame: order 2, two Rice partitions, the second escaped to raw residuals."""
    n, coefficients, shift = 16, (3, -1), 1
    residual = [1, -1, 2, 0, -2, 3] + [4, -4, 1, 0, 2, -3, 1, 1]
    x = [10, 12]
    for e in residual:
        x.append(e + ((coefficients[0] * x[-1] + coefficients[1] * x[-2]) >> shift))
    sign = lambda v, w: format(v & (1 << w) - 1, f"0{w}b")
    bits = "0" + format(32 + 1, "06b") + "0" + "".join(sign(v, 8) for v in x[:2]) + format(4 - 1, "04b") + sign(shift, 5) + "".join(sign(c, 4) for c in coefficients)
    bits += "00" + format(1, "04b") + format(1, "04b")
    for e in residual[:6]:
        u = e << 1 ^ e >> 63
        bits += "0" * (u >> 1) + "1" + format(u & 1, "b")
    bits += "1111" + format(4, "05b") + "".join(sign(e, 4) for e in residual[6:])
    bits += "0" * (-len(bits) % 8)
    head = b"\xff\xf8\x70\x02\x00" + struct.pack(">H", n - 1)
    frame = head + bytes([flac.crc8(head)]) + int(bits, 2).to_bytes(len(bits) // 8, "big")
    frame += struct.pack(">H", flac.crc16(frame))
    info = struct.pack(">HH", n, n) + bytes(6) + (8000 << 44 | 7 << 36 | n).to_bytes(8, "big") + bytes(16)
    stream = b"fLaC" + b"\x80" + len(info).to_bytes(3, "big") + info + frame
    assert flac.decode(stream)[0][0] == x


@pytest.mark.parametrize("width", [1, 3, 40])
def test_tiled_comparison_equals_brute_force(width):
    r = np.random.default_rng(width)
    base = r.normal(size=(12, width))
    x = np.concatenate([base + 0.1 * r.normal(size=base.shape) for _ in range(12)])
    x /= np.sqrt((x**2).sum(1))[:, None]
    got = set()
    for i, j in embedding_dup.compare(x, x, True, strip=50):
        got |= set(zip(i.tolist(), j.tolist()))
    assert got == {(i, j) for i, j in itertools.combinations(range(len(x)), 2) if x[i] @ x[j] >= 0.9}
