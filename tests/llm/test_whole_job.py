"""Tables on which a part of the job is easily left out."""

from __future__ import annotations

import zlib
from collections import defaultdict

import pytest

from wovenlake.llm import best_fit_packing, lm_score, queries


@pytest.mark.parametrize("low,high", [(1, 1), (10, 10), (129, 129), (400, 400), (342, 409)])
def test_packing_of_concentrated_lengths(spark, low, high):
    n = 4100 if high < 100 else 1000
    sizes = {i: low + i % (high - low + 1) for i in range(n)}
    df = spark.createDataFrame(list(sizes.items()), "id bigint, size bigint")
    by_seq = defaultdict(list)
    rows = best_fit_packing.place(df).collect()
    assert sorted(r["piece"] for r in rows) == sorted(sizes)
    for r in rows:
        by_seq[r["sequence_id"]].append((r["offset"], sizes[r["piece"]]))
    for parts in by_seq.values():
        at = 0
        for offset, size in sorted(parts):
            assert offset == at
            at += size
        assert at <= 2048
    assert len(by_seq) <= -(-n // (2048 // high))


def test_lm_scores_read_what_lies_behind_the_sample(spark):
    """Equal ids, words and first 20 000 bytes; only the order of words behind them differs."""
    ids = range(20)
    held = next(i for i in ids if zlib.crc32(str(i).encode()) % 7 == 2)
    head = " ".join(f"filler{i % 50}" for i in range(3000))
    got = []
    for tail in ("house river " * 500, "house " * 500 + "river " * 500):
        rows = [(i, "house river " * 20 if i == held else f"{head} {tail}") for i in ids]
        scores = lm_score.score(spark.createDataFrame(rows, "doc_id bigint, text string"), queries.vocabulary()).collect()
        got.append(next(r for r in scores if r["doc_id"] == held))
    assert got[0]["base_score"] == got[1]["base_score"]
    assert got[0]["score"] > got[1]["score"]


def test_lm_mixture_stays_a_distribution():
    import numpy as np

    p = lm_score.LmParameters(head_classes=3, tail_classes=2, width=4)
    names, counts = ["a", "b", "c</w>", "d", "e</w>", ""], np.array([5, 4, 3, 2, 1, 2])
    model = lm_score.AttentionModel(5, p, *lm_score.subword_classes(names, counts, p))
    cells = lm_score.followers(np.array([0, 1, 2, 0]), np.array([0, 3, 3, 4]), model.context)
    c = model.context
    assert sorted(cells) == sorted([c[6] * 6 + 0, c[0] * 6 + 1, c[1] * 6 + 2, c[2] * 6 + 5, c[6] * 6 + 5, c[6] * 6 + 0, c[0] * 6 + 5])
    seen = np.bincount(cells, minlength=36).reshape(6, 6) + counts / counts.sum()
    model.follow = (seen / seen.sum(1, keepdims=True)).astype(np.float32)
    model.freeze()
    # all texts of at most one id: the end at once, or an id first
    first = [10 ** (model.log10(np.array([i]), np.array([0, 1]))[0]) for i in range(5)]
    end = 10 ** model.log10(np.zeros(0, np.int64), np.array([0, 0]))[0]
    after = [10 ** (model.log10(np.array([i, j]), np.array([0, 2]))[0]) for i in range(5) for j in range(5)]
    assert end + sum(first) + sum(after) < 1 + 1e-5
    assert end > 0 and all(x > 0 for x in first + after)


def test_lm_learns_from_every_training_window(spark):
    """One rare window in 8 192 changes the network and all counts, wherever it stands: nothing is left to a sample."""
    import numpy as np

    p = lm_score.LmParameters(head_classes=6, tail_classes=2, width=4)
    names = [*"abcdefg", "h</w>", ""]
    ids = np.arange(131_072) % 5
    at = np.array([0, len(ids)])
    got = []
    for place in (None, 5, 70_003, 131_000):
        x = ids.copy()
        if place is not None:
            x[place] = 6
        model = lm_score.AttentionModel(8, p, *lm_score.subword_classes(names, np.append(np.bincount(ids, minlength=8), 1), p))
        texts = spark.createDataFrame([(x.astype(lm_score.id_type(8)).tobytes(),)], "ids binary")
        follow, lead, pair = lm_score.count_followers(texts, model)
        assert follow.sum() == lead.sum() == pair.sum() == len(x) + 1
        model.embed(lead, p)
        model.freeze()
        moments = lm_score.sum_moments(texts, model)
        assert moments[: -p.width**2].reshape(-1, p.width + 1)[:, -1].sum() == len(x) + 1
        model.fit_output(moments, 8)
        got.append((lead[6].sum(), model.w["U"].copy()))
        model.set_followers(follow, lead, pair, np.append(np.bincount(x, minlength=8), 1), p)
        first = [10 ** (model.log10(np.array([i]), np.array([0, 1]))[0]) for i in range(8)]
        after = [10 ** (model.log10(np.array([i, j]), np.array([0, 2]))[0]) for i in range(8) for j in range(8)]
        assert 10 ** model.log10(np.zeros(0, np.int64), np.array([0, 0]))[0] + sum(first) + sum(after) < 1 + 1e-5
    assert [n for n, _ in got] == [0, 1, 1, 1]
    assert all(not np.array_equal(u, got[0][1]) for _, u in got[1:])


def test_lm_looks_up_each_word_of_a_block_once():
    """The table sees the distinct words of a block, in parts of bounded size, and gives every word its ids in place."""
    import numpy as np
    import pyarrow as pa

    from wovenlake.llm.subwords import ChunkTable

    asked = []

    class Counting(ChunkTable):
        def rows(self, words):
            asked.append(words)
            return super().rows(words)

    words = [f"w{i % 700}" for i in range(5000)] + [""]
    coded = pa.array(words).dictionary_encode()
    table = Counting(lambda new: [[*w] for w in new], cap=20_000, digest=lambda w: int(w[1:] or 0))
    known = lm_score.Distinct(coded.dictionary, table, limit=100)
    assert sorted(w for part in asked for w in part) == sorted({w.encode() for w in words})
    assert max(sum(map(len, part)) for part in asked) < 110
    place = np.asarray(coded.indices)
    assert known.ids_of(place, "<u2").tolist() == list("".join(words).encode())
    assert known.hashes[place].tolist() == [int(w[1:] or 0) for w in words]
    assert known.empty == 700


def test_a_full_table_keeps_the_chunks_that_came_again():
    from wovenlake.llm.subwords import ChunkTable

    learned = []

    def encode(new):
        learned.extend(new)
        return [[*w] for w in new]

    table = ChunkTable(encode, cap=30_000, digest=len, keep_seen=True)
    often = [b"the%d" % i for i in range(40)]
    for i in range(60):
        batch = [*often, *(b"rare%d" % j for j in range(20 * i, 20 * i + 20))]
        got = table.rows(batch)
        ids, ends = table.ids_of_rows(got)
        assert ids.tolist() == [*b"".join(batch)] and ends[-1] == len(ids)
        assert table.digests[got].tolist() == [len(w) for w in batch]
    assert len(learned) == len(set(learned)) == 40 + 60 * 20
    assert len(table.index) < 300
    for i in range(20):  # all come again, too many to keep
        table.rows([b"new%d" % j for j in range(300)])
        assert len(table.index) < 600


def test_lm_words_and_ids_of_odd_white_space(spark):
    """Words and ids of the cutting pass equal plain ones, with empty texts and white space at the ends of texts."""
    import numpy as np
    import xxhash
    from tokenizers import Tokenizer

    texts = ["", " ", "\n\n", " a  B\tc ", "x", "\x00 \x1c\x1d y\x1ez \x0b\x0c\r q", "nbsp in  wide　", "É É İ Å", "don't 'S 12 a1b2 !!", " lead", "trail ", "\u0085 \u0085a", "the The THE"] * 2
    tokenizer = Tokenizer.from_file(queries.vocabulary())
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").selectExpr("doc_id", "doc_id % 3 = 0 held_out", "text").coalesce(1)
    for block_bytes in (8_000_000, 40, 1):
        cut = lm_score.cut_texts(docs, queries.vocabulary(), tokenizer.get_vocab_size(), block_bytes).collect()
        lists = {r["block"]: r for r in cut if r["no"] < 0}
        rows = {r["doc_id"]: r for r in cut if r["no"] >= 0}
        assert sorted(rows) == list(range(len(texts)))
        counts = defaultdict(int)
        for r in lists.values():
            assert len(r["hashes"]) == len(r["counts"]) == len(set(r["hashes"]))
            for h, n in zip(r["hashes"], r["counts"], strict=True):
                counts[h] += n
        want = defaultdict(int, dict.fromkeys(counts, 0))
        for i, t in enumerate(texts):
            assert np.frombuffer(rows[i]["ids"], "<u2").tolist() == tokenizer.encode(t, add_special_tokens=False).ids
            words = [lists[rows[i]["block"]]["hashes"][p] for p in lm_score._from_three_bytes(rows[i]["words"])]
            hashes = [int(np.uint64(xxhash.xxh3_64_intdigest(w)).view(np.int64)) for w in t.encode().lower().split()]
            assert words == hashes
            for h in hashes:
                want[h] += i % 3 > 0
        assert counts == want


def test_lm_score_equals_plain_attention():
    """log10 and moments against loops over single targets, with texts shorter and longer than a window."""
    import numpy as np

    rng, s = np.random.default_rng(3), lm_score.STRIDE
    n, p = 40, lm_score.LmParameters(head_classes=18, tail_classes=2, width=4)
    counts = np.append(rng.integers(0, 50, n), 4)
    model = lm_score.AttentionModel(n, p, *lm_score.subword_classes([chr(97 + i % 26) + "</w>" * (i % 2) for i in range(n)] + [""], counts, p))
    k, w = model.n_contexts, model.w
    w["E"][: n + 2] = rng.normal(size=(n + 2, 4)).astype(np.float32)
    for name in ("U", "G", "g"):
        w[name][:] = rng.normal(size=w[name].shape)
    model.set_followers(*(rng.integers(0, 9, shape).astype(np.float32) for shape in ((k, n + 1), (n + 2, k - 1), (k * k, k - 1))), counts, p)
    model.freeze()
    texts = [rng.integers(0, n, size) for size in (0, 1, s - 1, s, 3 * s + 5)]
    soft = lambda x: np.exp(x) / np.exp(x).sum()
    want, sums, products = [], np.zeros((len(w["b"]), 5)), np.zeros((4, 4))
    for text in texts:
        inputs, total = [n + 1, *text], 0.0
        for i, target in enumerate([*text, n]):
            keys = range(max(0, i // s * s - s), i + 1)
            e = w["E"].astype(float)
            weight = soft(np.array([e[inputs[i]] @ w["Q"] @ (e[inputs[j]] @ w["K"]) / 2 + w["r"][i - j] for j in keys]))
            h = np.tanh(e[inputs[i]] @ w["A"] + sum(a * (e[inputs[j]] @ w["V"]) for a, j in zip(weight, keys, strict=True)) @ w["O"])
            c = model.classes[target]
            group = slice(c // lm_score.GROUP * lm_score.GROUP, (c // lm_score.GROUP + 1) * lm_score.GROUP)
            net = soft(h @ w["G"] + w["g"])[c // lm_score.GROUP] * soft(np.clip(h @ w["U"] + w["b"], -40, 40)[group])[c % lm_score.GROUP]
            one, two = model.context[inputs[i]], model.context[inputs[i - 1] if i else n + 1]
            lead = model.lead[inputs[i], c]
            parts = [net * model.inside[target], model.follow[one, target], lead * model.inside[target], (model.pair[two * k + one, c] + model.pair_rest[two * k + one] * lead) * model.inside[target]]
            total += np.log10(np.dot(p.shares, parts))
            sums[c] += [*h, 1]
            products += np.outer(h, h)
        want.append(total)
    at = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    assert np.allclose(model.log10(np.concatenate(texts), at), want, rtol=1e-5)
    assert np.allclose(model.moments(np.concatenate(texts), at), np.concatenate([sums.ravel(), products.ravel()]), atol=1e-4)
