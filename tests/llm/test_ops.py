"""The operators against brute force on small tables that hold nulls, empty texts, ties, repeated rows and clashing columns."""

import math
import re
import time
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from plyweave.llm import _buckets, _shared, annsearch, langid, lmscore, mixing, packing, pii, pivots, sharding, simhash, token_file
from plyweave.llm._bpe import Encoder

SF = "/root/testdata/sf0.001"
BPE = public_tokenizers.path("byte_bpe_50k.json")
EDGE = [(None, "no id"), (10_001, None), (10_002, ""), (10_003, "   \n"), (10_004, "x"), (10_004, "x"), (10_005, "one two"), (10_006, "word " * 30_000), (10_007, "<|endoftext|> 中文 😀 don't"), (10_008, "x <|endoftext|> y<|endoftext|><|endoftext|>")]


@pytest.fixture(scope="module")
def docs(spark):
    real = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    return real.union(spark.createDataFrame(EDGE, "doc_id long, text string")).persist()


@pytest.fixture(scope="module")
def local(docs):
    return [tuple(r) for r in docs.collect()]


def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")


def test_shards(docs, local):
    got = sharding.shard_digest(docs, 8).collect()
    assert sorted((r.doc_id or -1, r["size"], r.text_crc32) for r in got) == sorted((d or -1, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for d, t in local)
    for s in range(8):
        rows = [r for r in got if r["shard"] == s]
        assert sorted(r.slot for r in rows) == list(range(len(rows)))
    sizes = [sum(r["size"] for r in got if r["shard"] == s) for s in range(8)]
    largest = max(r["size"] for r in got)
    assert max(sizes) - min(sizes) <= 2 * largest


def test_shards_of_one_hot_text(spark):
    rows = [(k, "same text") for k in range(4000)] + [(4000 + k, f"text {k}") for k in range(100)]
    got = sharding.shard_documents(spark.createDataFrame(rows, "doc_id long, text string").withColumn("Slot", F.lit(1)), 4).collect()
    sizes = [sum(r["size"] for r in got if r["shard"] == s) for s in range(4)]
    assert max(sizes) <= 1.03 * min(sizes) and len(got) == len(rows)
    texts = {}
    for r in got:
        texts.setdefault(r.text, set()).add(r["shard"])
    assert all(len(s) == 1 for t, s in texts.items() if t != "same text")


def test_shards_of_nothing(spark):
    assert sharding.shard_documents(empty(spark), 8).count() == 0


def brute_fingerprint(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    runs = [b" ".join(words[k : k + 3]) for k in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(r, 42) for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(ids, linked):
    label = list(range(len(ids)))
    changed = True
    while changed:
        changed = False
        for a in range(len(ids)):
            for b in range(len(ids)):
                if linked(a, b) and label[b] > label[a]:
                    label[b], changed = label[a], True
    groups = {}
    for k, g in enumerate(label):
        groups.setdefault(g, []).append(ids[k])
    return [min((x for x in groups[g] if x is not None), default=None) for g in label]


def test_simhash(docs, local):
    fps = [brute_fingerprint(t) for _, t in local]
    want = brute_components([d for d, _ in local], lambda a, b: (fps[a] ^ fps[b]).bit_count() <= 2)
    got = sorted((r.doc_id or -1, r.fingerprint, r.component_id) for r in simhash.simhash_digest(docs).collect())
    assert got == sorted((d or -1, f"{f:016x}", c) for (d, _), f, c in zip(local, fps, want, strict=True))


def test_golay_finds_every_link_of_two_bits():
    rng = np.random.default_rng(1)
    one = rng.integers(0, 1 << 23, 3000)
    nearest, near = simhash.golay_keys(one)
    for bits in (0, 1, 2):
        two = one.copy()
        for k in range(len(two)):
            for b in rng.choice(23, bits, replace=False):
                two[k] ^= 1 << int(b)
        other_nearest, other = simhash.golay_keys(two)
        if bits < 2:
            assert ((nearest[:, None] == other) & (other >= 0)).any(axis=1).all()
        assert ((near[:, :, None] == other[:, None, :]) & (near[:, :, None] >= 0)).any(axis=(1, 2)).all()


def test_soft_codewords_agree_best():
    rng = np.random.default_rng(2)
    margins = rng.integers(-50, 50, (40, 23))
    margins[0] *= 10_000_000
    words = [d << 11 for d in range(1 << 12)]
    for d in range(1 << 12):
        rest = words[d]
        for k in range(22, 10, -1):
            if rest >> k & 1:
                rest ^= simhash.GENERATOR << (k - 11)
        words[d] |= rest
    assert (simhash.golay_keys(np.array(words))[0] == np.arange(1 << 12)).all()
    signs = np.array([[2 * (w >> b & 1) - 1 for b in range(23)] for w in words])
    for row, got in zip(margins, simhash.soft_codewords(margins), strict=True):
        agree = signs @ row
        want = np.sort(agree)[::-1][: simhash.NEAREST]
        assert len(set(got.tolist())) == simhash.NEAREST and np.abs(agree[got] - want).max() <= np.abs(row).max() * 1e-3 * (np.abs(row).max() > 1 << 17)


def test_near_duplicates_meet_by_joint_codewords(spark):
    """Two nodes meet if and only if they share the codewords of both segments of a table and are near in the other half of their bits."""
    rng = np.random.default_rng(4)
    many = 2 * len(simhash.JOINT) * simhash.NEAREST
    fp, codes = rng.integers(0, 256, (4, 32), np.uint8), rng.permutation(4096)[: 4 * many].reshape(4, many)
    fp[1] = fp[0]
    codes[1, 3], codes[1, 7] = codes[0, 0], codes[0, 11]  # segments 0 and 1: one table
    fp[3] = fp[2]
    codes[3, 0], codes[3, 13] = codes[2, 1], codes[2, 12]  # segments 0 and 2: no table
    nodes = spark.createDataFrame([(k + 1, fp[k].tobytes(), codes[k].tolist()) for k in range(4)], "node long, fp binary, codes array<int>")
    assert sorted(map(tuple, simhash._near_edges(nodes, 39).collect())) == [(2, 1)]
    fp[1, 16:] ^= 255
    nodes = spark.createDataFrame([(k + 1, fp[k].tobytes(), codes[k].tolist()) for k in range(4)], "node long, fp binary, codes array<int>")
    assert simhash._near_edges(nodes, 39).count() == 0


def test_simhash_of_nothing(spark):
    assert simhash.simhash_digest(empty(spark)).count() == 0
    assert simhash.near_duplicates(empty(spark)).count() == 0


def test_near_duplicates_are_held_against_sets(spark):
    rng = np.random.default_rng(3)
    own = lambda: " ".join(f"w{k}" for k in rng.integers(0, 10**9, 300))
    line = " ".join(["again and again the line"] * 140)
    once = own()
    rows = [(1, f"{own()} {line}"), (2, f"{own()} {line}"), (3, f"{own()} " + "same " * 700), (4, f"{own()} " + "same " * 700), (5, f"{once} {once} {once[: once.index(' ', 1500)]}"), (6, f"{once} {once}")]
    got = {r.doc_id: r.component_id for r in simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: 1, 2: 2, 3: 3, 4: 4, 5: 5, 6: 5}


def brute_near(texts, similarity=0.8):
    """Smallest number of each text's component, by all pairs of sets of five words."""
    sets = [{tuple(w[k : k + 5]) for k in range(len(w) - 4)} for w in map(str.split, texts)]
    label = list(range(len(texts)))
    for a in range(len(texts)):
        for b in range(a):
            if label[a] != label[b] and len(sets[a] & sets[b]) >= similarity * len(sets[a] | sets[b]):
                label = [min(label[a], label[b]) if x in (label[a], label[b]) else x for x in label]
    return label


def test_near_duplicates_of_edited_copies(spark):
    rng = np.random.default_rng(8)
    texts = []
    for g in range(6):
        base = [f"g{g}w{k}" for k in range(400)]
        for c in range(40):
            own = list(base)
            for k in rng.choice(400, int(rng.integers(2, 9)), replace=False):
                own[k] = f"g{g}c{c}e{k}"
            texts.append(" ".join(own))
    want = brute_near(texts)
    assert 20 < len(set(want)) < len(texts) - 20
    got = {r.doc_id: r.component_id for r in simhash.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert [got[k] for k in range(len(texts))] == want


def test_near_duplicates_of_lone_pairs(spark):
    """Pairs at a similarity of 0.80 to 0.85 and no other copies: brute force links all of them."""
    rng = np.random.default_rng(9)
    texts = []
    for g in range(1500):
        base = [f"g{g}w{k}" for k in range(364)]
        cut = int(rng.integers(27, 37))
        texts += [" ".join(base[: 364 - cut]), " ".join(base[cut:])]
    sets = [{tuple(w[k : k + 5]) for k in range(len(w) - 4)} for w in map(str.split, texts)]
    near = range(0, len(texts), 2)
    assert all(0.8 <= len(sets[k] & sets[k + 1]) / len(sets[k] | sets[k + 1]) <= 0.85 for k in near)
    got = {r.doc_id: r.component_id for r in simhash.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    found = sum(got[k] == got[k + 1] for k in near)
    print("recall", found, len(near))
    assert found >= 0.999 * len(near)


def test_components_of_sets_equal_brute_force():
    rng = np.random.default_rng(12)
    for _ in range(200):
        base = [rng.choice(400, int(rng.integers(1, 60)), replace=False) for _ in range(3)]
        sets = []
        for _ in range(int(rng.integers(1, 40))):
            own = set(base[rng.integers(3)].tolist())
            own -= set(rng.choice(400, int(rng.integers(0, 30))).tolist())
            sets.append(np.array(sorted(own | set(rng.choice(400, int(rng.integers(0, 4))).tolist())), np.uint32))
        link = lambda a, b: len(set(sets[a]) & set(sets[b])) >= 0.8 * len(set(sets[a]) | set(sets[b])) and len(sets[a])  # noqa: E731, B023
        got = simhash.set_components(sets, 0.8).tolist()
        assert got == brute_components(list(range(len(sets))), lambda a, b: a == b or link(a, b))
    assert simhash.set_components([], 0.8).tolist() == []


def test_near_duplicates_of_large_groups_in_parts(spark, monkeypatch):
    """A group that is cut into parts has the same components as a whole one."""
    rng = np.random.default_rng(13)
    texts = []
    for c in range(300):
        own = [f"w{k}" for k in range(200)]
        for k in rng.choice(200, int(rng.integers(1, 6)), replace=False):
            own[k] = f"c{c}e{k}"
        texts.append(" ".join(own))
    want = brute_near(texts)
    monkeypatch.setattr(simhash, "GROUP_BYTES", 40_000)
    monkeypatch.setattr(simhash, "BLOCK_ROWS", 50)
    got = {r.doc_id: r.component_id for r in simhash.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert [got[k] for k in range(len(texts))] == want and len(set(want)) > 1


def test_near_duplicates_of_five_words(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    base = " ".join(r.text for r in docs[:1]).split()[:200]
    changed = [*base[:100], "otherword", *base[101:]]
    rows = [(1, " ".join(base)), (2, " ".join(changed)), (3, docs[5].text), (4, docs[5].text), (5, docs[9].text), (6, None), (7, "")]
    got = {r.doc_id: r.component_id for r in simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: 1, 2: 1, 3: 3, 4: 3, 5: 5, 6: 6, 7: 6}


def test_buckets_in_blocks_find_all_pairs(spark):
    rng = np.random.default_rng(3)
    rows = [(int(k % 3), int(r), i) for i, (k, r) in enumerate(zip(rng.integers(0, 3, 90), rng.integers(0, 3, 90), strict=True))]
    df = spark.createDataFrame(rows, "key long, role byte, id long")
    got = _buckets.linked(df, lambda t, i, q: (t["id"][i] < t["id"][q]) & ((t["id"][q] - t["id"][i]) % 7 == 0), lambda b: {"id": b.column("id").to_numpy(), "weight": np.ones(b.num_rows, np.int64)}, block=7, weights=True).collect()
    links = {}
    for k, r, i in rows:
        for k2, r2, q in rows:
            if k == k2 and r <= 1 and r2 >= 1 and i < q and (q - i) % 7 == 0:
                links[i] = links.get(i, 0) + 1
                links[q] = links.get(q, 0) + 1
    sums = {}
    for r in got:
        if r.n is not None:
            sums[r.a] = sums.get(r.a, 0) + r.n
    assert sums == links


def test_settled_deletes_what_led_to_it(spark):
    import os

    folder = _shared.shared_dir(spark).removeprefix("file://")
    before = set(os.listdir(folder))
    out = _shared.settled(spark, "kept", lambda: _shared.cut(_shared.cut(spark.range(5).toDF("a"), "one"), "two").filter("a > 1"))
    left = set(os.listdir(folder)) - before
    assert len(left) == 1 and left.pop().startswith("kept-") and sorted(r.a for r in out.collect()) == [2, 3, 4]


def test_components(spark):
    chain = [(k, k + 1) for k in range(0, 40)] + [(100, 101), (102, 101), (7, 7), (None, 3)] + [(200, 200 + k) for k in range(1, 30)]
    got = {r.id: r.component for r in _buckets.components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == {k: 0 for k in range(41)} | {100: 100, 101: 100, 102: 100} | {k: 200 for k in range(200, 230)}


def test_rounds_of_components_begin_with_few_edges(spark, monkeypatch):
    """A group whose ids have an edge to each of 30 smallest ones is joined with an edge or so for each id, not with all."""
    sizes, write = [], _buckets.cut

    def counted(df, label):
        out = write(df, label)
        sizes.append(out.count())
        return out

    monkeypatch.setattr(_buckets, "cut", counted)
    edges = [(k, c) for k in range(30, 430) for c in range(30)] + [(k, None) for k in range(9)] + [(1000, 1001), (1002, 1001)]
    got = {r.id: r.component for r in _buckets.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {k: 0 for k in range(430)} | {k: 1000 for k in (1000, 1001, 1002)}
    assert max(sizes) <= 432 + 4 * 30  # 12,002 before


def test_lm_prefers_what_it_has_seen(spark):
    seen = " ".join(["the cat sat on the mat"] * 40)
    rows = [(k, seen) for k in range(30)] + [(99, "mat the on sat cat the " * 40), (100, None), (101, " ")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("N_words", F.lit("x"))
    net, words, counts = lmscore.fit(docs)
    got = {r.doc_id: r for r in lmscore.score(docs, net, words, counts).collect()}
    assert got[0].n_words == 240 and got[100].n_words == 0 and got[100].log_likelihood == 0 and got[101].mean_log_likelihood is None
    assert got[0].mean_log_likelihood > got[99].mean_log_likelihood > -20
    assert sorted(r.n for r in counts.collect()) == [1240] * 4 + [2480]
    assert got[0].log_likelihood == pytest.approx(brute_score(net, words, {r["hash"]: r.n for r in counts.collect()}, seen), rel=1e-4)


def brute_score(net, words, counts, text):
    """The sum over a text's words, one at a time: class given the words around, then word given class."""
    hashes = lmscore.word_hashes([text])[0].tolist()
    own = dict(zip(words.hashes.tolist(), words.classes.tolist(), strict=True))
    classes = [own.get(h, lmscore.OWN + 1 + h % (lmscore.GROUPS * lmscore.WITHIN - lmscore.OWN)) for h in hashes]
    total = 0.0
    for k, c in enumerate(classes):
        hidden = np.zeros(lmscore.DIM)
        for place, o in enumerate((-2, -1, 1, 2)):
            hidden += net.into[classes[k + o] if 0 <= k + o < len(classes) else 0] * net.place[place]
        hidden = np.tanh(hidden)
        group, word = (c - 1) // lmscore.WITHIN, (c - 1) % lmscore.WITHIN
        one = hidden @ net.group[:-1] + net.group[-1]
        two = (hidden + net.shift[group]) @ net.word[:-1] + net.word[-1] + net.bias[group]
        total += one[group] - math.log(np.exp(one).sum()) + two[word] - math.log(np.exp(two).sum())
        total += math.log(counts.get(hashes[k], 0.5)) - math.log(max(words.class_counts[c], 0.5))
    return total


def test_lm_beats_frequencies_on_held_out_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    seen, held = docs.filter("doc_id % 5 > 0"), docs.filter("doc_id % 5 = 0")
    net, words, counts = lmscore.fit(seen, id_col="doc_id", replica_words=30_000)
    got = lmscore.score(held, net, words, counts).agg(F.sum("log_likelihood"), F.sum("n_words")).first()
    known, sums = {r["hash"]: r.n for r in counts.collect()}, 0.0
    total = sum(known.values())
    hashes = lmscore.word_hashes([r.text for r in held.collect()])[0].tolist()
    sums = sum(math.log(known.get(h, 0.5) / total) for h in hashes)
    print("mean log-likelihood", got[0] / got[1], "of frequencies", sums / len(hashes))
    assert got[1] == len(hashes) and got[0] / got[1] > sums / len(hashes) + 0.05


def test_lm_does_not_depend_on_partitions(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    scores = []
    for n in (1, 7):
        some = docs.repartition(n)
        scores.append({r.doc_id: r.log_likelihood for r in lmscore.score(some, *lmscore.fit(some, id_col="doc_id", replica_words=20_000)).collect()})
    assert all(scores[1][k] == pytest.approx(x, rel=1e-5) for k, x in scores[0].items())


def test_lm_counts_of_rare_words(spark):
    """With few words broadcast the others are joined, with the same scores."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").union(spark.createDataFrame([(10**6, None), (10**6, "")], "doc_id long, text string"))
    counts = lmscore.count_words(docs)
    brute = {}
    for r in docs.collect():
        for w in (r.text or "").encode().lower().split():
            brute[w] = brute.get(w, 0) + 1
    known = {r["hash"]: r.n for r in counts.collect()}
    assert all(known[lmscore.word_hashes([w.decode()])[0][0]] == n for w, n in brute.items()) and len(known) == len(brute)
    few, every = lmscore.vocabulary(counts, frequent=2000), lmscore.vocabulary(counts)
    assert 1000 < len(few.hashes) <= 2000 and len(every.hashes) == len(brute) and (few.class_counts == every.class_counts).all() and every.class_counts.sum() == sum(brute.values())
    net = lmscore.Network.start(3)
    one, two = ({(r.doc_id, r.n_words): r.log_likelihood for r in lmscore.score(docs, net, w, counts).collect()} for w in (few, every))
    assert all(two[k] == pytest.approx(x, rel=1e-6) for k, x in one.items())


def test_lm_probabilities_add_up():
    net = lmscore.Network.start(1)
    every = np.arange(1, lmscore.GROUPS * lmscore.WITHIN + 1)
    assert np.exp(lmscore._forward(net, np.tile([1, 2, 3, 4], (len(every), 1)), every)[-1].astype(float)).sum() == pytest.approx(1, abs=1e-3)


def plain_step(net, context, target, memory, rate):
    """One step of AdaGrad as the formulas stand: logarithms of all probabilities, a sum by group for what groups have."""

    def log_softmax(x):
        x = x - x.max(axis=1, keepdims=True)
        return x - np.log(np.exp(x).sum(axis=1, keepdims=True))

    def scatter(rows, where, size):
        order = np.argsort(where, kind="stable")
        new = np.flatnonzero(np.diff(where[order], prepend=-1))
        out = np.zeros((size, rows.shape[1]), np.float32)
        out[where[order][new]] = np.add.reduceat(rows[order], new, axis=0)
        return out

    dim, n, at = lmscore.DIM, len(target), np.arange(len(target))
    h = np.ones((n, dim + 1), np.float32)
    h[:, :dim] = np.tanh(sum(net.into[context[:, k]] * net.place[k] for k in range(4)))
    group, word = np.divmod(target - 1, lmscore.WITHIN)
    moved = h.copy()
    moved[:, :dim] += net.shift[group]
    d1, d2 = np.exp(log_softmax(h @ net.group)), np.exp(log_softmax(moved @ net.word + net.bias[group]))
    d1[at, group] -= 1
    d2[at, word] -= 1
    d1, d2 = d1 / n, d2 / n
    back2 = (d2 @ net.word.T)[:, :dim]
    inner = ((d1 @ net.group.T)[:, :dim] + back2) * (1 - h[:, :dim] ** 2)
    into = scatter((inner[:, None, :] * net.place).reshape(-1, dim), context.ravel(), len(net.into))
    place = np.stack([(inner * net.into[context[:, k]]).sum(axis=0) for k in range(4)])
    for part, grad, seen in zip(net.parts(), (into, place, h.T @ d1, scatter(back2, group, lmscore.GROUPS), moved.T @ d2, scatter(d2, group, lmscore.GROUPS)), memory, strict=True):
        seen += grad**2
        part -= rate * grad / (np.sqrt(seen) + np.float32(1e-6))


def test_lm_learns_as_the_plain_formulas_do_in_less_time():
    rng = np.random.default_rng(4)
    classes = 1 + np.minimum(rng.zipf(1.2, 5 * lmscore.BATCH + 100), lmscore.GROUPS * lmscore.WITHIN) % (lmscore.GROUPS * lmscore.WITHIN)
    counts, took = np.array([len(classes) - 7, 7]), [[], []]
    context = lmscore._context(classes, counts)
    for _ in range(4):
        nets = [lmscore.Network.start(6) for _ in range(2)]
        memory = [[np.zeros_like(x) for x in nets[0].parts()] for _ in range(2)]
        began = time.thread_time()
        lmscore.learn(nets[0], classes, counts, memory[0], 0.1)
        took[0].append(time.thread_time() - began)
        began = time.thread_time()
        for a in range(0, len(classes), lmscore.BATCH):
            plain_step(nets[1], context[a : a + lmscore.BATCH], classes[a : a + lmscore.BATCH], memory[1], 0.1)
        took[1].append(time.thread_time() - began)
    assert np.allclose(nets[0].flat(), nets[1].flat(), atol=1e-3)
    assert min(took[0]) < 0.85 * min(took[1])  # as much as this before


def test_lm_words():
    texts = [None, "", " a  B\ta\n", "Ünder ünder", "x"]
    classes, counts = lmscore.word_hashes(texts)
    assert counts.tolist() == [0, 0, 3, 2, 1] and classes[0] == classes[2] != classes[1]
    assert lmscore.word_hashes([])[1].tolist() == []


def test_lm_gradient():
    rng = np.random.default_rng(0)
    classes, counts = rng.integers(1, 50, 60), np.array([25, 35])
    context = lmscore._context(classes, counts)
    loss = lambda n: -float(lmscore._forward(n, context, classes)[-1].astype(float).mean())
    net = lmscore.Network.start(2)
    before, flat = loss(net), net.flat()
    memory = [np.full_like(p, 1e6) for p in net.parts()]  # steps are then -rate * gradient / 1000
    lmscore.learn(net, classes, counts, memory, 1.0)
    step = (net.flat() - flat).astype(float)
    assert loss(net) - before == pytest.approx(-1000 * float((step**2).sum()), rel=0.05)


def vector_rows(rng):
    centre = rng.standard_normal(16)
    rows = [(k, rng.standard_normal(16).tolist(), k % 3) for k in range(150)]
    rows += [(200 + k, (centre + 0.01 * rng.standard_normal(16)).tolist(), 1) for k in range(30)]
    rows += [(300 + k, centre.tolist(), 1) for k in range(5)] + [(400, centre.tolist(), 2), (401, centre.tolist(), None), (402, None, 1), (403, [0.0] * 16, 1), (404, [math.nan] * 16, 1), (405, [None] * 16, 1), (406, [math.inf] * 16, 1), (None, centre.tolist(), 1)]
    return rows


def good(v):
    return v is not None and all(x is not None and math.isfinite(x) for x in v) and any(v)


def test_vector_groups(spark):
    rows = vector_rows(np.random.default_rng(5))
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").withColumn("n_links", F.lit("x"))
    unit = [np.array(v) / np.linalg.norm(v) if good(v) else None for _, v, _ in rows]
    link = lambda a, b: a != b and None not in (rows[a][2], rows[b][2], rows[a][0], rows[b][0]) and rows[a][2] == rows[b][2] and unit[a] is not None and unit[b] is not None and unit[a] @ unit[b] >= 0.98
    want = brute_components([r[0] for r in rows], link)
    n = [sum(link(a, b) for b in range(len(rows))) for a in range(len(rows))]
    got = sorted((-1 if r.vec_id is None else r.vec_id, r.n_links, r.component_id, r.kept) for r in pivots.vector_digest(df).collect())
    assert got == sorted((-1 if r[0] is None else r[0], k, c, c is not None and r[0] == c) for r, k, c in zip(rows, n, want, strict=True))
    assert pivots.vector_digest(df.limit(0)).count() == 0


def test_vector_groups_of_extreme_and_short_vectors(spark):
    rows = [(1, [1e300] * 4), (2, [1e-300] * 4), (3, [1.0, 1.0]), (4, [2.0, 2.0, 0.0]), (5, [-1.0] * 4)]
    rows = [(i, v, 1) for i, v in rows]
    got = {r.vec_id: (r.n_links, r.component_id) for r in pivots.vector_digest(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()}
    assert got == {1: (1, 1), 2: (1, 1), 3: (1, 3), 4: (1, 3), 5: (0, 5)}


def test_pivot_permutations():
    rng = np.random.default_rng(0)
    unit, points = rng.integers(-2, 3, (1100, 6)).astype(float), rng.integers(-2, 3, (70, 6)).astype(float)
    assert (pivots.permutations(unit, points, 12) == np.argsort(-(unit @ points.T), axis=1, kind="stable")[:, :12]).all()


@pytest.mark.parametrize("block", [4096, 40])
def test_vector_links_of_a_whole_table(spark, block, monkeypatch):
    """All links of a test table with one dense label, in whole and in divided buckets."""
    monkeypatch.setattr(pivots, "BLOCK", block)
    rng = np.random.default_rng(3)
    centre = rng.standard_normal(32)
    data = [(r.vec_id, r.embedding[:32], r.label) for r in spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").collect()]
    data += [(10**6 + k, (centre + 0.1 * rng.standard_normal(32)).tolist(), 1) for k in range(700)]
    x = np.array([v for _, v, _ in data], np.float32).astype(float)
    x /= np.linalg.norm(x, axis=1)[:, None]
    label = np.array([l for _, _, l in data])
    want = ((x @ x.T >= 0.98) & (label[:, None] == label)).sum(axis=1) - 1
    got = {r.vec_id: r.n_links for r in pivots.vector_digest(spark.createDataFrame(data, "vec_id long, embedding array<float>, label int")).collect()}
    assert sum(got.values()) >= 0.999 * want.sum() > 10_000 and all(got[i] <= n for (i, _, _), n in zip(data, want.tolist(), strict=True))


def test_search(spark):
    rows = vector_rows(np.random.default_rng(6))
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    ok = [(i, np.array(v)) for i, v, _ in rows if i is not None and good(v)]
    got = {}
    for r in annsearch.search(df, F.col("vec_id") % 20 == 0, 20).collect():
        got.setdefault(r.query_id, {})[r["rank"]] = (r.vec_id, r.score)
    hits = total = 0
    for q, x in ok:
        if q % 20 == 0:
            best = sorted(((-float(x @ y), i) for i, y in ok if i != q))[:20]
            found = [got[q][k] for k in range(1, 21)]
            assert [s for _, s in found] == sorted((s for _, s in found), reverse=True)
            hits += len({i for i, _ in found} & {i for _, i in best})
            total += 20
            for i, s in found:
                assert s == pytest.approx(float(x @ dict(ok)[i]), rel=1e-12)
    assert hits / total >= 0.95
    assert annsearch.search(df.limit(0), F.col("vec_id") % 20 == 0, 20).count() == 0


def brute_search(rows, k=20):
    ok = [(i, np.array(v, float)) for i, v in rows if i is not None and good(v)]
    return {q: [i for _, i in sorted((-float(x @ y), i) for i, y in ok if i != q)[:k]] for q, x in ok if q % 20 == 0}


def searched(spark, rows, **options):
    got = {}
    for r in annsearch.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") % 20 == 0, 20, **options).collect():
        got.setdefault(r.query_id, {})[r["rank"]] = r.vec_id
    return {q: [x[k] for k in range(1, len(x) + 1)] for q, x in got.items()}


@pytest.mark.parametrize("n", [1, 2, 5, 10, 15, 20, 21, 30])
def test_search_of_few(spark, n):
    """With fewer rows than are asked for, all of them are found."""
    rng = np.random.default_rng(n)
    rows = [(k, rng.standard_normal(9).tolist()) for k in range(n)]
    want = {q: x for q, x in brute_search(rows).items() if x}
    got = searched(spark, rows)
    assert {q: len(x) for q, x in got.items()} == {q: len(x) for q, x in want.items()}
    if n <= 21:
        assert got == want


def test_search_of_outliers_and_clusters(spark):
    rng = np.random.default_rng(4)
    centre = rng.standard_normal(16)
    rows = [(k, rng.standard_normal(16).tolist()) for k in range(300)] + [(1000 + k, (centre + 1e-4 * rng.standard_normal(16)).tolist()) for k in range(400)]
    rows += [(2000 + 20 * k, (1e3 * rng.standard_normal(16)).tolist()) for k in range(3)] + [(2100, [1e300] * 16), (2120, [1e-300] * 16), (2140, [1.0, 2.0]), (2141, [3.0])]
    want, got = brute_search([(i, [*v, *[0.0] * (16 - len(v))]) for i, v in rows]), searched(spark, rows, recall=0.5)
    assert {q: len(x) for q, x in got.items()} == {q: 20 for q in want}
    hits = [len(set(got[q]) & set(want[q])) for q in want if q < 2000]
    assert sum(hits) >= 0.5 * 20 * len(hits)


def test_search_recall(spark):
    """Against brute force on whole test tables."""
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").collect()]
    x = np.array([v for _, v in rows])
    ids = np.array([i for i, _ in rows])
    got = {}
    for r in annsearch.search_digest(spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    hits = 0
    for q in got:
        score = x @ x[ids == q][0]
        score[ids == q] = -np.inf
        hits += len(got[q] & set(ids[np.argsort(-score)[:20]].tolist()))
    print("recall", hits / (20 * len(got)))
    assert hits >= 0.9 * 20 * len(got) and set(got) == {i for i in ids.tolist() if i % 20 == 0}


def test_index_retrieves_the_radius():
    rng = np.random.default_rng(2)
    q, r = rng.integers(0, 256, (20, 8), np.uint8), rng.integers(0, 256, (300, 8), np.uint8)
    distance = np.bitwise_count(q[:, None] ^ r[None]).sum(axis=2)
    index = annsearch.Index(r)
    for radius in (0, 7, 8, 20, 33, 64, 80):
        assert all((index.within(x, radius) == np.flatnonzero(d <= radius)).all() for x, d in zip(q, distance, strict=True))
    assert len(annsearch.Index(r[:0]).within(q[0], 64)) == 0


def test_encoder_equals_the_library():
    import random

    rng = random.Random(7)
    parts = ["'s", "'t", "'re", "'", "''", " ", "  ", "\n", "\n\n", "\t", "a", "B", "é", "1", "²", "!", "$$", "ll", "'ll", "中", "😀", " ", "\xa0", "ا", "<|endoftext|>", "́", "\r\n", "word", "x" * 40, "\x00", "\x85"]
    texts = ["".join(rng.choices(parts, k=rng.randint(0, 30))) for _ in range(2000)] + ["", "'", " ", "'s", "a's"]
    e = Encoder(BPE)
    ids, counts = e.encode(texts)
    want = [x.ids for x in Tokenizer.from_file(BPE).encode_batch(texts, add_special_tokens=False)]
    assert any(Tokenizer.from_file(BPE).token_to_id("<|endoftext|>") in x for x in want)
    assert counts.tolist() == [len(x) for x in want] and ids.tolist() == [i for x in want for i in x]


def encoded(local):
    return [[*x.ids, 2] for x in Tokenizer.from_file(BPE).encode_batch([t or "" for _, t in local], add_special_tokens=False)]


def test_ranks_round_trip():
    rng = np.random.default_rng(1)
    for n in (0, 1, 3, 4, 5, 1000):
        ranks = (2 ** rng.uniform(0, 32, n)).astype(np.uint32)
        control, data = token_file.pack_ranks(ranks)
        assert (token_file.unpack_ranks(np.frombuffer(control, np.uint8), np.frombuffer(data, np.uint8), n) == ranks).all()


def test_token_files(spark, docs, local):
    got = sorted((r.start, r.doc_id, r.n_tokens, r.ids_crc32) for r in token_file.token_digest(docs, BPE).collect())
    order = sorted(zip(local, encoded(local), strict=True), key=lambda x: (x[0][0] is not None, x[0][0] or 0, x[0][1] or ""))
    at, want = 0, []
    for (d, _), ids in order:
        want.append((at, d, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    assert got == want
    assert token_file.token_digest(empty(spark), BPE).count() == 0


def test_packing(spark, docs, local):
    packed = packing.pack_documents(docs, BPE, 1024, with_ids=True).collect()
    total = sum(map(len, encoded(local)))
    by_sequence = {}
    for r in packed:
        assert len(r.ids) == r.length and zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32
        by_sequence.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in by_sequence.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 1024
    assert len(by_sequence) <= -(-total // 1024) + 2
    long = sorted((r.piece, r.start, r.length) for r in packed if r.doc_id == 10_006)
    assert all(n == 1024 for _, _, n in long[1:]) and [s for _, s, _ in long] == np.cumsum([0, *(n for _, _, n in long[:-1])]).tolist()
    joined = packing.sequences(spark.createDataFrame(packed)).collect()
    assert sum(len(r.ids) for r in joined) == total
    assert packing.pack_documents(empty(spark), BPE).count() == 0


def test_packing_reaches_the_bound():
    counts = {1000: 30, 24: 30, 600: 10, 424: 10, 512: 8, 300: 9, 700: 9}
    best = packing._best_fit(counts, 1024, {}, np.random.default_rng(0))
    people = packing.evolve(counts, 1024, [best], 1, 30, 6)
    assert sum(people[0].values()) == 30 + 10 + 4 + 9
    for p in people:
        assert not packing._missing(counts, p) and all(packing.fill(x) <= 1024 for x in p)


PATTERNS = [
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m, d: True),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m, d: all(int(x) <= 255 for x in m.split("."))),
    ("card", r"[0-9]([\x20-]?[0-9])+", lambda m, d: 12 <= len(d) <= 19 and sum(sum(divmod(int(c) * (1 + k % 2), 10)) for k, c in enumerate(reversed(d))) % 10 == 0),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m, d: 9 <= len(d) <= 15),
]


def test_pii(spark, docs):
    more = [
        "a@b.co_x@y.zz é 1.2.3.4.5.6.7.300 999.1.1.1 000001.2.3.4 4111 1111 1111 1111, +1 (555) 123-4567.", "x@y @z a@b.c. +12345678 +123456789 4111-1111-1111-1112 4111-1111-1111-1111",
        "a.b+c%d@e-f.g-h.i " * 50, "1 " * 3000, "+1" + " " * 5000 + "2", "@" * 2000 + "a" * 20000, "99999999999999999999999999999999999999999999.1.1.1",
    ]
    df = docs.union(spark.createDataFrame([(20_000 + k, t) for k, t in enumerate(more)], "doc_id long, text string"))
    got = {(r.doc_id, r.text): r for r in pii.find_pii(df).collect()}
    for (_, text), r in got.items():
        want = sorted((m.start(), k, m.end(), name) for k, (name, p, ok) in enumerate(PATTERNS) for m in re.finditer(p, text or "") if ok(m.group(), re.sub("[^0-9]", "", m.group())))
        assert [(s.start, s.rank, s.end, s.kind) for s in r.pii if s.rank < 4] == want
    assert pii.pii_digest(empty(spark)).count() == 0


def test_pii_added_kinds_and_redaction(spark):
    rows = [(1, "IBAN GB82 WEST 1234 5698 7654 32 and GB82 WEST 1234 5698 7654 33"), (2, "my ssn is 123-45-6789"), (3, "part 123-45-6789"), (4, None), (5, "mail a@b.co or 10.0.0.1")]
    got = {r.doc_id: r for r in pii.redact(spark.createDataFrame(rows, "doc_id long, text string").withColumn("PII", F.lit(1))).collect()}
    assert got[1].text == "IBAN [IBAN] and GB82 WEST 1234 5698 7654 33"
    assert got[2].text == "my ssn is [SSN]" and got[3].text == "part 123-45-6789" and got[4].text is None
    assert got[5].text == "mail [EMAIL] or [IP]"


def test_pii_account_numbers_end_at_a_group(spark):
    rows = ["to BE68 5390 0754 7034 IN time", "BE68 5390 0754 7034 PLEASE", "BE68539007547034 NOW", "BE68 5390 0754 7034x", "xBE68 5390 0754 7034", "BE68 5390 0754 7035 IN"]
    df = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    got = {r.doc_id: r.text for r in pii.redact(df).collect()}
    assert got == {0: "to [IBAN] IN time", 1: "[IBAN] PLEASE", 2: "[IBAN] NOW", **{k: rows[k] for k in (3, 4, 5)}}
    whole = {r.doc_id: [s.kind for s in r.pii] for r in pii.find_pii(df, shorter=False).collect()}
    assert whole[0] == [] and whole[5] == []


@pytest.mark.parametrize("n", [1, 255, 256, 257, 1000, 20_000])
def test_pii_many_matches(spark, n):
    texts = ["é a@b.co 1.2.3.4, " * n, "".join(f"<{k}@x.org>+12345678{k}" for k in range(n))]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    plain = {r.doc_id: r.text for r in pii.redact(df).collect()}
    assert plain[0] == "é [EMAIL] [IP], " * n
    for r in pii.find_pii(df).collect():
        want = sorted((m.start(), k, m.end()) for k, (_, p, ok) in enumerate(PATTERNS) for m in re.finditer(p, r.text) if ok(m.group(), re.sub("[^0-9]", "", m.group())))
        assert [(s.start, s.rank, s.end) for s in r.pii if s.rank < 4] == want
        out, at = [], 0
        for s in r.pii:
            if s.start >= at:
                out.append(r.text[at : s.start] + f"[{s.kind.upper()}]")
            at = max(at, s.end)
        assert plain[r.doc_id] == "".join(out) + r.text[at:]


def brute_rake(cells, power, rounds=200):
    fitted = {k: float(v) for k, v in cells.items()}
    total = sum(fitted.values())
    shares = []
    for axis in range(3):
        sums = {}
        for k, v in cells.items():
            sums[k[axis]] = sums.get(k[axis], 0) + v
        raised = {x: v**power for x, v in sums.items() if v}
        shares.append({x: v / sum(raised.values()) * total for x, v in raised.items()})
    for _ in range(rounds):
        for axis in range(3):
            have = {}
            for k, v in fitted.items():
                have[k[axis]] = have.get(k[axis], 0) + v
            for k in fitted:
                fitted[k] *= shares[axis].get(k[axis], 0) / have[k[axis]] if have[k[axis]] else 0
    return fitted


@pytest.mark.parametrize("driver_cells", [100, 0])
def test_mixing(spark, driver_cells):
    rng = np.random.default_rng(4)
    rows = [(k, *(str(rng.integers(0, n)) if rng.random() > 0.05 else None for n in (3, 2, 2)), int(rng.integers(1, 50))) for k in range(200)] + [(900, "9", "9", "9", 0), (901, "0", "0", "0", None), (None, "0", "0", "0", 5)]
    df = spark.createDataFrame(rows, "doc_id long, source string, lang string, topic string, tokens long").withColumn("KEPT", F.lit("x"))
    got = mixing.mix(df, "tokens", ["source", "lang", "topic"], driver_cells=driver_cells, rounds=12 if driver_cells == 0 else 200, tolerance=1e-6).collect()
    cells = {}
    for r in rows:
        key = tuple(x or "(none)" for x in r[1:4])
        cells[key] = cells.get(key, 0) + (r[4] or 0)
    want = brute_rake(cells, 0.7)
    assert len(got) == len(rows)
    for r in got:
        key = tuple(x or "(none)" for x in (r.source, r.lang, r.topic))
        assert r.weight == pytest.approx(want[key] / cells[key] if cells[key] else 1, rel=1e-2)
        assert 0 <= r.probability <= 1
    assert max(r.probability for r in got) == pytest.approx(1)


@pytest.mark.parametrize("driver_cells", [10_000, 0])
def test_mixing_meets_its_targets_with_a_share(spark, driver_cells):
    """Expected tokens of every margin's value are the bounded targets, and probabilities those of brute force."""
    rng = np.random.default_rng(6)
    rows = [(k, *(str(min(rng.geometric(0.5), n)) for n in (6, 4, 3)), int(rng.integers(1, 50))) for k in range(3000)]
    margins = ["source", "lang", "topic"]
    df = spark.createDataFrame(rows, "doc_id long, source string, lang string, topic string, tokens long")
    mixed = mixing.mix(df, "tokens", margins, keep=0.6, power=0.4, driver_cells=driver_cells, rounds=20_000 if driver_cells else 12, tolerance=1e-7).cache()
    total = sum(r[4] for r in rows)
    near = 1e-5 if driver_cells else 0.01
    cells = {}
    for r in rows:
        cells[r[1:4]] = cells.get(r[1:4], 0) + r[4]
    wants = []
    for k, m in enumerate(margins):
        have = {}
        for c, t in cells.items():
            have[c[k]] = have.get(c[k], 0) + t
        lo, hi = 0.0, 1e9  # the level at which bounded targets add up, by bisection
        for _ in range(200):
            mid = (lo + hi) / 2
            lo, hi = (mid, hi) if sum(min(t, mid * t**0.4) for t in have.values()) < 0.6 * total else (lo, mid)
        want = {v: min(t, lo * t**0.4) for v, t in have.items()}
        wants.append(want)
        got = {r.value: r.expected for r in mixing.shares(mixed, "tokens", m).collect()}
        assert all(got[v] == pytest.approx(x / (0.6 * total), abs=near) for v, x in want.items())
    assert any(sum(t for c, t in cells.items() if c[k] == v) == x for k, w in enumerate(wants) for v, x in w.items())
    factor = dict.fromkeys(cells, 1.0)
    for _ in range(6000):
        for k, want in enumerate(wants):
            now = {}
            for c, t in cells.items():
                now[c[k]] = now.get(c[k], 0) + t * min(1, factor[c])
            for c in cells:
                factor[c] = min(1e12, factor[c] * want[c[k]] / now[c[k]])
    if driver_cells:  # twelve rounds of group-bys are not enough for that
        assert all(r.probability == pytest.approx(min(1, factor[r.source, r.lang, r.topic]), abs=1e-3) for r in mixed.collect())


def test_mixing_keeps_a_share(spark):
    df = spark.range(20_000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 10 == 0, "rare").otherwise("common").alias("source"), F.lit(10).alias("tokens"))
    got = mixing.mix(df, "tokens", ["source"], keep=0.5)
    kept = {r.source: r["count"] for r in got.filter("kept").groupBy("source").count().collect()}
    assert sum(kept.values()) == pytest.approx(10_000, rel=0.03) and kept["rare"] / 2000 > kept["common"] / 18_000
    assert mixing.mix(df.limit(0), "tokens", ["source"]).count() == 0
    aimed = mixing.mix(df, "tokens", ["source"], targets=[{"rare": 1.0}]).filter("kept").select("source").distinct().collect()
    assert [r.source for r in aimed] == ["rare"]


def test_language(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = langid.langid_digest(docs).join(docs, "doc_id").collect()
    assert len(got) == docs.count()
    held = [r for r in got if zlib.crc32(str(r.doc_id).encode()) % 3 == 1]
    assert all(r.held_out for r in held) and sum(r.held_out for r in got) == len(held)
    assert np.mean([r.lang == r.lang_pred for r in held]) > 0.98
    assert all(0 <= r.score <= 1 for r in got)


def test_language_of_odd_texts(spark):
    rows = [(1, "the cat", "en"), (2, "le chat", "fr"), (3, None, "en"), (4, "", None), (5, "12 34 !", "fr"), (6, "the", None), (None, "the the", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("Score", F.lit("x"))
    model = langid.train(df)
    got = {r.doc_id: r.lang_pred for r in langid.identify(df, model).collect()}
    assert got == {1: "en", 2: "fr", 3: "und", 4: "und", 5: "und", 6: "en", None: "en"}
    nothing = langid.train(df.filter("lang IS NULL"))
    assert {r.lang_pred for r in langid.identify(df, nothing).collect()} == {"und"}


def bucket(gram, buckets):
    """An n-gram's bucket by plain arithmetic."""
    mixed = 0
    for c in gram:
        mixed = (mixed * 0x01000193 & 0xFFFFFFFF) ^ ord(c)
    return ((mixed + len(gram)) * 0x9E3779B1 & 0xFFFFFFFF) >> (32 - (buckets.bit_length() - 1))


@pytest.mark.parametrize("chunk", [1, 2, 3, 4, 5, 7, 1000])
def test_language_pieces_hold_every_gram_once(monkeypatch, chunk):
    monkeypatch.setattr(langid, "CHUNK_CHARS", chunk)
    texts = ["", "a", "Ab c", "É𐍈xyz" * 3, "aaaaaaaaaa", "İß"]
    got = {k: [] for k in range(len(texts))}
    for which, pieces, tails in langid._pieces(texts, 2):
        found, owner = langid._hashed(pieces, tails, 1 << 14, (1, 2, 3))
        for f, o in zip(found.tolist(), owner.tolist(), strict=True):
            got[int(which[o])].append(f)
    for k, t in enumerate(texts):
        low = f" {t.lower()} "
        assert sorted(got[k]) == sorted(bucket(low[i : i + n], 1 << 14) for n in (1, 2, 3) for i in range(len(low) - n + 1))


def test_language_by_brute_force(monkeypatch, spark):
    rows = [(0, "the cat sat on the mat", "en"), (1, "der Hund und die Katze", "de"), (2, "le chat est sur la table", "fr"), (3, "the dog and the cat", "en"), (4, None, "en"), (5, "x", None)]
    model = langid.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"), buckets=1 << 10)
    grams = lambda t: [bucket(f" {t.lower()} "[i : i + n], 1 << 10) for n in (1, 2, 3) for i in range(len(t) + 3 - n)]
    known = [(t, x) for _, t, x in rows if t and x]
    texts = ["the mat", "die Katze", "la table est", "zzz", "the cat " * 40]
    monkeypatch.setattr(langid, "CHUNK_CHARS", 50)
    names, scores = langid.predict(model, texts)
    for text, name, score in zip(texts, names, scores, strict=True):
        total = {}
        for lang in ("de", "en", "fr"):
            count = Counter(g for t, x in known if x == lang for g in grams(t))
            n = sum(count.values()) + 0.5 * 1024
            total[lang] = math.log(sum(x == lang for _, x in known) / len(known)) + sum(math.log((count[g] + 0.5) / n) for g in grams(text))
        best = max(sorted(total), key=total.get)
        assert name == best and abs(score - 1 / sum(math.exp(v - total[best]) for v in total.values())) < 1e-4


def test_features_by_hand():
    found, owner = langid.features(["Ab", ""], 1 << 10, (2,))
    assert owner.tolist() == [0, 0, 0, 1]
    assert (found == langid.features(["ab", ""], 1 << 10, (2,))[0]).all()
