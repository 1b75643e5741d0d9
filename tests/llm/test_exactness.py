"""Texts that are built alike, hot keys, trees that prune, draws by weight, and plain loops beside the array code."""

import collections
import hashlib
import itertools
import re

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from gridloom.llm import bagminhash, bpe, common, components, covertree, langid, licenses, line_rules, mixing, resample, shards, unigram
from gridloom.llm import textvec as V

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")


def thue_morse(n, letters="ab"):
    return "".join(letters[k.bit_count() & 1] for k in range(n))


TWINS = [t for n in (1024, 4096) for t in (thue_morse(n), thue_morse(n, "ba"))]


# ---- equal hashes of texts that are built alike


def test_hashes_tell_twins_apart():
    data = np.frombuffer("".join(TWINS).encode(), np.uint8)
    ends = np.cumsum([len(t) for t in TWINS])
    assert len(set(V.span_hashes(data, ends - [len(t) for t in TWINS], ends).tolist())) == len(TWINS)
    empty = np.array([3, 5]), np.array([3, 5])
    assert len(set(V.span_hashes(data, *empty).tolist())) == 1
    which, some = V.codes(data, np.array([0, 1, 0]), np.array([2, 3, 2]))
    assert which.tolist() == [0, 1, 0] and some.to_pylist() == [b"ab", b"bb"]


@settings(max_examples=40, deadline=None)
@given(st.lists(st.binary(max_size=20), max_size=12), st.integers(0, 7))
def test_hashes_do_not_depend_on_the_place(parts, shift):
    data = np.frombuffer(bytes(shift) + b"".join(parts) + b"tail", np.uint8)
    size = np.array([len(p) for p in parts], np.int64)
    ends = shift + np.cumsum(size)
    got = V.span_hashes(data, ends - size, ends).tolist()
    by = {}
    for p, h in zip(parts, got, strict=True):
        assert by.setdefault(p, h) == h
    assert len(set(by.values())) == len(by)


def test_twins_are_encoded_as_the_library_does(spark):
    ranks = {t: k for k, t in enumerate(bpe.read_ranks(RANKS))}
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    table = spark.createDataFrame(list(enumerate(TWINS)), "doc_id long, text string").coalesce(1)
    for r in bpe.bpe_round_trip(table, RANKS, public_tokenizers.PATTERN).collect():
        ids = library.encode_ordinary(TWINS[r["doc_id"]])
        assert r["n_tokens"] == len(ids) and r["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(TWINS[r["doc_id"]].encode()).hexdigest()


def test_codec_forgets_and_still_encodes(monkeypatch):
    monkeypatch.setattr(bpe, "CACHED", 1)
    own = bpe.Codec(bpe.model_proto(bpe.read_ranks(RANKS)), public_tokenizers.PATTERN)
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks={t: k for k, t in enumerate(bpe.read_ranks(RANKS))}, special_tokens={})
    rng = np.random.default_rng(0)
    for _ in range(6):
        texts = [" ".join("".join(rng.choice(list("abcdeé"), 9)) for _ in range(40)) for _ in range(3)]
        block = next(V.blocks(pa.array(texts)))
        ids, cut = own.encode(block)
        assert [ids[a:b].tolist() for a, b in zip(cut[:-1], cut[1:], strict=True)] == [library.encode_ordinary(t) for t in texts]
        assert own.decode(ids) == "".join(texts).encode()


def test_twins_are_counted_apart():
    vocabulary = [("▁", -3.0), ("a", -2.0), ("b", -2.5), ("ab", -2.2), ("ba", -3.9), ("abba", -4.0)]
    alone = [unigram.Counter(vocabulary).block(next(V.blocks(pa.array([t])))) for t in TWINS]
    n, score = unigram.Counter(vocabulary).block(next(V.blocks(pa.array(TWINS))))
    assert n.tolist() == [int(a[0][0]) for a in alone] and np.allclose(score, [a[1][0] for a in alone])
    assert len({(int(x), round(float(s), 6)) for x, s in zip(n, score, strict=True)}) == len(TWINS)


def test_twins_are_different_lines_and_windows():
    a, b = TWINS[:2]
    counts, _, _ = line_rules.judge(next(V.blocks(pa.array([f"{a}\n{b}", f"{a}\n{a}", " ".join(["x", a, b, "y", "z", "x", b, a, "y", "z"]), " ".join(["x", a, b, "y", "z"] * 2)]))))
    assert counts["n_dup_lines"].tolist() == [0, 1, 0, 0] and counts["n_repeat_words"].tolist() == [0, 0, 0, 10]


def test_windows_of_equal_hash_are_compared():
    keys = np.zeros(5, np.uint64)
    parts = np.array([[1, 2], [3, 4], [1, 2], [5, 6], [3, 5]])
    assert line_rules._repeated(keys, parts).tolist() == [True, False, True, False, False]


def test_twins_are_not_near_duplicates(spark):
    table = spark.createDataFrame(list(enumerate(TWINS)), "doc_id long, text string").coalesce(1)
    assert {r["class_size"] for r in bagminhash.near_duplicates(table).collect()} == {1}


def test_nodes_of_equal_digest_are_told_apart(spark):
    rows = spark.createDataFrame([(1, 7, 1), (2, 7, 1), (3, 7, 2), (4, 9, 5)], "id long, node long, check long")
    got = {r["id"]: r["node"] for r in bagminhash._told_apart(rows).collect()}
    assert got[1] == got[2] != got[3] and len(set(got.values())) == 3


# ---- hot keys


def test_join_of_hot_keys(spark, monkeypatch):
    monkeypatch.setattr(components, "FLOOR", 10)
    monkeypatch.setattr(components, "SHARE", 4)
    many = common.settle(spark.createDataFrame([(1, k) for k in range(50)] + [(2, 0), (3, 1), (None, 5), (9, 9)], "k long, x long"))
    one = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "k long, y string")
    assert collections.Counter(r["y"] for r in components.join_unique(many, one, "k").collect()) == {"a": 50, "b": 1, "c": 1}
    assert sorted(str(r["y"]) for r in components.join_unique(many, one, "k", "left").where("k is null or k > 3").collect()) == ["None", "None"]
    hub = spark.createDataFrame([(0, k) for k in range(1, 200)] + [(500, 501), (501, 700)], "a long, b long")
    got = {r["a"]: r["b"] for r in components.stars(hub).collect()}
    assert got == {k: 0 for k in range(1, 200)} | {501: 500, 700: 500}


def family(n, words, edits, seed):
    rng = np.random.default_rng(seed)
    base = [f"f{seed}w{k}" for k in range(words)]
    out = []
    for _ in range(n):
        own = list(base)
        for k in rng.integers(0, words, rng.integers(0, edits + 1)):
            own[k] = f"x{rng.integers(1 << 40)}"
        out.append(" ".join(own))
    return out


@pytest.mark.parametrize("leaders, heads, cell", [(0, 1, 7), (2, 2, 512)])
def test_large_buckets_lose_no_link(spark, monkeypatch, leaders, heads, cell):
    """Many classes in one bucket: the same as by all pairs, whatever way is taken."""
    for name, value in (("LARGE", 4), ("LEADERS", leaders), ("HEADS", heads), ("CELL", cell)):
        monkeypatch.setattr(bagminhash, name, value)
    texts = family(150, 120, 9, 1) + family(60, 60, 4, 2)
    rows = list(enumerate(texts))
    got = {r["doc_id"]: r["class_id"] for r in bagminhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    sets = bagminhash._multisets(pa.array(texts))
    at = list(range(len(rows)))

    def root(k):
        while at[k] != k:
            k = at[k]
        return k

    for i in range(len(rows)):
        for j in range(i):
            if bagminhash.overlap(sets[i], sets[j]) >= bagminhash.SIMILAR:
                x, y = root(i), root(j)
                at[max(x, y)] = min(x, y)
    assert got == {k: root(k) for k in range(len(rows))}
    assert 20 < len(set(got.values())) < len(rows)


@settings(max_examples=30, deadline=None)
@given(st.lists(st.lists(st.integers(0, 6), max_size=40), min_size=2, max_size=4))
def test_parities_bound_the_difference(texts):
    block = next(V.blocks(pa.array([" ".join(f"w{k}" for k in t) for t in texts]), 1 << 20))
    doc, keys, size = bagminhash._elements(block)
    bits = bagminhash.parities(doc, keys, block.rows)
    sets = [set(keys[doc == d].tolist()) for d in range(block.rows)]
    for a, b in itertools.combinations(range(block.rows), 2):
        differ = int(bagminhash.differing(bits[[a]], bits[[b]])[0])
        assert differ <= len(sets[a] ^ sets[b]) and len(sets[a]) == size[a]
        whole, common_ = len(sets[a] | sets[b]), len(sets[a] & sets[b])
        if whole and 5 * common_ >= 4 * whole:
            assert 9 * differ <= size[a] + size[b]


# ---- cover trees


def nodes(tree):
    out, todo = [], [tree]
    while todo:
        out.append(todo.pop())
        todo += out[-1].children
    return out


@pytest.mark.parametrize("clustered", [True, False])
def test_trees_have_levels_and_keep_their_rules(clustered):
    rng = np.random.default_rng(3)
    points = rng.normal(size=(1500, 64)) * 256
    if clustered:
        points = rng.normal(size=(30, 64))[rng.integers(0, 30, 1500)] * 256 + rng.normal(size=(1500, 64)) * 4
    points[700:900] = points[3]  # copies
    tree = covertree.cover_tree(points)
    every = nodes(tree)
    assert len(every) > 50 and any(c.children for c in tree.children)
    for node in every:
        own = points[node.rows]
        assert (own[0] == node.centre).all() and np.sqrt(((own - node.centre) ** 2).sum(axis=1)).max() <= node.radius + 1e-9
        assert node.children or len(own) <= covertree.LEAF or node.radius == 0
        if node.children:
            centres = np.array([c.centre for c in node.children])
            gap = np.sqrt(((centres[:, None] - centres) ** 2).sum(axis=2)) + np.eye(len(centres)) * 1e9
            assert gap.min() > node.radius / covertree.BASE - 1e-9  # separation
            assert max(c.radius for c in node.children) <= node.radius / covertree.BASE + 1e-9  # covering
            assert (node.children[0].centre == node.centre).all()  # nesting
            assert sorted(np.concatenate([c.rows for c in node.children])) == sorted(node.rows)


def test_search_prunes_clusters_and_stays_exact():
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(40, 64)) * 256
    points = np.floor(centres[rng.integers(0, 40, 4000)] + rng.normal(size=(4000, 64)) * 4)
    ids, asked = np.arange(4000), np.arange(0, 4000, 4)
    search = covertree.Search(asked, points[asked], 5)
    search.meet(ids, points, covertree.cover_tree(points))
    assert search.visited > 100 and search.multiplied < 0.5 * len(asked) * 4000
    score = points[asked] @ points.T
    score[np.arange(len(asked)), asked] = -np.inf
    for k in range(len(asked)):
        best = np.lexsort((ids, -score[k]))[:5]
        assert search.found[k].tolist() == best.tolist() and search.score[k].tolist() == score[k][best].astype(int).tolist()


def test_cells_are_bounded_and_rows_dealt(spark, monkeypatch):
    rng = np.random.default_rng(5)
    assert len(covertree.upper_levels(rng.normal(size=(3000, 64)), 50)) <= covertree.CELLS
    assert len(covertree.upper_levels(np.zeros((10, 3)), 50)) == 1
    monkeypatch.setattr(covertree, "BLOCK", 64)
    hot = [(k, [1.0] * 4) for k in range(400)] + [(1000 + k, rng.normal(size=4).tolist()) for k in range(200)]
    got = covertree.top_k(spark.createDataFrame(hot, "vec_id long, embedding array<double>"), F.col("vec_id") % 50 == 0, k=3).collect()
    ints = {i: np.floor(256 * np.array(v)) for i, v in hot}
    for q, rows in itertools.groupby(sorted(map(tuple, got)), lambda r: r[0]):
        best = sorted((-int(ints[q] @ v), i) for i, v in ints.items() if i != q)[:3]
        assert [(r[2], r[3]) for r in rows] == [(i, -s) for s, i in best]


def test_many_queries_are_few_products(monkeypatch):
    rng = np.random.default_rng(6)
    points = np.floor(rng.normal(size=(4000, 64)) * 32)
    ids, asked, made, real = np.arange(4000) // 2, np.arange(0, 4000, 4), [], covertree._products
    monkeypatch.setattr(covertree, "_products", lambda *a: made.append(1) or real(*a))
    search = covertree.Search(ids[asked], points[asked], 5)
    search.meet(ids, points, covertree.cover_tree(points))
    assert len(made) < 100  # nothing can be pruned here, and a product of matrices has some 2^20 pairs
    score = points[asked] @ points.T
    score[ids[asked][:, None] == ids] = -np.inf
    for k in range(len(asked)):
        best = np.lexsort((ids, -score[k]))[:5]
        assert search.found[k].tolist() == ids[best].tolist() and search.score[k].tolist() == score[k][best].astype(int).tolist()


def test_trees_are_built_once(spark, monkeypatch, tmp_path):
    log, real = str(tmp_path / "trees"), covertree.cover_tree

    def logged(points, *rest, **more):
        if not rest:  # a whole tree
            with open(log, "a") as file:
                file.write(f"{len(points)}\n")
        return real(points, *rest, **more)

    monkeypatch.setattr(covertree, "BLOCK", 64)
    monkeypatch.setattr(covertree, "cover_tree", logged)
    rng = np.random.default_rng(7)
    rows = [(k, rng.normal(size=8).tolist()) for k in range(3000)]
    got = covertree.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") % 5 == 0).collect()
    ints = np.floor(256 * np.array([v for _, v in rows]))
    want = []
    for q in range(0, 3000, 5):
        score = ints @ ints[q]
        score[q] = -np.inf
        want += [(q, n, int(i), int(score[i])) for n, i in enumerate(np.lexsort((np.arange(3000), -score))[:5], 1)]
    assert sorted(map(tuple, got)) == want
    with open(log) as file:
        assert sum(map(int, file)) <= 3 * len(rows)  # the sample, and each row at most once for floors and once for results


# ---- resampling


def plain_features(text):
    """Tokens, pairs, shapes and pairs of shapes of one text, a token at a time."""
    one = lambda b: V.span_hashes(np.frombuffer(b, np.uint8), np.array([0]), np.array([len(b)]))[0]
    two = lambda a, b: V.mix(np.array([a], np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.array([b], np.uint64))[0]
    tokens = re.findall(rb"[A-Za-z0-9\x80-\xff]+|[^A-Za-z0-9\x80-\xff\x09-\x0d ]+", text.encode())
    small = [one(t.lower() if t.isascii() else bytes(b + 32 if 65 <= b <= 90 else b for b in t)) for t in tokens]
    shapes = []
    for k, t in enumerate(tokens):
        if t[:1].isalnum() or t[0] >= 128:
            shape = (65 <= t[0] <= 90) + 2 * any(65 <= b <= 90 for b in t) + 4 * any(97 <= b <= 122 for b in t) + 8 * any(48 <= b <= 57 for b in t) + 16 * min(len(t), 2)
            shape += 64 * int(k > 0 and small[k] == small[k - 1])
        else:
            shape = int(small[k])
        shapes.append(V.mix(np.array([int(shape) + 1 & (1 << 64) - 1], np.uint64))[0])
    pairs = lambda x: [two(a, b) for a, b in itertools.pairwise(x)]
    words = [int(h % resample.WORDS) for h in small + pairs(small)]
    return collections.Counter(words + [resample.WORDS + int(h % resample.SHAPES) for h in shapes + pairs(shapes)])


def test_features_and_weights_by_plain_loops(spark):
    texts = ["Aa bb bb! 12x", "", "É é ü?? a\tb", "one two three two one", "!! !! !!", "word " * 30]
    block = next(V.blocks(pa.array(texts)))
    cells, doc = resample.features(block)
    want = [plain_features(t) for t in texts]
    assert [collections.Counter(cells[doc == d].tolist()) for d in range(len(texts))] == want
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    ratios = resample.models(table, spark.createDataFrame([(3,)], "doc_id long"))
    raw, target = sum(want, collections.Counter()), want[3]
    for lo, hi in ((0, resample.WORDS), (resample.WORDS, resample.MODEL)):
        n, m = sum(v for k, v in raw.items() if lo <= k < hi), sum(v for k, v in target.items() if lo <= k < hi)
        for c in [k for k in raw if lo <= k < hi]:
            q = (raw[c] + 1) / (n + hi - lo)
            assert ratios[c] == pytest.approx(np.log((target[c] + q * (hi - lo)) / (m + hi - lo) / q))
    for r in resample.weigh(table, ratios).collect():
        own = want[r["doc_id"]]
        n, total = sum(own.values()), sum(ratios[c] * k for c, k in own.items())
        assert r["n_features"] == n and r["log_weight"] == pytest.approx(total * min(n, resample.EVIDENCE) / max(1, n), abs=1e-9)


def test_draws_follow_the_weights(spark):
    """200 draws of 4 out of 8 documents: inclusion rates of successive sampling by the weights, and not a threshold."""
    texts = ["good " * 30, "good good fine " * 10, "fine fine odd " * 8, "odd fine odd " * 9, "odd odd odd good " * 7, "bad odd bad " * 9, "bad bad odd bad " * 7, "bad " * 30]
    ratios = np.zeros(resample.MODEL)
    steps = {"good": 0.0, "fine": -0.02, "odd": -0.08, "bad": -0.15}
    for word, value in steps.items():
        for cell in plain_features(word):
            if cell < resample.WORDS:
                ratios[cell] = value * 4
    runs = 200
    rows = [(run * 100 + k, t) for run in range(runs) for k, t in enumerate(texts)]
    got = resample.weigh(spark.createDataFrame(rows, "doc_id long, text string"), ratios).collect()
    draws, logs = collections.defaultdict(list), {}
    for r in got:
        draws[r["doc_id"] // 100].append((r["draw"], r["doc_id"] % 100))
        logs[r["doc_id"] % 100] = r["log_weight"]
    picked = [frozenset(k for _, k in sorted(d, reverse=True)[:4]) for d in draws.values()]
    rng = np.random.default_rng(0)
    w = np.exp([logs[k] for k in range(8)])
    exact = np.mean([np.isin(np.arange(8), rng.choice(8, 4, replace=False, p=w / w.sum())) for _ in range(20000)], axis=0)
    rates = np.array([np.mean([k in p for p in picked]) for k in range(8)])
    assert np.abs(rates - exact).max() < 0.12 and len(set(picked)) > 20
    assert rates[0] > rates[3] > rates[7] and w.max() / w.min() > 2


def test_effective_sample_size(spark):
    rows = spark.createDataFrame([(0.0,)] * 10 + [(float(np.log(0.5)),)] * 4 + [(-50.0,)] * 6, "log_weight double")
    assert resample.sample_size(rows) == round(12**2 / 11)
    assert resample.sample_size(rows.limit(0)) == 0


def test_draws_follow_the_weights(spark):
    small = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{small}/{n}.parquet") for n in ("documents", "labels"))
    good = labels.where("quality = 1")
    rows = resample.weigh(docs, resample.models(docs, good)).where("n_features > 0").toPandas().drop_duplicates("doc_id").sort_values("doc_id")
    ids, w = rows["doc_id"].to_numpy(), rows["log_weight"].to_numpy()
    drawn = {r["doc_id"] for r in resample.resample(docs, good).collect()}
    top = set(ids[np.argsort(-w)[: len(drawn)]])
    assert len(drawn - top) > 0.05 * len(drawn)  # no threshold gives this set
    assert not drawn.intersection(r["doc_id"] for r in labels.where("quality = 0").collect())
    rng = np.random.default_rng(2)
    rates = np.zeros(len(ids))
    for _ in range(400):
        rates[np.argsort(-(w + rng.gumbel(size=len(w))))[: len(drawn)]] += 1 / 400
    doubt = (rates > 0.05) & (rates < 0.95)
    assert doubt.mean() > 0.1
    ranks = lambda x: np.argsort(np.argsort(x))
    expected = 1 - np.exp(-np.exp(w))  # one that grows with the weight alone
    steps = np.array_split(np.argsort(expected[doubt], kind="stable"), 10)
    means = [rates[doubt][s].mean() for s in steps]
    assert np.corrcoef(ranks(np.array(means)), np.arange(10))[0, 1] > 0.9


def test_equal_rows_at_the_last_place_are_drawn_together(spark):
    docs = spark.createDataFrame([(k, f"word{k} and some more") for k in range(6)] + [(2, "word2 and some more")] * 3, "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long")
    for k in range(1, 10):
        got = [r["doc_id"] for r in resample.resample(docs, none, k=k).collect()]
        assert got.count(2) in (0, 4) and k <= len(got) <= k + 3


# ---- networks, classifiers and flows by plain loops


def test_network_by_plain_loops():
    rng = np.random.default_rng(1)
    n, c = langid.HIDDEN, 3
    draw = lambda *s: rng.normal(0, 0.5, s).astype(np.float32)
    net = langid.Network(["a", "b", "c"], [draw(3 * n, 256) for _ in range(2)], [draw(3 * n, n) for _ in range(2)], draw(c, 2 * n), draw(c))
    texts = ["hello wörld", "", "x" * 300, "ab" * 64, "é"]
    got = langid.probabilities(net, next(V.blocks(pa.array(texts))))

    def states(table, recur, data):
        h, out = np.zeros(n), []
        for b in data:
            gate, back = table[:, b].astype(float), recur.astype(float) @ h
            z, r = (np.clip(gate[k * n : (k + 1) * n] + back[k * n : (k + 1) * n], 0, 1) for k in (0, 1))
            cand = gate[2 * n :] + r * back[2 * n :]
            h = h + z * (cand / (1 + np.abs(cand)) - h)
            out.append(h)
        return out

    for text, p in zip(texts, got, strict=True):
        raw, sums = text.encode(), np.zeros(c)
        for at in range(0, len(raw), langid.WINDOW):
            data = raw[at : at + langid.WINDOW]
            ahead = states(net.table[0], net.recur[0], data)
            behind = states(net.table[1], net.recur[1], data[::-1])[::-1]
            for a, b in zip(ahead, behind, strict=True):
                e = np.exp(net.out @ np.concatenate([a, b]) + net.bias)
                sums += e / e.sum()
        assert np.allclose(p, sums / max(1, len(raw)), atol=1e-4)


def test_ties_of_languages_go_to_the_first():
    n = langid.HIDDEN
    net = langid.Network(["a", "b"], [np.zeros((3 * n, 256), np.float32)] * 2, [np.zeros((3 * n, n), np.float32)] * 2, np.zeros((2, 2 * n), np.float32), np.zeros(2, np.float32))
    names, score = langid.predict(net, next(V.blocks(pa.array(["text", "123"]))))
    assert names == ["a", langid.UNKNOWN] and score.tolist() == [pytest.approx(0.5), 0.0]


def test_language_columns_of_clashing_names(spark):
    table = spark.createDataFrame([(1, "the text", "en", "x", 1.0, True)], "doc_id long, text string, lang string, lang_pred string, score double, held_out boolean")
    got = langid.identify(table, None, passed={"held_out": F.expr(langid.HELD_OUT)})
    assert got.columns == ["doc_id", "held_out", "lang_pred", "score"] and got.collect()[0]["lang_pred"] == langid.UNKNOWN


def test_license_scores_by_plain_loops():
    rng = np.random.default_rng(2)
    families = ["X", "Y", licenses.UNKNOWN, licenses.NONE]
    model = licenses.Classifier(families, rng.normal(size=(licenses.CELLS, 4)).astype(np.float32), rng.normal(size=4).astype(np.float32), 1.3, [[], []], [np.zeros(0, np.uint64)] * 2, np.zeros(0, np.uint64), 0.5)
    texts = ["One two, THREE four-five six seven eight nine ten eleven twelve thirteen fourteen\nshort line", "", "a b c", " ".join(f"w{k}" for k in range(40))]
    lines, p, line, start, end, two = model.scores(next(V.blocks(pa.array(texts))))
    want = []
    for text in texts:
        for row in text.split("\n"):
            words = [w.lower().encode() for w in re.findall(r"[A-Za-z0-9]+", row)]
            if not words:
                continue
            h = V.span_hashes(np.frombuffer(b"".join(words), np.uint8), *(np.cumsum([0, *map(len, words)])[k : len(words) + k] for k in (0, 1)))
            step = licenses.STEP
            for at in range(0, max(1, len(words) - step), step):
                own = h[at : at + 2 * step]
                z = sum(model.weights[int(x % licenses.CELLS)] for x in own)
                z = z + sum((model.weights[int(x % licenses.CELLS)] for x in licenses._bigrams(own)), np.zeros(4))
                want.append(licenses._softmax(((z / np.sqrt(2 * len(own) - 1) + model.bias) / model.temperature)[None])[0])
    assert len(p) == len(want) and np.allclose(p, want, atol=1e-4)


@settings(max_examples=25, deadline=None)
@given(st.lists(st.integers(1, 3), min_size=2, max_size=2), st.lists(st.integers(0, 7), min_size=2, max_size=2), st.integers(0, 2))
def test_flow_is_the_cheapest_of_the_largest(sizes, quotas, shape):
    members = [{"p": ["a"], "q": ["a", "b"]}, {"p": ["a", "b"], "q": ["a", "b"]}, {"p": ["b"], "q": ["b"]}][shape]
    size, quota = dict(zip("pq", sizes, strict=True)), dict(zip("ab", quotas, strict=True))
    cost = lambda n, f: sum(k // n for k in range(f))  # noqa: E731 - the k-th word costs as many as whole copies before it
    best = None
    arcs = [(p, s) for p in "pq" for s in members[p]]
    for flow in itertools.product(*(range(3 * size[p] + 1) for p, _ in arcs)):
        give = {p: sum(f for f, (x, _) in zip(flow, arcs, strict=True) if x == p) for p in "pq"}
        take = {s: sum(f for f, (_, x) in zip(flow, arcs, strict=True) if x == s) for s in "ab"}
        if all(give[p] <= 3 * size[p] for p in "pq") and all(take[s] <= quota[s] for s in "ab"):
            key = (-sum(flow), sum(cost(size[p], give[p]) for p in "pq"))
            best = min(best, key) if best else key
    got = mixing.route(size, members, quota, 3)
    assert (-sum(got.values()), sum(cost(size[p], got[p]) for p in "pq")) == best


# ---- shards


def test_shards_of_odd_rows(spark, tmp_path):
    """Null ids, rows that are repeated, clashing names, null and empty texts."""
    rows = [(1, "alpha beta " * 300, "s", 9), (1, "alpha beta " * 300, "s", 9), (None, "no id", "s", 9), (2, None, "s", 9), (3, "", "s", 9)]
    table = spark.createDataFrame(rows, "doc_id long, text string, shard string, slot long")
    end = len(bpe.read_ranks(RANKS))
    got = shards.write_shards(table, RANKS, public_tokenizers.PATTERN, f"file://{tmp_path}", length=64, per_shard=8).collect()
    own = bpe.Codec(bpe.model_proto(bpe.read_ranks(RANKS)), public_tokenizers.PATTERN)
    ids = [own.encode(next(V.blocks(pa.array([t or ""]))))[0] for _, t, _, _ in rows]
    assert collections.Counter(r["doc_id"] for r in got) == {1: 2 * -(-len(ids[0]) // 64), None: 1}
    assert sorted(r["slot"] for r in got) == list(range(len(got)))
    read = list(shards.read_sequences(f"file://{tmp_path}", 0, len(got), end, 64, 8))
    by = {r["slot"]: r for r in got}
    for slot, s in enumerate(read):
        want = ids[2] if by[slot]["doc_id"] is None else ids[0]
        part = want[by[slot]["seq"] * 64 : (by[slot]["seq"] + 1) * 64]
        assert s[: len(part)].tolist() == part.tolist() and (s[len(part) :] == end).all() and by[slot]["n_tokens"] == len(part)
    assert shards.write_shards(table.limit(0), RANKS, public_tokenizers.PATTERN, f"file://{tmp_path}/none").count() == 0


def test_a_shared_folder_is_demanded_on_a_cluster(monkeypatch):
    class Context:
        master = "spark://host:7077"

        class _jsc:
            @staticmethod
            def sc():
                class Scala:
                    @staticmethod
                    def getCheckpointDir():
                        class Option:
                            @staticmethod
                            def isDefined():
                                return False

                        return Option

                return Scala

    class Session:
        sparkContext = Context

        class conf:
            @staticmethod
            def get(name, default=None):
                return default

    with pytest.raises(ValueError):
        common.shared_folder(Session)
