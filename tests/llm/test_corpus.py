"""Operators that look at the whole corpus: fingerprints, the n-gram join, the language model, quality, the pipeline."""

import hashlib
import math
import random
import tracemalloc
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from lectern.llm import fingerprints as P
from lectern.llm import language_model as M
from lectern.llm import ngram_join as N
from lectern.llm import quality as Q
from lectern.llm.common import words


def _prose(r, n, vocabulary=400):
    return " ".join(f"w{int(r.paretovariate(0.6)) % vocabulary}" for _ in range(n))


# fingerprints


def _bag(text):
    w = words(text)
    return Counter(zip(*[w[k:] for k in range(5)])) if len(w) >= 5 else Counter([tuple(w)] if w else [])


def _likeness(a, b):
    a, b = _bag(a), _bag(b)
    return sum((a & b).values()) / sum((a | b).values()) if a or b else 1.0


def _fingerprints(spark, rows, parts=3):
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("fingerprint", F.lit(1)).repartition(parts)
    return P.fingerprints(df).collect()


@pytest.mark.parametrize("rows_a_piece", [1, 20, P.PIECE_ROWS])
def test_edits_follow_the_order_of_ids(spark, monkeypatch, rows_a_piece):
    monkeypatch.setattr(P, "PIECE_ROWS", rows_a_piece)
    r = random.Random(2)
    rows = [(i * i * 37 - 500, _prose(r, r.choice((0, 1, 3, 30, 80)))) for i in range(60)] + [(10**15, "é日本 x" * 3)]
    got = {x.doc_id: x for x in _fingerprints(spark, rows)}
    rows.sort(reverse=True)
    for k, (i, t) in enumerate(rows):
        other = rows[(k + 1) % len(rows)][1]
        half = len(t) // 2
        new = t[: len(t) - half] + other[:half]
        assert got[i].n_chars == len(t) and got[i].edited_sha256 == hashlib.sha256(new.encode()).hexdigest()


def test_likeness_estimates_generalised_jaccard(spark):
    r = random.Random(5)
    rows, want = [], []
    for k in range(120, 0, -2):
        a = _prose(r, 300)
        w = a.split()
        keep = r.randint(0, 300)
        rows += [(k, a), (k - 1, " ".join(w[:keep]) + " " + _prose(r, 300 - keep, 9000))]
    rows = rows[:-1] + [(rows[-1][0], rows[-1][1])]
    got = {x.doc_id: x.near_next for x in _fingerprints(spark, rows)}
    texts = dict(rows)
    errors = [got[k] - _likeness(texts[k], texts[k - 1]) for k in range(120, 0, -2)]
    assert abs(np.mean(errors)) < 0.02 and np.sqrt(np.mean(np.square(errors))) < 0.07


def test_weights_count(spark):
    """A repeated passage weighs more: the share of equal samples follows the weights, not the sets."""
    a = "a b c d e f g h i j " * 20 + "x1 x2 x3 x4 x5 x6"
    b = "a b c d e f g h i j " * 5 + "x1 x2 x3 x4 x5 x6"
    own = lambda t, i: " ".join(f"{w}of{i}" for w in t.split())
    many = [(i * 2, own(a, i)) for i in range(120)] + [(i * 2 - 1, own(b, i)) for i in range(120)]
    got = {x.doc_id: x.near_next for x in _fingerprints(spark, many)}
    want = _likeness(a, b)
    assert abs(np.mean([got[i * 2] for i in range(120)]) - want) < 0.02 and want < 0.4


@pytest.mark.parametrize(("n", "part", "times"), [(8, 2, 5), (15, 2, 20), (30, 2, 5), (300, 10, 3), (300, 10, 10), (1500, 2, 5)])
def test_repeats_do_not_bias_the_likeness(spark, n, part, times):
    """Texts whose first part is repeated, against the same without the repeats: the mean error over many texts is small."""
    r = random.Random(n + times)
    rows, want = [], {}
    for k in range(60 if n > 1000 else 250):
        w = [f"w{r.random()}" for _ in range(n)]
        a, b = " ".join(w[: n // part] * times + w), " ".join(w[: n * 3 // 4])
        rows += [(2 * k + 2, a), (2 * k + 1, b)]
        want[2 * k + 2] = _likeness(a, b)
    got = {x.doc_id: x.near_next for x in _fingerprints(spark, rows)}
    assert abs(np.mean([got[k] - want[k] for k in want])) < 0.02


def test_fingerprints_of_odd_rows(spark):
    got = _fingerprints(spark, [(1, None), (2, ""), (2, ""), (3, "same words here"), (4, "same words here"), (None, "z"), (None, None)])
    assert len(got) == 7 and all(0 <= x.near_next <= 1 and 0 <= x.near_edited <= 1 for x in got)
    by = defaultdict(set)
    for x in got:
        by[x.n_chars].add(x.fingerprint)
    assert by[0] == {""} and len(by[15]) == 1
    one = _fingerprints(spark, [(5, "alone on its own here now")])[0]
    assert one.near_next == 1.0
    assert _fingerprints(spark, [(None, "x"), (None, "y")])[0].n_chars == 1
    assert P.fingerprints(spark.createDataFrame([], "doc_id long, text string")).count() == 0


# n-gram join


def _brute_join(rows, least=0.8):
    sets = [frozenset(_bag(t)) for _, t in rows]
    up = list(range(len(rows)))

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    linked = defaultdict(set)
    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and len(sets[i] & sets[j]) >= least * len(sets[i] | sets[j]):
                up[top(i)] = top(j)
                if sets[i] != sets[j]:
                    linked[sets[i]].add(sets[j])
                    linked[sets[j]].add(sets[i])
    out = []
    for k, (i, _) in enumerate(rows):
        group = [rows[m][0] for m in range(len(rows)) if top(m) == top(k)]
        same = [rows[m][0] for m in range(len(rows)) if sets[m] == sets[k] and (sets[k] or m == k)]
        out.append((i, min(same), min(group), len(same), len(linked[sets[k]])))
    return sorted(out)


def _corpus(seed, n=60):
    r = random.Random(seed)
    rows = []
    for g in range(n):
        base = _prose(r, r.choice((3, 8, 40, 120)), 5000).split()
        for _ in range(r.choice((1, 1, 2, 5, 12))):
            w = list(base)
            for _ in range(r.choice((0, 0, 1, 2, 6))):
                w[r.randrange(len(w))] = f"new{r.random()}"
            rows.append(" ".join(w))
    r.shuffle(rows)
    return [(i * 3, t) for i, t in enumerate([*rows, "", "...", "One TWO", "one two!"])]


@pytest.mark.parametrize("block", [N.BLOCK, 4])
def test_links_against_brute_force(spark, block):
    """Also with buckets dealt into blocks of four."""
    rows = _corpus(1)
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("class_id", F.lit("clash")).repartition(3)
    got = sorted((x.doc_id, x.text_id, x.class_id, x.n_copies, x.n_links) for x in N.links(df, block=block).collect())
    assert got == _brute_join(rows)


def test_links_where_many_ids_are_joined(spark, monkeypatch):
    rows = _corpus(2, 15)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = sorted(map(tuple, N.links(df).collect()))
    monkeypatch.setattr(N, "BROADCAST_IDS", 0)
    monkeypatch.setattr(N, "PART_ROWS", 3)
    assert sorted(map(tuple, N.links(df).collect())) == want
    kept = {x.doc_id for x in N.first_of_each(df).collect()}
    assert kept == {w[2] for w in want}


def test_links_of_odd_rows(spark):
    rows = [(1, None), (2, ""), (7, "a b c d e f"), (7, "a b c d e f"), (9, "A, b c d e f"), (None, "a b c d e f"), (None, "lonely words that nobody shares at all")]
    got = sorted(((x.doc_id, x.class_id, x.n_copies, x.n_links) for x in N.links(spark.createDataFrame(rows, "doc_id long, text string")).collect()), key=str)
    assert got == sorted([(1, 1, 1, 0), (2, 2, 1, 0), (7, 7, 4, 0), (7, 7, 4, 0), (9, 7, 4, 0), (None, 7, 4, 0), (None, None, 1, 0)], key=str)
    assert N.links(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    kept = N.first_of_each(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(str(x.doc_id) for x in kept) == ["1", "2", "7", "7", "None", "None"]


@pytest.mark.parametrize("few", [N.BROADCAST_IDS, 0])
def test_one_row_of_each_class_stays(spark, monkeypatch, few):
    """Also where an id has several texts, rows are repeated, or have no id."""
    monkeypatch.setattr(N, "BROADCAST_IDS", few)
    rows = [
        (1, "one of a kind that no other row says"), (1, "a b c d e f"), (0, "a b c d e f"), (7, "g h i j k l"), (7, "g h i j k l"), (9, "G, h i j k l"), (None, "g h i j k l"),
        (None, "m n o p q r"), (None, "m n o p q r"), (None, "s t u v w x"), (2, ""), (2, None), (None, "..."),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    key = lambda found: sorted(map(str, ((x.doc_id, x.text) for x in found)))
    whole = [rows[0], rows[2], rows[3], rows[7], *rows[9:]]
    assert key(N.first_of_each(df, repeats=False).collect()) == sorted(map(str, whole))
    assert key(corpus_pipeline.single(spark, df, "").collect()) == sorted(map(str, whole))
    assert str(rows[0]) in key(N.first_of_each(df).collect())


def test_bands_reach_their_recall():
    rows, bands = N.choose_bands(0.8, 0.999)
    assert 1 - (1 - 0.8**rows) ** bands >= 0.999 and rows * bands <= 160
    r = np.random.RandomState(0)
    met = 0
    for _ in range(300):
        both, one, two = (r.randint(0, 2**63, n).astype(np.uint64) for n in (160, 20, 20))
        a, b = (N.band_hashes(np.unique(np.concatenate((both, x))), rows, bands) for x in (one, two))
        met += bool((a == b).any())
    assert met >= 297


def test_first_of_each_over_files(spark, tmp_path):
    """Rows of files as read are told apart by file and place: the same rows stay as from a written copy, with columns
    named like the operator's own, and no second copy of the texts is written."""
    text = [" ".join(f"w{k}x{i}" for i in range(40)) for k in range(6)]
    rows = [(k % 7, text[k % 6] if k % 5 else None, k, "g") for k in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string, _row long, _gone string").repartition(4)
    df.write.parquet(str(tmp_path / "d"))
    read = spark.read.parquet(str(tmp_path / "d"))
    from lectern.llm import common

    before = len(common._written)
    got = N.first_of_each(read, repeats=False)
    assert not any("lectern-rows-" in p for p in common._written[before:])
    key = lambda rs: sorted((str(r.doc_id), str(r.text)) for r in rs)
    kept = got.collect()
    assert got.columns == read.columns
    assert key(kept) == key(N.first_of_each(read.where("true or doc_id = 1").limit(60), repeats=False).collect())
    assert sum(r.text is None for r in kept) == 12 and sum(r.text is not None for r in kept) == 6


# language model


def test_network_gradient():
    """One window's step goes down the loss's slope as finite differences give it."""
    vocab = M.Vocabulary.of([(b"a", 9), (b"b", 5), (b"c", 3), (M.END, 2), (b"d", 1)], 22, learnt=5, classes=3)
    docs = [np.array([1, 2, 3, vocab.words[M.END]], dtype=np.int32), np.array([2, 0, vocab.words[M.END]], dtype=np.int32)]
    net = M.Network(vocab, units=3)
    for n in net.NAMES:
        setattr(net, n, (getattr(net, n) + np.random.RandomState(1).randn(*getattr(net, n).shape) * 0.3).astype(np.float64))
    flat = net.flat().astype(np.float64)

    def loss(x):
        other = M.Network(vocab, units=3)
        at = 0
        for n in net.NAMES:
            a = getattr(other, n)
            setattr(other, n, x[at : at + a.size].reshape(a.shape))
            at += a.size
        return -M.log_likelihoods(other, docs).sum()

    lanes = M.Lanes.of(docs, net.end)
    (_, at, inside), = lanes.windows(M.STEPS)
    seen, target = np.where(inside, lanes.seen[at], net.end), np.where(inside, lanes.target[at], -1)
    old = {n: np.full_like(getattr(net, n), 1e12) for n in net.NAMES}  # so large that a step is the slope
    before = net.flat()
    net.step(np.zeros((seen.shape[1], 3)), seen, target, old, rate=1e3)
    slope = (before - net.flat()) * 1e3
    r = np.random.RandomState(3)
    for i in r.choice(len(flat), 40, replace=False):
        up, down = flat.copy(), flat.copy()
        up[i] += 1e-4
        down[i] -= 1e-4
        assert slope[i] == pytest.approx((loss(up) - loss(down)) / 2e-4, abs=2e-3)


def test_likelihoods_do_not_depend_on_lanes():
    vocab = M.Vocabulary.of([(b"a", 9), (b"b", 5), (M.END, 2)], 20, learnt=3, classes=2)
    net = M.Network(vocab, units=4)
    r = np.random.RandomState(0)
    docs = [np.append(r.randint(0, 3, n), vocab.words[M.END]).astype(np.int32) for n in (0, 1, 700, 5, 300, 2)]
    alone = np.concatenate([M.log_likelihoods(net, [d]) for d in docs])
    assert M.log_likelihoods(net, docs) == pytest.approx(alone, rel=1e-4) and M.log_likelihoods(net, docs, window=7) == pytest.approx(alone, rel=1e-4)
    total = 0.0
    for first in range(len(vocab.mass)):
        total += math.exp(M.log_likelihoods(net, [np.array([first], dtype=np.int32)])[0])
    assert total == pytest.approx(1, rel=1e-4)


def test_network_has_its_whole_size():
    """24 units, and 256 lanes, so that the weights move every 32 words of a lane."""
    vocab = M.Vocabulary.of([(b"a", 9), (M.END, 2)], 11)
    assert M.Network(vocab).u.shape == (24, 72)
    docs = [np.full(200, vocab.words[b"a"], dtype=np.int32)] * 1000
    assert len(M.Lanes.of(docs, vocab.words[M.END]).size) == 256


def test_a_long_text_among_short_ones_takes_little_memory():
    """200,000 words beside 400 short texts: as likely as alone, in under 100 MB for scoring and training."""
    vocab = M.Vocabulary.of([(b"a", 9), (b"b", 5), (M.END, 2)], 20, learnt=3, classes=2)
    net = M.Network(vocab, units=4)
    r = np.random.RandomState(0)
    docs = [np.append(r.randint(0, 3, n), vocab.words[M.END]).astype(np.int32) for n in (4000, *[20] * 400)]
    alone = M.log_likelihoods(net, docs[:1])[0]
    many = M.Lanes.of([np.concatenate([docs[0]] * 50), *docs], net.end)
    assert many.seen.nbytes + many.target.nbytes < 2e6 and max(at.nbytes for _, at, _ in many.windows(M.STEPS)) < 1e6
    docs.append(np.concatenate([docs[0]] * 2))
    tracemalloc.start()
    got = M.log_likelihoods(net, docs)
    M.train(net, iter([docs]))
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 20e6 and got[0] == pytest.approx(alone, rel=1e-4) and got[-1] == pytest.approx(2 * alone, rel=1e-3)


def test_lanes_hold_every_word_once():
    r = np.random.RandomState(1)
    for most in (1, 3, 300):
        docs = [np.append(r.randint(0, 9, n), 9).astype(np.int32) for n in r.randint(0, 90, 50)]
        lanes = M.Lanes.of(docs, 9, most)
        seen = []
        for live, at, inside in lanes.windows(7):
            assert (at[0] < lanes.at[live] + lanes.size[live]).all() and inside[0].all()
            seen.append(at[inside])
        assert sorted(np.concatenate(seen).tolist()) == list(range(sum(map(len, docs))))
        for d, at in zip(docs, lanes.place, strict=True):
            assert (lanes.target[at : at + len(d)] == d).all() and lanes.seen[at] == 9 and (lanes.seen[at + 1 : at + len(d)] == d[:-1]).all()


def test_weights_are_averaged_in_two_steps(spark, monkeypatch):
    """With many tasks the mean of groups' means by words is the mean by words."""
    rows = spark.createDataFrame([(i, t) for i, t in _lm_rows(100) if t], "doc_id long, text string").repartition(80)
    known = M.counts(rows)
    total = known.agg(F.sum("c")).first()[0]
    net = M.Network(M.Vocabulary.of(M.commonest(known), total))
    monkeypatch.setattr(M, "SPLITS", 1)
    two = M._trained(net, rows).flat()
    monkeypatch.setattr(M.math, "isqrt", lambda n: 1)
    assert M._trained(net, rows).flat() == pytest.approx(two, abs=1e-5)


def _lm_rows(n=300):
    """Two languages: the words of one never follow those of the other."""
    r = random.Random(1)
    out = []
    for i in range(n):
        vocabulary = [f"{'ab'[i % 2]}{k}" for k in range(30)]
        out.append((i, " ".join(r.choices(vocabulary, k=r.randint(5, 60)) + ([f"Rare{i}"] if i % 5 == 0 else []))))
    return [*out, (n, None), (n + 1, ""), (n + 2, "Never Seen\x0bwords")]


def test_base_scores_by_hand_and_held_out_gain(spark):
    rows = _lm_rows()
    got = {x.doc_id: x for x in M.scores(spark.createDataFrame(rows, "doc_id long, text string").withColumn("score", F.lit(1)).repartition(3)).collect()}
    counts = Counter()
    for i, t in rows:
        if not M.held_out(i):
            counts.update(M.tokens(t))
    n, v = sum(counts.values()), len(counts)
    for i, t in rows:
        ws = M.tokens(t)
        x = got[i]
        assert (x.held_out, x.n_tokens, x.n_known, x.train_tokens) == (M.held_out(i), len(ws), sum(w in counts for w in ws), n)
        assert x.base_score == pytest.approx(sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in ws))
    out = [x for x in got.values() if x.held_out]
    assert sum(x.score for x in out) > sum(x.base_score for x in out) + 0.05 * sum(x.n_tokens for x in out)


def test_rare_words_are_joined(spark, monkeypatch):
    """With few words sent to the tasks the result is the same."""
    rows = spark.createDataFrame(_lm_rows(60), "doc_id long, text string").coalesce(1)
    want = {x.doc_id: (x.n_known, round(x.base_score, 6), round(x.score, 3)) for x in M.scores(rows, rounds=0).collect()}
    monkeypatch.setattr(M, "LONGEST", 3)
    got = {x.doc_id: (x.n_known, round(x.base_score, 6)) for x in M.scores(rows, rounds=0).collect()}
    assert got == {k: w[:2] for k, w in want.items()}


def test_scores_of_odd_tables(spark):
    kind = "doc_id long, text string"
    assert M.scores(spark.createDataFrame([], kind)).count() == 0
    only = M.scores(spark.createDataFrame([(k, "a b") for k in range(40) if M.held_out(k)], kind)).collect()
    assert all(x.n_known == 0 and x.train_tokens == 0 and x.base_score == 0.0 for x in only)
    twice = M.scores(spark.createDataFrame([(0, "a"), (0, "a"), (None, "b")], kind)).collect()
    assert len(twice) == 3 and sum(x.doc_id is None for x in twice) == 1


# quality


def _quality_rows(n=400):
    r = random.Random(3)
    rows, labels = [], []
    for i in range(n):
        good = i % 5 != 0
        text = _prose(r, 60) + ".\n" + _prose(r, 40) if good else (" | ".join(_prose(r, 30).upper().split()) + "!!\n") * 4
        rows.append((i, text, f"s{i % 7}", "en", len(text)))
        if i % 2:
            labels.append((i, int(good), 0))
    return rows, labels


def test_held_out_accuracy(spark):
    rows, labels = _quality_rows()
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, n_chars long").withColumn("score", F.lit("clash"))
    model = Q.fit(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    got = {x.doc_id: x for x in Q.score(docs, model).collect()}
    assert model.n_pseudo > 0 and model.held_out >= 0.95
    unseen = [i for i in range(len(rows)) if i % 2 == 0]
    assert np.mean([(got[i].score >= Q.KEEP) == (i % 5 != 0) for i in unseen]) >= 0.97
    assert all(0 <= got[i].p_text <= 1 and 0 <= got[i].p_page <= 1 for i in got)


def test_pseudo_labels_come_from_all_documents(spark, monkeypatch):
    """With room for few a round, what joins are the surest of all unlabelled documents, copies once."""
    rows, labels = _quality_rows()
    rows += [(1000 + k, *rows[0][1:]) for k in range(30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, n_chars long").repartition(3)
    seen = []
    own = Q.surest

    def watched(*how):
        seen.append((how[3], how[5], own(*how)))
        return seen[-1][2]

    monkeypatch.setattr(Q, "surest", watched)
    Q.fit(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), pool=40)
    lines, most, found = seen[0]
    marked = {i for i, _, _ in labels}
    odds = {}
    for i, text, source, lang, _ in rows:
        if i not in marked:
            w, a, b = lines[0]
            p = 1 / (1 + math.exp(-(a * float(Q._odds(Q.content(text.encode())[None], w)[0]) + b)))
            odds[text] = max(odds.get(text, 0.0), p)
    best = sorted((p for p in odds.values() if p >= 0.9), reverse=True)[: most[1]]
    texts = {i: t for i, t, *_ in rows}
    got = sorted((odds[texts[r.doc_id]] for r in found if r.view == 1 and r.label == 1), reverse=True)
    assert len(best) == most[1] and got == pytest.approx(best, abs=1e-6)
    for view in (0, 1):
        joined = [r.mark for _, _, f in seen for r in f if r.view == view]
        assert len(joined) == len(set(joined))
    assert Q.CONTENT == 2048 and Q.content(b"some text").shape == (2048,)


def test_scores_without_labels_and_odd_rows(spark):
    kind = "doc_id long, text string, source string, lang string"
    docs = spark.createDataFrame([(1, None, None, None), (1, "", "s", "en"), (2, "x" * 100_000, "s", "en"), (None, "a", "s", "en"), (2, "x" * 100_000, "s", "en")], kind)
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = Q.score(docs, Q.fit(docs, none)).collect()
    assert {round(x.score, 6) for x in got} == {0.5} and len(got) == 5
    odd = spark.createDataFrame([(1, 1, 0), (1, 0, 0), (None, 1, 0), (2, None, 0), (77, 1, 0)], "doc_id long, quality int, toxic int")
    assert Q.fit(docs, odd).text is None
    assert Q.score(docs.limit(0), Q.fit(docs, none)).count() == 0
    assert Q.score(docs.select("doc_id", "text"), Q.fit(docs.select("doc_id", "text"), none)).count() == 5


def test_calibration_by_hand():
    r = np.random.RandomState(0)
    odds = r.randn(20000) * 2
    y = (r.rand(20000) < 1 / (1 + np.exp(-(0.7 * odds - 0.4)))).astype(float)
    a, b = Q.platt(odds, y)
    assert a == pytest.approx(0.7, abs=0.05) and b == pytest.approx(-0.4, abs=0.05)


# pipeline


def test_stages_in_order(spark, tmp_path):
    rows, labels = _quality_rows(200)
    r = random.Random(8)
    near = rows[1][1].replace("w1 ", "v1 ", 1)
    leak = _prose(r, 14, 10**6)
    rows += [(1000, rows[1][1], "s1", "en", len(rows[1][1])), (1001, near, "s1", "en", len(near))]
    hidden = _prose(r, 60) + " token = 0123456789abcdef0123456789abcdef01234567 " + leak + " " + _prose(r, 60)
    rows.append((1002, hidden, "s1", "en", len(hidden)))
    kind = "doc_id long, text string, source string, lang string, n_chars long"
    spark.createDataFrame(rows, kind).repartition(2).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, leak)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality classifier", "n-gram Jaccard join", "benchmark decontamination", "secret scans", "packing"]
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    seen = []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, str(tmp_path))
        if k < 4:
            assert out.columns == docs.columns
        out.write.parquet(str(tmp_path / f"s{k}"))
        docs = spark.read.parquet(str(tmp_path / f"s{k}"))
        seen.append({x.doc_id for x in docs.select("doc_id").collect()})
    assert not any(i % 5 == 0 and i < 200 for i in seen[0]) and len(seen[0]) >= 160
    assert 1 in seen[1] and 1000 not in seen[1] and len(seen[1]) >= len(seen[0]) - 2
    assert seen[1] == seen[2] == seen[3] == seen[4]
    text = spark.read.parquet(str(tmp_path / "s3")).where("doc_id = 1002").first()
    assert "[secret]" in text.text and leak not in text.text and text.n_chars == len(text.text)
    got = corpus_pipeline.run(spark, str(tmp_path))
    assert {x.doc_id for x in got.select("doc_id").collect()} == seen[4]


def test_pipeline_of_odd_and_empty_tables(spark, tmp_path):
    """Nulls, empty texts, repeated rows and ids, columns named like the stages' own, no labels, no benchmark, no rows."""
    kind = "doc_id long, text string, source string, lang string, n_chars long, score string, hits long, n_words long, class_id long, _row string, secrets string"
    own = ("s", None, None, "x", 1, 2, 3, "y", "z")
    texts = [(1, None), (2, ""), (3, "a b c d e f g"), (3, "a b c d e f g"), (3, "another text with that id"), (None, "h i j k l m"), (4, "A, b c d e f g"), (5, "word " * 30_000)]
    docs = spark.createDataFrame([(*t, *own) for t in texts], kind)
    for name, rows in (("odd", docs), ("none", docs.limit(0))):
        rows.write.parquet(str(tmp_path / name / "documents.parquet"))
        spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / name / "labels.parquet"))
        spark.createDataFrame([(1, None)], "item_id long, text string").write.parquet(str(tmp_path / name / "benchmark.parquet"))
    got = corpus_pipeline.run(spark, str(tmp_path / "odd")).where("start = 0").collect()
    assert sorted(str(r.doc_id) for r in got) == ["1", "2", "3", "3", "5", "None"]
    assert corpus_pipeline.run(spark, str(tmp_path / "none")).count() == 0
    stage = docs
    for _, step in corpus_pipeline.STAGES[:-1]:
        stage = step(spark, stage, str(tmp_path / "odd"))
        assert stage.columns == docs.columns and {r.score for r in stage.select("score").collect()} == {"x"}
