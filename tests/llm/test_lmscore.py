import numpy as np
import pyarrow as pa
import pytest
from fieldloom.llm import lmscore, sums
from fieldloom.llm.batches import texts
from pyspark.sql import functions as F


def numbers(text):
    (t,) = texts(pa.array([text]))
    return lmscore.word_numbers(t)


def known_of(sums, twigs=4):
    none = np.zeros(0, np.int64)
    return lmscore.Vocabulary(none, none, none, twigs, twigs // 2, sums, int(sums.sum()))


def plain_loss(net, rows, twig):
    """Mean negative log-probability of branches and twigs, word by word."""
    total = 0.0
    for r, g in zip(rows, twig, strict=True):
        h = np.tanh(net.near[r].astype(float).sum(axis=0) + net.bias)
        s = h @ net.out + net.prior
        b, leaf = divmod(int(g), net.twigs)
        q = net.inner[b] @ np.append(h, 1.0)
        total -= s[b] - np.log(np.exp(s).sum()) + q[leaf] - np.log(np.exp(q).sum())
    return total / len(twig)


def test_probabilities_and_gradient():
    rng = np.random.default_rng(3)
    net = lmscore.Network.of(known_of(rng.uniform(0.5, 90, 3 * lmscore.BRANCHES), 3))
    net = lmscore.Network(net.flat + rng.standard_normal(len(net.flat)) * 0.2, 3)
    twig, at = rng.integers(0, net.groups, 40), np.arange(40)
    rows = net.neighbours(twig, np.array([0, 15, 15, 40]), at)
    assert np.isclose(-net.log_probs(rows, twig).mean(), plain_loss(net, rows, twig), rtol=1e-5)
    each = net.log_probs(np.repeat(rows[:1], net.groups, axis=0), np.arange(net.groups))
    assert np.isclose(np.exp(each).sum(), 1, atol=1e-4)
    named, near, rest = net.gradient(rows, twig)
    whole = np.zeros_like(net.near)
    whole[named] = near
    gradient = np.concatenate([x.ravel() for x in (whole, *rest)])
    for i in np.concatenate([rng.choice(np.flatnonzero(gradient), 40), rng.integers(0, len(gradient), 10)]):
        x = np.zeros(len(gradient), np.float32)
        x[i] = 1e-2
        slope = (plain_loss(lmscore.Network(net.flat + x, 3), rows, twig) - plain_loss(lmscore.Network(net.flat - x, 3), rows, twig)) / 2e-2
        assert abs(slope - gradient[i]) < 1e-4


def test_one_partition_is_the_plain_loop(spark):
    texts_ = ["the cat of the hat ran", "to the hat, of a cat " * 9, "zu dem Hut"]
    docs = spark.createDataFrame([(k, x) for k, x in enumerate(texts_)], "doc_id long, text string").coalesce(1)
    known = lmscore.vocabulary(docs)
    net = lmscore.train(docs, known, 1)
    own = lmscore.Network.of(known)
    texts_ = [r.text for r in docs.orderBy(F.xxhash64("doc_id", "text")).collect()]
    number, ending, first = (np.concatenate(x) for x in zip(*[numbers(x) for x in texts_], strict=True))
    first = np.cumsum([0, *[len(x.split()) for x in texts_]])
    twig = known.of(number, ending)[0]
    order = np.random.default_rng(len(number)).permutation(len(number))
    squares = np.full(len(own.flat), 1e-6, np.float32)
    for a in range(0, len(order), 32):
        rows = own.neighbours(twig, first, order[a : a + 32])
        g = np.zeros(len(own.flat), np.float32)
        named, near, rest = own.gradient(rows, twig[order[a : a + 32]])
        g[: own.near.size].reshape(own.near.shape)[named] = near
        g[own.near.size :] = np.concatenate([x.ravel() for x in rest])
        squares += g * g
        own.flat -= lmscore.RATE * g / np.sqrt(squares)
    assert np.allclose(own.flat, net.flat, atol=1e-3)


def test_sums_in_levels(spark):
    def send(batches):
        for _ in batches:
            pass
        task = sums.TaskContext.get().partitionId()
        yield sums.pieces(np.arange(100, dtype=np.float32) * (task + 1), task)

    rows = spark.range(0, 70, 1, 7).mapInArrow(send, sums.BLOB)
    weights = np.arange(7)
    expected = np.arange(100) * (weights * (weights + 1)).sum() / weights.sum()
    assert np.allclose(sums.gathered(rows, np.float32, True, fan=2), expected, rtol=1e-5)
    assert np.allclose(sums.gathered(rows, np.float32, False, fan=3), np.arange(100) * 28)
    assert len(sums.gathered(rows.where("task < 0"), np.float32, True)) == 0


def brute(text, known, net):
    number, ending, _ = numbers(text)
    twig, n = known.of(number, ending)
    total = 0.0
    for i, g in enumerate(twig):
        h = net.bias.astype(float).copy()
        for k, shift in enumerate([-2, -1, 1, 2]):
            j = i + shift
            h += net.near[k * (net.groups + 1) + (twig[j] if 0 <= j < len(twig) else net.groups)]
        h = np.tanh(h)
        s, (b, leaf) = h @ net.out + net.prior, divmod(int(g), net.twigs)
        q = net.inner[b] @ np.append(h, 1.0)
        total += s[b] - np.log(np.exp(s).sum()) + q[leaf] - np.log(np.exp(q).sum()) + np.log(max(n[i], 0) + 0.5) - np.log(known.sums[g])
    return total


def test_scores_and_edges(spark, sf_dir):
    table = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    extra = spark.createDataFrame([(-1, None), (-2, ""), (-3, "one"), (-4, "of the " * 40000), (None, "the of"), (-5, "zz yy"), (-5, "zz yy"), (-6, "qqxqq once")], "doc_id long, text string")
    docs = table.union(extra).withColumn("n_tokens", F.lit("clash"))
    known = lmscore.vocabulary(docs)
    net = lmscore.train(docs, known)
    rows = lmscore.score(docs, known, net).collect()
    assert len(rows) == docs.count()
    by = {r.doc_id: r for r in rows}
    for d, t in docs.select("doc_id", "text").limit(5).collect() + [(-3, "one"), (None, "the of"), (-5, "zz yy")]:
        assert np.isclose(by[d].log_likelihood, brute(t, known, net), rtol=1e-3)
    assert by[-1].log_likelihood == by[-2].log_likelihood == by[-1].n_once == 0 and by[-4].n_tokens == 80000
    assert by[-5].n_once == 0 and by[-6].n_once == 2
    assert lmscore.scored(docs.limit(0)).count() == 0


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01", "sf0.1"])
def test_held_out_words_are_better_predicted_than_by_their_counts(spark, sf_dir, sf):
    docs = spark.read.parquet(sf_dir.replace("sf0.001", sf) + "/documents.parquet").select("doc_id", "text")
    held = F.pmod(F.xxhash64("doc_id"), F.lit(6)) == 0
    rest, test = docs.where(~held), docs.where(held)
    known = lmscore.vocabulary(rest)

    def mean(net):
        r = lmscore.score(test, known, net).agg(F.sum("log_likelihood").alias("s"), F.sum("n_tokens").alias("n")).first()
        return r.s / r.n

    counts, net = mean(lmscore.Network.of(known)), lmscore.train(rest, known)
    assert mean(net) > counts + 0.4
    if sf == "sf0.01":
        for tasks in (1, 7, 40, 200):
            assert (lmscore.train(rest.repartition(tasks, "doc_id"), known).flat == net.flat).all()
        # also where there are several learners, which know less the fewer words each has
        few = [lmscore.train(rest.repartition(tasks), known, learner_words=known.total // 4) for tasks in (3, 40)]
        assert (few[0].flat == few[1].flat).all() and mean(few[0]) > counts + 0.2


def test_untaught_is_the_unigram(spark):
    docs = spark.createDataFrame([(1, "a b a c"), (2, "b a dd")], "doc_id long, text string")
    known = lmscore.vocabulary(docs)
    got = {r.doc_id: r.log_likelihood for r in lmscore.score(docs, known, lmscore.Network.of(known)).collect()}
    whole, share = known.sums.sum(), lambda n: np.log(n + 0.5)
    assert np.isclose(got[2], share(2) + share(3) + share(1) - 3 * np.log(whole), rtol=1e-4)


def test_every_word_is_learned_from_once():
    first = np.array([0, 1, 1, 9, 40])
    places = np.concatenate([lmscore.learned_places(first, k, lmscore.ROUNDS) for k in range(lmscore.ROUNDS)])
    assert sorted(places) == list(range(40))


def test_counts_and_shares_are_of_words(spark, monkeypatch):
    text = " ".join(f"w{i} " * (1 + i % 5) for i in range(40000))
    docs = spark.createDataFrame([(k, " ".join(text.split()[k::7])) for k in range(7)] + [(7, None)], "doc_id long, text string")
    whole = lmscore.vocabulary(docs)
    assert len(whole.words) == 40000 and whole.counts is None and whole.total == 120000
    assert np.isclose(whole.sums.sum(), 120000 + 0.5 * (40000 + whole.twigs * lmscore.BRANCHES))
    monkeypatch.setattr(lmscore, "KNOWN", 20000)
    part = lmscore.vocabulary(docs)
    assert len(part.words) == 16000 and part.counts.count() == 40000 and np.isclose(part.sums.sum(), whole.sums.sum())
    a, b = ({r.doc_id: r for r in lmscore.score(docs, k, lmscore.Network.of(k)).collect()} for k in (whole, part))
    assert len(a) == len(b) == 8 and all(np.isclose(a[d].log_likelihood, b[d].log_likelihood, rtol=1e-4) and a[d].n_tokens == b[d].n_tokens and a[d].n_once == b[d].n_once for d in a)


def test_slices_depend_on_the_learners_texts_alone(monkeypatch):
    monkeypatch.setattr(lmscore, "SLICE_BYTES", 20)
    rng = np.random.default_rng(5)
    rows = [(k, "w" * int(rng.integers(0, 30))) for k in (0, 3, 4) for _ in range(40)]

    def found(cuts, rows):
        edges = [0, *cuts, len(rows)]
        batches = [pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows[a:b]], pa.int64()), pa.array([r[1] for r in rows[a:b]], pa.string())], names=["learner", "text"]) for a, b in zip(edges, edges[1:], strict=False)]
        return [(k, None if t is None else (t.buf.tobytes(), tuple(t.off))) for k, t in lmscore._slices(batches)]

    whole = found([], rows)
    assert [k for k, t in whole if t is None] == [0, 3, 4] and sum(len(t[1]) - 1 for _, t in whole if t) == len(rows)
    for cuts in ([1], [39, 40, 41], list(range(1, len(rows))), [50, 50, 90]):
        assert found(cuts, rows) == whole
    assert found([5], [r for r in rows if r[0] == 3]) == [x for x in whole if x[0] == 3]
    assert found([], []) == []


def test_texts_are_read_for_counts_and_for_numbers_alone(spark):
    rows = [(k, f"the cat {k % 7} of the hat") for k in range(90)] + [(90, None), (91, " "), (None, "hat")]
    seen = spark.sparkContext.accumulator(0)

    def look(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert lmscore.scored(docs.mapInArrow(look, docs.schema)).count() == len(rows)
    assert seen.value == 2 * len(rows)


def test_numbers_are_those_of_the_texts(spark):
    rows = [(1, "the cat of the hat"), (None, "The  HAT "), (3, None), (4, ""), (5, " \n"), (5, "zz"), (5, "zz")]
    known = lmscore.vocabulary(spark.createDataFrame(rows[:2], "doc_id long, text string"))
    table = lmscore.numbered(spark.createDataFrame(rows, "doc_id long, text string"), known).collect()
    expected = []
    for d, text in rows:
        twig, n = known.of(*numbers(text or "")[:2])
        share = (np.log(np.maximum(n, 0) + 0.5) - np.log(known.sums[twig])).sum()
        expected.append((-1 if d is None else d, len((text or "").encode()), tuple(twig), len(twig), round(share, 6), int((n == 1).sum())))
    got = [(-1 if r.doc_id is None else r.doc_id, r.size, tuple(np.frombuffer(r.twigs, known.kind)), r.n_tokens, round(r.share, 6), r.once) for r in table]
    assert sorted(got) == sorted(expected) and len({r.row for r in table}) == len(rows) and not any(r.rest for r in table)


def test_sums_of_runs(monkeypatch):
    rng = np.random.default_rng(4)
    x = rng.standard_normal((50, 3)).astype(np.float32)
    for run in (2, 3, 24):
        monkeypatch.setattr(lmscore, "RUN", run)
        for count in ([1], [700], [1, 1, 1], [24, 25, 1, 48, 577, 2], rng.integers(1, 90, 200)):
            at = rng.integers(0, 50, int(np.sum(count)))
            expected = np.add.reduceat(x[at].astype(float), np.cumsum(count) - count, axis=0)
            assert np.allclose(lmscore.run_sums(x, at, np.array(count)), expected, atol=1e-3)
    assert lmscore.run_sums(x, np.zeros(0, np.int64), np.zeros(0, np.int64)).shape == (0, 3)
