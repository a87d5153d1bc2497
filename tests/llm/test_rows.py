"""Operators that judge rows: languages, quality, tokens, contamination, urls, neighbours, mixing."""

import random
from collections import defaultdict
from fractions import Fraction

import numpy as np
import public_tokenizers
import pytest
from brute import contamination
from pyspark.sql import functions as F

from lattiq.llm import decontam, langid, mixing, quality, queries, token_count, topk, url_filter
from lattiq.llm.common import id_crc, table

SF = "/root/testdata/sf0.01"


def test_top_k(spark):
    rng = np.random.default_rng(0)
    rows = [(i % 60, rng.normal(0, 0.2, rng.integers(3, 6)).tolist(), "x") for i in range(90)]
    rows += [(70, [float("nan"), 1.0], "x"), (71, None, "x"), (72, [None, 1.0], "x"), (73, [], "x"), (None, [1.0], "x"), rows[0], rows[0], rows[10], rows[7]]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, score string")
    got = topk.top_k(df.filter("vec_id % 10 = 0"), df, 5, 1024, query_block=3, candidate_block=7).collect()
    good = [(i, [int(np.floor(1024 * float(np.float32(x)))) for x in v]) for i, v, _ in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    want = []
    for j, (q, v) in enumerate(good):  # every row but the query's own
        if q % 10 == 0:
            found = sorted((-sum(a * b for a, b in zip(v, w)), c) for i, (c, w) in enumerate(good) if i != j)[:5]
            want += [(q, n + 1, c, -s) for n, (s, c) in enumerate(found)]
    assert sorted(tuple(r) for r in got) == sorted(want)
    assert topk.top_k(df.limit(0), df).count() == 0 and topk.top_k(df, df.limit(0)).count() == 0


def test_scores_beyond_64_bits_stay_exact(spark):
    df = spark.createDataFrame([(0, [2.0**40, 1.0]), (1, [2.0**40, 0.0]), (2, [1.0, 1.0])], "vec_id long, embedding array<double>")
    got = {(r.query_id, r.vec_id): r.score for r in topk.top_k(df, df, 2, 1024).collect()}
    assert got[0, 1] == 2**63 - 1 and got[0, 2] == 2**50 * 1024 + 1024 * 1024


def test_token_counts(spark):
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    rng = random.Random(1)
    texts = ["", "  a  b ", " " * 50 + "x" + " " * 200, "the" * 200, "a" * 1000, "<s> hi </s>", "x▁y", "▁", "\n\n", "日本語😀", "0x1A <0x0A>"]
    texts += ["".join(rng.choice("ab e\n\t▁ é日ａ<s>0  .,Theing😀") for _ in range(rng.randint(1, 200))) for _ in range(200)]
    texts += [r.text for r in table(spark, SF, "documents").limit(200).collect()]
    df = spark.createDataFrame([(t,) for t in [*texts, None]], "text string")
    got = {r.text: r.n for r in df.select("text", token_count.token_count(F.col("text"), path, 16).alias("n")).collect()}
    assert all(got[t] == len(sp.encode(t or "")) for t in [*texts, None])


def test_languages(spark):
    docs = table(spark, SF, "documents")
    got = queries.op5_langid(spark, SF).join(docs.select("doc_id", "lang"), "doc_id").filter("held_out").collect()
    assert np.mean([r.lang == r.lang_pred for r in got]) > 0.98 and all(0 <= r.score <= 1 for r in got)
    model = langid.train(docs.filter(id_crc() % 5 != 0), docs_per_lang=100)
    rows = spark.createDataFrame([(1, None, None, 1), (2, "12 ²! _", None, 1), (3, "the and", None, 1), (4, "", "en", 1)], "doc_id long, text string, lang string, score int")
    judged = {r.doc_id: r.p for r in rows.select("doc_id", langid.predict(rows, model, F.col("text")).alias("p")).collect()}
    assert [judged[i].lang_pred for i in (1, 2, 4)] == ["und"] * 3 and judged[3].lang_pred == "en"
    own = langid.keep_identified(rows.withColumn("__P", F.lit(9)), model).collect()
    assert [(r.doc_id, r["__P"]) for r in own] == [(3, 9)]
    kept = langid.keep_identified(rows, model).collect()
    assert [(r.doc_id, r.lang, r.score) for r in kept] == [(3, "en", 1)]
    blank = langid.train(rows.limit(0))
    assert rows.select(langid.predict(rows, blank, F.col("text"))["lang_pred"].alias("p")).distinct().first().p == "und"
    assert langid.keep_identified(rows, blank).count() == 1


def test_quality(spark):
    docs, labels = table(spark, SF, "documents"), table(spark, SF, "labels")
    got = queries.op3_quality(spark, SF).join(labels, "doc_id").filter("held_out").collect()
    pos, neg = ([r.score for r in got if r.quality == q] for q in (1, 0))
    assert np.mean([a > b for a in pos for b in neg]) > 0.95 and all(0 <= r.score <= 1 for r in got)
    assert quality.train(docs, labels.limit(0), id_crc() % 3 != 1) is None
    rows = spark.createDataFrame([(None,), ("",), ("x" * 5000,)], "text string")
    net = quality.train(docs, labels, id_crc() % 3 != 1, positives=200, unlabelled=300)
    assert all(0 <= r[0] <= 1 for r in rows.select(quality.quality_score(rows, net, F.col("text"))).collect())


def test_contamination(spark):
    items = [(1, "a b c d e"), (2, "C d"), (10, None), (11, "!!"), (3, "é B"), (3, "x"), (None, "q r s t")]
    texts = ["a, b! C d e f", "A b c d", "c--D é b", None, "", "zz", "b c d e a b c d e", "x" * 3000 + " x", "o p q R s", "a b " * 20_000 + "c", "zz"]
    docs = spark.createDataFrame([(i, t, "k") for i, t in enumerate(texts)], "doc_id long, text string, items string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    for most, sent in ((300_000, 400), (4, 400), (4, 2)):  # one automaton, several in one pass, and several passes
        judged = decontam.contamination(docs, bench, "h", width=3, max_words=most, at_once=50_000, max_sent=sent)
        if sent == 400:  # one scan of the documents, and nothing is written
            assert not hasattr(judged, "written_to") and str(judged._jdf.queryExecution().optimizedPlan()).count("Relation") == 0
            assert str(judged._jdf.queryExecution().executedPlan()).count("ArrowEvalPython") == 1
        got = judged.collect()
        assert len(got) == len(texts)
        for r in got:
            n, k, ids = contamination(r.text, items, 3)
            assert (r.h.n_words, r.h.n_hit, r.h.items) == (n, k, [i for i in ids if i != "None"])
        first = next(r for r in got if r.doc_id == 0)
        assert [first.text[s.start : s.stop] for s in first.h.spans] == ["a, b! C d e"]
    assert decontam.contamination(docs, bench.limit(0)).agg(F.sum("hit.n_hit")).first()[0] == 0
    assert decontam.contamination(docs.limit(0), bench).count() == 0
    kept = decontam.decontaminate(docs.withColumnRenamed("items", "__hit"), bench.filter("item_id = 2"))
    assert kept.columns == ["doc_id", "text", "__hit"] and kept.count() == len(texts) - 4


def test_urls(spark):
    urls = ["http://a.net/", "http://x.EXAMPLE.net/en/1", "https://example.com/de/?q", "http://b.example.com/fr", "http://c.org/fr/x#y", "http://a.net", None, "nothing", "://net/x", "http://notnet/x", "http://u.com?x=http://a.net/", "http://" + "a." * 50 + "net/" + "p" * 2000]
    df = spark.createDataFrame([(i, u, 1) for i, u in enumerate(urls)], "page_id long, url string, n int")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.judge_urls(df, queries.BLOCK, queries.ALLOW).collect()}
    assert got[0] == ("a.net", "/", "net/", "block") and got[1] == ("x.example.net", "/en/1", "example.net/en/", "allow")
    assert got[2] == ("example.com", "/de/", "example.com/de/", "block") and got[3][2:] == (None, "allow") and got[4][2:] == ("org/fr/", "allow")
    assert got[5] == ("a.net", "", None, "allow") and got[6] == ("", "", None, "allow") == got[7]
    assert got[8] == ("net", "/x", "net/", "block") and got[9][2] is None and got[10] == ("u.com", "", None, "allow") and got[11][2:] == ("net/", "block")
    assert url_filter.judge_urls(df.limit(0), queries.BLOCK, queries.ALLOW).count() == 0
    own = df.withColumns({"__KEYS": F.lit(5), "__hit": F.lit("h")})
    judged = url_filter.judge_urls(own, queries.BLOCK, queries.ALLOW)
    assert set(own.columns) <= set(judged.columns) and {(r.page_id, r.rule, r["__KEYS"], r["__hit"]) for r in judged.collect()} == {(i, g[2], 5, "h") for i, g in got.items()}
    assert url_filter.judge_urls(df, [], []).filter("verdict = 'allow'").count() == len(urls)


def test_cascade_is_exact(spark):
    keys = spark.range(20_000).select(F.xxhash64("id", F.lit(11)).alias("a"), F.xxhash64("id", F.lit(13)).alias("b"), "id")
    listed = keys.filter("id % 7 = 0")
    c = url_filter.build_cascade(listed, keys.filter("id % 7 != 0"), first_rate=0.25, rate=0.5)
    rows = keys.toPandas()
    assert (c.listed(rows.a.to_numpy(), rows.b.to_numpy()) == (rows.id.to_numpy() % 7 == 0)).all() and len(c.levels) > 3


def water(sizes, weights, epochs):
    """Targets by sharing again and again."""
    total, target, open_ = sum(sizes), [Fraction(0)] * len(sizes), set(range(len(sizes)))
    left = Fraction(total)
    while left > 0 and open_:
        share = left / sum(weights[i] for i in open_)
        over = {i for i in open_ if target[i] + share * weights[i] >= epochs * sizes[i]}
        if not over:
            for i in open_:
                target[i] += share * weights[i]
            break
        for i in over:
            left -= epochs * sizes[i] - target[i]
            target[i] = Fraction(epochs * sizes[i])
        open_ -= over
    return target


def test_mixing(spark):
    rng = random.Random(6)
    rows = [(i, " ".join("w" * 3 for _ in range(rng.randint(0, 60))), rng.choice(["a", "b", "c", "d", "é", None, "tiny"] if i % 20 == 0 else ["a", "b"]), 5) for i in range(400)]
    rows += [(500, None, "b", 5), (500, None, "b", 5), (501, "", "void", 5), (3, rows[3][1], rows[3][2], 5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, size int")
    got = mixing.fair_queue(df).collect()
    sizes = defaultdict(int)
    for r in got:
        sizes[r.source] += r.size
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None]
    want = dict(zip(names, water([sizes[s] for s in names], [i % 3 + 1 for i in range(len(names))], 3)))
    taken = defaultdict(int)
    for r in got:
        assert abs(r.target - float(want[r.source])) < 1e-6 and r.source_size == sizes[r.source] and 0 <= r.taken <= 3 * r.size
        taken[r.source] += r.taken
    assert len(got) == len(rows) and all(abs(taken[s] - float(want[s])) <= 2 * max(r.size for r in got) for s in names)
    assert sum(taken.values()) == sum(sizes.values())
    assert sorted(map(repr, mixing.fair_queue(df.repartition(3)).collect())) == sorted(map(repr, got))
    order = sorted(mixing.schedule(mixing._queues(df, "doc_id", "text", "source", (1, 2, 3), 3)).collect(), key=lambda r: r.before)
    assert [r.before for r in order] == [sum(r.words for r in order[:i]) for i in range(len(order))]
    assert [r.finish for r in order] == sorted(r.finish for r in order) and all(r.words == r.size for r in order[:-1])
    assert mixing.fair_queue(df.limit(0)).count() == 0


def test_languages_by_plain_backoff(spark):
    import math
    import re
    import zlib

    docs = table(spark, SF, "documents").select("doc_id", "text", "lang").filter("doc_id % 3 = 0")
    rows = docs.collect()
    word = re.compile(r"[^\W\d_]+")
    words = lambda t: [w for w in word.findall((t or "").lower())]
    cut = lambda w, n: [f"<{w}>"[i : i + n] for i in range(len(w) + 3 - n)] if n > 1 else list(w)
    seen, prior = {n: defaultdict(lambda: defaultdict(int)) for n in range(5)}, defaultdict(int)
    for r in rows:
        if r.lang is not None and r.text is not None and zlib.crc32(str(r.doc_id).encode()) % 5:
            prior[r.lang] += 1
            for w in words(r.text):
                for n in range(5):
                    for g in cut(w, n) if n else [w]:
                        seen[n][g][r.lang] += 1
    langs = sorted(prior)
    size = {(n, x): sum(c[x] for c in seen[n].values()) for n in seen for x in langs}
    value = lambda n, g, x: math.log((seen[n][g][x] + 0.5) / (size[n, x] + 0.5 * len(seen[n]) + 1))

    def judge(text):
        found = words(text)
        if not found:
            return "und", 0.0
        total = {x: math.log(prior[x] / sum(prior.values())) for x in langs}
        for w in found:
            n, known = (0, [w]) if w in seen[0] else next(((n, k) for n in (4, 3, 2, 1) if (k := [g for g in cut(w, n) if g in seen[n]])), (0, []))
            for x in langs:
                total[x] += sum(value(n, g, x) for g in known) / len(known) if known else 0
        best = max(langs, key=lambda x: total[x])
        return best, 1 / sum(math.exp(total[x] - total[best]) for x in langs)

    model = langid.train(docs.filter(id_crc() % 5 != 0), docs_per_lang=10**6)
    odd = spark.createDataFrame([(-1, "zzzq the xylo", "x"), (-2, "zzzq the xylo", "x"), (-3, "\u4e2d\u6587", None), (-4, "the " * 50_000, None)], docs.schema)
    every = docs.unionByName(odd)
    got = {r.doc_id: r.p for r in every.select("doc_id", langid.predict(docs, model, F.col("text")).alias("p")).collect()}
    for r in every.collect():
        lang, score = judge(r.text)
        assert got[r.doc_id].lang_pred == lang and abs(got[r.doc_id].score - score) < 1e-6


def test_quality_network_by_plain_arithmetic():
    rng = np.random.default_rng(1)
    net = quality.Network(rng.normal(size=3), np.array([1.0, 2.0, 0.5]), 2, 3)
    x = rng.normal(size=(5, 3))
    for row, got in zip(x, net.score(x)):
        t = [min(6, max(-6, (row[i] - net.mean[i]) / net.scale[i])) for i in range(3)]
        a = [np.tanh(sum(t[i] * net.p[0][i][j] for i in range(3)) + net.p[1][j]) for j in range(2)]
        assert abs(got - 1 / (1 + np.exp(-(sum(a[j] * net.p[2][j] for j in range(2)) + net.p[3][0])))) < 1e-12

    def risk(z, b, prior, plain):
        plus, minus = np.log1p(np.exp(-z)), np.log1p(np.exp(z))
        if plain:
            return plus[:b].mean() + minus[b:].mean()
        slack = minus[b:].mean() - prior * minus[:b].mean()
        return prior * plus[:b].mean() + slack if slack >= 0 else -slack

    for seed, prior, plain in [(2, 0.3, False), (3, 0.9, False), (4, 0.5, True), (5, 0.99, False)]:
        z = np.random.default_rng(seed).normal(0, 2, 9)
        z[:4] += 3 if prior == 0.99 else 0  # so that the unlabelled part is over-fitted
        g = quality.slopes(1 / (1 + np.exp(-z)), 4, prior, plain)
        for i in range(9):
            d = np.zeros(9)
            d[i] = 1e-6
            assert abs((risk(z + d, 4, prior, plain) - risk(z - d, 4, prior, plain)) / 2e-6 - g[i]) < 1e-6


def test_quality_prior_comes_from_positives_and_unlabelled():
    rng = np.random.default_rng(2)
    pad = np.zeros((4000, len(quality.FEATURES) - 2))
    for share in (0.2, 0.7):
        good = rng.random(4000) < share
        unl = np.c_[rng.normal(0, 1, (4000, 2)) + np.where(good, 3, 0)[:, None], pad]
        pos = np.c_[rng.normal(3, 1, (1500, 2)), pad[:1500]]
        assert abs(quality.estimated_prior(pos, unl, 8, 0) - share) < 0.1


def test_quality_rows(spark):
    """Repeated rows, conflicting labels, clashing columns, null ids."""
    docs, labels = table(spark, SF, "documents").select("doc_id", "text"), table(spark, SF, "labels")
    some = docs.filter("doc_id < 300")
    odd = some.unionByName(some.filter("doc_id < 40")).unionByName(spark.createDataFrame([(None, "x y"), (5, None)], some.schema))
    clash = labels.unionByName(labels.filter("doc_id < 20").withColumn("quality", (1 - F.col("quality")).cast(labels.schema["quality"].dataType)))
    net = quality.train(odd.withColumn("score", F.lit("s")).withColumn("x", F.lit(1)), clash.withColumn("text", F.lit(0)), F.lit(True))
    again = quality.train(odd.repartition(5), clash.repartition(3), F.lit(True))
    scored = odd.withColumn("score", quality.quality_score(odd, net, F.col("text"))).collect()
    assert len(scored) == odd.count() and len({(r.text, r.score) for r in scored}) == len({r.text for r in scored})
    assert all(np.allclose(a, b) for a, b in zip(net.p, again.p))


def test_repeated_and_missing_rows(spark):
    path = public_tokenizers.path("piece_bpe_32k.model")
    texts = spark.createDataFrame([("a b",), ("a b",), (None,)], "text string")
    assert [r.n for r in texts.select(token_count.token_count(F.col("text"), path).alias("n")).collect()] == [2, 2, 0]
    assert texts.limit(0).select(token_count.token_count(F.col("text"), path).alias("n")).count() == 0
    pages = spark.createDataFrame([("http://a.net/x", 1), ("http://a.net/x", 1), (None, 2)], "url string, host int")
    got = url_filter.judge_urls(pages, queries.BLOCK, queries.ALLOW).collect()
    assert sorted((r.host, r.verdict) for r in got) == [("", "allow"), ("a.net", "block"), ("a.net", "block")]
    long = spark.createDataFrame([(1, "w " * 200_000, "s"), (2, "v " * 10, "t"), (2, "v " * 10, "t"), (None, None, None)], "doc_id long, text string, source string")
    mix = mixing.fair_queue(long).collect()
    assert len(mix) == 4 and max(r.size for r in mix) == 200_000 and sum(r.taken for r in mix) == 200_020


def test_long_words_are_merged_alike(spark):
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    rng = random.Random(12)
    texts = ["".join(rng.choice(x) for _ in range(n)) for x in ("ab", "theingonab", "aeiou\u65e5t0", "a", "=-") for n in (97, 500, 4000)]
    model = token_count.PieceBpe(path)
    assert model.count(texts) == [len(sp.encode(t)) for t in texts]
    assert [model.count([t])[0] for t in texts] == [len(sp.encode(t)) for t in texts]
