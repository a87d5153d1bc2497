"""Phrase collocations, packing and fill-in-the-middle."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from lattiq.llm import collocations, fill_middle, packing, queries
from lattiq.llm.common import table
from lattiq.llm.ragged import U

SF = "/root/testdata/sf0.01"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain_collocations(rows, width, least, top, percent):
    count, n = defaultdict(Counter), Counter()
    for lang, text in rows:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang or "und"] += len(w)
            for m in range(1, width + 1):
                count[lang or "und"].update(tuple(w[i : i + m]) for i in range(len(w) - m + 1))
    out = []
    for lang, f in count.items():
        found = []
        cand = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        inside = defaultdict(int)
        for p, a in cand.items():
            for m in range(2, len(p)):
                for i in range(len(p) - m + 1):
                    inside[p[i : i + m]] = max(inside[p[i : i + m]], a)
        for p, a in cand.items():
            if not (p in inside and 100 * inside[p] >= percent * a):
                score, k = min((1_000_000 * a * a // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p)))
                found.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        out += [(lang, i + 1, p.decode(), -a, left, right, n[lang], -s) for i, (s, a, p, left, right) in enumerate(sorted(found)[:top])]
    return sorted(out)


@pytest.mark.parametrize("width, least, top, block", [(3, 3, 2000, 1 << 20), (4, 2, 40, 16), (2, 2, 7, 5)])
def test_collocations(spark, width, least, top, block):
    rng = random.Random(width)
    words = ["the", "The", "of", "a", "é", "日本", "x" * 40, "in-deed", "o'b", "\x1c", "\xa0", "..", "a.b"]
    rows = [(rng.choice(["en", "de", None, "und"]), "".join(rng.choice(words) + rng.choice([" ", "  ", "\t", ". ", ",", "\n", " "]) for _ in range(rng.randint(0, 60)))) for _ in range(60)]
    rows += [("en", None), ("en", ""), (None, " . \n"), ("en", "the of the of the of"), rows[0], rows[0], ("de", "a a a a a a a"), ("en", "of a " * 500)]
    df = spark.createDataFrame([(*r, i, 1.0) for i, r in enumerate(rows)], "lang string, text string, n long, score double")
    got = collocations.collocations(df, width, least, top, 50, block=block)
    assert sorted(tuple(r) for r in got.collect()) == plain_collocations(rows, width, least, top, 50)
    assert collocations.collocations(df.limit(0)).count() == 0 and collocations.collocations(df.filter("text = ''")).count() == 0


def test_words_are_alike_in_slices():
    rng = random.Random(0)
    text = "".join(rng.choice("ab .,\n\té日") for _ in range(500)).encode().translate(collocations.TABLE)
    whole = [w for part in collocations.tokens(text, 1 << 20) for w in part]
    for size in (1, 3, 17, 100):
        assert [w for part in collocations.tokens(text, size) for w in part] == whole


def test_scores_beyond_64_bits(spark):
    big = 3 * 10**12
    c = spark.createDataFrame([("en", "a b", big, 2)], "lang string, phrase string, a long, m int")
    f = spark.createDataFrame([("en", "a", big + 7), ("en", "b", big + 11)], "lang string, phrase string, a long")
    assert collocations.best_cut(c, f).first().score == 1_000_000 * big * big // ((big + 7) * (big + 11))


def test_bit_array_lets_all_frequent_through(spark):
    rows = [("en", f"w{i} x{i % 7}") for i in range(3000)]
    bits = collocations.bits_of(spark.createDataFrame(rows, "lang string, phrase string"))
    code = collocations.joined(collocations.codes("en", [f"w{i}" for i in range(3000)]), collocations.codes("en", [f"x{i % 7}" for i in range(3000)]))
    assert bits.has(code).all() and bits.has(code + U(1 << 50)).mean() < 0.05


def check_packing(rows, ids, size, most_cut):
    """Rows of ``pack`` with ids; every id is in one piece, and sequences are gapless and need no padding."""
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for r in rows:
        assert r.length == len(r.ids) // 4 > 0
        by_doc[r.doc_id, r.doc_tokens].append(r)
        by_seq[r.sequence_id].append(r)
    for (doc, n), pieces in by_doc.items():
        pieces.sort(key=lambda r: r.start)
        assert len(ids[doc]) == n and sum(r.length for r in pieces) == n
        assert [r.start for r in pieces] == np.cumsum([0, *[r.length for r in pieces]])[:-1].tolist()
        assert np.frombuffer(b"".join(r.ids for r in pieces), "<u4").tolist() == ids[doc]
    assert {d for d, _ in by_doc} == set(ids)
    for pieces in by_seq.values():
        pieces.sort(key=lambda r: r.offset)
        assert [r.offset for r in pieces] == np.cumsum([0, *[r.length for r in pieces]])[:-1].tolist()
        total = sum(r.length for r in pieces)
        assert total == size or total < size and total & (total - 1) == 0
    needed = sum(-(-len(v) // size) for v in ids.values())
    assert len(rows) <= needed + most_cut


def library_ids(texts):
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    return [[*e.ids, 1] for e in t.encode_batch(texts, add_special_tokens=False)]


def test_packing(spark):
    import public_tokenizers

    path = public_tokenizers.path("word_bpe_49k.json")
    rng = random.Random(2)
    texts = [None, "", " ", "It's <|endoftext|> <|ENDOFTEXT|> a<|startoftext|>. B.", "Å İ. É. Å", "... x. !?", "e.g. 3.5, x", "don't. we'll, 'S. ''s.", "\x1c.\x85.", "日本。 ab. 12."]
    texts += ["".join(rng.choice(["The", "a", "é.", ". ", " ", "\n", "Q", "ʼn", "é", "<|", "|>", "'s", "İ", "ß", "x,", "\t", "😀", "9."]) for _ in range(rng.randint(1, 3000))) for _ in range(60)]
    texts += ["word " * 40_000, "same text. " * 30, "same text. " * 30]
    df = spark.createDataFrame([(i, t, 7, 8) for i, t in enumerate(texts)], "doc_id int, text string, start int, ids int").repartition(3, "doc_id")
    ids = dict(enumerate(library_ids([t or "" for t in texts])))
    for size, most_open in ((2048, 1024), (64, 1024), (64, 2)):
        rows = packing.pack(df, path, size=size, most_open=most_open).collect()
        check_packing(rows, ids, size, 3 * 64 if most_open > 2 else 2 * len(texts) + 3 * 64)
    assert packing.pack(df.limit(0), path).count() == 0
    nulls = packing.pack(spark.createDataFrame([(None, "a"), (None, "a")], "doc_id string, text string").coalesce(1), path).collect()
    assert [(r.doc_id, r.length) for r in nulls] == [(None, 2), (None, 2)]


def test_op12_packing(spark):
    docs = table(spark, SF, "documents").select("doc_id", "text").collect()
    ids = {r.doc_id: v for r, v in zip(docs, library_ids([r.text or "" for r in docs]))}
    got = queries.op12_packing(spark, SF).collect()
    import zlib

    for r in got:
        assert zlib.crc32(np.array(ids[r.doc_id][r.start : r.start + r.length], "<u4").tobytes()) == r.ids_crc32 and r.doc_tokens == len(ids[r.doc_id])
    assert sum(r.length for r in got) == sum(map(len, ids.values()))
    totals = Counter()
    for r in got:
        totals[r.sequence_id] += r.length
    assert all(t == 2048 or t & (t - 1) == 0 for t in totals.values())


def test_level_has_least_sum_of_squares():
    rng = np.random.default_rng(3)
    packer = packing.Packer(32, 0, 10**6)
    for i in range(400):
        n = int(rng.choice([3, 5, 11, 17, 20, 29, 31]))
        options = {0: packer.count.copy()} | {int(h): packer.count.copy() for h in np.flatnonzero(packer.count) if h + n <= 32}
        for h, counts in options.items():
            counts[h] -= h > 0
            counts[h + n] += h + n < 32
        cost = {h: int((c[1:32] ** 2).sum()) for h, c in options.items()}
        assert cost[packer.level_for(n)] == min(cost.values())
        packer.add(i, b"\0\0\0\0" * n)


def test_boundaries():
    rng = random.Random(4)
    for n in (0, 1, 63, 64, 65, 511, 512, 513, 5000):
        text = "".join(rng.choice("aé日😀") for _ in range(n))
        data = np.frombuffer(text.encode(), np.uint8)
        b = fill_middle.Boundaries(data)
        starts = np.flatnonzero((data & 0xC0) != 0x80)
        assert b.total == n
        assert b.select(np.arange(n + 2)).tolist() == [*starts.tolist(), len(data), len(data)]
        assert b.rank(np.arange(len(data) + 1)).tolist() == [int((starts < i).sum()) for i in range(len(data) + 1)]


def test_fill_in_middle(spark):
    rng = random.Random(5)
    texts = [None, "", "a", "é", "日😀", "x<P>y", "<S>", "<M", "<<P", ">S>", "a\n<́P>"] + ["".join(rng.choice("ab<P>S M日é😀\n") for _ in range(rng.randint(0, 80))) for _ in range(300)]
    texts += ["日" * 300_000 + "x", "same", "same"]
    rows = [(None if i == 5 else i, t, "z", 0) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n string, output int").repartition(2)
    made = fill_middle.fill_in_middle(df, "n").withColumn("back", fill_middle.restored(F.col("n.output"), F.col("n.form")))
    forms = Counter()
    for r in made.collect():
        t, f = r.text or "", r.n
        s = hashlib.sha256(f"1:{'' if r.doc_id is None else r.doc_id}".encode()).hexdigest()
        h = [int(s[8 * i : 8 * i + 8], 16) for i in range(4)]
        a, b = sorted((h[0] % (len(t) + 1), h[1] % (len(t) + 1)))
        form = "plain" if not t or any(m in t for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90 else "spm" if h[3] % 100 < 20 else "psm"
        want = {"plain": t, "psm": f"<P>{t[:a]}<S>{t[b:]}<M>{t[a:b]}", "spm": f"<S>{t[b:]}<P>{t[:a]}<M>{t[a:b]}"}[form]
        assert (f.n, f.form, f.output, r.back, r.output) == (len(t), form, want, t, 0)
        assert (f.prefix_chars, f.middle_chars) == ((None, None) if form == "plain" else (a, b - a))
        forms[form] += 1
    assert len(forms) == 3 and fill_middle.fill_in_middle(df.limit(0)).count() == 0


@pytest.mark.parametrize("name", ["op11_collocations", "op13_fill_middle"])
def test_against_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    df = queries.QUERIES[name](spark, SF)
    cur = con.execute(queries.ORACLES[name])
    at = [[d[0] for d in cur.description].index(c) for c in df.columns]
    assert sorted(map(tuple, df.collect()), key=repr) == sorted((tuple(r[i] for i in at) for r in cur.fetchall()), key=repr)
