import random

import numpy as np
import pyarrow as pa
import pytest
from brute import groups, substring, suffix

from lattiq.llm import automaton_dedup, jaccard_join, ragged, repeats, suffix_dedup

SCHEMA = "doc_id long, text string, spans string, rest int"  # columns that an operator could trip over


def corpus(seed):
    rng = random.Random(seed)
    base = ["".join(rng.choice("ab ") for _ in range(300)) for _ in range(5)]
    docs = [(i, "".join(rng.choice(base)[a : a + rng.randint(20, 150)] for a in (rng.randint(0, 200) for _ in range(3)))) for i in range(50)]
    docs += [(900, None), (901, ""), (902, "a b " * 200), (903, "x" * 700), (904, "é" * 90), (905, " \n ")]
    docs += [(906, docs[3][1]), (907, docs[3][1]), (5, docs[5][1])]  # copies, and a repeated row
    return docs


def frame(spark, docs):
    return spark.createDataFrame([(i, t, "s", 1) for i, t in docs], SCHEMA)


@pytest.mark.parametrize("ids", ["unique", "repeated"])
def test_suffix_dedup(spark, ids):
    docs = corpus(1) if ids == "repeated" else corpus(1)[:-1]
    got = suffix_dedup.remove_repeats(frame(spark, docs), 40).collect()
    assert sorted((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got) == sorted(suffix(docs, 40))
    assert any(r.n_removed for r in got)


def test_suffix_dedup_counts_large_groups_the_same(spark):
    docs = corpus(2)[:-1]
    rows = repeats.keyed(frame(spark, docs), "doc_id", "text")
    plan = repeats.Plan(words=False, length=40, gram=24, first_wins=False)
    few = repeats.repeated_spans(spark, rows, plan, suffix_dedup.sorted_runs, max_group=1).collect()
    want = repeats.repeated_spans(spark, rows, plan, suffix_dedup.sorted_runs).collect()
    assert {(r.d, tuple(repeats.covered(r.spans))) for r in few} == {(r.d, tuple(repeats.covered(r.spans))) for r in want}


@pytest.mark.parametrize("ids", ["unique", "repeated"])
def test_substring_dedup(spark, ids):
    docs = [*corpus(3), (None, corpus(3)[0][1])] if ids == "repeated" else corpus(3)[:-1]
    got = automaton_dedup.remove_substrings(frame(spark, docs), 12).collect()
    key = lambda r: (r[0] is None, r[0] or 0, *r[1:])
    assert sorted(((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in got), key=key) == sorted(substring(docs, 12), key=key)


def test_automaton_matches():
    machine = automaton_dedup.SuffixAutomaton()
    rng = random.Random(4)
    seen = []
    for _ in range(30):
        probe = [rng.choice("abc") for _ in range(20)]
        want = [max((n for n in range(j + 2) if any(probe[j + 1 - n : j + 1] == s[a : a + n] for s in seen for a in range(len(s) - n + 1))), default=0) for j in range(20)]
        assert machine.matching(probe) == want
        seen.append([rng.choice("abc") for _ in range(15)])
        machine.add(seen[-1])


def test_jaccard_groups(spark):
    rng = random.Random(5)
    docs = []
    for _ in range(12):
        base = [f"w{rng.randrange(200)}" for _ in range(rng.randint(1, 90))]
        for _ in range(rng.randint(1, 6)):
            x = list(base)
            for _ in range(rng.randint(0, max(1, len(x) // 30))):
                x[rng.randrange(len(x))] = f"w{rng.randrange(200)}"
            docs.append((len(docs), rng.choice(" \n\t").join(x)))
    docs += [(500, None), (501, ""), (502, " \n"), (503, "a B"), (504, "A  b"), (505, "the " * 300), (506, "The " * 400), (0, docs[0][1])]
    got = jaccard_join.linked_groups(frame(spark, docs)).collect()
    want = groups(docs, 4, 85)
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == sorted(want) and len({w[2] for w in want}) < len(want)
    kept = jaccard_join.keep_one(frame(spark, docs), 4, 85)
    assert kept.columns == ["doc_id", "text", "spans", "rest"]
    assert kept.count() == len({c for _, n, c in want if n}) + sum(1 for _, n, _ in want if not n)


def test_empty_tables(spark):
    none = frame(spark, [])
    assert suffix_dedup.remove_repeats(none).count() == 0 and automaton_dedup.remove_substrings(none).count() == 0
    assert jaccard_join.linked_groups(none).count() == 0 and suffix_dedup.strip_repeats(none).count() == 0


def test_strip_keeps_columns(spark):
    docs = [(1, "q" * 30 + "z" * 60), (2, "z" * 60 + "r" * 5), (3, None)]
    got = {r.doc_id: r for r in suffix_dedup.strip_repeats(frame(spark, docs), 50).collect()}
    assert got[1].text == "q" * 30 and got[2].text == "r" * 5 and got[3].text == "" and got[1].spans == "s" and got[1].rest == 1


def test_substring_dedup_counts_large_groups_the_same(spark):
    docs = corpus(6)[:-1]
    rows = repeats.keyed(frame(spark, docs), "doc_id", "text")
    plan = repeats.Plan(words=True, length=12, gram=6, first_wins=True)
    few = repeats.repeated_spans(spark, rows, plan, automaton_dedup.streamed, max_group=1).collect()
    want = repeats.repeated_spans(spark, rows, plan, automaton_dedup.streamed).collect()
    assert {(r.d, tuple(repeats.covered(r.spans))) for r in few} == {(r.d, tuple(repeats.covered(r.spans))) for r in want} != set()


def test_small_shards_find_the_same():
    rng = random.Random(8)
    passages = sorted((rng.randrange(30), tuple(rng.choice("ab") for _ in range(rng.randint(5, 20)))) for _ in range(80))
    whole = automaton_dedup._stream(passages, 5, 1 << 30)
    assert automaton_dedup._stream(passages, 5, 20) == whole
    for (d, words), ends in zip(passages, whole):
        assert ends == [j for j in range(4, len(words)) if any(e < d and words[j - 4 : j + 1] == w[a : a + 5] for e, w in passages for a in range(len(w)))]


def test_multikey_sorts_and_counts_shared_bytes():
    rng = random.Random(9)
    texts = [bytes(rng.choice(b"ab") for _ in range(23)) for _ in range(300)]
    group = np.sort(np.array([rng.randrange(40) for _ in texts]))

    def word(rows, at):
        return np.array([int.from_bytes(texts[i][at : at + 5].ljust(5, b"\0"), "big") for i in rows], np.uint64)

    order, share = suffix_dedup.multikey(group, 23, word)
    assert [texts[i] for i in order] == [t for g in range(40) for t in sorted(texts[i] for i in np.flatnonzero(group == g))]
    for a, b, n in zip(order, order[1:], share[1:]):
        assert n == (-1 if group[a] != group[b] else next((i for i in range(23) if texts[a][i] != texts[b][i]), 23))


def test_very_long_texts(spark):
    """Texts of several parts, with passages that cross the seams."""
    rng = random.Random(10)
    words = [f"{rng.randrange(10**6)}" for _ in range(100_000)]
    seam = ragged.PIECE
    long = " ".join(words)
    inside = long[seam - 150 : seam + 150] + " | " + long[2 * seam - 20 : 2 * seam + 400]
    docs = [(1, long), (2, inside), (3, long[:1000]), (4, " ".join(words[65_500:65_600])), (5, " ".join(words[20:60]))]
    got = suffix_dedup.remove_repeats(frame(spark, docs), 200).collect()
    assert sorted((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got) == sorted(suffix(docs, 200))
    got = automaton_dedup.remove_substrings(frame(spark, docs), 50).collect()
    assert sorted((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in got) == sorted(substring(docs, 50))
    assert next(r for r in got if r.doc_id == 4).n_removed == 100 and len(long) > 2 * seam
    got = jaccard_join.linked_groups(frame(spark, [*docs, (6, long + " z")])).collect()
    assert {r.doc_id: r.component_id for r in got}[6] == 1 and next(r for r in got if r.doc_id == 1).n_shingles == 99_997


def thue_morse(n):
    w = "a"
    while len(w) < n:
        w += w.translate(str.maketrans("ab", "ba"))
    return w


def test_regular_words_have_different_codes(spark):
    flip = str.maketrans("ab", "ba")
    for n in (256, 1024, 2048, 4096):
        w = thue_morse(n)
        a, b = (jaccard_join.shingles(pa.array([f"x y {v} z q"]), 4)[0] for v in (w, w.translate(flip)))
        assert len(a) == 2 and not set(a.tolist()) & set(b.tolist())
    w = thue_morse(2048)
    docs = [(1, f"x y {w} z q"), (2, f"x y {w.translate(flip)} z q"), (3, w), (4, w.translate(flip))]
    got = {r.doc_id: r.component_id for r in jaccard_join.linked_groups(frame(spark, docs)).collect()}
    assert got == {1: 1, 2: 2, 3: 3, 4: 4}
    kept = suffix_dedup.remove_repeats(frame(spark, docs[2:]), 200).collect()
    assert sorted((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in kept) == sorted(suffix(docs[2:], 200))


def test_common_shingles_meet_in_blocks(spark, monkeypatch):
    rng = random.Random(11)
    common = [f"c{i}" for i in range(60)]
    docs = []
    for i in range(60):  # edits that leave some pairs above and some below the limit
        x = list(common)
        for _ in range(rng.randint(0, 3)):
            x[rng.randrange(60)] = f"e{rng.randrange(12)}"
        docs.append((i, " ".join(x)))
    want = sorted(groups(docs, 4, 85))
    for block in (4096, 7):
        monkeypatch.setattr(jaccard_join, "BLOCK", block)
        got = jaccard_join.linked_groups(frame(spark, docs)).collect()
        assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == want
    assert len({w[2] for w in want}) > 1


def test_spans_are_merged_before_they_are_collected(spark):
    from lattiq.llm.repeats import covered, merged

    rng = random.Random(9)
    rows = [(d, h, a << 32 | a + rng.randint(1, 9)) for d in (1, 2, None) for h in (0, 7) for a in [rng.randint(0, 200) for _ in range(60)]]
    found = {}
    for r in merged(spark.createDataFrame(rows, "d long, h long, span long")).collect():
        found.setdefault((r.d, r.h), []).append((r.span >> 32, r.span & 0xFFFFFFFF))
    assert {k: sorted(v) for k, v in found.items()} == {(d, h): covered([s for x, y, s in rows if (x, y) == (d, h)]) for d in (1, 2, None) for h in (0, 7)}
