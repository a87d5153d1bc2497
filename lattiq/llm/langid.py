"""Language identification by word-first backoff.

A word that training has seen scores by its log frequency in each language. An unseen word falls back to its character
4-grams, then 3-, 2- and 1-grams: the longest length of which any gram is known decides, with the mean log frequency of
the known grams. A text's language has the highest sum over all its words; the score is the posterior.
"""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import free_name, hash_share, small_batches
from .ragged import release

WORDS = re.compile(r"[^\W\d_]+")
LENGTHS = (4, 3, 2, 1)
UNKNOWN = "und"
#: Unseen words whose rows a worker remembers.
REMEMBERED = 1 << 16
_OUT = pa.struct([("lang_pred", pa.string()), ("score", pa.float64())])


def words_of(text: str | None) -> list[str]:
    found = WORDS.findall(text.lower()) if text else []
    return found if any(c.isalpha() for w in found for c in w) else []


def grams(word: str, n: int) -> list[str]:
    marked = f"<{word}>" if n > 1 else word
    return [marked[i : i + n] for i in range(len(marked) - n + 1)]


def _count_words(batches):
    """(lang, text) to (lang, word, k)."""
    for batch in batches:
        seen: dict[str, Counter] = {}
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            seen.setdefault(lang, Counter()).update(words_of(text))
        for lang, found in seen.items():
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(found), pa.string()), pa.array(list(found), pa.string()), pa.array(list(found.values()), pa.int64())], ["lang", "word", "k"])
    release()


def _count_grams(batches):
    """(lang, word, k) to (lang, n, gram, k); length 0 is a whole word."""
    for batch in batches:
        seen: dict[tuple[str, int], Counter] = {}
        for lang, word, k in zip(*(c.to_pylist() for c in batch.columns)):
            seen.setdefault((lang, 0), Counter())[word] += k
            for n in LENGTHS:
                found = seen.setdefault((lang, n), Counter())
                for g in grams(word, n):
                    found[g] += k
        for (lang, n), found in seen.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(found), pa.string()), pa.array([n] * len(found), pa.int32()), pa.array(list(found), pa.string()), pa.array(list(found.values()), pa.int64())],
                ["lang", "n", "gram", "k"],
            )
    release()


class Model:
    """For each length (0: whole words) an index of known grams and a matrix of their log frequencies per language."""

    def __init__(self, counts: pa.Table | None, docs: dict[str, int]):
        """``counts`` has lang, n, gram and k, each gram of a language once."""
        self.langs = sorted(docs)
        total = sum(docs.values()) or 1
        self.prior = np.array([math.log(docs[lang] / total) for lang in self.langs])
        self.tables: dict[int, tuple[dict[str, int], np.ndarray]] = {}
        for n in (0, *LENGTHS):
            own = counts.filter(pc.equal(counts.column("n"), n)).combine_chunks() if counts is not None else None
            grams_ = own.column("gram").combine_chunks().dictionary_encode() if own is not None else pa.array([], pa.string()).dictionary_encode()
            index = {g: i for i, g in enumerate(grams_.dictionary.to_pylist())}
            seen = np.zeros((len(index), len(self.langs)))
            if len(index):
                place = pc.index_in(own.column("lang").combine_chunks(), pa.array(self.langs, pa.string())).to_numpy(zero_copy_only=False)
                seen[grams_.indices.to_numpy(), place] = own.column("k").to_numpy()
            self.tables[n] = index, np.log((seen + 0.5) / (seen.sum(0) + 0.5 * len(index) + 1))

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k not in ("rows", "index", "used")}

    def _start(self) -> None:
        """The words known at first; unseen ones are added as they come."""
        index, rows = self.tables[0]
        self.index, self.rows, self.used = dict(index), np.zeros((len(index) + 1024, len(self.langs))), len(index)
        self.rows[: self.used] = rows

    def _unseen(self, words: list[str]) -> np.ndarray:
        """The backed-off rows of words, all at once for each length of gram."""
        out, left = np.zeros((len(words), len(self.langs))), np.arange(len(words))
        for n in LENGTHS:
            if not len(left):
                break
            index, rows = self.tables[n]
            parts = [grams(words[i], n) for i in left]
            sizes = np.array([len(p) for p in parts])
            ids = np.fromiter((index.get(g, -1) for p in parts for g in p), np.int64, sizes.sum())
            owner = np.repeat(np.arange(len(left)), sizes)[ids >= 0]
            known = np.bincount(owner, minlength=len(left))
            found = rows[ids[ids >= 0]]
            hit = known > 0
            for j in range(len(self.langs)):
                out[left[hit], j] = (np.bincount(owner, found[:, j], len(left)) / np.maximum(known, 1))[hit]
            left = left[~hit]
        return out

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        if not self.langs:
            return [UNKNOWN] * len(texts), [0.0] * len(texts)
        if not hasattr(self, "index") or self.used > len(self.tables[0][0]) + REMEMBERED:
            self._start()
        docs = [words_of(t) for t in texts]
        index = self.index
        fresh = [w for w in set().union(*docs) if w not in index] if docs else []
        for i in range(0, len(fresh), 10_000):
            part = fresh[i : i + 10_000]
            rows = self._unseen(part)
            if self.used + len(part) > len(self.rows):
                self.rows = np.concatenate([self.rows[: self.used], np.zeros((max(self.used // 4, len(part)), len(self.langs)))])
            self.rows[self.used : self.used + len(part)] = rows
            index.update(zip(part, range(self.used, self.used + len(part))))
            self.used += len(part)
        langs, scores = [], []
        for found in docs:
            if not found:
                langs.append(UNKNOWN)
                scores.append(0.0)
                continue
            total = self.prior + self.rows[np.fromiter(map(index.__getitem__, found), np.int64, len(found))].sum(0)
            share = np.exp(total - total.max())
            best = int(total.argmax())
            langs.append(self.langs[best])
            scores.append(float(share[best] / share.sum()))
        return langs, scores


def train(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", keys=("doc_id",), docs_per_lang: int = 1000, max_docs: int = 20_000) -> Model:
    """Fits on a bounded sample: about ``docs_per_lang`` documents of each language, or fewer where all would be more than
    ``max_docs``, drawn by a hash of ``keys``. All words and grams of their whole texts are learned. Rows with null language
    or text teach nothing, repeated rows are drawn together; without any labelled row every text is ``und``. Other columns
    play no part."""
    labelled = docs.filter(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"), hash_share(5, *keys).alias("at"))
    sizes = {r.lang: r["count"] for r in labelled.groupBy("lang").count().collect()}
    if not sizes:
        return Model(None, {})
    most = max(1, min(docs_per_lang, max_docs // len(sizes)))
    # one row a language, as collected; from Arrow, as rows of Python objects would start workers of another kind
    shares = docs.sparkSession.createDataFrame(pa.table({"lang": pa.array(list(sizes), pa.string()), "share": pa.array([min(1.0, most / n) for n in sizes.values()], pa.float64())}))
    drawn = labelled.join(F.broadcast(shares), "lang").filter("at < share").select("lang", "text")
    words = drawn.mapInArrow(_count_words, "lang string, word string, k bigint").groupBy("lang", "word").agg(F.sum("k").alias("k"))
    counts = words.mapInArrow(_count_grams, "lang string, n int, gram string, k bigint").groupBy("lang", "n", "gram").agg(F.sum("k").alias("k"))
    return Model(counts.toArrow(), sizes)


def predict(docs: DataFrame, model: Model, text: Column, texts_at_once: int = 256) -> Column:
    """A struct column: ``lang_pred`` (``und`` with score 0 if the text is null, empty or has no letter) and ``score``. Whole
    texts are judged, however long; equal texts alike, and equal sums go to the first language by code point."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("struct<lang_pred:string,score:double>")
    def judge(texts: pa.Array) -> pa.Array:
        langs, scores = [], []
        for i in range(0, len(texts), texts_at_once):
            found = shared.value.predict(texts.slice(i, texts_at_once).to_pylist())
            langs += found[0]
            scores += found[1]
        release()
        return pa.StructArray.from_arrays([pa.array(langs, pa.string()), pa.array(scores, pa.float64())], fields=list(_OUT))

    return judge.asNondeterministic()(text)  # else a filter on the result would have it computed twice


def keep_identified(docs: DataFrame, model: Model, lang_col: str = "lang", text_col: str = "text", least: float = 0.5) -> DataFrame:
    """The rows of ``docs`` whose language is found with a score of ``least`` or more; a null language is filled in. A model
    that has learned no language rejects only texts without a letter."""
    if not model.langs:
        return docs.filter(F.coalesce(F.col(text_col).rlike(r"\p{L}"), F.lit(False)))
    name = free_name(docs, "__p")
    found = F.col(name)
    rows = docs.withColumn(name, predict(docs, model, F.col(text_col))).filter((found["lang_pred"] != UNKNOWN) & (found["score"] >= least))
    return rows.withColumn(lang_col, F.coalesce(F.col(lang_col), found["lang_pred"])).drop(name)
