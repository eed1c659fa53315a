"""Language identification by mixture inference.

A text is taken as a mixture of languages. The model holds smoothed likelihoods of hashed letter n-grams (runs of
one to three letters, word edges count) per language. For each text expectation-maximisation estimates the proportions
of the languages from the likelihoods of its n-grams; then among the nested sets of the most probable languages the one with
the best penalised likelihood is kept, and the proportions are estimated again inside it. Sets grow while a larger one can still win: no set
is likelier than all languages together at their best proportions, and how much likelier than the ones found those can be follows from
the gradient. The prediction is the language with the largest proportion (ties: first by name) and the score is that proportion.

Fit: n-gram counts of at most about ``PER_LANG`` labelled training texts per language, taken by a hash of the id; the counts are
summed by Spark, and only languages x buckets numbers reach the driver. Every language is learned; the model is broadcast, so more
than ``MAX_LANGS`` different values of lang, which no corpus of languages has, are refused by an error and not left out.

Nulls: a null text, and one without a letter, is ``und`` with score 0; a null lang or an empty table trains nothing; without any
training text all is ``und``. Repeated rows each get their row. Long texts are read whole, in chunks of bounded size. Other columns of
any name pass through.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import table

#: Bounds of the fit: labelled texts per language, and languages (a model of 2^BITS numbers each).
PER_LANG, MAX_LANGS = 1500, 2000
BITS = 13
#: Pseudo-count of each bucket, iterations, and penalty in nats per further language, times the log of the number of n-grams.
ALPHA, ROUNDS, PENALTY = 0.5, 12, 2.0
CHUNK = 1 << 20

_M = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D], dtype=np.uint32)
_LETTER = None


def _letters() -> np.ndarray:
    """Whether each code point is a letter."""
    global _LETTER
    if _LETTER is None:
        _LETTER = np.array([chr(c).isalpha() for c in range(0x110000)])
    return _LETTER


def ngrams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Bucket and text number of every n-gram of ``texts``: one to three code points that begin with a letter or a word
    edge and hold a letter; anything but letters is an edge."""
    sizes = np.array([len(t) for t in texts], dtype=np.int64)
    codes = np.frombuffer("\n".join(texts).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    # one edge more before and after
    letter = np.zeros(len(codes) + 3, dtype=bool)
    letter[1 : len(codes) + 1] = _letters()[codes]
    c = np.ones(len(codes) + 3, dtype=np.uint32)
    np.copyto(c[1 : len(codes) + 1], codes + np.uint32(2), where=letter[1 : len(codes) + 1])
    owner = np.repeat(np.arange(len(texts), dtype=np.int64), sizes + 1)[: len(codes)]
    owner = np.concatenate([[0], owner, [len(texts) - 1] * 2])
    one = c * _M[0]
    two = one[:-1] ^ (c[1:] * _M[1])
    three = two[:-1] ^ (c[2:] * _M[2])
    found, at = [], []
    for n, code, start in ((1, one, letter), (2, two, letter[:-1] | letter[1:]), (3, three, letter[1:-1])):
        pick = np.flatnonzero(start)
        h = code[pick]
        h = (h ^ (h >> np.uint32(15))) * np.uint32(0x2C1B3C6D + n * 2)
        found.append((h >> np.uint32(32 - BITS)).astype(np.int64))
        # an edge can lie between two texts: the n-gram is of the text of its letter
        at.append(owner[pick] if n == 1 else np.where(letter[pick], owner[pick], owner[pick + 1]) if n == 2 else owner[pick + 1])
    return np.concatenate(found), np.concatenate(at)


def counts(texts: list[str]) -> np.ndarray:
    """Texts x buckets counts."""
    bucket, owner = ngrams(texts)
    return np.bincount(owner << BITS | bucket, minlength=len(texts) << BITS).reshape(len(texts), 1 << BITS)


def pieces(text: str) -> list[str]:
    """A very long text in chunks that end at a blank where there is one; n-grams over other cuts count as at an edge."""
    out, at = [], 0
    while len(text) - at > CHUNK:
        end = text.rfind(" ", at, at + CHUNK) + 1 or at + CHUNK
        out.append(text[at:end])
        at = end
    return [*out, text[at:]]


def fit(docs: DataFrame, per_lang: int = PER_LANG, max_langs: int = MAX_LANGS) -> tuple[list[str], np.ndarray]:
    """Languages in order of name, and buckets x languages likelihoods. ``docs`` has text, lang and doc_id and holds only rows to learn from."""
    rows = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull()).select("doc_id", "lang", "text", F.crc32(F.concat(F.lit("fit"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))).alias("draw"))
    many = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).limit(max_langs + 1).collect()}
    if len(many) > max_langs:
        raise ValueError(f"more than {max_langs} languages")
    if not many:
        return [], np.zeros((1 << BITS, 0))
    langs = sorted(many)
    below = F.create_map(*[x for k in langs for x in (F.lit(k), F.lit(int(min(1.0, per_lang / many[k]) * 2**32)).cast("long"))])
    sample = rows.where(F.col("lang").isin(langs)).where(F.col("draw") < below[F.col("lang")]).select("lang", "text")

    def tally(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = {}
        for pdf in batches:
            for lang, text in zip(pdf["lang"], pdf["text"], strict=True):
                for piece in pieces(text.lower()):
                    b, _ = ngrams([piece])
                    total[lang] = total.get(lang, 0) + np.bincount(b, minlength=1 << BITS)
        for lang, t in total.items():
            hit = np.flatnonzero(t)
            yield pd.DataFrame({"lang": lang, "bucket": hit, "n": t[hit]})

    seen = sample.mapInPandas(tally, "lang string, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
    table_ = np.full((1 << BITS, len(langs)), ALPHA)
    number = {k: i for i, k in enumerate(langs)}
    table_[seen["bucket"].to_numpy(), seen["lang"].map(number).to_numpy(dtype=np.int64)] += seen["n"].to_numpy()
    return langs, table_ / table_.sum(axis=0)


def _em(p: np.ndarray, n: np.ndarray, first: np.ndarray, owner: np.ndarray, total: np.ndarray, allowed: np.ndarray, rounds: int) -> tuple[np.ndarray, np.ndarray]:
    """Proportions of each text, their log likelihood, and a number that no proportions of the ``allowed`` languages (texts x languages)
    exceed. p: likelihoods of its entries, n: their counts. The log likelihood is concave, so its gradient bounds what is left to gain."""
    pi = allowed / allowed.sum(axis=1, keepdims=True)
    for _ in range(rounds):
        mix = p * pi[owner]
        mix *= (n / mix.sum(axis=1))[:, None]
        pi = np.add.reduceat(mix, first, axis=0) / total[:, None]
    mix = np.einsum("ij,ij->i", p, pi[owner])
    like = np.add.reduceat(n * np.log(mix), first)
    slope = np.add.reduceat(p * (n / mix)[:, None], first, axis=0)
    return pi, like, like + np.maximum(0.0, np.where(allowed > 0, slope, 0.0).max(axis=1) - total)


def infer(tally: np.ndarray, like: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Proportions (texts x languages) and number of languages chosen, for counts of texts that all have an n-gram."""
    owner, bucket = np.nonzero(tally)
    n = tally[owner, bucket].astype(float)
    first = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
    total = np.add.reduceat(n, first)
    p = like[bucket]
    texts, langs = len(first), like.shape[1]
    single = np.add.reduceat(n[:, None] * np.log(p), first, axis=0)
    best = single.argmax(axis=1)
    out = np.zeros((texts, langs))
    out[np.arange(texts), best] = 1
    size, score = np.ones(texts, dtype=np.int64), single.max(axis=1)
    if langs == 1:
        return out, size
    cost = PENALTY * np.log(total + 1)
    # no set of languages is likelier than all of them together: texts that gain too little from all keep one
    pi, _, most = _em(p, n, first, owner, total, np.ones((texts, langs)), ROUNDS)
    order = np.argsort(-pi, axis=1, kind="stable")
    k = 2
    while k <= langs:
        open_ = np.flatnonzero(most - (k - 1) * cost > score)
        if not len(open_):
            break
        inside = np.isin(owner, open_)
        o = np.searchsorted(open_, owner[inside])
        allowed = np.zeros((len(open_), langs))
        np.put_along_axis(allowed, order[open_, :k], 1.0, axis=1)
        pk, ll, _ = _em(p[inside], n[inside], np.flatnonzero(np.r_[True, o[1:] != o[:-1]]), o, total[open_], allowed, ROUNDS)
        gain = ll - (k - 1) * cost[open_]
        better = gain > score[open_]
        rows = open_[better]
        out[rows], size[rows], score[rows] = pk[better], k, gain[better]
        k += 1
    return out, size


def predict(docs: DataFrame, langs: list[str], like: np.ndarray, keep_text: bool = False) -> DataFrame:
    """row (struct of the document, its text only if ``keep_text``), lang_pred, score, langs (names of the chosen set, most first)."""
    sent = docs.sparkSession.sparkContext.broadcast((langs, like))  # MAX_LANGS x 2^BITS numbers at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, probs = sent.value
        for batch in batches:
            texts = batch.column("text").to_pylist()
            pred, score, chosen = np.full(len(texts), "und", dtype=object), np.zeros(len(texts)), np.full(len(texts), "", dtype=object)
            for rows, tally in _tallies(texts) if names else ():
                has = tally.any(axis=1)
                if not has.any():
                    continue
                pi, size = infer(tally[has], probs)
                at = np.asarray(rows)[has]
                top = pi.argmax(axis=1)
                score[at] = np.minimum(pi[np.arange(len(at)), top], 1.0)
                pred[at] = np.array(names, dtype=object)[top]
                order = np.argsort(-pi, axis=1, kind="stable")
                chosen[at] = [",".join(names[j] for j in o[:s]) for o, s in zip(order, size, strict=True)]
            new = [pa.array(pred, pa.string()), pa.array(score, pa.float64()), pa.array(chosen, pa.string())]
            yield pa.RecordBatch.from_arrays([batch.column("row"), *new], names=["row", "lang_pred", "score", "langs"])

    # the document travels as one struct, so that its columns can have any names and types; Arrow passes it on untouched
    boxed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns if keep_text or c != "text"]).alias("row"), F.col("text"))
    return boxed.mapInArrow(run, f"row {boxed.schema['row'].dataType.simpleString()}, lang_pred string, score double, langs string")


def _tallies(texts: list) -> Iterator[tuple[list[int], np.ndarray]]:
    """Row numbers and counts of texts, some hundred thousand letters at a time."""
    rows, held, size = [], [], 0
    for i, text in enumerate(texts):
        if not isinstance(text, str) or not text:
            continue
        text = text.lower()
        if len(text) > CHUNK:
            yield [i], sum(counts([x]) for x in pieces(text))
            continue
        rows.append(i)
        held.append(text)
        size += len(text)
        if size > CHUNK // 4 or len(rows) == 64:
            yield rows, counts(held)
            rows, held, size = [], [], 0
    if rows:
        yield rows, counts(held)


def held_out(doc_id):
    """crc32 of the id as text, modulo 5, is 0. A null id counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % 5 == 0


def op2_mixture_langid(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    langs, like = fit(docs.where(~held_out(F.col("doc_id"))))
    out = predict(docs.select("doc_id", "text"), langs, like)
    return out.select(F.col("row.doc_id").alias("doc_id"), held_out(F.col("row.doc_id")).alias("held_out"), "lang_pred", "score", "langs")
