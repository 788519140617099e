"""Language identification with unigram pieces, summed over all segmentations.

Words are runs of letters (a-z after lower-casing, and bytes from 0x80). Every language
has a probability for each piece of a fixed public vocabulary of byte strings, all
single bytes among them. A word's probability in a language is the sum over all ways
of cutting it into pieces, by the forward algorithm; a text's is the product over its
words. Piece probabilities are fitted by expectation-maximisation on word counts.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from habitspark.llm import words

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
LONGEST = 7  # bytes of a piece; a piece and its length then fit one 64-bit key
KNOWN_WORDS = 1_000_000

_LETTER = np.zeros(256, bool)
_LETTER[0x61:0x7B] = True
_LETTER[0x41:0x5B] = True
_LETTER[0x80:] = True
_BETWEEN = ~_LETTER


def load_pieces(path: str) -> np.ndarray:
    """Sorted keys of the letter pieces of a vocabulary file (base64 text and rank per line), in lower case."""
    found = {bytes([b]) for b in np.flatnonzero(_LETTER).tolist()}
    with open(path, "rb") as lines:
        for line in lines:
            piece = base64.b64decode(line.split()[0]).lstrip(b" ").lower()
            if 0 < len(piece) <= LONGEST and _LETTER[np.frombuffer(piece, np.uint8)].all():
                found.add(piece)
    return np.sort(np.array([int.from_bytes(p, "big") | len(p) << 56 for p in found], np.uint64))


def _piece_ids(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """[length, byte]: index of the piece of that length that ends at the byte; len(keys) if there is none."""
    out = np.full((LONGEST, len(data)), len(keys), np.int32)
    inside = np.arange(len(data)) - np.repeat(starts, lengths)
    key = np.zeros(len(data), np.uint64)
    for size in range(1, min(LONGEST, len(data)) + 1):
        back = size - 1
        key[back:] |= data[: len(data) - back].astype(np.uint64) << np.uint64(8 * back)
        at = np.flatnonzero(inside >= back)
        want = key[at] | np.uint64(size << 56)
        place = np.minimum(np.searchsorted(keys, want), len(keys) - 1)
        hit = keys[place] == want
        out[back, at[hit]] = place[hit]
    return out


def word_scores(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray, keys: np.ndarray, prob: np.ndarray) -> np.ndarray:
    """Log probability of every word (adjacent in ``data``) in every language, over all segmentations."""
    ids = _piece_ids(data, starts, lengths, keys)
    order = np.argsort(-lengths, kind="stable")
    starts, lengths = starts[order], lengths[order]
    langs = prob.shape[1]
    recent = np.zeros((LONGEST + 1, len(starts), langs))
    recent[0] = 1.0  # the empty beginning
    scale = np.zeros((len(starts), langs))
    result = np.zeros((len(starts), langs))
    active = len(starts)
    for i in range(int(lengths[0]) if len(lengths) else 0):
        active = int(np.searchsorted(-lengths[:active], -i, "left"))
        at = starts[:active] + i
        total = np.zeros((active, langs))
        for size in range(1, min(LONGEST, i + 1) + 1):
            total += recent[(i + 1 - size) % (LONGEST + 1), :active] * prob[ids[size - 1, at]]
        if i % 8 == 7:  # keep long words within the range of doubles
            top = np.maximum(total, 1e-300)
            scale[:active] += np.log(top)
            recent[:, :active] /= top
            total = total / top
        recent[(i + 1) % (LONGEST + 1), :active] = total
        done = np.flatnonzero(lengths[:active] == i + 1)
        result[done] = np.log(np.maximum(total[done], 1e-300)) + scale[done]
    out = np.empty_like(result)
    out[order] = result
    return out


def fit_pieces(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray, counts: np.ndarray, keys: np.ndarray, rounds: int = 3) -> np.ndarray:
    """Piece probabilities [piece, language] from word counts [word, language]; the last row is zero."""
    ids = _piece_ids(data, starts, lengths, keys)
    size = ((keys >> np.uint64(56)).astype(np.float64) - 1)[:, None]
    prob = np.repeat(np.exp(-1.5 * np.abs(size - 2)), counts.shape[1], axis=1)
    prob = np.vstack([prob / prob.sum(axis=0), np.zeros((1, counts.shape[1]))])
    inside = np.arange(len(data)) - np.repeat(starts, lengths)
    at_step = [np.flatnonzero(inside == i) for i in range(int(lengths.max()))]
    word_of = np.repeat(np.arange(len(starts)), lengths)
    left = lengths[word_of] - 1 - inside  # bytes after this one
    for _ in range(rounds):
        ahead = np.zeros((len(data), counts.shape[1]))
        behind = np.zeros((len(data), counts.shape[1]))  # of the rest after the byte
        for i, at in enumerate(at_step):
            for s in range(1, min(LONGEST, i + 1) + 1):
                ahead[at] += prob[ids[s - 1, at]] * (ahead[at - s] if s <= i else 1.0)
        behind[left == 0] = 1.0
        for i in range(len(at_step) - 2, -1, -1):
            at = at_step[i]
            for s in range(1, LONGEST + 1):
                on = at[left[at] >= s]
                behind[on] += prob[ids[s - 1, on + s]] * behind[on + s]
        whole = np.maximum(ahead[starts + lengths - 1], 1e-300)[word_of]
        share = counts[word_of] * behind / whole
        expected = np.zeros_like(prob)
        for s in range(1, LONGEST + 1):
            on = np.flatnonzero(inside >= s - 1)
            before = np.where((inside[on] >= s)[:, None], ahead[on - s], 1.0)
            np.add.at(expected, ids[s - 1, on], before * share[on])
        expected *= prob
        expected[-1] = 0
        body = expected[:-1] + 0.05
        prob = np.vstack([body / body.sum(axis=0), np.zeros((1, counts.shape[1]))])
    return prob


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        langs = batch.column(0).to_pylist()
        lang, word, count = [], [], []
        for at, w in words.slices(batch.column(1), between=_BETWEEN):
            h = w.hashes()
            text = np.searchsorted(w.first, np.arange(len(h)), "right") - 1
            names = np.array([str(x) for x in langs[at : at + len(w.first) - 1]], object)
            for name in set(names.tolist()):
                mine = np.flatnonzero((names == name)[text])
                _, first, n = np.unique(h[mine], return_index=True, return_counts=True)
                for k, c in zip(mine[first].tolist(), n.tolist()):
                    if w.ends[k] - w.starts[k] <= 32:
                        lang.append(name)
                        word.append(w.data[w.starts[k] : w.ends[k]].tobytes())
                        count.append(c)
        yield pa.RecordBatch.from_arrays([pa.array(lang, pa.string()), pa.array(word, pa.binary()), pa.array(count, pa.int64())], ["lang", "word", "count"])


def fit(
    docs: DataFrame, training: Column, vocabulary: str = VOCABULARY, sample_rows: int = 500, sample_words: int = 20_000, lang: str = "lang", text: str = "text", doc_id: str = "doc_id"
) -> dict:
    """Piece probabilities per language.

    Fitted on at most ``sample_rows`` training rows per language (smallest hash of the id)
    and their ``sample_words`` most frequent words of at most 32 bytes; rows without text or language are no
    training rows.
    """
    rows = docs.filter(training).select(F.col(lang).cast("string").alias("lang"), F.col(text).alias("text"), F.xxhash64(F.col(doc_id)).alias("draw"))
    rows = rows.filter("lang is not null and text is not null")
    pick = Window.partitionBy("lang").orderBy("draw", "text")
    # the hash alone decides first, so that texts are not sorted
    chosen = docs.select(F.col(lang).cast("string").alias("lang"), F.xxhash64(F.col(doc_id)).alias("draw"), F.col(text).isNotNull().alias("ok"), training.alias("t"))
    chosen = chosen.filter("lang is not null and ok and t").withColumn("k", F.row_number().over(Window.partitionBy("lang").orderBy("draw"))).filter(F.col("k") <= sample_rows)
    sample = rows.join(F.broadcast(chosen.select("lang", "draw").distinct()), ["lang", "draw"], "left_semi")
    counts = sample.select("lang", "text").mapInArrow(_counted, "lang string, word binary, count long").groupBy("lang", "word").agg(F.sum("count").alias("count"))
    best = Window.partitionBy("lang").orderBy(F.desc("count"), "word")
    top = counts.withColumn("k", F.row_number().over(best)).filter(F.col("k") <= sample_words).drop("k").toPandas()
    top["word"] = [bytes(w) for w in top["word"]]
    names = sorted(set(top["lang"]))
    keys = load_pieces(vocabulary)
    if not names:
        return {"names": [], "keys": keys, "prob": np.zeros((len(keys) + 1, 0))}
    table = top.pivot_table(index="word", columns="lang", values="count", fill_value=0, aggfunc="sum")[names].sort_index()
    spelled = [bytes(w) for w in table.index]
    lengths = np.array([len(w) for w in spelled])
    data = np.frombuffer(b"".join(spelled), np.uint8)
    prob = fit_pieces(data, np.cumsum(lengths) - lengths, lengths, table.to_numpy(float), keys)
    return {"names": names, "keys": keys, "prob": prob}


def _scored(model: dict):
    names, keys, prob = model["names"], model["keys"], model["prob"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = np.zeros(0, np.uint64)  # hashes of words scored before, sorted
        scores = np.zeros((0, len(names)))
        for batch in batches:
            column = batch.column(1)
            pred: list = []
            sure: list = []
            for at, w in words.slices(column, between=_BETWEEN):
                n = len(w.first) - 1
                if not names or not len(w.starts):
                    pred += ["und"] * n
                    sure += [0.0] * n
                    continue
                uniq, first, back = np.unique(w.hashes(), return_index=True, return_inverse=True)
                place = np.minimum(np.searchsorted(known, uniq), max(len(known) - 1, 0))
                seen = known[place] == uniq if len(known) else np.zeros(len(uniq), bool)
                mine = np.empty((len(uniq), len(names)))
                if seen.any():
                    mine[seen] = scores[place[seen]]
                fresh = np.flatnonzero(~seen)
                for part in np.array_split(fresh, len(fresh) // 50_000 + 1):
                    if not len(part):
                        continue
                    s, e = w.starts[first[part]], w.ends[first[part]]
                    lengths = e - s
                    begin = np.cumsum(lengths) - lengths
                    take = np.arange(lengths.sum()) + np.repeat(s - begin, lengths)
                    mine[part] = word_scores(w.data[take], begin, lengths, keys, prob)
                if len(known) > KNOWN_WORDS:
                    known, scores = uniq, mine
                else:
                    known = np.concatenate([known, uniq[fresh]])
                    order = np.argsort(known)
                    known, scores = known[order], np.concatenate([scores, mine[fresh]])[order]
                text = np.searchsorted(w.first, np.arange(len(back)), "right") - 1
                total = np.stack([np.bincount(text, weights=mine[back, k], minlength=n) for k in range(len(names))], axis=1)
                best = total.argmax(axis=1)
                share = 1 / np.exp(total - total.max(axis=1, keepdims=True)).sum(axis=1)
                ascii_letter = (w.data >= 0x61) & (w.data <= 0x7A)
                plain = np.add.reduceat(np.r_[ascii_letter, False].astype(np.int64), np.minimum(w.offsets[:-1], len(w.data)))
                plain[w.offsets[1:] == w.offsets[:-1]] = 0
                for k in range(n):
                    # bytes from 0x80 may be signs: look at the characters where there is no plain letter
                    letter = plain[k] > 0 or (w.first[k + 1] > w.first[k] and any(c.isalpha() for c in column[at + k].as_py()))
                    pred.append(names[best[k]] if letter else "und")
                    sure.append(float(share[k]) if letter else 0.0)
            extra = range(2, batch.num_columns)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(pred, pa.string()), pa.array(sure, pa.float64()), *[batch.column(i) for i in extra]],
                ["doc_id", "lang_pred", "score", *[batch.schema.names[i] for i in extra]],
            )

    return run


def identify(docs: DataFrame, model: dict, doc_id: str = "doc_id", text: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per input row: ``doc_id``, ``lang_pred``, ``score`` and the columns ``keep``.

    ``score`` is the probability of the language given the whole text, all languages alike
    beforehand. A null text, one without a letter, or a model without languages gives ``und`` and 0. Ties
    go to the name that sorts first.
    """
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"), *[F.col(k).alias(f"_keep_{k}") for k in keep])
    kinds = "".join(f", `_keep_{k}` {docs.schema[k].dataType.simpleString()}" for k in keep)
    out = rows.mapInArrow(_scored(model), "doc_id long, lang_pred string, score double" + kinds)
    return out.select("doc_id", "lang_pred", "score", *[F.col(f"_keep_{k}").alias(k) for k in keep])
