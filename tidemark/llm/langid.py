"""Language identification by segmentation-marginalised unigrams over a fixed public vocabulary.

Each language has a probability for every piece of the vocabulary, fitted by expectation maximisation over all
segmentations of its training words. A word's likelihood is the sum, over all its segmentations into pieces, of the
product of the pieces' probabilities: the forward algorithm adds them up in one pass over the word's characters. A
text's log-likelihood is the sum over its words (runs of letters, lower-cased, behind a word-start mark), so each
distinct word of a batch is scored once.

Forward passes run for all words of a block and all languages at a time, position by position, with rescaling, so words
of any length are exact.

Defined results: a null text, or one without letters, is ``und`` with score 0; if there is nothing to learn from, all
are; ties go to the language that sorts first; repeated rows and null ids are kept (a null id is not learned from, and
has held_out false); rows with a null lang are scored, not learned; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fit_sample, fold, hashed_sample

#: Bound on the rows whose words are learned from.
TRAIN_ROWS = 3_000
HELD_OUT = (5, 0)
ROUNDS, ADDED, BLOCK = 3, 0.05, 40_000
MARK = "▁"
LETTERS = regex.compile(r"\p{L}+")
_MUL, _PHI, _BITS = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93), 18


def vocabulary(path: str | None = None) -> list[str]:
    """Lower-cased pieces of a sentencepiece model, sorted; by default the public tokenizers' 32,000-piece model."""
    import sentencepiece

    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("piece_bpe_32k.model")
    sp = sentencepiece.SentencePieceProcessor(model_file=str(path))
    kept = (i for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i)))
    return sorted({p for p in (sp.id_to_piece(i).lower() for i in kept) if re.fullmatch(f"{MARK}?[^\\W\\d_]+|{MARK}", p)})


class Lattice:
    """Finds the vocabulary's pieces in words, for all substrings of one length at once."""

    def __init__(self, pieces: list[str]):
        self.longest = max(map(len, pieces), default=1)
        hashes = np.array([self._hash(p) for p in pieces], np.uint64)
        assert len(np.unique(hashes)) == len(hashes), "two pieces share a hash"
        size = 1 << _BITS
        self.keys, self.ids, self.reach = np.zeros(size, np.uint64), np.full(size, -1, np.int32), 0
        for i, (h, s) in enumerate(zip(hashes, ((hashes * _PHI) >> np.uint64(64 - _BITS)).tolist())):
            step = 0
            while self.ids[(s + step) % size] >= 0:
                step += 1
            self.keys[(s + step) % size], self.ids[(s + step) % size] = h, i
            self.reach = max(self.reach, step)

    @staticmethod
    def _hash(piece: str) -> np.uint64:
        h = np.zeros(1, np.uint64)
        for c in piece:
            h = h * _MUL + np.uint64(ord(c) + 1)
        return h[0]

    def _find(self, h: np.ndarray) -> np.ndarray:
        slot = ((h * _PHI) >> np.uint64(64 - _BITS)).astype(np.int64)
        out, todo = np.full(len(h), -1, np.int32), np.arange(len(h))
        for step in range(self.reach + 1):
            s = (slot[todo] + step) & ((1 << _BITS) - 1)
            hit = (self.keys[s] == h[todo]) & (self.ids[s] >= 0)
            out[todo[hit]] = self.ids[s[hit]]
            todo = todo[~hit & (self.ids[s] >= 0)]
            if not len(todo):
                break
        return out

    def of(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
        """(offsets, lengths, ids by piece length) of marked words, laid end to end."""
        lengths = np.array([len(w) for w in words], np.int64)
        offsets = np.concatenate([[0], np.cumsum(lengths)])
        cp = np.frombuffer("".join(words).encode("utf-32-le", "replace"), np.uint32).astype(np.uint64) + np.uint64(1)
        left = np.repeat(offsets[1:], lengths) - np.arange(len(cp))  # characters to the word's end
        h, ids = np.zeros(len(cp), np.uint64), []
        for n in range(1, min(self.longest, int(lengths.max(initial=0))) + 1):
            h = h[: len(cp) - n + 1] * _MUL + cp[n - 1 :]
            found = np.full(len(cp), -1, np.int32)
            ok = np.flatnonzero(left[: len(h)] >= n)
            found[ok] = self._find(h[ok])
            ids.append(found)
        return offsets[:-1], lengths, ids


@dataclass
class Model:
    langs: list[str]
    pieces: list[str]
    p: np.ndarray  # (pieces + 2, languages): then the row of an unknown character, then the row of no piece
    _lattice: Lattice | None = None

    def lattice(self) -> Lattice:
        if self._lattice is None:
            self._lattice = Lattice(self.pieces)
        return self._lattice

    def __getstate__(self):
        return self.__dict__ | {"_lattice": None}

    def forward(self, offsets, lengths, ids, backward: bool = False):
        """Scaled sums over all segmentations of each prefix (suffix) of each word, and each word's log scale."""
        k, n = len(self.langs), len(lengths)
        cells = offsets + np.arange(n)  # a word of m characters has m + 1 cells
        a, scale = np.zeros((int(lengths.sum()) + n, k)), np.zeros(n)
        a[cells + (lengths if backward else 0)] = 1
        order = np.argsort(-lengths, kind="stable")
        count = np.searchsorted(-lengths[order], -np.arange(1, int(lengths.max(initial=0)) + 1), side="right")
        for step, active in enumerate(count.tolist(), 1):
            w = order[:active]
            to = cells[w] + (lengths[w] - step if backward else step)
            total = np.zeros((active, k))
            for size in range(1, min(step, len(ids)) + 1):
                at = offsets[w] + (lengths[w] - step if backward else step - size)
                i = ids[size - 1][at]
                if size == 1:
                    total += a[to + (1 if backward else -1)] * self.p[np.where(i < 0, len(self.pieces), i)]
                else:
                    hit = np.flatnonzero(i >= 0)
                    if len(hit):
                        total[hit] += a[to[hit] + (size if backward else -size)] * self.p[i[hit]]
            a[to] = total
            if step % 12 == 0:
                reach = [to + (d if backward else -d) for d in range(min(step, len(ids)) + 1)]
                top = total.max(1)
                top[top == 0] = 1
                for r in reach:
                    a[r] /= top[:, None]
                scale[w] += np.log(top)
        return a, cells, scale

    def word_scores(self, words: list[str]) -> np.ndarray:
        """(words, languages): log-likelihoods."""
        out = np.zeros((len(words), len(self.langs)))
        for at in range(0, len(words), BLOCK):
            offsets, lengths, ids = self.lattice().of([MARK + w for w in words[at : at + BLOCK]])
            a, cells, scale = self.forward(offsets, lengths, ids)
            out[at : at + BLOCK] = np.log(np.maximum(a[cells + lengths], 1e-300)) + scale[:, None]
        return out

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        seen: dict[str, int] = {}
        docs = [np.array([seen.setdefault(w, len(seen)) for w in words_of(t)], np.int64) for t in texts]
        names, scores = ["und"] * len(texts), np.zeros(len(texts))
        if self.langs and seen:
            by_word = self.word_scores(list(seen))
            for i, d in enumerate(docs):
                if len(d):
                    z = by_word[d].sum(0)
                    best = int(z.argmax())
                    names[i], scores[i] = self.langs[best], 1 / np.exp(z - z[best]).sum()
        return names, scores


def fit(found: list[tuple[str, str, int]], pieces: list[str]) -> Model:
    """found: (language, word, times). Expected piece counts start from all occurrences and are refined over all
    segmentations."""
    langs = sorted({lang for lang, _, _ in found})
    at = {lang: k for k, lang in enumerate(langs)}
    counts: dict[str, np.ndarray] = {}
    for lang, w, n in found:
        if w not in counts:
            counts[w] = np.zeros(len(langs))
        counts[w][at[lang]] += n
    model = Model(langs, pieces, np.ones((len(pieces) + 2, max(1, len(langs)))) / max(1, len(pieces)))
    words = sorted(counts)
    if not langs or not words:
        return Model([], pieces, model.p)
    for turn in range(ROUNDS + 1):
        n = np.zeros((len(pieces), len(langs)))
        for at in range(0, len(words), BLOCK):
            part = words[at : at + BLOCK]
            weight = np.array([counts[w] for w in part])
            offsets, lengths, ids = model.lattice().of([MARK + w for w in part])
            owner = np.repeat(np.arange(len(part)), lengths)
            if turn:
                a, cells, fs = model.forward(offsets, lengths, ids)
                b, _, bs = model.forward(offsets, lengths, ids, backward=True)
                total = np.log(np.maximum(a[cells + lengths], 1e-300)) + fs[:, None]
            for size, found in enumerate(ids, 1):
                pos = np.flatnonzero(found >= 0)
                i, w = found[pos], owner[pos]
                if turn:
                    cell = pos + w
                    scaled = np.exp(np.minimum(fs[w] + bs[w], 600)[:, None] - total[w])
                    share = np.clip(a[cell] * model.p[i] * b[cell + size] * scaled, 0, 1)
                else:
                    share = np.full((len(pos), len(langs)), float(size) / 8)
                for k in range(len(langs)):
                    n[:, k] += np.bincount(i, share[:, k] * weight[w, k], len(pieces))
        p = (n + ADDED) / (n.sum(0) + ADDED * len(pieces))
        unknown = ADDED / 10 / (n.sum(0) + ADDED * len(pieces))
        model = Model(langs, pieces, np.vstack([p, unknown, np.zeros(len(langs))]), model._lattice)
    return model


def words_of(text: str | None) -> list[str]:
    return LETTERS.findall((text or "").lower())


def train(docs: DataFrame, rows: int = TRAIN_ROWS, vocab: str | None = None) -> Model:
    """The model of a bounded sample: tasks count words, the driver gets (language, word, times)."""
    known = docs.select("doc_id").where(F.col("doc_id").isNotNull() & F.col("lang").isNotNull() & (fold("doc_id", HELD_OUT[0]) != HELD_OUT[1]))
    picked = hashed_sample(known.distinct(), "doc_id", rows, 13)
    sample = fit_sample(docs.where("lang is not null"), picked, ["lang"], 13)

    def run(batches):
        counts: Counter = Counter()
        for b in batches:
            for t, lang in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                counts.update((lang, w) for w in words_of(t))
        langs, words = zip(*counts) if counts else ((), ())
        yield pa.record_batch([pa.array(langs, pa.string()), pa.array(words, pa.string()), pa.array(counts.values(), pa.int64())], names=["lang", "word", "n"])

    found = sample.select("text", "lang").mapInArrow(run, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    got = found.toArrow()
    return fit(list(zip(*(got[c].to_pylist() for c in ("lang", "word", "n")))), vocabulary(vocab))


def identify(docs: DataFrame, rows: int = TRAIN_ROWS, vocab: str | None = None) -> DataFrame:
    """doc_id, held_out, lang_pred, score for every row of docs."""
    model = docs.sparkSession.sparkContext.broadcast(train(docs, rows, vocab))

    def run(batches):
        for b in batches:
            names, scores = model.value.predict(b.column(1).to_pylist())
            yield pa.record_batch([b.column(0), pa.array(names, pa.string()), pa.array(scores)], names=["doc_id", "lang_pred", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    found = docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, lang_pred string, score double")
    held = F.coalesce(fold("doc_id", HELD_OUT[0]) == HELD_OUT[1], F.lit(False))
    return found.select("doc_id", held.alias("held_out"), "lang_pred", "score")
