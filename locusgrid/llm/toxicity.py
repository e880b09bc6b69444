"""Toxicity: a convolutional text classifier, trained in numpy.

A word is embedded as the sum of hashed vectors: of itself and of its beginnings, so unseen forms of a
known stem are near it. Filters over one, two and three words pass a rectifier and the maximum over the
whole text; a logistic layer reads the maxima. Embeddings start from the smoothed log-odds of their
bucket in the training rows, everything is then trained with Adam through the maxima.

The logit is calibrated by language: rows that training hasn't seen give each language a threshold,
which becomes score 0.5. The language is guessed from the words of the text alone. Labels are read from
training rows only, a bounded sample of ``TRAIN_ROWS`` whole texts of each class.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import count, repeat

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .positional import WORD_BYTES

TRAIN_ROWS = 3000
#: Characters on average of the labelled texts that are learnt from; with ``TRAIN_ROWS`` the bound of what the driver holds.
TRAIN_CHARS = 20_000
BUCKETS = 1 << 17
DIM = 8
FILTERS = 8
WIDTHS = (1, 2, 3)
PAD = max(WIDTHS) - 1
CHUNK_TOKENS = 150_000
EPOCHS = 8
# Common words by language.
COMMON = {
    "en": "the of and to in is it that for was on with as at by this from are an or",
    "de": "der die das und ist in den von zu mit im auf ein eine einen dem des nicht sich als",
    "fr": "le la les de des et en un une du est que qui dans pour pas sur au par ce",
    "es": "el la los las de que y en un una es por con para del se no al lo su",
}
LANGUAGES = tuple(COMMON)


def words(text: str | None) -> list[bytes]:
    """Lower-cased runs of letters and digits, in UTF-8."""
    return (text or "").lower().encode(errors="replace").translate(WORD_BYTES).split()


_COMMON: dict[bytes, int] = defaultdict(int)
for _n, _list in enumerate(COMMON.values()):
    for _word in _list.split():
        _COMMON[_word.encode()] |= 1 << _n


def beginning(word: bytes, n: int) -> bytes:
    """The first ``n`` characters; nothing of a shorter word."""
    if word.isascii():
        return word[:n] if len(word) >= n else b""
    spelled = word.decode(errors="replace")
    return spelled[:n].encode() if len(spelled) >= n else b""


def buckets(parts: list[bytes], salt: int) -> np.ndarray:
    hashed = np.fromiter(map(zlib.crc32, parts, repeat(salt)), np.int64, len(parts))
    return np.where(np.fromiter(map(len, parts), np.int64, len(parts)) > 0, 1 + hashed % (BUCKETS - 1), 0)


def features(vocabulary: list[bytes]) -> np.ndarray:
    """(words, 4): the buckets of a word and of its first four and five letters (bucket 0 is empty),
    and the languages that it is common in, as bits."""
    common = np.fromiter((_COMMON.get(w, 0) for w in vocabulary), np.int64, len(vocabulary))
    return np.stack([buckets(vocabulary, 0), *(buckets([beginning(w, n) for w in vocabulary], n) for n in (4, 5)),
                     common], axis=1).astype(np.int32)


@dataclass
class Chunk:
    """Some texts as numbers of their distinct words; each text is followed by PAD empty words (number
    0), an empty text has one more."""

    tokens: np.ndarray
    begins: np.ndarray
    lengths: np.ndarray
    features: np.ndarray

    @classmethod
    def of(cls, texts: list[list[bytes]]) -> Chunk:
        numbers = defaultdict(count(1).__next__, {b" ": 0})
        pad, tokens, lengths = [b" "] * PAD, [], []
        for found in texts:
            tokens += found or pad[:1]
            tokens += pad
            lengths.append(max(1, len(found)))
        ids = np.fromiter(map(numbers.__getitem__, tokens), np.int32, len(tokens))
        lengths = np.asarray(lengths, np.int64)
        begins = np.zeros(len(texts), np.int64)
        begins[1:] = np.cumsum(lengths[:-1] + PAD)
        table = np.zeros((len(numbers), 4), np.int32)
        table[1:] = features(list(numbers)[1:])
        return cls(ids, begins, lengths, table)

    def languages(self) -> np.ndarray:
        """The number of the language with most common words in each text; the first of equal ones."""
        votes = np.stack([np.add.reduceat((self.features[:, 3] >> i & 1)[self.tokens], self.begins)
                          for i in range(len(LANGUAGES))], axis=1)
        return votes.argmax(axis=1)


def chunks(texts: Iterable[str | None], most: int = CHUNK_TOKENS) -> Iterator[Chunk]:
    held, size = [], 0
    for text in texts:
        found = words(text)
        held.append(found)
        size += len(found) + PAD + 1
        if size >= most:
            yield Chunk.of(held)
            held, size = [], 0
    if held:
        yield Chunk.of(held)


class Network:
    """The parameters and what they make of a chunk."""

    def __init__(self, seed: int = 7):
        r = np.random.default_rng(seed)
        self.p = {"E": (r.normal(size=(BUCKETS, DIM)) * 0.02).astype(np.float32)}
        for w in WIDTHS:
            self.p[f"W{w}"] = (r.normal(size=(w, DIM, FILTERS)) * 0.3).astype(np.float32)
            self.p[f"W{w}"][:, 0, : FILTERS // 2] = np.abs(self.p[f"W{w}"][:, 0, : FILTERS // 2]) + 0.5 / w
            self.p[f"b{w}"] = np.full(FILTERS, -0.5, np.float32)
        self.p["out"] = np.full(FILTERS * len(WIDTHS), 0.2, np.float32)
        self.p["bias"] = np.array([-1.0], np.float32)
        self.p["E"][0] = 0

    def embed(self, table: np.ndarray) -> np.ndarray:
        e = self.p["E"]
        return e[table[:, 0]] + e[table[:, 1]] + e[table[:, 2]]

    def maxima(self, chunk: Chunk, where: bool = False):
        """(texts, filters) after rectifier and maximum; with ``where`` also the positions of the maxima."""
        vectors = self.embed(chunk.features)
        n = len(chunk.tokens)
        inner = np.ones(n, bool)
        for k in range(PAD):
            inner[chunk.begins + chunk.lengths + k] = False
        outer = np.flatnonzero(~inner)
        values, places = [], []
        for w in WIDTHS:
            conv = np.zeros((n, FILTERS), np.float32)
            for k in range(w):
                conv[: n - k] += (vectors @ self.p[f"W{w}"][k])[chunk.tokens[k:]]
            conv += self.p[f"b{w}"]
            conv[outer] = -np.inf
            top = np.maximum.reduceat(conv, chunk.begins, axis=0)
            values.append(np.maximum(top, 0))
            if where:
                places.append(np.stack([b + conv[b:b + m].argmax(axis=0)
                                        for b, m in zip(chunk.begins, chunk.lengths)]))
        return (np.hstack(values), places) if where else np.hstack(values)

    def logits(self, chunk: Chunk) -> np.ndarray:
        return self.maxima(chunk) @ self.p["out"] + self.p["bias"][0]


def log_odds(parts: list[tuple[Chunk, np.ndarray]], smooth: float = 3.0) -> np.ndarray:
    """The log-odds of each bucket: in how many toxic and other texts it occurs, smoothed."""
    counts = np.zeros((2, BUCKETS))
    sizes = np.zeros(2)
    for chunk, labels in parts:
        for b, m, y in zip(chunk.begins, chunk.lengths, labels):
            own = np.unique(chunk.features[np.unique(chunk.tokens[b:b + m]), :3])
            counts[int(y), own] += 1
            sizes[int(y)] += 1
    rate = (counts + smooth) / (sizes[:, None] + 2 * smooth)
    out = np.log(rate[1] / rate[0]) - np.log((smooth / (sizes[1] + 2 * smooth)) / (smooth / (sizes[0] + 2 * smooth)))
    out[0] = 0
    return out


def train(texts: list[str | None], labels: np.ndarray, epochs: int = EPOCHS, seed: int = 7) -> Network:
    """A network fitted to the rows; with one class only, or none, it stays as it starts."""
    net, r = Network(seed), np.random.default_rng(seed)
    if len(set(labels.tolist())) < 2:
        return net
    order = r.permutation(len(texts))
    batches = [(Chunk.of([words(texts[i]) for i in part]), labels[part].astype(np.float32))
               for part in np.array_split(order, max(1, len(order) // 48))]
    net.p["E"][:, 0] = np.clip(log_odds(batches), -1, 4).astype(np.float32)
    weight = np.float32(max(1.0, (labels == 0).sum() / max(1, (labels == 1).sum())))
    moments = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in net.p.items() if k != "E"}
    squares = np.zeros(BUCKETS, np.float32)
    step = 0
    for epoch in range(epochs):
        for n in r.permutation(len(batches)):
            chunk, y = batches[n]
            h, places = net.maxima(chunk, where=True)
            z = h @ net.p["out"] + net.p["bias"][0]
            g = (1 / (1 + np.exp(-z)) - y) * np.where(y > 0, weight, 1) / len(y)
            grads = {"out": h.T @ g + 1e-4 * net.p["out"], "bias": np.array([g.sum()], np.float32)}
            down = np.outer(g, net.p["out"]) * (h > 0)
            vectors = net.embed(chunk.features)
            at, moves = [], []
            for j, w in enumerate(WIDTHS):
                d = down[:, j * FILTERS:(j + 1) * FILTERS]
                kernel = net.p[f"W{w}"]
                gk = np.zeros_like(kernel)
                for k in range(w):
                    token = chunk.tokens[places[j] + k]
                    gk[k] = np.einsum("nfd,nf->df", vectors[token], d)
                    at.append(token.ravel())
                    moves.append((d[:, :, None] * kernel[k].T[None]).reshape(-1, DIM))
                grads[f"W{w}"], grads[f"b{w}"] = gk, d.sum(axis=0)
            step += 1
            for k, v in grads.items():
                m, s = moments[k]
                m += 0.1 * (v - m)
                s += 0.001 * (v * v - s)
                net.p[k] -= 0.01 * (m / (1 - 0.9 ** step)) / (np.sqrt(s / (1 - 0.999 ** step)) + 1e-8)
            token, move = np.concatenate(at), np.concatenate(moves)
            for c in range(3):  # the embeddings: a step by bucket, scaled by what the bucket has moved
                bucket = chunk.features[token, c]
                used = np.unique(bucket)
                total = np.zeros((len(used), DIM), np.float32)
                np.add.at(total, np.searchsorted(used, bucket), move)
                squares[used] += (total * total).mean(axis=1)
                net.p["E"][used] -= 0.05 * total / (np.sqrt(squares[used])[:, None] + 1e-6)
            net.p["E"][0] = 0
    return net


def threshold(z: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None) -> float:
    """The cut that errs least, in the middle of the widest such interval; an error counts ``weight``."""
    order = np.argsort(z)
    z, y = z[order], y[order]
    w = np.ones(len(z)) if weight is None else weight[order]
    errors = np.concatenate([[0], np.cumsum(w * y)]) + np.concatenate([np.cumsum((w * (1 - y))[::-1])[::-1], [0]])
    errors = np.round(errors, 6)
    edges = np.concatenate([[z[0] - 2], z, [z[-1] + 2]])
    best = np.flatnonzero(errors == errors.min())
    k = best[np.argmax(edges[best + 1] - edges[best])]
    return float((edges[k] + edges[k + 1]) / 2)


@dataclass
class Model:
    net: Network
    cuts: np.ndarray  # by language
    slope: float

    def scores(self, texts: Iterable[str | None]) -> np.ndarray:
        out = [1 / (1 + np.exp(-np.clip(self.slope * (self.net.logits(c) - self.cuts[c.languages()]), -40, 40)))
               for c in chunks(texts)]
        return np.concatenate(out).astype(np.float64) if out else np.zeros(0)


def fit(texts: list[str | None], labels: np.ndarray, folds: np.ndarray, least: int = 20,
        weights: np.ndarray | None = None) -> Model:
    """Train on folds other than 1, take the cuts from fold 1, where a row's errors count ``weights``. A language with fewer than ``least`` rows
    of either class there takes the cut of all. Without both classes everything scores below 0.5."""
    tune = folds == 1
    if len(set(labels[tune].tolist())) < 2 or len(set(labels[~tune].tolist())) < 2:
        tune = np.zeros(len(labels), bool)
    net = train([t for t, x in zip(texts, tune) if not x], labels[~tune])
    if len(set(labels.tolist())) < 2:
        return Model(net, np.full(len(LANGUAGES), 1e6), 1.0)
    use = np.flatnonzero(tune if tune.any() else ~tune)
    z, lang = [], []
    for chunk in chunks([texts[i] for i in use]):
        z.append(net.logits(chunk))
        lang.append(chunk.languages())
    z, lang, y = np.concatenate(z), np.concatenate(lang), labels[use]
    w = np.ones(len(y)) if weights is None else weights[use]
    cuts = np.full(len(LANGUAGES), threshold(z, y, w))
    for i in range(len(LANGUAGES)):
        own = lang == i
        if min((own & (y == 0)).sum(), (own & (y == 1)).sum()) >= least:
            cuts[i] = threshold(z[own], y[own], w[own])
    return Model(net, cuts, 1.0)


def fold(doc_id) -> F.Column:
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5


def training_rows(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS, id_col: str = "doc_id",
                  text_col: str = "text", label_col: str = "toxic", whole: bool = False) -> pd.DataFrame:
    """At most ``rows`` labelled rows of each class outside fold 0, in the order of a hash. ``weight``: how many
    labelled rows of its class a row stands for. Rows with a null id or label are no labels; an id with both labels
    is toxic. ``learn`` asks for ``whole`` texts: of each class those rows that together hold at most ``rows`` times
    ``TRAIN_CHARS`` characters, counted before texts come to the driver. Otherwise texts are previews, cut there to
    ``TRAIN_CHARS``."""
    known = (labels.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("int").alias("label"))
             .filter("label in (0, 1)").filter(fold("id") != 0).groupBy("id").agg(F.max("label").alias("label")))
    sizes = {r["label"]: r["n"] for r in known.groupBy("label").agg(F.count("*").alias("n")).collect()}
    picked = None
    for y in (0, 1):
        part = known.filter(F.col("label") == y).orderBy(F.xxhash64("id"), "id").limit(rows)
        picked = part if picked is None else picked.unionByName(part)
    text = F.col(text_col) if whole else F.substring(text_col, 1, TRAIN_CHARS)
    texts = docs.select(F.col(id_col).cast("long").alias("id"), text.alias("text"))
    # Of rows that repeat an id the smallest text stands for it, so no more rows come than there are labels.
    found = texts.join(F.broadcast(picked), "id").groupBy("id", "label").agg(F.min("text").alias("text"))
    if whole:
        fits = within(found.select("id", "label", F.xxhash64("id").alias("h"), F.coalesce(F.length("text"), F.lit(0)).alias("n")).collect(),
                      rows * TRAIN_CHARS)
        found = found.join(F.broadcast(fixed_ids(docs, fits)), "id") if fits is not None else found
    got = found.withColumn("fold", fold("id")).toPandas().sort_values("id").reset_index(drop=True)
    taken = got["label"].value_counts() if whole else {y: rows for y in sizes}
    got["weight"] = got["label"].map({y: max(1.0, n / taken[y]) for y, n in sizes.items() if y in taken})
    return got.iloc[np.random.default_rng(5).permutation(len(got))]


def within(lengths: list, most: int) -> list[int] | None:
    """Ids of the rows (id, label, h, n), in the order of ``h``, whose ``n`` add up to at most ``most`` in each label;
    a row that doesn't fit is passed over. None if all fit."""
    held, ids = [0, 0], []
    for r in sorted(lengths, key=lambda r: (r["h"], r["id"])):
        if held[r["label"]] + r["n"] <= most:
            held[r["label"]] += r["n"]
            ids.append(r["id"])
    return ids if len(ids) < len(lengths) else None


def fixed_ids(docs: DataFrame, ids: list[int]) -> DataFrame:
    return docs.sparkSession.createDataFrame([(i,) for i in ids], "id long")


def learn(docs: DataFrame, labels: DataFrame, **columns) -> Model:
    got = training_rows(docs, labels, whole=True, **columns)
    return fit(list(got["text"]), got["label"].to_numpy(), got["fold"].to_numpy(), weights=got["weight"].to_numpy())


def score_column(docs: DataFrame, model: Model, text_col: str = "text") -> F.Column:
    held = docs.sparkSession.sparkContext.broadcast(model)

    # Texts are taken from the Arrow batch one at a time, so only a chunk's words are Python objects.
    @F.arrow_udf("double")
    def scored(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for part in parts:
            yield pa.array(held.value.scores(x.as_py() for x in part), pa.float64())

    return scored(F.col(text_col))


def score(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, score, predicted) for each row of ``docs``.

    ``held_out`` is the fold labels aren't learnt from (null doc_ids: false). Null and empty texts have
    the score of no words. A repeated row is scored again. Other columns are ignored. Without labels of
    both classes every score is under 0.5. An empty table gives no rows.
    """
    model = learn(docs, labels, id_col=id_col, text_col=text_col)
    return docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.coalesce(fold(id_col) == 0, F.lit(False)).alias("held_out"),
        score_column(docs, model, text_col).alias("score"),
    ).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def keep_civil(docs: DataFrame, labels: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` without those scored 0.5 or more; the columns stay."""
    model = learn(docs, labels, text_col=text_col)
    return docs.filter(score_column(docs, model, text_col) < 0.5)
