"""URL rules by Bloom filter cascades.

A rule is a host and the beginning of a path. A URL's keys are its host and the domains above it, each
with the beginnings of its path that have a rule's length. The universe holds the keys of all URLs of
the corpus. A cascade encodes the listed keys in a first Bloom filter, the unlisted keys of the universe
that it passes in a second one, the listed keys that pass that in a third, and so on until no key passes
wrongly. Over the universe membership is exact, and testing a URL needs no join: every task holds the
filters. There is one cascade for blocking and one for allowing rules.

The filters' size follows the rules (about log2(universe / rules) bits for each). Keys are dealt by hash to as many
cascades as it takes for none to list more than ``SHARD_RULES``; the universe is only ever a table.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from copy import copy
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_rows, stored

SHARD_RULES = 1_000_000
SHARD_SEED = 1 << 40
DEFAULT = "allow"


@dataclass(frozen=True)
class Rule:
    verdict: str  # allow or block
    host: str
    path: str

    @property
    def key(self) -> str:
        return self.host + self.path


class Bloom:
    """A set of keys as bits; the bits of a key come from two 64-bit hashes, others at each level."""

    def __init__(self, n: int, rate: float, level: int):
        self.seeds = (2 * level, 2 * level + 1)
        self.size = max(64, math.ceil(-n * math.log(rate) / math.log(2) ** 2))
        self.hashes = max(1, round(self.size / max(1, n) * math.log(2)))
        self.bits = np.zeros(self.size, bool)

    def places(self, keys: list[bytes]) -> np.ndarray:
        a = np.array([xxhash.xxh64_intdigest(k, self.seeds[0]) for k in keys], np.uint64)
        b = np.array([xxhash.xxh64_intdigest(k, self.seeds[1]) for k in keys], np.uint64) | np.uint64(1)
        steps = np.arange(self.hashes, dtype=np.uint64)
        return (a[:, None] + steps * b[:, None]) % np.uint64(self.size)

    def add(self, keys: list[bytes]) -> None:
        if keys:
            self.bits[self.places(keys).astype(np.int64)] = True

    def passes(self, keys: list[bytes]) -> np.ndarray:
        if not keys:
            return np.zeros(0, bool)
        return self.bits[self.places(keys).astype(np.int64)].all(axis=1)


class Cascade(list):
    """Filters by level. A key is decided at the first level that it doesn't pass: levels 0, 2, ...
    encode listed keys, the others unlisted ones."""

    def listed(self, keys: list[bytes]) -> np.ndarray:
        out = np.full(len(keys), len(self) % 2 == 1)
        rest = np.arange(len(keys))
        for level, bloom in enumerate(self):
            ok = bloom.passes([keys[i] for i in rest])
            out[rest[~ok]] = level % 2 == 1
            rest = rest[ok]
        return out


def parts(url_col: str) -> tuple[F.Column, F.Column]:
    """Host and path of a URL; both empty without ``://``."""
    url = F.coalesce(F.col(url_col), F.lit(""))
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return (F.translate(F.regexp_extract(url, r"://([^/?#]*)", 1), upper, upper.lower()),
            F.regexp_extract(url, r"://[^/?#]*([^?#]*)", 1))


class Shards(list):
    """Cascades, each of the keys whose hash names it."""

    def shard(self, keys: list[bytes]) -> np.ndarray:
        return np.array([xxhash.xxh64_intdigest(k, SHARD_SEED) % max(1, len(self)) for k in keys], np.int64)

    def listed(self, keys: list[bytes]) -> np.ndarray:
        out, of = np.zeros(len(keys), bool), self.shard(keys)
        for n, cascade in enumerate(self):
            own = np.flatnonzero(of == n)
            out[own] = cascade.listed([keys[i] for i in own])
        return out


def keys_of(host: str, path: str, lengths: tuple[int, ...], labels: int) -> list[str]:
    """The keys a rule may have to fit, longest first; of equal ones that with the longer host. Domains have
    at most ``labels`` labels, as many as the hosts of the rules."""
    last = host.rsplit(".", labels)[-labels:] if labels else []
    domains = [".".join(last[i:]) for i in range(len(last))]
    found = [(d, path[:n]) for d in domains for n in lengths if n <= len(path)]
    return [d + p for d, p in sorted(found, key=lambda x: (-len(x[0]) - len(x[1]), -len(x[0])))]


def universe(urls: DataFrame, lengths: tuple[int, ...], labels: int) -> DataFrame:
    """The distinct keys of all (host, path). Only the beginning of a path matters, so equal ones are
    put together first."""
    most = max(lengths, default=0)
    short = urls.select("host", F.substring("path", 1, most).alias("path")).distinct()

    def rows(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            for host, path in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for key in keys_of(host, path, lengths, labels):
                    yield (key,)

    return map_rows(short, rows, "key string").distinct()


def passing(keys: DataFrame, bloom: Bloom) -> DataFrame:
    held = keys.sparkSession.sparkContext.broadcast(bloom)

    def rows(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            names = batch.column(0).to_pylist()
            for i in np.flatnonzero(held.value.passes([k.encode() for k in names])):
                yield (names[i],)

    return map_rows(keys, rows, "key string")


def filled(keys: DataFrame, bloom: Bloom) -> None:
    """Set the bits of ``keys``: each task sends the bytes of its own filter that it has set, and equal
    bytes are put together before they come to the driver, which holds one filter."""
    shape = keys.sparkSession.sparkContext.broadcast(bloom)

    def rows(batches: Iterator[pa.RecordBatch]):
        own = copy(shape.value)
        own.bits = np.zeros(own.size, bool)
        for batch in batches:
            own.add([k.encode() for k in batch.column(0).to_pylist()])
        packed = np.packbits(own.bits)
        for i in np.flatnonzero(packed):
            yield int(i), int(packed[i])

    packed = np.zeros(-(-bloom.size // 8), np.uint8)
    merged = map_rows(keys, rows, "at long, byte int").groupBy("at").agg(F.bit_or("byte").alias("byte"))
    for at, byte in merged.toLocalIterator():
        packed[at] = byte
    bloom.bits = np.unpackbits(packed)[: bloom.size].astype(bool)


def cascade(listed: list[str], keys: DataFrame) -> Cascade:
    """The cascade of ``listed`` over the universe ``keys`` (in files). The first filter passes about as
    many unlisted keys as there are listed ones, each further one half of what it is tested with."""
    listed = sorted(set(listed))
    out = Cascade()
    if not listed:
        out.append(Bloom(1, 0.5, 0))
        return out
    others = keys.filter(~F.col("key").isin(listed)) if len(listed) <= 1000 else keys.join(
        F.broadcast(keys.sparkSession.createDataFrame([(k,) for k in listed], "key string")), "key", "left_anti")
    n_others = others.count()
    rate = min(0.5, len(listed) * math.sqrt(2) / max(1, n_others))
    mine = [k.encode() for k in listed]
    bloom = Bloom(len(mine), rate, 0)
    bloom.add(mine)
    out.append(bloom)
    wrong = stored(passing(others, bloom), "url-level")
    while n := wrong.count():
        bloom = Bloom(n, 0.5, len(out))
        filled(wrong, bloom)
        out.append(bloom)
        mine = [k for k, ok in zip(mine, bloom.passes(mine)) if ok]
        if not mine:
            break
        bloom = Bloom(len(mine), 0.5, len(out))
        bloom.add(mine)
        out.append(bloom)
        wrong = stored(passing(wrong, bloom), "url-level")
    return out


def of_shard(keys: DataFrame, shards: Shards, n: int) -> DataFrame:
    def rows(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            names = batch.column(0).to_pylist()
            for i in np.flatnonzero(shards.shard([k.encode() for k in names]) == n):
                yield (names[i],)

    return map_rows(keys, rows, "key string")


def sharded(listed: list[str], keys: DataFrame, most: int = SHARD_RULES) -> Shards:
    """As many cascades as it takes for each to list about ``most`` keys, each over its part of the universe."""
    out = Shards([None] * max(1, -(-len(set(listed)) // most)))
    if len(out) == 1:
        return Shards([cascade(listed, keys)])
    of = out.shard([k.encode() for k in listed])
    return Shards([cascade([k for k, s in zip(listed, of) if s == n], stored(of_shard(keys, out, n), "url-shard"))
                   for n in range(len(out))])


def judge(pages: DataFrame, rules: list[Rule], id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """(page_id, host, path, rule, verdict) for each row of ``pages``; the longest fitting rule wins.

    A URL without a fitting rule, a null URL among them, has a null rule and the verdict ``allow``: none
    of its keys is listed. A repeated row is repeated, a null page_id stays null. Other columns are
    ignored. An empty table gives no rows.
    """
    host, path = parts(url_col)
    urls = pages.select(F.col(id_col).cast("long").alias("page_id"), host.alias("host"), path.alias("path"))
    lengths = tuple(sorted({len(r.path) for r in rules}))
    labels = max((len(r.host.split(".")) for r in rules), default=0)
    keys = stored(universe(urls, lengths, labels), "url-universe")
    verdicts = sorted({r.verdict for r in rules})
    cascades = {v: sharded([r.key for r in rules if r.verdict == v], keys) for v in verdicts}
    held = pages.sparkSession.sparkContext.broadcast(cascades)

    @F.pandas_udf("struct<rule: string, verdict: string>")
    def decided(hosts: pd.Series, paths: pd.Series) -> pd.DataFrame:
        known: dict[tuple[str, str], list[str]] = {}
        asked: dict[str, int] = {}
        most = max(lengths, default=0)
        for h, p in zip(hosts, paths):
            if (h, p[:most]) not in known:
                own = known[h, p[:most]] = keys_of(h, p, lengths, labels)
                for key in own:
                    asked.setdefault(key, len(asked))
        names = [k.encode() for k in asked]
        member = {v: c.listed(names) for v, c in held.value.items()}
        answer = {}
        for url, own in known.items():
            answer[url] = next(((k, v) for k in own for v in member if member[v][asked[k]]), (None, DEFAULT))
        return pd.DataFrame([answer[h, p[:most]] for h, p in zip(hosts, paths)], columns=["rule", "verdict"])

    return urls.withColumn("d", decided("host", "path")).select("page_id", "host", "path", "d.rule", "d.verdict")
