"""URL filters: rules in a sorted array of 64-bit digests, memory-mapped and probed by vectorised binary search.

A rule is (host, path, verdict). A store is one file: sorted xxhash64 keys, offsets, verdicts and the full rule
strings; rules beyond ``MAX_STORE`` bytes make further stores. For each url the keys of all rules that could fit (each
suffix of the host at a dot, with each prefix of the path as long as some rule's path) are probed in one binary search a
batch and store; every hit is confirmed by the stored string, so digests that collide do no harm. The longest rule of
all stores wins; without one the default verdict holds.

Stores are sent by ``SparkContext.addFile``: each executor, also one that joins later, gets its own copy from the
driver and maps it. A file is named by its content, so equal rules are sent once a session.

Edge cases: null urls and urls without ``://`` have empty host and path and get the default; repeated urls, and rows
with a null key, are judged each by its url; rules that repeat must agree; extra columns are not read; an empty table
gives an empty result, no rules give the default.
"""

from __future__ import annotations

import hashlib
import os
import tempfile
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark import SparkFiles
from pyspark.sql import DataFrame

from .common import tidy

MAX_STORE = 1 << 30
ALLOW, BLOCK = "allow", "block"
RULES = [("com", "/", ALLOW), ("example.com", "/en/", BLOCK), ("www.example.com", "/en/", ALLOW), ("net", "/es/", BLOCK), ("net", "/fr/", BLOCK)]
PARTS = regex.compile(r"://([^/?#]*)([^?#]*)")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def split_url(url: str | None) -> tuple[str, str]:
    """Host (A-Z lower-cased) and path; both empty without ``://``."""
    m = PARTS.search(url or "")
    return (m[1].translate(LOWER), m[2]) if m else ("", "")


def digest(rule: str) -> int:
    return xxhash.xxh64_intdigest(rule.encode("utf-8", "surrogatepass"))


def write_stores(rules: Iterable[tuple[str, str, str]], folder: str, limit: int = 0) -> list[str]:
    """The rules as files of at most limit bytes (one rule may have more), each named by its content."""
    verdicts: dict[str, str] = {}
    lengths = set()
    for host, path, verdict in rules:
        name = host.translate(LOWER) + path
        lengths.add(len(path))
        if verdicts.setdefault(name, verdict) != verdict:
            raise ValueError(f"two verdicts for {name}")
    entries = sorted((digest(name), name.encode("utf-8", "surrogatepass"), v == BLOCK) for name, v in verdicts.items())
    size, paths = np.cumsum([17 + len(e[1]) for e in entries]), []
    for part in np.unique(size // (limit or MAX_STORE)):
        some = [e for e, n in zip(entries, size // (limit or MAX_STORE), strict=True) if n == part]
        at = np.concatenate([[0], np.cumsum([len(e[1]) for e in some], dtype=np.int64)]).astype("<i8")
        out = np.array([len(some), len(lengths)], "<i8").tobytes() + np.array(sorted(lengths), "<i8").tobytes() + np.array([e[0] for e in some], "<u8").tobytes() + at.tobytes() + np.array([e[2] for e in some], "u1").tobytes() + b"".join(e[1] for e in some)
        paths.append(os.path.join(folder, f"urls-{hashlib.sha256(out).hexdigest()}.bin"))
        with open(paths[-1], "wb") as f:
            f.write(out)
    return paths


class Store:
    """A mapped store; nothing is read but what the search touches."""

    def __init__(self, path: str):
        m = np.memmap(path, np.uint8, "r")
        n, k = m[:16].view("<i8")
        self.lengths = m[16 : 16 + 8 * k].view("<i8").tolist()
        a = 16 + 8 * k
        self.keys = m[a : a + 8 * n].view("<u8")
        a += 8 * n
        self.at = m[a : a + 8 * (n + 1)].view("<i8")
        a += 8 * (n + 1)
        self.block, self.blob = m[a : a + n], m[a + n :]

    def probe(self, names: list[str]) -> np.ndarray:
        """Entry of each name, or -1."""
        found = np.full(len(names), -1, np.int64)
        keys = np.array([digest(x) for x in names], np.uint64)
        place = np.searchsorted(self.keys, keys)
        ask = np.flatnonzero(place < len(self.keys))
        while len(ask):  # more than one round only where digests collide
            ask = ask[self.keys[place[ask]] == keys[ask]]
            for i in ask:
                e = place[i]
                if self.blob[self.at[e] : self.at[e + 1]].tobytes() == names[i].encode("utf-8", "surrogatepass"):
                    found[i] = e
            ask = ask[found[ask] < 0]
            place[ask] += 1
            ask = ask[place[ask] < len(self.keys)]
        return found

    def candidates(self, host: str, path: str) -> list[str]:
        suffixes = [host, *(host[i + 1 :] for i, c in enumerate(host) if c == ".")] if host else []
        return [s + path[:n] for s in suffixes for n in self.lengths if n <= len(path)]


_stores: dict[str, Store] = {}
_sent: dict[tuple[str, str], str] = {}


def filter_urls(pages: DataFrame, rules: list[tuple[str, str, str]], *, key: str = "page_id", url: str = "url", default: str = ALLOW) -> DataFrame:
    """key, host, path, the longest fitting rule and the verdict of every url."""
    context, names = pages.sparkSession.sparkContext, []
    folder = tempfile.mkdtemp(prefix="glossa-urls-")  # on the driver, which serves the files from there
    for path in write_stores(rules, folder):
        name = os.path.basename(path)
        if (context.applicationId, name) in _sent:
            os.remove(path)
        else:
            context.addFile(path)
            _sent[context.applicationId, name] = path
        names.append(name)
    if not os.listdir(folder):
        os.rmdir(folder)
    schema = pages.select(key).schema
    for column in ("host", "path", "rule", "verdict"):
        schema = schema.add(column, "string")

    def run(batches):
        for name in names:
            if name not in _stores:
                _stores[name] = Store(SparkFiles.get(name))
        stores = [_stores[name] for name in names]
        for batch in batches:
            parts = [split_url(u) for u in batch.column(1).to_pylist()]
            asked = [stores[0].candidates(*p) if stores else [] for p in parts]
            urls = [x for xs in asked for x in xs]
            owner = np.repeat(np.arange(len(parts)), [len(x) for x in asked])
            rule, verdict = [None] * len(parts), [default] * len(parts)
            for store in stores:
                found = store.probe(urls)
                for i in np.flatnonzero(found >= 0):
                    o = owner[i]
                    if rule[o] is None or len(urls[i]) > len(rule[o]):
                        rule[o], verdict[o] = urls[i], BLOCK if store.block[found[i]] else ALLOW
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, pa.string()) for c in ([p[0] for p in parts], [p[1] for p in parts], rule, verdict)]], names=schema.names)

    return pages.select(key, url).mapInArrow(tidy(run), schema)


def op3_url_filter(spark, sf_dir: str) -> DataFrame:
    return filter_urls(spark.read.parquet(f"{sf_dir}/pages.parquet"), RULES)


OP3_SQL = """
WITH p AS (
  SELECT page_id,
         translate(regexp_extract(coalesce(url, ''), '://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(coalesce(url, ''), '://[^/?#]*([^?#]*)', 1) AS path
  FROM pages),
r AS (
  SELECT *, CASE
    WHEN ends_with('.' || host, '.www.example.com') AND starts_with(path, '/en/') THEN 'www.example.com/en/'
    WHEN ends_with('.' || host, '.example.com') AND starts_with(path, '/en/') THEN 'example.com/en/'
    WHEN ends_with('.' || host, '.net') AND starts_with(path, '/es/') THEN 'net/es/'
    WHEN ends_with('.' || host, '.net') AND starts_with(path, '/fr/') THEN 'net/fr/'
    WHEN ends_with('.' || host, '.com') AND starts_with(path, '/') THEN 'com/' END AS rule
  FROM p)
SELECT page_id, host, path, rule,
       CASE WHEN rule IN ('example.com/en/', 'net/es/', 'net/fr/') THEN 'block' ELSE 'allow' END AS verdict
FROM r
"""
