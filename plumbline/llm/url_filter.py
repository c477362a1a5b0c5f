"""URL rules looked up in a sorted array of 64-bit digests.

A rule is a host and a path prefix written together, such as ``example.net/en/``. It fits
its host and all subdomains where the URL's path starts with the rule's path; the longest
rule that fits wins (of two as long, the one with the longer host). Rules are a sequence or a
table, and Spark makes the index from them: a file for each range of digests holds
sorted xxhash64 keys, then the strings. Executors memory-map the files, probe them with a
vectorised binary search and confirm each hit on the stored string, so that two strings with
one digest can't be mistaken for each other. The hosts of rules are indexed like the rules, each with the
lengths that its rules' paths have; so a URL is probed for its host and the domains above it first, and then
only for prefixes as long as the rules of a host that was found.

Rules whose hosts differ in case only are one; the last counts. Null rules and rules without a
host fit nothing. Null URLs and URLs without ``://`` have an empty host and path, fit no rule and
get the default verdict. Repeated rows are judged alike; an empty table gives an empty result.
"""

from __future__ import annotations

import atexit
import json
import math
import os
import shutil
import tempfile
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import Written

#: Fixed rules of the production filter.
RULES = [("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow")]
VERDICTS = ("allow", "block")
#: Rules in one file of the index; more rules make more files.
PART = 1 << 20
#: The seed that Spark's xxhash64 has.
SEED = 42
HOSTS, PATHS = 0, 1
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_fold = str.maketrans(UPPER, LOWER)


def split_url(url: str | None) -> tuple[str, str]:
    if url is None or (at := url.find("://")) < 0:
        return "", ""
    rest = url[at + 3 :]
    end = min((i for c in "/?#" if (i := rest.find(c)) >= 0), default=len(rest))
    host, path = rest[:end].translate(_fold), rest[end:]
    return host, path[: min((i for c in "?#" if (i := path.find(c)) >= 0), default=len(path))]


def entries(rules: DataFrame) -> DataFrame:
    """(kind, text, values) of (rule, verdict, seq): of each rule its verdict, of each host the lengths of its rules' paths.

    Of rules that differ only in the case of their host the one with the largest seq counts, then one that allows last.
    """
    cut = F.instr("rule", "/")
    host = F.translate(F.when(cut > 0, F.substring("rule", F.lit(1), cut - 1)).otherwise(F.col("rule")), UPPER, LOWER)
    path = F.when(cut > 0, F.substring("rule", cut, F.length("rule"))).otherwise("")
    known = F.when(F.col("verdict").isin(*VERDICTS), F.array_position(F.lit(list(VERDICTS)), F.col("verdict")) - 1).otherwise(F.raise_error(F.lit("a rule's verdict is neither allow nor block")))
    full = rules.where("rule IS NOT NULL").select(host.alias("host"), path.alias("path"), F.struct("seq", known.cast("long").alias("verdict")).alias("last")).where("host <> ''")
    full = full.groupBy("host", "path").agg(F.max("last").alias("last"))
    paths = full.select(F.lit(PATHS).alias("kind"), F.concat("host", "path").alias("text"), F.array("last.verdict").alias("values"))
    # as many lengths as the longest path has characters, at most
    hosts = full.groupBy("host").agg(F.sort_array(F.collect_set(F.length("path").cast("long"))).alias("values"))
    return paths.unionByName(hosts.select(F.lit(HOSTS).alias("kind"), F.col("host").alias("text"), "values"))


class DigestTable:
    """Strings and their values, by digest: 4 int64 (strings, values, bytes of strings, 0); keys; string ends; value ends; values; strings."""

    def __init__(self, raw: np.ndarray):
        self.n, k, size, _ = (int(x) for x in raw[:32].view(np.int64))
        at = 32
        self.keys = raw[at : (at := at + 8 * self.n)].view(np.uint64)
        self.ends = raw[at : (at := at + 8 * self.n)].view(np.int64)
        self.value_ends = raw[at : (at := at + 8 * self.n)].view(np.int64)
        self.values = raw[at : (at := at + 8 * k)].view(np.int64)
        self.strings = raw[at : at + size]

    @staticmethod
    def packed(digests: np.ndarray, texts: list[str], values: list[list[int]]) -> bytes:
        order = np.argsort(digests, kind="stable")
        strings, numbers = [texts[i].encode() for i in order], [values[i] for i in order]
        sizes = [np.fromiter(map(len, x), np.int64, len(x)) for x in (strings, numbers)]
        flat = np.fromiter((v for x in numbers for v in x), np.int64, int(sizes[1].sum()))
        header = np.array([len(strings), len(flat), sizes[0].sum(), 0], np.int64)
        return b"".join([header.tobytes(), digests[order].tobytes(), *(np.cumsum(x).astype(np.int64).tobytes() for x in sizes), flat.tobytes(), *strings])

    def find(self, probes: list[bytes], digests: np.ndarray) -> np.ndarray:
        """The place of each probe, or -1: hits of the binary search are confirmed on the stored strings."""
        found = np.full(len(probes), -1)
        if not self.n:
            return found
        at = np.searchsorted(self.keys, digests)
        for i in np.flatnonzero((at < self.n) & (self.keys[np.minimum(at, self.n - 1)] == digests)):
            j = int(at[i])
            while j < self.n and self.keys[j] == digests[i]:
                if self.string(j) == probes[i]:
                    found[i] = j
                    break
                j += 1
        return found

    def string(self, j: int) -> bytes:
        return self.strings[self.ends[j - 1] if j else 0 : self.ends[j]].tobytes()

    def of(self, j: int) -> list[int]:
        return self.values[self.value_ends[j - 1] if j else 0 : self.value_ends[j]].tolist()


def blocks(rules: DataFrame, bits: int) -> DataFrame:
    """(kind, part, data): the index in 2 ** bits ranges of digests, for hosts and for rules; empty ranges are left out."""
    digest = F.xxhash64("text")
    part = F.shiftrightunsigned(digest, 64 - bits) if bits else F.lit(0).cast("long")
    rows = entries(rules).select("kind", part.alias("part"), digest.alias("digest"), "text", "values")

    def block(key: tuple, t: pa.Table) -> pa.Table:
        data = DigestTable.packed(t["digest"].to_numpy().view(np.uint64), t["text"].to_pylist(), t["values"].to_pylist())
        return pa.table({"kind": pa.array([key[0].as_py()], pa.int32()), "part": pa.array([key[1].as_py()], pa.int64()), "data": pa.array([data], pa.binary())})

    return rows.groupBy("kind", "part").applyInArrow(block, "kind int, part long, data binary")


class Index:
    """The files of an index by kind and range; one is mapped when the first probe falls into its range."""

    def __init__(self, paths: dict[tuple[int, int], str], bits: int):
        self.paths, self.bits, self.open = paths, bits, {}

    def find(self, kind: int, probes: list[str]) -> dict[str, list[int]]:
        """The values of the probes that the index holds."""
        raw = [p.encode() for p in probes]
        digests = np.fromiter((xxhash.xxh64_intdigest(p, SEED) for p in raw), np.uint64, len(raw))
        parts = digests >> np.uint64(64 - self.bits) if self.bits else np.zeros(len(raw), np.uint64)
        out = {}
        for part in np.unique(parts).tolist():
            if (kind, part) not in self.paths:
                continue
            if (kind, part) not in self.open:
                self.open[kind, part] = DigestTable(np.memmap(self.paths[kind, part], np.uint8, "r"))
            table, mine = self.open[kind, part], np.flatnonzero(parts == part)
            for i, j in zip(mine.tolist(), table.find([raw[i] for i in mine], digests[mine]).tolist(), strict=True):
                if j >= 0:
                    out[probes[i]] = table.of(j)
        return out

    def judge(self, urls: list[str | None], default: str) -> list[tuple]:
        cut = [split_url(u) for u in urls]
        above = {host: [host[i:] for i in range(len(host)) if i == 0 or host[i - 1] == "."] for host, _ in cut}
        lengths = self.find(HOSTS, list(dict.fromkeys(s for x in above.values() for s in x)))
        fit = {host: [(s, lengths[s]) for s in x if s in lengths] for host, x in above.items()}
        probes: dict[str, None] = {}
        for host, path in cut:
            probes.update((s + path[:n], None) for s, known in fit[host] for n in known if n <= len(path))
        found = self.find(PATHS, list(probes))
        out = []
        for host, path in cut:
            hits = ((len(s) + n, len(s), s + path[:n]) for s, known in fit[host] for n in known if n <= len(path) and s + path[:n] in found)
            rule = max(hits, default=(0, 0, None))[2]
            out.append((host, path, rule, default if rule is None else VERDICTS[found[rule][0]]))
        return out


_written: dict[str, tuple[list[str], int]] = {}


def shipped(spark: SparkSession, rules: DataFrame | list[tuple[str, str]], most: int) -> tuple[list[str], int]:
    """Names of the index's files, which Spark's own file service brings to each executor, also to one that starts later, and the bits of a range.

    Tasks make the files; the driver takes them from the shared folder one by one, and holds one at a time.
    Its copies on disk stay until it ends, for executors that start later. Equal sequences are written once.
    """
    name = "digests-" + xxhash.xxh3_128_hexdigest(os.urandom(16) if isinstance(rules, DataFrame) else json.dumps([rules, most, spark.sparkContext.applicationId]).encode())
    if name not in _written:
        if not isinstance(rules, DataFrame):
            rules = spark.createDataFrame([(i, r, v) for i, (r, v) in enumerate(rules)], "seq long, rule string, verdict string")
        elif "seq" not in rules.columns:
            rules = rules.withColumn("seq", F.lit(0))
        bits, out = max(math.ceil(math.log2(max(rules.count(), 1) / most)), 0), Written(spark, "url-index")
        made, _ = out.put(blocks(rules, bits))
        folder = os.path.join(tempfile.mkdtemp(prefix="plumbline-"), name)
        os.mkdir(folder)
        atexit.register(shutil.rmtree, os.path.dirname(folder), ignore_errors=True)
        names = []
        for r in made.toLocalIterator():
            names.append(f"{name}-{r.kind}-{r.part}.bin")
            with open(os.path.join(folder, names[-1]), "wb") as f:
                f.write(r.data)
            spark.sparkContext.addFile(os.path.join(folder, names[-1]))
        out.drop()
        _written[name] = sorted(names), bits
    return _written[name]


def filter_urls(df: DataFrame, rules: DataFrame | Iterable[tuple[str, str]] = RULES, key: str = "page_id", url: str = "url", default: str = "allow", most: int = PART) -> DataFrame:
    """(key, host, path, rule, verdict) of each row of df. Other columns of df are not read.

    rules: pairs of a rule and its verdict, or a table (rule, verdict) of any size that executors' disks
    hold, with seq if some are equal. Executors map the files, so that only the pages that probes touch
    are in memory; verdicts are the same for any `most`.
    """
    names, bits = shipped(df.sparkSession, rules if isinstance(rules, DataFrame) else [tuple(r) for r in rules], most)
    rows = df.select(F.col(key).alias("k"), F.col(url).cast("string").alias("u"))
    schema = f"k {rows.schema['k'].dataType.simpleString()}, host string, path string, rule string, verdict string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Index({tuple(map(int, n.removesuffix(".bin").split("-")[-2:])): SparkFiles.get(n) for n in names}, bits)
        for b in batches:
            got = index.judge(b.column(1).to_pylist(), default)
            cols = zip(*got, strict=True) if got else ([], [], [], [])
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(list(c), pa.string()) for c in cols)], names=["k", "host", "path", "rule", "verdict"])

    return rows.mapInArrow(run, schema).withColumnRenamed("k", key)


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(spark.read.parquet(f"{sf_dir}/pages.parquet"))


SQL = f"""
WITH u AS (
  SELECT page_id, CASE WHEN url IS NULL OR strpos(url, '://') = 0 THEN '' ELSE substr(url, strpos(url, '://') + 3) END AS rest FROM pages
), h AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), '{UPPER}', '{LOWER}') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u
), r(rule, rule_host, rule_path, verdict) AS (
  VALUES ('net/', 'net', '/', 'block'), ('example.net/en/', 'example.net', '/en/', 'allow'),
         ('example.com/de/', 'example.com', '/de/', 'block'), ('org/fr/', 'org', '/fr/', 'allow')
), m AS (
  SELECT h.page_id, h.host, h.path, r.rule, r.verdict,
         row_number() OVER (PARTITION BY h.rowid_ ORDER BY length(r.rule) DESC, length(r.rule_host) DESC) AS rank
  FROM (SELECT *, row_number() OVER () AS rowid_ FROM h) h
  LEFT JOIN r ON (h.host = r.rule_host OR ends_with(h.host, '.' || r.rule_host)) AND starts_with(h.path, r.rule_path)
)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM m WHERE rank = 1
"""
