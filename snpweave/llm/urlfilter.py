"""URL filters over a sorted digest array.

Rules ``(host, path, verdict)`` become one string each, host and path joined.  Their
64-bit xxhash keys are sorted into an array file, with the strings beside it in the same
order; the files are written to the cluster's shared folder and brought to every executor by Spark's file
distribution, where they are memory-mapped.  A URL's candidate strings - the suffixes of its host with as many
dots as some rule's host has, each with the prefixes of its path that have the length of some rule's path - are hashed,
found by one vectorised binary search a batch, and confirmed against the stored strings, so equal keys
of unequal strings do no harm.  How many candidates a URL has, and how long they are, depends
on the rules alone.  Rules beyond ``SHARD_RULES`` make further files, probed one
after the other: what one file holds is bounded.

Defined results: null urls and urls without ``://`` have empty host and path (no rule of a host fits them);
of several rules that fit the longest string wins, of equal length the one with the
longer host; of equal strings ``block`` wins; without a rule the verdict is the default;
page ids may be null or repeated, rows are judged one by one; urls of any length; rules without a host are left out, without a
path they fit every path; empty tables of pages or rules are fine; extra columns are
ignored.
"""

from __future__ import annotations

import io
import os
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import scratch
from .common import ascii_lower, map_arrow, text_slices

# The rules of the query, as host, path, verdict.
RULES = (("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block"))
#: Rules in one array file (about 60 bytes each).
SHARD_RULES = 2_000_000

_worker: dict = {}


def digest(text: str) -> int:
    return xxhash.xxh64_intdigest(text.encode())


class SortedDigests:
    """Read side of one shard: memory-mapped keys, string ends, strings and verdicts, all in key order."""

    def __init__(self, stem: str):
        self.keys = np.load(stem + ".keys.npy", mmap_mode="r")
        self.ends = np.load(stem + ".ends.npy", mmap_mode="r")
        self.strings = np.load(stem + ".strings.npy", mmap_mode="r")
        self.blocks = np.load(stem + ".blocks.npy", mmap_mode="r")

    @staticmethod
    def files(rules: list[tuple[str, str]], hash_of=digest) -> dict[str, bytes]:
        """The contents of a shard's files by their last names; ``rules`` as (string, verdict)."""
        best: dict[str, bool] = {}
        for text, verdict in rules:
            best[text] = best.get(text, False) or verdict == "block"
        ordered = sorted((hash_of(text), text) for text in best)
        blobs = [text.encode() for _, text in ordered]
        made = {
            "keys": np.array([k for k, _ in ordered], np.uint64), "ends": np.cumsum([len(b) for b in blobs], dtype=np.int64),
            "strings": np.frombuffer(b"".join(blobs), np.uint8), "blocks": np.array([best[text] for _, text in ordered], bool),
        }
        out = {}
        for name, values in made.items():
            np.save(content := io.BytesIO(), values)
            out[f"{name}.npy"] = content.getvalue()
        return out

    def string(self, at: int) -> str:
        start = int(self.ends[at - 1]) if at else 0
        return self.strings[start : int(self.ends[at])].tobytes().decode()

    def find(self, texts: list[str], hash_of=digest) -> list[int]:
        """The place of each text's rule, or -1."""
        keys = np.fromiter(map(hash_of, texts), np.uint64, len(texts))
        at = np.searchsorted(self.keys, keys)
        out = np.full(len(texts), -1)
        inside = np.flatnonzero(at < len(self.keys))
        for i in inside[self.keys[at[inside]] == keys[inside]].tolist():
            place = int(at[i])
            while place < len(self.keys) and self.keys[place] == keys[i]:  # several strings may share a key
                if self.string(place) == texts[i]:
                    out[i] = place
                    break
                place += 1
        return out.tolist()


def candidates(host: str, path: str, dots: frozenset[int], lengths: list[int], longest: int) -> list[tuple[str, int]]:
    """Rule strings that would fit, with their host's length: ``dots`` are the numbers of dots of the rules' hosts, ``lengths``
    their paths' lengths, ``longest`` their longest host's."""
    out, end, passed = [], len(host), 0
    while passed <= max(dots, default=-1):
        at = host.rfind(".", max(0, len(host) - longest - 1), end)
        if passed in dots and len(host) - at - 1 <= longest and (at >= 0 or len(host) <= longest):
            out += [(host[at + 1 :] + path[:n], len(host) - at - 1) for n in lengths if n <= len(path)]
        if at < 0:
            break
        end, passed = at, passed + 1
    return out


def put_file(spark: SparkSession, path: str, content: bytes) -> None:
    """Write a file to the shared folder, whatever store it is in."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    stream = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(target, True)
    try:
        for at in range(0, len(content), 1 << 22):
            stream.write(bytearray(content[at : at + (1 << 22)]))
    finally:
        stream.close()


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host: after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; path: from there up to ``?``, ``#`` or the end."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    raw = F.regexp_extract(rest, "^[^/?#]*", 0)
    return ascii_lower(raw), F.regexp_extract(F.substr(rest, F.length(raw) + 1), "^[^?#]*", 0)


def filter_urls(pages: DataFrame, rules: DataFrame, *, default: str = "allow", id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """``(page_id, host, path, rule, verdict)``, one row a page; ``rules`` has ``host, path, verdict``."""
    spark = pages.sparkSession
    made = rules.select(F.lower("host"), F.coalesce("path", F.lit("")), "verdict").where("host IS NOT NULL")
    stem, shards, shard, lengths, dots, longest = f"rules-{uuid.uuid4().hex}", [], [], set(), set(), 0

    def close() -> None:
        shards.append(f"{stem}-{len(shards)}")
        for name, content in SortedDigests.files(shard).items():
            file = f"{scratch(spark)}/snpweave/{stem}/{shards[-1]}.{name}"
            put_file(spark, file, content)
            spark.sparkContext.addFile(file)
        shard.clear()

    for host, path, verdict in made.toLocalIterator():
        shard.append((host + path, verdict))
        lengths.add(len(path)), dots.add(host.count("."))
        longest = max(longest, len(host))
        if len(shard) >= SHARD_RULES:
            close()
    if shard:
        close()
    sizes, dotted = sorted(lengths), frozenset(dots)
    host, path = host_and_path(F.col(url_col).cast("string"))
    rows = pages.select(F.col(id_col).alias("page_id"), host.alias("host"), path.alias("path"))
    id_type = rows.schema["page_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if _worker.get("stem") != stem:
            _worker.update(stem=stem, shards=[SortedDigests(os.path.join(os.path.dirname(SparkFiles.get(f"{s}.keys.npy")), s)) for s in shards])
        for batch, paths in text_slices(batches, "path"):
            owner, texts, hosts = [], [], []
            for i, (h, p) in enumerate(zip(batch.column(1).to_pylist(), paths, strict=True)):
                for text, size in candidates(h, p, dotted, sizes, longest):
                    owner.append(i), texts.append(text), hosts.append(size)
            best: dict[int, tuple[int, int, str, bool]] = {}
            for digests in _worker["shards"]:
                for i, text, size, place in zip(owner, texts, hosts, digests.find(texts), strict=True):
                    if place >= 0:
                        best[i] = max(best.get(i, (-1, -1, "", False)), (len(text), size, text, bool(digests.blocks[place])))
            met = [best.get(i) for i in range(batch.num_rows)]
            rule = pa.array([m and m[2] for m in met], pa.string())
            verdict = pa.array([default if m is None else "block" if m[3] else "allow" for m in met], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns, rule, verdict], names=["page_id", "host", "path", "rule", "verdict"])

    return map_arrow(rows, run, f"page_id {id_type}, host string, path string, rule string, verdict string", "verdicts")
