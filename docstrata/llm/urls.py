"""URL filter: sorted digest arrays probed by vectorised binary search.

Rules are (verdict, host, path). A rule fits its host and all subdomains
of it when the URL's path starts with the rule's path; the rule with the
longest host, then the longest path, wins. Two sorted arrays of 64-bit
xxhash keys hold the rules: hosts, and host + path. They are written once
as plain arrays, given to every executor as a Spark file and memory-mapped
there, so that all workers of a machine share one copy in the page cache.
A probe is a binary search for a whole batch; each hit is confirmed on the
stored strings, so that colliding digests change nothing.

Edge rows: a null URL, or one without ``://``, has empty host and path and
fits no rule; such rows get the default verdict. Repeated rows are judged
alike, an empty table gives an empty result, and columns of the input
other than id and URL are not read. The rule list may be empty. Rules are
bounded by what a machine can map; URLs are never shuffled or collected.
"""

from __future__ import annotations

import json
import os
import tempfile
import uuid
from collections import defaultdict
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The rules of the production query (verdict, host, path).
RULES = (
    ("block", "net", "/"),
    ("allow", "example.net", "/en/"),
    ("block", "example.com", "/de/"),
    ("allow", "org", "/fr/"),
)
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def host_path(url: F.Column | str) -> tuple[F.Column, F.Column]:
    """Host (A-Z lower-cased) and path of a URL column; empty without ``://``."""
    url = F.col(url) if isinstance(url, str) else url
    rest = F.coalesce(F.regexp_extract(url, r"(?s)^.*?://(.*)$", 1), F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), _UPPER, _UPPER.lower())
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def digest(text: str) -> int:
    return xxhash.xxh64_intdigest(text.encode())


class DigestArray:
    """Sorted 64-bit keys in a memory-mapped file with the strings they stand for."""

    @staticmethod
    def write(path: str, strings: Iterable[str], key=digest) -> None:
        rows = sorted((key(s), s) for s in set(strings))
        np.save(path + ".keys.npy", np.array([k for k, _ in rows], np.uint64))
        blobs = [s.encode() for _, s in rows]
        np.save(path + ".offsets.npy", np.concatenate(([0], np.cumsum([len(b) for b in blobs], dtype=np.int64))).astype(np.int64))
        np.save(path + ".bytes.npy", np.frombuffer(b"".join(blobs) + b"\0", np.uint8))

    def __init__(self, path: str, key=digest):
        self.keys, self.offsets, self.bytes = (np.load(f"{path}.{n}.npy", mmap_mode="r") for n in ("keys", "offsets", "bytes"))
        self.key = key

    def probe(self, strings: list[str]) -> np.ndarray:
        """Row of each string, or -1; ties of digests are walked, strings compared whole."""
        keys = np.fromiter((self.key(s) for s in strings), np.uint64, len(strings))
        at = np.searchsorted(self.keys, keys)
        out = np.full(len(strings), -1, np.int64)
        inside = at < len(self.keys)
        hits = np.flatnonzero(inside)
        hits = hits[self.keys[at[hits]] == keys[hits]]
        for i in hits.tolist():
            j, want = int(at[i]), strings[i].encode()
            while j < len(self.keys) and self.keys[j] == keys[i]:
                if bytes(self.bytes[self.offsets[j]: self.offsets[j + 1]]) == want:
                    out[i] = j
                    break
                j += 1
        return out


_open: dict[str, tuple] = {}


def _arrays(token: str) -> tuple[DigestArray, DigestArray, dict]:
    if token not in _open:
        meta = json.loads(open(SparkFiles.get(f"{token}-meta.json")).read())
        _open[token] = (DigestArray(SparkFiles.get(f"{token}-hosts")), DigestArray(SparkFiles.get(f"{token}-rules")), meta)
    return _open[token]


def judge(hosts: list[str], paths: list[str], host_rows: DigestArray, rule_rows: DigestArray, meta: dict) -> tuple[list, list]:
    """(rule, verdict) of each row; one probe for each label depth and rule length."""
    n = len(hosts)
    rule: list[str | None] = [None] * n
    verdict: list[str] = [meta["default"]] * n
    open_rows = list(range(n))
    suffix = {i: hosts[i] for i in open_rows}
    while open_rows:
        found = host_rows.probe([suffix[i] for i in open_rows])
        wanted: dict[int, list[int]] = defaultdict(list)
        for i, row in zip(open_rows, found.tolist()):
            for length in meta["lengths"][row] if row >= 0 else ():
                if len(paths[i]) >= length:
                    wanted[length].append(i)
        settled: set[int] = set()
        for length in sorted(wanted, reverse=True):
            ask = [i for i in wanted[length] if i not in settled]
            names = [f"{suffix[i]}{paths[i][:length]}" for i in ask]
            for i, name, row in zip(ask, names, rule_rows.probe([f"{suffix[i]}\0{paths[i][:length]}" for i in ask]).tolist()):
                if row >= 0:
                    rule[i], verdict[i] = name, meta["verdicts"][row]
                    settled.add(i)
        nxt = []
        for i in open_rows:
            if i not in settled and "." in suffix[i]:
                suffix[i] = suffix[i].split(".", 1)[1]
                nxt.append(i)
        open_rows = nxt
    return rule, verdict


def url_filter(pages: DataFrame, rules: Iterable[tuple[str, str, str]] = RULES, default: str = "allow",
               id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """(page_id, host, path, rule, verdict) of every row; see the module docstring."""
    rules = [(v, h.translate(str.maketrans(_UPPER, _UPPER.lower())), p) for v, h, p in rules]
    token = f"urls-{uuid.uuid4().hex}"
    folder = tempfile.mkdtemp(prefix="docstrata-rules-")  # the driver's copy; executors get theirs from Spark
    DigestArray.write(f"{folder}/{token}-hosts", (h for _, h, _ in rules))
    DigestArray.write(f"{folder}/{token}-rules", (f"{h}\0{p}" for _, h, p in rules))
    hosts, lookup = DigestArray(f"{folder}/{token}-hosts"), DigestArray(f"{folder}/{token}-rules")
    lengths: list[set] = [set() for _ in hosts.keys]
    verdicts = [""] * len(lookup.keys)
    for (v, h, p), a, b in zip(rules, hosts.probe([h for _, h, _ in rules]), lookup.probe([f"{h}\0{p}" for _, h, p in rules])):
        lengths[a].add(len(p))
        verdicts[b] = v
    with open(f"{folder}/{token}-meta.json", "w") as out:
        json.dump({"lengths": [sorted(x) for x in lengths], "verdicts": verdicts, "default": default}, out)
    for name in sorted(os.listdir(folder)):
        pages.sparkSession.sparkContext.addFile(f"{folder}/{name}")
    host, path = host_path(url_col)
    rows = pages.select(F.col(id_col).alias("page_id"), host.alias("host"), path.alias("path"))

    def run(batches):
        arrays = _arrays(token)
        for b in batches:
            rule, verdict = judge(b.column("host").to_pylist(), b.column("path").to_pylist(), *arrays)
            yield pa.RecordBatch.from_arrays(
                [b.column("page_id"), b.column("host"), b.column("path"), pa.array(rule, pa.string()), pa.array(verdict, pa.string())],
                names=["page_id", "host", "path", "rule", "verdict"])

    kind = rows.schema["page_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"page_id {kind}, host string, path string, rule string, verdict string")


URLS_SQL = r"""
WITH p AS (
  SELECT page_id,
         translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages),
rules(verdict, host, path) AS (VALUES ('block', 'net', '/'), ('allow', 'example.net', '/en/'), ('block', 'example.com', '/de/'), ('allow', 'org', '/fr/')),
hit AS (
  SELECT p.page_id, p.host, p.path, r.host || r.path AS rule, r.verdict,
         row_number() OVER (PARTITION BY p.page_id ORDER BY length(r.host) DESC NULLS LAST, length(r.path) DESC) AS n
  FROM p LEFT JOIN rules r ON (p.host = r.host OR ends_with(p.host, '.' || r.host)) AND starts_with(p.path, r.path))
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM hit WHERE n = 1
"""
