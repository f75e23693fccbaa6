"""URL rules in a trie over reversed host labels and path segments.

The rules of a crawl policy are a small, stated list: the trie is built once on
the driver, its size is checked, and it travels to the tasks with the function.
Judging is a narrow projection of the url column.

Precedence: of the rules that fit, the one with the longest host wins; among
rules of one host the one with the longest path; a block entry beats an allow
entry with the same host and path.  A rule's path is a string prefix, so its last
segment may be a part of the url's segment.

Cases: a null url, or one without ``://``, has an empty host and path and gets the
default verdict; an empty host never fits a rule; repeated rows are judged each by
itself; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from functools import partial

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilmark.llm.common import ASCII_LOWER

#: (verdict, host, path)
RULES = [
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
]
#: The verdict of a url that no rule fits.
DEFAULT_VERDICT = "allow"
#: Largest rule list that may be sent to every task.
MAX_RULES = 1_000_000

_AFTER = re.compile(r"://([^/?#]*)([^?#]*)", re.DOTALL)
_LOWER = {c: ASCII_LOWER[c] for c in range(65, 91)}


class Trie:
    """``hosts`` goes down by labels from the last one; each host has a trie of path segments.

    A path node has the rules that end in the middle of the next segment under
    the key None: {prefix of the segment: (verdict, rule text)}.
    """

    def __init__(self, rules: Iterable[tuple[str, str, str]]):
        self.root: dict = {"next": {}, "paths": None}
        rules = list(rules)
        if len(rules) > MAX_RULES:
            raise ValueError(f"{len(rules)} rules are too many to send to every task (limit {MAX_RULES})")
        for verdict, host, path in rules:
            if verdict not in ("allow", "block"):
                raise ValueError(f"unknown verdict {verdict!r}")
            host = host.translate(_LOWER)
            node = self.root
            for label in reversed(host.split(".")):
                node = node["next"].setdefault(label, {"next": {}, "paths": None})
            if node["paths"] is None:
                node["paths"] = {}
            at = node["paths"]
            *full, tail = path.split("/")
            for segment in full:
                at = at.setdefault(segment, {})
            ends = at.setdefault(None, {})
            if tail not in ends or verdict == "block":
                ends[tail] = (verdict, host + path)

    @staticmethod
    def in_path(paths: dict, path: str) -> tuple[str, str] | None:
        """The rule with the longest path that is a prefix of ``path``."""
        best, at = None, paths
        for segment in path.split("/"):
            ends = at.get(None)
            if ends:
                fit = [tail for tail in ends if segment.startswith(tail)]
                if fit:
                    best = ends[max(fit, key=len)]
            at = at.get(segment)
            if at is None:
                break
        return best

    def judge(self, host: str, path: str) -> tuple[str, str] | None:
        """(verdict, rule text) of the longest fitting rule, or None."""
        if not host:
            return None
        best, node = None, self.root
        for label in reversed(host.split(".")):
            node = node["next"].get(label)
            if node is None:
                break
            if node["paths"] is not None:
                best = self.in_path(node["paths"], path) or best
        return best


def split_url(url: str | None) -> tuple[str, str]:
    """(host with A-Z lower-cased, path); both empty without ``://``."""
    m = _AFTER.search(url) if url else None
    return (m[1].translate(_LOWER), m[2]) if m else ("", "")


def _judge_batches(batches: Iterator[pa.RecordBatch], trie: Trie, default: str) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        hosts, paths, rules, verdicts = [], [], [], []
        for url in batch.column(1).to_pylist():
            host, path = split_url(url)
            verdict, rule = trie.judge(host, path) or (default, None)
            hosts.append(host)
            paths.append(path)
            rules.append(rule)
            verdicts.append(verdict)
        text = pa.string()
        yield pa.record_batch(
            [batch.column(0), pa.array(hosts, text), pa.array(paths, text), pa.array(rules, text), pa.array(verdicts, text)],
            ["page_id", "host", "path", "rule", "verdict"],
        )


def judge_urls(pages: DataFrame, rules: Iterable[tuple[str, str, str]] = RULES, default: str = DEFAULT_VERDICT) -> DataFrame:
    """page_id, host, path, rule (host and path of the winning rule, or null), verdict."""
    work = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"))
    return work.mapInArrow(
        partial(_judge_batches, trie=Trie(rules), default=default),
        "page_id long, host string, path string, rule string, verdict string",
    )
