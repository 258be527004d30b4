"""URL rules by a sort-merge range join over reversed hosts.

A host's key is its labels from last to first, each closed by a NUL. A rule's host and all its
subdomains are then one interval of keys, and two such intervals are nested or apart. URLs are
range-partitioned and sorted by key; each task sweeps its run once and keeps a stack of the rules
whose interval is open. The page id is part of the range key, so a host with a third of all pages is
spread over tasks.

Rules are an argument of the job, like a list of phrases: every task gets all of them. A rule that
is part of a table belongs in a join, not here.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from taxaflow.llm.common import lower_ascii, whole_text

LOCATION = r"^(?s:.*?)://([^/?#]*)([^?#]*)"


class Rule(NamedTuple):
    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


def host_of(url: Column) -> Column:
    return lower_ascii(F.regexp_extract(whole_text(url), LOCATION, 1))


def path_of(url: Column) -> Column:
    return F.regexp_extract(whole_text(url), LOCATION, 2)


def reversed_key(host: str) -> str:
    return "".join(label + "\0" for label in reversed(host.split(".")))


def key_column(host: Column) -> Column:
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.")), "\0"), F.lit("\0"))


def fits(rule: Rule, host: str, path: str) -> bool:
    return (host == rule.host or host.endswith("." + rule.host)) and path.startswith(rule.path)


def sweep(rules: list[Rule], default: str):
    """Function over a run of pages sorted by key."""
    opening = sorted((reversed_key(rule.host), rule) for rule in rules)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ahead, stack = 0, []  # rules not opened yet start at opening[ahead]
        for batch in batches:
            keys, hosts, paths = (batch.column(c).to_pylist() for c in ("key", "host", "path"))
            names, verdicts, previous, found = [], [], None, None
            for key, host, path in zip(keys, hosts, paths, strict=True):
                if (key, path) != previous:
                    while ahead < len(opening) and opening[ahead][0] <= key:
                        while stack and not opening[ahead][0].startswith(stack[-1][0]):
                            stack.pop()
                        stack.append(opening[ahead])
                        ahead += 1
                    while stack and not key.startswith(stack[-1][0]):
                        stack.pop()
                    fitting = [rule for _, rule in stack if fits(rule, host, path)]
                    found = max(fitting, key=lambda rule: (len(rule.name), rule.name), default=None)
                    previous = (key, path)
                names.append(found.name if found else None)
                verdicts.append(found.verdict if found else default)
            yield pa.RecordBatch.from_arrays(
                [batch.column("page_id"), batch.column("host"), batch.column("path"), pa.array(names, pa.string()), pa.array(verdicts, pa.string())],
                names=["page_id", "host", "path", "rule", "verdict"],
            )

    return run


def judge_urls(pages: DataFrame, rules: Iterable[Rule], default: str = "allow") -> DataFrame:
    """One row per page: host, path, the longest fitting rule or null, and its verdict or ``default``.

    A null url, or one without ``://``, has an empty host and path and no rule. Repeated pages give
    repeated rows; of two rules of one name the one that sorts last counts. Other columns of
    ``pages`` are left out.
    """
    kind = pages.schema["page_id"].dataType.simpleString()
    url = F.col("url")
    keyed = pages.select("page_id", host_of(url).alias("host"), path_of(url).alias("path")).withColumn("key", key_column(F.col("host")))
    order = ["key", "path", "page_id"]
    sorted_runs = keyed.repartitionByRange(*order).sortWithinPartitions(*order)
    return sorted_runs.mapInArrow(sweep(list(rules), default), f"page_id {kind}, host string, path string, rule string, verdict string")
