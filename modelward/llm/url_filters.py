"""URL filters: a trie over reversed host labels and then path segments, with the longest rule deciding."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from modelward.session import ensure_checkpoint_dir

#: Characters of rules in one trie; more rules make further tries, which pass over the urls one after another.
TRIE_CHARS = 8 << 20
#: The verdicts.
ALLOW, BLOCK = "allow", "block"


class Trie:
    """Rules as a tree: host labels from the last to the first, then the path cut after each ``/``.

    A node is a dictionary of its children; below a host's labels, ``PATHS`` holds the tree of its paths. A path that ends
    inside a segment is kept by its rest in ``OPEN`` of the node before, as it fits all segments that begin with it.
    """

    PATHS, OPEN, RULE = 0, 1, 2

    def __init__(self, rules: Iterable[tuple[str, str, str]]) -> None:
        self.root: dict = {}
        for verdict, host, path in rules:
            node = self.root
            for label in reversed(host.split(".")) if host else ():
                node = node.setdefault(label, {})
            node = node.setdefault(self.PATHS, {})
            *whole, rest = path.split("/")
            for segment in whole:
                node = node.setdefault(segment, {})
            found = (len(host) + len(path), len(host), verdict == BLOCK, host + path, verdict)
            if rest:
                ends = node.setdefault(self.OPEN, {}).setdefault(len(rest), {})
                ends[rest] = max(found, ends.get(rest, found))
            else:
                node[self.RULE] = max(found, node.get(self.RULE, found))

    def longest(self, host: str, path: str) -> tuple | None:
        """The longest rule that fits, then that of the longer host, then the blocking one."""
        best, node, segments = None, self.root, None
        labels = host.split(".")
        at = len(labels)
        while node is not None:
            if self.PATHS in node:
                if segments is None:
                    segments = path.split("/")
                best = self._along(node[self.PATHS], segments, best)
            at -= 1
            node = node.get(labels[at]) if at >= 0 else None
        return best

    def _along(self, node: dict, segments: list[str], best: tuple | None) -> tuple | None:
        last = len(segments) - 1
        for k, segment in enumerate(segments):
            if self.RULE in node:
                best = max(best or node[self.RULE], node[self.RULE])
            for n, ends in node.get(self.OPEN, {}).items():
                hit = ends.get(segment[:n]) if len(segment) >= n else None
                if hit is not None:
                    best = max(best or hit, hit)
            if k == last or (node := node.get(segment)) is None:
                break
        return best


def tries(rules: DataFrame, chars: int = TRIE_CHARS) -> Iterator[Trie]:
    """The rules in tries of a bounded size; the driver holds one at a time."""
    held, size = [], 0
    for r in rules.where("verdict is not null and host is not null and path is not null").toLocalIterator():
        held.append((r["verdict"], r["host"], r["path"]))
        size += len(r["host"]) + len(r["path"]) + 16
        if size >= chars:
            yield Trie(held)
            held, size = [], 0
    if held:
        yield Trie(held)


def after_scheme(url: Column) -> Column:
    """What follows the first ``://``; empty without one."""
    at = F.instr(url, "://")
    return F.coalesce(F.when(at > 0, F.substr(url, at + 3)), F.lit(""))


def url_host(url: Column) -> Column:
    """The host with A-Z lower-cased, as it stands before the first ``/``, ``?`` or ``#``."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.translate(F.regexp_extract(after_scheme(url), "^[^/?#]*", 0), upper, upper.lower())


def url_path(url: Column) -> Column:
    """What follows the host, up to ``?`` or ``#``."""
    return F.regexp_extract(after_scheme(url), "^[^/?#]*([^?#]*)", 1)


def judged(rows: DataFrame, trie: Trie) -> DataFrame:
    """Rows with ``_host, _path, _best``, the latter replaced where the trie has a better rule."""
    shared = rows.sparkSession.sparkContext.broadcast(trie)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = shared.value.longest
        for batch in batches:
            hosts, paths, before = (batch.column(c).to_pylist() for c in ("_host", "_path", "_best"))
            found = [find(h, p) for h, p in zip(hosts, paths)]
            names = [f.name for f in best_type]
            best = [was if hit is None else max([dict(zip(names, hit)), *([was] if was else [])], key=lambda b: [b[n] for n in names]) for hit, was in zip(found, before)]
            columns = [pa.array(best, best_type) if c == "_best" else batch.column(c) for c in batch.schema.names]
            yield pa.RecordBatch.from_arrays(columns, batch.schema.names)

    best_type = pa.struct([("chars", pa.int64()), ("host_chars", pa.int64()), ("blocks", pa.bool_()), ("rule", pa.string()), ("verdict", pa.string())])
    return rows.mapInArrow(search, rows.schema)


def url_verdicts(pages: DataFrame, rules: DataFrame, *, default: str = ALLOW, id_column: str = "page_id", url_column: str = "url", trie_chars: int = TRIE_CHARS) -> DataFrame:
    """``id, host, path, rule, verdict`` of every page, by ``rules`` (verdict, host, path).

    A rule fits its host and all its subdomains if the url's path begins with the rule's, also inside a segment. The longest
    rule in characters of host and path decides; of equally long ones that of the longer host, then the one that blocks. Urls
    that no rule fits get the ``default``. Tries are broadcast one by one, each of at most ``trie_chars`` characters and one
    rule; with more than one, the verdicts so far are checkpointed between them.

    Urls that are null or without ``://`` have an empty host and path, which only a rule of an empty host can fit. Hosts are
    read as they stand: ports, users and final dots are part of them. Repeated rows are judged each, null ids kept; texts may
    be of any length. Rules with a null field are left out; without rules all urls get the default. Other columns are not
    read, and an empty table gives no rows.
    """
    url = F.col(url_column)
    empty = F.lit(None).cast("struct<chars: bigint, host_chars: bigint, blocks: boolean, rule: string, verdict: string>")
    rows = pages.select(F.col(id_column), url_host(url).alias("_host"), url_path(url).alias("_path"), empty.alias("_best"))
    for n, trie in enumerate(tries(rules, trie_chars)):
        if n:
            ensure_checkpoint_dir(pages.sparkSession)
            rows = rows.checkpoint()
        rows = judged(rows, trie)
    return rows.select(id_column, F.col("_host").alias("host"), F.col("_path").alias("path"), F.col("_best.rule").alias("rule"), F.coalesce("_best.verdict", F.lit(default)).alias("verdict"))
