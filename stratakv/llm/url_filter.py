"""URL filter: allow and block rules in a trie over reversed host labels and path segments; the longest rule wins."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

from .common import map_text

#: (verdict, rule); a rule is host, then path from its first slash.
DEFAULT_RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))
#: A trie is broadcast, so its size is checked; more rules than this are refused rather than sent.
MAX_RULE_BYTES = 64_000_000


class Trie:
    """Host labels from the right, then path segments; a rule's last segment is a prefix of a segment.

    A node is [children by label, path root]; a path node is [children by segment, {last segment: (verdict, rule)}].
    Of the rules that fit a url, one on a longer host comes before one on a shorter host, then a longer path before a
    shorter one; a rule given twice with both verdicts blocks.
    """

    def __init__(self, rules: Sequence[tuple[str, str]]):
        self.root: list = [{}, None]
        for verdict, rule in rules:
            host, slash, path = rule.partition("/")
            node = self.root
            for label in reversed(host.lower().split(".")) if host else ():
                node = node[0].setdefault(label, [{}, None])
            if node[1] is None:
                node[1] = [{}, {}]
            *whole, last = (slash + path).split("/")
            at = node[1]
            for segment in whole:
                at = at[0].setdefault(segment, [{}, {}])
            if at[1].get(last, ("allow",))[0] != "block":
                at[1][last] = (verdict, rule)

    def match(self, host: str, path: str) -> tuple[str, str] | None:
        node, paths = self.root, [self.root[1]]
        for label in reversed(host.split(".")):
            node = node[0].get(label)
            if node is None:
                break
            paths.append(node[1])
        segments = path.split("/")
        for at in reversed(paths):
            found = None
            for segment in segments if at is not None else ():
                if at[1]:
                    best = max((k for k in at[1] if segment.startswith(k)), key=len, default=None)
                    found = at[1][best] if best is not None else found
                at = at[0].get(segment)
                if at is None:
                    break
            if found:
                return found
        return None


def split_url(url: str | None) -> tuple[str, str]:
    """Host with A-Z lower-cased, and path; both empty for a null url or one without '://'."""
    _, there, rest = (url or "").partition("://")
    if not there:
        return "", ""
    rest = rest.partition("#")[0].partition("?")[0]
    host, slash, path = rest.partition("/")
    return host.translate(_LOWER), slash + path


_LOWER = {c: c + 32 for c in range(65, 91)}


def filter_urls(pages: DataFrame, rules: Sequence[tuple[str, str]] = DEFAULT_RULES, default: str = "allow", id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """One row a page: id, host, path, rule (null if none fits) and verdict.

    Null urls and urls without '://' have an empty host and path, which no rule with a host fits, and get `default`.
    Repeated rows are judged each; other columns are not read.
    """
    size = sum(len(r) + len(v) for v, r in rules)
    if size > MAX_RULE_BYTES:
        raise ValueError(f"the rules take {size} bytes; at most {MAX_RULE_BYTES} are broadcast")
    trie = pages.sparkSession.sparkContext.broadcast(Trie(rules))

    def start():
        match = trie.value.match

        def judge(urls):
            parts = [split_url(u) for u in urls]
            found = [match(*p) if p[0] else None for p in parts]
            import pyarrow as pa

            return [pa.array(x, pa.string()) for x in ([p[0] for p in parts], [p[1] for p in parts], [f[1] if f else None for f in found], [f[0] if f else default for f in found])]

        return judge

    return map_text(pages, [id_col], url_col, start, "host string, path string, rule string, verdict string")
