"""URL filters by a sort-merge range join.

A host's labels in reverse order, each followed by a dot, make a key of which the keys of all subdomains are
continuations; so a rule's host is an interval of keys, and intervals of different rules nest or are apart. Each task
sorts its URLs by key and sweeps once over them and the sorted rules, with a stack of the rules whose interval is open.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foretrace.llm.common import build_parts, load_part, table
from foretrace.llm.registry import query

RULES = (("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/"))
#: Rules are swept in parts of at most this many bytes, so that a task's rules stay bounded whatever their number.
PART_BYTES = 32_000_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_AFTER = "(?s)^.*?://"


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z made small; else empty."""
    return F.translate(F.coalesce(F.regexp_extract(url, _AFTER + "([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, _AFTER + "[^/?#]*([^?#]*)", 1), F.lit(""))


def host_key(host: Column) -> Column:
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.", -1)), "."), F.lit("."))


def key_of(host: str) -> str:
    return ".".join(reversed(host.split("."))) + "."


class RuleTable:
    """Rules by host key in sorted order; the paths of a host are found by their lengths, longest first."""

    def __init__(self, rules: Iterable[tuple[str, str]]):
        hosts: dict[str, dict[str, tuple[str, str]]] = {}
        for verdict, rule in rules:
            host, slash, rest = rule.partition("/")
            host, path = host.translate(str.maketrans(UPPER, LOWER)), slash + rest
            if not host:
                raise ValueError(f"rule {rule!r} has no host")
            paths = hosts.setdefault(key_of(host), {})
            if path not in paths or verdict == "block":  # of two equal rules, block holds
                paths[path] = (host + path, verdict)
        self.keys = sorted(hosts)
        self.paths = [hosts[k] for k in self.keys]
        self.lengths = [sorted({len(p) for p in paths}, reverse=True) for paths in self.paths]


class Sweep:
    """Goes once over keys in ascending order; ``at`` is the next rule, ``open`` the stack of rules around the key."""

    def __init__(self, rules: RuleTable | None):
        self.rules, self.at, self.open = rules, 0, []

    def move(self, key: str) -> None:
        rules, keys = self.rules, self.rules.keys
        while self.open and not key.startswith(keys[self.open[-1]]):
            self.open.pop()
        while self.at < len(keys) and keys[self.at] <= key:
            if key.startswith(keys[self.at]):
                self.open.append(self.at)
            self.at += 1

    def longest(self, path: str) -> tuple[str, str] | None:
        """The longest open rule whose path the given one starts with; of equally long ones, that of the longer host."""
        best = None
        for i in reversed(self.open):
            for length in self.rules.lengths[i]:
                found = self.rules.paths[i].get(path[:length]) if length <= len(path) else None
                if found:
                    if best is None or len(found[0]) > len(best[0]):
                        best = found
                    break
        return best


def _parts(rules: DataFrame | Sequence[tuple[str, str]], part_bytes: int) -> list[RuleTable | str]:
    """Rules as given, or the paths of those of a (verdict, rule) table in parts of bounded size, each made by a task."""
    if not isinstance(rules, DataFrame):
        return [RuleTable(rules)]
    known = rules.where(F.col("rule").isNotNull() & F.col("verdict").isNotNull()).select("verdict", "rule").distinct()
    total = known.agg(F.coalesce(F.sum(F.octet_length("rule")), F.lit(0))).first()[0]
    part = F.pmod(F.xxhash64("rule"), F.lit(max(1, -(-int(total) // part_bytes))))
    pairs = lambda found: RuleTable(list(zip(found["verdict"].to_pylist(), found["rule"].to_pylist())))
    return build_parts(known.select("verdict", "rule", part.alias("part")), "part", pairs, "rules")


def judge_urls(
    pages: DataFrame,
    rules: DataFrame | Sequence[tuple[str, str]] = RULES,
    *,
    id_col: str = "page_id",
    url: str = "url",
    default: str = "allow",
    part_bytes: int = PART_BYTES,
) -> DataFrame:
    """One row for each row of ``pages``: id, host, path, the longest fitting rule or null, and its verdict or ``default``.

    A rule fits its host and all subdomains where the URL's path starts with the rule's. A null URL, or one without
    ``://``, has an empty host and path and fits no rule. Repeated rows stay; other columns are not carried. The URLs are
    not shuffled: each task sorts what it has read, so no host can crowd a task. Rules of a table beyond ``part_bytes`` are
    swept part by part, and the longest of all parts holds.
    """
    found = pages.select(
        F.col(id_col).alias("id"), host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"),
        F.lit(None).cast("string").alias("rule"), F.lit(None).cast("string").alias("verdict"),
    )
    schema = f"key string, id {dict(found.dtypes)['id']}, host string, path string, rule string, verdict string"
    parts = _parts(rules, part_bytes)

    def sweep(batches):
        states = [Sweep(None) for _ in parts]
        for batch in batches:
            key, ids, host, path, rule, verdict = batch.columns
            new_rule, new_verdict = rule.to_pylist(), verdict.to_pylist()
            keys, paths = key.to_pylist(), path.to_pylist()
            for part, state in zip(parts, states):
                state.rules = load_part(part) if isinstance(part, str) else part
                for i, (k, p) in enumerate(zip(keys, paths)):
                    state.move(k)
                    best = state.longest(p) if state.open else None
                    old = new_rule[i]
                    if best and (old is None or (len(best[0]), best[0].find("/")) > (len(old), old.find("/"))):
                        new_rule[i], new_verdict[i] = best
                state.rules = None
            yield pa.RecordBatch.from_arrays(
                [key, ids, host, path, pa.array(new_rule, pa.string()), pa.array(new_verdict, pa.string())],
                names=["key", "id", "host", "path", "rule", "verdict"],
            )

    keyed = found.select(host_key(F.col("host")).alias("key"), "id", "host", "path", "rule", "verdict")
    found = keyed.sortWithinPartitions("key").mapInArrow(sweep, schema).drop("key")
    return found.select(
        F.col("id").alias(id_col), "host", "path", "rule", F.coalesce("verdict", F.lit(default)).alias("verdict")
    )


SQL = f"""
WITH rules(verdict, host, path) AS (VALUES {", ".join(f"('{v}', '{r.partition('/')[0]}', '/{r.partition('/')[2]}')" for v, r in RULES)}),
split AS (
  SELECT row_number() OVER () AS i, page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) END AS rest FROM pages
), parts AS (
  SELECT i, page_id, translate(coalesce(regexp_extract(rest, '^[^/?#]*'), ''), '{UPPER}', '{LOWER}') AS host,
    coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path FROM split
), fits AS (
  SELECT i, r.host || r.path AS rule, verdict, row_number() OVER (PARTITION BY i ORDER BY length(r.host || r.path) DESC, length(r.host) DESC) AS n
  FROM parts p JOIN rules r ON (p.host = r.host OR ends_with(p.host, '.' || r.host)) AND starts_with(p.path, r.path)
)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM parts LEFT JOIN (SELECT * FROM fits WHERE n = 1) USING (i)
"""


@query("op6_url_filter", SQL)
def op6_url_filter(spark, sf_dir):
    return judge_urls(table(spark, sf_dir, "pages"))


__all__ = ["RuleTable", "Sweep", "judge_urls"]
