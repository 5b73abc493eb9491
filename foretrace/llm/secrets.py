"""Secret scans with an incremental blob ledger, in built-in functions only.

Every version of every path is addressed by the SHA-256 of its content. The ledger has which rule versions have seen
which blob and what they found there; only pairs of a blob and a rule version that are not in it are scanned, each blob
once however many paths have it, and the findings of the whole ledger are joined back to all paths.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foretrace.llm.common import cut_lineage, table
from foretrace.llm.registry import query
from foretrace.llm.spans import count_kind, find_spans, spans_text


@dataclass(frozen=True)
class Rule:
    """A pattern; matches whose ``group`` has fewer than ``least`` characters are dropped. Raise ``version`` with any change."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1
    version: int = 1

    @property
    def key(self) -> str:
        return f"{self.kind}@{self.version}"


#: The base rules in their listed order, then further ones.
RULES = (
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", r"AKIA[A-Z0-9]{16,}"),
    Rule("hex", r"[0-9a-f]{24,}"),
    Rule("pem", r"-----BEGIN (?:[A-Z]{1,20} ){0,3}PRIVATE KEY-----"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
)
BASE = ("assign", "access", "hex")
FOUND = "array<struct<start:int,rank:int,kind:string,stop:int>>"
LEDGER = f"blob string, rules array<string>, found {FOUND}"


def _scan(text: Column, rule: Rule, rank: int) -> Column:
    spans = find_spans(text, rule.pattern, lambda _, v: F.char_length(v) >= rule.least, group=rule.group)
    return F.transform(
        spans, lambda s: F.struct(s["start"].alias("start"), F.lit(rank).alias("rank"), F.lit(rule.kind).alias("kind"), s["stop"].alias("stop"))
    )


def address(versions: DataFrame, *, path: str, text: str) -> DataFrame:
    """(path, blob, text) of every version; null text is the empty blob."""
    content = F.coalesce(F.col(text), F.lit(""))
    return versions.select(F.col(path).alias("path"), F.sha2(content, 256).alias("blob"), content.alias("text"))


def _layers(rules: Sequence[Rule]) -> list[list[tuple[int, Rule]]]:
    """The ranked rules in groups that have one version of each kind at most: mostly one group."""
    out: list[list[tuple[int, Rule]]] = []
    for i, rule in enumerate(rules):
        free = next((layer for layer in out if rule.kind not in {r.kind for _, r in layer}), None)
        if free is None:
            out.append(free := [])
        free.append((i, rule))
    return out


def scan_unseen(addressed: DataFrame, ledger: DataFrame | None, rules: Sequence[Rule] = RULES) -> DataFrame:
    """New ledger rows: for each blob that some rule version has not seen, those rule versions and what they found.

    A row has one version of a kind at most, so that ``rules`` and a finding's kind tell which version found it.
    One version stands for each blob, the one with the smallest path; it is chosen on narrow rows. A blob that very many
    paths have is one row after map-side combination.
    """
    chosen = addressed.groupBy("blob").agg(F.min("path").alias("chosen"))
    keys = F.array(*[F.lit(r.key) for r in rules])
    if ledger is None:
        pending = chosen.withColumn("todo", keys)
    else:
        seen = ledger.groupBy("blob").agg(F.flatten(F.collect_list("rules")).alias("seen"))
        joined = chosen.join(seen, "blob", "left")
        pending = joined.select("blob", "chosen", F.array_except(keys, F.coalesce("seen", F.array().cast("array<string>"))).alias("todo"))
        pending = pending.where(F.size("todo") > 0)
    pending = pending.withColumnRenamed("blob", "pending")
    texts = addressed.join(pending, (addressed.blob == pending.pending) & addressed.path.eqNullSafe(pending.chosen))
    text = F.col("text")
    parts = [
        F.struct(
            F.array_intersect("todo", F.array(*[F.lit(r.key) for _, r in layer])).alias("rules"),
            F.flatten(
                F.array(*[F.when(F.array_contains("todo", r.key), _scan(text, r, i)).otherwise(F.array().cast(FOUND)) for i, r in layer])
            )
            .cast(FOUND)
            .alias("found"),
        )
        for layer in _layers(rules)
    ]
    scanned = texts.select("blob", F.array(*parts).alias("parts")).groupBy("blob").agg(F.first("parts").alias("parts"))
    return scanned.select("blob", F.explode("parts").alias("part")).select("blob", "part.rules", "part.found").where(F.size("rules") > 0)


def scan_history(
    versions: DataFrame, ledger: DataFrame | None = None, *, path: str = "doc_id", text: str = "text", rules: Sequence[Rule] = RULES
) -> tuple[DataFrame, DataFrame]:
    """(findings, ledger): the spans of every row of ``versions`` by the given rules, and the ledger with what was added.

    ``findings`` has a row for each version, repeated rows and null paths too: the path, its blob and ``found``, an array of
    (start, rank, kind, stop) by start and rule order, in code points. A null text is the empty one and has none. Other
    columns are not carried. Findings of rule versions that are not asked for stay in the ledger and are left out here. The
    added ledger rows are written once, to the shared folder.
    """
    addressed = address(versions, path=path, text=text)
    added = cut_lineage(scan_unseen(addressed, ledger, rules))
    whole = added if ledger is None else ledger.select("blob", "rules", "found").unionByName(added)
    asked = F.array(*[F.lit(r.key) for r in rules])
    kinds = F.create_map(*[F.lit(v) for r in rules for v in (r.key, r.kind)])
    current = whole.where(F.size("found") > 0).withColumn("kinds", F.transform(F.array_intersect("rules", asked), lambda k: kinds[k]))
    current = current.select("blob", F.filter("found", lambda s: F.array_contains("kinds", s["kind"])).alias("found")).where(F.size("found") > 0)
    by_blob = current.groupBy("blob").agg(F.array_sort(F.flatten(F.collect_list("found"))).alias("found"))
    rows = addressed.select("path", "blob").join(by_blob, "blob", "left")
    return rows.select(F.col("path").alias(path), "blob", F.coalesce("found", F.array().cast(FOUND)).alias("found")), whole


def _sql_spans(kind: str, rank: int, pattern: str, group: int, least: int) -> str:
    quoted = pattern.replace("'", "''")
    return f"""
  SELECT doc_id, {rank} AS rank, '{kind}' AS kind,
    list_sum(list_transform(g[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0) AS start,
    length(m[i]) AS size
  FROM (SELECT *, unnest(range(1, len(m) + 1)) AS i FROM (
    SELECT doc_id, regexp_extract_all(t, '{quoted}') AS m, string_split_regex(t, '{quoted}') AS g,
      regexp_extract_all(t, '{quoted}', {group}) AS v FROM d))
  WHERE length(v[i]) >= {least}"""


def _letters(pattern: str) -> str:
    """ASCII letters in either case spelled out, as RE2's own folding goes beyond ASCII."""
    names = ("password", "passwd", "secret", "token", "api_?key")
    spelled = "|".join("".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in name) for name in names)
    return pattern.replace("((?i:" + "|".join(names) + "))", f"({spelled})")


SQL = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), s AS ({" UNION ALL ".join(_sql_spans(r.kind, i, _letters(r.pattern), r.group, r.least) for i, r in enumerate(RULES))}
), j AS (
  SELECT doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
    string_agg(kind || ':' || start::BIGINT || ':' || (start + size)::BIGINT, ',' ORDER BY start, rank) FILTER (rank < {len(BASE)}) AS base,
    string_agg(kind || ':' || start::BIGINT || ':' || (start + size)::BIGINT, ',' ORDER BY start, rank) AS spans
  FROM s GROUP BY doc_id
)
SELECT doc_id, coalesce(n_assign, 0)::BIGINT AS n_assign, coalesce(n_access, 0)::BIGINT AS n_access, coalesce(n_hex, 0)::BIGINT AS n_hex,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN j USING (doc_id)
"""


@query("op3_secret_scan", SQL)
def op3_secret_scan(spark, sf_dir):
    findings, _ = scan_history(table(spark, sf_dir, "documents"))
    base = F.filter("found", lambda s: s["kind"].isin(*BASE))
    return findings.select(
        "doc_id",
        *[count_kind(F.col("found"), k).alias(f"n_{k}") for k in BASE],
        F.sha2(spans_text(base), 256).alias("base_sha256"),
        spans_text(F.col("found")).alias("spans"),
    )


def ledger_counts(ledger: DataFrame, run: int, sign: int = 1) -> DataFrame:
    """(run, rule, pairs, spans): blobs that each rule version has scanned, and what it found there, times ``sign``."""
    each = ledger.select(F.explode("rules").alias("rule"), "found")
    kind = F.split("rule", "@")[0]
    own = each.select("rule", F.size(F.filter("found", lambda s: s["kind"] == kind)).alias("n"))
    return own.groupBy("rule").agg((sign * F.count(F.lit(1))).alias("pairs"), (sign * F.sum("n")).alias("spans")).withColumn("run", F.lit(run))


#: The second run's rules: secrets that are assigned must be longer.
RAISED = (Rule("assign", RULES[0].pattern, 2, 10, version=2), *RULES[1:])


def _count_sql(rule: Rule) -> str:
    """Matches of a rule in a text ``t``."""
    return f"len(list_filter(regexp_extract_all(t, '{_letters(rule.pattern).replace(chr(39), chr(39) * 2)}', {rule.group}), lambda v: length(v) >= {rule.least}))"


_RUNS = [(1, "first", r) for r in RULES] + [(2, "every" if r.version > 1 else "fresh", r) for r in RAISED]
LEDGER_SQL = f"""
WITH first AS (SELECT DISTINCT coalesce(text, '') AS t FROM documents), every AS (SELECT t FROM first UNION SELECT coalesce(text, '') FROM conversations),
fresh AS (SELECT t FROM every EXCEPT SELECT t FROM first)
{" UNION ALL ".join(f"SELECT {run} AS run, '{r.key}' AS rule, count(*) AS pairs, coalesce(sum({_count_sql(r)}), 0)::BIGINT AS spans FROM {source} HAVING count(*) > 0" for run, source, r in _RUNS)}
"""


@query("secret_ledger", LEDGER_SQL)
def secret_ledger(spark, sf_dir):
    """What two runs over one ledger scan: all documents, and then documents and conversations with a raised rule.

    The second run meets every document again, but scans only blobs that are new, and all blobs with the new version.
    """
    docs = table(spark, sf_dir, "documents").select(F.concat(F.lit("d/"), F.col("doc_id").cast("string")).alias("path"), "text")
    turns = table(spark, sf_dir, "conversations")
    turns = turns.select(F.concat_ws("/", F.lit("c"), F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("path"), "text")
    _, first = scan_history(docs, path="path")
    _, second = scan_history(docs.union(turns), first, path="path", rules=RAISED)
    counts = ledger_counts(first, 1).union(ledger_counts(second, 2)).union(ledger_counts(first, 2, -1))
    summed = counts.groupBy("run", "rule").agg(F.sum("pairs").alias("pairs"), F.sum("spans").alias("spans"))
    return summed.where("pairs > 0").select("run", "rule", "pairs", "spans")


__all__ = ["LEDGER", "RULES", "Rule", "ledger_counts", "scan_history"]
