"""Personal data by patterns and by bootstrapped contexts, in built-in functions only.

Base patterns find addresses, numbers and cards. They are the seeds of the bootstrap: the words before an entity are a
lexical pattern, and patterns and instances (surfaces) form a graph of their occurrences in the whole corpus. A pattern's
confidence is the mean confidence of the instances it precedes; an unseen identifier's is that of the best pattern
that precedes it anywhere. The two are computed in turn a fixed number of times, where instances that a round came to believe
support further patterns in the next, and what confident patterns precede is added to the base spans under the kind
``context``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foretrace.llm.common import cut_lineage, table
from foretrace.llm.registry import query
from foretrace.llm.spans import bound, count_kind, find_spans, gather, spans_text

KINDS = ("email", "ip", "card", "phone", "context")
BASE = KINDS[:4]
#: Rounds of scoring; confidence from which a pattern is trusted; distinct believed instances that a pattern needs.
ROUNDS, CONFIDENT, SEEDS = 3, 0.8, 3
#: Code points before an entity in which its pattern's words are looked for.
LEFT = 48

# A run of name characters is entered at its start, or where the match before it ended inside it: starts further on find
# nothing that the first does not, and would make long runs quadratic. Repeats take all they can at once.
EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
_PART = r"0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
CARD = r"[0-9](?:[\x20-]?[0-9]){15,}+"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
#: An unseen identifier: an unbroken token of letters, digits and hyphens with at least four digits, of 6 to 40 characters.
TOKEN = r"(?<![A-Za-z0-9-])[A-Za-z-]*+[0-9][A-Za-z0-9-]*+"


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _digit_count(value: Column) -> Column:
    return F.char_length(_digits(value))


def luhn(digits: Column) -> Column:
    """Does a string of digits pass the Luhn test?"""
    backwards = F.split(F.reverse(digits), "")

    def weight(d: Column, i: Column) -> Column:
        n = d.cast("int")
        doubled = F.when(n > 4, 2 * n - 9).otherwise(2 * n)
        return F.when(i % 2 == 1, doubled).otherwise(n)

    parts = F.transform(F.filter(backwards, lambda d: d != ""), weight)
    return F.aggregate(parts, F.lit(0), lambda s, x: s + x) % 10 == 0


def _card(value: Column, _: Column) -> Column:
    return _digit_count(value).between(16, 19) & luhn(_digits(value))


def _phone(value: Column, _: Column) -> Column:
    return _digit_count(value).between(8, 15)


def _ip(value: Column, _: Column) -> Column:
    return value.rlike(rf"^{_PART}\.{_PART}\.{_PART}\.{_PART}$")


def _token(value: Column, _: Column) -> Column:
    return F.char_length(value).between(6, 40) & (_digit_count(value) >= 4)


FINDERS = {"email": (EMAIL, None), "ip": (IP, _ip), "card": (CARD, _card), "phone": (PHONE, _phone)}
PLACES = "array<struct<rank:int,start:int,stop:int,kind:string,surface:bigint,context:string>>"


def _places(text: Column, kind: str) -> Column:
    """Spans of a kind with a hash of their surface and their pattern: up to two words before them, digits as 0."""
    pattern, keep = FINDERS.get(kind, (TOKEN, _token))
    words = lambda s: F.regexp_extract(s, r"((?:[^\s]+\s+)?[^\s]+)\s*$", 1)
    plain = lambda s: F.lower(F.regexp_replace(F.regexp_replace(words(s), "[0-9]", "0"), r"\s+", " "))
    return F.transform(
        find_spans(text, pattern, keep, before=LEFT),
        lambda s: F.struct(
            F.lit(KINDS.index(kind)).alias("rank"), s["start"].alias("start"), s["stop"].alias("stop"),
            F.lit(kind).alias("kind"), F.xxhash64(F.lower(s["value"])).alias("surface"), plain(s["before"]).alias("context"),
        ),
    )


def _occurrences(docs: DataFrame, id_col: str, text: str, keep: list[str]) -> DataFrame:
    """The table that all later steps read: base spans by kind, and unseen identifiers outside of them."""
    content = F.coalesce(F.col(text), F.lit(""))
    base = F.flatten(F.array(*[_places(content, kind) for kind in BASE])).cast(PLACES)
    found = docs.select(
        F.col(id_col).alias("id"), *[F.col(c) for c in keep], base.alias("base"), _places(content, "context").cast(PLACES).alias("tokens")
    )
    alone = (F.size("base") == 0) | (F.size("tokens") == 0)
    found = found.withColumn("tokens", F.when(alone, F.col("tokens")).otherwise(_apart(F.col("tokens"), F.col("base"))))
    return cut_lineage(found.withColumn("row", F.monotonically_increasing_id()))


def _apart(tokens: Column, base: Column) -> Column:
    """The tokens that overlap no base span, by one sweep over both in the order of their starts.

    Tokens do not overlap each other, so only the last one can reach into a base span that starts after it.
    """
    tagged = lambda spans, is_token: F.transform(spans, lambda s: F.struct(s["start"].alias("start"), F.lit(is_token).alias("token"), s.alias("span")))
    element = PLACES[len("array<") : -1]
    none = F.array().cast(PLACES)
    waiting = lambda s: F.when(s["ok"], F.array(s["held"])).otherwise(none)

    def step(s: Column, x: Column) -> tuple[dict[str, Column], Column]:
        span, token = x["span"], x["token"]
        state = {
            "reach": F.when(token, s["reach"]).otherwise(F.greatest(s["reach"], span["stop"])),
            "held": F.when(token, span).otherwise(s["held"]),
            "ok": F.when(token, s["reach"] <= span["start"]).otherwise(s["ok"] & (s["held"]["stop"] <= span["start"])),
        }
        return state, F.when(token, waiting(s)).otherwise(none)

    start = {"reach": F.lit(0), "held": F.lit(None).cast(element), "ok": F.lit(False)}
    return gather(F.array_sort(F.concat(tagged(base, False), tagged(tokens, True))), start, PLACES, step, waiting)


def trusted_patterns(places: DataFrame, *, rounds: int = ROUNDS, confident: float = CONFIDENT, seeds: int = SEEDS) -> DataFrame:
    """(context, score): patterns whose instances are, weighted by their occurrences, personal data with confidence.

    ``places`` has base and tokens as arrays. Occurrences are added up by (context, surface) in the tasks that read them, so
    a frequent pattern or instance is no hot key; the graph is written once, and each round joins it with one row per
    instance and one per pattern.
    """
    each = places.select(F.explode(F.concat("base", "tokens")).alias("p"))
    graph = cut_lineage(
        each.where(F.col("p.context") != "")
        .groupBy(F.col("p.context").alias("context"), F.col("p.surface").alias("surface"))
        .agg(F.count(F.lit(1)).alias("n"), F.max((F.col("p.kind") != "context").cast("int")).alias("is_seed"))
    )
    known = graph.groupBy("surface").agg(F.max("is_seed").alias("seed"))
    # no round can support a context that has fewer different instances than a pattern needs
    possible = graph.groupBy("context").agg(F.count(F.lit(1)).alias("instances")).where(F.col("instances") >= seeds).select("context")
    edges = cut_lineage(graph.join(possible, "context", "left_semi").join(known, "surface").select("context", "surface", "n", "seed"))
    belief = edges.groupBy("surface").agg(F.max("seed").cast("double").alias("belief"))
    for turn in range(rounds):
        scores = (
            edges.join(belief, "surface")
            .groupBy("context")
            .agg(
                F.round(F.sum(F.col("n") * F.col("belief")) / F.sum("n"), 9).alias("score"),
                F.sum((F.col("belief") > 0).cast("bigint")).alias("support"),
            )
            .where((F.col("support") >= seeds) & (F.col("score") >= confident))
            .select("context", "score")
        )
        if turn < rounds - 1:
            best = edges.join(scores, "context", "left").groupBy("surface").agg(F.max("score").alias("best"), F.max("seed").alias("seed"))
            believed = F.when(F.col("seed") == 1, 1.0).otherwise(F.coalesce("best", F.lit(0.0)))
            belief = cut_lineage(best.select("surface", believed.alias("belief")))
    return cut_lineage(scores)


def find_personal_data(docs: DataFrame, *, id_col: str = "doc_id", text: str = "text", keep: tuple[str, ...] = (), **limits) -> DataFrame:
    """One row for each row of ``docs``: its id, the columns in ``keep``, and ``spans``, an array of (rank, start, stop, kind).

    Spans are in code points, stop exclusive, by kind as listed in ``KINDS`` and then start; base spans of different kinds may
    overlap, those of ``context`` overlap no base span. Null and empty texts have no spans; repeated rows stay, and count
    as often in the pattern scores as they occur. Clashing names of other columns do no harm, as only those in ``keep``
    are carried; these must not be called id, base, tokens, row or spans.
    """
    places = _occurrences(docs, id_col, text, list(keep))
    patterns = trusted_patterns(places, **limits)
    tokens = places.select("row", F.explode("tokens").alias("t"))
    chosen = tokens.join(patterns, F.col("t.context") == patterns.context, "left_semi")
    more = chosen.groupBy("row").agg(F.collect_list("t").alias("found"))
    joined = places.join(more, "row", "left")
    every = F.concat("base", F.coalesce("found", F.array().cast(PLACES)))
    spans = F.transform(F.array_sort(every), lambda s: F.struct(s["rank"], s["start"], s["stop"], s["kind"]))
    return joined.select(F.col("id").alias(id_col), *keep, spans.alias("spans"))


#: Code points of the pieces that a text is cut into, to reach its places without counting from its start.
PIECE = 1024
STRETCH = "array<struct<start:int,stop:int,kind:string>>"


def redact(text: Column, spans: Column) -> Column:
    """The text with every stretch that spans cover replaced by the kind of the first span in it, in angle brackets.

    Write the result before a Python function takes it: Spark cannot plan one over nested lambda functions.
    """
    ordered = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["rank"].alias("rank"), s["stop"].alias("stop"), s["kind"].alias("kind"))))
    none = F.array().cast(STRETCH)
    stretch = lambda a, b, kind: F.array(F.struct(a.alias("start"), b.alias("stop"), kind.alias("kind"))).cast(STRETCH)

    def step(s: Column, x: Column) -> tuple[dict[str, Column], Column]:
        kept = F.when(x["start"] >= s["at"], stretch(s["at"], x["start"], x["kind"])).otherwise(none)
        return {"at": F.greatest(s["at"], x["stop"])}, kept

    end = lambda s: stretch(s["at"], F.char_length(text), F.lit(None).cast("string"))
    kept = gather(ordered, {"at": F.lit(0)}, STRETCH, step, end)

    def said(pieces: Column, p: Column) -> Column:
        first = F.floor(p["start"] / PIECE).cast("int")
        reached = F.array_join(F.slice(pieces, first + 1, F.floor((p["stop"] - 1) / PIECE).cast("int") - first + 1), "")
        plain = F.when(p["stop"] > p["start"], F.substring(reached, p["start"] - first * PIECE + 1, p["stop"] - p["start"])).otherwise("")
        return F.concat(plain, F.coalesce(F.concat(F.lit("<"), p["kind"], F.lit(">")), F.lit("")))

    pieces = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0))
    done = bound(pieces, lambda cut: F.array_join(F.transform(kept, lambda p: said(cut, p)), ""))
    return F.when(F.size(spans) > 0, done).otherwise(text)


@query("op7_personal_data")
def op7_personal_data(spark, sf_dir):
    found = find_personal_data(table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda s: s["kind"] != "context")
    return found.select(
        "doc_id",
        *[count_kind(F.col("spans"), k).alias(f"n_{k}") for k in BASE],
        F.sha2(spans_text(base), 256).alias("base_sha256"),
        spans_text(F.col("spans")).alias("spans"),
        F.size("spans").cast("bigint").alias("n_spans"),
    )


__all__ = ["find_personal_data", "luhn", "redact", "trusted_patterns"]
