"""Text, identifier and record expressions."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from foretrace.functions import fixed_values as fv
from foretrace.functions.scalar import as_col

# Patterns of a play description.
INTENTIONAL_WALK = r"(?i)intentionally walks ([^\\.]+)"
SUBJECT_VERBS = (
    "singles|doubles|triples|homers|walks|strikes out|grounds|flies|lines|pops|reaches|called out|out on|hits|bunts"
    "|sacrifices|hit by pitch"
)
SUBJECT = rf"(?i)^([A-Za-zÀ-ÖØ-öø-ÿ'., -]+?) (?:{SUBJECT_VERBS})"
TRAILING_WORD = r"(?i)\b(bunt|ground|fly|line|pop)\b$"
PLACEHOLDER = r"(?i)^batter_[0-9]+$"
PUNCTUATION = r"[!-/:-@\[-`{-~]"


def or_null(text: Column) -> Column:
    return F.nullif(text, F.lit(""))


def cleaned_name(text: str | Column) -> Column:
    """Trimmed, single-spaced, without a trailing word of the play."""
    squeezed = F.regexp_replace(F.trim(as_col(text)), r"\s+", " ")
    return F.trim(F.regexp_replace(squeezed, TRAILING_WORD, ""))


def canonical_name(text: str | Column) -> Column:
    """The cleaned name; empty gives null."""
    return or_null(cleaned_name(text))


def usable_name(text: str | Column) -> Column:
    """The cleaned name; empty names and placeholders give null."""
    return or_null(F.regexp_replace(cleaned_name(text), PLACEHOLDER, ""))


def subject_name(text: str | Column, verbs: str = SUBJECT) -> Column:
    """The player a play description is about."""
    trimmed = F.trim(as_col(text))
    walked = F.trim(F.regexp_extract(trimmed, INTENTIONAL_WALK, 1))
    named = canonical_name(F.regexp_extract(trimmed, verbs, 1))
    return F.coalesce(or_null(walked), named)


def is_placeholder(name: str | Column) -> Column:
    return F.coalesce(as_col(name).rlike(PLACEHOLDER), F.lit(False))


def mapped(code: Column, aliases: Mapping[str, str]) -> Column:
    """Alias of a code, the code itself where it has none."""
    lookup = F.create_map(*[F.lit(v) for pair in aliases.items() for v in pair])
    return F.coalesce(F.try_element_at(lookup, code), code)


def team_code(code: str | Column, aliases: Mapping[str, str] = fv.LIVE_ALIASES) -> Column:
    """Upper-case team code with its alias applied; null gives the empty string."""
    return F.coalesce(mapped(F.upper(F.trim(as_col(code))), aliases), F.lit(""))


def venue_key(name: str | Column) -> Column:
    squeezed = F.regexp_replace(F.lower(F.trim(as_col(name))), r"\s+", " ")
    return or_null(F.regexp_replace(squeezed, PUNCTUATION, ""))


def team_venue_key(code: str | Column) -> Column:
    text = F.trim(as_col(code))
    plain = F.when(text.rlike("^[0-9]+$"), text.try_cast("bigint").cast("string")).otherwise(text)
    stripped = F.regexp_replace(F.upper(plain), PUNCTUATION + r"|\s", "")
    return F.when(F.length(text) > 0, mapped(stripped, fv.VENUE_ALIASES))


def slug(name: str | Column) -> Column:
    return F.replace(F.lower(F.trim(as_col(name))), F.lit(" "), F.lit("-"))


def pick_id(
    date: str | Column,
    game: str | Column,
    batter: str | Column,
    batter_name: str | Column,
    pitcher: str | Column,
    pitcher_name: str | Column,
) -> Column:
    """``date:game:batter:pitcher``, without the game if unknown, with slugs of names for unknown ids."""
    who = F.coalesce(as_col(batter).cast("string"), slug(batter_name), F.lit(""))
    whom = F.coalesce(as_col(pitcher).cast("string"), slug(pitcher_name), F.lit(""))
    return F.concat_ws(":", as_col(date).cast("string"), as_col(game).cast("string"), who, whom)


def result_label(value: str | Column) -> Column:
    token = F.lower(F.trim(as_col(value).cast("string")))
    return (
        F.when(token.isin(*fv.HIT_WORDS), "HR")
        .when(token.isin(*fv.MISS_WORDS), "No HR")
        .when(token.isin(*fv.POSTPONED_WORDS), "Postponed")
        .otherwise("Pending")
    )


def result_outcome(label: str | Column) -> Column:
    return F.when(as_col(label) == "HR", 1).when(as_col(label) == "No HR", 0)


def game_state(status: str | Column, start: str | Column, reference: Column) -> Column:
    """final / live / pregame from the words of the status, then from the start time."""
    token = F.lower(F.trim(F.coalesce(as_col(status), F.lit(""))))
    return (
        F.when(token.rlike("|".join(fv.FINAL_STATUS_PARTS)), "final")
        .when(token.rlike("|".join(fv.LIVE_STATUS_PARTS)), "live")
        .when(as_col(start) <= reference, "live")
        .otherwise("pregame")
    )


def is_postponed(status: str | Column) -> Column:
    return F.coalesce(F.lower(as_col(status)).rlike("postponed|cancelled"), F.lit(False))


def to_int(value: str | Column) -> Column:
    return as_col(value).try_cast("bigint")


def to_float(value: str | Column) -> Column:
    parsed = as_col(value).try_cast("double")
    return F.when(~F.isnan(parsed), parsed)


def to_day(value: str | Column) -> Column:
    return as_col(value).try_cast("date")
