"""Labels, titles and replies as text columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def raw_label(name: Column) -> Column:
    """Underscores and white space to single blanks, trimmed."""
    return F.trim(F.regexp_replace(name, r"[_\s]+", " "))


def title_tokens(title: Column) -> Column:
    """Without a leading number and the word premium, split at dashes, first occurrences only."""
    bare = F.regexp_replace(F.regexp_replace(raw_label(title), r"^[0-9]+[.)]?\s*", ""), r"(?i)\bpremium\b", "")
    parts = F.transform(F.split(bare, r"\s*[–—]\s*|\s+-\s+"), lambda x: F.trim(x))
    return F.array_distinct(F.filter(parts, lambda x: x != ""))


def first_match(text: Column, rules: list[tuple[str, str]], default: str | None = None) -> Column:
    """The class of the first pattern that occurs in the lower-cased text."""
    low = F.lower(text)
    out = None
    for pattern, kind in rules:
        out = F.when(low.rlike(pattern), kind) if out is None else out.when(low.rlike(pattern), kind)
    return F.lit(default) if out is None else out.otherwise(F.lit(default))


def name_and_year(name: Column) -> Column:
    """Lower-cased text before the first separator, and the first year of 1900 to 2099."""
    team = F.lower(F.trim(F.regexp_extract(raw_label(name), r"^([^-]*)", 1)))
    year = F.regexp_extract(name, r"((?:19|20)[0-9]{2})", 1)
    return F.struct(team.alias("team"), F.when(year != "", year).alias("year"))


def split_lines(text: Column) -> Column:
    """Lines without bullets and blanks."""
    return F.filter(F.transform(F.split(text, "\n"), lambda x: F.trim(F.regexp_replace(x, r"^\s*[-*•]+\s*", ""))), lambda x: x != "")


def digits(reply: Column) -> Column:
    """All digits of a reply joined; a question mark or none gives null."""
    found = F.regexp_replace(reply, r"[^0-9]", "")
    return F.when(~reply.contains("?") & (found != ""), found)


def known_role(reply: Column, roles: list[str]) -> Column:
    """Lower-cased and trimmed when it is one of the roles, else null."""
    low = F.lower(F.trim(reply))
    return F.when(low.isin(roles), low)


def parsed_window(text: Column) -> Column:
    """N19: 'start:end' with 0 <= start < end as a struct, else null."""
    parts = F.split(text, ":")
    start, end = (F.try_element_at(parts, F.lit(k)).try_cast("double") for k in (1, 2))
    return F.when((F.size(parts) == 2) & (start >= 0) & (start < end), F.struct(start.alias("start_s"), end.alias("end_s")))


def good_commentary(text: Column, markers: list[str], shortest: int = 50, longest: int = 140) -> Column:
    """Trimmed length in range, two or three sentences, a marker word somewhere."""
    t = F.trim(text)
    sentences = F.size(F.filter(F.split(t, r"[.!?。！？]+"), lambda x: F.trim(x) != ""))
    has = F.lit(False)
    for m in markers:
        has = has | t.contains(m)
    return F.coalesce(F.length(t).between(shortest, longest) & sentences.between(2, 3) & has, F.lit(False))


def bare_json(reply: Column) -> Column:
    """An object without a Markdown fence around it; anything else is null."""
    body = F.regexp_extract(F.trim(reply), r"(?s)^(?:```(?:json)?\s*)?(\{.*\})\s*(?:```)?$", 1)
    return F.when(body != "", body)


def older_than(version: Column, major: int, minor: int) -> Column:
    """(major, minor) below the given; what can't be read counts as old."""
    part = lambda k: F.try_element_at(F.split(version, r"\."), F.lit(k)).try_cast("int")
    return F.coalesce((part(1) < major) | ((part(1) == major) & (part(2) < minor)), F.lit(True))


def category(role: Column, team: Column, jersey: Column) -> Column:
    """role_team_jersey, role_team or the bare role; an unknown role is an error."""
    bare = role.isin("referee", "ball", "other")
    player = role.isin("player", "goalkeeper")
    named = F.when(jersey.rlike("^[0-9]+$"), F.concat_ws("_", role, team, jersey)).otherwise(F.concat_ws("_", role, team))
    return F.when(player, named).when(bare, role).otherwise(F.raise_error(F.concat(F.lit("unknown role "), F.coalesce(role, F.lit("null")))))


def display_path(relative: Column, library: str) -> Column:
    """A path below the name of its library."""
    return F.concat(F.lit(f"{library}/"), relative)


def result_path(relative: Column, folder: str = "analysis") -> Column:
    """The path of a file's result: below ``folder``, the last suffix of its name replaced by .json."""
    return F.concat(F.lit(f"{folder}/"), F.regexp_replace(relative, r"(?<=[^/])\.[^./]+$", ""), F.lit(".json"))
