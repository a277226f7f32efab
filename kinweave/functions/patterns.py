"""Rules on column names and patterns of values. All patterns avoid look-around and back-references."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from kinweave.functions.binding import bind

# The semantics a column may carry.
SEMANTICS = [
    "pk", "address", "address2", "birthdate", "city", "country", "state", "postal", "create-dt", "update-dt", "email",
    "full-name", "given-name", "surname", "title", "generational-suffix", "gender", "phone",
]


@dataclass(frozen=True)
class NameRule:
    """A semantic and the words of a snake-case column name that stand for it."""

    semantic: str
    words: str

    @property
    def pattern(self) -> str:
        return f"(^|_)({self.words})(_|$)"


# Tried in this order, the first that fits wins.
NAME_RULES = [
    NameRule("email", "email|e_mail|mail_address|e_?mail_?address"),
    NameRule("phone", "phone|telephone|mobile|cell_?(phone|number|no)|phone_number"),
    NameRule("birthdate", "birth_?date|birth_?day|dob|date_of_birth"),
    NameRule("address2", "address_?(line_?)?2|addr_?2|apartment|suite"),
    NameRule("address", "address|addr|street"),
    NameRule("city", "city|town"),
    NameRule("state", "state|province"),
    NameRule("postal", "zip|zip_?code|postal|postal_?code|postcode"),
    NameRule("country", "country"),
    NameRule("full-name", "full_?name|customer_name|contact_name"),
    NameRule("given-name", "first_?name|given_?name|fname"),
    NameRule("surname", "last_?name|surname|family_?name|lname"),
    NameRule("generational-suffix", "suffix"),
    NameRule("title", "title|salutation|name_prefix"),
    NameRule("gender", "gender|sex"),
    NameRule("create-dt", "(created|creation|signup|registered)_?(at|on|dt|date|ts|time)"),
    NameRule("update-dt", "(updated|modified|changed)_?(at|on|dt|date|ts|time)"),
    NameRule("pk", "uuid|guid|id|pk"),
]

UUID_PATTERN = "(^|_)(uuid|guid)(_|$)"


def snake_case(name: Column) -> Column:
    """``lastName`` as ``last_name``."""
    return F.lower(F.regexp_replace(name, "([a-z])([A-Z])", "$1_$2"))


def name_semantic(name: Column, rules: list[NameRule] = NAME_RULES) -> Column:
    """Semantic of a column by its name, null for names no rule knows.

    The rules become one conditional expression, so a catalogue of any size is classified in the scan. A name no
    rule fits is settled by the first, joint pattern.
    """
    joint = f"(^|_)({'|'.join(r.words for r in rules)})(_|$)"

    def chain(snake: Column) -> Column:
        found = F.coalesce(*[F.when(snake.rlike(r.pattern), F.lit(r.semantic)) for r in rules])
        return F.when(snake.rlike(joint), found)

    return bind(snake_case(name), chain)


@dataclass(frozen=True)
class ValuePattern:
    """What a value looks like, and a short pattern found in every such value that is quick to look for."""

    pattern: str
    hint: str


# Where two could start at the same place, the earlier one is taken.
VALUE_PATTERNS = {
    "email": ValuePattern(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}", "@"),
    "ipv4": ValuePattern(r"[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}", r"[0-9]\.[0-9]"),
    "card": ValuePattern(r"[0-9]{4}[ -]?[0-9]{4}[ -]?[0-9]{4}[ -]?[0-9]{4}", "[0-9]{4}"),
    "date": ValuePattern(r"[0-9]{4}-[0-9]{2}-[0-9]{2}", "[0-9]{4}-"),
    # With or without country code, brackets round the area code, and blanks, dots or hyphens between the groups.
    "phone": ValuePattern(r"(?:\+[0-9]{1,3}[ .-]?)?(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}", "[ .-][0-9]{4}"),
}


def any_pattern(patterns: Mapping[str, ValuePattern] = VALUE_PATTERNS) -> str:
    """One pattern that fits whatever any of the patterns fits."""
    return "|".join(f"(?:{p.pattern})" for p in patterns.values())


def may_hold(text: Column, patterns: Mapping[str, ValuePattern] = VALUE_PATTERNS) -> Column:
    """False for texts in which none of the patterns can be found."""
    return text.rlike("|".join(f"(?:{p.hint})" for p in patterns.values()))


def holds(text: Column, pattern: ValuePattern) -> Column:
    """True if the pattern is found in the text."""
    return text.rlike(pattern.hint) & text.rlike(pattern.pattern)


def value_kind(value: Column, patterns: Mapping[str, ValuePattern] = VALUE_PATTERNS) -> Column:
    """Name of the first pattern that fits the whole value."""
    return F.coalesce(*[F.when(value.rlike(f"^(?:{p.pattern})$"), F.lit(name)) for name, p in patterns.items()])
