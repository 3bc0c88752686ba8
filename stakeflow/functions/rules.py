"""Validation rules for columns: each maps a Column to a boolean Column; null fails."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

Rule = Callable[[Column], Column]

# Patterns of the format rules.
EMAIL = r"^[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}$"
URL = r"(?i)^(https?|ftp)://[^\s/$.?#].[^\s]*$"
PHONE = {None: r"^\+?[0-9]{7,15}$", "US": r"^(\+1)?[0-9]{10}$", "FR": r"^(\+33|0)[0-9]{9}$"}
POSTAL = {
    "US": r"^\d{5}(-\d{4})?$",
    "CA": r"^[A-Z]\d[A-Z]\s?\d[A-Z]\d$",
    "UK": r"^[A-Z]{1,2}\d{1,2}\s?\d[A-Z]{2}$",
    "FR": r"^\d{5}$",
    "DE": r"^\d{5}$",
}
IPV4 = r"(?:(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])\.){3}(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])"


def _ipv6() -> str:
    h = "[0-9a-fA-F]{1,4}"
    forms = [f"(?:{h}:){{7}}{h}", f"(?:{h}:){{1,7}}:", f":(?::{h}){{1,7}}", "::"]
    forms += [f"(?:{h}:){{{a}}}(?::{h}){{1,{7 - a}}}" for a in range(1, 7)]
    return "^(?:" + "|".join(forms) + ")$"


IPV6 = _ipv6()


def not_empty() -> Rule:
    return lambda c: F.regexp_replace(c.cast("string"), r"[\s\p{Z}]+", "") != ""


def in_range(low=None, high=None) -> Rule:
    def check(c: Column) -> Column:
        ok = c.isNotNull()
        if low is not None:
            ok = ok & (c >= low)
        return ok & (c <= high) if high is not None else ok
    return check


def length_between(low=None, high=None) -> Rule:
    return lambda c: in_range(low, high)(F.length(c))


def email() -> Rule:
    def check(c: Column) -> Column:
        local, domain = F.regexp_extract(c, "^(.*)@", 1), F.regexp_extract(c, "@([^@]*)$", 1)
        return (c.rlike(EMAIL) & (F.length(local) <= 64) & ~local.rlike(r"^\.|\.$|\.\.")
                & (F.length(domain) <= 255) & ~domain.rlike("^-|-$"))
    return check


def phone(country: str | None = None) -> Rule:
    def check(c: Column) -> Column:
        digits = F.regexp_replace(c, r"[\s\-\(\)\.]", "")
        ok = digits.rlike(PHONE[None])
        country_ = country.upper() if country else None
        return ok & digits.rlike(PHONE[country_]) if country_ in PHONE and country_ else ok
    return check


def url(schemes: tuple[str, ...] = ("http", "https")) -> Rule:
    return lambda c: c.rlike(URL) & F.lower(F.split_part(c, F.lit("://"), F.lit(1))).isin(*schemes)


def uuid(version: int | None = None) -> Rule:
    def check(c: Column) -> Column:
        bare = F.regexp_replace(F.regexp_replace(c, "urn:|uuid:", ""), r"^[{}]+|[{}]+$|-", "")
        ok = bare.rlike("^[0-9a-fA-F]{32}$")
        return ok & (F.substring(bare, 13, 1) == str(version)) & bare.rlike("^.{16}[89abAB]") if version else ok
    return check


def date(pattern: str = "yyyy-M-d", shape: str = r"^\d{4}-\d{1,2}-\d{1,2}$") -> Rule:
    return lambda c: c.rlike(shape) & F.try_to_timestamp(c, F.lit(pattern)).isNotNull()


def ip(version: int | None = None) -> Rule:
    def check(c: Column) -> Column:
        v4 = c.rlike(f"^{IPV4}$")
        v6 = F.regexp_replace(c, f"(?<=:){IPV4}$", "0:0").rlike(IPV6)
        return {4: v4, 6: v6}.get(version, v4 | v6)
    return check


def json() -> Rule:
    return lambda c: F.try_parse_json(c).isNotNull()


def postal_code(country: str = "US") -> Rule:
    pattern = POSTAL.get(country.upper())
    return lambda c: F.upper(c).rlike(pattern) if pattern else F.lit(False)


def username(low: int = 3, high: int = 30, special: bool = False) -> Rule:
    body = r"^[a-zA-Z0-9_\-\.]+$" if special else "^[a-zA-Z0-9_]+$"
    return lambda c: (F.length(c).between(low, high) & c.rlike(body) & ~c.rlike(r"^[._-]|[._-]$|[._-]{2,}"))


# Named rules of the quality scans; users add their own with register_rule.
RULES: dict[str, Callable[..., Rule]] = {
    "not_empty": not_empty, "range": in_range, "length": length_between, "email": email, "phone": phone, "url": url,
    "uuid": uuid, "date": date, "ip": ip, "json": json, "postal_code": postal_code, "username": username,
}


def register_rule(name: str, rule: Rule) -> None:
    """Add a user rule; a pandas UDF registered on the session works as well as a Column expression."""
    RULES[name] = lambda: rule


def resolve(spec: str | tuple) -> Rule:
    """Rule from its name or (name, arguments...); an unknown name is an error."""
    name, *args = (spec,) if isinstance(spec, str) else spec
    if name not in RULES:
        raise ValueError(f"unknown rule {name!r}, expected one of {sorted(RULES)}")
    return RULES[name](*args)
