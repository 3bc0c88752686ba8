"""Text functions as Column expressions over whole texts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Character classes written out, so that letters of all languages count as word characters.
WORD = r"\p{L}\p{N}_"
SPACE = r"\s\x{0b}\x{1c}-\x{1f}\x{85}\p{Z}"

# Attack patterns by name; W and S stand for the classes above.
SQL_PATTERNS = {
    "sql_keyword": rf"(?i)(?<![{WORD}])(SELECT|INSERT|UPDATE|DELETE|DROP|CREATE|ALTER|EXEC|EXECUTE)(?![{WORD}])",
    "sql_comment": r"(--|#|/\*|\*/)",
    "sql_or": rf"(?id)(?<![{WORD}])OR(?![{WORD}]).*=",
    "sql_and": rf"(?id)(?<![{WORD}])AND(?![{WORD}]).*=",
    "sql_meta": r"('|--|;|\||&)",
}
XSS_PATTERNS = {
    "xss_script": r"(?id)<script[^>]*>.*?</script>",
    "xss_javascript": r"(?i)javascript:",
    "xss_handler": rf"(?i)on[{WORD}]+[{SPACE}]*=",
    "xss_iframe": r"(?i)<iframe",
    "xss_object": r"(?i)<object",
    "xss_embed": r"(?i)<embed",
}

# Card brands by number prefix, and the candidate patterns of the PII scan.
CARD_BRANDS = (("visa", "^4"), ("mastercard", "^5[1-5]"), ("amex", "^3[47]"), ("discover", "^6011"))
EMAIL_CANDIDATE = r"[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}"
CARD_CANDIDATE = r"[0-9]{4}(?:[ -][0-9]{4}){3}(?:[ -][0-9]{3}\b)?|[0-9]{4}[ -][0-9]{6}[ -][0-9]{5}|[0-9]+"
PHONE_CANDIDATE = r"\+[0-9]{1,3}[ .-]?\(?[0-9]{1,4}\)?(?:[ .-]?[0-9]{2,4}){2,3}|\(?[0-9]{2,4}\)?[ .-][0-9]{3,4}[ .-][0-9]{4}|\(?[0-9]{2,4}\)?(?:[ .-][0-9]{2}){3,4}"
CARD_GROUPS = r"[0-9]{4}(?:[ -][0-9]{4}){3}(?:[ -][0-9]{3}\b)?|[0-9]{4}[ -][0-9]{6}[ -][0-9]{5}"


def strip(c: Column) -> Column:
    return F.regexp_replace(c, rf"^[{SPACE}]+|[{SPACE}]+$", "")


def clean_text(c: Column, max_length: int | None = None, keep_tags: bool = False) -> Column:
    """Drop control characters, script blocks, event handlers, script URLs and tags; trim."""
    c = F.regexp_replace(c, r"[\x{00}-\x{08}\x{0b}\x{0c}\x{0e}-\x{1f}]", "")
    c = F.regexp_replace(c, r"(?is)<script[^>]*>.*?</script>", "")
    c = F.regexp_replace(c, rf"(?i)[{SPACE}]*on[{WORD}]+[{SPACE}]*=[{SPACE}]*[\"'][^\"']*[\"']", "")
    c = F.regexp_replace(c, r"(?i)javascript:", "")
    if not keep_tags:
        c = F.regexp_replace(c, r"<[^>]+>", "")
    if max_length:
        c = F.substring(c, 1, max_length)
    return strip(c)


def slugify(c: Column, max_length: int = 50, sep: str = "-") -> Column:
    c = F.regexp_replace(c, rf"[^{WORD}{SPACE}-]", "")
    c = F.regexp_replace(c, rf"[{SPACE}_]+", sep)
    c = F.lower(F.regexp_replace(c, f"{sep}+", sep))
    return F.regexp_replace(F.substring(c, 1, max_length), f"^{sep}+|{sep}+$", "")


def truncate_words(c: Column, length: int, suffix: str = "...") -> Column:
    """Cut at the last space; the suffix counts towards the length."""
    head = F.substring(c, 1, length - len(suffix))
    back = F.locate(" ", F.reverse(head))
    cut = F.length(head) - back
    word = F.when((back > 0) & (cut > 0), F.substr(head, F.lit(1), cut)).otherwise(head)
    return F.when(F.length(c) <= length, c).otherwise(F.concat(word, F.lit(suffix)))


def row_hash(c: Column, algo: str) -> Column:
    if algo not in ("md5", "sha1", "sha256", "sha512"):
        raise ValueError(f"unsupported hash {algo!r}")
    b = F.encode(c, "UTF-8")
    return {"md5": F.md5, "sha1": F.sha1, "sha256": lambda x: F.sha2(x, 256), "sha512": lambda x: F.sha2(x, 512)}[algo](b)


def query_params(url: Column) -> Column:
    """Map of query parameters to their non-empty values, in order."""
    q = F.regexp_extract(url, r"\?([^#]*)", 1)

    def decode(x: Column) -> Column:
        once = F.try_url_decode(x)
        return F.coalesce(F.try_url_decode(F.replace(once, F.lit("+"), F.lit("%2B"))), once, x)

    pairs = F.filter(
        F.transform(F.split(q, "&"), lambda p: F.struct(
            # a key with a broken escape stays as it is
            F.coalesce(F.try_url_decode(F.split_part(p, F.lit("="), F.lit(1))), F.split_part(p, F.lit("="), F.lit(1))).alias("k"),
            decode(F.regexp_extract(p, "=(.*)$", 1)).alias("v"))),
        lambda x: (x["v"] != "") & x["k"].isNotNull())
    keys = F.array_distinct(F.transform(pairs, lambda x: x["k"]))
    values = F.transform(keys, lambda k: F.transform(F.filter(pairs, lambda x: x["k"] == k), lambda x: x["v"]))
    return F.map_from_arrays(keys, values)


def json_fields(text: Column, paths: dict[str, str], default: str | None = None) -> list[Column]:
    """Named strings at paths of a JSON text, ``default`` where a path leads nowhere, and ``valid``; broken texts give nulls or defaults."""
    v = F.try_parse_json(text)
    found = [F.try_variant_get(v, path, "string") for path in paths.values()]
    return [*[(c if default is None else F.coalesce(c, F.lit(default))).alias(n) for n, c in zip(paths, found)], v.isNotNull().alias("valid")]


def luhn(digits: Column) -> Column:
    """True where a digit string passes the Luhn check."""
    rev = F.reverse(digits)
    total = F.aggregate(
        F.sequence(F.lit(1), F.length(digits)), F.lit(0),
        lambda acc, i: acc + F.when(i % 2 == 1, F.substr(rev, i, F.lit(1)).cast("int")).otherwise(
            F.substr(rev, i, F.lit(1)).cast("int") * 2 - F.when(F.substr(rev, i, F.lit(1)).cast("int") > 4, 9).otherwise(0)))
    return total % 10 == 0


def cards(text: Column) -> Column:
    """Valid card numbers of a text, separators removed."""
    found = F.transform(F.regexp_extract_all(text, F.lit(CARD_CANDIDATE), F.lit(0)), lambda x: F.regexp_replace(x, "[ -]", ""))
    sized = F.filter(found, lambda x: F.length(x).between(13, 19))
    # sixteen digits and three more may be a card and its check value
    whole = F.transform(sized, lambda x: F.when((F.length(x) == 19) & ~luhn(x), F.substring(x, 1, 16)).otherwise(x))
    return F.filter(whole, luhn)


def phones(text: Column) -> Column:
    """Phone numbers of a text, outside of card numbers in groups, separators removed."""
    text = F.regexp_replace(text, CARD_GROUPS, "_")
    found = F.transform(F.regexp_extract_all(text, F.lit(PHONE_CANDIDATE), F.lit(0)), lambda x: F.regexp_replace(x, r"[\s\-\(\)\.]", ""))
    return F.filter(found, lambda x: x.rlike(r"^\+?[0-9]{7,15}$"))


def number_text(c: Column, pattern: str) -> Column:
    return F.call_function("format_number", c, F.lit(pattern))


# Currency symbols; those in front of the amount.
CURRENCY_SYMBOLS = {"USD": "$", "EUR": "€", "GBP": "£", "JPY": "¥", "CHF": "Fr", "CAD": "C$", "AUD": "A$"}
SYMBOL_FIRST = ("USD", "GBP", "CAD", "AUD")
# Duration units in seconds, largest first; size units.
DURATION_UNITS = (("y", 31536000), ("mo", 2592000), ("w", 604800), ("d", 86400), ("h", 3600), ("m", 60), ("s", 1))
SIZE_UNITS = ("B", "KB", "MB", "GB", "TB", "PB")


def currency_text(amount: Column, code: Column) -> Column:
    num, code = number_text(amount, "#,##0.00"), F.upper(code)
    symbol = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in CURRENCY_SYMBOLS.items() for x in kv]), code),
                        F.concat(code, F.lit(" ")))
    return F.when(code.isin(*SYMBOL_FIRST), F.concat(symbol, num)).otherwise(F.concat(num, F.lit(" "), symbol))


def percent_text(v: Column) -> Column:
    """Values up to 1 in size are shares and are scaled to percent."""
    return F.concat(number_text(F.when(F.abs(v) <= 1, v * 100).otherwise(v), "0.00"), F.lit("%"))


def duration_text(seconds: Column, precision: int = 2) -> Column:
    left, parts = F.greatest(seconds.cast("long"), F.lit(0)), []
    for name, size in DURATION_UNITS:
        n = F.floor(left / size)
        parts.append(F.when(n > 0, F.concat(n.cast("string"), F.lit(name))))
        left = left % size
    text = F.array_join(F.slice(F.array_compact(F.array(*parts)), 1, precision), " ")
    return F.when(text == "", "0s").otherwise(text)


def size_text(size: Column) -> Column:
    v = size.cast("double")
    out = F.concat(number_text(v / 1e15, "0.00"), F.lit(" PB"))
    for i in range(len(SIZE_UNITS) - 2, -1, -1):
        out = F.when(F.abs(v) < 1000.0 ** (i + 1), F.concat(number_text(v / 1000.0**i, "0.00"), F.lit(f" {SIZE_UNITS[i]}"))).otherwise(out)
    return out


# Texts read as flags, and units of size texts (powers of 1024).
TRUE_TEXTS = ("true", "yes", "on", "1", "y", "t")
FALSE_TEXTS = ("false", "no", "off", "0", "n", "f")
SIZE_POWERS = ("B", "KB", "MB", "GB", "TB", "PB", "EB")


def parse_flag(c: Column, default: bool = False) -> Column:
    v = strip(F.lower(c))
    return F.when(v.isin(*TRUE_TEXTS), True).when(v.isin(*FALSE_TEXTS), False).otherwise(F.lit(default))


def parse_size(c: Column) -> Column:
    """Bytes of a text such as 1.5 MB; null where the text is not a size."""
    t = strip(F.upper(c))
    pat = r"^([0-9.]+)[\s]*([A-Z]+)$"
    number = F.regexp_extract(t, pat, 1).try_cast("double")
    unit = F.element_at(F.create_map(*[F.lit(x) for i, u in enumerate(SIZE_POWERS) for x in (u, 1024.0**i)]), F.regexp_extract(t, pat, 2))
    return F.floor(number * unit).cast("long")
