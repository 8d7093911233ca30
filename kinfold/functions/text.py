"""Text, pattern and date functions as column expressions."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from kinfold import vocabulary as V


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and use it several times inside ``body``."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def clean(low: Column) -> Column:
    """White space runs collapsed to one blank, ends trimmed. Plain printable text with single inner blanks is left."""
    return F.when(low.rlike(r"^ |  | $|[^\x20-\x7e]"), F.trim(F.regexp_replace(low, V.WHITESPACE, " "))).otherwise(low)


def normalize(text: Column) -> Column:
    """Lower case, white space runs collapsed to one blank, ends trimmed."""
    return let(F.lower(text), clean)


def strip(text: Column) -> Column:
    """Trim any white space from both ends."""
    return F.when(text.rlike(r"^[^!-~]|[^!-~]$"),
                  F.regexp_replace(text, f"^{V.WHITESPACE}|{V.WHITESPACE}$", "")).otherwise(text)


def _by_alphabet(text: Column, plain: Column, unicode: Column) -> Column:
    """``plain`` for ASCII text, where it gives the same result as the much slower ``unicode``."""
    return F.when(F.octet_length(text) == F.char_length(text), plain).otherwise(unicode)


def _found(text: Column, pattern: str) -> Column:
    hit = _by_alphabet(text, F.regexp_extract(text, pattern, 0), F.regexp_extract(text, "(?iU)" + pattern, 0))
    return F.when(hit != "", hit)


def _matches(text: Column, pattern: str) -> Column:
    return _by_alphabet(text, text.rlike("(?i)" + pattern), text.rlike("(?iU)" + pattern))


_SIGNAL_PATTERNS = {"bank": [V.IBAN_PATTERN, V.SWIFT_PATTERN], "net": [V.IPV4_PATTERN]}
#: The same patterns by the name of the field that they fill.
SIGNAL_FIELDS = {"bank": ["iban", "swift"], "net": ["ipv4"]}


def find_iban(text: Column) -> Column:
    return _found(F.upper(text), V.IBAN_PATTERN)


def find_swift(text: Column) -> Column:
    return _found(F.upper(text), V.SWIFT_PATTERN)


def find_ipv4(text: Column) -> Column:
    return _found(text, V.IPV4_PATTERN)


def find_ipv6(text: Column) -> Column:
    """The whole text when it holds a colon and an address-like run."""
    return F.when(F.contains(text, F.lit(":")) & _matches(text, V.IPV6_PATTERN), text)


def has_word(lowered: Column, kind: str) -> Column:
    """True when a lower-cased text holds a keyword of ``kind``."""
    return reduce(lambda a, b: a | b, [F.contains(lowered, F.lit(word)) for word in V.KEYWORDS[kind]])


def text_has_word(text: Column, kind: str) -> Column:
    return let(F.lower(text), lambda low: has_word(low, kind))


def has_shape(text: Column, kind: str) -> Column:
    """True when a text matches one of the patterns of ``kind``."""
    return reduce(lambda a, b: a | b, [_matches(text, p) for p in _SIGNAL_PATTERNS[kind]])


def has_signal(text: Column, kind: str) -> Column:
    """True when a string value speaks for ``kind``: a keyword, or one of the kind's patterns."""
    return text_has_word(text, kind) | has_shape(text, kind)


def lines_with(lowered: Column, kind: str, words: bool, shape: bool) -> Column:
    """Lines of lower-cased ASCII text with a keyword (``words``) or a pattern (``shape``) of ``kind``: each match takes the rest of its line."""
    signs = [*(V.KEYWORDS[kind] if words else []), *(_SIGNAL_PATTERNS[kind] if shape else [])]
    return F.regexp_count(lowered, F.lit(f"(?i)(?:{'|'.join(signs)})[^\n]*"))


def may_match(joined: Column, kind: str, hits: dict[str, Column]) -> Column:
    """``has_shape`` of the joined strings, from what the patterns found in them where they are ASCII text."""
    found = reduce(lambda a, b: a | b, [hits[name].isNotNull() for name in SIGNAL_FIELDS[kind]])
    return _by_alphabet(joined, found, has_shape(joined, kind))


def email_domain(email: Column) -> Column:
    """Everything after the first ``@``; null without one or when nothing follows."""
    domain = strip(F.lower(F.when(F.instr(email, "@") > 0, F.substr(email, F.instr(email, "@") + 1))))
    return F.when(domain != "", domain)


def company_from_domain(domain: Column) -> Column:
    """Company label of a mail domain; null for free-mail providers."""
    def label(lowered: Column) -> Column:
        parts = F.filter(F.split(lowered, r"\."), lambda p: ~p.isin(V.DOMAIN_PREFIXES))
        base = let(parts, lambda ps: F.when(F.size(ps) >= 2, F.try_element_at(ps, F.lit(-2)))
                   .otherwise(F.get(ps, F.lit(0))))
        named = let(base, lambda b: F.when(b != "", F.concat(F.upper(F.substring(b, 1, 1)),
                                                             F.lower(F.substr(b, F.lit(2))))))
        return F.when(~lowered.isin(V.FREE_MAIL_DOMAINS), named)
    return F.when(domain.isNotNull(), let(F.lower(domain), label))


def iban_country_code(iban: Column) -> Column:
    return F.when(F.length(iban) >= 2, F.upper(F.substring(iban, 1, 2)))


def country_name(code: Column) -> Column:
    names = F.create_map(*[F.lit(x) for pair in V.IBAN_COUNTRIES.items() for x in pair])
    return F.try_element_at(names, code)


def as_timestamp(value: Column) -> Column:
    """ISO text to timestamp, UTC when it names no zone; null when it is no timestamp."""
    return F.try_to_timestamp(value.cast("string"))


def percent(part: Column, whole: Column) -> Column:
    """``part`` as a percentage of ``whole``; 0 when the whole is 0."""
    return F.coalesce(F.try_divide(part * F.lit(100.0), whole), F.lit(0.0))


def column_name(name: Column) -> Column:
    """Turn any key into a safe column name."""
    base = F.regexp_replace(strip(name), "[^a-zA-Z0-9_]+", "_")
    base = F.regexp_replace(F.lower(F.regexp_replace(base, "^_+|_+$", "")), "__+", "_")
    return (F.when(F.coalesce(base, F.lit("")) == "", "col")
            .when(base.rlike("^[0-9]"), F.concat(F.lit("c_"), base))
            .otherwise(base))
