"""Domain name expressions."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Two-label public suffixes that keep three labels in the apex.
TWO_LABEL_SUFFIXES = (
    "co.uk", "org.uk", "gov.uk", "ac.uk", "me.uk", "net.uk",
    "co.jp", "co.nz", "co.za", "co.in", "co.kr", "co.il",
    "com.au", "net.au", "org.au", "edu.au", "gov.au",
    "com.br", "com.mx", "com.cn", "com.tw", "com.sg", "com.hk",
)

# Suffixes never reported when the site profile names none.
DEFAULT_BENIGN_SUFFIXES = (
    "google.com", "gstatic.com", "googleapis.com", "microsoft.com", "windowsupdate.com",
    "apple.com", "icloud.com", "cloudflare.com", "akamai.net", "amazonaws.com",
    "netflix.com", "mozilla.org", "ubuntu.com", "debian.org", "github.com",
    "facebook.com", "fbcdn.net", "instagram.com", "cdninstagram.com",
    "pool.ntp.org", "in-addr.arpa", "ip6.arpa", "local", "arpa",
)

# Shape of a generated-looking label.
GENERATED_MIN_LABEL = 12
GENERATED_MIN_ENTROPY = 3.6


def _c(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def clean_domain(raw: Column | str) -> Column:
    """Lower-case name without unprintable characters and trailing dots; null when nothing is left."""
    printable = F.regexp_replace(
        _c(raw), r"[\p{C}\p{Zl}\p{Zp}\x{FFFD}]|[\p{Zs}&&[^ ]]", ""
    )
    return F.nullif(F.lower(F.rtrim(F.trim(printable), F.lit("."))), F.lit(""))


def match_form(domain: Column | str) -> Column:
    """Form used for list matching: trimmed, lower case, no trailing dots."""
    return F.rtrim(F.lower(F.trim(_c(domain))), F.lit("."))


def apex_domain(domain: Column | str) -> Column:
    """Registrable part: the last two labels, three under a listed two-label suffix."""
    c = _c(domain)
    name = F.rtrim(c, F.lit("."))
    labels = F.size(F.split(name, r"\."))
    last_two = F.substring_index(name, ".", -2)
    return (
        F.when(labels < 2, c)
        .when((labels >= 3) & last_two.isin(*TWO_LABEL_SUFFIXES), F.substring_index(name, ".", -3))
        .otherwise(last_two)
    )


def shannon_entropy(text: Column | str) -> Column:
    """Bits per character over the characters of ``text``; 0 for empty text."""
    c = _c(text)
    n = F.length(c)

    def term(ch: Column) -> Column:
        share = (n - F.length(F.replace(c, ch, F.lit("")))) / n
        return share * F.log2(share)

    chars = F.array_distinct(F.split(c, ""))
    total = F.aggregate(F.transform(chars, term), F.lit(0.0), lambda acc, x: acc + x)
    return F.when(n == 0, F.lit(0.0)).otherwise(-total)


def generated_label(domain: Column | str) -> Column:
    """The leftmost label when it has the length and alphabet of a generated one, else null."""
    c = _c(domain)
    label = F.split_part(c, F.lit("."), F.lit(1))
    fits = c.contains(".") & label.rlike(f"^[a-z0-9-]{{{GENERATED_MIN_LABEL},}}$")
    return F.when(fits, label)


def looks_generated(domain: Column | str) -> Column:
    """True for a long, high-entropy leftmost label that is vowel-poor or digit-rich."""
    label = generated_label(domain)
    n = F.length(label)
    digits = F.length(F.regexp_replace(label, "[^0-9]", "")) / n
    vowels = F.length(F.regexp_replace(label, "[^aeiou]", "")) / n
    shape = (vowels < 0.25) | (digits > 0.3)
    return F.coalesce(shape & (shannon_entropy(label) >= GENERATED_MIN_ENTROPY), F.lit(False))


def domain_suffixes(domain: Column | str) -> Column:
    """All suffixes of a name: ``a.b.c`` gives ``c``, ``b.c`` and ``a.b.c``."""
    c = _c(domain)
    return F.transform(
        F.sequence(F.lit(1), F.size(F.split(c, r"\."))),
        lambda i: F.call_function("substring_index", c, F.lit("."), -i),
    )


def under_any(domain: Column, suffixes: Sequence[str]) -> Column:
    """True when ``domain`` equals or lies under one of a short list of suffixes."""
    if not suffixes:
        return F.lit(False)
    return domain.rlike(r"(^|\.)(" + "|".join(re.escape(s) for s in suffixes) + r")$")


def is_benign_domain(domain: Column | str, policy) -> Column:
    """True for names the site profile declares harmless (exact names, or under a suffix)."""
    d = F.rtrim(F.lower(_c(domain)), F.lit("."))
    exact = d.isin(*policy.benign_domains) if policy.benign_domains else F.lit(False)
    return F.coalesce(exact | under_any(d, policy.benign_domain_suffixes), F.lit(False))


def refang(text: Column | str) -> Column:
    """Undo the usual defanging of an indicator."""
    c = F.trim(_c(text))
    # Defanged spelling and its plain form.
    for written, meant in (
        ("[.]", "."), ("(.)", "."), ("[dot]", "."), ("[:]", ":"),
        ("hxxps://", "https://"), ("hxxp://", "http://"),
    ):
        c = F.replace(c, F.lit(written), F.lit(meant))
    return c
