"""Scalar helpers built from Spark built-ins only (JVM-side, codegen'd)."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column
from pyspark.sql import functions as F


def line_count(c: Column) -> Column:
    """Number of '\\n'-separated pieces (newlines + 1); null for null."""
    return (F.length(c) - F.length(F.replace(c, F.lit("\n"), F.lit("")))) + F.lit(1)


def grams(c: Column, size: int) -> Column:
    """Distinct substrings of ``size`` characters.

    A look-ahead moves along the text once; ``substr`` at every place would
    walk from the start of the text each time.
    """
    return F.array_distinct(F.regexp_extract_all(c, F.lit(f"(?s)(?=(.{{{size}}}))"), F.lit(1)))


def ws_trim(c: Column) -> Column:
    """Strip leading/trailing whitespace (Spark's trim strips spaces only)."""
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def html_escape(c: Column) -> Column:
    """Escape & < > \" for HTML text."""
    out = F.replace(c, F.lit("&"), F.lit("&amp;"))
    out = F.replace(out, F.lit("<"), F.lit("&lt;"))
    out = F.replace(out, F.lit(">"), F.lit("&gt;"))
    return F.replace(out, F.lit('"'), F.lit("&quot;"))


def csv_field(c: Column) -> Column:
    """Quote a CSV field only when it holds a comma, quote or newline; double quotes."""
    s = F.coalesce(c.cast("string"), F.lit(""))
    needs = s.contains(",") | s.contains('"') | s.contains("\n")
    return F.when(needs, F.concat(F.lit('"'), F.replace(s, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(s)


def cwe_url(cwe: Column) -> Column:
    return F.concat(F.lit("https://cwe.mitre.org/data/definitions/"),
                    F.replace(cwe, F.lit("CWE-"), F.lit("")), F.lit(".html"))


def hmac_sha256_hex(msg: Column, secret: str) -> Column:
    """HMAC-SHA256 (hex) of a string column with a fixed key, built-ins only.

    The key pads are computed once on the driver from the (tiny) secret;
    every row then costs two SHA-256 passes inside codegen.
    """
    key = secret.encode("utf-8")
    if len(key) > 64:
        key = hashlib.sha256(key).digest()
    key = key.ljust(64, b"\0")
    ipad = bytes(b ^ 0x36 for b in key).hex()
    opad = bytes(b ^ 0x5C for b in key).hex()
    inner = F.unhex(F.sha2(F.concat(F.unhex(F.lit(ipad)), F.encode(msg, "UTF-8")), 256))
    return F.sha2(F.concat(F.unhex(F.lit(opad)), inner), 256)


def nano_to_usd(nano: Column) -> Column:
    """Exact nano-USD integer → USD double (one correctly rounded division)."""
    return nano.cast("double") / F.lit(1e9)


def nano_round4(nano: Column) -> Column:
    """Nano-USD → USD rounded half-up to 4 decimals, exact in integers."""
    return F.floor((nano + F.lit(50000)) / F.lit(100000)).cast("double") / F.lit(1e4)


def fmt4(x: Column) -> Column:
    """Fixed 4-decimal text of a double that is already a multiple of 1e-4."""
    return F.format_string("%.4f", x)
