"""Number, duration and quoting text in the style alert values are printed in.

Values such as ``185 > 100`` or ``avg(cpu,1m0s)=93.5 > 90`` are user visible and
stored with incidents, so doubles print without a trailing ``.0`` and switch to an
exponent below 1e-4 and from 1e6 on.
"""

from __future__ import annotations

import math
from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

_NS = {"h": 3_600_000_000_000, "m": 60_000_000_000, "s": 1_000_000_000}


def _strip_zeros(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, r"(\.\d*?)0+$", "$1"), r"\.$", "")


def double_text(value: Column) -> Column:
    """Shortest decimal text of a DOUBLE column (NULL in, NULL out)."""
    d = value.cast("double")
    size = F.abs(d)
    # JVMs before 19 print some doubles with one digit too many; 16 digits do if they read back equal.
    printed, rounded = d.cast("string"), F.format_string("%.15E", d)
    raw = F.when((F.length(printed) > 17) & (rounded.try_cast("double") == d), rounded).otherwise(printed)
    plain = raw.try_cast("decimal(38,25)").cast("string")
    # Between 1e6 and 1e7 the JVM prints no exponent yet: the point moves by six places.
    exponent = F.coalesce(F.regexp_extract(raw, r"E\+?(-?\d+)$", 1).try_cast("int"), F.lit(6))
    mantissa = F.regexp_replace(F.regexp_replace(raw, r"E[+-]?\d+$", ""), r"^(-?\d)(\d{6})\.", "$1.$2")
    scientific = F.concat(
        _strip_zeros(mantissa),
        F.when(exponent < 0, F.lit("e-")).otherwise(F.lit("e+")),
        F.format_string("%02d", F.abs(exponent)),
    )
    return (
        F.when(F.isnan(d), F.lit("NaN"))
        .when(d == F.lit(math.inf), F.lit("+Inf"))
        .when(d == F.lit(-math.inf), F.lit("-Inf"))
        .when(d == 0, F.lit("0"))
        .when((size < 1e-4) | (size >= 1e6), scientific)
        .otherwise(_strip_zeros(plain))
    )


def double_literal(value: float) -> str:
    """Plan-time twin of :func:`double_text` for rule constants."""
    v = float(value)
    if math.isnan(v):
        return "NaN"
    if math.isinf(v):
        return "+Inf" if v > 0 else "-Inf"
    if v == 0:
        return "0"
    d = Decimal(repr(v))
    exponent = d.adjusted()
    if -4 <= exponent < 6:
        text = format(d, "f")
        return text.rstrip("0").rstrip(".") if "." in text else text
    digits = "".join(map(str, d.as_tuple().digits)).rstrip("0")
    head = digits[0] + ("." + digits[1:] if len(digits) > 1 else "")
    return f"{'-' if v < 0 else ''}{head}e{'-' if exponent < 0 else '+'}{abs(exponent):02d}"


def duration_text(ns: int) -> str:
    """``5400000000000`` -> ``1h30m0s``; sub-second amounts use ms, µs or ns."""
    if ns == 0:
        return "0s"
    sign, n = ("-", -ns) if ns < 0 else ("", ns)
    if n < _NS["s"]:
        for unit, size in (("ms", 1_000_000), ("µs", 1_000), ("ns", 1)):
            if n >= size:
                return f"{sign}{_fraction(n, size)}{unit}"
    hours, rest = divmod(n, _NS["h"])
    minutes, rest = divmod(rest, _NS["m"])
    text = f"{_fraction(rest, _NS['s'])}s"
    if hours:
        text = f"{hours}h{minutes}m{text}"
    elif minutes:
        text = f"{minutes}m{text}"
    return sign + text


def _fraction(n: int, size: int) -> str:
    whole, part = divmod(n, size)
    if not part:
        return str(whole)
    return f"{whole}.{str(part).zfill(len(str(size)) - 1).rstrip('0')}"


def quoted(text: str) -> str:
    """Double-quoted text with backslash escapes, as shown in pattern values."""
    named = {'"': '\\"', "\\": "\\\\", "\n": "\\n", "\t": "\\t", "\r": "\\r",
             "\a": "\\a", "\b": "\\b", "\f": "\\f", "\v": "\\v"}
    out = []
    for ch in text:
        if ch in named:
            out.append(named[ch])
        elif ch.isprintable():
            out.append(ch)
        elif ord(ch) < 0x80:
            out.append(f"\\x{ord(ch):02x}")
        elif ord(ch) < 0x10000:
            out.append(f"\\u{ord(ch):04x}")
        else:
            out.append(f"\\U{ord(ch):08x}")
    return '"' + "".join(out) + '"'
