"""Regular expressions in linear-time (RE2) syntax, run by Spark's ``rlike``."""

from __future__ import annotations

import re

import regex

# Constructs the linear-time dialect does not have, or means otherwise than Java.
_UNSUPPORTED = re.compile(r"\(\?(?:=|!|<=|<!|>)|(?<!\\)(?:\\\\)*\\(?:[1-9]|k<)|[*+?}]\+|\(\?[a-zA-Z]*U")
_POSIX = {"alnum": "Alnum", "alpha": "Alpha", "ascii": "ASCII", "blank": "Blank", "cntrl": "Cntrl", "digit": "Digit", "graph": "Graph",
          "lower": "Lower", "print": "Print", "punct": "Punct", "space": "Space", "upper": "Upper", "xdigit": "XDigit"}
_PIECE = re.compile(
    r"""(?P<quoted>\\Q(?P<body>.*?)(?:\\E|\Z))
      | (?P<hex>\\x\{(?P<code>[0-9A-Fa-f]+)\})
      | (?P<script>\\(?P<not>[pP])\{(?P<inverse>\^?)(?P<name>\w+)\})
      | (?P<escaped>\\.)
      | (?P<posix>\[:(?P<negated>\^?)(?P<set>\w+):\])
      | (?P<group>\(\?P?<[A-Za-z_]\w*>)
      | (?P<other>.)""",
    re.VERBOSE | re.DOTALL,
)


def _pieces(pattern: str):
    """Pieces of a pattern, each with whether it stands inside a character class."""
    inside = False
    for m in _PIECE.finditer(pattern):
        kind, text = m.lastgroup, m[0]
        if m["quoted"]:
            kind = "quoted"
        elif m["hex"]:
            kind = "hex"
        elif m["script"]:
            kind = "script"
        elif m["posix"]:
            kind = "posix" if inside else "other"
        if kind == "posix" or text not in ("[", "]"):
            yield kind, m, inside
        elif text == "[" and not inside:
            yield "open", m, False
            inside = True
        elif text == "]" and inside:
            yield "close", m, True
            inside = False
        else:
            yield "literal", m, inside


def pattern_error(pattern: str) -> str | None:
    """Why a pattern is rejected, or None when it is fine."""
    if _UNSUPPORTED.search(re.sub(r"\\Q.*?(?:\\E|\Z)", "", pattern, flags=re.DOTALL)):
        return "look-around, back-references, possessive quantifiers and the U flag are not supported"
    out = []
    for kind, m, inside in _pieces(pattern):
        if kind == "quoted":
            out.append(regex.escape(m["body"]))
        elif kind == "hex":
            if int(m["code"], 16) > 0x10FFFF:
                return f"no such character: {m[0]}"
            out.append(regex.escape(chr(int(m["code"], 16))))
        elif kind == "posix" and m["set"] not in (*_POSIX, "word"):
            return f"unknown character class {m[0]}"
        elif kind == "group":
            out.append("(")
        else:
            out.append("\\Z" if m[0] == "\\z" else "\\[" if kind == "literal" and m[0] == "[" else m[0])
    try:
        regex.compile("".join(out))
    except regex.error as err:
        return str(err)
    return None


def java_pattern(pattern: str) -> str:
    """The same pattern for Java.

    Only ``\\n`` ends a line, ``$`` without the m flag is the end of the text, POSIX sets and scripts are spelled Java's way, ``[`` and
    ``&&`` in a class are plain characters, and groups lose their names.
    """
    multiline = re.search(r"\(\?[a-zA-Z]*m", pattern) is not None
    out = ["(?d)"]
    for kind, m, inside in _pieces(pattern):
        text = m[0]
        if kind == "posix":
            name = "w" if m["set"] == "word" else None
            letter = "P" if m["negated"] else "p"
            text = ("\\W" if m["negated"] else "\\w") if name else f"\\{letter}{{{_POSIX[m['set']]}}}"
        elif kind == "script":
            letter = m["not"] if not m["inverse"] else {"p": "P", "P": "p"}[m["not"]]
            name = m["name"] if len(m["name"]) <= 2 else "Is" + m["name"]
            text = f"\\{letter}{{{name}}}"
        elif kind == "group":
            text = "("
        elif kind == "literal" and text == "[":
            text = "\\["
        elif text == "&" and inside:
            text = "\\&"
        elif text == "$" and not inside and not multiline:
            text = "\\z"
        out.append(text)
    return "".join(out)
