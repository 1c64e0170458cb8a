"""Boolean rule expressions as Spark SQL text.

Rules are written as Spark SQL conditions over ``record.field`` / ``record["field"]``.
A handful of spellings are accepted on top and replaced token by token, outside string
literals: ``&& || ! == !=``, ``"text"``, ``nil``, ``[a, b]`` lists, the infix tests
``contains / startsWith / endsWith / matches / in``, ``len``, ``regex_match(field,
pattern)`` and the window helpers ``avg_over(field, "30d")``. Everything else is Spark SQL;
Catalyst parses, types and optimises it.

A missing field is NULL: comparing the field itself with ``==`` or ``!=`` is null-safe, any other
use makes the verdict NULL, i.e. no tick at all. Two fields are equal if both are numbers, texts or booleans and
equal, or both are missing. Division follows floating point: ``x / 0`` is infinite, and comparing ``0 / 0`` is false in
scheduled rules and no verdict in push rules. ``a ? b : c`` is a conditional.

Fields nest: ``record.user.name``, ``record.user?.name``, ``record.tags[0]``. ``"a" in record.tags`` and ``len(record.tags)`` look into lists. On a typed table a
path through a value without members (``record.value.x`` of a number) is an error of the rule. A text that is no number has no value where
a number is needed (``int(record.n)``). Spellings of other rule languages (``??``, ``**``, ``..``, ``max(a, b)``, ``any(list, ...)``, ``+`` between texts) are refused with the spelling to use.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from .durations import flex_duration_ns
from .patterns import java_pattern, pattern_error

HELPERS = {"avg_over": "avg", "sum_over": "sum", "min_over": "min", "max_over": "max", "count_over": "count"}
# Functions that reach outside the expression or abort the query.
FORBIDDEN = {"reflect", "java_method", "try_reflect", "raise_error", "assert_true", "select", "from"}

_COMPARE = {"==", "!=", "=", "<", "<=", ">", ">="}
_ARITHMETIC = ("+", "-", "*", "/", "%")
_TEXT_TESTS = {"contains", "startswith", "endswith", "matches", "like", "rlike", "ilike"}
_NUMBER_FUNCTIONS = {"abs", "ceil", "floor", "round", "sqrt", "pow", "power", "greatest", "least", "isnan", "mod"}
_TOKEN = re.compile(
    r"""(?P<string>"(?:[^"\\]|\\.)*"|'(?:[^'\\]|\\.)*')
      | (?P<field>record(?:\??\.[A-Za-z_]\w*|\[\s*(?:"(?:[^"\\]|\\.)*"|'(?:[^'\\]|\\.)*'|\d+)\s*\])+)
      | (?P<number>\d+(?:\.(?!\.)\d*)?(?:[eE][+-]?\d+)?|\.\d+)
      | (?P<word>[A-Za-z_]\w*)
      | (?P<op>&&|\|\||==|!=|<=|>=|<>|\?\?|\*\*|\.\.|[^\s])""",
    re.VERBOSE,
)
_STEP = re.compile(r"""\.([A-Za-z_]\w*)|\[\s*("(?:[^"\\]|\\.)*"|'(?:[^'\\]|\\.)*')\s*\]|\[\s*(\d+)\s*\]""")
# Spellings of other rule languages, and what to write here.
_INSTEAD = {"??": "coalesce(a, b)", "**": "pow(a, b)", "..": "x BETWEEN a AND b", "#": '"a" in record.list or len(record.list)'}
_INSTEAD_CALLS = {"max": "greatest(a, b)", "min": "least(a, b)", "any": '"a" in record.list', "all": '!("a" in record.list)', "none": '!("a" in record.list)'}
_CASTS = {"int": "INT", "integer": "INT", "bigint": "BIGINT", "long": "BIGINT", "float": "DOUBLE", "double": "DOUBLE", "boolean": "BOOLEAN"}
_PRINTED = {"string", "concat", "concat_ws"}


class ExpressionError(ValueError):
    """The expression text cannot be used as a rule."""


def _unquote(token: str) -> str:
    body = token[1:-1]
    plain = {"n": "\n", "t": "\t", "r": "\r"}
    return re.sub(r"\\(.)", lambda m: plain.get(m[1], m[1]), body)


def sql_string(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _like(text: str) -> str:
    return text.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_")


def _tokens(source: str) -> list[tuple[str, str]]:
    out = []
    for m in _TOKEN.finditer(source):
        if m["string"]:
            out.append(("string", _unquote(m["string"])))
        elif m["field"]:
            path = tuple(dot or (int(place) if place else _unquote(key)) for dot, key, place in _STEP.findall(m["field"]))
            out.append(("field", path[0] if len(path) == 1 else path))
        elif m["number"]:
            out.append(("number", m["number"]))
        elif m["word"]:
            out.append(("word", m["word"]))
        else:
            out.append(("op", m["op"]))
    return out


def paths(source: str) -> list[tuple]:
    """The record fields that an expression reaches through others, as steps."""
    return [text for kind, text in _tokens(source) if kind == "field" and isinstance(text, tuple)]


def _bare(tokens: list[tuple[str, str]]) -> list[tuple[str, str]]:
    """The same tokens without brackets around a lone field, which would hide it from its neighbours."""
    out: list[tuple[str, str]] = []
    for token in tokens:
        out.append(token)
        while len(out) >= 3 and out[-1] == ("op", ")") and out[-2][0] == "field" and out[-3] == ("op", "(") and (
                len(out) == 3 or out[-4][0] != "word" or out[-4][1].lower() in ("and", "or", "not", "when", "then", "else")):
            out[-3:] = [out[-2]]
    return out


def _refuse_other_spellings(tokens: list[tuple[str, str]]) -> None:
    for i, (kind, text) in enumerate(tokens):
        beside = [tokens[k] for k in (i - 1, i + 1) if 0 <= k < len(tokens)]
        if kind == "op" and text in _INSTEAD:
            raise ExpressionError(f"{text} is not known here; write {_INSTEAD[text]}")
        if kind == "word" and text.lower() in _INSTEAD_CALLS and beside[-1] == ("op", "("):
            raise ExpressionError(f"{text}() is not known here; write {_INSTEAD_CALLS[text.lower()]}")
        if kind == "op" and text == "+" and any(t[0] == "string" for t in beside):
            raise ExpressionError("texts are joined with concat(a, b), not with +")


def _literal_kind(token: tuple[str, str]) -> str | None:
    kind, text = token
    if kind in ("string", "number"):
        return kind
    if kind == "word" and text.lower() in ("true", "false"):
        return "boolean"
    if kind == "word" and text.lower() in ("nil", "null"):
        return "present"
    return None


def _field_kind(tokens, i: int, calls: list[str], typed: Callable[[str], str | None], alone: str) -> str:
    """Which typed accessor a record field needs, judged from its neighbours."""
    at = lambda k: tokens[k] if 0 <= k < len(tokens) else ("end", "")
    before, after = at(i - 1), at(i + 1)
    for op, other in ((after, at(i + 2)), (before, at(i - 2))):
        if op[0] == "op" and op[1] in _COMPARE:
            kind = _literal_kind(other)
            return kind or typed(tokens[i][1]) or _operand_kind(tokens, i, op is after)
        if op[0] == "word" and op[1].lower() in _TEXT_TESTS:
            return "string"
    if after[0] == "word" and after[1].lower() == "in":
        return _literal_kind(at(i + 3)) or "string"
    if after[0] == "word" and after[1].lower() == "is":
        return "present"
    if after[1] in _ARITHMETIC or before[1] in _ARITHMETIC:
        return "number"
    if calls and calls[-1] in _PRINTED:
        return "text"
    if calls and calls[-1]:
        return "number" if calls[-1] in _NUMBER_FUNCTIONS else typed(tokens[i][1]) or "string"
    return alone


def _operand_kind(tokens, i: int, right: bool) -> str:
    """Kind of what a field is compared with, when that is a call or a group: calls give text unless they are numeric."""
    if right:
        name = tokens[i + 2] if i + 2 < len(tokens) and i + 3 < len(tokens) and tokens[i + 3] == ("op", "(") else None
    else:
        depth, j = 0, i - 2
        while j >= 0:
            depth += {")": 1, "(": -1}.get(tokens[j][1], 0) if tokens[j][0] == "op" else 0
            if depth == 0:
                break
            j -= 1
        name = tokens[j - 1] if j > 0 and tokens[j] == ("op", "(") else None
    if name is None or name[0] != "word":
        return "number"
    low = name[1].lower()
    return "number" if low in _NUMBER_FUNCTIONS or low in HELPERS or low in ("len", "length", "size") else "string"


def _plain_pair(tokens, i: int) -> bool:
    """Does a comparison of two fields start at ``i``?"""
    at = lambda k: tokens[k] if 0 <= k < len(tokens) else ("end", "")
    return (at(i)[0] == "field" and at(i + 1)[0] == "op" and at(i + 1)[1] in _COMPARE and at(i + 2)[0] == "field"
            and at(i - 1)[1] not in _ARITHMETIC and at(i + 3)[1] not in _ARITHMETIC)


def _compare_fields(left: str, op: str, right: str, field: Callable[[str, str], str]) -> str:
    """Comparison of two fields by what they hold; different kinds are unequal and have no order."""
    kinds = ("number", "string", "boolean")
    pairs = [(field(k, left), field(k, right)) for k in kinds]
    if op in ("==", "=", "!="):
        missing = f"({field('present', left)} IS NULL AND {field('present', right)} IS NULL)"
        equal = " OR ".join([f"coalesce({a} = {b}, false)" for a, b in pairs] + [missing])
        return f"(NOT ({equal}))" if op == "!=" else f"({equal})"
    ordered = " ".join(f"WHEN {a} IS NOT NULL AND {b} IS NOT NULL THEN {a} {op} {b}" for a, b in pairs[:2])
    return f"(CASE {ordered} END)"


def _conditional(tokens) -> tuple[int, int] | None:
    """Places of ``?`` and its ``:`` outside of brackets."""
    depth, question, nested = 0, None, 0
    for j, token in enumerate(tokens):
        if token[0] != "op":
            continue
        depth += {"(": 1, "[": 1, ")": -1, "]": -1}.get(token[1], 0)
        if depth == 0 and token[1] == "?":
            nested += 1
            question = j if question is None else question
        elif depth == 0 and token[1] == ":" and question is not None:
            nested -= 1
            if nested == 0:
                return question, j
    if question is not None:
        raise ExpressionError("a conditional needs ? and :")
    return None


def _bare_field_compared(tokens, i: int) -> bool:
    """Is one side of the comparison a plain field or nil (which may be missing without being an error)?"""
    at = lambda k: tokens[k] if 0 <= k < len(tokens) else ("end", "")
    plain = lambda side, beyond: (side[0] == "field" or _literal_kind(side) == "present") and beyond[1] not in _ARITHMETIC
    return plain(at(i - 1), at(i - 2)) or plain(at(i + 1), at(i + 2))


def _operand_end(tokens, i: int) -> int:
    """Index after the operand that starts at ``i`` (a literal, field, call or group)."""
    while tokens[i] in (("op", "!"), ("op", "-")) and i + 1 < len(tokens):
        i += 1
    if tokens[i][0] == "word" and i + 1 < len(tokens) and tokens[i + 1] == ("op", "("):
        i += 1
    if tokens[i] != ("op", "("):
        return i + 1
    depth = 0
    for j in range(i, len(tokens)):
        depth += {"(": 1, ")": -1}.get(tokens[j][1], 0) if tokens[j][0] == "op" else 0
        if depth == 0:
            return j + 1
    raise ExpressionError("unbalanced parentheses")


def to_sql(
    source: str,
    mode: str,
    field: Callable[[str, str], str],
    feature: Callable[[str, str, int], str] | None = None,
    typed: Callable[[str], str | None] = lambda name: None,
) -> str:
    """Spark SQL text of an expression.

    ``field(kind, name)`` and ``feature(agg, name, window_ns)`` give the column name that
    holds a typed record field or a window aggregate.
    """
    tokens = _bare(_tokens(source.strip()))
    _refuse_other_spellings(tokens)
    if not tokens:
        raise ExpressionError("no text")
    sql = " ".join(_render(tokens, mode, field, feature, typed))
    return f"coalesce({sql}, false)" if mode == "scheduled" and ("op", "/") in tokens else sql


def _render(tokens, mode, field, feature, typed, alone: str = "boolean") -> list[str]:
    parts = _conditional(tokens)
    if parts is not None:
        test, then, other = tokens[:parts[0]], tokens[parts[0] + 1:parts[1]], tokens[parts[1] + 1:]
        if not (test and then and other):
            raise ExpressionError("a conditional needs a test and two values")
        text = [" ".join(_render(t, mode, field, feature, typed, k)) for t, k in ((test, "boolean"), (then, alone), (other, alone))]
        return [f"(CASE WHEN {text[0]} THEN {text[1]} ELSE {text[2]} END)"]
    out: list[str] = []
    calls: list[str] = []
    brackets: list[str] = []
    operand, divides = 0, False  # where the left side of a comparison begins, and whether it divides
    i = 0
    while i < len(tokens):
        kind, text = tokens[i]
        low = text.lower() if kind != "field" else ""
        follows = tokens[i + 1] if i + 1 < len(tokens) else ("end", "")
        call = kind == "word" and follows == ("op", "(")
        if call and (low in HELPERS or low == "regex_match"):
            args = tokens[i + 2:i + 7]
            shape = [t[0] for t in args[:4]] + [args[-1][1] if len(args) > 3 else ""]
            if len(args) < 4 or args[0][0] != "string" or args[2][0] != "string" or args[3] != ("op", ")"):
                raise ExpressionError(f"{text} needs two string literals, got {shape}")
            out.append(_helper(low, args[0][1], args[2][1], mode, field, feature))
            i += 6
            continue
        at = lambda k: tokens[k] if k < len(tokens) else ("end", "")
        if kind in ("string", "number") and at(i + 1) == ("word", "in") and at(i + 2)[0] == "field" and mode != "scheduled":
            column = field("texts" if kind == "string" else "numbers", at(i + 2)[1])
            out.append(f"array_contains({column}, {sql_string(text) if kind == 'string' else f'double({text})'})")
            i += 3
            continue
        if call and low == "len" and at(i + 2)[0] == "field" and at(i + 3) == ("op", ")") and mode != "scheduled":
            out.append(field("length", at(i + 2)[1]))
            i += 4
            continue
        if call and low in _CASTS:
            # text that is no number has no value, instead of failing the query
            end = _operand_end(tokens, i)
            inner = " ".join(_render(tokens[i + 2:end - 1], mode, field, feature, typed, typed(tokens[i + 2][1]) or "text" if tokens[i + 2][0] == "field" else "number"))
            out.append(f"try_cast({inner} AS {_CASTS[low]})")
            i = end
            continue
        if _plain_pair(tokens, i) and mode != "scheduled":
            out.append(_compare_fields(text, follows[1], tokens[i + 2][1], field))
            i += 3
            continue
        if kind == "op" and text == "(" and not (i and tokens[i - 1][0] == "word"):
            end = _operand_end(tokens, i)
            if _conditional(tokens[i + 1:end - 1]) is not None:
                beside = [tokens[k] for k in (i - 1, i - 2, end, end + 1) if 0 <= k < len(tokens)]
                compared = any(t[0] == "op" and t[1] in (*_COMPARE, *_ARITHMETIC) for t in beside)
                kind = next((k for k in map(_literal_kind, beside) if k), "number") if compared else alone
                out += _render(tokens[i + 1:end - 1], mode, field, feature, typed, kind)
                i = end
                continue
        if kind == "op" and text in _COMPARE and divides:
            # comparing 0 / 0 is never true
            out[operand:] = [f"nanvl({' '.join(out[operand:])}, CAST(NULL AS DOUBLE))"]
            divides = False
        if kind == "op" and text in ("&&", "||", "(", ",", ")") or kind == "word" and low in ("and", "or", "not", "when", "then", "else"):
            operand, divides = len(out) + 1, False
        if kind == "string":
            out.append(sql_string(text))
        elif kind == "field":
            if mode == "scheduled":
                raise ExpressionError("record is not available in scheduled mode")
            out.append(field(_field_kind(tokens, i, calls, typed, alone), text))
        elif kind == "number":
            # A trailing D keeps arithmetic in floating point, as records are.
            out.append(text + ("D" if re.search(r"[.eE]", text) else ""))
        elif kind == "word" and low in FORBIDDEN:
            raise ExpressionError(f"{text} is not allowed in rule expressions")
        elif kind == "word" and low == "nil":
            out.append("NULL")
        elif call and low == "len":
            out.append("length")
        elif not call and low in ("contains", "startswith", "endswith") and kind == "word":
            if follows[0] != "string":
                raise ExpressionError(f"{text} needs a string literal on its right")
            pattern = {"contains": "%{}%", "startswith": "{}%", "endswith": "%{}"}[low].format(_like(follows[1]))
            out.append("LIKE " + sql_string(pattern))
            i += 1
        elif not call and low == "matches" and kind == "word":
            problem = pattern_error(follows[1]) if follows[0] == "string" else "pattern literal required"
            if problem:
                raise ExpressionError(problem)
            out.append("RLIKE " + sql_string(java_pattern(follows[1])))
            i += 1
        elif kind == "op" and text == "%" and i + 1 < len(tokens):
            # A remainder by zero gives NULL (no verdict) instead of failing the query.
            end = _operand_end(tokens, i + 1)
            inner = " ".join(_render(tokens[i + 1:end], mode, field, feature, typed, "number"))
            out.append(f"% nullif({inner}, 0)")
            i = end
            continue
        elif kind == "op" and text == "/" and i + 1 < len(tokens):
            # Floating division: times infinity and by one where the divisor is zero, else times one and by the divisor.
            end = _operand_end(tokens, i + 1)
            inner = " ".join(_render(tokens[i + 1:end], mode, field, feature, typed, "number"))
            out.append(f"* if({inner} = 0, double('Infinity'), 1D) / if({inner} = 0, 1D, {inner})")
            i, divides = end, True
            continue
        elif kind == "op" and text == "!" and i + 1 < len(tokens):
            end = _operand_end(tokens, i + 1)
            out.append(f"(NOT ({' '.join(_render(tokens[i + 1:end], mode, field, feature, typed))}))")
            i = end
            continue
        elif kind == "op" and text in ("?", ";", "`"):
            raise ExpressionError(f"unexpected {text!r}")
        elif kind == "op" and text == "[":
            listed = bool(out) and out[-1].upper() == "IN"
            brackets.append(")")
            calls.append("in" if listed else "array")
            out.append("(" if listed else "array(")
        elif kind == "op" and text == "]":
            if not brackets:
                raise ExpressionError("unbalanced brackets")
            calls.pop()
            out.append(brackets.pop())
        elif kind == "op" and text in ("==", "!=") and _bare_field_compared(tokens, i):
            out.append({"==": "<=>", "!=": "IS DISTINCT FROM"}[text])
        elif kind == "op" and text in ("&&", "||"):
            out.append({"&&": "AND", "||": "OR"}[text])
        else:
            if kind == "op" and text == "(":
                calls.append(tokens[i - 1][1].lower() if i and tokens[i - 1][0] == "word"
                             and tokens[i - 1][1].lower() not in ("and", "or", "not", "in") else "")
            elif kind == "op" and text == ")" and calls:
                calls.pop()
            out.append(text)
        i += 1
    return out


def _helper(name, field_name, argument, mode, field, feature) -> str:
    if name == "regex_match":
        if mode == "scheduled":
            return "false"  # there is no current record to match
        column = field("text", field_name)
        if pattern_error(argument):
            return f"CASE WHEN {column} IS NULL THEN false END"
        return f"coalesce(regexp_like({column}, {sql_string(java_pattern(argument))}), false)"
    window_ns = flex_duration_ns(argument)
    if mode != "scheduled" or window_ns is None or feature is None:
        return "0D"
    return f"coalesce({feature(HELPERS[name], field_name, window_ns)}, 0D)"


def summary(source: str) -> str:
    """One-line expression text for the value column, at most 79 bytes plus an ellipsis."""
    line = " ".join(source.split())
    raw = line.encode()
    return line if len(raw) <= 80 else raw[:79].decode(errors="ignore") + "…"
