"""Chat templates as models ship them, compiled to one expression over a message array.

The language is the part of the usual template language that such files need::

    text  {{ value }}  {% if test %} .. {% elif test %} .. {% else %} .. {% endif %}
    {% for message in messages %} .. {% endfor %}  {% set name = value %}   {# remark #}

A ``-`` inside a mark strips the white space beside it, and a line break right after a ``%}`` is dropped, as template readers do.
Values are texts, ``true``, ``false``, ``none``, numbers, variables, ``message.role`` or ``message['role']``, ``messages[0].content``,
``messages[1:]``, ``loop.first``, ``loop.last``, ``loop.index`` and ``loop.index0``; they are joined by ``+`` or ``~``, compared by
``==``, ``!=``, ``in``, combined by ``and``, ``or``, ``not`` and brackets, tested by ``is defined`` and ``is none``, and passed through
``trim``, ``upper`` and ``lower``. ``raise_exception('..')`` fails the row's job where it is reached.

What depends on variables alone is decided when the template is compiled; what depends on messages becomes ``when`` and ``transform``.
Null texts are empty.
"""

from __future__ import annotations

import re
from collections.abc import Mapping
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

_MARKS = re.compile(r"(\{\{-?.*?-?\}\}|\{%-?.*?-?%\}|\{#-?.*?-?#\})", re.DOTALL)
_TOKEN = re.compile(r"\s*(?:('(?:[^'\\]|\\.)*'|\"(?:[^\"\\]|\\.)*\")|(\d+)|([A-Za-z_]\w*)|(==|!=|[-+~()\[\].|,:=]))", re.DOTALL)
_ESCAPES = {"n": "\n", "t": "\t", "r": "\r"}
_FILTERS = {"trim": lambda c: F.regexp_replace(c, r"(?U)^\s+|\s+$", ""), "upper": F.upper, "lower": F.lower}
_CONSTANT_FILTERS = {"trim": str.strip, "upper": str.upper, "lower": str.lower}


class TemplateError(ValueError):
    """The template asks for what the language above does not have."""


class _Undefined:
    def __init__(self, name: str):
        self.name = name


@dataclass(frozen=True)
class _Loop:
    place: Column
    size: Column


@dataclass(frozen=True)
class _Messages:
    """An array of messages, and how many of its first ones are left out."""

    column: Column
    skipped: int = 0

    @property
    def value(self) -> Column:
        rest = F.filter(self.column, lambda _, i: i >= self.skipped) if self.skipped else self.column
        return F.coalesce(rest, F.array().cast("array<struct<role:string,content:string>>"))


def _literal(value: Any) -> Any:
    return value if isinstance(value, Column) else F.lit(value)


def _as_text(value: Any) -> Column | str:
    if isinstance(value, _Undefined):
        raise TemplateError(f"undefined variable {value.name!r}")
    if isinstance(value, (_Messages, _Loop)):
        raise TemplateError("only texts, numbers and truth values can be put out")
    if isinstance(value, Column):
        return F.coalesce(value.cast("string"), F.lit(""))
    return "" if value is None else str(value)


def _joined(parts: list) -> Column | str:
    texts = [_as_text(p) for p in parts]
    if all(isinstance(t, str) for t in texts):
        return "".join(texts)
    return F.concat(*[_literal(t) for t in texts])


def _truth(value: Any) -> Column | bool:
    if isinstance(value, _Undefined):
        return False
    if isinstance(value, _Messages):
        return F.size(value.value) > 0
    if isinstance(value, Column):
        # A text is true if it is not empty; comparisons are truth values already.
        return F.coalesce(value.cast("string"), F.lit("")).isin("", "false") == F.lit(False)
    return bool(value)


def _negated(value: Column | bool) -> Column | bool:
    return ~value if isinstance(value, Column) else not value


def _combined(left: Column | bool, right: Column | bool, both: bool) -> Column | bool:
    for known, other in ((left, right), (right, left)):
        if not isinstance(known, Column):
            return other if known == both else known
    return left & right if both else left | right


def _chosen(test: Column, yes: Any, no: Any) -> Any:
    """A value that depends on the messages."""
    if yes is no:
        return yes
    if isinstance(yes, _Messages) and isinstance(no, _Messages):
        return _Messages(F.when(test, yes.value).otherwise(no.value))
    if isinstance(yes, (_Messages, _Loop)) or isinstance(no, (_Messages, _Loop)):
        raise TemplateError("a variable is a list of messages in one branch only")
    plain = lambda v: F.lit(None) if isinstance(v, _Undefined) else _literal(v)
    return F.when(test, plain(yes)).otherwise(plain(no))


class _Expression:
    """One expression, read from left to right by descent."""

    def __init__(self, source: str, names: Mapping[str, Any]):
        self._source, self._names, self._tokens, at = source, names, [], 0
        source = source.rstrip()
        while at < len(source):
            found = _TOKEN.match(source, at)
            if found is None:
                raise TemplateError(f"cannot read {source[at:at + 20]!r} in {source!r}")
            kind = next(i for i in range(1, 5) if found[i] is not None)
            self._tokens.append((("text", "number", "name", "sign")[kind - 1], found[kind]))
            at = found.end()

    def value(self) -> Any:
        found = self._either()
        if self._tokens:
            raise TemplateError(f"cannot read {self._tokens[0][1]!r} in {self._source!r}")
        return found

    def _take(self, *texts: str) -> str | None:
        if self._tokens and self._tokens[0][0] != "text" and self._tokens[0][1] in texts:
            return self._tokens.pop(0)[1]
        return None

    def _need(self, text: str) -> None:
        if self._take(text) is None:
            raise TemplateError(f"{text!r} is missing in {self._source!r}")

    def _either(self) -> Any:
        left = self._both()
        while self._take("or"):
            left = _combined(_truth(left), _truth(self._both()), both=False)
        return left

    def _both(self) -> Any:
        left = self._not()
        while self._take("and"):
            left = _combined(_truth(left), _truth(self._not()), both=True)
        return left

    def _not(self) -> Any:
        return _negated(_truth(self._not())) if self._take("not") else self._compared()

    def _compared(self) -> Any:
        left = self._sum()
        sign = self._take("==", "!=", "in", "is", "not")
        if sign is None:
            return left
        if sign == "is":
            negative, test = self._take("not") is not None, self._take("defined", "none")
            if test is None:
                raise TemplateError(f"unknown test in {self._source!r}")
            held: Any = not isinstance(left, _Undefined)
            if test == "none":
                held = left.isNull() if isinstance(left, Column) else left is None
            return _negated(held) if negative else held
        if sign == "not":
            self._need("in")
        right = self._sum()
        if sign in ("in", "not"):
            whole, part = _as_text(right), _as_text(left)
            held = part in whole if isinstance(whole, str) and isinstance(part, str) else F.contains(_literal(whole), _literal(part))
            return _negated(held) if sign == "not" else held
        if isinstance(left, _Undefined) or isinstance(right, _Undefined):
            held = False
        elif isinstance(left, Column) or isinstance(right, Column):
            held = F.coalesce(_literal(left) == _literal(right), F.lit(False))
        else:
            held = left == right
        return _negated(held) if sign == "!=" else held

    def _sum(self) -> Any:
        parts = [self._filtered()]
        while self._take("+", "~"):
            parts.append(self._filtered())
        return parts[0] if len(parts) == 1 else _joined(parts)

    def _filtered(self) -> Any:
        value = self._atom()
        while self._take("|"):
            name = self._tokens.pop(0)[1] if self._tokens else ""
            if name not in _FILTERS:
                raise TemplateError(f"unknown filter {name!r}")
            told = _as_text(value)
            value = _CONSTANT_FILTERS[name](told) if isinstance(told, str) else _FILTERS[name](told)
        return value

    def _atom(self) -> Any:
        if self._take("("):
            value = self._either()
            self._need(")")
            return self._parts_of(value)
        if not self._tokens:
            raise TemplateError(f"a value is missing in {self._source!r}")
        kind, told = self._tokens.pop(0)
        if kind == "text":
            return re.sub(r"\\(.)", lambda m: _ESCAPES.get(m[1], m[1]), told[1:-1], flags=re.DOTALL)
        if kind == "number":
            return int(told)
        if kind == "sign":
            raise TemplateError(f"cannot read {told!r} in {self._source!r}")
        if told.lower() in ("true", "false", "none"):
            return {"true": True, "false": False, "none": None}[told.lower()]
        if told == "raise_exception":
            self._need("(")
            reason = self._either()
            self._need(")")
            return F.raise_error(_literal(_as_text(reason)))
        return self._parts_of(self._names.get(told, _Undefined(told)))

    def _parts_of(self, value: Any) -> Any:
        while True:
            if self._take("."):
                value = self._field(value, self._tokens.pop(0)[1] if self._tokens else "")
            elif self._take("["):
                index = self._either()
                if self._take(":"):
                    if not isinstance(value, _Messages) or not isinstance(index, int):
                        raise TemplateError("only messages can be cut, by a number")
                    value = _Messages(value.value, index)
                elif isinstance(value, _Messages) and isinstance(index, int):
                    value = F.get(value.value, F.lit(index))
                else:
                    value = self._field(value, index)
                self._need("]")
            else:
                return value

    @staticmethod
    def _field(value: Any, name: str) -> Any:
        if isinstance(value, _Loop):
            found = {
                "first": value.place == 0, "last": value.place == value.size - 1, "index0": value.place, "index": value.place + 1,
            }.get(name)
            if found is None:
                raise TemplateError(f"unknown loop.{name}")
            return found
        if isinstance(value, Column):
            return value[name] if name in ("role", "content") else _Undefined(name)
        raise TemplateError(f"no {name!r} to take")


def _pieces(template: str) -> list[tuple[str, str]]:
    """``kind, content`` of texts, values and statements, white space stripped as the marks say."""
    out: list[tuple[str, str]] = []
    strip_next = drop_break = False
    parts = _MARKS.split(template)
    for at, part in enumerate(parts):
        if at % 2 == 0:
            text = part
            if strip_next:
                text = text.lstrip()
            elif drop_break and text.startswith("\n"):
                text = text[1:]
            if at + 1 < len(parts) and parts[at + 1][2] == "-":
                text = text.rstrip()
            if text:
                out.append(("text", text))
            continue
        strip_next, drop_break = part[-3] == "-", part[1] in "%#"
        inner = part[2:-2].removeprefix("-").removesuffix("-").strip()
        if part[1] != "#":
            out.append(("value" if part[1] == "{" else "statement", inner))
    return out


class _Body:
    """Statements of a template in order; ``names`` hold what is set so far."""

    def __init__(self, pieces: list[tuple[str, str]]):
        self._pieces = pieces

    def rendered(self, names: dict[str, Any], ends: tuple[str, ...] = ()) -> tuple[list, str]:
        parts: list = []
        while self._pieces:
            kind, told = self._pieces.pop(0)
            if kind == "text":
                parts.append(told)
                continue
            if kind == "value":
                parts.append(_as_text(_Expression(told, names).value()))
                continue
            word, _, rest = told.partition(" ")
            if word in ends:
                return parts, told
            if word == "set":
                name, equals, source = rest.partition("=")
                if not equals or not name.strip().isidentifier():
                    raise TemplateError(f"cannot set {rest!r}")
                names[name.strip()] = _Expression(source, names).value()
            elif word == "if":
                parts.append(self._branches(rest, names))
            elif word == "for":
                parts.append(self._loop(rest, names))
            else:
                raise TemplateError(f"unknown statement {told!r}")
        if ends:
            raise TemplateError(f"{ends[-1]!r} is missing")
        return parts, ""

    def _branches(self, test: str, names: dict[str, Any]) -> Any:
        held = _truth(_Expression(test, names).value())
        chosen, other = dict(names), dict(names)
        if held is False:
            # What is not taken may speak of variables that are not there.
            yes: Any = ""
            end = self._skipped()
        else:
            parts, end = self.rendered(chosen, ("elif", "else", "endif"))
            yes = _joined(parts)
        no: Any = ""
        if held is True:
            while end != "endif":
                end = self._skipped()
        elif end.startswith("elif"):
            no = self._branches(end[4:].strip(), other)
        elif end == "else":
            parts, _ = self.rendered(other, ("endif",))
            no = _joined(parts)
        if isinstance(held, bool):
            names.update(chosen if held else other)
            return yes if held else no
        for name in {*chosen, *other}:
            names[name] = _chosen(held, chosen.get(name, _Undefined(name)), other.get(name, _Undefined(name)))
        return F.when(held, _literal(yes)).otherwise(_literal(no))

    def _skipped(self) -> str:
        depth = 0
        while self._pieces:
            kind, told = self._pieces.pop(0)
            if kind != "statement":
                continue
            word = told.split(" ")[0]
            if depth == 0 and word in ("elif", "else", "endif"):
                return told
            depth += (word in ("if", "for")) - (word in ("endif", "endfor"))
        raise TemplateError("'endif' is missing")

    def _loop(self, rest: str, names: dict[str, Any]) -> Column:
        found = re.fullmatch(r"(\w+)\s+in\s+(.+)", rest, re.DOTALL)
        source = _Expression(found[2], names).value() if found else None
        if not isinstance(source, _Messages) or "loop" in names:
            raise TemplateError(f"only one loop over messages at a time: {rest!r}")
        listed, pieces, left = source.value, list(self._pieces), []

        def each(message: Column, place: Column) -> Column:
            body = _Body(list(pieces))
            inner = {**names, found[1]: message, "loop": _Loop(place, F.size(listed))}
            parts, _ = body.rendered(inner, ("endfor",))
            left[:] = body._pieces
            return _literal(_joined(parts))

        rendered = F.array_join(F.transform(listed, each), "")
        self._pieces[:] = left
        return rendered


def compile_template(template: str, messages: Column, generation: bool = False, **variables: Any) -> Column:
    """The text that the template gives for ``messages``, an ``array<struct<role, content>>``.

    ``generation`` is the template's ``add_generation_prompt``; ``variables``, such as ``eos_token`` or ``reasoning_effort``, are texts, truth
    values, or columns.
    """
    names = {"messages": _Messages(messages), "add_generation_prompt": generation, **variables}
    parts, _ = _Body(_pieces(template)).rendered(names)
    return _literal(_joined(parts))
