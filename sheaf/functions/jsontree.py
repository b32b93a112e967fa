"""Strict JSON of any depth as Python values, and what can be said of a value without its neighbours."""

from __future__ import annotations

import json
import re
from decimal import Decimal
from json.decoder import scanstring
from typing import Any

_SPACE = re.compile(r"[ \t\n\r]*")
_PLAIN = re.compile(r"(-?(?:0|[1-9]\d*)(?:\.\d+)?(?:[eE][-+]?\d+)?)|true|false|null", re.ASCII)


class NotJson(ValueError):
    pass


def _refuse(name: str) -> Any:
    raise NotJson(name)


def parse(text: str | None) -> Any:
    """The value of a JSON text; NotJson if it is none. NaN and Infinity are none, of repeated keys the last counts."""
    if text is None:
        raise NotJson("null")
    try:
        return json.loads(text, parse_constant=_refuse)
    except RecursionError:
        return _deep(text)
    except NotJson:
        raise
    except ValueError as error:
        raise NotJson(str(error)) from None


def _plain(text: str, at: int) -> tuple[Any, int]:
    if text[at : at + 1] == '"':
        try:
            return scanstring(text, at + 1, True)
        except ValueError as error:
            raise NotJson(str(error)) from None
    found = _PLAIN.match(text, at)
    if not found:
        raise NotJson(f"at {at}")
    return json.loads(found[0]), found.end()


def _deep(text: str) -> Any:
    """The same for nesting beyond the interpreter's stack."""
    open_: list[tuple[Any, str | None]] = []  # a container and the key that waits for a value
    at, done, value = 0, False, None
    skip = lambda i: _SPACE.match(text, i).end()
    while True:
        at = skip(at)
        if not done:
            mark = text[at : at + 1]
            if mark in ("{", "["):
                at = skip(at + 1)
                empty = text[at : at + 1] == ("}" if mark == "{" else "]")
                value = {} if mark == "{" else []
                if empty:
                    at, done = at + 1, True
                    continue
                key = None
                if mark == "{":
                    key, at = _key(text, at, skip)
                open_.append((value, key))
                continue
            value, at = _plain(text, at)
            done = True
            continue
        if not open_:
            if at != len(text):
                raise NotJson(f"at {at}")
            return value
        holder, key = open_.pop()
        if isinstance(holder, dict):
            holder[key] = value
        else:
            holder.append(value)
        mark = text[at : at + 1]
        if mark == ("}" if isinstance(holder, dict) else "]"):
            at, value = at + 1, holder
        elif mark == ",":
            at = skip(at + 1)
            if isinstance(holder, dict):
                key, at = _key(text, at, skip)
            open_.append((holder, key))
            done = False
        else:
            raise NotJson(f"at {at}")


def _key(text: str, at: int, skip) -> tuple[str, int]:
    if text[at : at + 1] != '"':
        raise NotJson(f"at {at}")
    key, at = _plain(text, at)
    at = skip(at)
    if text[at : at + 1] != ":":
        raise NotJson(f"at {at}")
    return key, at + 1


def kind(value: Any) -> str:
    """string, number, boolean, object, array or null."""
    if isinstance(value, bool):
        return "boolean"
    if value is None:
        return "null"
    return {str: "string", dict: "object", list: "array"}.get(type(value), "number")


def scalar_text(value: Any) -> str:
    """One writing of a scalar: equal numbers are written alike."""
    if isinstance(value, float) and value == value and abs(value) != float("inf"):
        number = Decimal(repr(value))
        return str(int(number)) if number == number.to_integral_value() and abs(number) < Decimal(10) ** 30 else repr(value)
    return json.dumps(value, ensure_ascii=False)


def json_text(value: Any, compact: bool = False) -> str:
    """The JSON text of a value of any depth; compact without gaps."""
    comma, colon = (",", ":") if compact else (", ", ": ")
    try:
        return json.dumps(value, ensure_ascii=False, separators=(comma, colon))
    except RecursionError:
        pass
    out, waiting = [], [(False, value)]  # whether it is a text already, and the text or value
    while waiting:
        written, part = waiting.pop()
        if written:
            out.append(part)
        elif isinstance(part, dict):
            members = [x for n, (k, v) in enumerate(part.items()) for x in ((True, f"{comma * (n > 0)}{json.dumps(k, ensure_ascii=False)}{colon}"), (False, v))]
            waiting += [(True, "}"), *reversed(members), (True, "{")]
        elif isinstance(part, list):
            members = [x for n, v in enumerate(part) for x in ((True, comma * (n > 0)), (False, v))]
            waiting += [(True, "]"), *reversed(members), (True, "[")]
        else:
            out.append(json.dumps(part, ensure_ascii=False))
    return "".join(out)


def pointer(parent: str, step: str | int) -> str:
    """The JSON pointer of a member."""
    return f"{parent}/{str(step).replace('~', '~0').replace('/', '~1')}"
