"""Strict reading of delimited records, one Python string each, and the typed values in them."""

from __future__ import annotations

import csv
import datetime as dt
import re
import sys
from collections.abc import Iterable, Iterator

csv.field_size_limit(sys.maxsize)

# The spellings of a missing value and of truth values.
NULL_WORDS = frozenset(["", "na", "n/a", "null", "none", "nan"])
TRUE_WORDS = frozenset(["true", "yes", "1"])
FALSE_WORDS = frozenset(["false", "no", "0"])

_INT = re.compile(r"[+-]?[0-9]+", re.ASCII)
_FLOAT = re.compile(r"[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?", re.ASCII)
_DATE = re.compile(r"[0-9]{4}-[0-9]{2}-[0-9]{2}", re.ASCII)
BLANKS = " \t"


class BadRecord(ValueError):
    """A record whose structure can't be read; ``args[0]`` is the reason."""


def assemble(lines: Iterable[str], separator: str = ",", most_lines: int = 1_000) -> Iterator[str]:
    """Join physical lines into records: a line break inside an open quote belongs to the field.

    A quote opens a field only at the field's start, so a stray quote inside an unquoted field opens nothing.
    Where lines that were joined make no record (a field that is opened and not closed, or closed by the quote of
    a later record), the first line comes out alone, for the strict reader to refuse, and those behind it are
    read anew: nothing valid is lost behind a broken quote. ``most_lines`` is how many lines one record may have.
    """
    todo = iter(lines)
    held: list[str] = []
    again: list[str] = []
    while True:
        line = again.pop() if again else next(todo, None)
        if line is not None:
            held.append(line)
            if open_at_end(line, separator, inside=len(held) > 1) and len(held) < most_lines:
                continue
        elif not held:
            return
        if len(held) == 1 or line is not None and _whole("\n".join(held), separator):
            yield "\n".join(held)
        else:
            yield held[0]
            again += held[:0:-1]
        held = []


def _whole(record: str, separator: str) -> bool:
    try:
        split_record(record.removesuffix("\r"), separator)
    except BadRecord:
        return False
    return True


def open_at_end(line: str, separator: str, inside: bool = False) -> bool:
    """Whether a quoted field is open at the end of a line; ``inside`` tells whether one was at its start."""
    at, n = 0, len(line)
    while True:
        if not inside:
            if line.startswith('"', at):
                inside, at = True, at + 1
            else:
                at = line.find(separator, at)
                if at < 0:
                    return False
                at += len(separator)
                continue
        end = line.find('"', at)
        if end < 0:
            return True
        if line.startswith('"', end + 1):
            at = end + 2
            continue
        inside, at = False, line.find(separator, end + 1)  # what stands between is for the strict reader to refuse
        if at < 0:
            return False
        at += len(separator)
        if at > n:
            return False


def split_record(raw: str, separator: str = ",", crlf: bool = False) -> list[str]:
    """The fields of one record; raises BadRecord where the quoting is broken.

    A field is either wholly enclosed in quotes, inner ones doubled, or contains none. With ``crlf``
    a final carriage return is part of the record separator, otherwise of the last value.
    """
    tail = ""
    if raw.endswith("\r"):
        raw, tail = raw[:-1], "" if crlf else "\r"
    if not raw:
        return [tail]
    if len(separator) != 1:
        return _split_long(raw, separator, tail)
    try:
        rows = list(csv.reader([raw], delimiter=separator, quotechar='"', doublequote=True, strict=True))
    except csv.Error as e:
        raise BadRecord(f"broken quoting: {e}") from None
    if len(rows) != 1:
        raise BadRecord("line break outside quotes")
    fields = rows[0]
    if '"' in raw:  # the strict reader lets a quote pass inside an unquoted field
        at = 0
        for value in fields:
            if raw.startswith('"', at):
                at += len(value) + value.count('"') + 2
            elif '"' in value:
                raise BadRecord("broken quoting: quote in an unquoted field")
            else:
                at += len(value)
            at += 1
        if at != len(raw) + 1:
            raise BadRecord("line break outside quotes")
        if tail and raw.endswith('"'):
            raise BadRecord("broken quoting: text after a closing quote")
    elif "\r" in raw or "\n" in raw:
        raise BadRecord("line break outside quotes")
    fields[-1] += tail
    return fields


def _split_long(raw: str, separator: str, tail: str) -> list[str]:
    """As split_record, for separators that the csv module doesn't take (several characters)."""
    if not separator:
        raise BadRecord("empty field separator")
    fields, at = [], 0
    while True:
        if raw.startswith('"', at):
            m = re.compile(r'"((?:[^"]|"")*)"').match(raw, at)
            if not m:
                raise BadRecord("broken quoting: unexpected end of data")
            fields.append(m[1].replace('""', '"'))
            at = m.end()
            if at < len(raw) and not raw.startswith(separator, at):
                raise BadRecord("broken quoting: text after a closing quote")
        else:
            end = raw.find(separator, at)
            value = raw[at:] if end < 0 else raw[at:end]
            if '"' in value:
                raise BadRecord("broken quoting: quote in an unquoted field")
            if "\n" in value or "\r" in value:
                raise BadRecord("line break outside quotes")
            fields.append(value)
            at += len(value)
        if at >= len(raw):
            fields[-1] += tail
            return fields
        at += len(separator)


def is_null(value: str) -> bool:
    return len(value) <= 4 and value.lower() in NULL_WORDS


def read_int(value: str) -> int:
    if not _INT.fullmatch(value):
        raise ValueError("not an int")
    n = int(value) if len(value) <= 400 else int(value[0] + value[1:].lstrip("0")[:30] if value[0] in "+-" else value.lstrip("0")[:30] or "0")
    if not -(2**63) <= n < 2**63:
        raise ValueError("int beyond 64 bits")
    return n


def read_float(value: str) -> float:
    if not _FLOAT.fullmatch(value):
        raise ValueError("not a float")
    return float(value)


def read_date(value: str) -> dt.date:
    if not _DATE.fullmatch(value):
        raise ValueError("not a date")
    return dt.date(int(value[:4]), int(value[5:7]), int(value[8:]))


def read_boolean(value: str) -> bool:
    v = value.lower() if len(value) <= 5 else ""
    if v in TRUE_WORDS:
        return True
    if v in FALSE_WORDS:
        return False
    raise ValueError("not a boolean")


READERS = {"int": read_int, "float": read_float, "date": read_date, "boolean": read_boolean}


def typed(raw: str, types: list[str], separator: str, crlf: bool) -> list[object]:
    """The typed values of a record of the declared columns; raises BadRecord with the reason."""
    fields = split_record(raw, separator, crlf)
    if len(fields) != len(types):
        raise BadRecord(f"wrong column count: {len(fields)} fields for {len(types)} columns")
    out: list[object] = []
    for n, (value, kind) in enumerate(zip(fields, types), 1):
        value = value.strip(BLANKS)
        if is_null(value):
            out.append(None)
        elif (read := READERS.get(kind or "string")) is None:
            out.append(value)
        else:
            try:
                out.append(read(value))
            except ValueError:
                raise BadRecord(f"invalid value: column {n} is not of type {kind}") from None
    return out
