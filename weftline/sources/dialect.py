"""How a delimited file is written: separator, header, preamble. Reads its first lines only; changes no file."""

from __future__ import annotations

import csv
import io
import os
import re
from collections import Counter
from collections.abc import Callable
from dataclasses import dataclass

from weftline.functions.records import BadRecord, split_record
from weftline.functions.storage import first_bytes

CANDIDATES = [";", ",", "\t", "|"]
SAMPLE_LINES = 50


@dataclass(frozen=True)
class Dialect:
    header: bool = True
    separator: str = ","
    record_separator: str = "\n"
    skip_lines: int = 0

    def options(self) -> dict[str, str]:
        return {"fieldSeparator": self.separator, "header": str(self.header).lower(), "recordSeparator": self.record_separator, "skipLines": str(self.skip_lines)}


_DELEGATE: list[Callable[[list[str]], dict] | None] = [None]


def set_dialect_delegate(f: Callable[[list[str]], dict] | None) -> None:
    """A function that judges sample lines where the rules here fail: keys as in Dialect.options()."""
    _DELEGATE[0] = f


def head(path: str, lines: int = SAMPLE_LINES) -> tuple[list[str], str]:
    """The first lines, without their ends, and the record separator."""
    raw, size = [], 64 * 1024
    while len(raw) < lines:  # the last line may be cut off, so more is read until there are enough or no more
        data = first_bytes(path, size)
        raw = list(io.StringIO(data.decode("utf-8-sig", "replace"), newline=""))
        if len(data) < size:
            break
        raw, size = raw[:-1], size * 8
    raw = raw[:lines]
    return [x.rstrip("\r\n") for x in raw], "\r\n" if raw and raw[0].endswith("\r\n") else "\n"


def fields(line: str, separator: str) -> int:
    try:
        return len(split_record(line, separator))
    except BadRecord:
        return line.count(separator) + 1


def preamble(lines: list[str], separators: list[str] = CANDIDATES) -> tuple[int, str] | None:
    """(lines before the table, separator): the first row of several fields that the next rows agree with."""
    for s in separators:
        counts = [fields(x, s) if x.strip() else 0 for x in lines]
        for n, c in enumerate(counts):
            later = counts[n + 1 : n + 6]
            if c > 1 and sum(abs(k - c) <= 1 and k > 1 for k in later) >= min(2, max(1, len(later))) and later:
                return n, s
    return None


def best_separator(lines: list[str], separators: list[str] = CANDIDATES) -> str | None:
    """The separator by which all filled lines have the same number of fields, the most of them."""
    best: tuple[int, str] | None = None
    for s in separators:
        counts = {fields(x, s) for x in lines if x.strip()}
        if len(counts) == 1 and (n := counts.pop()) > 1 and (best is None or n > best[0]):
            best = (n, s)
    return best[1] if best else None


def consistent(lines: list[str], separator: str, tolerance: int = 1, least: int = 3) -> bool:
    """Whether nearly all filled lines have about the usual number of fields, more than one."""
    counts = [fields(x, separator) for x in lines if x.strip()]
    if not counts:
        return False
    usual = Counter(counts).most_common(1)[0][0]
    return usual > 1 and sum(abs(c - usual) <= tolerance for c in counts) >= min(least, len(counts))


def has_header(lines: list[str], separator: str) -> bool:
    """Whether the first row is of names: no number in it, unlike in the rows below, or all different."""
    rows = [x for x in lines if x.strip()]
    if not rows:
        return True
    number = re.compile(r"\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*")

    def row(line: str) -> list[str]:
        try:
            return split_record(line, separator)
        except BadRecord:
            return line.split(separator)

    first, rest = row(rows[0]), [row(x) for x in rows[1:]]
    if any(number.fullmatch(x) for x in first):
        return False
    return len({x.strip().lower() for x in first}) == len(first) or any(number.fullmatch(x) for r in rest for x in r)


def sniff(path: str) -> dict[str, str]:
    """Separator and header by the csv module's rules on the first 2048 characters; {} if they fail."""
    try:
        sample = first_bytes(path, 4 * 2048).decode("utf-8-sig", "ignore")[:2048]
        d = csv.Sniffer().sniff(sample, "".join(CANDIDATES))
        return {"fieldSeparator": d.delimiter, "header": str(csv.Sniffer().has_header(sample)).lower()}
    except (csv.Error, OSError):
        return {}


def characterize(path: str) -> Dialect:
    """The dialect of a file: rules first, then the delegate, then commas with a header."""
    lines, ends = head(path)
    if re.fullmatch(r"sheet\d+_table\d+\.csv", os.path.basename(path)):
        return Dialect(True, ",", ends, 0)
    found = preamble(lines)
    skip, separator = found or (0, None)
    body = lines[skip:]
    if better := best_separator(body):
        separator = better
    if separator and consistent(body, separator):
        return Dialect(has_header(body, separator), separator, ends, skip)
    if _DELEGATE[0] is not None:
        got = _DELEGATE[0](lines) or {}
        return Dialect(bool(got.get("header", True)), got.get("fieldSeparator") or ",", got.get("recordSeparator") or ends, int(got.get("skipLines") or 0))
    return Dialect(True, ",", ends, 0)
