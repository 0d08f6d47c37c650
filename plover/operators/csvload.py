"""Rows that fail to parse (problem 6).

Method: an error-recovering recursive-descent grammar over running text. A record is fields joined by the file's
delimiter, up to a line end; a field is plain or quoted, and a quoted one may hold line ends. Where a record breaks the
grammar the fault is located, and parsing resumes at the next validated record-start anchor: a line start where the
record tag stands and from which a whole record parses.

``load_rejections`` parses each file's delivered lines as running text. As every delivered line starts a record, the
lines are the places anchors are looked for; a record that doesn't end with its line has lost a quote, and the lines up
to the anchor are diagnosed one by one. Files are cut into blocks of lines, which are parsed on their own: a file of any
size is spread over all tasks, and a task holds one block's text. Each record is parsed once, and once more where it is
broken; so the work is linear in the text, up to the length of a block where quotes are missing.

Parsing is Arrow-batched Python (``mapInPandas``): a grammar with located errors has no built-in form.

Edge cases: null and blank lines and (repeated) headers are no records; an unknown delimiter falls back to comma; a
header may be missing; very long fields are parsed whole; a byte-order mark and a trailing line end are ignored; lines
without number come first; repeated rows are records of their own; empty table: empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plover.runtime import spread

HEADER = ("kind", "accountUserId", "page", "rawFile", "index", "origin", "parentId", "candidateId", "reasons")
BLANKS = " \t"
INT_MAX = 2147483647

#: The rejection codes of the data contract.
REJECTION_CODES = (
    "invalid_response_shape",
    "missing_tweet_id",
    "empty_text",
    "invalid_created_at",
    "missing_metric",
    "invalid_media",
    "missing_author",
    "missing_author_id",
    "missing_author_handle",
    "missing_author_display_name",
    "missing_author_counts",
    "missing_author_created_at",
    "missing_author_verification",
    "conflicting_tweet_text",
)
TAG = "rejection"
#: Delivered lines of a block, and the characters from which on a block ends earlier.
BLOCK_LINES, BLOCK_CHARS = 4096, 1_000_000


@dataclass
class SyntaxFault(Exception):
    """Where and why a record breaks the grammar."""

    reason: str
    offset: int


class RecordGrammar:
    """record := field (delimiter field)* (line end | end);  field := quoted | plain."""

    def __init__(self, delimiter: str):
        self.delimiter = delimiter

    def record(self, text: str, at: int, end: int | None = None) -> tuple[list[str], int]:
        """The fields of the record at ``at`` and the offset where it ends: with ``end`` there, without at a line end."""
        fields = []
        stop = self.next_line(text, at) if end is None else end  # where plain text ends
        whole = len(text) if end is None else end
        while True:
            if text.startswith('"', at, whole):
                field, at = self.quoted(text, at, whole, end is None)
                if end is None and at > stop:
                    stop = self.next_line(text, at)
            else:
                field, at = self.plain(text, at, stop)
            fields.append(field)
            if at >= stop:
                return fields, at
            at += 1  # the delimiter

    @staticmethod
    def next_line(text: str, at: int) -> int:
        stop = text.find("\n", at)
        return len(text) if stop < 0 else stop

    def plain(self, text: str, at: int, stop: int) -> tuple[str, int]:
        to = text.find(self.delimiter, at, stop)
        to = stop if to < 0 else to
        quote = text.find('"', at, to)
        if quote >= 0:
            raise SyntaxFault("quote inside an unquoted field", quote)
        return text[at:to], to

    def quoted(self, text: str, at: int, end: int, running: bool = False) -> tuple[str, int]:
        parts, start, at = [], at, at + 1
        while True:
            quote = text.find('"', at, end)
            if quote < 0:
                raise SyntaxFault("no closing quote", start)
            parts.append(text[at:quote])
            if not text.startswith('"', quote + 1, end):
                break
            parts.append('"')
            at = quote + 2
        after = quote + 1
        if after < end and not text.startswith((self.delimiter, "\n") if running else self.delimiter, after, end):
            raise SyntaxFault("text after a closing quote", after)
        return "".join(parts), after


def bad_value(fields: list[str]) -> str:
    """The first column whose value is invalid; '' if none."""
    kind, account, page, raw_file, index, origin, parent, candidate, reasons = (f.strip(BLANKS) for f in fields)
    digits = lambda s: s.isascii() and s.isdigit()
    within = lambda s, least: digits(s) and len(s.lstrip("0")) <= 10 and least <= int(s) <= INT_MAX
    codes = reasons.split("|")
    for name, ok in (
        ("kind", kind == "rejection"),
        ("accountUserId", digits(account)),
        ("page", within(page, 1)),
        ("rawFile", raw_file != ""),
        ("index", within(index, 0)),
        ("origin", origin in ("timeline", "embedded")),
        ("parentId", parent == "" or digits(parent)),
        ("candidateId", candidate == "" or digits(candidate)),
        ("reasons", all(c in _CODES for c in codes)),
    ):
        if not ok:
            return name
    return ""


_CODES = frozenset(REJECTION_CODES)


def strip_line_end(line: str) -> str:
    line = line[:-1] if line.endswith("\n") else line
    return line[:-1] if line.endswith("\r") else line


def cleaned(line: str) -> str:
    return strip_line_end(line).removeprefix("\ufeff")


def judged(fields: list[str]) -> tuple[str | None, str, int, list[str]]:
    """What a record of sound syntax is worth, as ``parse_record``."""
    if tuple(f.strip(BLANKS) for f in fields) == HEADER:
        return None, "header", 0, []
    if len(fields) != len(HEADER):
        return "column_count", f"{len(fields)} fields", 0, []
    if name := bad_value(fields):
        return "bad_value", name, 0, []
    return "", "", 0, [f.strip(BLANKS) for f in fields]


def parse_record(line: str, delimiter: str) -> tuple[str | None, str, int, list[str]]:
    """(kind of row or failure, detail, offset, fields) of one line: '' for a loaded record, None for no record at all."""
    line = cleaned(line)
    if not line.strip():
        return None, "blank", 0, []
    try:
        return judged(RecordGrammar(delimiter).record(line, 0, len(line))[0])
    except SyntaxFault as fault:
        return "quoting", fault.reason, fault.offset, []


class Recovery:
    """One pass through running text, from line start to line start, with resumption at anchors."""

    def __init__(self, text: str, delimiter: str, starts: list[int], tag: str = TAG):
        self.text, self.grammar, self.starts = text, RecordGrammar(delimiter), starts
        self.tags, self.ahead, self.known = (tag, f'"{tag}"'), 0, {}

    def parsed(self, i: int) -> tuple[list[str], int] | SyntaxFault:
        """The record at line start ``i``; parsed once, as an anchor or in its turn."""
        if i not in self.known:
            try:
                self.known[i] = self.grammar.record(self.text, self.starts[i])
            except SyntaxFault as fault:
                self.known[i] = fault
        return self.known[i]

    def is_anchor(self, i: int) -> bool:
        if not self.text.startswith(self.tags, self.starts[i]):
            return False
        found = self.parsed(i)
        return not isinstance(found, SyntaxFault) and len(found[0]) == len(HEADER)

    def anchor_after(self, i: int) -> int:
        """The first validated anchor behind line ``i``; the number of lines if there is none. Looks at each line once."""
        self.ahead = max(self.ahead, i + 1)
        while self.ahead < len(self.starts) and not self.is_anchor(self.ahead):
            self.ahead += 1
        return self.ahead

    def forget(self, i: int) -> None:
        self.known.pop(i, None)


def parse_stream(text: str, delimiter: str, tag: str = TAG) -> Iterator[tuple[int, int, str | None, str]]:
    """(start, end, failure, detail) of the records in running text; after a fault it resumes at an anchor, and without
    one at the next line."""
    starts = [0] + [i + 1 for i, c in enumerate(text) if c == "\n"]
    run, i = Recovery(text, delimiter, starts, tag), 0
    while i < len(starts) and starts[i] < len(text):
        found, at = run.parsed(i), starts[i]
        run.forget(i)
        if isinstance(found, SyntaxFault):
            after = run.anchor_after(i)
            after = i + 1 if after == len(starts) else after
            end = starts[after] - 1 if after < len(starts) else len(text)
            yield at, end, "quoting", found.reason
        else:
            fields, end = found
            line = cleaned(text[at:end])
            yield at, end, *((None, "blank") if not line.strip() else judged(fields if line == text[at:end] else parse_fields(line, delimiter))[:2])
            after = i + 1
        while after < len(starts) and starts[after] <= end:  # line starts inside quotes
            after += 1
        i = after


def parse_fields(line: str, delimiter: str) -> list[str]:
    return RecordGrammar(delimiter).record(line, 0, len(line))[0]


def parse_lines(lines: list[str], delimiter: str) -> Iterator[tuple[str | None, str, int, list[str]]]:
    """The results of ``parse_record`` for delivered lines, parsed as running text: one per line, in order."""
    rows = [cleaned(line) for line in lines]
    starts, at = [], 0
    for row in rows:
        starts.append(at)
        at += len(row) + 1
    run, i = Recovery("\n".join(rows), delimiter, starts), 0
    while i < len(rows):
        if not rows[i].strip():
            yield None, "blank", 0, []
            i += 1
            continue
        found = run.parsed(i)
        if not isinstance(found, SyntaxFault) and found[1] == starts[i] + len(rows[i]):
            run.forget(i)
            yield judged(found[0])
            i += 1
            continue
        run.forget(i)
        after = run.anchor_after(i)  # the record ran into other lines, or broke: resume there
        for row in rows[i:after]:
            yield parse_record(row, delimiter)
        i = after


LOADED = "raw_seq long, failure string, detail string, error_offset int, kind string, account_user_id string, page int, raw_file string, row_index int, origin string, parent_id string, candidate_id string, reasons array<string>"


def _load(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    names = [c.split()[0] for c in LOADED.split(", ")]
    held, block, chars = [], None, 0

    def parsed() -> pd.DataFrame:
        rows = []
        for (seq, _), (failure, detail, offset, f) in zip(held, parse_lines([line for _, line in held], block[2]), strict=True):
            if failure:
                rows.append((seq, failure, detail, offset, *[None] * 9))
            elif failure is not None:
                rows.append((seq, None, None, None, f[0], f[1], int(f[2]), f[3], int(f[4]), f[5], f[6] or None, f[7] or None, f[8].split("|")))
        return pd.DataFrame(rows, columns=names, dtype=object)

    for batch in batches:
        for file, number, seq, line, delimiter in zip(batch["load_file"], batch["block"], batch["raw_seq"], batch["line"], batch["delimiter"], strict=True):
            if held and ((file, number, delimiter) != block or chars > BLOCK_CHARS):
                yield parsed()
                held, chars = [], 0
            block = (file, number, delimiter)
            held.append((seq, line))
            chars += len(line)
    if held:
        yield parsed()


def load_rejections(lines: DataFrame) -> DataFrame:
    """Typed records and failures of ``lines`` (raw_seq, load_file, line_no, line): columns of ``LOADED``.

    failure is null for a loaded record, else quoting, column_count or bad_value; detail and error_offset locate it.
    """
    lines = lines.select("raw_seq", "load_file", "line_no", "line").filter(F.col("line").isNotNull())
    mark = F.regexp_extract("line", '^\\uFEFF?"?kind"?([,;\\t])', 1)
    heads = lines.filter("line_no = 1").groupBy("load_file").agg(F.max(mark).alias("delimiter"))
    marked = lines.join(heads, "load_file", "left").select(
        "raw_seq",
        F.coalesce("load_file", F.lit("")).alias("load_file"),
        F.coalesce("line_no", F.lit(0)).alias("line_no"),
        "line",
        F.when(F.col("delimiter").isin(",", ";", "\t"), F.col("delimiter")).otherwise(",").alias("delimiter"),
    )
    blocks = marked.withColumn("block", F.expr(f"line_no div {BLOCK_LINES}")).repartition(spread(lines.sparkSession), "load_file", "block")
    return blocks.sortWithinPartitions("load_file", "block", "line_no", "raw_seq").mapInPandas(_load, LOADED)
