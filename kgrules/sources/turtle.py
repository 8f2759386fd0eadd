"""Turtle: a tokenizer and statement reader, run file by file on the executors.

Statements span lines, so a file is the unit of parallelism; write many files for large graphs, or use ``read_lines`` where
every line is one statement in full terms. A file's lines pass through the reader, which holds one statement of it. Terms have one lexical form: IRIs without brackets, literals in double quotes with
language tag or datatype, blank nodes ``_:x``; numbers are plain literals, true and false carry their datatype.
"""

from __future__ import annotations

import re
from collections import deque
from collections.abc import Iterable, Iterator
from itertools import groupby
from operator import itemgetter
from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RDF, BOOLEAN = "http://www.w3.org/1999/02/22-rdf-syntax-ns#", "http://www.w3.org/2001/XMLSchema#boolean"
TOKEN = re.compile(
    r"""(?P<skip>\s+|\#[^\n]*)|(?P<iri><[^<>"{}|^`\\\s]*(?:\\u[0-9A-Fa-f]{4}[^<>\s]*)*>)|(?P<long>\"{3}(?:\\.|(?!\"{3}).)*\"{3}|'{3}(?:\\.|(?!'{3}).)*'{3})"""
    r"""|(?P<str>"(?:\\.|[^"\\\n])*"|'(?:\\.|[^'\\\n])*')|(?P<kind>\^\^)|(?P<at>@[A-Za-z]+(?:-[A-Za-z0-9]+)*)|(?P<blank>_:[\w.-]*[\w-])"""
    r"""|(?P<number>[+-]?(?:\d+\.\d+|\.\d+|\d+)(?:[eE][+-]?\d+)?(?![\w:]))|(?P<name>(?:[^\W\d][\w.-]*)?:(?:[\w:.%\-]|\\.)*|[^\W\d][\w-]*)|(?P<sign>[.;,\[\]()])|(?P<other>.)""",
    re.DOTALL,
)
ESCAPES = {"n": "\n", "r": "\r", "t": "\t", "b": "\b", "f": "\f", "\\": "\\", '"': '"', "'": "'"}


def _unescape(s: str) -> str:
    def one(m: re.Match) -> str:
        x = m[1]
        if x[0] in "uU":
            return chr(int(x[1:], 16))
        return ESCAPES.get(x, "\\" + x)

    return re.sub(r"\\(u[0-9A-Fa-f]{4}|U[0-9A-Fa-f]{8}|.)", one, s, flags=re.DOTALL)


def tokens(chunks: Iterable[str]) -> Iterator[tuple[str, str]]:
    """(kind, text) of the tokens of a text that comes in chunks, which end at ends of lines; a long string may go on in the next."""

    def scan(text: str, last: bool) -> Iterator[tuple[str, str]]:
        for m in TOKEN.finditer(text):
            if not last and m[0] in ('""', "''") and text.startswith(m[0][0], m.end()):
                return m.start()  # three quotes whose end isn't here yet
            if m.lastgroup != "skip":
                yield m.lastgroup, m[0]
        return len(text)

    held, size, due = [], 0, 0
    for chunk in chunks:
        held.append(chunk)
        size += len(chunk)
        # what goes on is looked at again once it has doubled; a line's end may be escaped
        if size >= due and not chunk.endswith("\\"):
            text = "".join(held)
            left = text[(yield from scan(text, False)) :]
            held, size, due = [left], len(left), 2 * len(left)
    yield from scan("".join(held), True)


class Reader:
    """Triples of one text, whole or in chunks that end at ends of lines; ``tag`` keeps the unnamed nodes of different texts apart."""

    def __init__(self, text: str | Iterable[str], tag: str = ""):
        self.tokens = tokens([text] if isinstance(text, str) else text)
        self.ahead: deque[tuple[str, str]] = deque()
        self.prefixes, self.base, self.tag, self.unnamed = {}, "", tag, 0
        self.found: list[tuple[str, str, str]] = []

    def peek(self) -> tuple[str | None, str]:
        if not self.ahead:
            token = next(self.tokens, None)
            if token is None:
                return None, ""
            self.ahead.append(token)
        return self.ahead[0]

    def take(self) -> tuple[str | None, str]:
        out = self.peek()
        if self.ahead:
            self.ahead.popleft()
        return out

    def read(self, most: int = 10_000) -> Iterator[list[tuple[str, str, str]]]:
        """The triples in parts of about so many, or of one statement."""
        while self.peek()[0] is not None:
            if len(self.found) >= most:
                yield self.found
                self.found = []
            kind, x = self.peek()
            if x.lower() in ("@prefix", "prefix"):
                self.take()
                name, iri = self.take()[1], self.take()[1]
                self.prefixes[name.removesuffix(":")] = self.iri(iri)
                self.dot(x[0] == "@")
            elif x.lower() in ("@base", "base"):
                self.take()
                self.base = self.iri(self.take()[1])
                self.dot(x[0] == "@")
            elif kind == "at":
                self.skip()
            elif kind in ("iri", "blank", "name") or x in ("[", "("):
                subject = self.term()
                if self.peek()[1] != ".":
                    self.properties(subject)
                self.dot(True)
            else:
                self.take()
        yield self.found

    def dot(self, due: bool) -> None:
        if due and self.peek()[1] != ".":
            self.skip()
        elif due:
            self.take()

    def skip(self) -> None:
        while self.peek()[0] is not None and self.take()[1] != ".":
            pass

    def iri(self, token: str) -> str:
        found = _unescape(token[1:-1]) if "\\" in token else token[1:-1]
        return urljoin(self.base, found) if self.base and ":" not in found.split("/")[0] else found

    def node(self) -> str:
        self.unnamed += 1
        return f"_:anon{self.tag}{self.unnamed}"

    def term(self) -> str:
        kind, x = self.take()
        if kind == "iri":
            return self.iri(x)
        if kind in ("str", "long"):
            body = _unescape(x[3:-3] if kind == "long" else x[1:-1])
            out = f'"{body}"'
            after, y = self.peek()
            if after == "at":
                self.take()
                return out + y
            if after == "kind":
                self.take()
                return f"{out}^^{self.term()}"
            return out
        if kind == "number":
            return f'"{x}"'
        if x == "[":
            node = self.node()
            if self.peek()[1] != "]":
                self.properties(node)
            self.take()
            return node
        if x == "(":
            items = []
            while self.peek()[1] not in (")", ""):
                items.append(self.term())
            self.take()
            rest = f"{RDF}nil"
            for item in reversed(items):
                node = self.node()
                self.found += [(node, f"{RDF}first", item), (node, f"{RDF}rest", rest)]
                rest = node
            return rest
        if x == "a":
            return f"{RDF}type"
        if x in ("true", "false"):
            return f'"{x}"^^{BOOLEAN}'
        if kind == "name":
            dots = len(x) - len(x.rstrip("."))
            if dots:  # dots at the end are punctuation
                self.ahead.extendleft([("sign", ".")] * dots)
                x = x[:-dots]
            head, colon, local = x.partition(":")
            return self.prefixes[head] + re.sub(r"\\(.)", r"\1", local) if colon and head in self.prefixes else x
        return x

    def properties(self, subject: str) -> None:
        while True:
            if self.peek()[1] in (".", "]", ""):
                return
            p = self.term()
            while True:
                if self.peek()[1] in (".", "]", ";", ""):
                    break
                self.found.append((subject, p, self.term()))
                if self.peek()[1] != ",":
                    break
                self.take()
            if self.peek()[1] != ";":
                return
            while self.peek()[1] == ";":
                self.take()


def parse(text: str | Iterable[str], tag: str = "") -> list[tuple[str, str, str]]:
    return [t for part in Reader(text, tag).read() for t in part]


def read(spark: SparkSession, path: str) -> DataFrame:
    """(s, p, o) of a file or of all files of a folder. A file's lines are brought together in their order and pass through one
    task, which holds a batch of them and one statement at a time; larger graphs come as many files, or as lines for
    ``read_lines``. Files are told apart by a hash of their names of 64 bits."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def pieces() -> Iterator[tuple[str, str]]:
            before = None
            for x in batches:
                for _, own in x.groupby((x["name"] != x["name"].shift()).cumsum(), sort=False):
                    name, text = own["name"].iloc[0], "\n".join(own["value"])
                    yield name, f"\n{text}" if name == before else text
                    before = name

        for name, own in groupby(pieces(), itemgetter(0)):
            for part in Reader((text for _, text in own), f"{name}x").read():
                yield pd.DataFrame(part, columns=["s", "p", "o"])

    lines = spark.read.text(path, lineSep="\n").select(F.xxhash64(F.input_file_name()).alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("line"), "value")
    lines = lines.repartition("file").sortWithinPartitions("file", "block", "line")
    return lines.select(F.hex("file").alias("name"), "value").mapInPandas(run, "s string, p string, o string")


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(s, p, o) of files with one statement in full terms on each line: splittable, without Python."""
    return parse_lines(spark.read.text(path))


def parse_lines(lines: DataFrame) -> DataFrame:
    pattern = r'^\s*(<[^>]*>|_:\S+)\s+<([^>]*)>\s+(<[^>]*>|_:\S+|"(?:[^"\\]|\\.)*"(?:@[A-Za-z-]+[A-Za-z0-9-]*|\^\^<[^>]*>)?)\s*\.\s*(?:#.*)?$'
    part = lambda i: F.regexp_extract("value", pattern, i)
    bare = lambda c: F.when(c.startswith("<"), F.substring(c, F.lit(2), F.length(c) - 2)).otherwise(F.regexp_replace(c, r"\^\^<([^>]*)>$", r"^^\$1".replace("\\$", "$")))
    return lines.where(F.col("value").rlike(pattern)).select(bare(part(1)).alias("s"), part(2).alias("p"), bare(part(3)).alias("o"))


#: Names of prefixes that the driver holds at most.
MOST_PREFIXES = 100_000


def prefixes(spark: SparkSession, path: str) -> dict[str, str]:
    """The prefixes that the files declare; of a name that is declared again the last one, by file name and place in the file."""
    pattern = r"(?i)^\s*@?prefix\s+([^\s:]*)\s*:\s*<([^>]*)>"
    lines = spark.read.text(path).select("value", F.struct("_metadata.file_path", "_metadata.file_block_start", F.monotonically_increasing_id().alias("line")).alias("at"))
    found = lines.where(F.col("value").rlike(pattern)).groupBy(F.regexp_extract("value", pattern, 1).alias("k")).agg(F.max_by(F.regexp_extract("value", pattern, 2), "at").alias("v"))
    rows = found.limit(MOST_PREFIXES + 1).collect()
    if len(rows) > MOST_PREFIXES:
        raise ValueError(f"more than {MOST_PREFIXES} prefixes")
    return {r.k: r.v for r in rows}
