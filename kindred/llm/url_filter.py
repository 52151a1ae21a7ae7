"""URL filtering by a bit-parallel wildcard automaton.

Glob rules over hosts and paths are packed into one multiword Shift-And automaton: a bit per pattern position, a mask
per byte value, and self-loop masks for the stars. A URL is read as ``.`` host, a separator, path and a terminator; all
URLs of a batch advance together, a byte at a time, and all rules are simulated at once. A star in a host rule does not
pass the separator, and globs do not see it.

Host rules (``Rule``) fit their host and all its subdomains if the path starts with the rule's path; the longest fitting
rule decides. Otherwise the URL is blocked if one of the ``block_globs`` fits its host or path.

Host: after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; path: from there up to ``?``, ``#``
or the end. A null URL or one without ``://`` has an empty host and path. Repeated rows get equal results; input columns
that have the name of an output are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

_U = np.uint64
_SEP, _END = 256, 257  # symbols beyond the bytes


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


def _star(symbol) -> bool:
    return isinstance(symbol, tuple)


class ShiftAnd:
    """Patterns as lists of symbols: a number, a list of them, or a star (None, where it may loop). Bits of all patterns share the words."""

    def __init__(self, patterns: list[list]):
        size = sum(sum(not _star(s) for s in p) + 1 for p in patterns)
        self.words = max(1, -(-size // 64))
        self.take = np.zeros((258, self.words), _U)
        self.loop = np.zeros((258, self.words), _U)
        self.start = np.zeros(self.words, _U)
        self.last: list[tuple[int, int]] = []
        bit = 0
        for p in patterns:
            # bit = "this many symbols read"; the first is the empty prefix
            self._set(self.start, bit)
            for s in p:
                if _star(s):
                    for c in s[1]:
                        self._set(self.loop[c], bit)
                else:
                    bit += 1
                    for c in [s] if isinstance(s, int) else s:
                        self._set(self.take[c], bit)
            self.last.append((bit // 64, bit % 64))
            bit += 1

    @staticmethod
    def _set(mask: np.ndarray, bit: int) -> None:
        mask[bit // 64] |= _U(1 << (bit % 64))

    def run(self, symbols: np.ndarray, size: np.ndarray) -> np.ndarray:
        """(texts, patterns): which patterns fit each row of ``symbols``, of which ``size`` are its own."""
        state = np.repeat(self.start[None], len(symbols), 0)
        for t in range(int(size.max(initial=0))):
            on = np.flatnonzero(size > t)
            c = symbols[on, t]
            d = state[on]
            up = d << _U(1)
            up[:, 1:] |= d[:, :-1] >> _U(63)
            state[on] = (up & self.take[c]) | (d & self.loop[c])
        return np.stack([(state[:, w] >> _U(b)) & _U(1) for w, b in self.last], 1).astype(bool) if self.last else np.zeros((len(symbols), 0), bool)


_ANY_HOST = tuple(range(256))
_ANY = tuple(range(257))


def rule_pattern(r: Rule) -> list:
    """``*.host`` separator ``path*``, over the dotted form of the host."""
    return [(None, _ANY_HOST), *f".{r.host}".encode(), _SEP, *r.path.encode(), (None, _ANY), _END]


def glob_pattern(glob: str) -> list:
    """A glob over host + path: ``*`` any run, ``?`` one byte; it must fit the whole."""
    body = [(None, _ANY) if c == 42 else ([*_ANY_HOST] if c == 63 else c) for c in glob.encode()]
    skip = (None, (_SEP,))  # the separator is no part of what a glob sees
    return [[*_ANY_HOST], *(x for s in body for x in (skip, s)), skip, _END]


def _symbols(host: list[bytes], path: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    size = np.array([len(h) + len(p) + 3 for h, p in zip(host, path, strict=True)])
    out = np.zeros((len(host), int(size.max(initial=0))), np.int16)
    for i, (h, p) in enumerate(zip(host, path, strict=True)):
        x = np.frombuffer(b"." + h + b"\0" + p + b"\0", np.uint8)
        out[i, : len(x)] = x
        out[i, len(h) + 1] = _SEP
        out[i, len(x) - 1] = _END
    return out, size


def judge(hosts: list[str], paths: list[str], rules: list[Rule], globs: list[str], automaton: ShiftAnd) -> tuple[list, list]:
    names: list = [None] * len(hosts)
    verdicts = ["allow"] * len(hosts)
    raw = [(h.encode(), p.encode()) for h, p in zip(hosts, paths, strict=True)]
    order = sorted(range(len(raw)), key=lambda i: len(raw[i][0]) + len(raw[i][1]))  # rows of like length share an array
    at = 0
    while at < len(order):
        end = at + 1
        while end < len(order) and end - at < 512 and (end - at) * sum(map(len, raw[order[end]])) < 1 << 21:
            end += 1
        part = order[at:end]
        fits = automaton.run(*_symbols([raw[i][0] for i in part], [raw[i][1] for i in part]))
        for k, i in enumerate(part):
            hit = [rules[j] for j in np.flatnonzero(fits[k, : len(rules)])]
            if hit:
                best = max(hit, key=lambda r: (len(r.name), r.name))
                names[i], verdicts[i] = best.name, best.verdict
            elif fits[k, len(rules) :].any():
                verdicts[i] = "block"
        at = end
    return names, verdicts


def _judge(rules: list[Rule], globs: list[str], schema: pa.Schema):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = ShiftAnd([*map(rule_pattern, rules), *map(glob_pattern, globs)])
        for b in batches:
            names, verdicts = judge(b.column("host").to_pylist(), b.column("path").to_pylist(), rules, globs, automaton)
            made = {"rule": pa.array(names, pa.string()), "verdict": pa.array(verdicts, pa.string())}
            yield pa.RecordBatch.from_arrays([made[f.name] if f.name in made else b.column(f.name).cast(f.type) for f in schema], schema=schema)

    return rows


def filter_urls(pages: DataFrame, rules: list[Rule], block_globs: list[str], *, url: str = "url") -> DataFrame:
    """``pages`` with host, path, rule and verdict; see the module's text."""
    u = F.coalesce(F.col(f"`{url}`").cast("string"), F.lit(""))
    src, (tmp,) = C.with_helpers(pages, ("host", "path", "rule", "verdict"), _url=u)
    u = F.col(tmp)
    at = F.instr(u, "://")
    tail = F.when(at > 0, F.substring(u, at + 3, F.length(u))).otherwise("")
    host = F.translate(F.regexp_extract(tail, r"(?s)^[^/?#]*", 0), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    path = F.regexp_extract(tail, r"(?s)^[^/?#]*([^?#]*)", 1)
    parsed = src.select("*", host.alias("host"), path.alias("path")).drop(tmp)
    schema, arrow = C.widened(parsed, "rule string, verdict string")
    return parsed.mapInArrow(_judge(rules, block_globs, arrow), schema)
