"""Operator 7: URL filters.

All glob rules are packed side by side into multiword bit masks, and one Shift-And automaton reads each
canonical URL once, stepping every rule at the same time: a rule of m literals owns m + 1 bits, a literal moves
its bit on, a wildcard holds it. numpy steps all URLs of a batch together, one character position at a time.

A canonical URL is host + path: the host runs from after the first '://' to '/', '?', '#' or the end, with A-Z
lower-cased; the path from there to '?', '#' or the end. A host holds no '/', so the first one ends it. In a
glob '?' is one character but '/', '*' any run without '/', '**' any run at all; a glob must fit the whole URL.
A rule (host, path) becomes the globs 'host path**' and '*.host path**'.

Of the host rules that fit, the longest wins (of equal ones the first). Where none fits, the pattern globs
decide: block if one fits, else allow.

Defined cases: null url or no '://' gives empty host and path, no rule, and the verdict of an empty URL; an
empty path fits no rule whose path is '/'; repeated rows are judged each; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrazone.llm.common import map_texts

#: (verdict, host/path), as named by the contract of op7.
HOST_RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))
#: Globs of hosts and paths that a web corpus leaves out; the method's own verdict.
BLOCK_GLOBS = ("*casino*", "*casino*/**", "*viagra*", "*viagra*/**", "*cheap-pills*", "*cheap-pills*/**", "*porn*", "*porn*/**", "*xxx*", "*xxx*/**", "**/wp-login.php**", "**/cgi-bin/**")


def host_path(url: Column) -> tuple[Column, Column]:
    """Host and path by the rules above, as native expressions."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + F.lit(3))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), path


class GlobAutomaton:
    """Shift-And over any number of globs, 64 bits to a word."""

    def __init__(self, globs: Sequence[str]):
        self.globs = list(globs)
        parsed = [self._parse(g) for g in self.globs]
        bits = sum(len(literals) + 1 for literals, _ in parsed)
        self.words = max(1, -(-bits // 64))
        step = np.zeros((256, self.words * 64), bool)  # bits that a byte may move on to
        hold = np.zeros((256, self.words * 64), bool)  # bits that a byte may stay on
        self.first, self.last = [], []
        any_but = np.ones(256, bool)
        any_but[ord("/")] = False
        at = 0
        for literals, stars in parsed:
            self.first.append(at)
            for k, byte in enumerate(literals, 1):
                step[:, at + k] |= any_but if byte is None else np.arange(256) == byte
            for k, star in stars.items():
                hold[:, at + k] |= True if star == "**" else any_but
            at += len(literals) + 1
            self.last.append(at - 1)
        self.step, self.hold = self._pack(step), self._pack(hold)
        start = np.zeros((1, self.words * 64), bool)
        start[0, self.first] = True
        self.start = self._pack(start)[0]

    @staticmethod
    def _parse(glob: str) -> tuple[list[int | None], dict[int, str]]:
        literals: list[int | None] = []
        stars: dict[int, str] = {}
        data, i = glob.encode(), 0
        while i < len(data):
            if data[i : i + 2] == b"**":
                stars[len(literals)] = "**"
                i += 2
            elif data[i : i + 1] == b"*":
                stars.setdefault(len(literals), "*")
                i += 1
            else:
                literals.append(None if data[i : i + 1] == b"?" else data[i])
                i += 1
        return literals, stars

    def _pack(self, bits: np.ndarray) -> np.ndarray:
        packed = np.packbits(bits, axis=1, bitorder="little")
        return np.ascontiguousarray(packed).view("<u8").reshape(len(bits), self.words).astype(np.uint64)

    def fits(self, urls: list[bytes]) -> np.ndarray:
        """Which glob fits which URL: booleans, URLs by globs."""
        sizes = np.fromiter(map(len, urls), np.int64, len(urls))
        order = np.argsort(-sizes, kind="stable")
        buffer = np.frombuffer(b"".join(urls), np.uint8)
        starts = (np.cumsum(sizes) - sizes)[order]
        falling = -sizes[order]
        state = np.tile(self.start, (len(urls), 1))
        for pos in range(int(sizes.max(initial=0))):
            live = int(np.searchsorted(falling, -pos, "left"))  # those longer than pos
            byte = buffer[starts[:live] + pos]
            now = state[:live]
            moved = now << np.uint64(1)
            moved[:, 1:] |= now[:, :-1] >> np.uint64(63)
            state[:live] = (moved & self.step[byte]) | (now & self.hold[byte])
        last = np.array(self.last, np.int64)
        found = np.empty((len(urls), len(last)), bool)
        found[order] = (state[:, last // 64] >> (last % 64).astype(np.uint64)) & np.uint64(1) != 0
        return found


class UrlJudge:
    def __init__(self, rules: Sequence[tuple[str, str]], block_globs: Sequence[str]):
        globs: list[str] = []
        self.rules = sorted(rules, key=lambda r: -len(r[1]))  # stable: the first of equal length
        for _, rule in self.rules:
            globs += [f"{rule}**", f"*.{rule}**"]
        self.automaton = GlobAutomaton([*globs, *block_globs])

    def judge(self, urls: list[bytes]) -> tuple[list[str | None], list[str]]:
        found = self.automaton.fits(urls)
        n = len(self.rules)
        host = found[:, : 2 * n].reshape(len(urls), n, 2).any(axis=2)
        blocked = found[:, 2 * n :].any(axis=1)
        rule, verdict = [], []
        for hit, best, block in zip(host.any(axis=1), host.argmax(axis=1) if n else np.zeros(len(urls), int), blocked):
            rule.append(self.rules[best][1] if hit else None)
            verdict.append(self.rules[best][0] if hit else "block" if block else "allow")
        return rule, verdict


def filter_urls(df: DataFrame, rules: Sequence[tuple[str, str]] = HOST_RULES, block_globs: Sequence[str] = BLOCK_GLOBS, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """One row per input row: id, host, path, rule, verdict."""
    kind = dict(df.dtypes)[id_col]
    rules, block_globs = tuple(rules), tuple(block_globs)

    def make():
        judge = UrlJudge(rules, block_globs)

        def step(part: pa.RecordBatch) -> dict:
            host, path = part.column("host").to_pylist(), part.column("path").to_pylist()
            rule, verdict = judge.judge([(h + p).encode() for h, p in zip(host, path)])
            return {id_col: part.column("id"), "host": host, "path": path, "rule": rule, "verdict": verdict}

        return step

    host, path = host_path(df[url_col])
    picked = df.select(df[id_col].alias("id"), host.alias("host"), path.alias("path"))
    return map_texts(picked, make, f"{id_col} {kind}, host string, path string, rule string, verdict string", "path")


ORACLE_SQL = """
with u as (select page_id, case when instr(url, '://') > 0 then substr(url, instr(url, '://') + 3) else '' end as rest from pages),
s as (select page_id, coalesce(rest, '') as rest from u),
p as (select page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
  regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) as path from s),
r as (select page_id, host, path, case
  when (host = 'example.com' or suffix(host, '.example.com')) and prefix(path, '/de/') then 'example.com/de/'
  when (host = 'example.net' or suffix(host, '.example.net')) and prefix(path, '/en/') then 'example.net/en/'
  when (host = 'org' or suffix(host, '.org')) and prefix(path, '/fr/') then 'org/fr/'
  when (host = 'net' or suffix(host, '.net')) and prefix(path, '/') then 'net/' end as rule from p)
select page_id, host, path, rule, case
  when rule in ('net/', 'example.com/de/') then 'block' when rule is not null then 'allow'
  when contains(host, 'casino') or contains(host, 'viagra') or contains(host, 'cheap-pills') or contains(host, 'porn') or contains(host, 'xxx') then 'block'
  when contains(path, '/wp-login.php') or contains(path, '/cgi-bin/') then 'block'
  else 'allow' end as verdict
from r
"""
