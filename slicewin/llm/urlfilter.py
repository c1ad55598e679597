"""Operator 5: URL filter, all glob rules at once by a bit-parallel automaton.

Every rule is a glob over the canonical URL (host in lower case, then path): ``*`` stands for any run
without ``/``, ``**`` for any run. The places of all globs are packed one after another into 64-bit
words. For a byte c, B[c] has the places that c reaches and L[c] those at which a wildcard holds c;
one step of all globs over a batch of URLs is D = (D << 1 & B[c]) | (D & L[c]), with the bits that
leave a word carried into the next.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from slicewin.llm.common import ascii_lower, table

#: (verdict, host and path): fits the host and its subdomains and paths that start so; the longest wins.
RULES = (
    ("allow", "com/"),
    ("block", "example.com/en/"),
    ("allow", "www.example.com/en/"),
    ("block", "net/es/"),
    ("block", "net/fr/"),
)
#: Globs that block a URL which no rule fits, in either case.
BLOCKED = ("**casino**", "**viagra**", "**porn**", "**xxx**", "**poker**", "**lottery**", "**/ads/**", "**.exe", "**.zip")

U = np.uint64


class Automaton:
    """``globs``: (pattern, whether either case fits). ``match`` tells which fit the whole of each text."""

    def __init__(self, globs: list[tuple[str, bool]]):
        places: list[tuple[bytes | None, str, bool]] = []  # byte that leads here, wildcard here, either case
        self.accept, starts = [], []
        for pattern, either in globs:
            starts.append(len(places))
            places.append((None, "", either))
            data, i = pattern.encode(), 0
            while i < len(data):
                if data[i : i + 1] == b"*":
                    j = i
                    while data[j : j + 1] == b"*":
                        j += 1
                    kind = "any" if j - i > 1 or places[-1][1] == "any" else "segment"
                    places[-1] = (places[-1][0], kind, either)
                    i = j
                else:
                    places.append((data[i : i + 1], "", either))
                    i += 1
            self.accept.append(len(places) - 1)
        n = -(-len(places) // 64) or 1
        self.B, self.L, self.start = np.zeros((256, n), U), np.zeros((256, n), U), np.zeros(n, U)
        for i, (lead, wild, either) in enumerate(places):
            bit = U(1 << i % 64)
            if lead is not None:
                for c in {lead, lead.lower(), lead.upper()} if either else {lead}:
                    self.B[c[0], i // 64] |= bit
            if wild:
                self.L[:, i // 64] |= bit
                if wild == "segment":
                    self.L[ord("/"), i // 64] &= ~bit
        for i in starts:
            self.start[i // 64] |= U(1 << i % 64)

    def match(self, texts: list[bytes]) -> np.ndarray:
        length = np.array([len(t) for t in texts], np.int64)
        order = np.argsort(-length, kind="stable")
        length = length[order]
        data = np.frombuffer(b"".join(texts[i] for i in order), np.uint8)
        begin = np.concatenate([[0], np.cumsum(length)[:-1]]) if len(texts) else length
        D = np.tile(self.start, (len(texts), 1))
        active = len(texts)
        for at in range(int(length[0]) if len(texts) else 0):
            while length[active - 1] <= at:
                active -= 1
            c, d = data[begin[:active] + at], D[:active]
            moved = d << U(1)
            moved[:, 1:] |= d[:, :-1] >> U(63)
            D[:active] = (moved & self.B[c]) | (d & self.L[c])
        out = np.empty((len(texts), len(self.accept)), bool)
        for k, i in enumerate(self.accept):
            out[order, k] = (D[:, i // 64] >> U(i % 64)) & U(1) != 0
        return out


def judge_urls(pages: DataFrame, rules=RULES, blocked=BLOCKED, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """page_id, host, path, rule, verdict of each row.

    A null url, or one without ``://``, has empty host and path; no rule and no glob fits it and the
    verdict is ``allow``, the one for everything that nothing blocks. Repeated rows are judged alike;
    other columns are not read; an empty table gives no rows. Time grows with the longest URL of a
    batch, memory with the bytes of a batch.
    """
    parts = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    url = F.coalesce(F.col(url_col), F.lit(""))
    rows = pages.select(
        F.col(id_col).alias("page_id"), ascii_lower(F.regexp_extract(url, parts, 1)).alias("host"), F.regexp_extract(url, parts, 2).alias("path")
    )
    globs = [(p, False) for _, r in rules for p in (f"{r}**", f"*.{r}**")] + [(b, True) for b in blocked]
    ranked = sorted(range(len(rules)), key=lambda k: len(rules[k][1]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = Automaton(globs)
        for b in batches:
            host, path = b.column(1).to_pylist(), b.column(2).to_pylist()
            hit = automaton.match([(h + p).encode() for h, p in zip(host, path, strict=True)])
            best = np.full(b.num_rows, -1)
            for k in ranked:
                best[hit[:, 2 * k] | hit[:, 2 * k + 1]] = k
            spam = hit[:, 2 * len(rules) :].any(axis=1)
            rule = [rules[k][1] if k >= 0 else None for k in best]
            verdict = [rules[k][0] if k >= 0 else ("block" if s else "allow") for k, s in zip(best, spam, strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(rule, pa.string()), pa.array(verdict, pa.string())], names=["page_id", "host", "path", "rule", "verdict"])

    kind = dict(rows.dtypes)["page_id"]
    return rows.mapInArrow(run, f"page_id {kind}, host string, path string, rule string, verdict string")


def op5_urlfilter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(table(spark, sf_dir, "pages"))


ORACLE_SQL = r"""
WITH p AS (
  SELECT page_id, translate(regexp_extract(coalesce(url, ''), '^.*?://([^/?#]*)([^?#]*)', 1, 's'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(coalesce(url, ''), '^.*?://([^/?#]*)([^?#]*)', 2, 's') AS path FROM pages),
r AS (
  SELECT *, CASE
    WHEN (host = 'www.example.com' OR ends_with(host, '.www.example.com')) AND starts_with(path, '/en/') THEN 'www.example.com/en/'
    WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/en/') THEN 'example.com/en/'
    WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/es/') THEN 'net/es/'
    WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/fr/') THEN 'net/fr/'
    WHEN (host = 'com' OR ends_with(host, '.com')) AND starts_with(path, '/') THEN 'com/' END AS rule FROM p)
SELECT page_id, host, path, rule, CASE
    WHEN rule IN ('com/', 'www.example.com/en/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block'
    WHEN regexp_matches(host || path, '(?is)casino|viagra|porn|xxx|poker|lottery|/ads/|\.exe$|\.zip$') THEN 'block' ELSE 'allow' END AS verdict
FROM r
"""
