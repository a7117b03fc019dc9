"""URL filters: all wildcard rules run at once as one bit-parallel automaton.

Every rule becomes a chain of states, one bit each, packed side by side into 64-bit words. Reading a byte moves all
states at once (Shift-And): states step on where the next element accepts the byte, and stay where a star stands. A batch
of URLs runs in lockstep over a matrix of words, longest first, so the cost is the sum of their lengths.

The text that is read is "." + host + SEP + path with a byte SEP that no UTF-8 text holds: host wildcards stop at SEP.

Defined results: a url that is null or has no "://" has empty host and path, fits no host rule, and is judged by the
wildcards for an empty host; the longest fitting rule wins, ties go to the first listed; a repeated row gets its own
output row; a null id is kept; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

SEP = 0xFF
#: (verdict, host, path): fits the host and its subdomains if the path starts with the rule's.
RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"))
#: Host wildcards and path wildcards that block what no rule decides. "?" is one character's byte, "*" any run.
WILDCARDS = (("", "*"), ("*spam*", "*"), ("*adult*", "*"), ("*casino*", "*"), ("*", "*/wp-login*"), ("*", "*.exe"), ("tracker?.*", "*"))

_STEP, _HOST_STAR, _PATH_STAR = range(3)


def _elements(host: str, path: str) -> list[tuple[int, int | None]]:
    """(kind, byte) of a wildcard over "." + host + SEP + path; byte None: any."""
    out: list[tuple[int, int | None]] = []
    for text, star in ((host, _HOST_STAR), (path, _PATH_STAR)):
        for c in text.encode():
            out.append((star, None) if c == 0x2A else (_STEP, None if c == 0x3F else c))
        if star == _HOST_STAR:
            out.append((_STEP, SEP))
    return out


class Automaton:
    """Tells which of some wildcards match a text, for many texts at a time."""

    def __init__(self, patterns: Sequence[list[tuple[int, int | None]]]) -> None:
        bits, self.final, start = 0, [], []
        step: list[tuple[int, int | None]] = []
        stay: list[tuple[int, bool]] = []
        for p in patterns:
            start.append(bits)
            for kind, byte in p:
                if kind == _STEP:
                    bits += 1
                    step.append((bits, byte))
                else:
                    stay.append((bits, kind == _PATH_STAR))
            self.final.append(bits)
            bits += 1
        self.words = -(-max(bits, 1) // 64)
        self.move = np.zeros((256, self.words), dtype=np.uint64)
        self.loop = np.zeros((256, self.words), dtype=np.uint64)
        self.start = np.zeros(self.words, dtype=np.uint64)
        one = lambda b: (b // 64, np.uint64(1 << b % 64))
        for b, byte in step:
            w, m = one(b)
            self.move[slice(0, SEP) if byte is None else byte, w] |= m
        for b, everywhere in stay:
            w, m = one(b)
            self.loop[: 256 if everywhere else SEP, w] |= m
        for b in start:
            w, m = one(b)
            self.start[w] |= m

    def matches(self, texts: Sequence[bytes]) -> np.ndarray:
        """A row for each text, a boolean for each pattern."""
        n = len(texts)
        sizes = np.fromiter(map(len, texts), dtype=np.int64, count=n)
        order = np.argsort(-sizes, kind="stable")
        data = np.frombuffer(b"".join(texts) or b"\0", dtype=np.uint8)
        starts = (np.cumsum(sizes) - sizes)[order]
        state = np.tile(self.start, (n, 1))
        live = np.searchsorted(-sizes[order], -np.arange(1, int(sizes.max(initial=0)) + 1), side="right")
        for t, m in enumerate(live.tolist()):
            c = data[starts[:m] + t]
            d = state[:m]
            up = d << np.uint64(1)
            up[:, 1:] |= d[:, :-1] >> np.uint64(63)
            state[:m] = (up & self.move[c]) | (d & self.loop[c])
        out = np.empty((n, len(self.final)), dtype=bool)
        for k, b in enumerate(self.final):
            out[order, k] = (state[:, b // 64] >> np.uint64(b % 64)) & np.uint64(1) != 0
        return out


def parts(url: str | None) -> tuple[str, str]:
    """Host (A-Z lower-cased) and path of a url."""
    _, found, rest = (url or "").partition("://")
    if not found:
        return "", ""
    end = min((i for c in "/?#" if (i := rest.find(c)) >= 0), default=len(rest))
    host, tail = rest[:end], rest[end:]
    if not tail.startswith("/"):
        return _lower(host), ""
    stop = min((i for c in "?#" if (i := tail.find(c)) >= 0), default=len(tail))
    return _lower(host), tail[:stop]


def _lower(host: str) -> str:
    return host.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")


def judge(pages: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES, wildcards: Sequence[tuple[str, str]] = WILDCARDS, page_id: str = "page_id", url: str = "url") -> DataFrame:
    """page_id, host, path, rule (null if none fits) and verdict for every row of pages."""
    ranked = sorted(rules, key=lambda r: -len(r[1] + r[2]))
    patterns = [[(_HOST_STAR, None), *_elements("." + host, path), (_PATH_STAR, None)] for _, host, path in ranked]
    patterns += [_elements("." + host, path) for host, path in wildcards]
    names = [host + path for _, host, path in ranked]
    verdicts = [verdict for verdict, _, _ in ranked]
    rows = pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = Automaton(patterns)
        for b in batches:
            split = [parts(u) for u in b.column("url").to_pylist()]
            hit = machine.matches([b"." + h.encode("utf-8", "surrogatepass") + bytes([SEP]) + p.encode("utf-8", "surrogatepass") for h, p in split])
            ruled, other = hit[:, : len(names)], hit[:, len(names) :].any(axis=1)
            first = np.where(ruled.any(axis=1), ruled.argmax(axis=1) if names else 0, -1).tolist()
            yield pa.RecordBatch.from_arrays(
                [
                    b.column("page_id"),
                    pa.array([h for h, _ in split], pa.string()),
                    pa.array([p for _, p in split], pa.string()),
                    pa.array([names[k] if k >= 0 else None for k in first], pa.string()),
                    pa.array([verdicts[k] if k >= 0 else ("block" if bad else "allow") for k, bad in zip(first, other.tolist())], pa.string()),
                ],
                ["page_id", "host", "path", "rule", "verdict"],
            )

    text = [T.StructField(c, T.StringType()) for c in ("host", "path", "rule", "verdict")]
    return rows.mapInArrow(run, T.StructType([rows.schema["page_id"], *text]))


ORACLE = r"""
WITH u AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substring(url, strpos(url, '://') + 3) ELSE '' END AS r FROM pages),
s AS (SELECT page_id, translate(regexp_extract(r, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(r, '^[^/?#]*(/[^?#]*)', 1) AS path FROM u),
rules AS (SELECT * FROM (VALUES ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'), ('allow', 'com', '/fr/'), ('block', 'com', '/de/')) AS v(verdict, h, p)),
f AS (SELECT page_id, arg_max(h || p, length(h || p)) AS rule, arg_max(verdict, length(h || p)) AS verdict FROM s JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY page_id)
SELECT s.page_id, host, path, rule, coalesce(verdict, CASE WHEN host = '' OR regexp_matches(host, 'spam|adult|casino') OR contains(path, '/wp-login') OR ends_with(path, '.exe') OR regexp_matches(host, '^tracker.\.') THEN 'block' ELSE 'allow' END) AS verdict
FROM s LEFT JOIN f ON s.page_id = f.page_id
"""
