"""URL filters: glob rules packed into multiword Shift-And masks, all simulated at once.

Globs match the whole of ``.host/path``: ``*`` is any run without a slash, ``**`` any run, ``?`` any
one byte; a backslash takes the next character as it is. One bit stands for each other character of
each rule; the bits of all rules lie end to end in 64-bit words. A step shifts every state by one,
takes in the rules that may begin here, keeps what the character allows, and adds back the states
that a star holds. Many URLs step together, a column of bytes at a time.

The base rules are held against host and path as they stand, the method's own against the canonical
URL: without user, port and the host's last dots, and with percent-escapes of letters, digits and
``-._~`` undone.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pixelyard.llm import textvec
from pixelyard.llm.common import map_batches

ONE, STAR, STARS = object(), object(), object()
#: URLs that step together.
BLOCK = 2048


@dataclass(frozen=True)
class Rule:
    """A glob, its verdict, the name to report (None: an unnamed rule of the method) and its rank: the highest wins."""

    glob: str
    verdict: str
    name: str | None = None
    rank: int = 0
    canonical: bool = True
    """held against the canonical URL, not the URL as it stands"""


def host_rule(rule: str, verdict: str) -> Rule:
    """A rule ``host/path``: it fits the host and all its subdomains where the path starts with the rule's."""
    host, slash, path = rule.partition("/")
    plain = "".join("\\" + c if c in "*?\\" else c for c in f".{host}{slash}{path}")
    return Rule(f"*{plain}**", verdict, rule, 1_000_000 + len(rule), canonical=False)


def parse(glob: str) -> list:
    out, i = [], 0
    while i < len(glob):
        if glob[i] == "\\" and i + 1 < len(glob):
            out += list(glob[i + 1].encode())
            i += 2
        elif glob.startswith("**", i):
            out.append(STARS)
            i += 2
        elif glob[i] in "*?":
            out.append(STAR if glob[i] == "*" else ONE)
            i += 1
        else:
            out += list(glob[i].encode())
            i += 1
    return out


class Automaton:
    def __init__(self, rules: list[Rule]):
        self.rules = rules
        parts = [parse(r.glob) for r in rules]
        if not all(any(x not in (STAR, STARS) for x in p) for p in parts):
            raise ValueError("a rule needs a character besides stars")
        bits = sum(1 for p in parts for x in p if x not in (STAR, STARS))
        self.width = max(1, -(-bits // 64))
        masks = lambda *shape: np.zeros((*shape, self.width), dtype=np.uint64)
        self.allow, self.hold = masks(256), masks(256)
        self.first, self.anywhere, self.in_segment = masks(), masks(), masks()
        self.last: list[tuple[int, np.uint64]] = []
        at = 0
        for p in parts:
            start, before = at, None
            for x in p:
                if x in (STAR, STARS):
                    if at == start:
                        before = STARS if STARS in (x, before) else x
                    else:
                        word, bit = divmod(at - 1, 64)
                        held = np.ones(256, dtype=bool)
                        held[47] = x is STARS
                        self.hold[held, word] |= np.uint64(1 << bit)
                    continue
                word, bit = divmod(at, 64)
                self.allow[slice(None) if x is ONE else x, word] |= np.uint64(1 << bit)
                at += 1
            word, bit = divmod(start, 64)
            self.first[word] |= np.uint64(1 << bit)
            if before is not None:
                (self.anywhere if before is STARS else self.in_segment)[word] |= np.uint64(1 << bit)
            word, bit = divmod(at - 1, 64)
            self.last.append((word, np.uint64(1 << bit)))

    def _run(self, data: np.ndarray, begin: np.ndarray, length: np.ndarray) -> np.ndarray:
        """The states after each string; strings come longest first."""
        state = np.zeros((len(begin), self.width), dtype=np.uint64)
        flat = np.ones(len(begin), dtype=bool)
        one, top = np.uint64(1), np.uint64(63)
        for j in range(int(length[0]) if len(length) else 0):
            n = int(np.searchsorted(-length, -j, side="left"))
            c, now = data[begin[:n] + j], state[:n]
            moved = now << one
            moved[:, 1:] |= now[:, :-1] >> top
            moved &= ~self.first
            moved |= self.first if j == 0 else self.anywhere | np.where(flat[:n, None], self.in_segment, np.uint64(0))
            state[:n] = (moved & self.allow[c]) | (now & self.hold[c])
            flat[:n] &= c != 47
        return state

    def matches(self, strings: pa.Array) -> np.ndarray:
        """For each string and rule, whether the rule's glob matches the whole string."""
        data, offsets = textvec.flat(strings)
        length = np.diff(offsets)
        out = np.zeros((len(length), len(self.rules)), dtype=bool)
        order = np.argsort(-length, kind="stable")
        for i in range(0, len(order), BLOCK):
            rows = order[i : i + BLOCK]
            state = self._run(data, offsets[rows], length[rows])
            for k, (word, bit) in enumerate(self.last):
                out[rows, k] = state[:, word] & bit != 0
        return out


#: The base rules.
BASE = [host_rule("org/", "allow"), host_rule("example.org/es/", "block"), host_rule("example.org/en/1", "block"), host_rule("com/fr/", "allow"), host_rule("com/de/", "block")]
#: The method's own rules, for URLs that no base rule fits.
OWN = [
    *[Rule(glob, "block", rank=3) for glob in ("*spam-farm.**", "*cheap-pills.**", "*.casino-*.**")],
    *[Rule(glob, "block", rank=2) for glob in ("*.ads.**", "*.adserver.**", "*.tracking.**")],
    *[Rule(glob, "block", rank=1) for glob in ("*/wp-login.php", "*/**/wp-login.php", "*/cgi-bin/**", "*/**/cgi-bin/**", "**.exe", "**.apk")],
]
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Characters that mean the same escaped or not.
UNRESERVED = UPPER + LOWER + "0123456789-._~"
_ESCAPE = re.compile("%([0-9A-Fa-f]{2})")
_PORT = re.compile(":[0-9]*\\Z")


def canonical(host: str, path: str) -> str:
    """``.host/path`` without user, port and last dots; escapes that stand for unreserved characters are undone until none is left."""
    host = _PORT.sub("", host[host.rfind("@") + 1 :]).rstrip(".")
    before = None
    while "%" in path and path != before:
        before, path = path, _ESCAPE.sub(lambda m: c if (c := chr(int(m[1], 16))) in UNRESERVED else m[0], path)
    return f".{host}{path}"


def judge(pages: DataFrame, rules: list[Rule] | None = None, default: str = "allow", unparsed: str = "block") -> DataFrame:
    """``page_id, host, path, rule, verdict`` of each row of ``pages(page_id, url)``.

    The fitting rule of the highest rank decides (the earlier of equal ones). With none, a URL without
    a host gets ``unparsed`` and any other ``default``. A null url, or one without ``://``, has an empty
    host and path. Repeated rows give repeated rows; an empty table gives no rows; other columns are ignored.
    """
    rules = BASE + OWN if rules is None else rules
    at = F.instr("url", "://")
    rest = F.when(at > 0, F.expr("substring(url, instr(url, '://') + 3)")).otherwise("")
    parts = pages.select("page_id", "url").withColumn("rest", F.coalesce(rest, F.lit("")))
    parts = parts.select("page_id", F.translate(F.regexp_extract("rest", "^[^/?#]*", 0), UPPER, LOWER).alias("host"), F.regexp_extract("rest", "^[^/?#]*([^?#]*)", 1).alias("path"))
    automaton = Automaton(rules)
    order = sorted(range(len(rules)), key=lambda k: -rules[k].rank)
    own = [k for k, r in enumerate(rules) if r.canonical]

    def decide(batch: pa.RecordBatch) -> pa.RecordBatch:
        hosts, paths = batch["host"].to_pylist(), batch["path"].to_pylist()
        plain = [f".{h}{p}" for h, p in zip(hosts, paths, strict=True)]
        fits = automaton.matches(pa.array(plain, pa.large_string()))
        plainer = [canonical(h, p) for h, p in zip(hosts, paths, strict=True)]
        if odd := [i for i, (x, y) in enumerate(zip(plain, plainer, strict=True)) if x != y]:
            fits[np.ix_(odd, own)] = automaton.matches(pa.array([plainer[i] for i in odd], pa.large_string()))[:, own]
        best = np.full(len(hosts), -1)
        for k in reversed(order):
            best[fits[:, k]] = k
        names = [rules[k].name if k >= 0 else None for k in best.tolist()]
        verdicts = [rules[k].verdict if k >= 0 else default if h else unparsed for k, h in zip(best.tolist(), hosts, strict=True)]
        return pa.RecordBatch.from_arrays([batch["page_id"], batch["host"], batch["path"], pa.array(names, pa.string()), pa.array(verdicts, pa.string())], names=["page_id", "host", "path", "rule", "verdict"])

    kind = pages.schema["page_id"].dataType.simpleString()
    return map_batches(parts, decide, f"page_id {kind}, host string, path string, rule string, verdict string")
