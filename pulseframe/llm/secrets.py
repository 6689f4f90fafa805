"""Secret scans: key patterns, and sliding-window entropy over candidate strings."""

from __future__ import annotations

import math
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pulseframe.llm.common import fresh, text_or_empty

KINDS = ("assign", "access", "hex", "entropy")
ASSIGN = re.compile(r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")
MIN_ASSIGNED, MIN_ACCESS = 12, 18
#: Per class of characters: its name, the characters, the window and the bits a character from which a window is suspect.
CLASSES = (
    ("hex", "0123456789abcdefABCDEF", 20, 3.0),
    ("base64", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-", 24, 4.0),
)
#: Windows that touch one of these, in any case, are known to be harmless.
ALLOW = ("example", "abcdefghij", "0123456789", "placeholder", "xxxxxxxx", "changeme")


def suspect_windows(text: str, window: int, least_bits: float) -> list[int]:
    """Where the windows begin whose Shannon entropy is at least least_bits.

    With counts c of the characters in a window of w, the entropy is
    log2(w) - sum(c * log2(c)) / w; a step of the window changes two counts.
    """
    term = [0.0] + [c * math.log2(c) for c in range(1, window + 1)]
    most = window * (math.log2(window) - least_bits) + 1e-9
    count: dict[str, int] = {}
    total, starts = 0.0, []
    for i, c in enumerate(text):
        if i >= window:
            gone = text[i - window]
            n = count[gone]
            count[gone] = n - 1
            total += term[n - 1] - term[n]
        n = count.get(c, 0)
        count[c] = n + 1
        total += term[n + 1] - term[n]
        if i >= window - 1 and total <= most:
            starts.append(i - window + 1)
    return starts


def allowed_places(text: str, allow: tuple[str, ...]) -> list[tuple[int, int]]:
    """Spans of the allow-list's terms in the text, in order."""
    low, found = text.lower(), []
    for term in allow:
        at = low.find(term)
        while at >= 0:
            found.append((at, at + len(term)))
            at = low.find(term, at + 1)
    return sorted(found)


def by_allowance(starts: list[int], window: int, places: list[tuple[int, int]]) -> tuple[list[tuple[int, int]], list[tuple[int, int]]]:
    """Windows that touch none of the places, and those that do."""
    if not places:
        return [(s, s + window) for s in starts], []
    clear, harmless, k, reach = [], [], 0, -1
    for s in starts:
        while k < len(places) and places[k][0] < s + window:
            reach = max(reach, places[k][1])
            k += 1
        (harmless if reach > s else clear).append((s, s + window))
    return clear, harmless


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans joined where they overlap or meet, in order."""
    out: list[tuple[int, int]] = []
    for s, e in sorted(spans):
        if out and s <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], e))
        else:
            out.append((s, e))
    return out


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, end, kind) of the pattern matches, in code points."""
    found = [(m.start(), m.end(), 0) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= MIN_ASSIGNED]
    if "AKIA" in text:
        found += [(m.start(), m.end(), 1) for m in ACCESS.finditer(text) if m.end() - m.start() >= MIN_ACCESS]
    return found + [(m.start(), m.end(), 2) for m in HEX.finditer(text)]


class EntropyScan:
    """Finds candidate runs of each class by one table look-up a byte, then slides the window over them."""

    def __init__(self, classes=CLASSES, allow=ALLOW):
        self.allow = tuple(a.lower() for a in allow)
        self.classes = []
        for _, chars, window, bits in classes:
            table = np.zeros(256, bool)
            table[list(chars.encode())] = True
            self.classes.append((table, window, bits))

    def spans(self, text: str) -> tuple[list[tuple[int, int]], list[tuple[int, int]]]:
        """Suspect spans and those that the allow-list suppresses, in code points; the classes' spans are merged where they meet."""
        raw = text.encode()
        data = np.frombuffer(raw, np.uint8)
        clear: list[tuple[int, int]] = []
        harmless: list[tuple[int, int]] = []
        for table, window, bits in self.classes:
            if len(data) < window:
                continue
            inside = np.zeros(len(data) + 2, np.int8)
            inside[1:-1] = table[data]
            edges = np.flatnonzero(np.diff(inside))
            starts, ends = edges[::2], edges[1::2]
            for i in np.flatnonzero(ends - starts >= window).tolist():
                a, b = int(starts[i]), int(ends[i])
                run = raw[a:b].decode()
                suspect = suspect_windows(run, window, bits)
                if suspect:
                    for out, found in zip((clear, harmless), by_allowance(suspect, window, allowed_places(run, self.allow))):
                        out += [(a + s, a + e) for s, e in merged(found)]
        if not clear and not harmless:
            return [], []
        points = lambda spans: spans
        if len(raw) != len(text):  # bytes to code points: continuation bytes don't count
            ahead = np.cumsum((data & 0xC0) != 0x80)
            points = lambda spans: [(int(ahead[s]) - 1, int(ahead[e - 1])) for s, e in spans]
        return merged(points(clear)), merged(points(harmless))


SPAN = T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])
FOUND = T.StructType([T.StructField("spans", T.ArrayType(SPAN)), T.StructField("suppressed", T.ArrayType(SPAN))])
_SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
_FOUND = pa.struct([("spans", _SPANS), ("suppressed", _SPANS)])


def secret_spans(df: DataFrame, text: str = "text", out: str = "secret_spans", suppressed: str = "suppressed_spans", classes=CLASSES, allow=ALLOW) -> DataFrame:
    """Add the column out: array of (kind, start, end) sorted by start, then by kind as in KINDS;
    and the column suppressed: the entropy spans that the allow-list holds back.

    Offsets are code points, the end exclusive. Pattern matches stay as they are;
    spans of entropy come beside them, over them too. A null or empty text has empty
    arrays. Each row is scanned by itself, so repeated rows get equal spans, and an
    empty df gives no rows. Existing columns of the names out and suppressed are replaced;
    all others pass through. Any length of text is scanned whole, in time linear in
    its length.
    """
    name = fresh("_found", df)

    @F.arrow_udf(FOUND)
    def scan(texts: pa.Array) -> pa.Array:
        entropy = EntropyScan(classes, allow)
        rows = []
        for t in texts:
            t = t.as_py() or ""
            suspect, harmless = entropy.spans(t)
            found = base_spans(t) + [(s, e, 3) for s, e in suspect]
            shown = lambda spans: [{"kind": KINDS[k], "start": s, "end": e} for s, e, k in sorted(spans, key=lambda x: (x[0], x[2], x[1]))]
            rows.append({"spans": shown(found), "suppressed": shown([(s, e, 3) for s, e in harmless])})
        return pa.array(rows, _FOUND)

    found = df.withColumn(name, scan(text_or_empty(text)))
    return found.withColumns({out: F.col(name)["spans"], suppressed: F.col(name)["suppressed"]}).drop(name)
