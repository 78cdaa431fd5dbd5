"""Secret scans: an Aho-Corasick keyword prefilter, regular expressions anchored at the
hits, then validation of the checksums that some formats embed.

Keywords are sought in the text with A-Z lower-cased (offsets stay), so a text without
any keyword costs one automaton pass. Hexadecimal strings have no keyword and are found
by their own maximal runs.
"""

from __future__ import annotations

import base64
import binascii
import hashlib
import json
import re
import zlib
from collections.abc import Callable, Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagelattice.runtime import tidy

#: In the order in which equal starts are listed.
KINDS = ("assign", "access", "hex", "github", "npm", "jwt", "slack", "stripe", "google", "pem")

_ASSIGN = re.compile(
    r"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII
)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{16,}")
_BASE62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"


def crc_suffix(body: str) -> str:
    """The six base-62 digits of a body's CRC-32, as code-host tokens end in."""
    n, out = zlib.crc32(body.encode()), ""
    for _ in range(6):
        n, d = divmod(n, 62)
        out = _BASE62[d] + out
    return out


def _crc_ok(m: re.Match) -> bool:
    return crc_suffix(m.group(1)[:-6]) == m.group(1)[-6:]


_JWT_RUN = re.compile(r"[A-Za-z0-9_-]+")
_JWT_REST = re.compile(r"\.[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}+")
#: Longer headers are no tokens; the bound keeps the scan linear.
JWT_HEADER = 4096


def _jwt_ok(head: str) -> bool:
    """The header must be base64url of a JSON object that names an algorithm."""
    try:
        return "alg" in json.loads(base64.urlsafe_b64decode(head + "=" * (-len(head) % 4)))
    except (ValueError, binascii.Error, TypeError, RecursionError):
        return False


#: kind -> keywords, anchored expression, validation
_MORE: dict[str, tuple[tuple[str, ...], re.Pattern, Callable[[re.Match], bool] | None]] = {
    "github": (("ghp_", "gho_", "ghu_", "ghs_", "ghr_"), re.compile(r"gh[pousr]_([A-Za-z0-9]{36})(?![A-Za-z0-9])"), _crc_ok),
    "npm": (("npm_",), re.compile(r"npm_([A-Za-z0-9]{36})(?![A-Za-z0-9])"), _crc_ok),
    "slack": (("xoxa-", "xoxb-", "xoxp-", "xoxr-", "xoxs-"), re.compile(r"xox[abprs]-[0-9]{8,14}-[0-9A-Za-z-]{12,}"), None),
    "stripe": (("sk_live_", "rk_live_"), re.compile(r"[sr]k_live_[0-9A-Za-z]{24,}"), None),
    "google": (("aiza",), re.compile(r"AIza[0-9A-Za-z_-]{35}(?![0-9A-Za-z_-])"), None),
    "pem": (
        ("-----begin ",),
        re.compile(r"-----BEGIN (?:[A-Z]+ )?PRIVATE KEY-----(?:[A-Za-z0-9+/=\s]*-----END (?:[A-Z]+ )?PRIVATE KEY-----)?"),
        None,
    ),
}


class _Tokens:
    """Web tokens of one text: header, payload and signature, joined by points.

    All starts within one run of header characters share its end and what follows, which
    are sought once, so a run of any number of starts costs its length.
    """

    def __init__(self, text: str) -> None:
        self.text, self.run_end, self.end = text, 0, -1

    def end_at(self, start: int) -> int:
        """The end of the token that starts here, or -1."""
        text = self.text
        if text[start : start + 3] != "eyJ":
            return -1
        if start >= self.run_end:
            self.run_end = _JWT_RUN.match(text, start).end()
            rest = _JWT_REST.match(text, self.run_end)
            self.end = rest.end() if rest else -1
        size = self.run_end - start
        return self.end if self.end >= 0 and 11 <= size <= JWT_HEADER and _jwt_ok(text[start : self.run_end]) else -1


def _automaton() -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    words = {w: "assign" for w in ("password", "passwd", "secret", "token", "apikey", "api_key")} | {"akia": "access"}
    words |= {w: kind for kind, (keys, _, _) in _MORE.items() for w in keys} | {"eyj": "jwt"}
    for w, kind in words.items():
        found.add_word(w, (len(w), kind))
    found.make_automaton()
    return found


_KEYWORDS: list[ahocorasick.Automaton] = []


def scan(text: str | None) -> list[tuple[int, int, str, int]]:
    """``(start, order of kind, kind, end)`` of all spans of a text in code points, sorted.

    Spans of a kind do not overlap (leftmost first); spans of different kinds may. An
    assignment whose value is shorter than 12 characters is consumed, then dropped.
    """
    if not text:
        return []
    if not _KEYWORDS:
        _KEYWORDS.append(_automaton())
    low = text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")
    spans, tokens = [], _Tokens(text)
    free = dict.fromkeys(KINDS, 0)
    for last, (size, kind) in _KEYWORDS[0].iter(low):
        start = last - size + 1
        if start < free[kind]:
            continue
        if kind == "jwt":
            end = tokens.end_at(start)
            if end >= 0:
                spans.append((start, KINDS.index(kind), kind, end))
                free[kind] = end
            continue
        if kind == "assign":
            m = _ASSIGN.match(text, start)
            ok = m and len(m.group(1)) >= 12
        elif kind == "access":
            m = _ACCESS.match(text, start)
            ok = m and len(m.group()) >= 18
        else:
            _, pattern, valid = _MORE[kind]
            m = pattern.match(text, start)
            ok = m and (valid is None or valid(m))
        if m:
            free[kind] = m.end() if ok or kind in ("assign", "access") else start + 1
            if ok:
                spans.append((start, KINDS.index(kind), kind, m.end()))
    spans += [(m.start(), 2, "hex", m.end()) for m in _HEX.finditer(text)]
    spans.sort()
    return spans


def joined(spans: list[tuple[int, int, str, int]]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for start, _, kind, end in spans)


REPLACEMENT = "[SECRET]"


def redact(text: str | None) -> str | None:
    """The text with every secret value replaced; an assignment keeps its name and quotes."""
    spans = scan(text)
    if not spans:
        return text
    values = sorted((_ASSIGN.match(text, a).start(1) if kind == "assign" else a, b) for a, _, kind, b in spans)
    out, at, end = [], 0, -1
    for a, b in values:
        if a >= end:  # else it overlaps the value before
            out += [text[at:a], REPLACEMENT]
        at = end = max(end, b)
    return "".join(out) + text[at:]


_SCHEMA = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_more long"


def _scan_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for text in batch.column(1):
            spans = scan(text.as_py())
            base = [x for x in spans if x[1] < 3]
            n = [sum(x[1] == k for x in base) for k in range(3)]
            rows.append((*n, hashlib.sha256(joined(base).encode()).hexdigest(), joined(spans), len(spans) - len(base)))
        cols = list(zip(*rows)) or [()] * 6
        kinds = [*[pa.int64()] * 3, pa.string(), pa.string(), pa.int64()]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), *map(pa.array, cols, kinds)],
            names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_more"],
        )


def scan_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_more)`` per row.

    Null and empty texts have no spans. Null ids and repeated rows pass through; other
    columns are ignored; an empty table gives no rows.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(_scan_batches, _SCHEMA)


def redact_rows(docs: DataFrame, text_col: str = "text", length_col: str | None = "n_chars") -> DataFrame:
    """``docs`` with secrets redacted; ``length_col``, where it exists, follows the new text."""
    at, names, schema = docs.columns.index(text_col), docs.columns, docs.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(at)
            new = pa.array([redact(x.as_py()) for x in column], column.type)
            yield pa.RecordBatch.from_arrays([new if i == at else batch.column(i) for i in range(len(names))], names=names)

    out = docs.mapInArrow(tidy(__name__, run), schema)
    if length_col in names:
        same = F.col(text_col).isNull()
        out = out.withColumn(length_col, F.when(same, F.col(length_col)).otherwise(F.length(text_col)).cast(schema[length_col].dataType))
    return out


def op6_secrets(spark, sf_dir: str) -> DataFrame:
    return scan_rows(spark.read.parquet(f"{sf_dir}/documents.parquet"))
