"""Personal data: loose generators propose overlapping spans, boosted trees score them, thresholds decide.

Strict forms (an address with a domain, four octets, digits with a valid check digit, an international number) are
always found. Looser forms are proposed by generators made for recall: any run with an at sign, written out or spaced, any run
of digit groups, masked digits, any token with a digit. Trees learn from format and context features what a damaged form of
personal data looks like: strict finds of a bounded sample are damaged where they stand (plus sign or country code dropped, address
spaced or spelled out, digits masked) and count as positive; negative are all other proposals of the sample, numbers whose check
digit fails among them, and numbers of other kinds (time stamps, book and order numbers, dates, versions) put in the same places.
A threshold per kind, calibrated on held-out documents, selects the additional spans.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .boosting import Boosted, boost, calibrated_threshold
from .tables import bounded_sample, pick
from .textio import byte_set, group_sums, pieces, text_bytes

KINDS = ("email", "ip", "card", "phone")
#: Documents that the trees are trained on, at most, and the bytes of one of these documents.
TRAIN_DOCUMENTS, TRAIN_BYTES = 20_000, 1 << 15
#: Proposals and strict finds of one of these documents, at most, picked by a hash.
TRAIN_PROPOSALS, TRAIN_FINDS = 20, 4
#: Share of right selections that a threshold must reach on held-out proposals.
PRECISION = 0.95

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
# A match never starts inside a run of digits, which keeps long runs linear.
OCTETS = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
GROUPS = re.compile(r"[+(]{0,2}[0-9][0-9\x20().-]*[0-9]")
TOKENS = re.compile(r"[A-Za-z0-9@._%+-]+")
AT = re.compile(r"@|[\[(]at[\])]")
SPELLED = re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]+(?:\x20?@\x20?|\x20?[\[(]at[\])]\x20?)[A-Za-z0-9-]+(?:(?:\.|\x20?[\[(]dot[\])]\x20?)[A-Za-z0-9-]+)+")
SPACED_OCTETS = re.compile(r"(?<![0-9])[0-9]{1,3}(?:\x20?\[?\.\]?\x20?[0-9]{1,3}){3}(?![0-9])")
MASKED = re.compile(r"(?<![0-9A-Za-z*])(?:[0-9]{4}|[Xx*]{4})(?:[\x20-]?[0-9Xx*]{4}){2}[\x20-]?[0-9Xx*]{1,7}(?![0-9A-Za-z*])")
MASKS = re.compile(r"[Xx*]")
MARK = re.compile(r"[0-9@]")
MARKED = byte_set(b"0123456789@[(")
HINTS = {
    "email": ("mail", "contact"), "ip": ("ip", "host", "server", "address"),
    "card": ("card", "visa", "account", "credit"), "phone": ("phone", "tel", "call", "fax", "mobile"),
}

Span = tuple[int, int, str]


def emails(text: str) -> list[tuple[int, int]]:
    found, done, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in LOCAL:
            start -= 1
        match = DOMAIN.match(text, at + 1) if start < at else None
        if match:
            done = match.end()
            found.append((start, done))
        at = text.find("@", max(at + 1, done))
    return found


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def strict_spans(text: str) -> list[Span]:
    """All strict finds: leftmost and non-overlapping within a kind, failing matches dropped."""
    found: list[Span] = [(a, b, "email") for a, b in emails(text)]
    for m in OCTETS.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in m.group().split(".")):
            found.append((*m.span(), "ip"))
    for m in CARD.finditer(text):
        digits = _digits(m.group())
        if 12 <= len(digits) <= 19 and luhn(digits):
            found.append((*m.span(), "card"))
    for m in PHONE.finditer(text):
        if 9 <= len(_digits(m.group())) <= 15:
            found.append((*m.span(), "phone"))
    return sorted(found, key=lambda s: (s[0], KINDS.index(s[2])))


def proposals(text: str) -> list[Span]:
    """Loose spans of every kind; they may overlap each other and the strict finds."""
    found: set[Span] = set(strict_spans(text))
    for m in TOKENS.finditer(text):
        own = m.group().rstrip(".%+-")
        if not MARK.search(own):
            continue
        a, b = m.start(), m.start() + len(own)
        if "@" in own:
            found.add((a, b, "email"))
        elif own.count(".") >= 2:
            found.add((a, b, "ip"))
        elif b - a >= 7:
            found.add((a, b, "card" if len(_digits(own)) >= 12 else "phone"))
    if AT.search(text):
        found.update((*m.span(), "email") for m in SPELLED.finditer(text))
    found.update((*m.span(), "ip") for m in SPACED_OCTETS.finditer(text))
    found.update((*m.span(), "card") for m in MASKED.finditer(text) if MARK.search(m.group()) and MASKS.search(m.group()))
    for m in GROUPS.finditer(text):
        n = len(_digits(m.group()))
        if 7 <= n <= 15:
            found.add((*m.span(), "phone"))
        if 12 <= n <= 19:
            found.add((*m.span(), "card"))
    return sorted(found, key=lambda s: (s[0], KINDS.index(s[2]), s[1]))


def features(text: str, span: Span) -> list[float]:
    """Format of the span and what stands around it; the check digit is not among them."""
    a, b, kind = span
    own = text[a:b]
    digits = _digits(own)
    groups = re.findall(r"[0-9]+", own)
    before, after = text[a - 1 : a], text[b : b + 1]
    words = text[max(0, a - 40) : a].lower()
    plain = re.sub(r"\x20?[\[(]dot[\])]\x20?", ".", re.sub(r"\x20?(@|[\[(]at[\])])\x20?", "@", own))
    _, _, domain = plain.partition("@")
    return [
        float(KINDS.index(kind)), len(own), len(digits), sum(c.isalpha() for c in own), len(groups),
        max((len(g) for g in groups), default=0), min((len(g) for g in groups), default=0),
        own.count("."), own.count("-"), own.count(" "), own.count("(") + own.count(")"), own.count("@"),
        float(own[:1] == "+"), domain.count("."), len(domain.rpartition(".")[2]),
        len(set(digits)), float(before.isalnum()), float(after.isalnum()), float(before in ("\"", "'", "=", "/", "#")),
        float(after in ("\"", "'", "/")), float(any(h in words for h in HINTS[kind])),
        max((int(g) for g in groups if len(g) <= 3), default=999) if kind == "ip" else 0.0,
        float(len(MASKS.findall(own))), float(own.count("[") + own.count("(at)") + own.count("(dot)")), float(own.count(".") >= 1 and len(groups) == 4 and all(len(g) <= 3 for g in groups)),
        float(domain.rpartition(".")[2].isalpha()), len(groups[0]) if groups else 0, len(groups[-1]) if groups else 0,
        float(MARK.search(text, max(0, a - 2), a) is not None), float(MARK.search(text, b, b + 2) is not None),
    ]


def damaged(own: str, kind: str, choice: int) -> str:
    """A strict find as people also write it."""
    if kind == "email":
        name, _, domain = own.partition("@")
        return (f"{name} @ {domain}", f"{name} [at] {domain}", f"{name}(at){domain}", f"{name} [at] {domain.replace('.', ' [dot] ')}")[choice % 4]
    if kind == "ip":
        return own.replace(".", ("[.]", " . ", ". ", "[.]")[choice % 4])
    if kind == "card":
        digits = _digits(own)
        fours = [digits[i : i + 4] for i in range(0, len(digits), 4)]
        hidden = [fours[0], *["*X"[choice // 4 % 2] * 4 for _ in fours[1:-1]], fours[-1]]
        return ("", " ", "-", " ")[choice % 4].join(hidden)
    groups = re.findall(r"[0-9]+", own)
    short = groups[1:] if len(groups) > 2 else groups
    return (own[1:], "-".join(short), ".".join(short), f"({short[0]}) " + " ".join(short[1:]))[choice % 4]


def lookalike(choice: int) -> str:
    """A number that is no personal data: time stamp, book number, order number, date, version, amount, tag."""
    n = choice * 2654435761 % 10**12
    year, month, day = 1990 + n % 40, 1 + n // 40 % 12, 1 + n // 480 % 28
    clock = f"{n // 7 % 24:02d}{n // 11 % 60:02d}{n // 13 % 60:02d}"
    return (
        f"{year}{month:02d}{day:02d}{clock}", f"978{n % 10**10:010d}", f"978-{n % 10}-{n % 10**4:04d}-{n // 17 % 10**4:04d}-{n // 3 % 10}", f"{n % 10**10:010d}", f"{n % 10**8:08d}",
        f"{year}-{month:02d}-{day:02d}", f"{day}.{month}.{year}", f"{n % 30}.{n // 3 % 30}.{n // 7 % 300}", f"{n % 10**7 / 100:.2f}", f"{n % 10**16:016d}", f"{year}-{month:02d}-{day:02d} {clock[:2]}", f"@tag{n % 99}",
    )[choice % 12]


@dataclass(frozen=True)
class Detector:
    """Trees and a threshold per kind; ``find`` joins strict finds and selected proposals."""

    model: Boosted
    thresholds: dict[str, float]

    def find(self, text: str) -> list[tuple[Span, bool]]:
        """Spans in order, and whether each is a strict find."""
        strict = strict_spans(text)
        known = set(strict)
        taken = bytearray(len(text))
        for a, b, _ in strict:
            taken[a:b] = b"\1" * (b - a)
        loose = [s for s in proposals(text) if s not in known and taken.find(1, s[0], s[1]) < 0]
        added: list[Span] = []
        if loose:
            score = self.model.probability(np.array([features(text, s) for s in loose]))
            for _, _, s in sorted((-round(float(p), 2), s[0] - s[1], s) for p, s in zip(score, loose) if p >= self.thresholds[s[2]]):
                a, b, _ = s
                if taken.find(1, a, b) < 0:  # the likeliest first, the longer of equal ones; a span over a taken one adds nothing
                    taken[a:b] = b"\1" * (b - a)
                    added.append(s)
        return sorted([(s, True) for s in strict] + [(s, False) for s in added], key=lambda f: (f[0][0], KINDS.index(f[0][2])))

    def spans(self, text: str) -> list[Span]:
        return [s for s, _ in self.find(text)]


def _hash(text: str) -> int:
    return zlib.crc32(text.encode())


def _placed(text: str, a: int, b: int, put: str, kind: str | None) -> Iterator[tuple[list[float], int]]:
    """Proposals over ``put`` where a strict find stood: positive if they are just that span and kind, else negative."""
    before = text[max(0, a - 60) : a]
    here = before + put + text[b : b + 30]
    start, end = len(before), len(before) + len(put)
    strict = strict_spans(here)
    for s in proposals(here):
        if s[0] < end and start < s[1] and not any(x < s[1] and s[0] < y for x, y, _ in strict):
            yield features(here, s), int(s == (start, end, kind))


def _examples(text: str) -> Iterator[tuple[list[float], int]]:
    strict = strict_spans(text)
    known = set(strict)
    for a, b, kind in sorted(strict, key=lambda s: _hash(f"{s[0]} {text[s[0] : s[1]]}"))[:TRAIN_FINDS]:
        choice = _hash(f"{a} {text[a:b]}")
        yield from _placed(text, a, b, damaged(text[a:b], kind, choice), kind)
        for i in range(3):
            yield from _placed(text, a, b, lookalike(choice + i), None)
    others = [s for s in proposals(text) if s not in known and not any(a < s[1] and s[0] < b for a, b, _ in strict)]
    for s in sorted(others, key=lambda s: _hash(f"{s[0]} {text[s[0] : s[1]]}"))[:TRAIN_PROPOSALS]:
        yield features(text, s), 0


def train(df: DataFrame, id_column: str = "doc_id", text_column: str = "text", documents: int = TRAIN_DOCUMENTS, precision: float = PRECISION) -> Detector:
    """Trees from the proposals of at most ``documents`` documents of up to ``TRAIN_BYTES`` bytes, picked by a hash.

    Proposals of every fifth of them only calibrate the thresholds. Without strict finds nothing is ever added. The driver gets
    ``documents`` times some 30 to 40 rows of 120 bytes at most, one value per batch.
    """
    some = bounded_sample(pick(df, doc_id=id_column, text=text_column), documents, 11)
    some = some.where((F.octet_length("text") <= TRAIN_BYTES) & F.col("text").rlike(r"[0-9@\[(]")).select("text", F.xxhash64("text").alias("_order"))

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(n % 5 == 0, x, y) for n, t in zip(batch.column("_order").to_pylist(), batch.column("text").to_pylist()) for x, y in _examples(t)]
            if rows:
                # Fixed-width rows of a batch in one value: held, label, features.
                table = np.array([[r[0], r[2], *r[1]] for r in rows], np.float32)
                yield pa.RecordBatch.from_arrays([pa.array([table.shape[1]], pa.int32()), pa.array([table.tobytes()], pa.binary())], names=["width", "rows"])

    told = some.mapInArrow(extract, "width int, rows binary").toArrow()
    if not told.num_rows:
        return Detector(boost(np.zeros((0, 1)), np.zeros(0)), dict.fromkeys(KINDS, 2.0))
    table = np.concatenate([np.frombuffer(r.as_buffer(), np.float32) for r in told.column("rows")]).reshape(-1, told.column("width")[0].as_py())
    held, y, x = table[:, 0] > 0, table[:, 1].astype(float), table[:, 2:]
    order = np.lexsort((*x.T, y))
    x, y, held = x[order], y[order], held[order]
    model = boost(x[~held], y[~held])
    if not model.trees:
        return Detector(model, dict.fromkeys(KINDS, 2.0))
    thresholds = {}
    for i, kind in enumerate(KINDS):
        own = held & (x[:, 0] == i)
        found = calibrated_threshold(model.probability(x[own]), y[own], precision)
        thresholds[kind] = max(found, 0.5)
    return Detector(model, thresholds)


def _marked(texts: pa.Array) -> np.ndarray:
    """Texts that can hold any span at all."""
    data, offsets = text_bytes(texts)
    return group_sums(MARKED[data], offsets) > 0


SPAN_TYPE = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("strict", pa.bool_())]))


def find_personal_data(df: DataFrame, id_column: str = "doc_id", text_column: str = "text", detector: Detector | None = None) -> DataFrame:
    """One row per input row: doc_id and spans (kind, start, end in code points with the end exclusive, strict).

    Null and empty texts have no spans; null ids and repeated rows keep their own rows; an empty table gives an empty result;
    other columns are ignored. Texts are read whole.
    """
    detector = detector or train(df, id_column, text_column)
    source = pick(df, doc_id=id_column, text=text_column)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches, "text"):
            texts = piece.column("text")
            marked = _marked(texts)
            out = []
            for i in range(len(piece)):
                spans = detector.find(texts[i].as_py()) if marked[i] else []
                out.append([{"kind": k, "start": a, "end": b, "strict": strict} for (a, b, k), strict in spans])
            yield pa.RecordBatch.from_arrays([piece.column("doc_id"), pa.array(out, SPAN_TYPE)], names=["doc_id", "spans"])

    id_type = dict(source.dtypes)["doc_id"]
    return source.mapInArrow(scan, f"doc_id {id_type}, spans array<struct<kind:string,start:bigint,`end`:bigint,strict:boolean>>")


def redacted(text: str, spans: list[Span]) -> str:
    """The text with each span, or run of overlapping spans, replaced by the kind of the first."""
    out, done = [], 0
    for a, b, kind in spans:
        if a < done:
            done = max(done, b)
            continue
        out += [text[done:a], f"[{kind.upper()}]"]
        done = b
    return "".join([*out, text[done:]])


def redact(df: DataFrame, id_column: str = "doc_id", text_column: str = "text", detector: Detector | None = None) -> DataFrame:
    """All rows and columns of ``df``, personal data in the text replaced by placeholders; null stays null."""
    detector = detector or train(df, id_column, text_column)

    def rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches, text_column):
            texts = piece.column(text_column)
            marked = _marked(texts)
            kept = texts.to_pylist()
            new = pa.array([redacted(t, detector.spans(t)) if m else t for t, m in zip(kept, marked)], texts.type)
            place = piece.schema.get_field_index(text_column)
            yield pa.RecordBatch.from_arrays([*piece.columns[:place], new, *piece.columns[place + 1 :]], names=piece.schema.names)

    return df.mapInArrow(rewrite, df.schema)
