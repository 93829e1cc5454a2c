"""PII: base patterns, and a semi-Markov conditional random field that scores whole candidate spans.

The base patterns (email, ip, card, phone) are matched over the whole text and always reported. The random field reads
the zones of a text that hold digits or @ signs: a zone is cut into tokens, every segment of up to MAX_TOKENS tokens is a
candidate for every type, and features of the whole segment (check digit, octets, separators, length, what stands beside
it) score it. Dynamic programming over segment ends chooses boundaries and types of all entities of a zone jointly;
entities are bounded by MAX_TOKENS, so it is linear in the zone. Spans that it finds and that touch no base span are
added.

Weights are fitted by stochastic gradient steps on the conditional likelihood (a forward and a backward pass over the
same segments), on the zones of a bounded sample of texts. The base spans in them are labels, and so are forms that the
patterns can't match: each such zone is learned from once more with its spans rewritten (`@` set apart or spelled out,
dots set apart, other separators, no plus sign), so that the field finds what the patterns miss.

Defined results: a null text counts as empty and has no spans; offsets are code points, ends exclusive; repeated rows and
null ids are kept; base spans of different kinds may overlap; an empty table gives an empty result; columns besides
doc_id and text are ignored.
"""

from __future__ import annotations

import hashlib
import re
from array import array
from bisect import bisect_left
from collections import deque
from dataclasses import dataclass, field
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fit_sample, hashed_sample

KINDS = ("email", "ip", "card", "phone")
#: Bounds: texts whose zones are learned from, zones learned from (the first in the order of a hash) and their longest, tokens
#: of an entity.
TRAIN_ROWS, TRAIN_ZONES, TRAIN_ZONE, MAX_TOKENS = 4_000, 1_500, 2_000, 12
EPOCHS, STEP, L2 = 4, 0.3, 1e-4

# fixed values: the contract's base patterns
EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
TRIGGER = re.compile(r"[0-9@]|\((?:at|AT)\)|\[(?:at|AT)\]")
# the same matches of e-mail and ip in linear time: what follows each @, and a run of digits from its start without going back
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
IP_RUN = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
BLANK = re.compile(r"\s")
AT = re.compile(r"@|\((?:at|AT)\)|\[(?:at|AT)\]")
TOKEN = re.compile(r"[A-Za-z0-9]+|\s|[^\sA-Za-z0-9]")


def luhn(digits: str) -> bool:
    d = np.frombuffer(digits.encode(), np.uint8).astype(np.int64)[::-1] - 48
    d[1::2] *= 2
    return int(np.where(d > 9, d - 9, d).sum()) % 10 == 0


def octet(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) <= 3 and int(part or "0") <= 255


def digits_of(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def emails(text: str) -> list[tuple[int, int]]:
    """The matches of EMAIL: from each @ back over what may stand before it, no further than the match before."""
    out, last, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > last and text[start - 1] in LOCAL:
            start -= 1
        m = DOMAIN.match(text, at) if start < at else None
        if m:
            last = m.end()
            out.append((start, last))
        at = text.find("@", at + 1)
    return out


def base_spans(text: str) -> list[list[tuple[int, int]]]:
    """Spans of each kind, in the order of KINDS."""
    out: list[list[tuple[int, int]]] = [[], [], [], []]
    if "@" in text:
        out[0] = emails(text)
    out[1] = [m.span() for m in IP_RUN.finditer(text) if all(map(octet, m[0].split(".")))]
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 16:
            d = digits_of(m[0])
            if 16 <= len(d) <= 19 and luhn(d):
                out[2].append(m.span())
    if "+" in text:
        out[3] = [m.span() for m in PHONE.finditer(text) if 8 <= len(digits_of(m[0])) <= 15]
    return out


def zones(text: str):
    """(start, end) of the stretches around digits and @ signs, spelled out or not: whole words, and the next ones while
    they have any; a word before or behind a sign that stands alone belongs to it."""
    at, n = 0, len(text)
    while m := TRIGGER.search(text, at):
        start = m.start()
        while start > at and not text[start - 1].isspace():
            start -= 1
        if start - 3 >= at and text[start - 1] == " " and text[start - 2] not in " \n" and text[start - 3] == " ":
            start -= 2  # a lone sign before the first word
        b = BLANK.search(text, m.start())
        end = b.start() if b else n
        if AT.fullmatch(text, start, end) and start - 1 > at and text[start - 1] == " ":
            start -= 1
            while start > at and not text[start - 1].isspace():
                start -= 1
        alone = bool(AT.fullmatch(text, m.start(), end))
        while end < n and text[end] == " ":
            b = BLANK.search(text, end + 1)
            stop = b.start() if b else n
            if not alone and not TRIGGER.search(text, end + 1, stop):
                break
            alone = bool(AT.fullmatch(text, end + 1, stop))
            end = stop
        yield start, end
        at = end


def _bucket(n: int, edges=(0, 3, 6, 7, 8, 10, 12, 15, 16, 19)) -> int:
    return sum(n > e for e in edges)


def features(zone: str, start: int, end: int) -> tuple[str, ...]:
    """Names of a segment's features: all of them look at the whole span or at its two sides."""
    s = zone[start:end]
    d = digits_of(s)
    kinds = "".join(sorted({"9" if c.isdigit() else "a" if c.isalnum() else c for c in s}))
    sides = "".join("^" if not c else "_" if c.isspace() else "9" if c.isdigit() else "a" if c.isalnum() else c for c in (zone[start - 1 : start], zone[end : end + 1]))
    parts = [p.strip() for p in s.split(".")]
    checks = (
        f"{'l' if 16 <= len(d) <= 19 and luhn(d) else ''}{'o' if len(parts) == 4 and all(p.isdigit() and octet(p) for p in parts) else ''}"
        f"{'+' if s[0] == '+' else ''}{'@' if len(AT.findall(s)) == 1 else ''}"
    )
    tail = s.rpartition(".")[2]
    return (
        "bias", f"n{_bucket(len(d))}", f"k{kinds}", f"s{sides}", f"c{checks}", f"c{checks}n{_bucket(len(d))}", f"c{checks}k{kinds}", f"c{checks}s{sides}",
        f"len{_bucket(len(s), (1, 4, 8, 12, 16, 20, 30))}", f"tld{bool(AT.search(s)) and tail.isalpha() and 2 <= len(tail) <= 6}{'.' in s}", f"first{'9' if s[0].isdigit() else s[0] if not s[0].isalnum() else 'a'}",
    )


def segments(zone: str) -> tuple[int, list[tuple[int, int, int, int, tuple[str, ...]]]]:
    """Number of tokens and the candidates (first token, end token, start, end, features)."""
    tokens = [m.span() for m in TOKEN.finditer(zone)]
    out = []
    for i, (start, stop) in enumerate(tokens):
        first = zone[start]
        if not (first.isalnum() or first in "+("):
            continue
        for j in range(i, min(len(tokens), i + MAX_TOKENS)):
            a, end = tokens[j]
            last = zone[a]
            if last.isspace() and last != " ":
                break
            if not (last.isalnum() or last == ")"):
                continue
            if end - start > 4 and TRIGGER.search(zone, start, end):
                out.append((i, j + 1, start, end, features(zone, start, end)))
    return len(tokens), out


@dataclass
class Field:
    """weights[kind][feature]; a token outside all entities scores 0."""

    weights: list[dict[str, float]] = field(default_factory=lambda: [{} for _ in KINDS])

    def scores(self, feats: tuple[str, ...]) -> list[float]:
        return [sum(w.get(f, 0.0) for f in feats) for w in self.weights]

    def decode(self, zone: str) -> list[tuple[int, int, int]]:
        """(kind, start, end) of the best segmentation; a tie goes to fewer entities, then the first kind."""
        # candidates come by their end and only the last MAX_TOKENS tokens are held, so that a long zone costs a few numbers a token
        best, back = array("d", [0.0]), [array("i") for _ in range(4)]
        recent: deque = deque(maxlen=MAX_TOKENS)
        for j, m in enumerate(TOKEN.finditer(zone), 1):
            (a, end), top, how = m.span(), best[-1], (-1, 0, 0, 0)
            last = zone[a]
            if last.isspace() and last != " ":
                recent.clear()
            else:
                recent.append((j - 1, a))
                if last.isalnum() or last == ")":
                    for i, start in recent:
                        if end - start > 4 and (zone[start].isalnum() or zone[start] in "+(") and TRIGGER.search(zone, start, end):
                            sc = self.scores(features(zone, start, end))
                            k = max(range(len(KINDS)), key=lambda y: (sc[y], -y))
                            if best[i] + sc[k] > top:
                                top, how = best[i] + sc[k], (i, k, start, end)
            best.append(top)
            for column, x in zip(back, how):
                column.append(x)
        out, j = [], len(best) - 1
        while j > 0:
            i, k, start, end = (column[j - 1] for column in back)
            if i >= 0:
                out.append((k, start, end))
                j = i
            else:
                j -= 1
        return out[::-1]

    def log_z(self, zone: str):
        """log of the partition function and, for each candidate, the probability of each kind."""
        n, segs = segments(zone)
        sc = [self.scores(s[4]) for s in segs]
        fwd, bwd = [-np.inf] * (n + 1), [-np.inf] * (n + 1)
        fwd[0] = bwd[n] = 0.0
        ends, starts = {}, {}
        for s, v in zip(segs, sc):
            total = float(np.logaddexp.reduce(v))
            ends.setdefault(s[1], []).append((s[0], total))
            starts.setdefault(s[0], []).append((s[1], total))
        for j in range(1, n + 1):
            fwd[j] = float(np.logaddexp.reduce([fwd[j - 1], *(fwd[i] + v for i, v in ends.get(j, ()))]))
        for i in range(n - 1, -1, -1):
            bwd[i] = float(np.logaddexp.reduce([bwd[i + 1], *(bwd[j] + v for j, v in starts.get(i, ()))]))
        return fwd[n], [(s, [float(np.exp(min(0.0, fwd[s[0]] + x + bwd[s[1]] - fwd[n]))) for x in v]) for s, v in zip(segs, sc)]


def rewritten(kind: int, span: str, way: int) -> str:
    """The same entity in a form that its base pattern doesn't match."""
    if kind == 0:
        return span.replace("@", (" @ ", "(at)", " [at] ", "[AT]")[way % 4])
    if kind == 1:
        return span.replace(".", (" . ", ". ")[way % 2]) if len(span) < 12 else span.replace(".", ". ")
    if kind == 2:
        digits = digits_of(span)
        return (".", "/")[way % 2].join(digits[i : i + 4] for i in range(0, len(digits), 4))
    return ("00", "", "(0)")[way % 3] + span[1:]


def zone_labels(text: str) -> list[tuple[str, list[tuple[int, int, int]]]]:
    """(zone, [(kind, start, end)]) of the zones of a text, labelled by the base spans in them, overlapping ones by the first."""
    gold = sorted((a, b, k) for k, spans in enumerate(base_spans(text)) for a, b in spans)
    out, i = [], 0
    for start, end in zones(text):
        while i < len(gold) and gold[i][0] < start:
            i += 1
        own, j, last = [], i, start
        while j < len(gold) and gold[j][0] < end:
            a, b, k = gold[j]
            if a >= last and b <= end:
                own.append((k, a - start, b - start))
                last = b
            j += 1
        out.append((text[start:end], own))
    return out


def variant(zone: str, gold: list[tuple[int, int, int]], way: int) -> tuple[str, list[tuple[int, int, int]]]:
    """The zone with its spans rewritten, and where they are then."""
    out, labels, at = "", [], 0
    for k, a, b in gold:
        out += zone[at:a]
        new = rewritten(k, zone[a:b], way)
        labels.append((k, len(out), len(out) + len(new)))
        out, at = out + new, b
    return out + zone[at:], labels


def fit(data: list[tuple[str, list[tuple[int, int, int]]]]) -> Field:
    """The field of labelled zones, and of the rewritten forms of those that have an entity."""
    data = data + [variant(z, g, i + j) for i, (z, g) in enumerate(data) if g for j in range(2)]
    model = Field()
    order = np.random.default_rng(17)
    for epoch in range(EPOCHS):
        step = STEP / (1 + epoch)
        for x in order.permutation(len(data)):
            zone, labels = data[x]
            gold = {(a, b): k for k, a, b in labels}
            for (_, _, start, end, feats), p in model.log_z(zone)[1]:
                right = gold.get((start, end))
                for k in range(len(KINDS)):
                    g = (right == k) - p[k]
                    if abs(g) > 1e-3:
                        w = model.weights[k]
                        for f in feats:
                            w[f] = w.get(f, 0.0) * (1 - step * L2) + step * g
    return model


def train(docs: DataFrame, rows: int = TRAIN_ROWS) -> Field:
    """The field of a bounded sample: tasks cut the zones and label them; the driver gets TRAIN_ZONES of them."""
    picked = hashed_sample(docs.select("doc_id").where("doc_id is not null").distinct(), "doc_id", rows, 29)
    sample = fit_sample(docs.where(F.col("text").rlike(TRIGGER.pattern)), picked, [], 29)

    def run(batches):
        for b in batches:
            every = [x for t in b.column(0).to_pylist() for x in zone_labels(t) if len(x[0]) <= TRAIN_ZONE]
            flat = [[v for span in g for v in span] for _, g in every]
            order = [hashlib.md5(z.encode("utf-8", "replace")).hexdigest() for z, _ in every]
            yield pa.record_batch([pa.array(order, pa.string()), pa.array([z for z, _ in every], pa.string()), pa.array(flat, pa.list_(pa.int32()))], names=["h", "zone", "gold"])

    zoned = sample.select("text").mapInArrow(run, "h string, zone string, gold array<int>").dropDuplicates(["h"])
    got = zoned.orderBy("h").limit(TRAIN_ZONES).collect()
    return fit([(r["zone"], [tuple(r["gold"][i : i + 3]) for i in range(0, len(r["gold"]), 3)]) for r in got])


def spans_of(text: str, model: Field) -> tuple[list[list[tuple[int, int]]], list[tuple[int, int, int]]]:
    """Base spans by kind, and the added (kind, start, end)."""
    base = base_spans(text)
    taken, added = sorted(s for spans in base for s in spans), []
    starts, ends = [a for a, _ in taken], list(accumulate((b for _, b in taken), max))  # the furthest end so far
    for start, end in zones(text):
        for k, a, b in model.decode(text[start:end]):
            a, b = a + start, b + start
            before = bisect_left(starts, b)  # base spans that start before b
            if not before or ends[before - 1] <= a:
                added.append((k, a, b))
    return base, added


def join_spans(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in sorted(spans))


def find(docs: DataFrame, rows: int = TRAIN_ROWS) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans for every row of docs."""
    model = docs.sparkSession.sparkContext.broadcast(train(docs, rows))
    names = ["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans"]

    def run(batches):
        for b in batches:
            counts, digests, joined = [], [], []
            for t in b.column(1).to_pylist():
                base, added = spans_of(t or "", model.value)
                flat = [(k, *s) for k, spans in enumerate(base) for s in spans]
                counts.append([len(s) for s in base])
                digests.append(hashlib.sha256(join_spans(flat).encode()).hexdigest())
                joined.append(join_spans(flat + added))
            c = np.array(counts, np.int64).reshape(-1, len(KINDS))
            yield pa.record_batch([b.column(0), *(pa.array(c[:, i]) for i in range(len(KINDS))), pa.array(digests, pa.string()), pa.array(joined, pa.string())], names=names)

    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, " + ", ".join(f"n_{k} long" for k in KINDS) + ", base_sha256 string, spans string"
    return docs.select("doc_id", "text").mapInArrow(run, schema)
