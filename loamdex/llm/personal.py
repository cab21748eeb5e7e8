"""Personal data: patterns that always count, and a semi-Markov conditional random field that adds what they miss.

Around places that may hold personal data a text is cut into tokens. Every run of up to ``LONGEST`` tokens may be a
segment of one kind, and is scored as a whole: its digits' checksum and grouping, its marks (also spelled ones), what
surrounds it. Dynamic programming over segments of bounded length chooses boundaries and kinds together; tokens of no
segment score nothing. The field is trained on windows in which the patterns matched, on copies of them in which what
matched is written in other ways, and on copies in which it is spoilt.
"""

from __future__ import annotations

import math
import random
import re
from collections import defaultdict
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loamdex.llm import text as T

KINDS = ("email", "ip", "card", "phone")
Span = tuple[str, int, int]

_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_CHAIN = re.compile(r"[0-9]++(?:\.[0-9]++)*+")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile("[0-9]")


def luhn(digits: str) -> bool:
    """Whether the digits' checksum is right."""
    total = sum(map(int, digits[-1::-2])) + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])
    return total % 10 == 0


def _digits(s: str) -> str:
    return "".join(_DIGIT.findall(s))


def _byte(part: str) -> bool:
    return len(part.lstrip("0")) <= 3 and int(part.lstrip("0") or "0") <= 255


def base(text: str) -> list[Span]:
    """(kind, start, end) of all that the patterns match, by kind, then start; time grows with the text's length alone."""
    out: list[Span] = []
    done = at = 0
    while (at := text.find("@", at)) >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        found = _DOMAIN.match(text, at + 1) if start < at else None
        if found:
            out.append(("email", start, found.end()))
        done = at = found.end() if found else at + 1
    if _DIGIT.search(text) is None:
        return out
    for m in _CHAIN.finditer(text):
        parts, start = m.group().split("."), m.start()
        for four in (parts[i : i + 4] for i in range(0, len(parts) - 3, 4)):
            end = start + len(".".join(four))
            if all(map(_byte, four)):
                out.append(("ip", start, end))
            start = end + 1
    for m in _CARD.finditer(text):
        digits = _digits(m.group())
        if 13 <= len(digits) <= 19 and luhn(digits):
            out.append(("card", m.start(), m.end()))
    for m in _PHONE.finditer(text):
        if 9 <= len(_digits(m.group())) <= 15:
            out.append(("phone", m.start(), m.end()))
    return out


#: Tokens of a segment at most, and characters around an anchor that a window takes in.
LONGEST, AROUND = 28, 64
_TOKEN = re.compile(r"[^\W\d_]+|[0-9]+|\s+|[\s\S]")
#: Digits, a few of them apart, or a mark of an address, also in words.
_ANCHOR = re.compile(r"[0-9](?:[^\w\n]{0,3}[0-9]){3,}+|@|[\[(]\s?(?:at|dot|\.)\s?[\])]|\sdot\s", re.I)
_AT = re.compile(r"\s*[\[(]\s?(?:at|@)\s?[\])]\s*|\s+at\s+|\s*@\s*", re.I)
_DOT = re.compile(r"\s*[\[(]\s?(?:dot|\.)\s?[\])]\s*|\s+dot\s+", re.I)
#: Marks right before and right after a segment, which then is but a part of something.
_GOES_ON_LEFT = re.compile(r"(?:\bdot\s+|[\[(]\s?(?:dot|at|@|\.)\s?[\])]\s*|[.@])$", re.I)
_GOES_ON_RIGHT = re.compile(r"(?:\s+dot\b|\s*[\[(]\s?(?:dot|at|@|\.)\s?[\])]|[.@]\w)", re.I)
#: Endings of addresses that are told from other words.
ENDINGS = frozenset("com org net edu gov info io eu uk de fr es it nl".split())
_ADDRESS = re.compile(r"[A-Za-z0-9._%+-]+@([A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+)")


def windows(text: str) -> Iterator[tuple[int, int]]:
    """(start, end) of stretches around anchors; those that meet are one."""
    held: tuple[int, int] | None = None
    for m in _ANCHOR.finditer(text):
        start, end = max(0, m.start() - AROUND), min(len(text), m.end() + AROUND)
        if held and start <= held[1]:
            held = held[0], end
            continue
        if held:
            yield held
        held = start, end
    if held:
        yield held


def _side(char: str) -> str:
    return "none" if not char else "space" if char.isspace() else "word" if char.isalnum() else "point" if char in ".,;:!?" else "mark"


def features(piece: str, before: str, after: str) -> list[str] | None:
    """What holds of a whole segment between what stands before and after it; None if nothing of it could be personal data."""
    digits = _digits(piece)
    spelled = _DOT.sub(".", piece)
    plain = _AT.sub("@", spelled)
    marks = plain.count("@")
    if marks != 1 and not (marks == 0 and 4 <= len(digits) <= 19):
        return None
    out = ["any", f"left {_side(before[-1:])}", f"right {_side(after[:1])}", "spelled" if plain != piece else "as it is"]
    out += [name for name, mark in (("goes on left", _GOES_ON_LEFT.search(before)), ("goes on right", _GOES_ON_RIGHT.match(after))) if mark]
    if marks:
        match = _ADDRESS.fullmatch(plain)
        if match is None:
            return None
        last = match[1].rsplit(".", 1)[1].lower()
        out += ["address", f"parts {min(match[1].count('.'), 3)}", "ending" if last in ENDINGS else "other ending" if last.isalpha() else "odd ending"]
        bare = re.search(r"\sat\s", piece, re.I) is not None
        return [*out, f"gaps {min(sum(c.isspace() for c in piece), 3)}", "at" if bare else "mark", "dots" if _DOT.search(piece) else "points"]
    letters = any(c.isalpha() for c in spelled)
    if letters:
        return None
    groups = re.findall("[0-9]+", piece)
    four = re.fullmatch(r"[0-9]+(?:\.[0-9]+){3}", spelled.replace(" ", "")) if spelled.count(".") == 3 else None
    if four:
        out.append("four bytes" if all(map(_byte, groups)) and len(groups) == 4 else "four numbers")
    n = len(digits)
    out += [f"digits {n}", "groups " + ("-".join(str(len(g)) for g in groups) if len(groups) <= 6 else "many")]
    if n >= 12:
        out.append("checksum" if luhn(digits) else "no checksum")
    out += [name for name, there in (("plus", piece[0] == "+"), ("zeros", piece.startswith("00")), ("bracket", "(" in piece), ("open bracket", piece.count("(") != piece.count(")")), ("dash", "-" in piece), ("space", " " in piece), ("dot", "." in piece), ("slash", "/" in piece), ("other", bool(re.search(r"[^0-9\s()+./\[\]-]", piece)))) if there]
    return out


def candidates(text: str, start: int, end: int) -> tuple[list[int], list[tuple[int, int, list[str]]]]:
    """(ends of tokens, segments (from token, to token, features)) of a window; segments begin and end with a word, a number, a plus or a bracket."""
    tokens = [(m.start(), m.end()) for m in _TOKEN.finditer(text, start, end)]
    opens = [text[a] in "+(" or text[a].isalnum() for a, _ in tokens]
    closes = [text[b - 1].isalnum() for _, b in tokens]
    tells = [text[a].isdigit() or text[a : a + 1] in "@[(" or text[a:b].lower() in ("at", "dot") for a, b in tokens]
    out = []
    for i, (a, _) in enumerate(tokens):
        glued = a > 0 and text[a].isalnum() and text[a - 1].isalnum()
        if not opens[i] or glued:
            continue
        telling = False
        for j in range(i, min(len(tokens), i + LONGEST)):
            telling = telling or tells[j]
            b = tokens[j][1]
            if telling and closes[j] and not (b < len(text) and text[b].isalnum()):
                found = features(text[a:b], text[max(0, a - 8) : a], text[b : b + 8])
                if found is not None:
                    out.append((i, j + 1, found))
    return [start, *(b for _, b in tokens)], out


@dataclass
class Field:
    """Weights of (kind, feature), and of one kind right after another."""

    weights: dict[tuple[str, str], float] = field(default_factory=dict)
    after: dict[tuple[str, str], float] = field(default_factory=dict)

    def scores(self, segments: list[tuple[int, int, list[str]]]) -> list[list[float]]:
        return [[sum(self.weights.get((k, f), 0.0) for f in found) for k in KINDS] for _, _, found in segments]

    def sums(self, n: int, segments: list[tuple[int, int, list[str]]], scores: list[list[float]]) -> tuple[list[list[float]], list[list[float]], float]:
        """(ways that lead to each token's beginning by kind of the last segment, ways on from there, all ways); index 0 is no segment."""
        hold = [[math.exp(min(s, 30.0)) for s in row] for row in scores]
        turn = [[1.0] * 5, *([1.0, *(math.exp(self.after.get((a, b), 0.0)) for b in KINDS)] for a in KINDS)]
        begins, ends = defaultdict(list), defaultdict(list)
        for s, (i, j, _) in enumerate(segments):
            begins[i].append(s)
            ends[j].append(s)
        ahead = [[0.0] * 5 for _ in range(n + 1)]
        ahead[0][0] = 1.0
        entering = [[0.0] * 5 for _ in range(n + 1)]
        for t in range(n + 1):
            for s in ends[t]:
                for k in range(4):
                    ahead[t][k + 1] += entering[segments[s][0]][k + 1] * hold[s][k]
            entering[t] = [sum(ahead[t][a] * turn[a][b] for a in range(5)) for b in range(5)]
            if t < n:
                ahead[t + 1][0] += entering[t][0]
        on = [[1.0] * 5 if t == n else [0.0] * 5 for t in range(n + 1)]
        for t in range(n - 1, -1, -1):
            ways = [on[t + 1][0], 0.0, 0.0, 0.0, 0.0]
            for s in begins[t]:
                for k in range(4):
                    ways[k + 1] += hold[s][k] * on[segments[s][1]][k + 1]
            on[t] = [sum(turn[a][b] * ways[b] for b in range(5)) for a in range(5)]
        return entering, on, sum(ahead[n])

    def best(self, n: int, segments: list[tuple[int, int, list[str]]], sure: float) -> list[tuple[int, int, str]]:
        """The segments of the best segmentation that are ``sure`` by their share of all ways."""
        scores = self.scores(segments)
        if not any(s > 0 for row in scores for s in row):
            return []
        ends = defaultdict(list)
        for s, (_, j, _) in enumerate(segments):
            ends[j].append(s)
        names = ("", *KINDS)
        top = [[-math.inf] * 5 for _ in range(n + 1)]
        back: list[list[tuple[int, int, int] | None]] = [[None] * 5 for _ in range(n + 1)]
        top[0][0] = 0.0
        for t in range(1, n + 1):
            top[t][0], a = max((top[t - 1][a], -a) for a in range(5))
            back[t][0] = (t - 1, -a, -1)
            for s in ends[t]:
                i = segments[s][0]
                for k in range(4):
                    value, a = max((top[i][a] + (self.after.get((names[a], KINDS[k]), 0.0) if a else 0.0), -a) for a in range(5))
                    if value + scores[s][k] > top[t][k + 1]:
                        top[t][k + 1], back[t][k + 1] = value + scores[s][k], (i, -a, s)
        t, a = n, max(range(5), key=lambda a: (top[n][a], -a))
        path = []
        while t:
            i, before, s = back[t][a]
            if s >= 0:
                path.append((s, a - 1))
            t, a = i, before
        if not path:
            return []
        entering, on, total = self.sums(n, segments, scores)
        share = lambda s, k: entering[segments[s][0]][k + 1] * math.exp(min(scores[s][k], 30.0)) * on[segments[s][1]][k + 1] / total
        return [(segments[s][0], segments[s][1], KINDS[k]) for s, k in reversed(path) if share(s, k) >= sure]

    def train(self, examples: list[tuple[str, list[Span]]], epochs: int = 6, rate: float = 0.5, l2: float = 1e-3) -> None:
        """Ascend the examples' likelihood, given (text, spans that are personal data), one after another in a fixed shuffled order."""
        made = []
        for text, spans in examples:
            ends, segments = candidates(text, 0, len(text))
            place = {e: t for t, e in enumerate(ends)}
            gold = {(place.get(a), place.get(b)): kind for kind, a, b in spans}
            marked = [(s, KINDS.index(gold[seg[:2]])) for s, seg in enumerate(segments) if seg[:2] in gold]
            if segments and len(marked) == len(gold):  # else a span that no segment can be
                made.append((len(ends) - 1, segments, marked))
        squares: dict = defaultdict(float)
        order = random.Random(13)

        def step(table: dict, key: tuple[str, str], g: float) -> None:
            g -= l2 * table.get(key, 0.0)
            squares[key] += g * g
            table[key] = table.get(key, 0.0) + rate * g / math.sqrt(squares[key] + 1e-8)

        for _ in range(epochs):
            order.shuffle(made)
            for n, segments, marked in made:
                scores = self.scores(segments)
                entering, on, total = self.sums(n, segments, scores)
                slope: dict = defaultdict(float)
                for s, k in marked:
                    for f in segments[s][2]:
                        slope[KINDS[k], f] += 1.0
                for s, (i, j, found) in enumerate(segments):
                    for k in range(4):
                        share = entering[i][k + 1] * math.exp(min(scores[s][k], 30.0)) * on[j][k + 1] / total
                        if share > 1e-6:
                            for f in found:
                                slope[KINDS[k], f] -= share
                for key, g in slope.items():
                    step(self.weights, key, g)


def disguised(kind: str, piece: str, pick: random.Random) -> str:
    """The same data written in another way."""
    if kind == "email":
        at, dot = pick.choice([(" at ", " dot "), ("(at)", "."), ("[at]", "[dot]"), (" (at) ", " (dot) "), (" (at) ", "."), (" @ ", " dot "), (" [at] ", "."), ("@", "[.]"), (" @ ", ".")])
        local, domain = piece.split("@")
        return (local.replace(".", dot) if pick.random() < 0.5 else local) + at + domain.replace(".", dot)
    if kind == "ip":
        return piece.replace(".", pick.choice(["[.]", "(.)", " . ", "[dot]"]))
    digits = _digits(piece)
    if kind == "card":
        return pick.choice([".", "/", "  ", " - "]).join(digits[i : i + 4] for i in range(0, len(digits), 4))
    tail = digits[-10:] if len(digits) > 10 else digits
    return pick.choice(["00" + piece[1:], f"({tail[:3]}) {tail[3:6]}-{tail[6:]}", f"{tail[:3]}-{tail[3:6]}-{tail[6:]}", f"{tail[:3]}.{tail[3:6]}.{tail[6:]}"])


def spoilt(kind: str, piece: str, pick: random.Random) -> str:
    """What looks like it but is none."""
    digits = _digits(piece)
    if kind == "email":
        at = pick.choice([" ", "/", "#", " at "])
        if pick.random() < 0.5:
            return piece.replace("@", at).replace(".", pick.choice([" ", "."]))
        words = re.findall("[a-z]{2,}", piece) or ["so"]  # words between marks that address nobody
        return f"{pick.choice(words)} at {pick.choice(words)} dot {pick.choice([w for w in words if w not in ENDINGS] or ['so'])}"
    if kind == "ip":
        parts = piece.split(".")
        return ".".join(parts[: pick.choice([2, 3])]) if pick.random() < 0.5 else ".".join([str(256 + pick.randrange(700)), *parts[1:]])
    if kind == "card":
        if pick.random() < 0.5:
            at = pick.randrange(len(digits))
            return digits[:at] + str((int(digits[at]) + 1 + pick.randrange(8)) % 10) + digits[at + 1 :]
        return digits[: pick.randrange(4, 12)]
    return pick.choice([digits[:5], f"{digits[:4]}-{digits[4:6]}-{digits[6:8]}", digits[:4] + " " + digits[4:7], f"{digits[:2]}.{digits[2:4]}"])


#: Documents whose windows may be learnt from, windows of one document and windows of one kind that are.
SAMPLE, EACH, OF_KIND = 8192, 4, 120
#: Share of all ways from which on a segment counts.
SURE = 0.9


def learn(docs: DataFrame, sample: int = SAMPLE) -> Field:
    """A field trained on windows of at most about ``sample`` documents, chosen by a hash of their text; without any match it finds nothing."""
    rows = docs.select("text").filter("text is not null")
    n = rows.count()
    rows = rows.withColumn("h", F.xxhash64("text", F.lit(13)))
    if n > sample:
        rows = rows.filter(F.pmod("h", F.lit(1_000_000)) < int(1_000_000 * sample / n) + 1)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: dict[str, list] = {"h": [], "kind": [], "at": [], "piece": []}
            for text, h in zip(batch.column("text").to_pylist(), batch.column("h").to_pylist()):
                spans, taken = base(text), defaultdict(int)
                for start, end in windows(text):
                    inside = next((k for k, a, b in spans if start <= a and b <= end), "none")
                    taken[inside] += 1
                    if taken[inside] <= EACH and end - start <= 10 * AROUND:
                        for name, value in zip(out, (h, inside, start, text[start:end])):
                            out[name].append(value)
            yield pa.RecordBatch.from_pydict(out, pa.schema([("h", pa.int64()), ("kind", pa.string()), ("at", pa.int64()), ("piece", pa.string())]))

    made = rows.mapInArrow(run, "h long, kind string, at long, piece string").distinct()
    found = made.orderBy("h", "at").limit(sample * EACH).collect()  # windows of the bounded sample
    pick, own = random.Random(1), Field()
    examples: list[tuple[str, list[Span]]] = []
    for kind in (*KINDS, "none"):
        for r in [r for r in found if r.kind == kind][:OF_KIND]:
            spans = _apart(base(r.piece))
            examples.append((r.piece, spans))
            for change in (disguised, disguised, spoilt) if spans else ():
                text, moved, done = "", [], 0
                for name, a, b in spans:
                    text += r.piece[done:a]
                    new = change(name, r.piece[a:b], pick)
                    moved += [(name, len(text), len(text) + len(new))] if change is disguised else []
                    text, done = text + new, b
                text += r.piece[done:]
                kept = moved if change is disguised else [s for s in _apart(base(text))]
                examples.append((text, kept))
    own.train(examples)
    own.weights = {k: w for k, w in own.weights.items() if w}
    return own


def _apart(spans: list[Span]) -> list[Span]:
    """Spans by place, without those that overlap an earlier one."""
    out: list[Span] = []
    for span in sorted(spans, key=lambda s: (s[1], -s[2], KINDS.index(s[0]))):
        if not out or span[1] >= out[-1][2]:
            out.append(span)
    return out


def added(text: str, spans: list[Span], own: Field, sure: float = SURE) -> list[Span]:
    """What the field finds beside the spans that the patterns matched; none of it overlaps them."""
    out: list[Span] = []
    taken = sorted((a, b) for _, a, b in spans)
    at = 0
    for start, end in windows(text):
        # stretches of the window between matched spans
        while at < len(taken) and taken[at][1] <= start:
            at += 1
        cuts, here, k = [], start, at
        while k < len(taken) and taken[k][0] < end:
            if taken[k][0] > here:
                cuts.append((here, taken[k][0]))
            here, k = max(here, taken[k][1]), k + 1
        if here < end:
            cuts.append((here, end))
        for a, b in cuts:
            if _ANCHOR.search(text, a, b) is None:
                continue
            ends, segments = candidates(text, a, b)
            if segments:
                out += [(kind, ends[i], ends[j]) for i, j, kind in own.best(len(ends) - 1, segments, sure)]
    return out


def find(docs: DataFrame, own: Field | None = None) -> DataFrame:
    """(doc_id, spans): all personal data of each whole text, as (kind, start, end, base) by kind, then start; places in code points, end exclusive.

    ``base`` marks what the patterns match, which always counts; the field adds spans that overlap none of it. Kinds
    are email, ip, card and phone. A null or empty text has no span; repeated rows and null ids give a row each, and an
    empty table none. A very long text is searched window by window: what is held of it is the text and its spans.
    Windows of at most ``SAMPLE`` documents are learnt from, unless a trained field is given.
    """
    own = own or learn(docs)
    shared = docs.sparkSession.sparkContext.broadcast(own)  # weights of four kinds' features

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        item = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("base", pa.bool_())])
        for part, texts in T.steps(batches):
            rows = []
            for raw in texts:
                text = raw.decode("utf-8", "replace")
                spans = base(text)
                found = [(*s, True) for s in spans] + [(*s, False) for s in added(text, spans, shared.value)]
                found.sort(key=lambda s: (KINDS.index(s[0]), s[1]))
                rows.append([dict(zip(("kind", "start", "end", "base"), s)) for s in found])
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(rows, pa.list_(item))], ["doc_id", "spans"])

    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, spans array<struct<kind: string, start: long, end: long, base: boolean>>")


def masked(docs: DataFrame, found: DataFrame) -> DataFrame:
    """(doc_id, text): each text with a placeholder such as ``<email>`` in place of every span; of overlapping ones the first in place stays. ``doc_id`` must be unique."""

    @F.udf("string")
    def cover(text: str | None, spans: list) -> str | None:
        out, done = [], 0
        for kind, a, b in _apart([(s["kind"], s["start"], s["end"]) for s in spans or []]):
            out += [text[done:a], f"<{kind}>"]
            done = b
        return text if text is None else "".join([*out, text[done:]])

    return docs.select("doc_id", "text").join(found, "doc_id", "left").select("doc_id", cover("text", "spans").alias("text"))
