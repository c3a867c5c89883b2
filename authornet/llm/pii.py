"""Personal data: fixed patterns, and a semi-Markov conditional random field beside them.

The patterns (``base_spans``) are exact and always kept.  The field looks at zones, runs of pieces
with a digit or an @ in them, and scores whole candidate segments: length and digit
counts, check digit, dotted quads, signs at the edges, cue words before.  A dynamic programme over
the zone's tokens, bounded by the longest entity, chooses boundaries and types of all segments
jointly; a long zone is decoded in windows that overlap by more than the longest entity.  Its weights are learned here: conditional likelihood on a bounded sample of zones
(``sample_zones``, the smallest hashes), marked by the patterns, with a Gaussian prior around the
weights that the meaning of the features suggests.  A segment of the best labelling is added where
it touches no pattern's span and its probability is high enough.

Edge cases: null and empty texts have no span; an empty table gives an empty result; a corpus
without any zone leaves the weights at their prior; repeated rows are scanned each; very long
words cost linear time (no pattern is retried inside a run); extra columns are ignored (or
kept, by ``redact``).
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

KINDS = ("email", "ip", "card", "phone")
SAMPLE_ZONES = 300
MAX_TOKENS = 24
WINDOW, MARGIN = 1024, 3 * MAX_TOKENS  # tokens whose segments a window keeps, and read on either side of them
KEPT_RUN = 64  # letters or digits of one run in a training row: more change no feature
EPOCHS = 30
PRIOR_STRENGTH = 0.02
MIN_PROBABILITY = 0.9

# The patterns of the task's contract; runs are entered at their start only.
LOCAL = re.compile(r"[A-Za-z0-9._%+-]")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
MARK = re.compile(r"[0-9@]")
GAP = re.compile(r"[ \n\t\r]")
LONG_RUN = re.compile(rf"([A-Za-z]{{{KEPT_RUN}}})[A-Za-z]+|([0-9]{{{KEPT_RUN}}})[0-9]+")

Span = tuple[str, int, int]


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if k % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d)
    return total % 10 == 0


def _emails(text: str) -> Iterator[Span]:
    done, at = 0, text.find("@")
    while at >= 0:
        first = at
        while first > done and LOCAL.match(text[first - 1]):
            first -= 1
        m = DOMAIN.match(text, at + 1) if first < at else None
        if m:
            yield "email", first, m.end()
        done = m.end() if m else at + 1  # a part before this @ cannot belong to the next one
        at = text.find("@", done)


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def base_spans(text: str) -> list[Span]:
    """All spans of the four patterns, by kind and start."""
    out = list(_emails(text))
    if not MARK.search(text):
        return out
    for m in IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
            out.append(("ip", *m.span()))
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 13 and 13 <= len(d := _digits(m[0])) <= 19 and luhn(d):
            out.append(("card", *m.span()))
    for m in PHONE.finditer(text):
        if 9 <= len(_digits(m[0])) <= 15:
            out.append(("phone", *m.span()))
    return out


def zones(text: str) -> list[tuple[int, int]]:
    """Runs of pieces that hold a digit or an @, one space between them."""
    out: list[tuple[int, int]] = []
    at = 0
    while m := MARK.search(text, at):
        first = max(at, 1 + max(text.rfind(c, at, m.start()) for c in " \n\t\r"))
        gap = GAP.search(text, m.end())
        end = gap.start() if gap else len(text)
        if out and first == out[-1][1] + 1 and text[out[-1][1]] == " ":
            out[-1] = (out[-1][0], end)
        else:
            out.append((first, end))
        at = end
    return out


TOKEN = re.compile(r"[A-Za-z]+|[0-9]+|\s+|.", re.S)
CUES = {"email": "email mail e-mail contact contacto correo courriel", "ip": "ip address server host from adresse",
        "card": "card visa credit carte karte tarjeta", "phone": "phone tel call mobile fax telefon téléphone teléfono"}
FEATURES = ("bias", "digits_few", "digits_7_8", "digits_9_12", "digits_13_15", "digits_16_19", "digits_many", "luhn",
            "plus", "paren", "one_at", "at_dot", "quad", "quad_255", "space", "hyphen", "letters", "left_clean",
            "right_clean", "cue_email", "cue_ip", "cue_card", "cue_phone")
OUTSIDE = ("digits", "at", "letters", "sign", "space")
NF, NO = len(FEATURES), len(OUTSIDE)
INDEX = {f: k for k, f in enumerate(FEATURES)}
# What the features mean, as the centre of the Gaussian prior.
PRIOR = {
    "email": {"bias": -6, "one_at": 3, "at_dot": 5, "left_clean": 1, "right_clean": 1, "space": -6, "cue_email": 1},
    "ip": {"bias": -6, "quad": 2, "quad_255": 5, "left_clean": 1, "right_clean": 1, "space": -6, "letters": -6, "cue_ip": 1},
    "card": {"bias": -6, "digits_16_19": 1, "digits_13_15": 0.5, "luhn": 6, "left_clean": 1, "right_clean": 1, "letters": -6,
             "one_at": -6, "plus": -3, "quad": -4, "cue_card": 1},
    "phone": {"bias": -6, "digits_9_12": 2, "digits_13_15": 1, "plus": 4, "paren": 2, "left_clean": 1, "right_clean": 1,
              "letters": -6, "one_at": -6, "quad": -4, "cue_phone": 2, "hyphen": 0.5},
}


def prior_weights() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(kind x feature, outside token kinds, label x label transitions)."""
    w = np.zeros((len(KINDS), NF))
    for k, kind in enumerate(KINDS):
        for f, v in PRIOR[kind].items():
            w[k, INDEX[f]] = v
    return w, np.zeros(NO), np.zeros((len(KINDS) + 1, len(KINDS) + 1))


def windows(text: str, first: int, end: int) -> Iterator[tuple[int, int, int, int]]:
    """(start, end) of the tokens whose segments are kept and of those read, for the windows of a zone.  The
    kept parts lie side by side; what is read reaches ``MARGIN`` tokens further, so a segment that starts in a
    kept part lies inside its window with all segments that compete with it."""
    starts = [m.start() for m in TOKEN.finditer(text, first, end)]
    n = len(starts)
    at = lambda k: starts[max(k, 0)] if k < n else end
    if n <= WINDOW + 2 * MARGIN:
        yield first, end, first, end
        return
    for k in range(0, n, WINDOW):
        yield at(k), at(k + WINDOW), at(k - MARGIN), at(k + WINDOW + MARGIN)


class Lattice:
    """Tokens of a zone, or of a window of the zone that starts at ``zone``, and its candidate segments
    (first token, end token) with their feature rows; ``outside`` is the kind of each token."""

    def __init__(self, text: str, first: int, end: int, zone: int | None = None):
        zone = first if zone is None else zone
        toks = [(m.start(), m.end(), m[0]) for m in TOKEN.finditer(text, first, end)]
        self.n = len(toks)
        self.outside = np.array([self._kind(t) for _, _, t in toks], dtype=np.int64)
        before = text[max(0, zone - 40):zone].lower().split()[-3:]
        cues = [INDEX[f"cue_{k}"] for k in KINDS if any(w.strip(":.,") in CUES[k].split() for w in before)]
        digits = np.concatenate([[0], np.cumsum([len(t) if k == 0 else 0 for (_, _, t), k in zip(toks, self.outside)])])
        ats = np.concatenate([[0], np.cumsum(self.outside == 1)])
        letters = np.concatenate([[0], np.cumsum(self.outside == 2)])
        self.spans, rows, self.segments = [], [], []
        for i, (s, _, t) in enumerate(toks):
            if self.outside[i] not in (0, 2) and t not in "+(":
                continue
            for j in range(i + 1, min(self.n, i + MAX_TOKENS) + 1):
                if self.outside[j - 1] == 4 and toks[j - 1][2] != " ":
                    break  # entities stay on a line
                if self.outside[j - 1] not in (0, 2) or digits[j] - digits[i] < 7 and ats[j] == ats[i] and j - i < 7:
                    continue
                if ats[j] == ats[i] and letters[j] > letters[i]:
                    continue  # neither an address nor a number
                e = toks[j - 1][1]
                active = self._features(text, s, e, int(digits[j] - digits[i]), int(ats[j] - ats[i]))
                if active is None:
                    continue
                row = np.zeros(NF)
                row[active + cues] = 1
                rows.append(row)
                self.segments.append((i, j))
                self.spans.append((s, e))
        self.rows = np.array(rows).reshape(-1, NF)
        self.by_end: list[list[int]] = [[] for _ in range(self.n + 1)]
        for k, (_, j) in enumerate(self.segments):
            self.by_end[j].append(k)

    @staticmethod
    def _kind(t: str) -> int:
        c = t[0]
        return 0 if "0" <= c <= "9" else 1 if c == "@" else 2 if c.isalpha() else 4 if c.isspace() else 3

    @staticmethod
    def _features(text: str, s: int, e: int, n_digits: int, n_at: int) -> list[int] | None:
        seg = text[s:e]
        names = ["bias"]
        names += (["digits_few"] if n_digits < 7 else ["digits_7_8"] if n_digits < 9 else ["digits_9_12"] if n_digits < 13
                  else ["digits_13_15"] if n_digits < 16 else ["digits_16_19"] if n_digits < 20 else ["digits_many"])
        letters = any(c.isalpha() for c in seg)
        quad = not letters and seg.count(".") == 3 and all(p.isdigit() for p in seg.split("."))
        if n_at == 0 and letters or n_at == 0 and n_digits < 7 and not quad:
            return None  # neither an address nor a number
        if 13 <= n_digits <= 19 and not letters and luhn(_digits(seg)):
            names.append("luhn")
        if quad:
            names.append("quad")
            if all(len(p) <= 3 and int(p) <= 255 for p in seg.split(".")):
                names.append("quad_255")
        if n_at == 1:
            names.append("one_at")
            if " " not in seg and "." in seg.partition("@")[2] and seg[0] != "@":
                names.append("at_dot")
        names += [f for f, yes in (("plus", seg[0] == "+"), ("paren", "(" in seg and ")" in seg), ("space", " " in seg),
                                   ("hyphen", "-" in seg), ("letters", letters)) if yes]
        if s == 0 or not text[s - 1].isalnum() and text[s - 1] not in "@.-_+%":
            names.append("left_clean")
        after = text[e:e + 2]
        if not after or not after[0].isalnum() and after[0] not in "@-_" and not (after[0] == "." and after[1:].isalnum()):
            names.append("right_clean")
        return [INDEX[f] for f in names]

    def scores(self, w, outside, trans):
        return self.rows @ w.T, outside[self.outside]

    def best(self, w, outside, trans) -> list[tuple[int, int]]:
        """Segments (index, kind) of the best labelling; label 0 is outside."""
        seg, out = self.scores(w, outside, trans)
        K = len(KINDS)
        top = np.full((self.n + 1, K + 1), -np.inf)
        top[0, 0] = 0
        back = {}
        for j in range(1, self.n + 1):
            through = top[j - 1] + trans[:, 0]
            p = int(through.argmax())
            top[j, 0], back[j, 0] = through[p] + out[j - 1], (j - 1, p, -1)
            for k in self.by_end[j]:
                i = self.segments[k][0]
                for kind in range(K):
                    through = top[i] + trans[:, kind + 1]
                    p = int(through.argmax())
                    if (v := through[p] + seg[k, kind]) > top[j, kind + 1]:
                        top[j, kind + 1], back[j, kind + 1] = v, (i, p, k)
        j, label, found = self.n, int(top[self.n].argmax()), []
        while j > 0:
            i, p, k = back[j, label]
            if k >= 0:
                found.append((k, label - 1))
            j, label = i, p
        return found[::-1]

    def expectations(self, w, outside, trans):
        """(log partition, segment x kind probabilities, token outside probabilities,
        expected transitions) by forward and backward sums."""
        seg, out = self.scores(w, outside, trans)
        K = len(KINDS)
        fwd, bwd = np.full((self.n + 1, K + 1), -np.inf), np.full((self.n + 1, K + 1), -np.inf)
        fwd[0, 0] = 0
        into = np.full((len(self.segments), K), -np.inf)
        for j in range(1, self.n + 1):
            fwd[j, 0] = np.logaddexp.reduce(fwd[j - 1] + trans[:, 0]) + out[j - 1]
            for k in self.by_end[j]:
                into[k] = np.logaddexp.reduce(fwd[self.segments[k][0]][:, None] + trans[:, 1:], axis=0) + seg[k]
                fwd[j, 1:] = np.logaddexp(fwd[j, 1:], into[k])
        bwd[self.n] = 0
        starts: list[list[int]] = [[] for _ in range(self.n + 1)]
        for k, (i, _) in enumerate(self.segments):
            starts[i].append(k)
        for i in range(self.n - 1, -1, -1):
            total = trans[:, 0] + out[i] + bwd[i + 1, 0]
            for k in starts[i]:
                total = np.logaddexp(total, np.logaddexp.reduce(trans[:, 1:] + seg[k] + bwd[self.segments[k][1], 1:], axis=1))
            bwd[i] = total
        z = np.logaddexp.reduce(fwd[self.n])
        seg_p = np.exp(into + np.array([bwd[j, 1:] for _, j in self.segments]).reshape(-1, K) - z)
        out_p = np.exp(fwd[1:, 0] + bwd[1:, 0] - z)
        moves = np.zeros_like(trans)
        for i in range(self.n):
            moves[:, 0] += np.exp(fwd[i] + trans[:, 0] + out[i] + bwd[i + 1, 0] - z)
            for k in starts[i]:
                moves[:, 1:] += np.exp(fwd[i][:, None] + trans[:, 1:] + seg[k] + bwd[self.segments[k][1], 1:] - z)
        return z, seg_p, out_p, moves


def _gold(lat: Lattice, spans: list[Span]) -> list[tuple[int, int]]:
    """Segments the patterns mark, left to right without overlap, as (index, kind)."""
    place = {s: k for k, s in enumerate(lat.spans)}
    marked = sorted((s, e, KINDS.index(kind)) for kind, s, e in spans if (s, e) in place)
    out, at = [], -1
    for s, e, kind in marked:
        if s >= at:
            out.append((place[s, e], kind))
            at = e
    return out


def train(samples: list[str | tuple[str, int, int, int]], epochs: int = EPOCHS):
    """Weights by gradient ascent on the conditional likelihood of the marked zones: all zones of a text, or the
    window of ``training_windows``."""
    weights = prior_weights()
    centre = [x.copy() for x in weights]
    data = []
    for sample in samples:
        text, *place = [sample] if isinstance(sample, str) else sample
        spans = base_spans(text)
        for zone, first, end in [place] if place else [
                (zone, first, end) for zone, zone_end in zones(text) for _, _, first, end in windows(text, zone, zone_end)]:
            lat = Lattice(text, first, end, zone)
            if lat.segments:
                data.append((lat, _gold(lat, spans)))
    if not data:
        return weights
    w, outside, trans = weights
    m, v = [np.zeros_like(x) for x in weights], [np.zeros_like(x) for x in weights]
    for step in range(1, epochs + 1):
        grad = [-PRIOR_STRENGTH * (x - c) * len(data) for x, c in zip(weights, centre)]
        for lat, gold in data:
            _, seg_p, out_p, moves = lat.expectations(w, outside, trans)
            true_p, true_out = np.zeros_like(seg_p), np.ones(lat.n)
            at, last, true_moves = 0, 0, np.zeros_like(trans)
            for k, kind in gold:
                true_p[k, kind] = 1
                i, j = lat.segments[k]
                true_out[i:j] = 0
                if i > at:
                    true_moves[last, 0] += 1
                    true_moves[0, 0] += i - at - 1
                    last = 0
                true_moves[last, kind + 1] += 1
                at, last = j, kind + 1
            if lat.n > at:
                true_moves[last, 0] += 1
                true_moves[0, 0] += lat.n - at - 1
            grad[0] += (true_p - seg_p).T @ lat.rows
            grad[1] += np.bincount(lat.outside, true_out - out_p, NO)
            grad[2] += true_moves - moves
        for x, g, mm, vv in zip(weights, grad, m, v):  # Adam
            g = g / len(data)
            mm += 0.1 * (g - mm)
            vv += 0.01 * (g * g - vv)
            x += 0.2 * (mm / (1 - 0.9 ** step)) / (np.sqrt(vv / (1 - 0.99 ** step)) + 1e-8)
    return weights


def added_spans(text: str, base: list[Span], weights) -> list[Span]:
    """Segments of the field that touch no pattern's span."""
    out = []
    for zone, zone_end in zones(text):
        if any(s <= zone and e >= zone_end for _, s, e in base):
            continue
        done = zone
        for kept, kept_end, first, end in windows(text, zone, zone_end):
            near = [(s, e) for _, s, e in base if s < end and first < e]
            lat = Lattice(text, first, end, zone)
            found = [(k, kind) for k, kind in lat.best(*weights) if kept <= lat.spans[k][0] < kept_end
                     and not any(s < lat.spans[k][1] and lat.spans[k][0] < e for s, e in near)]
            if found:
                _, seg_p, _, _ = lat.expectations(*weights)
                for k, kind in found:
                    if seg_p[k, kind] >= MIN_PROBABILITY and lat.spans[k][0] >= done:
                        out.append((KINDS[kind], *lat.spans[k]))
                        done = lat.spans[k][1]
    return out


def find_spans(text: str, weights) -> tuple[list[Span], list[Span]]:
    """(spans of the patterns, all spans), each by kind as listed and start."""
    base = base_spans(text)
    every = base + added_spans(text, base, weights) if MARK.search(text) else base
    return base, sorted(every, key=lambda s: (KINDS.index(s[0]), s[1], s[2]))


def digest(spans: list[Span]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


def training_windows(text: str) -> Iterator[tuple[str, int, int, int, bool]]:
    """(text, place where the words before the zone end, start, end, whether a pattern's span is in it) of every
    window of the zones, with what the lattice reads around it; very long runs of one kind are shortened."""
    base = base_spans(text)
    for zone, zone_end in zones(text):
        if zone_end - zone < 7:
            continue
        cue = text[max(0, zone - 40):zone]
        for _, _, first, end in windows(text, zone, zone_end):
            lead = cue if first == zone else f"{cue}\n{text[first - 1]}"
            body = LONG_RUN.sub(r"\1\2", text[first:end])
            after = "" if end == zone_end else text[end:end + 2]
            yield (lead + body + after, len(cue), len(lead), len(lead) + len(body),
                   any(s < end and first < e for _, s, e in base))


def fit(df: DataFrame, sample_zones: int = SAMPLE_ZONES):
    """Weights learned from the zones (windows of long ones) with the smallest hashes among all texts of
    ``df``; half of the sample holds a pattern's span, half does not."""
    schema = "zone string, cue int, start int, stop int, marked boolean"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = [pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.bool_()]
        for batch in batches:
            found = [w for t in batch.column(0).to_pylist() for w in training_windows(t)]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found) if found else [()] * 5, types)],
                                             names=["zone", "cue", "start", "stop", "marked"])

    texts = common.texts(df).select("text").filter(F.col("text").rlike("[0-9@]"))
    cut = common.write_shared(texts.mapInArrow(run, schema).distinct(), "zones")
    order = [F.xxhash64("zone"), F.col("zone"), F.col("start")]
    half = [(r["zone"], r["cue"], r["start"], r["stop"]) for yes in (True, False)
            for r in cut.filter(F.col("marked") == yes).orderBy(*order).limit(sample_zones // 2).collect()]
    return train(half)


def scan(df: DataFrame, weights) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base (string), spans (string)."""
    sent = common.send(df.sparkSession, weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = sent()
        for batch in batches:
            rows = [find_spans(t, weights) for t in batch.column(1).to_pylist()]
            counts = [pa.array([sum(s[0] == k for s in base) for base, _ in rows], pa.int64()) for k in KINDS]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *counts, pa.array([hashlib.sha256(digest(b).encode()).hexdigest() for b, _ in rows]),
                 pa.array([digest(every) for _, every in rows], pa.string())],
                names=["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans"])

    schema = "doc_id bigint, n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, base_sha256 string, spans string"
    return common.texts(df).mapInArrow(run, schema)


def redact(df: DataFrame, sample_zones: int = SAMPLE_ZONES) -> DataFrame:
    """``df`` with every span replaced by its kind in brackets (n_chars follows)."""
    sent = common.send(df.sparkSession, fit(df, sample_zones))
    names = df.columns
    at = names.index("text")
    counted = names.index("n_chars") if "n_chars" in names else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = sent()
        for batch in batches:
            cols = list(batch.columns)
            texts, sizes = cols[at].to_pylist(), None if counted is None else cols[counted].to_pylist()
            touched = False
            for i, t in enumerate(texts):
                spans = find_spans(t, weights)[1] if t else []
                if not spans:
                    continue
                touched, out, done = True, [], 0
                for kind, s, e in sorted(spans, key=lambda x: (x[1], -x[2])):
                    if s >= done:
                        out += [t[done:s], f"[{kind}]"]
                    done = max(done, e)
                texts[i] = "".join(out) + t[done:]
                if sizes is not None:
                    sizes[i] = len(texts[i])
            if touched:
                cols[at] = pa.array(texts, cols[at].type)
                if sizes is not None:
                    cols[counted] = pa.array(sizes, cols[counted].type)
                batch = pa.RecordBatch.from_arrays(cols, names=names)
            yield batch

    return df.mapInArrow(run, df.schema)


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of personal data in every document."""
    docs = common.documents(spark, sf_dir)
    return scan(docs, fit(docs))
