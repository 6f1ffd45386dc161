"""Personal data: base patterns, and a semi-Markov conditional random field that adds spans.

Base kinds (email, ip, card, phone) are the leftmost non-overlapping matches of fixed patterns with a check each; a failing match is dropped without a
retry.  Each pattern is run so that it takes linear time on any text.

The semi-Markov CRF works on chunks (runs of non-blanks without outer punctuation).  A segment of 1 to ``MAX_CHUNKS`` chunks and at most ``MAX_CHARS``
characters is scored per type by whole-span features: digit, letter and mark counts, shape, checksums, the words before it.  A dynamic program
over chunk ends, with every entity bounded in length, chooses boundaries and types jointly.  An
entity's outer chunks hold a digit or an @, and other chunks score 0, so only windows around such characters are decoded; that
gives the same result as decoding the whole text.  Its types are the base kinds, which compete for segments, and ``local_phone`` and
``secret``, which have no base pattern; spans of these two that do not overlap a base span are added.  n_email to n_phone count base spans;
n_local_phone, n_secret and n_spans count what the model adds and all spans.  The bounds belong to the method: a secret of letters only, or of over ``MAX_CHARS``
characters, is no candidate.

The model is trained (exact log-likelihood gradients) on a fixed number of sentences composed from templates with a
fixed seed, since no table marks spans; its weights are a few hundred numbers and travel with the task.

Edge cases: a null text is empty; a row without spans has counts 0 and empty strings; repeated rows give repeated rows; null ids stay null; an empty
table gives no rows; extra columns are ignored.  Offsets are code points, ends exclusive.
"""

from __future__ import annotations

import bisect
import functools
import hashlib
import math
import random
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

BASE_KINDS = ("email", "ip", "card", "phone")
ADDED_KINDS = ("local_phone", "secret")
KINDS = BASE_KINDS + ADDED_KINDS
MAX_CHUNKS, MAX_CHARS = 5, 120

_LOCAL = re.compile(r"[A-Za-z0-9._%+-]")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_NOT_DIGIT = re.compile(r"[^0-9]")
_LOCAL_SET = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if k % 2:
            d = d * 2 - 9 if d > 4 else d * 2
        total += d
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """A match is a run of local characters before an @ and a domain after it: found from each @, in one direction each."""
    at, free = text.find("@"), 0
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL_SET:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            yield start, m.end()
        # characters before this @ cannot be part of a later match
        free = m.end() if m else at + 1
        at = text.find("@", free)


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, kind index, end) by start, then kind as listed."""
    out: list[tuple[int, int, int]] = [(a, 0, b) for a, b in _emails(text)]
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
            out.append((m.start(), 1, m.end()))
    for m in _CARD.finditer(text):
        digits = _NOT_DIGIT.sub("", m[0])
        if 14 <= len(digits) <= 19 and luhn(digits):
            out.append((m.start(), 2, m.end()))
    for m in _PHONE.finditer(text):
        if 10 <= len(_NOT_DIGIT.sub("", m[0])) <= 15:
            out.append((m.start(), 3, m.end()))
    return sorted(out)


# --- semi-Markov CRF -------------------------------------------------------------------------------------------------

_CHUNK = re.compile(r"\S+")
_BLANK = re.compile(r"\s")
_TRIGGER = re.compile(r"[0-9@]")
_HEX = re.compile(r"[0-9a-fA-F]+")
_MAIL_LIKE = re.compile(r"[^\s@]+@[^\s@]+\.[A-Za-z0-9-]+")
_PHONE_CHARS = re.compile(r"[0-9().\x20-]+")
_GROUPS = re.compile(r"\(?[0-9]{3}\)?[\x20.-]?[0-9]{3}[\x20.-][0-9]{4}")
_SECRET_CHARS = re.compile(r"[A-Za-z0-9_+/=-]+")
# fixed values: words that announce a kind
CUES = {"secret": ("token", "key", "secret", "password", "passwd", "apikey", "api_key", "bearer"), "phone": ("phone", "tel", "call", "fax", "mobile")}
FEATURES = (
    "bias", "chunks_1", "chunks_2", "chunks_3", "chunks_4up", "has_at", "mail_like", "plus_first", "dotted_quad", "quad_in_range", "digits_1_6", "digits_7_9",
    "digits_10_13", "digits_14_19", "digits_20up", "luhn", "only_digits", "phone_chars", "phone_groups", "hex_32up", "mixed_20up", "letters", "cue_secret", "cue_phone", "assigned", "blank_inside", "long",
)
_AT = {f: k for k, f in enumerate(FEATURES)}


def span_features(s: str, chunks: int, before: str) -> list[int]:
    """Indexes of the features that hold for a whole span; ``before``: the text just before it."""
    digits = sum("0" <= c <= "9" for c in s)
    letters = sum(c.isalpha() for c in s)
    plain = _NOT_DIGIT.sub("", s)
    words = re.findall(r"[A-Za-z_]+", before.lower())[-2:]
    quad = s.split(".")
    is_quad = len(quad) == 4 and all(q.isdigit() for q in quad)
    bucket = "digits_1_6" if digits < 7 else "digits_7_9" if digits < 10 else "digits_10_13" if digits < 14 else "digits_14_19" if digits < 20 else "digits_20up"
    held = {
        "bias": True, ("chunks_4up" if chunks > 3 else f"chunks_{chunks}"): True, "has_at": "@" in s, "mail_like": bool(_MAIL_LIKE.fullmatch(s)), "plus_first": s[0] == "+",
        "dotted_quad": is_quad, "quad_in_range": is_quad and all(int(q[-9:]) <= 255 for q in quad), bucket: True, "luhn": 14 <= digits <= 19 and luhn(plain), "only_digits": digits == len(s),
        "phone_chars": bool(_PHONE_CHARS.fullmatch(s)), "phone_groups": bool(_GROUPS.fullmatch(s)), "hex_32up": len(s) >= 32 and bool(_HEX.fullmatch(s)),
        "mixed_20up": len(s) >= 20 and digits >= 4 and letters >= 4 and s.isascii() and bool(_SECRET_CHARS.fullmatch(s)), "letters": letters > 0, "cue_secret": any(w in CUES["secret"] for w in words),
        "cue_phone": any(w in CUES["phone"] for w in words), "assigned": before.rstrip(" \"'")[-1:] in ("=", ":"), "blank_inside": " " in s, "long": len(s) > 45,
    }
    return [_AT[f] for f, v in held.items() if v]


def chunks_of(text: str, a: int, b: int) -> list[tuple[int, int]]:
    out = []
    for m in _CHUNK.finditer(text, a, b):
        s, e = m.span()
        while s < e and text[s] in "\"'[<{#*$%&":
            s += 1
        while e > s and text[e - 1] in ".,;:!?\"']>}#*$%&":
            e -= 1
        # name=value: the value is a chunk of its own
        cut = text.find("=", s, e)
        if 0 < cut - s < 24 and cut + 1 < e:
            s = cut + 1
            while s < e and text[s] in "\"'":
                s += 1
        if s < e:
            out.append((s, e))
    return out


def segments(text: str, chunks: list[tuple[int, int]]) -> list[tuple[int, int, list[int]]]:
    """(first chunk, chunk after the last, features) of the candidate segments."""
    hot = [bool(_TRIGGER.search(text, s, e)) for s, e in chunks]
    out = []
    for i, (s, _) in enumerate(chunks):
        if hot[i]:
            for j in range(i, min(i + MAX_CHUNKS, len(chunks))):
                e = chunks[j][1]
                if e - s > MAX_CHARS:
                    break
                if hot[j]:
                    out.append((i, j + 1, span_features(text[s:e], j + 1 - i, text[max(0, s - 40) : s])))
    return out


def decode(text: str, chunks: list[tuple[int, int]], weights: np.ndarray) -> list[tuple[int, int, int]]:
    """The best segmentation: (start, kind index, end) of its entities."""
    by_end: dict[int, list[tuple[int, int, float]]] = {}
    for i, j, f in segments(text, chunks):
        scores = weights[:, f].sum(axis=1)
        y = int(np.argmax(scores))  # types do not interact, so only a segment's best one can win
        by_end.setdefault(j, []).append((i, y, float(scores[y])))
    best, back = [0.0] * (len(chunks) + 1), [None] * (len(chunks) + 1)
    for j in range(1, len(chunks) + 1):
        best[j] = best[j - 1]
        for i, y, score in by_end.get(j, ()):
            if best[i] + score > best[j]:
                best[j], back[j] = best[i] + score, (i, y)
    out, j = [], len(chunks)
    while j:
        if back[j] is None:
            j -= 1
        else:
            i, y = back[j]
            out.append((chunks[i][0], y, chunks[j - 1][1]))
            j = i
    return out[::-1]


def _gradient(text: str, gold: set[tuple[int, int, int]], weights: np.ndarray) -> np.ndarray:
    """Of the log-likelihood of one sentence, by forward and backward sums over segmentations."""
    chunks = chunks_of(text, 0, len(text))
    n, segs = len(chunks), segments(text, chunks)
    scores = [weights[:, f].sum(axis=1) for _, _, f in segs]
    ahead, behind = [-math.inf] * (n + 1), [-math.inf] * (n + 1)
    ahead[0] = behind[n] = 0.0
    ends, starts = {}, {}
    for k, (i, j, _) in enumerate(segs):
        ends.setdefault(j, []).append(k)
        starts.setdefault(i, []).append(k)
    whole = [float(np.logaddexp.reduce(s)) for s in scores]
    for j in range(1, n + 1):
        ahead[j] = float(np.logaddexp.reduce([ahead[j - 1], *(ahead[segs[k][0]] + whole[k] for k in ends.get(j, ()))]))
    for i in range(n - 1, -1, -1):
        behind[i] = float(np.logaddexp.reduce([behind[i + 1], *(behind[segs[k][1]] + whole[k] for k in starts.get(i, ()))]))
    out = np.zeros_like(weights)
    for (i, j, f), s in zip(segs, scores, strict=True):
        expected = np.exp(ahead[i] + s + behind[j] - ahead[n])
        for y in range(len(KINDS)):
            seen = float((chunks[i][0], y, chunks[j - 1][1]) in gold)
            out[y, f] += seen - expected[y]
    return out


def _sentence(rng: random.Random) -> tuple[str, set[tuple[int, int, int]]]:
    word = lambda: "".join(rng.choice("abdefghilmnoprstuw") for _ in range(rng.randrange(2, 9)))
    num = lambda n: "".join(rng.choice("0123456789") for _ in range(n))

    def card() -> str:
        body = num(15)
        return next(body + d for d in "0123456789" if luhn(body + d))

    def entity() -> tuple[int, str, str, str]:
        y = rng.randrange(len(KINDS) + 3)
        pre = post = ""
        if y == 0:
            s = f"{word()}{rng.choice(['.', '_', ''])}{num(rng.randrange(3))}@{word()}.{rng.choice(['com', 'org', 'net', 'example.com'])}"
        elif y == 1:
            s = ".".join(str(rng.randrange(256)) for _ in range(4))
        elif y == 2:
            s = card()
            s = rng.choice([s, " ".join(s[k : k + 4] for k in range(0, 16, 4)), "-".join(s[k : k + 4] for k in range(0, 16, 4))])
        elif y == 3:
            s = rng.choice([f"+1 ({num(3)}) {num(3)}-{num(4)}", f"+{num(2)} {num(3)} {num(4)} {num(3)}", f"+1-{num(3)}-{num(3)}-{num(4)}"])
        elif y == 4:
            s, pre = rng.choice([f"({num(3)}) {num(3)}-{num(4)}", f"{num(3)}-{num(3)}-{num(4)}", f"{num(3)}.{num(3)}.{num(4)}", f"{num(3)} {num(3)}-{num(4)}"]), rng.choice(["", "", "call ", "phone: "])
        elif y == 5:
            s = rng.choice(["".join(rng.choice("0123456789abcdef") for _ in range(rng.choice([32, 40, 64]))), rng.choice(["sk_", "AKIA", ""]) + "".join(rng.choice("ABCDEFGHabcdefgh0123456789") for _ in range(rng.randrange(24, 40)))])
            s = s if sum(c.isdigit() for c in s) > 3 and sum(c.isalpha() for c in s) > 3 else "a1b2c3d4" + s
            pre, post = rng.choice([('token = "', '"'), ("api_key=", ""), ("secret: ", ""), ("password '", "'"), ("key ", "")])
        else:  # numbers that are nothing of the kind
            y = -1
            s = rng.choice([str(rng.randrange(1900, 2030)), f"{num(1)}.{num(1)}", num(rng.randrange(1, 13)), f"v{num(1)}.{num(2)}", f"{num(2)}/{num(2)}/{num(4)}", f"20{num(2)}-0{num(1)}-1{num(1)}", f"${num(3)},{num(3)}", f"{word()}{num(2)}", f"{300 + rng.randrange(600)}.{num(4)}.{num(1)}.{num(1)}", num(16)[:-1] + "x", f"{num(3)} {num(2)}", f"{num(4)} {num(4)}"])
        return y, pre, s, post

    text, gold = "", set()
    for _ in range(rng.randrange(1, 5)):
        text += " ".join(word() for _ in range(rng.randrange(1, 5))) + " "
        y, pre, s, post = entity()
        if y >= 0:
            gold.add((len(text) + len(pre), y, len(text) + len(pre) + len(s)))
        text += pre + s + post + rng.choice([" ", ", ", ". ", "\n"])
    return text + word(), gold


@functools.cache
def train(sentences: int = 500, rounds: int = 3, rate: float = 0.3, seed: int = 11) -> bytes:
    """Weights (kinds, features) as bytes, from ``sentences`` composed sentences."""
    rng = random.Random(seed)
    data = [_sentence(rng) for _ in range(sentences)]
    weights, square = np.zeros((len(KINDS), len(FEATURES))), np.full((len(KINDS), len(FEATURES)), 1e-6)
    weights[:, _AT["bias"]] = -1.0
    for _ in range(rounds):
        for text, gold in data:
            g = _gradient(text, gold, weights) - 1e-4 * weights
            square += g * g
            weights += rate * g / np.sqrt(square)
    return weights.tobytes()


def windows(text: str) -> Iterator[tuple[int, int]]:
    """Ranges from the first to the last of neighbouring digits and @: no candidate segment has such characters of two ranges."""
    a = b = -1
    for m in _TRIGGER.finditer(text):
        p = m.start()
        if a >= 0 and p - b > 2 * MAX_CHARS:
            yield a, b
            a = -1
        if a < 0:
            a = p
        b = p
    if a >= 0:
        yield a, b


def added_spans(text: str, base: list[tuple[int, int, int]], weights: np.ndarray) -> list[tuple[int, int, int]]:
    out, starts, reach = [], [x[0] for x in base], []
    for _, _, e in base:
        reach.append(max(e, reach[-1] if reach else 0))
    done = 0  # text before this is decoded
    for a, b in windows(text):
        # a whole chunk at either end; a chunk that the window before reached into is decoded with that one, so each is read once
        if b < done:
            continue
        a = max(a, done)
        while a > done and not text[a - 1].isspace():
            a -= 1
        m = _BLANK.search(text, b)
        done = b = m.start() if m else len(text)
        for s, y, e in decode(text, chunks_of(text, a, b), weights):
            before = bisect.bisect_left(starts, e)  # base spans that begin before this one ends
            if y >= len(BASE_KINDS) and not (before and reach[before - 1] > s):
                out.append((s, y, e))
    return out


def find(docs: DataFrame) -> DataFrame:
    """doc_id, spans: array of (kind, start, end, base) by start, then kind as listed."""
    trained = train()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = np.frombuffer(trained).reshape(len(KINDS), len(FEATURES))
        kind = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("base", pa.bool_())])
        for batch in batches:
            found = []
            for value in batch.column(1):
                text = value.as_py() or ""
                spans = []
                if _TRIGGER.search(text):
                    base = base_spans(text)
                    more = added_spans(text, base, weights)
                    spans = [{"kind": KINDS[y], "start": s, "end": e, "base": b} for s, y, e, b in sorted([*((*x, True) for x in base), *((*x, False) for x in more)])]
                found.append(spans)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(kind))], ["doc_id", "spans"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, spans array<struct<kind:string,start:long,end:long,base:boolean>>")


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find(table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda s: s["base"])
    joined = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    count = lambda spans, kind: F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    counts, more = [count(base, kind) for kind in BASE_KINDS], [count("spans", kind) for kind in ADDED_KINDS]
    return found.select("doc_id", *counts, F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"), *more, F.size("spans").cast("long").alias("n_spans"))
