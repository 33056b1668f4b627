"""Secret scans: fixed patterns, and a linear-chain conditional random field over tokens.

The field tags tokens as secret begin, inside or outside from their shape, neighbouring words and
features of the file, and is decoded by Viterbi. Tokens are runs of TOKEN characters. Tagged are all tokens
of a line behind a key-like word, whatever their length and kind, and elsewhere those of at least MIN_LENGTH
characters with a digit or mixed case, or of LONG characters. All other tokens are outside by definition, so
a text's best tagging falls apart into its runs of neighbouring tokens, each decoded with an outside tag on
either side. That is the exact Viterbi path of the whole text.

The field is trained here, by gradient descent on the conditional likelihood, over labelled lines that a
seeded generator writes (keys, tokens, passwords, against dates, numbers, addresses, versions, checksums).
"""

from __future__ import annotations

import math
import random
import re
import zlib
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import accumulate

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Base patterns, fixed values: kinds in order, with the least length of the part that must be long enough.
KINDS = ("assign", "access", "hex")
_assign = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
_access = re.compile(r"AKIA[A-Z0-9]+")
_hex = re.compile(r"[0-9a-f]{16,}")
_words = ("password", "passwd", "secret", "token", "apikey", "api_key")
ASSIGN_LENGTH, ACCESS_LENGTH = 12, 18
MODEL_KIND = "crf"

MIN_LENGTH = 8
LONG = 20
BUCKETS = 4096
OUT, BEGIN, INSIDE = range(3)
_digit = re.compile(r"[0-9]")
_token = re.compile(r"[A-Za-z0-9+/_=~!@#$%^&*.\-]+")
_word = re.compile(r"\w")
_core = re.compile(r"[A-Za-z0-9+/_=~].*[A-Za-z0-9+/_=~]", re.DOTALL)
_near = 80
_long = re.compile(rf"[A-Za-z0-9+/_=~!@#$%^&*.\-]{{{MIN_LENGTH},}}")
_mixed = re.compile(r"[a-z][A-Z]|[A-Z]{2}[a-z]")
_key_word = r"(?<![A-Za-z])(?:pass(?:word|wd|phrase)?|pwd|secret|token|bearer|auth(?:orization)?|credentials?|(?:api|access|private)[_-]?key)(?![A-Za-z])"
_key = re.compile(_key_word, re.ASCII | re.IGNORECASE)
_just_before = re.compile(_key_word + r"""["']?\s*(=|:|is\b)?\s*["']?$""", re.ASCII | re.IGNORECASE)
_alnum = re.compile(r"[A-Za-z0-9]")


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the fixed patterns' matches, sorted by start, then kind as listed."""
    found = []
    lowered = text.lower()
    if any(w in lowered for w in _words):
        found += [(m.start(), m.end(), "assign") for m in _assign.finditer(text) if len(m[2]) >= ASSIGN_LENGTH]
    if "AKIA" in text:
        found += [(m.start(), m.end(), "access") for m in _access.finditer(text) if m.end() - m.start() >= ACCESS_LENGTH]
    found += [(m.start(), m.end(), "hex") for m in _hex.finditer(text)]
    return sorted(found, key=lambda s: (s[0], KINDS.index(s[2])))


def candidates(text: str) -> Iterator[tuple[int, int]]:
    """Spans of candidate tokens, in order. Linear in the text: from digit to digit, past each token's end."""
    done = 0
    while m := _digit.search(text, done):
        at = m.start()
        start = at
        while start > done and _token.match(text, start - 1, start):
            start -= 1
        end = _token.match(text, at).end()
        done = end
        if end - start >= MIN_LENGTH and (core := _core.search(text, start, end)) and core.end() - core.start() >= MIN_LENGTH and _digit.search(core[0]):
            yield core.start(), core.end()


def keyed(text: str) -> list[tuple[int, int, int]]:
    """Start of a line's first key-like word, its end and the line's end, for every line that has one."""
    found, upto = [], 0
    while m := _key.search(text, upto):
        end = text.find("\n", m.end())
        upto = len(text) if end < 0 else end
        found.append((m.start(), m.end(), upto))
    return found


def odd_tokens(text: str, start: int, end: int) -> Iterator[tuple[int, int]]:
    """Spans in a stretch of text of tokens that have a digit or mixed case, or are long."""
    for m in _long.finditer(text, start, end):
        core = _core.search(text, *m.span())
        if core and len(core[0]) >= MIN_LENGTH and (_digit.search(core[0]) or _mixed.search(core[0]) or len(core[0]) >= LONG):
            yield core.span()


def tagged(text: str) -> Iterator[tuple[int, int]]:
    """Spans of all tokens that the field tags, in order."""
    done = 0
    for word, start, end in keyed(text):
        yield from odd_tokens(text, done, word)
        cuts = [start]  # every later key-like word ends a token too, so that its value is one of its own
        for m in _key.finditer(text, start, end):
            cuts += m.span()
        for a, b in zip(cuts, [*cuts[1:], end]):
            for m in _token.finditer(text, a, b):
                core = m[0].rstrip("!@#$%^&*.-")
                bare = core.lstrip("=!@#$%^&*.-")
                if _alnum.search(bare):
                    yield m.start() + len(core) - len(bare), m.start() + len(core)
        done = end
    yield from odd_tokens(text, done, len(text))


def runs(text: str) -> Iterator[list[tuple[int, int]]]:
    """Runs of neighbouring tagged tokens: a few marks or blanks, and no word, lie between them."""
    held: list[tuple[int, int]] = []
    for a, b in tagged(text):
        if held and (a - held[-1][1] > 8 or _word.search(text, held[-1][1], a)):
            yield held
            held = []
        held.append((a, b))
    if held:
        yield held


def file_features(text: str) -> list[str]:
    n = max(len(text), 1)
    marks = text.count("=") + text.count("{") + text.count(";")
    return [f"file:marks{min(int(math.log2(1 + 1000 * marks / n)), 5)}", f"file:lines{min(int(math.log2(1 + 1000 * text.count(chr(10)) / n)), 5)}"]


def shape(token: str) -> str:
    return re.sub(r"(.)\1+", r"\1+", re.sub(r"[^Aa0]", "-", re.sub(r"[0-9]", "0", re.sub(r"[a-z]", "a", re.sub(r"[A-Z]", "A", token)))))


def token_features(text: str, a: int, b: int, file: list[str]) -> list[int]:
    """Hashed features of one candidate token."""
    token = text[a:b]
    counts = np.unique(np.frombuffer(token.encode("utf-32-le"), np.uint32), return_counts=True)[1] / len(token)
    entropy = float(-(counts * np.log2(counts)).sum())
    digits = sum(c.isdigit() for c in token)
    upper, lower = any("A" <= c <= "Z" for c in token), any("a" <= c <= "z" for c in token)
    mixed = ("A" if upper else "") + ("a" if lower else "") + ("0" if digits else "")
    form = shape(token)
    names = [
        "bias", f"len{min(len(token) // 4, 12)}", f"ent{min(int(2 * entropy), 10)}", f"mix{mixed}", f"digits{int(5 * digits / len(token))}",
        f"changes{min(len(form.replace('+', '')) // 3, 8)}", f"shape:{form[:12]}", f"start:{token[:4].lower()}", f"mix{mixed}len{min(len(token) // 8, 6)}ent{min(int(2 * entropy), 10)}",
        f"hex{bool(re.fullmatch('[0-9a-f]+', token))}", f"number{bool(re.fullmatch('[-0-9.,:/+()]+', token))}", f"has:{'.' in token}{'/' in token}{'-' in token}{'_' in token}{'@' in token}",
    ]
    before = re.findall(r"[A-Za-z_]{2,}|[:=]", text[max(0, a - _near) : a])[-4:]
    after = re.findall(r"[A-Za-z_]{2,}", text[b : b + _near])[:1]
    names += [f"b{k}:{w.lower()}" for k, w in enumerate(reversed(before))] + [f"b:{w.lower()}" for w in before] + [f"a:{w.lower()}" for w in after]
    names.append(f"edge:{text[max(0, a - 1) : a]}:{text[b : b + 1]}" if text[b : b + 1] in "\"'`,;)" else "edge")
    key = _just_before.search(text, max(0, a - _near), a)
    if key:
        names += ["keyed", f"keyed:{(key[1] or '').lower()}", f"keyed:{(key[1] or '').lower()}:mix{mixed}len{min(len(token) // 4, 4)}"]
    names.append(f"short{len(token)}" if len(token) < MIN_LENGTH else f"mixed{bool(_mixed.search(token))}:{bool(digits)}:{min(len(form.replace('+', '')) // 3, 8)}")
    return [zlib.crc32(x.encode("utf-8", "surrogatepass")) % BUCKETS for x in names + file]


@dataclass
class SecretField:
    """weights: one row of tag scores per feature; moves: score of one tag after another."""

    weights: np.ndarray
    moves: np.ndarray

    def scores(self, feats: list[list[int]]) -> np.ndarray:
        return np.array([self.weights[f].sum(0) for f in feats])

    def decode(self, emit: np.ndarray) -> list[int]:
        """Best tags of a run, with outside before and after it; inside never follows outside."""
        best = self.moves[OUT] + emit[0]
        back = []
        for e in emit[1:]:
            step = best[:, None] + self.moves
            back.append(step.argmax(0))
            best = step.max(0) + e
        tag = int((best + self.moves[:, OUT]).argmax())
        tags = [tag]
        for b in reversed(back):
            tags.append(int(b[tags[-1]]))
        return tags[::-1]

    def spans(self, text: str) -> list[tuple[int, int]]:
        """Spans that the field tags as secrets in a whole text."""
        found, file = [], None
        for run in runs(text):
            file = file_features(text) if file is None else file
            tags = self.decode(self.scores([token_features(text, a, b, file) for a, b in run]))
            for (a, b), t in zip(run, tags):
                if t == BEGIN:
                    found.append((a, b))
                elif t == INSIDE:
                    found[-1] = (found[-1][0], b)
        return found


_FORBIDDEN = -1e4


def _lines(rng: random.Random) -> Iterator[tuple[str, list[tuple[int, int]]]]:
    """Endless labelled lines: text and spans of its secrets."""
    hexa, alnum = "0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    pick = lambda s, n: "".join(rng.choice(s) for _ in range(n))
    syl = ["an", "re", "tion", "er", "the", "in", "ou", "le", "en", "ver", "sch", "de", "os", "ment", "cia", "ing", "lo", "ka", "mi", "tu"]
    word = lambda: "".join(rng.choice(syl) for _ in range(rng.randint(1, 3)))
    digits = lambda n: pick("0123456789", n)
    secrets = [
        lambda: pick(hexa, rng.choice([24, 32, 40, 64])), lambda: pick(alnum, rng.randint(16, 44)), lambda: "AKIA" + pick(alnum[:26] + "0123456789", 16),
        lambda: rng.choice(["ghp_", "sk_live_", "sk-", "xoxb-", "glpat-"]) + pick(alnum, rng.randint(20, 36)), lambda: pick(alnum + "+/", rng.randint(24, 60)) + rng.choice(["", "=", "=="]),
        lambda: "eyJ" + pick(alnum, 20) + "." + pick(alnum, 30) + "." + pick(alnum, 30), lambda: word().capitalize() + pick("!@#$%^&*", 1) + digits(rng.randint(3, 5)) + pick(alnum, 4),
    ]
    letters = alnum[:52]
    bare = [  # without a digit
        lambda: pick(letters, rng.randint(16, 40)), lambda: "".join(word().capitalize() for _ in range(rng.randint(2, 4))), lambda: rng.choice(["ghp_", "sk_live_", "xoxb-"]) + pick(letters, rng.randint(20, 36)),
    ]
    named = [*bare, lambda: word() + pick(letters[26:], rng.randint(1, 4)), lambda: word() + pick("!@#$%^&*", 1) + word()]  # told by the word before only
    plain = [
        lambda: "".join(word().capitalize() for _ in range(rng.randint(2, 3))), lambda: "".join(word().capitalize() for _ in range(3)), lambda: word() + word().capitalize() + word().capitalize(), lambda: "-".join(word() for _ in range(5)), lambda: f"www.{word()}{word()}.org/{word()}/{word()}", lambda: word() + word() + word(),
        lambda: digits(16), lambda: ".".join(str(rng.randint(0, 255)) for _ in range(4)), lambda: f"20{digits(2)}-{digits(2)}-{digits(2)}", lambda: f"+1-{digits(3)}-{digits(3)}-{digits(4)}", lambda: f"{digits(3)}-{digits(4)}",
        lambda: f"v{rng.randint(1, 9)}.{digits(2)}.{digits(2)}-{word()}", lambda: f"www.{word()}{digits(2)}.com/{word()}/{digits(3)}.html", lambda: f"{word()}{word()}{digits(rng.randint(1, 4))}", lambda: f"{digits(4)}.{digits(6)}",
        lambda: f"{word()}.{word()}{digits(2)}@{word()}.com", lambda: f"{word()}_{word()}_{digits(3)}.txt", lambda: f"{digits(9)}", lambda: f"{digits(3)},{digits(3)},{digits(3)}", lambda: f"0x{pick(hexa, 8)}", lambda: f"{word().upper()}-{digits(6)}",
        lambda: f"{word()}{digits(1)}{word()}{word()}", lambda: f"{pick(hexa, 8)}-{pick(hexa, 4)}-4{pick(hexa, 3)}-a{pick(hexa, 3)}-{pick(hexa, 12)}",
    ]
    keys = ["token", "api_key", "apikey", "secret", "password", "passwd", "access_key", "auth", "bearer", "Authorization: Bearer", "private_key", "client_secret", "credentials", "pwd", "aws_secret_access_key"]
    notes = ["commit", "sha256", "checksum", "md5", "etag", "revision", "id", "order", "phone", "date", "version", "call", "card", "ip", "file", "see", "isbn", "build"]
    while True:
        text, spans = "", []
        for _ in range(rng.randint(1, 4)):
            text += " ".join(word() for _ in range(rng.randint(0, 6))) + " "
            roll = rng.random()
            if roll < 0.35:
                text += rng.choice(keys) + rng.choice([" = ", "=", ": ", " ", " is ", ' = "', "='", ':"'])
                text = text if rng.random() < 0.9 else text + word() + " "
                for part in range(1 + (rng.random() < 0.15)):  # now and then a secret of two tokens
                    joint = text.rstrip(" \"'")[-1:] in ("=", ":")
                    s = rng.choice((secrets if rng.random() < 0.6 else named if joint else bare[:1] + bare[2:]) if not part else secrets)()
                    if part:
                        text += " "
                        spans[-1] = (spans[-1][0], len(text) + len(s))
                    else:
                        spans.append((len(text), len(text) + len(s)))
                    text += s
                text += rng.choice(['"', "'", "", "", ",", "."]) + rng.choice([" ", "\n"])
            elif roll < 0.42:  # a key-like word in prose
                text += rng.choice(keys[:-1]) + rng.choice([" ", " is ", "s "]) + " ".join(word() for _ in range(rng.randint(1, 6))) + rng.choice([". ", "\n", " "])
            elif roll < 0.52:
                s = rng.choice(secrets[:1] + secrets[2:6] + bare[:1] + bare[2:])()
                if s.isalnum() and s == s.lower():  # bare hex in running text: a checksum unless named a key
                    text += rng.choice(notes) + " " + s + " "
                else:
                    spans.append((len(text), len(text) + len(s)))
                    text += s + " "
            else:
                if rng.random() < 0.4:
                    text += rng.choice(notes) + rng.choice([" ", ": ", " = "])
                text += rng.choice(plain)() + rng.choice([" ", ", ", ". ", "\n"])
        yield text + word(), spans


def train(lines: int = 2500, epochs: int = 6, rate: float = 0.3, seed: int = 5) -> SecretField:
    """Fit on generated lines by stochastic gradient ascent on the conditional likelihood (forward-backward)."""
    rng = random.Random(seed)
    made = _lines(rng)
    cases = []
    for _ in range(lines):
        text, spans = next(made)
        file = file_features(text)
        for run in runs(text):
            tags = []
            for a, b in run:
                inside = [s for s in spans if s[0] < b and a < s[1]]
                first = inside and (not tags or tags[-1][1] != inside[0])
                tags.append((BEGIN if first else INSIDE, inside[0]) if inside else (OUT, None))
            cases.append(([np.array(token_features(text, a, b, file)) for a, b in run], [t for t, _ in tags]))
    w = np.zeros((BUCKETS, 3))
    moves = np.zeros((3, 3))
    moves[OUT, INSIDE] = _FORBIDDEN
    for epoch in range(epochs):
        rng.shuffle(cases)
        step = rate / (1 + epoch)
        for feats, tags in cases:
            emit = np.array([w[f].sum(0) for f in feats])
            n = len(tags)
            alpha, beta = np.zeros((n, 3)), np.zeros((n, 3))
            alpha[0] = moves[OUT] + emit[0]
            for k in range(1, n):
                alpha[k] = np.logaddexp.reduce(alpha[k - 1][:, None] + moves, 0) + emit[k]
            beta[-1] = moves[:, OUT]
            for k in range(n - 2, -1, -1):
                beta[k] = np.logaddexp.reduce(moves + emit[k + 1] + beta[k + 1], 1)
            z = np.logaddexp.reduce(alpha[-1] + beta[-1])
            node = np.exp(alpha + beta - z)
            for k, (f, t) in enumerate(zip(feats, tags)):
                g = -node[k]
                g[t] += 1
                np.add.at(w, f, step * g / 4)
            grad = np.zeros((3, 3))
            grad[OUT] -= node[0]
            grad[OUT, tags[0]] += 1
            grad[:, OUT] -= node[-1]
            grad[tags[-1], OUT] += 1
            for k in range(1, n):
                grad -= np.exp(alpha[k - 1][:, None] + moves + emit[k] + beta[k] - z)
                grad[tags[k - 1], tags[k]] += 1
            moves += step * grad / 4
            moves[OUT, INSIDE] = _FORBIDDEN
        w *= 0.999
    return SecretField(w, moves)


def scan_text(text: str | None, field: SecretField) -> tuple[list[tuple[int, int, str]], list[tuple[int, int, str]]]:
    """Base spans, and all spans: the base ones and those the field adds outside them; null is empty."""
    text = text or ""
    base = base_spans(text)
    starts = [s for s, _, _ in base]
    reach = list(accumulate((e for _, e, _ in base), max))  # the furthest end of the base spans so far
    added = [(a, b, MODEL_KIND) for a, b in field.spans(text) if not (k := bisect_right(starts, a)) or reach[k - 1] < b]
    order = (*KINDS, MODEL_KIND)
    return base, sorted(base + added, key=lambda s: (s[0], order.index(s[2])))


SPANS = "array<struct<start:long,end:long,kind:string>>"


def scan(docs: DataFrame, field: SecretField, *, text: str = "text") -> DataFrame:
    """docs with base_spans and spans, arrays of (start, end, kind) in code points, end exclusive, by start.

    Null and empty texts have none. Columns of docs with these names are replaced; repeated rows stay.
    """
    shared = docs.sparkSession.sparkContext.broadcast(field)  # bounded: BUCKETS x 3 weights
    line = lambda spans: ",".join(f"{k}:{a}:{b}" for a, b, k in spans)

    @F.pandas_udf("struct<base_spans:string,spans:string>")
    def run(t: pd.Series) -> pd.DataFrame:
        got = [scan_text(x, shared.value) for x in t]
        return pd.DataFrame({"base_spans": [line(g[0]) for g in got], "spans": [line(g[1]) for g in got]}, dtype=object)

    def parsed(name: str) -> F.Column:
        part = lambda p, k: F.get(F.split(p, ":"), F.lit(k))
        some = F.transform(F.split(F.col(f"_found.{name}"), ","), lambda p: F.struct(part(p, 1).cast("long").alias("start"), part(p, 2).cast("long").alias("end"), part(p, 0).alias("kind")))
        return F.when(F.col(f"_found.{name}") == "", F.array().cast(SPANS)).otherwise(some).alias(name)

    keep = [c for c in docs.columns if c.lower() not in ("base_spans", "spans")]
    return docs.select(*[F.col(f"`{c}`") for c in keep], run(F.col(text)).alias("_found")).select(*[f"`{c}`" for c in keep], parsed("base_spans"), parsed("spans"))


def redact_text(text: str, starts: list[int], ends: list[int], mark: str = "[SECRET]") -> str:
    """The text with every stretch that spans (sorted by start) cover replaced by the mark; overlapping spans share one."""
    out, at = [], 0
    for a, b in zip(starts, ends):
        if b > at:
            out += [text[at:a], mark] if a >= at else []
            at = b
    return "".join([*out, text[at:]])


def redact(text: F.Column, spans: F.Column, mark: str = "[SECRET]") -> F.Column:
    """redact_text of a text and its spans; a null text stays null."""

    @F.pandas_udf("string")
    def run(t: pd.Series, starts: pd.Series, ends: pd.Series) -> pd.Series:
        return pd.Series([x if x is None or not len(a) else redact_text(x, a.tolist(), b.tolist(), mark) for x, a, b in zip(t, starts, ends)], dtype=object)

    return run(text, F.transform(spans, lambda s: s["start"]), F.transform(spans, lambda s: s["end"]))
