"""Personal data: fixed base patterns, and further spans chosen by boosted trees.

Base spans (email, ip, card, phone) are exact matches and always stay. High-recall generators propose
further, overlapping candidates (keys and passwords, hexadecimal and upper-case blobs, national phone
and identity numbers, bank accounts, spelled-out mail addresses); boosted trees score them by format
and context, and the calibrated threshold of a kind selects.

The corpus has no labels for spans, so examples are planted: windows of at most CONTEXTS of its
documents get TRAINING forms, personal or secret ones, look-alikes (hashes of commits and files, order
numbers, versions, placeholders) and, for each kind, forms that could be either, whose label is drawn
with the kind's rate in DOUBTFUL. Half of the examples fit the trees, a quarter the calibration, the
last quarter the thresholds; no window serves two of them.
"""

from __future__ import annotations

import random
import re
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from hashlib import sha256

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .boosting import BoostedTrees
from .texts import map_texts

BASE = ("email", "ip", "card", "phone")
ADDED = ("secret", "blob", "national_phone", "national_id", "account", "spelled_email")
ORDER = {k: i for i, k in enumerate(BASE + ADDED)}
TRAINING, SEED = 16_000, 20_240_601  # planted examples, a quarter each for calibration and thresholds
CONTEXTS, WINDOW = 1_600, 160  # documents, the least by a hash of the id, and characters taken of each
#: That a kind's threshold reaches: the lower end of the precision's interval (Wilson's, one side) of the
#: examples kept for thresholds, at CONFIDENCE standard deviations, since the least of many is chosen.
PRECISION, CONFIDENCE = 0.95, 2.33
#: Share of the true spans over the least such threshold that are over the highest one taken into account.
KEPT = 0.99
#: Share of a kind's doubtful forms (right format, no cue) that count as personal or secret.
DOUBTFUL = {"secret": 0.3, "blob": 0.15, "national_phone": 0.5, "national_id": 0.6, "account": 0.8, "spelled_email": 0.7}

_LOCAL_BACK = re.compile(r"[A-Za-z0-9._%+-]*")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# A match that fails from the start of a run of digits fails from the middle of it too.
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_NOT_DIGIT = re.compile(r"[^0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(map(int, reversed(digits))):
        total += d if k % 2 == 0 else 2 * d - 9 * (d > 4)
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[str, int, int]]:
    """A match holds one @; its local part is the run before it, back to the match before."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and _LOCAL_BACK.fullmatch(text, start - 1, start):
            start -= 1
        found = _DOMAIN.match(text, at + 1) if start < at else None
        if found:
            yield "email", start, found.end()
            done = found.end()
            at = text.find("@", done)
        else:
            done = at + 1
            at = text.find("@", done)


def base_spans(text: str | None) -> list[tuple[str, int, int]]:
    """(kind, start, end) of the base patterns, by start, then kind as listed."""
    if not text:
        return []
    out = list(_emails(text))
    if _DIGIT.search(text):
        out += [("ip", *m.span()) for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p[-3:] if len(p) > 3 else p) <= 255 for p in m[0].split("."))]
        for m in _CARD.finditer(text):
            if 12 <= len(digits := _NOT_DIGIT.sub("", m[0])) <= 19 and luhn(digits):
                out.append(("card", *m.span()))
        if "+" in text:
            out += [("phone", *m.span()) for m in _PHONE.finditer(text) if 9 <= len(_NOT_DIGIT.sub("", m[0])) <= 15]
    return sorted(out, key=lambda s: (s[1], ORDER[s[0]], s[2]))


_GENERATORS = {
    "secret": re.compile(r"(?:password|passwd|pwd|token|secret|api[_-]?key|access[_-]?key)[\"']?\x20?[=:]\x20?[\"']?(?P<v>[A-Za-z0-9_/+.~-]{5,})", re.I),
    "blob": re.compile(r"(?<![A-Za-z0-9])(?:[A-Z0-9]{12,}+|[0-9a-f]{16,}+)(?![A-Za-z0-9])"),
    "national_phone": re.compile(r"(?<![0-9A-Za-z])\(?[0-9]{2,5}\)?[ ./-][0-9]{3,4}[ .-]?[0-9]{3,4}(?![0-9A-Za-z])"),
    "national_id": re.compile(r"(?<![0-9-])[0-9]{3}[- ][0-9]{2}[- ][0-9]{4}(?![0-9-])"),
    "account": re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"),
    "spelled_email": re.compile(r"(?<![A-Za-z0-9._%+-])(?=(?P<v>[A-Za-z0-9._%+-]{1,64}(?: ?(?:\(dot\)|\[dot\]| dot ) ?[A-Za-z0-9_%+-]{1,64}){0,3} ?(?:\(at\)|\[at\]| at ) ?[A-Za-z0-9-]{1,63}(?: ?(?:\(dot\)|\[dot\]| dot |\.) ?[A-Za-z0-9-]{2,63}){1,4}))"),
}
_NEEDS_DIGIT = ("blob", "national_phone", "national_id", "account")
_CUES = (
    re.compile(r"password|passwd|pwd|token|secret|key|credential|login|auth", re.I),
    re.compile(r"call|phone|tel|fax|mobile|contact|dial", re.I),
    re.compile(r"ssn|social|identity|passport|id\b", re.I),
    re.compile(r"iban|account|bank|konto|transfer", re.I),
    re.compile(r"mail|write|reach|contact", re.I),
    re.compile(r"version|page|isbn|order|part|room|section|vol|model|figure|chapter|item|case|ticket|invoice|serial|sku|build", re.I),
    re.compile(r"commit|sha|md5|checksum|digest|revision|hash|etag|fingerprint|blob|tree|object", re.I),
)
_ENDINGS = frozenset("com org net edu gov io de fr es uk eu info".split())
_EMPTY = re.compile(r"(?:your|my|the|some|new|old|user)?[_-]?(?:required|optional|string|none|null|true|false|changeme|example|placeholder|password|token|secret|value|here|hidden|empty|unset|default|protected|reset|field|policy|manager)+", re.I)


def candidates(text: str) -> list[tuple[str, int, int]]:
    """Overlapping proposals of all generators, whatever their worth."""
    out, digit = [], bool(_DIGIT.search(text))
    for kind, pattern in _GENERATORS.items():
        if kind in _NEEDS_DIGIT and not digit or kind == "secret" and not ("=" in text or ":" in text):
            continue
        if kind == "spelled_email" and not ("(at)" in text or "[at]" in text or " dot " in text or "[dot]" in text or "(dot)" in text):
            continue
        out += [(kind, *(m.span("v") if "v" in pattern.groupindex else m.span())) for m in pattern.finditer(text)]
    return out


def _iban(s: str) -> bool:
    s = s.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def describe(text: str, kind: str, start: int, end: int) -> list[float]:
    """Format of the span and what stands around it."""
    s, before, after = text[start:end], text[max(0, start - 28) : start], text[end : end + 12]
    n = len(s)
    digits, upper, lower = (sum(map(f, s)) for f in (str.isdigit, str.isupper, str.islower))
    counts = np.array([s.count(c) for c in set(s)]) / n
    return [
        *[float(kind == k) for k in ADDED], n, digits, digits / n, upper / n, lower / n, len(set(s)) / n, float(-(counts * np.log2(counts)).sum()),
        sum(not c.isalnum() for c in s), sum(c in "0123456789abcdefABCDEF" for c in s) / n, float(bool(digits and (upper or lower))), len(re.findall(r"[0-9]+", s)), len(re.split(r"[^A-Za-z0-9]+", s)),
        float(s.startswith(("AKIA", "ASIA", "ghp_", "sk-", "xox"))), float(kind == "account" and _iban(s)), float("(at)" in s or "[at]" in s), float(" dot " in s or "dot)" in s or "dot]" in s),
        float(s[:1] == "("), float(s[:3] in ("000", "666") or s[:1] == "9"), *[float(bool(c.search(before))) for c in _CUES], float(before[-1:].isalnum()), float(after[:1].isalnum()), float(bool(_DIGIT.search(after))), float(bool(re.search(r"[=:]\x20?[\"']?$", before))),
        float(bool(re.search(r"=\x20?[\"']?$", before))), float(before[-1:] in " \"'"), float(n in (32, 40, 64)), float(_EMPTY.fullmatch(s) is not None), float(re.split(r"[^A-Za-z]+", s)[-1].lower() in _ENDINGS), float(bool(re.match(r" ?(?:at |\(at\)|\[at\]|dot |\(dot\)|\[dot\])", after))),
    ]


# Training examples


def _example(rng: random.Random, window: str) -> tuple[str, str, int, int, int]:
    """(text, kind, start, end, whether it is personal or secret): a form planted in a window."""
    letters = "abcdefghijklmnopqrstuvwxyz"
    hexes, alnum, upper = "0123456789abcdef", letters + letters.upper() + "0123456789", letters.upper() + "0123456789"

    def of(alphabet: str, a: int, b: int | None = None) -> str:
        return "".join(rng.choices(alphabet, k=rng.randint(a, b or a)))

    def word(a: int = 2, b: int = 9) -> str:
        return of(letters, a, b)

    def digits(k: int) -> str:
        return of("0123456789", k)

    one = rng.choice
    kind, sort = one(ADDED), one(("good", "good", "bad", "bad", "doubt"))
    good = rng.random() < DOUBTFUL[kind] if sort == "doubt" else sort == "good"
    lead = ""
    if kind == "secret":
        name, quote = one(["password", "passwd", "pwd", "token", "secret", "api_key", "access-key", "Password", "Token"]), one(["", '"'])
        if sort == "good":
            lead, s = name + one(["=", ": ", " = ", ":"]) + quote, one([of(hexes, 10, 64), of(alnum, 10, 40), of(hexes, 18), word(3, 8) + digits(rng.randint(2, 4))])
            if not any(c.isdigit() for c in s):
                s = s[:-2] + digits(2)
            if rng.random() < 0.25:
                lead, s = name + "=" + quote, word(5, 8) + word(4, 8) + word(3, 8)
        elif sort == "bad":
            lead, s = name + one(["=", ": ", ": ", " = "]) + quote, one([word(5, 9), word(5, 9) + "-" + word(3, 8), one(["required", "optional", "string", "your_password", "changeme", "reset", "policy", "hidden"]), digits(5)])
            if lead.endswith("=") and s.isalpha():
                s = one(["required", "optional", "string", "null", "true", "your_token", "placeholder"])
        else:
            lead, s = name + one([": ", " : "]), word(8, 14)
    elif kind == "blob":
        if sort == "good":
            prefixed = one(["AKIA", "ASIA"]) + of(upper, 16)
            lead, s = one([("", prefixed), (one(["key ", "access key ", "secret ", "credential ", "auth token "]), one([prefixed, of(hexes, 32, 64), of(upper, 20, 40)]))])
        elif sort == "bad":
            lead = one(["", "", "commit ", "sha256 ", "sha1:", "md5 ", "checksum ", "digest ", "revision ", "hash ", "object ", "serial ", "part "])
            s = one([of(hexes, 40), of(hexes, 64), of(hexes, 32), digits(rng.randint(12, 30)), word(12, 24).upper(), one(letters[:6]) * 20, "0" * rng.randint(16, 40), digits(8) + "ABCD", one(["DEADBEEF", "ABC123"]) * 3])
        else:
            s = one([of(upper, 20, 40), of(hexes, 24, 48)])
    elif kind == "national_phone":
        forms = [f"({digits(3)}) {digits(3)}-{digits(4)}", f"{digits(3)}-{digits(3)}-{digits(4)}", f"0{digits(3)} {digits(3)} {digits(4)}"]
        other = [f"{digits(4)}-{digits(3)}-{digits(3)}", f"{digits(2)}.{digits(3)}.{digits(3)}", f"{digits(3)} {digits(3)} {digits(3)}", f"19{digits(2)} 20{digits(2)} 20{digits(2)}"]
        s = one(forms) if sort != "bad" else one(forms + other * 2)
        lead = one(["call ", "phone: ", "tel ", "fax ", "contact ", "mobile "]) if sort == "good" else one(["order ", "part ", "version ", "isbn ", "page ", "ticket "]) if sort == "bad" else ""
        if sort == "bad" and s not in forms and rng.random() < 0.5:
            lead = ""
    elif kind == "national_id":
        form = f"{rng.randint(100, 665)}-{digits(2)}-{digits(4)}"
        s = form if sort != "bad" else one([form, f"{digits(3)} {digits(2)} {digits(4)}", f"000-{digits(2)}-{digits(4)}", f"9{digits(2)}-{digits(2)}-{digits(4)}"])
        lead = one(["ssn ", "social security ", "identity ", "id ", "passport ", "ssn: "]) if sort == "good" else one(["part ", "order ", "model ", "order id ", "item id ", "case id ", "invoice ", "serial "]) if sort == "bad" else ""
    elif kind == "account":
        body = of("0123456789", 12, 18) if rng.random() < 0.8 else of("ABCDEFGH0123456789", 12, 18)
        country = one(["DE", "FR", "ES", "GB", "NL"])
        check = 98 - int("".join(str(int(c, 36)) for c in body + country + "00")) % 97
        s = f"{country}{check if sort != 'bad' else (check + rng.randint(1, 80)) % 97 + 1:02d}{body}"
        if rng.random() < 0.4:
            s = " ".join(s[k : k + 4] for k in range(0, len(s), 4))
        lead = one(["iban ", "account ", "bank ", ""]) if sort == "good" else one(["model ", "part ", "", "serial "]) if sort == "bad" else one(["model ", "item "])
    else:
        at, dot = one([(" (at) ", " (dot) "), ("[at]", "[dot]"), (" at ", " dot "), ("(at)", ".")])
        name = word() + one(["", dot + word() if dot != "." else "." + word(), digits(2)])
        if sort == "good":
            s, lead = name + at + word(3, 9) + dot + one(["com", "org", "net", "de", "fr", "es"]), one(["mail ", "write to ", "reach me: ", ""])
        elif sort == "bad":
            s = one([word() + " at " + word(3, 9) + "." + word(3, 8), word(2, 4) + " at " + word() + dot + word(2, 3)])
            if dot in s and dot != "." and rng.random() < 0.7:  # cut short: the address goes on
                return _planted(window, rng, "", s, at + word(3, 9) + dot + "com", kind, 0)
        else:
            s = name + at + word(3, 9) + dot + word(2, 3)
    return _planted(window, rng, lead, s, one([" ", ".", ",", "\n", ";"]), kind, int(good))


def _planted(window: str, rng: random.Random, lead: str, s: str, tail: str, kind: str, good: int) -> tuple[str, str, int, int, int]:
    at = rng.randint(0, len(window))
    front = window[:at] + " " + lead
    return front + s + tail + " " + window[at:], kind, len(front), len(front) + len(s), good


@dataclass(frozen=True)
class SpanModel:
    trees: BoostedTrees
    thresholds: tuple[float, ...]  # by kind as in ADDED; over 1 if a kind can't reach the precision

    def select(self, texts: list[str], base: list[list[tuple[str, int, int]]]) -> list[list[tuple[str, int, int]]]:
        """Base spans and, by falling probability in hundredths, the candidates over their thresholds that
        overlap none already there (ties: leftmost, then longest, then kind as listed)."""
        found = [candidates(t) for t in texts]
        rows = [describe(t, *c) for t, cs in zip(texts, found) for c in cs]
        probs = iter(self.trees.probability(np.array(rows)).tolist() if rows else ())
        out = []
        for spans, cs in zip(base, found):
            taken, free = list(spans), _Free(spans)
            sure = [(-round(100 * p), a, -b, ADDED.index(kind)) for kind, a, b in cs if (p := next(probs)) >= self.thresholds[ADDED.index(kind)]]
            for _, a, b, kind in sorted(sure):
                if free.take(a, -b):
                    taken.append((ADDED[kind], a, -b))
            out.append(sorted(taken, key=lambda s: (s[1], ORDER[s[0]], s[2])))
        return out


class _Free:
    """What of a text no span has taken yet; taking one looks at its two neighbours only."""

    def __init__(self, spans: list[tuple[str, int, int]]):
        self.starts: list[int] = []
        self.ends: list[int] = []
        for _, a, b in sorted(spans, key=lambda s: s[1]):
            if self.ends and a < self.ends[-1]:
                self.ends[-1] = max(self.ends[-1], b)
            else:
                self.starts.append(a)
                self.ends.append(b)

    def take(self, a: int, b: int) -> bool:
        k = bisect_right(self.starts, a)
        if k and self.ends[k - 1] > a or k < len(self.starts) and self.starts[k] < b:
            return False
        self.starts.insert(k, a)
        self.ends.insert(k, b)
        return True


def contexts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", most: int = CONTEXTS) -> list[str]:
    """Windows of at most `most` texts, the least by a hash of the id; each begins at a hashed place. A
    bound on the hash, from the number of rows, leaves some four times as many to be ordered, so that
    tasks send the driver few rows however many tasks there are."""
    n = df.count()
    text, key = F.col(text_col).cast("string"), F.col(id_col).cast("string")
    place = F.pmod(F.xxhash64(key, F.lit(SEED)), F.greatest(F.char_length(text) - WINDOW, F.lit(1)))
    draw = F.xxhash64(key, F.lit("contexts"))
    share = min(1.0, 4 * most / max(n, 1))
    rows = df.where((F.pmod(draw, F.lit(1 << 30)) < int(share * (1 << 30))) & (F.char_length(text) > 0)).select(F.pmod(draw, F.lit(1 << 30)).alias("h"), F.substr(text, (place + 1).cast("int"), F.lit(WINDOW)).alias("w"))
    return [r["w"] for r in rows.orderBy("h", "w").limit(most).collect()]


def examples(windows: list[str], many: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Features and labels of `many` forms planted in the windows, one after another."""
    rng = random.Random(seed)
    made = [_example(rng, windows[k % len(windows)]) for k in range(many)]
    return np.array([describe(*e[:4]) for e in made]), np.array([e[4] for e in made], float)


def train(windows: list[str] | None = None, many: int = TRAINING, seed: int = SEED, precision: float = PRECISION) -> SpanModel:
    """Trees on half of the examples, calibration on a quarter, thresholds on the last quarter: for each
    kind the least threshold at which, and from the first on that reaches it above which, the lower
    bound of its precision is enough, raised half as far as hardly any true span is lost."""
    return _trained(tuple(windows or ("",)), many, seed, precision)


def surely(right: int, n: int, deviations: float = CONFIDENCE) -> float:
    """The lower end of Wilson's interval for a share of `right` in n."""
    p, z = right / n, deviations**2
    return float((p + z / (2 * n) - deviations * np.sqrt(p * (1 - p) / n + z / (4 * n * n))) / (1 + z / n))


@lru_cache(maxsize=4)
def _trained(windows: tuple[str, ...], many: int, seed: int, precision: float) -> SpanModel:
    parts = [list(windows[k::4]) or list(windows) for k in range(4)]
    fit, calibration, last = (examples(own, n, seed + k) for k, (own, n) in enumerate(((parts[0] + parts[1], many // 2), (parts[2], many // 4), (parts[3], many // 4))))
    trees = BoostedTrees().fit(*fit).calibrate(*calibration)
    p, (x, y) = trees.probability(last[0]), last
    thresholds = []
    for k in range(len(ADDED)):
        own = x[:, k] > 0
        least = 2.0
        for t in np.arange(0.98, 0.01, -0.02):
            sure = own & (p >= t)
            if sure.any() and surely(int(y[sure].sum()), int(sure.sum())) >= precision:
                least = float(t)
            elif least < 2:
                break
        if least < 2:
            # Between the forms that stay and those left out hardly any lie: the threshold goes midway.
            held = y[own & (p >= least)].sum()
            least = (least + max(float(t) for t in np.arange(0.98, 0.01, -0.02) if y[own & (p >= t)].sum() >= KEPT * held)) / 2
        thresholds.append(least)
    return SpanModel(trees, tuple(thresholds))


def _written(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def find(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: SpanModel | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """(id, *keep, n_email, n_ip, n_card, n_phone, base_sha256, spans, redacted) of every whole text.

    Counts and the digest are of base spans, `spans` has all (kind:start:end by code points), and
    `redacted` is the text with each span as [KIND]; of overlapping spans the union goes, under the
    kind that starts first. Null is as empty, and stays null in `redacted`. Rows stay rows, an empty
    table is empty, other columns are not read. Without a model one is trained on windows of df.
    """
    model = model or train(contexts(df, id_col, text_col))

    def work(slices) -> Iterator[dict]:
        for _, texts in slices:
            base = [base_spans(t) for t in texts]
            every = model.select([t or "" for t in texts], base)
            yield {f"n_{k}": [sum(s[0] == k for s in b) for b in base] for k in BASE} | {
                "base_sha256": [sha256(_written(b).encode()).hexdigest() for b in base],
                "spans": [_written(s) for s in every],
                "redacted": [redact(t, s) for t, s in zip(texts, every)],
            }

    return map_texts(df, id_col, text_col, ", ".join(f"n_{k} long" for k in BASE) + ", base_sha256 string, spans string, redacted string", work, keep)


def redact(text: str | None, spans: list[tuple[str, int, int]]) -> str | None:
    if not text or not spans:
        return text
    out, at = [], 0
    for kind, a, b in spans:
        if a >= at:
            out += [text[at:a], f"[{kind.upper()}]"]
        at = max(at, b)
    return "".join([*out, text[at:]])
