"""Personal data: pattern matches with fixed rules, and candidates that boosted trees select.

The base spans of the four kinds follow fixed patterns and checks and always stay. High-recall
generators propose more spans, overlapping ones included: spelled-out addresses, numbers with
other separators, numbers without a country code, each possible end of a worded domain, cards and addresses beside words that announce
them. Gradient-boosted trees over features of their format and context score each; a threshold for each
kind, calibrated on rows that were not trained on, selects what is added. The training rows are
written by a seeded generator, so the model needs no corpus and is the same everywhere.

Null texts are empty. Offsets count code points, ends are exclusive. Texts are processed whole, in
time that is linear but for sorting. Of overlapping candidates the more probable one stays, of equal
ones the one proposed first. Rows that repeat are found one by one, an empty table gives an empty one,
and columns that find() adds replace those of the same names.
"""

from __future__ import annotations

import functools
import hashlib
import re
from bisect import bisect_left, insort
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .boosting import Boosted, least_threshold
from .common import replace_columns, with_columns

KINDS = ("email", "ip", "card", "phone")
SEED = 20_240_503
#: Written training rows, and the share of right spans that the thresholds are set for.
TRAINING_ROWS = 6_000
PRECISION = 0.99
#: Code points on either side that count as context.
CONTEXT = 32

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
DIGIT = re.compile(r"[0-9]")

Span = tuple[int, int, str]


def luhn(digits: str) -> bool:
    d = [int(x) for x in reversed(digits)]
    return (sum(d[0::2]) + sum(sum(divmod(2 * x, 10)) for x in d[1::2])) % 10 == 0


def digits_of(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def emails(text: str) -> list[Span]:
    """Each @ belongs to one match at most: the run of local characters before it, as far as it is free, and a domain."""
    out, free = [], 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in LOCAL:
            start -= 1
        m = DOMAIN.match(text, at + 1) if start < at else None
        if m:
            out.append((start, m.end(), "email"))
            free = m.end()
        else:
            free = max(free, at + 1)
        at = text.find("@", free)
    return out


def base_spans(text: str) -> list[Span]:
    """Base spans by start, then kind in the order of KINDS."""
    out = emails(text)
    if DIGIT.search(text):
        for m in IP.finditer(text):
            if all(len(x.lstrip("0")) <= 3 and int(x.lstrip("0") or 0) <= 255 for x in m.group().split(".")):
                out.append((m.start(), m.end(), "ip"))
        for m in CARD.finditer(text):
            d = digits_of(m.group())
            if 14 <= len(d) <= 19 and luhn(d):
                out.append((m.start(), m.end(), "card"))
        if "+" in text:
            for m in PHONE.finditer(text):
                if 10 <= len(digits_of(m.group())) <= 15:
                    out.append((m.start(), m.end(), "phone"))
    return sorted(out, key=lambda s: (s[0], KINDS.index(s[2])))


#: Fixed patterns of the candidate generators.
WORDED_EMAIL = re.compile(r"\b[A-Za-z0-9][A-Za-z0-9._%+-]{0,63} ?(?P<at>\(at\)|\[at\]|\{at\}| at ) ?[A-Za-z0-9-]{1,63}(?: ?(?:\(dot\)|\[dot\]|\{dot\}| dot |\.) ?[A-Za-z0-9-]{2,63}){1,3}", re.A)
NUMBER = re.compile(r"(?<![0-9A-Za-z])[(+]?[0-9](?:[ ().\-/]{0,2}[0-9]){6,18}(?![0-9A-Za-z])")
SPACED_IP = re.compile(r"(?<![0-9.])[0-9]{1,3} ?[.,] ?[0-9]{1,3} ?[.,] ?[0-9]{1,3} ?[.,] ?[0-9]{1,3}(?![0-9]|[.,][0-9])")
#: Fixed value: what often ends a domain, countries aside, which have two letters.
TOP = frozenset("com org net edu gov mil int info biz name app dev xyz online site shop cloud".split())
#: A separator in a worded domain.
DOT = re.compile(r" ?(?:\(dot\)|\[dot\]|\{dot\}| dot |\.) ?", re.A)

#: Words that announce a kind, in lower case.
CUES = {
    "email": ("mail", "contact", "write", "reach", "address"),
    "ip": ("ip", "host", "server", "address", "addr", "login", "from"),
    "card": ("card", "visa", "master", "amex", "credit", "payment", "debit"),
    "phone": ("phone", "tel", "call", "mobile", "cell", "fax", "whatsapp", "contact", "ring"),
}
#: Words that announce another kind of number.
OTHERS = ("version", "isbn", "order", "invoice", "id", "page", "section", "date", "price", "total", "serial", "number", "ref", "build")


def candidates(text: str) -> list[Span]:
    """All proposals of the generators; they may overlap each other and base spans."""
    out = []
    if "at" in text and (" at " in text or "(at)" in text or "[at]" in text or "{at}" in text):
        for m in WORDED_EMAIL.finditer(text):
            # An address may end at each part of its domain; what follows can be a new sentence.
            ends = [d.start() for d in DOT.finditer(text, m.end("at"), m.end())][1:]
            out += [(m.start(), e, "email") for e in (*ends, m.end())]
    if DIGIT.search(text):
        for m in NUMBER.finditer(text):
            n = len(digits_of(m.group()))
            if 7 <= n <= 15:
                out.append((m.start(), m.end(), "phone"))
            if 13 <= n <= 19:
                out.append((m.start(), m.end(), "card"))
        out += [(m.start(), m.end(), "ip") for m in SPACED_IP.finditer(text)]
    return out


def features(text: str, span: Span) -> list[float]:
    start, end, kind = span
    s, d = text[start:end], digits_of(text[start:end])
    before, after = text[max(0, start - CONTEXT) : start].lower(), text[end : end + CONTEXT].lower()
    groups = re.findall(r"[0-9]+", s)
    sizes = [len(g) for g in groups] or [0]
    near = re.split(r"[^a-z]+", before)
    cue = [any(w.startswith(c) for w in near for c in CUES[k]) for k in KINDS]
    last = re.split(r"[^A-Za-z0-9-]+", s.rstrip(")]}"))[-1].lower()
    return [
        *(kind == k for k in KINDS),
        len(s), len(d), len(groups), max(sizes), min(sizes), sizes[0], sizes[-1],
        *(s.count(c) for c in " -./("), s.startswith("+"), len({c for c in s if c in " -./,"}),
        "dot" in s, "(" in s or "[" in s or "{" in s, luhn(d) if d else 0,
        all(int(g[-4:]) <= 255 and len(g) <= 3 for g in groups) if groups else 0,
        *cue, any(w.startswith(o) for w in near for o in OTHERS),
        before[-1:].isalnum(), after[:1].isalnum(), ":" in before[-3:], len(set(d)),
        sizes == [3, 3, 4] or sizes == [3, 4] or sizes == [1, 3, 3, 4], sizes in ([4, 4, 4, 4], [4, 6, 5]),
        last in TOP or (len(last) == 2 and last.isalpha()), len(last), len(re.split(r"\W+", s)), bool(re.search(r"[A-Za-z]\. ", s)), s[len(s) - len(last) :][:1].isupper(),
    ]


def training_rows(n: int = TRAINING_ROWS) -> tuple[list[tuple[str, Span]], np.ndarray]:
    """Candidates in written sentences, with whether they are personal data."""
    r = np.random.default_rng(SEED)
    pick = lambda *x: x[int(r.integers(len(x)))]
    num = lambda k: "".join(str(int(c)) for c in r.integers(0, 10, k))
    word = lambda: "".join(pick(*"aeiou") if i % 2 else pick(*"bcdfglmnprst") for i in range(int(r.integers(3, 9))))

    def carded(valid: bool) -> str:
        d = pick("4", "51", "37", "6011", "35")
        d += num((14 if d == "37" else 15) - len(d))
        d += next(c for c in "0123456789" if luhn(d + c) == valid)
        parts = [d[:4], d[4:10], d[10:]] if len(d) == 15 and r.integers(2) else [d[i : i + 4] for i in range(0, len(d), 4)]
        return pick("", "-", " ", ".", "/", "  ").join(parts)

    def sample() -> tuple[str, str, bool]:
        """Words before, the span, whether it is right."""
        what = int(r.integers(10))
        if what == 0:
            local = pick(word(), f"{word()}.{word()}", f"{word()}{pick('_', '-')}{word()}", f"{word()}{num(2)}", f"{word()[0]}.{word()}")
            at, dot = pick((" (at) ", " (dot) "), ("(at)", "(dot)"), (" [at] ", " [dot] "), ("[at]", "."), ("(at)", "."), (" (at) ", "."), ("{at}", "{dot}"), (" at ", " dot "), (" at ", " dot "))
            return pick("write to ", "mail ", "contact: ", "", word() + " "), f"{local}{at}{word()}{pick('', '', '-' + word())}{dot}{pick('com', 'org', 'net', 'de', 'fr', 'es', 'io', 'info')}", True
        if what == 1:
            return pick("we met ", "look ", "", word() + " "), f"{word()} at {word()}{pick('. ', '. ', '.', ' dot ')}{pick(word(), word().capitalize(), pick('it', 'he', 'in', 'we', 'It', 'He', 'In', 'We', 'Le', 'Der'))}", False
        if what == 2:
            sep = pick("-", ".", " ")
            return pick("call ", "phone: ", "tel. ", "mobile ", "fax: ", "call this number: ", "phone number "), pick(f"({num(3)}) {num(3)}-{num(4)}", sep.join((num(3), num(3), num(4))), sep.join(("0" + num(2), num(4), num(4))), f"0{num(9)}"), True
        if what == 3:
            return pick("", "", "number ", "the number is "), pick(f"({num(3)}) {num(3)}-{num(4)}", f"1-{num(3)}-{num(3)}-{num(4)}"), True
        if what == 4:
            return pick("order ", "invoice ", "id ", "isbn ", "ref: ", "serial ", "", "", word() + " "), pick(num(8), num(10), num(12), num(14), f"{num(4)}-{num(2)}-{num(2)}", f"{num(3)}-{num(1)}-{num(5)}-{num(3)}-{num(1)}", f"{num(5)}/{num(6)}", f"{num(4)}.{num(5)}"), False
        if what == 5:
            return pick("card ", "visa: ", "credit card: ", "payment by card ", "card number "), carded(bool(r.integers(4))), True
        if what == 6:
            return pick("", "", "order ", "serial ", "id ", word() + " "), pick(num(16), num(15), num(18), carded(False)), False
        if what == 7:
            return pick("host ", "ip: ", "server ", "login from "), pick(", ", ". ", " . ", ",").join(str(int(x)) for x in r.integers(0, 256, 4)), True
        if what == 8:
            return pick("version ", "section ", "build ", ""), pick(".", ". ", ", ").join(str(int(x)) for x in r.integers(0, 999, 4)), False
        return pick("", "total ", "price "), pick(", ".join(str(int(x)) for x in r.integers(0, 99, 4)), f"{num(3)} {num(3)} {num(3)}", f"{num(1)} {num(3)} {num(3)}.{num(2)}"), False

    rows, right = [], []
    while len(rows) < n:
        cue, s, good = sample()
        head, tail = " ".join(word() for _ in range(int(r.integers(0, 4)))), " ".join(word() for _ in range(int(r.integers(0, 4))))
        text = f"{head} {cue}{s}{pick('', '', '.', ',')} {tail}"
        start = len(head) + 1 + len(cue)
        for c in candidates(text):
            if c[0] < start + len(s) and c[1] > start:
                exact = abs(c[0] - start) <= 1 and abs(c[1] - start - len(s)) <= 1
                kind = "email" if re.search("[a-z]{2}", s) else "card" if len(digits_of(s)) >= 15 else "ip" if re.search("[.,] ?[0-9]+ ?[.,] ?[0-9]+ ?[.,]", s) else "phone"
                rows.append((text, c))
                right.append(good and exact and kind == c[2])
    return rows, np.array(right, dtype=float)


@functools.cache
def model() -> tuple[Boosted, dict[str, float]]:
    rows, y = training_rows()
    x = np.array([features(*r) for r in rows], dtype=float)
    third = np.arange(len(y)) % 3
    b = Boosted().fit(x[third == 0], y[third == 0]).calibrate(x[third == 1], y[third == 1])
    held, kinds = third == 2, np.array([r[1][2] for r in rows])
    p = b.probability(x)
    return b, {k: max(0.5, least_threshold(p[held & (kinds == k)], y[held & (kinds == k)], PRECISION)) for k in KINDS}


def added_spans(texts: list[str], base: list[list[Span]], fitted: tuple[Boosted, dict[str, float]] | None = None) -> list[list[Span]]:
    """The selected candidates of each text that overlap neither a base span nor a better candidate, by a model(), which is fitted if not given."""
    rows, at = [], []
    for i, t in enumerate(texts):
        starts, reach = [s for s, _, _ in base[i]], list(accumulate((e for _, e, _ in base[i]), max))
        for c in candidates(t):
            k = bisect_left(starts, c[1])
            if not (k and reach[k - 1] > c[0]):
                rows.append(c)
                at.append(i)
    out: list[list[Span]] = [[] for _ in texts]
    if not rows:
        return out
    trees, least = fitted or model()
    p = trees.probability(np.array([features(texts[i], c) for i, c in zip(at, rows, strict=True)], dtype=float))
    for k in np.argsort(-p, kind="stable").tolist():
        c, own = rows[k], out[at[k]]
        # own is in order and free of overlaps, so that its last span before the end of c tells.
        if p[k] >= least[c[2]] and not ((j := bisect_left(own, (c[1],))) and own[j - 1][1] > c[0]):
            insort(own, c)
    return out


def joined(spans: list[Span]) -> str:
    return ",".join(f"{k}:{s}:{e}" for s, e, k in spans)


FOUND = T.StructType([*(T.StructField(f"n_{k}", T.LongType()) for k in KINDS), T.StructField("base_sha256", T.StringType()), T.StructField("spans", T.StringType())])


def find(docs: DataFrame) -> DataFrame:
    """docs with n_email, n_ip, n_card, n_phone and base_sha256 of the base spans, and spans, all of them; columns of these names are replaced."""
    fitted = docs.sparkSession.sparkContext.broadcast(model())

    def run(batch: pa.RecordBatch) -> dict:
        texts = [x or "" for x in batch.column("text").to_pylist()]
        base = [base_spans(x) for x in texts]
        every = [sorted(b + a, key=lambda s: (s[0], KINDS.index(s[2]))) for b, a in zip(base, added_spans(texts, base, fitted.value), strict=True)]
        out = {f"n_{k}": pa.array([sum(s[2] == k for s in b) for b in base], pa.int64()) for k in KINDS}
        return out | {"base_sha256": pa.array([hashlib.sha256(joined(b).encode()).hexdigest() for b in base]), "spans": pa.array([joined(x) for x in every], pa.string())}

    return with_columns(docs, "text", FOUND, run)


def redacted(text: str, spans: list[Span]) -> str:
    """text with each run of overlapping spans replaced by its first kind in angle brackets."""
    out, done = [], 0
    for start, end, kind in sorted(spans, key=lambda s: (s[0], KINDS.index(s[2]))):
        if start >= done:
            out += [text[done:start], f"<{kind.upper()}>"]
        done = max(done, end)
    return "".join([*out, text[done:]])


def redact(docs: DataFrame) -> DataFrame:
    """docs with all spans in text replaced; null stays null, and n_chars, where there is one, follows a changed text."""
    fitted = docs.sparkSession.sparkContext.broadcast(model())

    def run(batch: pa.RecordBatch) -> dict:
        raw = batch.column("text").to_pylist()
        texts = [x or "" for x in raw]
        base = [base_spans(x) for x in texts]
        clean = [None if x is None else redacted(x, b + a) for x, b, a in zip(raw, base, added_spans(texts, base, fitted.value), strict=True)]
        out = {"text": pa.array(clean, batch.column("text").type)}
        if "n_chars" in batch.schema.names:
            n = batch.column("n_chars")
            out["n_chars"] = pa.array([k if x == c else len(c) for k, x, c in zip(n.to_pylist(), raw, clean, strict=True)], n.type)
        return out

    return replace_columns(docs, "text", run)
