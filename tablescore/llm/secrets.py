"""Secret scans: fixed patterns, and the novelty of strings to a dictionary-primed zstandard.

The base spans of the three kinds follow fixed patterns and always stay. Besides, every run of
token characters that mixes letters and digits is a candidate if a word that announces a secret stands
within CUE characters on either side, or in the name to which the run is assigned. '=' is no such
character, except as padding at the end. Its novelty is the marginal number of compressed bytes that it costs: zstandard, primed
with a dictionary of identifiers, keywords and usual words, compresses the text around the candidate
with and without it. Names, paths and prose cost little; random strings cost most of their length.
A candidate is reported as kind `novel` if that is NOVELTY of what a random character of its alphabet holds, and if it
overlaps no base span; a long one if any piece of MOST characters is.

Null texts are empty. Offsets count code points, ends are exclusive. Texts are processed whole, in
time linear in their length. Rows that repeat are scanned one by one, an empty table gives an empty
one, and columns that scan() adds replace those of the same names.
"""

from __future__ import annotations

import functools
import hashlib
import math
import re
from bisect import bisect_left
from itertools import accumulate

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import with_columns

KINDS = ("assign", "access", "hex", "novel")
#: Code points on either side of a candidate that are compressed with it or hold its name, and between a cue and a candidate.
CONTEXT, CUE = 200, 48
#: The share of a random character's bits from which a candidate counts as incompressible.
NOVELTY = 0.9
#: Characters of the alphabets that are told apart: hexadecimal, letters of one case and digits, all letters and digits.
ALPHABETS = (16, 36, 62)
LEAST, MOST = 16, 512
#: A candidate has a piece of so many letters and digits; paths of short names have none.
PIECE = 12
PIECES = re.compile(r"[A-Za-z0-9]+")

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']? *[:=] *["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{24,}")
CANDIDATE = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{14,}(?:={1,2}(?![A-Za-z0-9+/_=-]))?")
NAME = re.compile(r"""([A-Za-z0-9_.-]+)["']?\s*[:=]\s*["']?\Z""")
CUES = re.compile(r"pass(?:word|wd|phrase)|secret|token|api.?key|credential|bearer|authorization|private|access.?key|client.?id", re.I | re.A)
WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")

#: Identifiers, keywords and words that the compressor knows beforehand.
DICTIONARY = (
    "abstract async await boolean break case catch class const continue default delete double else enum export extends false final finally float for from function "
    "global if implements import in instanceof int interface lambda let long namespace new none null object package pass private protected public raise return self "
    "short static string struct super switch template this throw throws true try type typedef undefined unsigned using var virtual void volatile while with yield "
    "access_key access_token account address admin api_key apiKey api_secret application args array attribute authorization auth_token base64 bearer body buffer bytes "
    "cache callback certificate char children client_id client_secret clientSecret code column command config configuration connection content context cookie count "
    "create credential credentials current data database date decode default_value delete_file description dict directory document element email encode endpoint "
    "environment error event example exception file filename format get_value getElementById handle hash header headers height host http https id identifier index "
    "initialize input instance item items key keys kwargs label language length level library line list load local localhost location log logger login main map master "
    "max message method min mode model module name network node number offset open option options order output page param parameter parameters parent parse path "
    "pattern payload permission pointer port position prefix print private_key process product property protocol public_key query queue read record reference "
    "refresh_token register remote remove repository request required reset response result root route row run save schema script search secret_key section select "
    "send server service session session_token set_value settings size source start state status stop store stream style suffix system table tag target task test "
    "text thread time timeout timestamp title token_type tokens total transaction tree update upload url user user_id userName username utils valid validate value "
    "values variable vector version view visible web widget width window worker workspace write 0123456789 abcdefghijklmnopqrstuvwxyz ABCDEFGHIJKLMNOPQRSTUVWXYZ "
    'password = "" passwd: secret = token = "" api_key = apikey: {"name": "value", "type": "string"} the and of to in is that for with as was on are by this be '
)

Span = tuple[int, int, str]


def base_spans(text: str) -> list[Span]:
    """Base spans by start, then kind in the order of KINDS."""
    out = []
    low = text.lower()
    if any(w in low for w in WORDS):
        out += [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if m.end() - m.start(2) >= 6]
    if "AKIA" in text:
        out += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    out += [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]
    return sorted(out, key=lambda s: (s[0], KINDS.index(s[2])))


@functools.cache
def compressor() -> zstandard.ZstdCompressor:
    # Names in camel case are made of words that begin with a capital.
    words = " ".join(w.capitalize() for w in DICTIONARY.split() if w.isalpha()) + " " + DICTIONARY
    data = zstandard.ZstdCompressionDict(words.encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    # Matches of three characters, so that short words of a name are found.
    how = zstandard.ZstdCompressionParameters.from_level(19, source_size=2 * CONTEXT + MOST, dict_size=len(words), min_match=3, write_content_size=False, write_checksum=False, write_dict_id=False)
    return zstandard.ZstdCompressor(dict_data=data, compression_params=how)


def novelty(text: str, start: int, end: int) -> float:
    """Marginal compressed bits for each character of text[start:end]: what it adds to the text around it."""
    before, own, after = text[max(0, start - CONTEXT) : start], text[start:end], text[end : end + CONTEXT]
    size = lambda s: len(compressor().compress(s.encode("utf-8", "surrogatepass")))
    return 8 * (size(before + own + after) - size(before + after)) / len(own)


def least_bits(s: str) -> float:
    """The novelty from which s counts, by the alphabet of its long pieces; longer runs are no names and count from the least."""
    if len(s) > MOST:
        return NOVELTY * math.log2(ALPHABETS[0])
    long = "".join(p for p in PIECES.findall(s) if len(p) >= PIECE)
    one_case = long in (long.lower(), long.upper())
    size = ALPHABETS[0] if not long.strip("0123456789abcdefABCDEF") else ALPHABETS[1 if one_case else 2]
    return NOVELTY * math.log2(size)


def mixed(s: str) -> bool:
    return any(c.isdigit() for c in s) and any(c.isalpha() for c in s) and max(map(len, PIECES.findall(s))) >= PIECE


def novel_spans(text: str, base: list[Span]) -> list[Span]:
    """Incompressible strings in a sensitive context that overlap no base span."""
    cues = [c.span() for c in CUES.finditer(text)]
    if not cues:
        return []
    cue_ends = [e for _, e in cues]
    starts, reach = [b for b, _, _ in base], list(accumulate((e for _, e, _ in base), max))
    out: list[Span] = []
    for m in CANDIDATE.finditer(text):
        start, end = m.span()
        # Pieces overlap by half, so that a secret is not split among pieces that each hold little of it.
        spans = [(a, min(end, a + MOST)) for a in range(start, max(start + 1, end - MOST // 2), MOST // 2)]
        spans = [(a, b) for a, b in spans if mixed(text[a:b])]
        if end - start < LEAST or not spans:
            continue
        k = bisect_left(cue_ends, start - CUE)
        if k == len(cues) or cues[k][0] > end + CUE:
            name = NAME.search(text[max(0, start - CONTEXT) : start])
            if not name or not CUES.search(name[1]):
                continue
        k, least = bisect_left(starts, end), least_bits(m.group())
        if not (k and reach[k - 1] > start) and any(novelty(text, a, b) >= least for a, b in spans):
            out.append((start, end, "novel"))
    return out


def joined(spans: list[Span]) -> str:
    return ",".join(f"{k}:{s}:{e}" for s, e, k in spans)


FOUND = T.StructType([*(T.StructField(f"n_{k}", T.LongType()) for k in KINDS), T.StructField("base_sha256", T.StringType()), T.StructField("spans", T.StringType())])


def scan(docs: DataFrame) -> DataFrame:
    """docs with n_assign, n_access, n_hex, n_novel, base_sha256 of the base spans, and spans, all of them; columns of these names are replaced."""

    def run(batch: pa.RecordBatch) -> dict:
        texts = [x or "" for x in batch.column("text").to_pylist()]
        base = [base_spans(x) for x in texts]
        every = [sorted(b + novel_spans(x, b), key=lambda s: (s[0], KINDS.index(s[2]))) for b, x in zip(base, texts, strict=True)]
        out = {f"n_{k}": pa.array([sum(s[2] == k for s in x) for x in every], pa.int64()) for k in KINDS}
        return out | {"base_sha256": pa.array([hashlib.sha256(joined(b).encode()).hexdigest() for b in base]), "spans": pa.array([joined(x) for x in every], pa.string())}

    return with_columns(docs, "text", FOUND, run)


def findings(docs: DataFrame) -> DataFrame:
    """(doc_id, kind, start, end, secret) of every span in docs (doc_id, text)."""
    s = scan(docs.select("doc_id", "text")).where(F.col("spans") != "").select("doc_id", "text", F.explode(F.split("spans", ",")).alias("s"))
    part = F.split("s", ":")
    s = s.select("doc_id", "text", part[0].alias("kind"), part[1].cast("long").alias("start"), part[2].cast("long").alias("end"))
    return s.select("doc_id", "kind", "start", "end", F.substring(F.col("text"), (F.col("start") + 1).cast("int"), (F.col("end") - F.col("start")).cast("int")).alias("secret"))
