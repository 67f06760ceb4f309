"""Secret scan: fixed patterns and a randomness test battery (operator 10).

Patterns find assignments, access ids and long hexadecimal runs. The battery
looks at every other run of ``MIN_RUN`` or more token characters: it infers
the encoding whose alphabet holds the run, and tests the run against uniform
random draws from that alphabet by a chi-squared test of the alphabet's
letters, a runs test about the alphabet's middle and a test of the lag-one
serial correlation, joined by Fisher's rule to one p-value. A run that fails
(below ``ODD``) is not random. What a pattern leaves of a run, on either side
of its span, is a run too. ``+/`` and ``-_`` may belong to a key or join it to
words, so besides the whole run its parts between ``+/``, between ``-_`` and
between all four are tested, those of ``MIN_RUN`` and more.

Short names pass such tests too, so passing is not enough. The null hypothesis
of the report is that a run is an ordinary name. What ordinary names look like
is learnt from the corpus itself: over all tokens shorter than ``MIN_RUN``, how
lower case, capitals, digits and joints follow each other, and which letter
follows which (fixed-size counts over all documents). Under a model P of names
and the uniform model U of the encoding, P(x) / U(x) is a p-value for a random
x, as U / P has mean one under P; names in capitals throughout are in the model
as well. Runs are sorted into strata by encoding and doubling length, and within
each the Benjamini-Hochberg rule at level ``LEVEL`` says which are no ordinary
names; so at most that share of what is reported in any stratum, long or
short, is one. The rule needs only how many p-values fall into each of 64
bins of a stratum. On 2,000 made-up identifiers none, on random keys of 20 and
more characters over 0.95 are reported (tests state the bounds).

Spans are in code points of the whole text, end exclusive. A random span
never overlaps a pattern's span, nor another: of those that do, the longest
(then the first) is reported.

Defined results: null and empty texts have no spans; very long texts are read
whole; repeated rows are scanned alike; null ids are kept; extra columns are
not read; an empty table gives an empty result.
"""

from __future__ import annotations

import bisect
import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from furlong.llm import bytesops as B
from furlong.llm.common import pick, read_table, store

KINDS = ("assign", "access", "hex", "random")
KEYWORDS = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")
ASSIGN = re.compile(rb"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.IGNORECASE)
ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
HEX = re.compile(rb"[0-9a-f]{24,}")  # the greedy runs of 24 and more
MIN_VALUE, MIN_ACCESS = 6, 20
MIN_RUN = 20
LEVEL = 0.01
ODD = 1e-3
MIXED = 0.2  # of each step of a name that need not follow the corpus: humps, digits, foreign letters
BINS = 64
TOKEN = B.byte_class((0x30, 0x39), (0x41, 0x5A), (0x61, 0x7A), (0x2B, 0x2B), (0x2F, 0x2F), (0x2D, 0x2D), (0x5F, 0x5F))
JOINTS = (re.compile(rb"[^+/]+"), re.compile(rb"[^_-]+"), re.compile(rb"[^+/_-]+"))
DIGITS, UPPER, LOWERS = b"0123456789", bytes(range(65, 91)), bytes(range(97, 123))
#: Encodings from the narrowest alphabet to the widest.
ENCODINGS = (
    ("hex", DIGITS + b"abcdef"),
    ("hex_upper", DIGITS + b"ABCDEF"),
    ("base32", UPPER + b"234567"),
    ("alnum", DIGITS + UPPER + LOWERS),
    ("base64", UPPER + LOWERS + DIGITS + b"+/"),
    ("base64url", UPPER + LOWERS + DIGITS + b"-_"),
)


def _tables() -> list[np.ndarray]:
    out = []
    for _, alphabet in ENCODINGS:
        value = np.full(256, -1, np.int16)
        value[np.frombuffer(alphabet, np.uint8)] = np.arange(len(alphabet))
        out.append(value)
    return out


TABLES = _tables()
#: Kind of a byte (lower, capital, digit, joint, start) and its letter, without case.
KIND, LETTER = np.full(256, 3, np.int64), np.zeros(256, np.int64)
KIND[97:123], KIND[65:91], KIND[48:58] = 0, 1, 2
LETTER[97:123] = LETTER[65:91] = np.arange(26)
STARTS, NO_LETTER = 4, 26


def normal_tail(z: float) -> float:
    """Two-sided tail of the normal distribution."""
    return math.erfc(abs(z) / math.sqrt(2))


def chi2_tail(x: float, df: int) -> float:
    """Upper tail of the chi-squared distribution, by Wilson and Hilferty."""
    if x <= 0:
        return 1.0
    z = ((x / df) ** (1 / 3) - (1 - 2 / (9 * df))) / math.sqrt(2 / (9 * df))
    return 0.5 * math.erfc(z / math.sqrt(2))


def battery(run: bytes) -> tuple[int, float] | None:
    """(encoding, p-value that a uniform random string of it looks this odd); None where no alphabet holds the run."""
    raw = np.frombuffer(run, np.uint8)
    for which, value in enumerate(TABLES):
        v = value[raw]
        if v.min() < 0:
            continue
        n, size = len(v), len(ENCODINGS[which][1])
        seen = np.bincount(v, minlength=size)
        # mean size - 1 and variance 2 (size - 1) (1 - 1/n): scaled to a chi-squared of the same moments
        keep = 1 - 1 / n
        x = float((seen * seen).sum()) * size / n - n
        p_chi = chi2_tail(x / keep, (size - 1) / keep)
        high = v >= size // 2
        share_high = 1 - (size // 2) / size
        change = 2 * share_high * (1 - share_high)
        runs = 1 + int(np.count_nonzero(high[1:] != high[:-1]))
        p_runs = normal_tail((runs - 1 - (n - 1) * change) / math.sqrt((n - 1) * change * (1 - change)))
        u = (v - (size - 1) / 2) / math.sqrt((size * size - 1) / 12)
        p_serial = normal_tail(float((u[1:] * u[:-1]).sum()) / math.sqrt(n - 1))
        x = -sum(math.log(max(p, 1e-300)) for p in (p_chi, p_runs, p_serial))
        return which, math.exp(-x) * (1 + x + x * x / 2)  # Fisher, 6 degrees of freedom
    return None


class Names:
    """What ordinary names look like: bits of each step between kinds of
    characters and between letters."""

    def __init__(self, kinds: np.ndarray, letters: np.ndarray) -> None:
        kinds, letters = kinds + 1.0, letters + 0.5
        self.kind = -np.log2((1 - MIXED) * kinds / kinds.sum(axis=1, keepdims=True) + MIXED / 4)
        self.letter = -np.log2((1 - MIXED) * letters / letters.sum(axis=1, keepdims=True) + MIXED / 26)

    def _bits(self, raw: np.ndarray) -> float:
        kind, letter = KIND[raw], LETTER[raw]
        is_letter = kind < 2
        before = np.concatenate([[STARTS], kind[:-1]])
        from_letter = np.concatenate([[NO_LETTER], np.where(is_letter, letter, NO_LETTER)[:-1]])
        own = np.where(kind == 2, math.log2(10), 2.0)   # a digit, or one of four joints
        own[is_letter] = self.letter[from_letter[is_letter], letter[is_letter]]
        return float((self.kind[before, kind] + own).sum())

    def bits(self, run: bytes) -> float:
        """-log2 of the probability of a run as a name, written as it is or all in capitals."""
        raw = np.frombuffer(run, np.uint8)
        as_is = self._bits(raw) + 1
        if (KIND[raw] == 0).any():
            return as_is
        return min(as_is, self._bits(np.frombuffer(run.lower(), np.uint8)) + 6)


def _steps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of steps between kinds (5 x 4) and between letters (27 x 26) in
    the tokens of a task that are too short to be tested."""
    kinds, letters = np.zeros(5 * 4, np.int64), np.zeros(27 * 26, np.int64)
    for batch in batches:
        for _, _, data, offs in B.slices(batch.column("text")):
            starts, ends, _ = B.words(data, offs, TOKEN)
            short = (ends - starts >= 2) & (ends - starts < MIN_RUN)
            starts, ends = starts[short], ends[short]
            inside = np.zeros(len(data) + 1, np.int64)
            inside[starts] += 1
            inside[ends] -= 1
            at = np.flatnonzero(np.cumsum(inside[:-1]) > 0)
            if not len(at):
                continue
            first = np.zeros(len(data), bool)
            first[starts] = True
            kind, is_first = KIND[data[at]], first[at]
            letter = np.where(kind < 2, LETTER[data[at]], NO_LETTER)
            before = np.where(is_first, STARTS, np.concatenate([[STARTS], kind[:-1]]))
            kinds += np.bincount(before * 4 + kind, minlength=20)
            from_letter = np.where(is_first, NO_LETTER, np.concatenate([[NO_LETTER], letter[:-1]]))
            to = letter < NO_LETTER
            letters += np.bincount(from_letter[to] * 26 + letter[to], minlength=27 * 26)
    flat = np.concatenate([kinds, letters])
    yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(flat)), pa.int32()), pa.array(flat)], names=["cell", "n"])


def learn_names(texts: DataFrame) -> Names:
    """From column ``text`` of all documents; 722 counts reach the driver."""
    flat = np.zeros(20 + 27 * 26, np.int64)
    for r in texts.select("text").mapInArrow(_steps, "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect():
        flat[r.cell] = r.n
    return Names(flat[:20].reshape(5, 4), flat[20:].reshape(27, 26))


def name_bits(run: bytes, names: Names) -> tuple[int, float] | None:
    """(encoding, -log2 of the p-value that the run is an ordinary name); no
    bits for a run that is not random, None where no alphabet holds it."""
    got = battery(run)
    if got is None:
        return None
    uniform = len(run) * math.log2(len(ENCODINGS[got[0]][1]))
    return got[0], max(0.0, names.bits(run) - uniform) if got[1] >= ODD else 0.0


def runs_to_test(text: bytes, s: int, e: int, taken: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Of a token, what the ``taken`` spans (in order) leave and the parts of that."""
    rest = []
    for x, y in taken:
        if x < e and s < y:
            rest.append((s, x))
            s = max(s, y)
    out: dict[tuple[int, int], None] = {}
    for a, b in [*rest, (s, e)]:
        if b - a >= MIN_RUN:
            out[a, b] = None
            for joint in JOINTS:
                out.update(((m.start(), m.end()), None) for m in joint.finditer(text, a, b) if m.end() - m.start() >= MIN_RUN)
    return list(out)


def _scan(names: Names):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _scanned(batches, names)
    return run


def _scanned(batches: Iterator[pa.RecordBatch], names: Names) -> Iterator[pa.RecordBatch]:
    span = pa.struct([("start", pa.int64()), ("kind", pa.int32()), ("end", pa.int64())])
    test = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("stratum", pa.int32()), ("bin", pa.int32())])
    for batch in batches:
        bases, tests = [], []
        for _, _, data, offs in B.slices(batch.column("text")):
            starts, ends, first = B.words(data, offs, TOKEN)
            long = np.flatnonzero(ends - starts >= MIN_RUN)
            cut = np.searchsorted(long, first)
            for r, (a, b) in enumerate(zip(offs[:-1].tolist(), offs[1:].tolist(), strict=True)):
                text = data[a:b].tobytes()
                found = []
                low = text.lower()
                if any(k in low for k in KEYWORDS):
                    found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= MIN_VALUE]
                if b"AKIA" in text:
                    found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= MIN_ACCESS]
                tokens = [(int(starts[k] - a), int(ends[k] - a)) for k in long[cut[r] : cut[r + 1]]]
                for s, e in tokens:  # a hexadecimal run of 24 lies in a long token
                    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text, s, e)]
                found.sort()
                tried = []
                taken = [(x, y) for x, _, y in found]
                for token in tokens:
                    for s, e in runs_to_test(text, *token, taken):
                        if (got := name_bits(text[s:e], names)) is not None:
                            tried.append((s, e, got[0] * 64 + (e - s).bit_length(), min(BINS - 1, int(got[1]))))
                if found or tried:
                    raw = data[a:b]
                    point = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])  # of a byte: characters before it
                    found = [(int(point[s]), k, int(point[e])) for s, k, e in found]
                    tried = [(int(point[s]), int(point[e]), w, p) for s, e, w, p in tried]
                bases.append([dict(zip(("start", "kind", "end"), x, strict=True)) for x in found])
                tests.append([dict(zip(("start", "end", "stratum", "bin"), x, strict=True)) for x in tried])
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(bases, pa.list_(span)), pa.array(tests, pa.list_(test))], names=["doc_id", "base", "tests"])


def discovered(counts: dict[int, np.ndarray], level: float = LEVEL) -> dict[int, int]:
    """By stratum, the first bin (of -log2 p) whose p-values the step-up rule rejects."""
    out = {}
    for stratum, n in counts.items():
        m, above = n.sum(), np.cumsum(n[::-1])[::-1]
        ok = [k for k in range(BINS) if above[k] and 2.0**-k <= level * above[k] / m]
        out[stratum] = min(ok, default=BINS)
    return out


def apart(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Of spans, the longest, then the first, that overlap none kept before."""
    kept: list[tuple[int, int]] = []
    for s, e in sorted(set(spans), key=lambda x: (x[0] - x[1], x[0])):
        k = bisect.bisect(kept, (s, e))
        if (not k or kept[k - 1][1] <= s) and (k == len(kept) or e <= kept[k][0]):
            kept.insert(k, (s, e))
    return kept


def scan(docs: DataFrame, level: float = LEVEL) -> DataFrame:
    """doc_id, base and spans: arrays of (start, kind as a place in KINDS, end) in order."""
    d = pick(docs, doc_id="doc_id", text="text")
    kind = d.schema["doc_id"].dataType.simpleString()
    span = "array<struct<start:long,kind:int,end:long>>"
    found = store(d.mapInArrow(_scan(learn_names(d)), f"doc_id {kind}, base {span}, tests array<struct<start:long,end:long,stratum:int,bin:int>>"), "secret-runs")
    bins = found.select(F.inline("tests")).groupBy("stratum", "bin").agg(F.count(F.lit(1)).alias("n")).collect()  # strata x 64 at most
    counts: dict[int, np.ndarray] = {}
    for r in bins:
        counts.setdefault(r.stratum, np.zeros(BINS, np.int64))[r.bin] = r.n
    limit = discovered(counts, level)

    def report(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans = []
            for base, tests in zip(batch.column("base").to_pylist(), batch.column("tests").to_pylist(), strict=True):
                more = apart([(t["start"], t["end"]) for t in tests if t["bin"] >= limit[t["stratum"]]])
                rows = [(x["start"], x["kind"], x["end"]) for x in base] + [(s, KINDS.index("random"), e) for s, e in more]
                spans.append([dict(zip(("start", "kind", "end"), x, strict=True)) for x in sorted(rows)])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("base"), pa.array(spans, batch.column("base").type)], names=["doc_id", "base", "spans"])

    return found.mapInArrow(report, f"doc_id {kind}, base {span}, spans {span}")


def _written(spans: str):
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", names[s["kind"]], s["start"].cast("string"), s["end"].cast("string"))), ",")


def q_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == KINDS.index(k))).cast("long").alias(f"n_{k}")
    found = scan(read_table(spark, sf_dir, "documents"))
    return found.select("doc_id", count("assign"), count("access"), count("hex"), F.sha2(_written("base"), 256).alias("base_sha256"), _written("spans").alias("spans"))
