"""Personal data: base patterns, and further spans found by boosted trees over generated candidates.

Base spans follow fixed rules (e-mail, IP address, card number with Luhn digit, phone
number) and always stay. Generators then propose many overlapping spans: every run of
neighbouring digit groups of up to 19 digits with the signs between them, and every word with
an ``@`` or a written-out one. Each candidate is described by its format and its
surroundings; one set of boosted trees per kind says how likely it is personal data.
They learn from all texts, without labels: candidates equal to a base span are
positive, all others negative, except those that meet a match that failed its check
and are no parts of a base span, since these are what the trees are for (a phone number next to a card number
fails as one match). Equal candidates are counted first; the trees are fitted on the
distinct ones with their counts as weights, of a kind with very many on a weighted
sample. The threshold of a kind is the least one whose precision on all candidates of
a third of the texts, held out from the fit, reaches ``PRECISION``. Chosen candidates
that do not overlap base spans, best first, are added. ``PRIOR_TEXTS`` made-up texts with
the usual writings of all kinds are always among the texts learned from, so that trees
decide in a table of any size.

Defined results: null and empty texts have no spans. For a kind without such a threshold
nothing is added. Candidates that are equally likely are taken in the order of their
borders, then kinds. Texts are read whole. Repeated rows and extra columns pass
through; an empty table gives an empty table. Borders are code points, end exclusive.
"""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from jobweave.llm.arrow import add_columns, free_name, slices
from jobweave.llm.trees import Boosted, boost
from jobweave.session import stage

KINDS = ("email", "ip", "card", "phone")
#: Formats of one kind that the driver fits on.
FIT_FORMATS = 20_000
#: One in so many texts is held out.
HELD_OUT = 3
STEPS = 4096
#: Digits of the longest kind, a card number.
MOST_DIGITS = 19
#: Made-up texts that the trees learn from beside the given ones.
PRIOR_TEXTS = 3000
PRECISION = 0.995

DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL_END = re.compile(r"[A-Za-z0-9._%+-]+\Z")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# A match can only begin where a run of digits begins; saying so keeps long runs linear.
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGITS = re.compile(r"[0-9]+")
#: Signs that may stand between the digit groups of one candidate.
BETWEEN = re.compile(r"[\x20().\-/]{1,3}\Z")
WORDY = re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++\s?(?:\[at\]|\(at\))\s?[A-Za-z0-9.-]++", re.I)
SOME = re.compile(r"[0-9@]|\(at\)|\[at\]", re.I)
Span = tuple[str, int, int]


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        v = int(d) * (1 + k % 2)
        total += v - 9 * (v > 9)
    return total % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost matches around each ``@``: the local part is the run of its characters before it."""
    out, free, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in LOCAL:
            start -= 1
        m = DOMAIN.match(text, at + 1) if start < at else None
        if m:
            out.append((start, m.end()))
            free = m.end()
        else:
            free = at + 1
        at = text.find("@", free)
    return out


def base_spans(text: str) -> tuple[list[Span], list[tuple[int, int]]]:
    """Base spans in the order of the kinds, and the borders of the matches that failed their check."""
    out: list[Span] = [("email", a, b) for a, b in emails(text)] if "@" in text else []
    failed = []
    for kind, pattern in (("ip", IP), ("card", CARD), ("phone", PHONE)):
        for m in pattern.finditer(text):
            found = m.group()
            digits = re.sub(r"[^0-9]", "", found)
            if kind == "ip":
                ok = all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in found.split("."))
            elif kind == "card":
                ok = 13 <= len(digits) <= 19 and luhn(digits)
            else:
                ok = 9 <= len(digits) <= 15
            if ok:
                out.append((kind, m.start(), m.end()))
            else:
                failed.append((m.start(), m.end()))
    return out, failed


def candidates(text: str) -> list[tuple[int, int]]:
    """Overlapping spans that may be personal data, each once."""
    found = set()
    groups = [m.span() for m in DIGITS.finditer(text)]
    for i, (a, b) in enumerate(groups):
        start = a
        # A sign before the first group belongs to it: "+", "(", "+(".
        while start > 0 and a - start < 2 and text[start - 1] in "+(":
            start -= 1
        last, digits = b, 0
        for j in range(i, len(groups)):
            digits += groups[j][1] - groups[j][0]
            if digits > MOST_DIGITS:
                break
            if j > i:
                if not BETWEEN.match(text[last : groups[j][0]]):
                    break
                last = groups[j][1]
            if last - a >= 6:
                found.add((start, last))
    if "@" in text:
        found.update(emails(text))
    found.update(m.span() for m in WORDY.finditer(text))
    return sorted(found)


FEATURES = [
    "length", "digits", "groups", "first_group", "last_group", "longest_group", "plus", "bracket", "dots", "dashes", "spaces",
    "at_sign", "written_at", "luhn", "largest_part", "letters", "digit_before", "digit_after", "letter_before", "letter_after", "word_before",
]
NAMED = re.compile(r"(?:tel|phone|call|fon|móvil|mail|card|karte|carte|tarjeta|ip|server|host)\W{0,3}\Z", re.I)


def describe(text: str, start: int, end: int) -> list[float]:
    """Format of a span and its surroundings."""
    s = text[start:end]
    parts = DIGITS.findall(s)
    digits = "".join(parts)
    left, right = text[max(0, start - 1) : start], text[end : end + 1]
    near = text[max(0, start - 3) : start], text[end : end + 3]
    return [
        len(s), len(digits), len(parts), len(parts[0]) if parts else 0, len(parts[-1]) if parts else 0, max(map(len, parts), default=0),
        s.startswith("+"), "(" in s, s.count("."), s.count("-"), s.count(" "), s.count("@"),
        "at)" in s.lower() or "at]" in s.lower(), 13 <= len(digits) <= 19 and luhn(digits), min(max((int(p[:6]) for p in parts), default=0), 1000),
        sum(c.isalpha() for c in s), any(c.isdigit() for c in near[0]), any(c.isdigit() for c in near[1]),
        left.isalpha(), right.isalpha(), bool(NAMED.search(text[max(0, start - 12) : start])),
    ]


class Busy:
    """Disjoint taken ranges in order; overlap and insertion by binary search."""

    def __init__(self, spans: list[tuple[int, int]]):
        self.starts: list[int] = []
        self.ends: list[int] = []
        for a, b in sorted(spans):
            if self.ends and a < self.ends[-1]:
                self.ends[-1] = max(self.ends[-1], b)
            else:
                self.starts.append(a)
                self.ends.append(b)

    def meets(self, a: int, b: int) -> bool:
        k = bisect_left(self.starts, b) - 1
        return k >= 0 and self.ends[k] > a

    def holds(self, a: int, b: int) -> bool:
        k = bisect_right(self.starts, a) - 1
        return k >= 0 and self.ends[k] >= b

    def take(self, a: int, b: int) -> None:
        k = bisect_left(self.starts, a)
        self.starts.insert(k, a)
        self.ends.insert(k, b)


def examples(text: str) -> list[tuple[str, list[float]]]:
    """(kind of the equal base span or '', features) of the candidates that may be learned from."""
    base, failed = base_spans(text)
    kind = {(a, b): k for k, a, b in base}
    out, doubtful, known = [], Busy([(a, b) for a, b in failed if b - a >= 6]), Busy(list(kind))
    for a, b in candidates(text):
        k = kind.get((a, b), "")
        # The span of a card number is often a part of what another kind's failed match covers: it stays positive, and
        # a part of a base span stays negative.
        if not k and doubtful.meets(a, b) and not known.holds(a, b):
            continue
        out.append((k, describe(text, a, b)))
    return out


def with_luhn_digit(digits: str) -> str:
    return next(digits + d for d in "0123456789" if luhn(digits + d))


def prior_texts(n: int = PRIOR_TEXTS) -> list[str]:
    """Texts with usual writings of every kind and of numbers that are none, drawn by a fixed rule, so that no kind lacks examples."""
    rng = random.Random(1)

    def number(k: int) -> str:
        return str(rng.randint(10 ** (k - 1), 10**k - 1))

    def phone() -> str:
        country = rng.choice(["1", number(2), number(3)])
        if country == "1":
            return f"+1 ({number(3)}) {number(3)}-{number(4)}" if rng.random() < 0.5 else f"+1 {number(3)}-{number(3)}-{number(4)}"
        groups = rng.choice([(3, 3, 4), (1, 2, 2, 2, 2), (2, 3, 4), (3, 6), (4, 4)])
        return f"+{country} " + " ".join(number(k) for k in groups)

    def card() -> str:
        if rng.random() < 0.2:
            d = with_luhn_digit(number(14))
            return f"{d[:4]} {d[4:10]} {d[10:]}"
        d = with_luhn_digit(number(15))
        return rng.choice(["", " ", "-"]).join(d[k : k + 4] for k in range(0, 16, 4))

    def ip() -> str:
        return ".".join(str(rng.randint(1, 255)) for _ in range(4))

    def email() -> str:
        name = "".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=rng.randint(2, 12)))
        return f"{name}{rng.choice(['', '.', '_'])}{number(2)}@{name[::-1]}.{rng.choice(['com', 'org', 'net', 'example.com'])}"

    def other() -> str:
        return rng.choice([
            f"{number(4)}-{number(2)}-{number(2)}", number(rng.randint(6, 19)), f"{number(2)} {number(3)} {number(3)}", f"v{number(1)}.{number(2)}.{number(3)}",
            f"{number(1)}.{number(1)}.{number(1)}.{number(1)}.{number(1)}", f"{number(4)} {number(4)} {number(4)} {number(4)}", f"{number(3)}/{number(4)}/{number(2)}",
            f"{number(3)}-{number(1)}-{number(2)}-{number(6)}-{number(1)}", f"({number(3)}) {number(3)} {number(2)}", f"{number(3)}.{number(3)}.{number(4)}",
        ])

    # Signs that end a base match, so that a number next to another one is seen as well as one between words.
    between = [" and ", ", ", "; ", ",", " or ", "; "]
    kinds = (phone, card, ip, email, other)
    return [
        f"{rng.choice(['at', 'call', 'see', 'to'])} {made()}{rng.choice(between)}{rng.choice(kinds)()}{rng.choice(between)}{made()}{rng.choice(between)}{rng.choice(kinds)()}"
        for _ in range(n // 5)
        for made in kinds
    ]


class Detector:
    """Trees and thresholds by kind."""

    def __init__(self, models: dict[str, tuple[Boosted, float]]):
        self.models = models

    def spans(self, text: str | None) -> tuple[list[Span], list[Span]]:
        """(base, added), both by kind as listed and then start."""
        if not text or not SOME.search(text):
            return [], []
        base, _ = base_spans(text)
        taken = Busy([(a, b) for _, a, b in base])
        free = [c for c in candidates(text) if not taken.meets(*c)]
        if not free:
            return base, []
        x = np.array([describe(text, a, b) for a, b in free], float)
        offers = []
        for kind, (model, limit) in self.models.items():
            p = model.probability(x)
            offers += [(-p[k], *free[k], kind) for k in np.flatnonzero(p >= limit)]
        added = []
        for _, a, b, kind in sorted(offers):
            if not taken.meets(a, b):
                taken.take(a, b)
                added.append((kind, a, b))
        return base, sorted(added, key=lambda s: (KINDS.index(s[0]), s[1]))


def joined(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in sorted(spans, key=lambda s: (KINDS.index(s[0]), s[1])))


def redact(text: str, spans: list[Span]) -> str:
    """The text with each span replaced by its kind in brackets; overlapping spans are one."""
    out, at = [], 0
    for kind, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
        if b <= at:
            continue
        out += [text[at : max(a, at)], f"[{kind.upper()}]"] if a >= at else []
        at = b
    return "".join([*out, text[at:]])


def count_formats(docs: DataFrame, text: str = "text") -> DataFrame:
    """(kind, x, fit, held): how many candidates of all texts are equal, in texts to fit and in texts held out; copies of a text are on one side."""
    texts = docs.select(F.col(text).alias("text")).where(F.col("text").isNotNull())
    schema = "kind string, x array<double>, fit bigint, held bigint"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in slices(batch.column(0)):
                counts: dict[tuple, list[int]] = {}
                for t in batch.column(0).slice(a, b - a).to_pylist():
                    if not SOME.search(t):
                        continue
                    held = zlib.crc32(t.encode()) % HELD_OUT == 0
                    for k, x in examples(t):
                        counts.setdefault((k, tuple(map(float, x))), [0, 0])[held] += 1
                columns = [[k for k, _ in counts], [x for _, x in counts], [n for n, _ in counts.values()], [n for _, n in counts.values()]]
                kinds = [pa.string(), pa.list_(pa.float64()), pa.int64(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["kind", "x", "fit", "held"])

    return texts.mapInArrow(run, schema).groupBy("kind", "x").agg(F.sum("fit").alias("fit"), F.sum("held").alias("held"))


def fit_sample(formats: DataFrame, totals: dict[str, tuple[int, int]], most: int) -> DataFrame:
    """(kind, x, weight): every format, or about ``most`` of a kind with more.

    ``totals`` is (formats, candidates) to fit by kind. A format of n candidates is taken with probability n / step, or always
    from ``step`` on, and stands for at least ``step``, so that the weights of a kind keep its shares.
    """
    step = F.lit(0.0)
    for kind, (rows, n) in sorted(totals.items()):
        step = F.when(F.col("kind") == kind, F.lit(n / most if rows > most else 0.0)).otherwise(step)
    draw = (F.pmod(F.xxhash64("kind", "x"), F.lit(1 << 30)) + 0.5) / float(1 << 30)
    return formats.where((F.col("fit") > 0) & (F.col("fit") >= draw * step)).select("kind", "x", F.greatest(F.col("fit").cast("double"), step).alias("weight"))


def limits(formats: DataFrame, models: dict[str, Boosted]) -> dict[str, float]:
    """By kind the least score from which PRECISION of all held-out candidates are of it, where there is one; scores count in steps."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kinds, n = batch.column("kind").to_pylist(), batch.column("held").to_numpy(zero_copy_only=False).astype(float)
            x = np.array(batch.column("x").to_pylist(), float).reshape(len(n), len(FEATURES))
            for kind, model in models.items():
                at = np.floor(model.probability(x) * STEPS).astype(int)
                right = np.bincount(at, n * np.array([k == kind for k in kinds], float))
                every = np.bincount(at, n)
                own = np.flatnonzero(every)
                columns = [pa.array([kind] * len(own), pa.string()), pa.array(own, pa.int64()), pa.array(right[own]), pa.array(every[own])]
                yield pa.RecordBatch.from_arrays(columns, names=["kind", "at", "right", "every"])

    scored = formats.where(F.col("held") > 0).mapInArrow(run, "kind string, at bigint, right double, every double")
    counts: dict[str, list[tuple]] = {}
    for r in scored.where(F.col("at") * 2 >= STEPS).groupBy("kind", "at").agg(F.sum("right").alias("right"), F.sum("every").alias("every")).collect():
        counts.setdefault(r["kind"], []).append((r["at"], r["right"], r["every"]))
    out = {}
    for kind, rows in counts.items():
        at, right, every = np.array(sorted(rows, reverse=True), float).T
        good = np.flatnonzero(np.cumsum(right) >= PRECISION * np.cumsum(every))
        if len(good):
            out[kind] = float(at[good[-1]] / STEPS)
    return out


def learn(docs: DataFrame, text: str = "text", fit_formats: int = FIT_FORMATS) -> Detector:
    """Trees from the counted candidates of all texts; about ``fit_formats`` formats of a kind are collected, all that are held out are scored in tasks."""
    prior = docs.sparkSession.createDataFrame([(t,) for t in prior_texts()], "text string")
    formats = stage(count_formats(docs.select(F.col(text).alias("text")).unionByName(prior)), "pii-formats")
    fits = (F.col("fit") > 0).cast("bigint")
    rows = formats.groupBy("kind").agg(F.sum(fits).alias("rows"), F.sum("fit").alias("fit")).collect()
    sample = fit_sample(formats, {r["kind"]: (r["rows"], r["fit"]) for r in rows}, fit_formats).toPandas()
    # The order of rows in a table is not fixed; sums of floats depend on it.
    x, kinds = np.stack(sample["x"].to_list()).astype(float), sample["kind"].to_numpy(str)
    order = np.lexsort([*x.T, kinds])
    x, kinds, weight = x[order], kinds[order], sample["weight"].to_numpy(float)[order]
    models = {k: boost(x, (kinds == k).astype(float), trees=40, depth=6, rate=0.3, least=5, part=1.0, weight=weight) for k in KINDS}
    least = limits(formats, models)
    return Detector({k: (m, least[k]) for k, m in models.items() if k in least})


def find_personal_data(docs: DataFrame, text: str = "text", detector: Detector | None = None) -> DataFrame:
    """``docs`` with n_email, n_ip, n_card, n_phone, base_sha256 (base spans only), spans (all) and redacted (the text without them)."""
    model = detector or learn(docs, text)

    def fn(column: pa.Array) -> list:
        counts, digests, spans, clean = [[] for _ in KINDS], [], [], []
        for t in column.to_pylist():
            base, added = model.spans(t)
            for n, k in zip(counts, KINDS):
                n.append(sum(s[0] == k for s in base))
            digests.append(hashlib.sha256(joined(base).encode()).hexdigest())
            spans.append(joined(base + added))
            clean.append(redact(t, base + added) if base or added else t)
        return [*counts, digests, spans, clean]

    fields = [*[(f"n_{k}", "bigint") for k in KINDS], ("base_sha256", "string"), ("spans", "string"), ("redacted", "string")]
    return add_columns(docs, text, [(free_name(docs, n), t) for n, t in fields], fn)


def redact_documents(docs: DataFrame, text: str = "text") -> DataFrame:
    name = free_name(docs, "redacted")
    found = find_personal_data(docs, text)
    return found.withColumn(text, F.col(name)).select(*docs.columns)
