"""Personal data: patterns, and spans that a learned tagger adds to theirs.

The patterns find e-mail addresses, IPv4 addresses, card and phone numbers.
The tagger (a character-level BiLSTM with CRF transitions) is trained from
windows around a bounded sample of the spans that patterns label, with their
written forms varied (``name [at] host dot tld``, numbers without the plus, with
other separators or grouped as in other countries), and from windows of other
digits, which are no data.  It reads the parts of every text around digits,
``@``, ``(at)``, ``dot`` and an ``at`` before a host with a dot.  Overlapping windows are scored, their scores
averaged where they overlap, and each whole stretch is decoded at once.  What
it adds must not overlap a pattern's span and must pass a check of its kind
(digits, octets, Luhn, an at and a dot).

Offsets are code points, ends exclusive; spans come in the order of kinds as
listed, then start.  Edge cases: a null text is empty and has no spans; where
no text has a pattern's span the tagger adds nothing; other columns pass through.
"""

from __future__ import annotations

import hashlib
import random
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import applied, quoted, released
from .tagger import Tagger, codes
from .text import portions

KINDS = ("email", "ip", "card", "phone")
WINDOW, STRIDE, REACH = 96, 48, 40
SAMPLE_WINDOWS = 1200
CACHE = 50_000
#: Stretches of text, and characters of them (but for a longer one), tagged at once.
TAGGED, TAGGED_CHARS = 2000, 200_000

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# A failing start inside a run of digits fails wherever in the run it is, so only a run's first digit is tried.
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_ANCHOR = re.compile(r"[0-9]+|@")
_WORDS = re.compile(r"[\[({<]\s?at\s?[\])}>]|\bdot\b|\bat\s+[a-z0-9-]+\.[a-z0-9]", re.IGNORECASE)


def _emails(t: str):
    done, at = 0, t.find("@")
    while at >= 0:
        start = at
        while start > done and t[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(t, at + 1)):
            yield start, m.end()
            done = m.end()
        at = t.find("@", max(at + 1, done))


def luhn(digits: str) -> bool:
    odd = sum(int(d) for d in digits[-1::-2])
    even = sum((2 * int(d) - 9) if d > "4" else 2 * int(d) for d in digits[-2::-2])
    return (odd + even) % 10 == 0


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def base_spans(text: str | None) -> list[tuple[str, int, int]]:
    """The patterns' spans, by kind, then start."""
    t = text or ""
    out = [("email", a, b) for a, b in _emails(t)]
    if not _DIGIT.search(t):
        return out
    out += [("ip", *m.span()) for m in _IP.finditer(t) if all(len(p.lstrip("0")) <= 3 and int(p[-3:] if len(p) > 3 else p) <= 255 for p in m[0].split("."))]
    out += [("card", *m.span()) for m in _CARD.finditer(t) if len(m[0]) >= 16 and 16 <= len(d := _digits(m[0])) <= 19 and luhn(d)]
    out += [("phone", *m.span()) for m in _PHONE.finditer(t) if 8 <= len(_digits(m[0])) <= 15]
    return out


def stretches(t: str) -> list[tuple[int, int]]:
    """Where written forms of the kinds could be: the parts of a text around anchors, joined where they meet."""
    marks = [m.span() for m in _ANCHOR.finditer(t)] if _ANCHOR.search(t) else []
    low = t.lower() if len(t.lower()) == len(t) else t
    if "dot" in low or "at" in low and ("." in low or any(b in low for b in "[({<")):
        marks += [m.span() for m in _WORDS.finditer(t)]
        marks.sort()
    out: list[list[int]] = []
    for a, b in marks:
        a, b = max(0, a - REACH), min(len(t), b + REACH)
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


#: An address as it may be written out.
_WRITTEN = re.compile(r"[A-Za-z0-9._%+-]+\s*(?:@|[\[({<]\s?(?:at|@)\s?[\])}>]|\sat\s)\s*[A-Za-z0-9-]+(?:\s*(?:\.|[\[({<]\s?(?:dot|\.)\s?[\])}>]|\sdot\s)\s*[A-Za-z0-9-]+)+", re.IGNORECASE)


# ---- training from labelled spans


def _varied(kind: str, s: str, r: random.Random) -> str:
    """Another way to write what a span holds."""
    if kind == "email":
        name, host = s.split("@", 1)
        word = lambda: "".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(r.randrange(2, 9)))
        if r.random() < 0.7:
            name = r.choice([name, word(), word() + "." + word(), word() + str(r.randrange(100)), word() + "_" + word(), word() + "-" + word()])
            host = r.choice(["", "", "mail.", "mx" + str(r.randrange(9)) + "."]) + r.choice([word(), host.split(".")[-2]]) + "." + r.choice(["com", "org", "net", "de", "fr", "es", "io", "edu", "info", "co.uk"])
        at, dot = r.choice([(" [at] ", "."), (" (at) ", "."), (" at ", " dot "), *[(" at ", ".")] * 3, (" [at] ", " [dot] "), ("[at]", "."), (" AT ", " DOT "), ("(at)", "(dot)"), (" @ ", ".")])
        return name + at + host.replace(".", dot)
    d = [str(r.randrange(10)) if kind == "phone" else c for c in _digits(s)]
    if kind == "ip":
        parts = [str(r.randrange(1, 256)) for _ in range(4)]
        return r.choice(["[.]", "(.)", " . ", " dot "]).join(parts)
    if kind == "card":
        groups = ["".join(d[i : i + 4]) for i in range(0, len(d), 4)]
        return r.choice([".", "/", "  ", " - ", "_"]).join(groups)
    d = (["5"] * 10 + d)[-10:]
    a, b, c = "".join(d[:3]), "".join(d[3:6]), "".join(d[6:])
    if (how := r.random()) < 0.6:
        return "".join(d) if how < 0.15 else _grouped("".join(d), r)
    return r.choice([f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"{a} {b} {c}", f"001 {a} {b} {c}", f"1-{a}-{b}-{c}", f"({a}){b}-{c}"])


def _grouped(d: str, r: random.Random) -> str:
    """Ten digits as a phone number of other countries."""
    pairs = lambda s, by: by.join(s[i : i + 2] for i in range(0, len(s), 2))
    short = d[3 : 10 - r.randrange(2)]
    return r.choice([
        d, f"0{d[1]} {pairs(d[2:], ' ')}", f"0{d[1]}-{pairs(d[2:], '-')}", f"0{d[1]}.{pairs(d[2:], '.')}", f"0033 {d[1]} {pairs(d[2:], ' ')}", f"02{d[2]} {d[2:6]} {d[6:]}", f"0{d[1:5]} {d[4:]}", f"07{d[1:4]} {d[4:]}",
        f"0{d[1:3]} {short}", f"0{d[1:3]}/{short}", f"(0{d[1:3]}) {short}", f"0{d[1:4]}-{short}", f"0049 {d[1:3]} {short}", f"6{d[1:3]} {d[3:6]} {d[6:9]}", f"9{d[1]} {d[2:5]} {d[5:7]} {d[7:9]}", f"6{d[1:9]}",
    ])


def _decoy(r: random.Random) -> str:
    """Digits that are no personal data."""
    n = lambda k: "".join(str(r.randrange(10)) for _ in range(k))
    return r.choice([
        f"{r.randrange(1900, 2100)}-{r.randrange(1, 13):02}-{r.randrange(1, 29):02}", f"{n(2)}/{n(2)}/{n(4)}", f"{r.randrange(9)}.{r.randrange(20)}.{r.randrange(20)}", n(r.randrange(1, 8)), f"${n(2)},{n(3)}.{n(2)}",
        f"{n(2)}:{n(2)}:{n(2)}", f"{n(3)}%", f"no. {n(5)}", f"{n(1)},{n(3)},{n(3)}", f'token = "{"".join(r.choice("0123456789abcdef") for _ in range(40))}"', f"password={''.join(r.choice('0123456789abcdef') for _ in range(18))}",
        f"at {n(2)} dot {n(1)}", "look at that dot", f"({n(4)})", f"{n(4)}-{n(4)}", f"pp. {n(3)}-{n(3)}", f"{n(2)}.{n(3)}", "AKIA" + "".join(r.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567") for _ in range(16)),
    ])


def _near_phone(r: random.Random) -> str:
    """Dates, ranges and numbers of about as many digits as a phone number."""
    n = lambda k: "".join(str(r.randrange(10)) for _ in range(k))
    return r.choice([f"{r.randrange(1900, 2100)}-{r.randrange(1, 13):02}-{r.randrange(1, 29):02}", f"{n(2)}/{n(2)}/{n(4)}", f"{n(2)}.{n(2)}.{n(4)}", f"{n(4)}-{n(4)}", f"{n(4)}-{n(4)}", f"no. {n(5)}", f"{r.randrange(1900, 2100)} - {r.randrange(1900, 2100)}", n(8)])


def _examples(docs: DataFrame, most: int) -> list[tuple[str, str, str, str]]:
    """(kind, before, span, after) of a bounded sample of the patterns' spans: those of least hash, as many of each kind.

    One pass: each task keeps its own least of every kind, and Spark the least
    of these.  Spans of over ``WINDOW - 20`` characters don't fit a window and
    are no examples.
    """
    each = most // len(KINDS)

    def label(batches):
        least: dict[str, dict] = {k: {} for k in KINDS}
        for batch in batches:
            for t in batch.column(0).to_pylist():
                if t and _ANCHOR.search(t):
                    for k, a, b in base_spans(t):
                        if b - a <= WINDOW - 20:
                            row = (t[max(0, a - WINDOW) : a], t[a:b], t[b : b + WINDOW])
                            least[k][int.from_bytes(hashlib.blake2b("\0".join(row).encode(), digest_size=7).digest(), "big"), *row] = None
                for k, rows in least.items():
                    if len(rows) > 4 * each:
                        least[k] = dict.fromkeys(sorted(rows)[:each])
        rows = [(k, *r) for k in KINDS for r in sorted(least[k])[:each]]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.int64() if i == 1 else pa.string()) for i in range(5)], ["kind", "o", "before", "span", "after"])

    found = docs.select("text").filter("text is not null").mapInArrow(label, "kind string, o long, before string, span string, after string")
    place = F.row_number().over(Window.partitionBy("kind").orderBy("o", "before", "span", "after"))
    rows = found.distinct().withColumn("place", place).filter(F.col("place") <= each).collect()
    return [(r.kind, r.before, r.span, r.after) for r in sorted(rows, key=lambda r: (KINDS.index(r.kind), r.place))]


def train(docs: DataFrame, sample_windows: int = SAMPLE_WINDOWS) -> Tagger | None:
    """A tagger from the patterns' own spans in ``docs`` (text); None if there are none."""
    r = random.Random(13)
    texts, tags = [], []
    examples = _examples(docs, sample_windows)
    for kind, before, span, after in examples * max(1, round(sample_windows / max(1, len(examples)))):  # fewer spans are varied more often
        for what, form in (("base", span), ("form", _varied(kind, span, r)), ("form", _varied(kind, span, r)), ("form", _varied(kind, span, r)), ("decoy", _decoy(r)), ("decoy", _decoy(r)), ("decoy", _near_phone(r))):
            lead = r.randrange(5, max(6, WINDOW - len(form)))
            head = before[-lead:]
            own = (len(head), len(head) + len(form))
            texts.append((head + form + after)[:WINDOW])
            # whatever else is in the window is labelled as the patterns see it
            marks = [s for s in base_spans(texts[-1]) if what == "base" or s[2] <= own[0] or s[1] >= own[1]]
            if what == "form":
                marks.append((kind, own[0], min(own[1], len(texts[-1]))))
            row = [0] * len(texts[-1])
            for q, a, b in marks:
                k = KINDS.index(q)
                row[a:b] = [1 + 2 * k] + [2 + 2 * k] * (b - a - 1)
            tags.append(row)
    if not texts:
        return None
    model = Tagger(1 + 2 * len(KINDS))
    model.fit(texts, tags, WINDOW)
    return model


# ---- finding


def _valid(kind: str, s: str) -> bool:
    """Whether what the tagger found can be such data at all."""
    d = _digits(s)
    if kind == "email":
        return bool(_WRITTEN.fullmatch(s))
    if kind == "ip":
        parts = re.findall(r"[0-9]+", s)
        return len(parts) == 4 and all(len(p) <= 3 and int(p) <= 255 for p in parts) and not re.search(r"[A-CE-NP-SU-Za-ce-np-su-z]", s)
    if re.search(r"[^0-9 ()./_+\t-]", s):
        return False
    if kind == "card":
        return 16 <= len(d) <= 19 and luhn(d)
    return 8 <= len(d) <= 15 and bool(re.fullmatch(r"[+(]*[0-9][0-9 ()./\t+-]*[0-9]", s))


def _tagged(model: Tagger, texts: list[str]) -> list[list[tuple[str, int, int]]]:
    """The tagger's spans in stretches of text.

    The tagger sees codes, in which all digits are one, so windows of tables of
    numbers are few different ones; each is read once.
    """
    cut, owner, starts = [], [], []
    for i, t in enumerate(texts):
        for a in range(0, max(1, len(t) - WINDOW + STRIDE), STRIDE):
            cut.append(t[a : a + WINDOW])
            owner.append(i)
            starts.append(a)
    total = [np.zeros((len(t), 1 + 2 * len(KINDS)), np.float32) for t in texts]
    times = [np.zeros((len(t), 1), np.float32) for t in texts]
    ids = codes(cut, WINDOW)
    _, first, which = np.unique(ids, axis=0, return_index=True, return_inverse=True)
    order = np.argsort(which, kind="stable")  # windows by what they are
    bounds = np.searchsorted(which[order], np.arange(len(first) + 1))
    for i in range(0, len(first), 256):
        e = model.emissions(ids[first[i : i + 256]])
        for k in order[bounds[i] : bounds[min(i + 256, len(first))]].tolist():
            o, a, t = owner[k], starts[k], cut[k]
            total[o][a : a + len(t)] += e[which[k] - i, : len(t)]
            times[o][a : a + len(t)] += 1
    out = []
    for tags in model.decode([s / n for s, n in zip(total, times)]):
        spans = []
        k = 0
        while k < len(tags):
            if tags[k]:
                kind, a = (tags[k] - 1) // 2, k
                k += 1
                while k < len(tags) and tags[k] == 2 + 2 * kind:
                    k += 1
                spans.append((KINDS[kind], a, k))
            else:
                k += 1
        out.append(spans)
    return out


def _trimmed(kind: str, t: str, a: int, b: int) -> tuple[int, int]:
    while a < b and t[a] in " \t\n,;:.-":
        a += 1
    while b > a and t[b - 1] in " \t\n,;:.-":
        b -= 1
    if kind == "email":  # the whole address that was touched, without words beside it
        low = max(0, a - REACH)
        for m in _WRITTEN.finditer(t, low, min(len(t), b + REACH)):
            if m.start() < b and a < m.end():
                return m.span()
    return a, b


def spans_of(texts: list[str | None], model: Tagger | None, cache: dict) -> list[list[tuple[str, int, int, bool]]]:
    """(kind, start, end, whether a pattern has it) of each text, in order."""
    out, asked = [], []
    for i, text in enumerate(texts):
        t = text or ""
        out.append([(*s, True) for s in base_spans(t)])
        if model is not None:
            asked += [(i, a, t[a:b]) for a, b in stretches(t)]
    fresh = sorted({s for _, _, s in asked if s not in cache}, key=lambda s: (len(s), s))
    while fresh:
        n = max(1, int(np.searchsorted(np.cumsum([len(s) for s in fresh[:TAGGED]]), TAGGED_CHARS, side="right")))
        cache.update(zip(fresh[:n], _tagged(model, fresh[:n])))
        fresh = fresh[n:]
    for i, at, s in asked:
        for kind, a, b in cache[s]:
            a, b = _trimmed(kind, s, a, b)
            if _valid(kind, s[a:b]) and not any(x < at + b and at + a < y for _, x, y, _ in out[i]):
                out[i].append((kind, at + a, at + b, False))
    if len(cache) > CACHE:
        cache.clear()
    return [sorted(s, key=lambda x: (KINDS.index(x[0]), x[1])) for s in out]


SPANS = "array<struct<kind:string,start:int,end:int,base:boolean>>"


def find(docs: DataFrame, model: Tagger | None, keep: list[str]) -> DataFrame:
    """The ``keep`` columns and ``spans`` for every row of ``docs``; a kept column of that name gives way."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("base", pa.bool_())]))

    def run(batches):
        cache: dict = {}
        for texts in batches:
            found = []
            for part in portions(texts):
                found += spans_of(part.to_pylist(), shared.value, cache)
            yield [pa.array([[dict(zip(("kind", "start", "end", "base"), s)) for s in x] for x in found], kind)]
        cache.clear()
        released()

    return applied(docs, keep, run, f"spans {SPANS}")


def digests(found: DataFrame, keep: list[str]) -> DataFrame:
    """Counts and digest of the patterns' spans, and all spans as text."""
    named = lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])
    base = F.filter("spans", lambda x: x["base"])
    count = lambda k: F.size(F.filter("spans", lambda x: x["base"] & (x["kind"] == k))).cast("long").alias(f"n_{k}")
    counts = [count(k) for k in KINDS]
    return found.select(*[F.col(quoted(c)) for c in keep if c != "spans"], *counts, F.sha2(F.concat_ws(",", F.transform(base, named)), 256).alias("base_sha256"), F.concat_ws(",", F.transform("spans", named)).alias("spans"))


def redact(docs: DataFrame, model: Tagger | None) -> DataFrame:
    """``docs`` with every span in ``text`` replaced by its kind in brackets; of overlapping spans the whole stretch goes under the first's kind."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def clean(t: str | None, spans) -> str | None:
        if not spans:
            return t
        out, done = [], 0
        for kind, a, b, _ in sorted(spans, key=lambda s: (s[1], -s[2])):
            if b <= done:
                continue
            if a >= done:
                out += [t[done:a], f"[{kind.upper()}]"]
            done = b
        return "".join([*out, t[done:]])

    def run(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        cache: dict = {}
        for column in texts:
            done = []
            for part in map(pa.Array.to_pylist, portions(column)):
                done += map(clean, part, spans_of(part, shared.value, cache))
            yield pa.array(done, pa.string())
        cache.clear()
        released()

    run.__annotations__ = {"texts": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return docs.withColumn("text", F.arrow_udf(run, "string")(F.col("text")))
