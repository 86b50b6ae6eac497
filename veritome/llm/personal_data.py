"""Personal data: exact patterns, and a trained tagger for what they miss.

Exact spans are e-mail addresses, IPv4 addresses, card numbers (16 to 19 digits
passing Luhn) and international phone numbers, each kind found from the left
without overlaps; matches that fail their test are dropped and not retried.

The tagger (``sequence_tagger``) reads windows of 64 characters, each overlapping
the next by half.  Every kind holds a digit or ``@``, so every window is decoded that
meets a run of non-blanks with one, or a run next to that: a tagged span has at most
one blank on either side of ``@``, and numbers have digits in each run.  Each character takes its
tag from the window in which it lies more centrally, and spans are read off the
tags of the whole text, across window borders.  A tagged span is added if it meets
no exact span and passes its kind's test.

Training texts are a bounded sample of documents with exact spans labelled, and
pieces of these documents with generated addresses and numbers, also in spellings
that the patterns leave out (phone numbers without ``+``, blanks around ``@``).

Defined results: a null or empty text has no spans; every input row gives one row,
repeated ids included.  Offsets are code points, ends exclusive.  Other input
columns are not read; ``redact`` passes them on unchanged.
"""

from __future__ import annotations

import hashlib
import random
import re
import string

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veritome.llm import textkit as K
from veritome.llm.sequence_tagger import PAD, Tagger, classes

KINDS = ("email", "ip", "card", "phone")
WINDOW, STRIDE = 64, 32
#: Bound of the training sample: documents, read whole.
SAMPLE_DOCS = 400
#: Generated windows and passes over the training set.
GENERATED, EPOCHS = 2400, 5
DECODE_BATCH = 512

# Fixed patterns.  A number starts at the first digit of its run: a start further
# in fails with it or lies inside its match.
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
_CARD = re.compile(r"(?<![0-9])[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_LOCAL = frozenset(string.ascii_letters + string.digits + "._%+-")

_TRIGGER = np.zeros(256, bool)
_TRIGGER[[*b"0123456789@"]] = True

_BLANK = np.zeros(256, bool)
_BLANK[[0x20, *range(0x09, 0x0E)]] = True

Span = tuple[str, int, int]


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        v = int(d) * (1 + k % 2)
        total += v - 9 * (v > 9)
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def _is_ip(text: str) -> bool:
    return all(len(part.lstrip("0")) <= 3 and int(part.lstrip("0") or 0) <= 255 for part in text.split("."))


def _is_card(text: str) -> bool:
    return 16 <= len(d := _digits(text)) <= 19 and luhn(d)


def exact_spans(text: str) -> list[Span]:
    """Base spans by kind, then start."""
    out, at, end = [], text.find("@"), 0
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            out.append(("email", start, m.end()))
            end = m.end()
        at = text.find("@", max(at + 1, end))
    out += [("ip", *m.span()) for m in _IP.finditer(text) if _is_ip(m[0])]
    out += [("card", *m.span()) for m in _CARD.finditer(text) if _is_card(m[0])]
    out += [("phone", *m.span()) for m in _PHONE.finditer(text) if 8 <= len(_digits(m[0])) <= 15]
    return out


def plausible(kind: str, text: str) -> bool:
    """The test that a tagged span must pass."""
    if kind == "email":
        local, _, domain = text.replace(" ", "").partition("@")
        return bool(local) and bool(_DOMAIN.fullmatch(domain))
    if kind == "ip":
        return text.count(".") == 3 and all(p.isascii() and p.isdigit() for p in text.split(".")) and _is_ip(text)
    if kind == "card":
        return all(c in "0123456789 -" for c in text) and _is_card(text)
    return all(c in "0123456789 ()-.+" for c in text) and 9 <= len(_digits(text)) <= 15 and any(c in " ()-." for c in text)


# ---- training texts ---------------------------------------------------------


def _word(rnd: random.Random, lo: int, hi: int, letters: str = string.ascii_lowercase) -> str:
    return "".join(rnd.choice(letters) for _ in range(rnd.randint(lo, hi)))


def _number(rnd: random.Random, n: int) -> str:
    return _word(rnd, n, n, string.digits)


def _card(rnd: random.Random, valid: bool = True) -> str:
    body = _number(rnd, rnd.choice([15, 15, 15, 18]))
    check = next(d for d in string.digits if luhn(body + d) == valid)
    digits, gap = body + check, rnd.choice(["", "", " ", "-"])
    return gap.join(digits[k : k + 4] for k in range(0, len(digits), 4))


def _generate(rnd: random.Random) -> tuple[str, str]:
    """Kind (empty: none) and text of something that holds digits or ``@``."""
    pick = rnd.random()
    if pick < 0.22:
        at = rnd.choice(["@", "@", "@", "@", " @ ", "@ ", " @"])
        return "email", _word(rnd, 2, 10) + rnd.choice(["", ".", "_"]) + _word(rnd, 0, 4, string.ascii_lowercase + string.digits) + _number(rnd, rnd.randint(0, 3)) + at + _word(rnd, 3, 9, string.ascii_lowercase + "0123") + "." + rnd.choice(["com", "org", "net", "example.com", "de", "fr", "es", "co.uk"])
    if pick < 0.38:
        return "ip", ".".join(str(rnd.randint(0, 255)) for _ in range(4))
    if pick < 0.54:
        return "card", _card(rnd)
    if pick < 0.78:
        area, mid, tail, gap = _number(rnd, 3), _number(rnd, 3), _number(rnd, 4), rnd.choice("-. ")
        return "phone", rnd.choice([f"+{rnd.randint(1, 99)} ({area}) {mid}-{tail}", f"+{rnd.randint(1, 99)} {area} {mid}{tail}", f"({area}) {mid}-{tail}", f"{area}{gap}{mid}{gap}{tail}", f"+{rnd.randint(1, 99)}{gap}{area}{gap}{mid}{gap}{tail}"])
    return "", rnd.choice([
        f"{rnd.randint(1900, 2099)}-{rnd.randint(10, 12)}-{rnd.randint(10, 28)}", f"{rnd.randint(1, 9)}.{rnd.randint(0, 9)}", f"version {rnd.randint(1, 9)}.{rnd.randint(0, 9)}.{rnd.randint(0, 9)}",
        _word(rnd, 12, 40, "0123456789abcdef"), _number(rnd, rnd.randint(1, 8)), f"{rnd.randint(1, 999)},{_number(rnd, 3)}.{_number(rnd, 2)}", f"@{_word(rnd, 3, 9)}", f"{_word(rnd, 3, 8)} @ {rnd.randint(1, 30)}",
        f"{rnd.randint(1, 23)}:{_number(rnd, 2)}", f"{_number(rnd, 3)}.{_number(rnd, 3)}.{rnd.randint(300, 999)}.{rnd.randint(300, 999)}", f"https://{_word(rnd, 3, 8)}.com/{_number(rnd, 5)}",
    ])


def _tags(length: int, spans: list[Span]) -> np.ndarray:
    tags = np.zeros(length, np.int64)
    for kind, a, b in spans:
        k = KINDS.index(kind)
        tags[a:b] = 2 + 2 * k
        tags[a] = 1 + 2 * k
    return tags


def training_set(texts: list[str], seed: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Windows and tags from labelled spans of the texts and from generated ones."""
    rnd, xs, ys = random.Random(seed), [], []
    texts = [t for t in texts if t.strip()] or ["the of and to in is that for it as with be on by this from or at an are"]

    def add(text: str, spans: list[Span], start: int) -> None:
        x, y = np.full(WINDOW, PAD, np.int16), np.zeros(WINDOW, np.int64)
        part = text[start : start + WINDOW]
        x[: len(part)] = classes(np.frombuffer(part.encode("utf-32-le"), np.uint32))
        y[: len(part)] = _tags(len(text), spans)[start : start + WINDOW]
        xs.append(x)
        ys.append(y)

    for text in texts:
        spans = exact_spans(text)
        for _, a, _ in spans[:8]:
            add(text, spans, max(0, a - rnd.randint(0, STRIDE)))
        digits = [m.start() for m in re.finditer("[0-9@]", text)]
        if digits and not spans:
            add(text, spans, max(0, rnd.choice(digits) - rnd.randint(0, STRIDE)))
    while len(xs) < GENERATED:
        text = rnd.choice(texts)
        a = rnd.randrange(len(text))
        left, right = text[a : a + 70], text[a + 70 : a + 160]
        left, right = re.sub("[0-9@]", "e", left), re.sub("[0-9@]", "e", right)
        kind, item = _generate(rnd)
        left, right = left + rnd.choice([" ", " ", " ", "\n", "(", ": "]), rnd.choice([" ", " ", ". ", ", ", ")", "\n"]) + right
        spans = [(kind, len(left), len(left) + len(item))] if kind else []
        add(left + item + right, spans, rnd.randint(max(0, len(left) - WINDOW + 8), len(left)))
    return np.stack(xs), np.stack(ys)


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Tagger:
    """Trains on the driver; the sample is bounded and chosen in hash order of the ids."""
    ids = [r[0] for r in docs.select(docs[id_col]).where(docs[id_col].isNotNull()).distinct().orderBy(F.xxhash64(id_col), id_col).limit(SAMPLE_DOCS).collect()]
    texts = [] if not ids else [r[1] for r in sorted(docs.where(docs[id_col].isin(ids)).select(docs[id_col], docs[text_col].cast("string")).collect(), key=str) if r[1]]
    return fit_texts(texts)


def fit_texts(texts: list[str]) -> Tagger:
    tagger = Tagger(1 + 2 * len(KINDS))
    tagger.train(*training_set(texts), EPOCHS)
    return tagger


# ---- whole texts ------------------------------------------------------------


def _near_trigger(points: np.ndarray) -> np.ndarray:
    """Characters of runs between blanks that hold a digit or ``@``, and of the runs next to these."""
    blank = _BLANK[points]
    run = np.cumsum(np.diff(blank, prepend=True) & ~blank)  # numbered from 1; blanks have the number of the run before
    hit = np.zeros(int(run[-1]) + 3 if len(run) else 3, bool)
    hit[run[_TRIGGER[points] & ~blank]] = True
    hit[:-1] |= hit[1:].copy()
    hit[1:] |= hit[:-1].copy()
    return hit[run]


def tagged_spans(texts: list[str], tagger: Tagger) -> list[list[Span]]:
    """What the tagger finds in each text, overlapping windows reconciled."""
    points = [classes(np.frombuffer(t.encode("utf-32-le", "surrogatepass"), np.uint32)) for t in texts]
    owners, starts = [], []
    for i, p in enumerate(points):
        block = np.unique(np.flatnonzero(_near_trigger(p)) // STRIDE)
        first = np.unique(np.concatenate([block, np.maximum(block - 1, 0)])) * STRIDE
        owners.append(np.full(len(first), i))
        starts.append(first)
    owner, start = (np.concatenate(x) if x else np.empty(0, np.int64) for x in (owners, starts))
    out: list[list[Span]] = [[] for _ in texts]
    tags = np.empty((len(owner), WINDOW), np.int64)
    for lo in range(0, len(owner), DECODE_BATCH):
        x = np.full((len(owner[lo : lo + DECODE_BATCH]), WINDOW), PAD, np.int16)
        for k, (i, a) in enumerate(zip(owner[lo : lo + DECODE_BATCH].tolist(), start[lo : lo + DECODE_BATCH].tolist())):
            part = points[i][a : a + WINDOW]
            x[k, : len(part)] = part
        tags[lo : lo + DECODE_BATCH] = tagger.decode(x)
    half = STRIDE // 2
    edges = np.searchsorted(owner, np.arange(len(texts) + 1))
    for i in range(len(texts)):
        mine = range(edges[i], edges[i + 1])
        if not mine:
            continue
        whole, size = np.zeros(len(points[i]) + WINDOW, np.int64), len(points[i])
        decoded = set(start[edges[i] : edges[i + 1]].tolist())
        for k in mine:
            a = int(start[k])
            # The first quarter belongs to the window before, the last to the window after, where they are decoded.
            lo = half if a - STRIDE in decoded else 0
            hi = STRIDE + half if a + STRIDE in decoded else WINDOW
            whole[a + lo : a + hi] = tags[k, lo:hi]
        whole = whole[:size]
        kind = np.where(whole > 0, (whole - 1) // 2, -1)
        new = np.ones(size, bool)
        new[1:] = (kind[1:] != kind[:-1]) | ((whole[1:] % 2 == 1) & (whole[1:] > 0))
        turns = np.concatenate([np.flatnonzero(new), [size]])
        for a, b in zip(turns[:-1].tolist(), turns[1:].tolist()):
            if kind[a] >= 0:
                out[i].append((KINDS[kind[a]], a, b))
    return out


def all_spans(texts: list[str], tagger: Tagger) -> tuple[list[list[Span]], list[list[Span]]]:
    """Exact spans, and these with the tagger's, each by kind, then start."""
    base = [exact_spans(t) for t in texts]
    full = []
    for text, exact, tagged in zip(texts, base, tagged_spans(texts, tagger)):
        more, taken = [], bytearray(len(text) if tagged else 0)
        for _, a, b in exact if tagged else []:
            taken[a:b] = b"\x01" * (b - a)
        for kind, a, b in tagged:
            while a < b and text[a] in " .,-)":
                a += 1
            while b > a and text[b - 1] in " .,-(":
                b -= 1
            if a and text[a - 1] == "(" and ")" in text[a:b] and "(" not in text[a:b]:
                a -= 1  # an area code keeps its bracket
            if a < b and 1 not in taken[a:b] and plausible(kind, text[a:b]) and not (a and text[a - 1].isalnum()) and not (b < len(text) and text[b].isalnum()):
                more.append((kind, a, b))  # tagged spans do not meet one another
        full.append(sorted([*exact, *more], key=lambda s: (KINDS.index(s[0]), s[1], s[2])))
    return base, full


def joined(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def _find(data: np.ndarray, offs: np.ndarray, tagger: Tagger) -> dict[int, tuple[str, list[Span], list[Span]]]:
    """Text, exact and all spans of the rows that hold a digit or ``@``."""
    rows = np.flatnonzero(K.per_row(_TRIGGER[data], offs)).tolist()
    raw = data.tobytes()
    texts = [raw[offs[r] : offs[r + 1]].decode("utf-8", "replace") for r in rows]
    return {r: x for r, *x in zip(rows, texts, *all_spans(texts, tagger))}


def personal_data(docs: DataFrame, tagger: Tagger, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Counts and digest of the exact spans, and all spans, for every row."""
    fields = [*((f"n_{k}", T.LongType()) for k in KINDS), ("base_sha256", T.StringType()), ("spans", T.StringType())]

    def compute(data, offs):
        found, n = _find(data, offs, tagger), len(offs) - 1
        counts = {k: np.zeros(n, np.int64) for k in KINDS}
        digests, spans = [hashlib.sha256(b"").hexdigest()] * n, [""] * n
        for r, (_, base, full) in found.items():
            for kind, _, _ in base:
                counts[kind][r] += 1
            digests[r], spans[r] = hashlib.sha256(joined(base).encode()).hexdigest(), joined(full)
        return {f"n_{k}": v for k, v in counts.items()} | {"base_sha256": digests, "spans": spans}

    return K.map_documents(docs, compute, fields, id_col, text_col)


def redact(docs: DataFrame, tagger: Tagger, text_col: str = "text", count_col: str | None = "n_chars") -> DataFrame:
    """``docs`` with each span replaced by its kind, and the character count kept true."""
    place, schema = docs.columns.index(text_col), docs.schema
    count = docs.columns.index(count_col) if count_col in docs.columns else None

    def run(batches):
        for batch in batches:
            column = batch.column(place)
            data, offs = K.buffers(column)
            texts, changed = None, {}
            for lo, _, part, at in K.slices(data, offs):
                for r, (text, _, full) in _find(part, at, tagger).items():
                    if full:
                        out, end = [], 0
                        for kind, a, b in sorted(full, key=lambda s: (s[1], -s[2])):
                            if b > end:
                                out += [text[end : max(a, end)], f"<{kind.upper()}>"]
                                end = b
                        changed[lo + r] = "".join(out) + text[end:]
            if changed:
                texts = column.to_pylist()
                for r, text in changed.items():
                    texts[r] = text
                columns = list(batch.columns)
                columns[place] = pa.array(texts, column.type)
                if count is not None:
                    numbers = columns[count].to_pylist()
                    for r, text in changed.items():
                        numbers[r] = len(text)
                    columns[count] = pa.array(numbers, columns[count].type)
                batch = pa.RecordBatch.from_arrays(columns, names=batch.schema.names)
            yield batch

    return docs.mapInArrow(run, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return personal_data(docs, fit(docs))
