"""Request objects, without Spark: each is described by a table of its fields.

``shape`` turns such a table into a check of a whole object, and ``must`` a test into
a check of one value; a check takes a value and its place in the request and returns
what it stands for.  A null field counts as absent; unknown fields are refused;
lengths are UTF-8 bytes.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from collections.abc import Callable
from dataclasses import asdict, dataclass, field
from types import SimpleNamespace
from typing import Any

import numpy as np

from veritome.errors import BAD_JSON, BAD_TEXT, INVALID, EvidenceError, invalid, limit_exceeded

# Size limits.
MAX_SPANS = 65_536
SPAN_BYTES_FACTOR = 4
MAX_EMBEDDING_VALUES = 1 << 20
MAX_PATH_BYTES = MAX_REASON_BYTES = 1024
MAX_KEY_BYTES = MAX_MODEL_BYTES = 256
MAX_TAG_BYTES = 128
MAX_TAGS = 64
MAX_DIMENSIONS = 2000
INT4, INT8 = 2**31 - 1, 2**63 - 1
SCHEMA_VERSION = 1
MAX_DEPTH = 128
RESERVED_NAMES = {"information_schema", "public", "evidence"}
TEXT_SEARCH_CONFIGS = {"simple", "pg_catalog.simple"}

Check = Callable[[Any, str], Any]
#: In a table of fields: no value, no default.
NEEDED = object()


def decode(request: Any) -> Any:
    """A request given as JSON text or as an object; what the store cannot hold or nests too deeply is refused."""
    if isinstance(request, (str, bytes)):
        try:
            request = json.loads(request)
        except (ValueError, RecursionError):
            raise EvidenceError(BAD_JSON, "invalid_json", "this is no JSON") from None
    level, depth = [request], 0
    while level:
        depth += 1
        if depth > MAX_DEPTH:
            raise invalid("request", f"objects and arrays may nest {MAX_DEPTH} deep")
        if any(isinstance(x, str) and "\0" in x for x in level):
            raise EvidenceError(BAD_TEXT, "unsupported_character", "U+0000 cannot be stored")
        level = [y for x in level if isinstance(x, (dict, list)) for y in ([*x.keys(), *x.values()] if isinstance(x, dict) else x)]
    return request


def size(text: str) -> int:
    return len(text.encode("utf-8", "surrogatepass"))


# ---- checks -------------------------------------------------------------------


def must(test: Callable[[Any], bool], wanted: str) -> Check:
    def check(value: Any, at: str) -> Any:
        if not test(value):
            raise invalid(at, f"{at or 'request'}: expected {wanted}")
        return value

    return check


def shape(fields: dict[str, Check | tuple[Check, Any]]) -> Check:
    """A check of an object by the checks of its fields, each alone (needed) or with a default, in the order of the table."""

    def check(value: Any, at: str = "") -> SimpleNamespace:
        given = _object(value, at)
        place = {k: f"{at}.{k}" if at else k for k in [*given, *fields]}
        for key in given.keys() - fields.keys():
            raise invalid(place[key], f"{place[key]}: no such field")
        out = {}
        for key, entry in fields.items():
            test, default = entry if isinstance(entry, tuple) else (entry, NEEDED)
            if given.get(key) is not None:
                out[key] = test(given[key], place[key])
            elif default is NEEDED:
                raise invalid(place[key], f"{place[key]}: missing")
            else:
                out[key] = default
        return SimpleNamespace(**out)

    return check


def listed(item: Check, least: int = 0, most: int | None = None, repeats: bool = True) -> Check:
    """A check of an array by that of its items; a tuple."""

    def check(value: Any, at: str) -> tuple:
        items = array(value, at)
        if len(items) < least or (most is not None and len(items) > most):
            raise invalid(at, f"{at}: expected {least} to {most} items, not {len(items)}")
        out: list = []
        for i, one in enumerate(items):
            read = item(one, f"{at}[{i}]")
            if not repeats and read in out:
                raise invalid(f"{at}[{i}]", f"{at}[{i}]: named before")
            out.append(read)
        return tuple(out)

    return check


def at_most(limit: str, most: int, check: Check) -> Check:
    """``check``, and the named limit."""

    def bounded(value: Any, at: str) -> int:
        if check(value, at) > most:
            raise limit_exceeded(limit, most, f"{at}: {limit} is {most}")
        return value

    return bounded


def _storable(value: Any) -> bool:
    return isinstance(value, str) and not re.search("[\0\ud800-\udfff]", value)


def _matching(pattern: str, wanted: str) -> Check:
    return must(lambda v: _storable(v) and re.fullmatch(pattern, v) is not None, wanted)


_object = must(lambda v: isinstance(v, dict), "an object")
string = must(_storable, "text without U+0000 and lone surrogates")
boolean = must(lambda v: isinstance(v, bool), "true or false")
array = must(lambda v: isinstance(v, list), "an array")
positive = must(lambda v: type(v) is int and 1 <= v < 2**32, "an integer from 1 to 4294967295")
digest = _matching("[0-9a-f]{64}", "64 digits of lowercase hexadecimal")
relation_kind = _matching("[a-z][a-z0-9_]{0,62}", "a name: a-z, then up to 62 of a-z, 0-9 and _")


def uint(most: int) -> Check:
    return must(lambda v: type(v) is int and 0 <= v <= most, f"an integer from 0 to {most}")


def text(most: int, controls: bool = False) -> Check:
    fits = lambda v: _storable(v) and 1 <= size(v) <= most and (controls or "Cc" not in map(unicodedata.category, v))
    return must(fits, f"text of 1 to {most} bytes" + ("" if controls else " without control characters"))


tag = text(MAX_TAG_BYTES)
_uuid = _matching("(?i)[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}", "a UUID with hyphens")


def uuid(value: Any, at: str) -> str:
    return _uuid(value, at).lower()


def vector(dimensions: int) -> Check:
    """A check of numbers that are finite as 4-byte floats and not all zero."""

    def check(value: Any, at: str) -> list[float]:
        numeric = all(type(x) in (int, float) for x in array(value, at))
        if not numeric or len(value) != dimensions:
            raise invalid(at, f"{at}: expected {dimensions} numbers")
        with np.errstate(over="ignore"):
            singles = np.array([x if abs(x) < 1e300 else np.inf for x in value], np.float64).astype(np.float32)
        if not np.isfinite(singles).all() or not singles.any():
            raise invalid(at, f"{at}: expected finite 4-byte floats, one of them not zero")
        return singles.astype(float).tolist()

    return check


def corpus_name(name: str) -> str:
    if not re.fullmatch("[a-z][a-z0-9_]{0,47}", name) or name.startswith("pg_") or name in RESERVED_NAMES:
        raise invalid("corpus", f'"{name}" cannot name a corpus: a-z, then up to 47 of a-z, 0-9 and _, and not a reserved name')
    return name


# ---- collection configuration -----------------------------------------------


@dataclass(frozen=True)
class Limits:
    max_source_bytes: int = 1 << 20
    max_response_bytes: int = 64 << 10
    max_candidates_per_operator: int = 256
    max_plan_nodes: int = 32
    max_edges_returned: int = 1024


CEILING = Limits(64 << 20, 16 << 20, 10_000, 256, 100_000)


@dataclass(frozen=True)
class Config:
    embedding_model: str | None = None
    embedding_dimensions: int | None = None
    text_search_config: str = "pg_catalog.simple"
    limits: Limits = field(default_factory=Limits)


_LIMITS = shape({name: (at_most(name, most, positive), getattr(Limits, name)) for name, most in asdict(CEILING).items()})
_CONFIG = shape({
    "embedding_model": (text(MAX_MODEL_BYTES), None),
    "embedding_dimensions": (must(lambda v: type(v) is int and 1 <= v <= MAX_DIMENSIONS, f"an integer from 1 to {MAX_DIMENSIONS}"), None),
    "text_search_config": (must(lambda v: v in TEXT_SEARCH_CONFIGS, " or ".join(sorted(TEXT_SEARCH_CONFIGS))), "simple"),
    "limits": (_LIMITS, None),
})


def parse_config(value: Any) -> Config:
    m = _CONFIG(value, "config")
    if (m.embedding_model is None) != (m.embedding_dimensions is None):
        raise invalid("config.embedding_dimensions", "a model and its dimensions are given together")
    return Config(m.embedding_model, m.embedding_dimensions, limits=Limits(**vars(m.limits)) if m.limits else Limits())


# ---- mutations --------------------------------------------------------------


def utf8_boundary(raw: bytes, at: int) -> bool:
    """Whether no character spreads over this place."""
    return not 0x80 <= int.from_bytes(raw[at : at + 1]) < 0xC0


@dataclass(frozen=True)
class Stage:
    asset_id: str
    path: str
    source: str
    source_sha256: str
    spans: tuple[tuple[int, int], ...]
    ingestion_key: str
    expected_revision: int

    def request_sha256(self) -> str:
        """Digest of the canonical request: everything but the key, spans in request order."""
        body = {"asset_id": self.asset_id, "expected_revision": self.expected_revision, "path": self.path, "source_sha256": self.source_sha256, "spans": [list(s) for s in self.spans]}
        return hashlib.sha256(json.dumps(body, ensure_ascii=False, separators=(",", ":")).encode()).hexdigest()


_SPAN = shape({"start_byte": uint(INT4), "end_byte": uint(INT4)})
_STAGE = {"asset_id": uuid, "path": text(MAX_PATH_BYTES), "ingestion_key": text(MAX_KEY_BYTES), "expected_revision": uint(INT8)}


def span_faults(start: np.ndarray, end: np.ndarray, raw: bytes, most: int) -> tuple[np.ndarray, np.ndarray]:
    """For each span: 0, or 1 if it is not within the source, 2 if it cuts a character, 3 if it was given before; whether it and those before hold too much."""
    inside = (0 <= start) & (start < end) & (end <= len(raw))
    mid_character = np.zeros(len(raw) + 1, bool)
    mid_character[:-1] = np.frombuffer(raw, np.int8) < -64  # 10xxxxxx
    torn = np.zeros(len(start), bool)
    torn[inside] = mid_character[start[inside]] | mid_character[end[inside]]
    _, first = np.unique(start * (INT4 + 1) + end, return_index=True)
    repeated = np.ones(len(start), bool)
    repeated[first] = False
    return np.select([~inside, torn, repeated], [1, 2, 3], 0), np.cumsum(end - start) > most


def span_table(items: list, raw: bytes, most: int) -> tuple[tuple[int, int], ...]:
    """The spans of a source as pairs; the first one that breaks a rule is refused, by the first rule it breaks."""
    read, unreadable = [], None
    for i, item in enumerate(items):
        try:
            read.append(_SPAN(item, f"spans[{i}]"))
        except EvidenceError as error:  # an earlier span may break a rule
            unreadable = error
            break
    start, end = (np.array([getattr(s, k) for s in read], np.int64) for k in ("start_byte", "end_byte"))
    faulty, heavy = span_faults(start, end, raw, most)
    for i in np.flatnonzero((faulty > 0) | heavy)[:1].tolist():
        if faulty[i]:
            why = ("", f"not within 0 to {len(raw)}", "cuts a character", "given before")[faulty[i]]
            raise invalid(f"spans[{i}]", f"spans[{i}]: {why}")
        raise limit_exceeded("max_span_bytes_total", most, f"the spans together may hold {most} bytes")
    if unreadable:
        raise unreadable
    return tuple(zip(start.tolist(), end.tolist()))


def parse_stage(value: Any, max_source_bytes: int) -> Stage:
    raw = b""

    def source(value: Any, at: str) -> str:
        nonlocal raw
        raw = string(value, at).encode()
        if len(raw) > max_source_bytes:
            raise limit_exceeded("max_source_bytes", max_source_bytes, f"the source has {len(raw)} bytes, the collection takes {max_source_bytes}")
        return value

    def source_sha256(value: Any, at: str) -> str:
        if digest(value, at) != (computed := hashlib.sha256(raw).hexdigest()):
            raise EvidenceError(INVALID, "source_sha256_mismatch", "this is not the digest of the source", field=at, computed=computed)
        return value

    def spans(value: Any, at: str) -> tuple:
        if len(array(value, at)) > MAX_SPANS:
            raise limit_exceeded("max_spans_per_version", MAX_SPANS, f"a version has at most {MAX_SPANS} spans")
        return span_table(value, raw, SPAN_BYTES_FACTOR * max_source_bytes)

    return Stage(**vars(shape(_STAGE | {"source": source, "source_sha256": source_sha256, "spans": spans})(value)))


def parse_attach(value: Any, model: str, dimensions: int) -> tuple[str, list[tuple[str, list[float]]]]:
    pair = shape({"evidence_id": uuid, "vector": vector(dimensions)})

    def embeddings(value: Any, at: str) -> dict[str, list[float]]:
        n = len(array(value, at))
        for limit, most, have in (("max_spans_per_version", MAX_SPANS, n), ("max_embedding_values_per_call", MAX_EMBEDDING_VALUES, n * dimensions)):
            if have > most:
                raise limit_exceeded(limit, most, f"{at}: {limit} is {most}; use several calls")
        out: dict[str, list[float]] = {}
        for i, read in enumerate(listed(pair, 1)(value, at)):
            if out.setdefault(read.evidence_id, read.vector) is not read.vector:
                raise invalid(f"{at}[{i}]", f"{at}[{i}]: its evidence_id came before")
        return out

    m = shape({"version_id": uuid, "model": must(lambda v: v == model, f'the collection\'s model "{model}"'), "embeddings": embeddings})(value)
    return m.version_id, list(m.embeddings.items())


_PUBLISH = shape({"version_id": uuid})
_RETIRE = shape({"asset_id": uuid, "expected_revision": uint(INT8)})
_PURGE = shape({"version_id": uuid, "reason": text(MAX_REASON_BYTES)})
_TAGGING = shape({"action": string, "asset_id": uuid, "expected_annotation_revision": uint(INT8), "tags": listed(tag, 1, MAX_TAGS, repeats=False)})
_LINKING = shape({"action": string, "source_evidence_id": uuid, "target_evidence_id": uuid, "kind": relation_kind})
#: The shape of each action, and whether it adds.
ACTIONS = {"tag": (_TAGGING, True), "untag": (_TAGGING, False), "link": (_LINKING, True), "unlink": (_LINKING, False)}


def parse_publish(value: Any) -> str:
    return _PUBLISH(value).version_id


def parse_retire(value: Any) -> tuple[str, int]:
    m = _RETIRE(value)
    return m.asset_id, m.expected_revision


def parse_purge(value: Any) -> tuple[str, str]:
    m = _PURGE(value)
    return m.version_id, m.reason


@dataclass(frozen=True)
class TagChange:
    add: bool
    asset_id: str
    tags: tuple[str, ...]
    expected: int


@dataclass(frozen=True)
class LinkChange:
    add: bool
    source: str
    target: str
    kind: str


def parse_annotate(value: Any) -> TagChange | LinkChange:
    action = value.get("action") if isinstance(value, dict) else None
    if not isinstance(action, str) or action not in ACTIONS:
        raise invalid("action", f"action: expected one of {', '.join(ACTIONS)}")
    read, adds = ACTIONS[action]
    m = read(value)
    if read is _TAGGING:
        return TagChange(adds, m.asset_id, m.tags, m.expected_annotation_revision)
    if m.source_evidence_id == m.target_evidence_id:
        raise invalid("target_evidence_id", "target_evidence_id: expected other evidence than the source's")
    return LinkChange(adds, m.source_evidence_id, m.target_evidence_id, m.kind)
