"""Secret scans by grammar inference (operator 6).

* ``credential_matches``: the fixed patterns of the contract, with their spans.
* ``learn_formats``: builds a prefix tree over the character classes of labelled
  credentials, one tree a kind, and merges statistically compatible states
  (Hoeffding test, red and blue states) into a probabilistic automaton.
* ``find_secrets``: fixed matches, and every other credential-like run of
  characters whose likelihood under one of the automata exceeds that under the
  automaton of ordinary runs by ``min_gain`` nats.  Runs are cut at the bounds of fixed
  matches, and what is left is scored whole and between separators (``/``, ``=``, ``.``);
  of spans that overlap, the likeliest stays.

Nulls and edge cases: a null or empty text has no spans; repeated rows are judged row
by row; without labelled credentials or ordinary runs only fixed matches are
found; empty tables give empty results; columns other than id and text are ignored.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hirelake.llm import textbuf as tb
from hirelake.session import materialize

#: Fixed patterns of the contract, in the order in which they are listed, and
#: the least length of the group that counts.
KINDS = ("assign", "access", "hex")
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
                     re.IGNORECASE | re.ASCII)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
MIN_LENGTH = {"assign": 6, "access": 20, "hex": 24}
#: Words one of which any ``assign`` match has, in lower case.
_KEYWORDS = (b"passw", b"secret", b"token", b"apikey", b"api_key")

#: Characters of a candidate run, and their classes: digits, a-f, g-z, A-F, G-Z, rest.
_RUN = np.zeros(256, bool)
_RUN[list(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_.=-")] = True
_HEX = np.zeros(256, bool)
_HEX[list(b"0123456789abcdef")] = True
_CLASS = np.full(256, 5, np.int8)
_CLASS[48:58] = 0
_CLASS[97:103] = 1
_CLASS[103:123] = 2
_CLASS[65:71] = 3
_CLASS[71:91] = 4
N_CLASSES = 6
#: Characters in each class, for the likelihood of a character within it.
_CLASS_SIZE = np.array([10, 6, 20, 6, 20, 6])
MIN_RUN = 16
#: Characters that may join a credential to something else.
_SEPARATOR = np.zeros(256, bool)
_SEPARATOR[list(b"/=.")] = True


def _runs(inside: np.ndarray, least: int, cuts: np.ndarray | None = None):
    """Maximal runs of true of at least ``least``; none crosses a cut."""
    edge = np.concatenate(([False], inside, [False]))
    begin = edge[1:] & ~edge[:-1]
    stop = ~edge[1:] & edge[:-1]
    if cuts is not None and len(cuts):
        both = cuts[(cuts > 0) & (cuts < len(inside))]
        both = both[inside[both - 1] & inside[both]]
        begin[both] = True
        stop[both] = True
    a, b = np.flatnonzero(begin), np.flatnonzero(stop)
    long = b - a >= least
    return a[long], b[long]


def _fixed(texts: tb.Texts) -> list[tuple[int, int, int, int, int]]:
    """``(document, start byte, end byte, kind, start byte of the credential)``."""
    found = []
    low = tb.LOWER[texts.data].tobytes()
    if any(k in low for k in _KEYWORDS):
        for d in range(texts.n):
            a, b = int(texts.off[d]), int(texts.off[d + 1])
            if any(low.find(k, a, b) >= 0 for k in _KEYWORDS):
                # The pattern is ASCII, so it can run on bytes read as Latin-1.
                text = texts.data[a:b].tobytes().decode("latin-1")
                found += [(d, a + m.start(), a + m.end(), 0, a + m.start(2)) for m in _ASSIGN.finditer(text)
                          if m.end(2) - m.start(2) >= MIN_LENGTH["assign"]]
    raw = texts.data.tobytes()
    if b"AKIA" in raw:
        for d in range(texts.n):
            a, b = int(texts.off[d]), int(texts.off[d + 1])
            if raw.find(b"AKIA", a, b) >= 0:
                found += [(d, a + m.start(), a + m.end(), 1, a + m.start())
                          for m in _ACCESS.finditer(raw[a:b].decode("latin-1"))
                          if m.end() - m.start() >= MIN_LENGTH["access"]]
    a, b = _runs(_HEX[texts.data], MIN_LENGTH["hex"], texts.off)
    doc = np.searchsorted(texts.off, a, side="right") - 1
    found += [(int(d), int(x), int(y), 2, int(x)) for d, x, y in zip(doc, a, b, strict=True)]
    return sorted(found, key=lambda f: (f[0], f[1], f[3]))


def _candidates(texts: tb.Texts) -> tuple[np.ndarray, np.ndarray]:
    return _runs(_RUN[texts.data], MIN_RUN, texts.off)


def credential_samples(docs: DataFrame, sample: int = 3000, id_col: str = "doc_id",
                       text_col: str = "text") -> DataFrame:
    """A bounded sample of labelled strings: ``(kind, value)``, for each kind
    and for ``ordinary`` (runs that hold no fixed match) the ``sample``
    distinct values with the smallest crc32."""

    def run(batches: Iterator[pa.RecordBatch]):
        # A task keeps the values of smallest crc32 only, as the sample does.
        import zlib
        kept: dict[str, dict[bytes, int]] = {k: {} for k in (*KINDS, "ordinary")}

        def trim(kind, to):
            if len(kept[kind]) > to:
                kept[kind] = dict(sorted(kept[kind].items(), key=lambda x: (x[1], x[0]))[:sample])

        for batch in tb.slices(batches):
            texts = tb.Texts(batch.column(0))
            fixed = _fixed(texts)
            for _, _, b, kind, value in fixed:
                v = texts.data[value:b].tobytes()
                kept[KINDS[kind]].setdefault(v, zlib.crc32(v))
            a, b = _candidates(texts)
            taken = np.zeros(len(texts.data) + 1, np.int32)
            for _, x, y, _, _ in fixed:
                taken[x:y] = 1
            covered = np.concatenate(([0], np.cumsum(taken)))
            free = covered[b] == covered[a]
            for x, y in zip(a[free].tolist(), b[free].tolist(), strict=True):
                v = texts.data[x:y].tobytes()
                kept["ordinary"].setdefault(v, zlib.crc32(v))
            for kind in kept:
                trim(kind, 20 * sample)
        for kind in kept:
            trim(kind, sample)
        yield pa.RecordBatch.from_arrays(
            [pa.array([k for k, v in kept.items() for _ in v], pa.string()),
             pa.array([x.decode() for v in kept.values() for x in v], pa.string())], ["kind", "value"])

    values = materialize(docs.select(F.col(text_col).alias("text")).mapInArrow(run, "kind string, value string")
                         .distinct(), "credentials")
    picked = None
    for kind in (*KINDS, "ordinary"):
        part = values.where(F.col("kind") == kind).orderBy(F.crc32("value"), "value").limit(sample)
        picked = part if picked is None else picked.unionAll(part)
    return picked


@dataclass(frozen=True)
class FormatAutomaton:
    """Probabilistic automaton over character classes: ``go[state, class]`` is
    the next state (-1: none), ``logp[state, class]`` and ``stop[state]`` the log
    probabilities of a class and of the end."""

    go: np.ndarray
    logp: np.ndarray
    stop: np.ndarray

    def score(self, codes: np.ndarray, off: np.ndarray) -> np.ndarray:
        """Log likelihood of each string of class codes."""
        length = np.diff(off)
        order = np.argsort(-length, kind="stable")
        begin, length = off[:-1][order], length[order]
        state, total = np.zeros(len(length), np.int64), np.zeros(len(length))
        for t in range(int(length[0]) if len(length) else 0):
            k = int(np.searchsorted(-length, -t, side="left"))
            c = codes[begin[:k] + t]
            s = state[:k]
            total[:k] += self.logp[s, c]
            state[:k] = np.where(self.go[s, c] >= 0, self.go[s, c], s)
        total += self.stop[state]
        out = np.empty_like(total)
        out[order] = total
        return out


def learn_automaton(values: list[bytes], alpha: float = 0.05, least: int = 10) -> FormatAutomaton:
    """Prefix tree of ``values`` with compatible states merged.

    Two states are compatible if the shares of every class and of the end
    differ by no more than the Hoeffding bound at ``alpha``, and so for the states
    they lead to.  States seen fewer than ``least`` times merge into the first
    state that fits."""
    children: list[dict[int, int]] = [{}]
    passes: list[list[int]] = [[0] * N_CLASSES]
    ends, seen = [0], [0]
    for value in values:
        node = 0
        seen[0] += 1
        for c in _CLASS[np.frombuffer(value, np.uint8)].tolist():
            passes[node][c] += 1
            if c not in children[node]:
                children[node][c] = len(children)
                children.append({})
                passes.append([0] * N_CLASSES)
                ends.append(0)
                seen.append(0)
            node = children[node][c]
            seen[node] += 1
        ends[node] += 1
    width = math.sqrt(0.5 * math.log(2 / alpha))

    def differ(f1, n1, f2, n2):
        return abs(f1 / n1 - f2 / n2) > width * (1 / math.sqrt(n1) + 1 / math.sqrt(n2))

    def compatible(a, b):
        todo = [(a, b)]
        while todo:
            x, y = todo.pop()
            if not seen[x] or not seen[y]:
                continue
            if differ(ends[x], seen[x], ends[y], seen[y]) or any(
                    differ(passes[x][c], seen[x], passes[y][c], seen[y]) for c in range(N_CLASSES)):
                return False
            todo += [(children[x][c], children[y][c]) for c in children[x] if c in children[y] and
                     min(seen[children[x][c]], seen[children[y][c]]) >= least]
        return True

    def fold(a, b):
        """Merge the tree below ``b`` into ``a``."""
        todo = [(a, b)]
        while todo:
            x, y = todo.pop()
            if x == y:
                continue
            seen[x] += seen[y]
            ends[x] += ends[y]
            for c in range(N_CLASSES):
                passes[x][c] += passes[y][c]
            for c, to in children[y].items():
                if c in children[x]:
                    todo.append((children[x][c], to))
                else:
                    children[x][c] = to

    red = [0]
    blue = [(0, c) for c in sorted(children[0])]
    while blue:
        parent, c = blue.pop(0)
        node = children[parent][c]
        if node in red:
            continue
        for r in red:
            if compatible(r, node):
                children[parent][c] = r
                fold(r, node)
                break
        else:
            red.append(node)
        blue = [(r, c) for r in red for c in sorted(children[r]) if children[r][c] not in red]
    number = {r: i for i, r in enumerate(red)}
    go = np.full((len(red), N_CLASSES), -1)
    logp, stop = np.zeros((len(red), N_CLASSES)), np.zeros(len(red))
    for r, i in number.items():
        total = seen[r] + 0.1 * (N_CLASSES + 1)
        for c in range(N_CLASSES):
            logp[i, c] = math.log((passes[r][c] + 0.1) / total) - math.log(_CLASS_SIZE[c])
            if c in children[r]:
                go[i, c] = number[children[r][c]]
        stop[i] = math.log((ends[r] + 0.1) / total)
    return FormatAutomaton(go, logp, stop)


def learn_formats(docs: DataFrame, sample: int = 3000, least_values: int = 20, **columns) -> dict[str, FormatAutomaton]:
    """One automaton for each kind with ``least_values`` distinct credentials or
    more, and one for ``ordinary`` runs; learnt from at most ``sample`` distinct
    values each, which is all that reaches the driver."""
    values: dict[str, list[bytes]] = {}
    for r in credential_samples(docs, sample, **columns).collect():
        values.setdefault(r.kind, []).append(r.value.encode())
    return {k: learn_automaton(sorted(v)) for k, v in values.items() if len(v) >= least_values or k == "ordinary"}


SCHEMA = "doc_id long, secrets array<struct<kind:string,start:long,end:long,gain:double>>"


def _learned(texts: tb.Texts, fixed, formats, min_gain: float):
    """Candidates, clear of fixed matches, that a format explains better."""
    ordinary = formats.get("ordinary")
    others = [a for k, a in formats.items() if k != "ordinary"]
    if ordinary is None or not others or not len(texts.data):
        return []
    free = _RUN[texts.data]
    for _, x, y, _, _ in fixed:
        free[x:y] = False
    whole = np.stack(_runs(free, MIN_RUN, texts.off))
    parts = np.stack(_runs(free & ~_SEPARATOR[texts.data], MIN_RUN, texts.off))
    # Separators at the ends of a run don't belong to a credential.
    joint = np.concatenate(([0], np.cumsum(~_SEPARATOR[texts.data])))
    inner = np.searchsorted(joint, joint[whole[0]], side="right") - 1, np.searchsorted(joint, joint[whole[1]], side="left")
    a, b = np.unique(np.concatenate((np.stack(inner), parts), axis=1), axis=1)
    a, b = a[b - a >= MIN_RUN], b[b - a >= MIN_RUN]
    if not len(a):
        return []
    size = b - a
    off = np.concatenate(([0], np.cumsum(size)))
    index = np.arange(off[-1]) - np.repeat(off[:-1] - a, size)
    codes = _CLASS[texts.data[index]]
    gain = np.max([m.score(codes, off) for m in others], axis=0) - ordinary.score(codes, off)
    hit = np.flatnonzero(gain >= min_gain)
    taken: dict[int, list[tuple[int, int]]] = {}
    kept = []
    for i in hit[np.argsort(-gain[hit], kind="stable")].tolist():
        # The parts of a run lie in it: only spans of the same document can overlap.
        doc = int(np.searchsorted(texts.off, a[i], side="right")) - 1
        own = taken.setdefault(doc, [])
        if all(b[i] <= x or y <= a[i] for x, y in own):
            own.append((int(a[i]), int(b[i])))
            kept.append((doc, int(a[i]), int(b[i]), 3, float(gain[i])))
    return kept


def find_secrets(docs: DataFrame, formats: dict[str, FormatAutomaton], min_gain: float = 15.0,
                 id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, secrets)``, one row per row of ``docs``: spans in code points
    (end exclusive) by start, then kind as in ``KINDS``; learnt spans, which
    never overlap a fixed one, have the kind ``format``."""

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in tb.slices(batches):
            texts = tb.Texts(batch.column(1))
            offsets, spans = _spans(texts, formats, min_gain)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.ListArray.from_arrays(offsets, spans)], ["doc_id", "secrets"])

    data = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return data.mapInArrow(run, SCHEMA)


def _all(texts: tb.Texts, formats, min_gain: float):
    fixed = _fixed(texts)
    found = [(d, a, b, k, None) for d, a, b, k, _ in fixed] + _learned(texts, fixed, formats, min_gain)
    return sorted(found, key=lambda f: f[:2] + (f[3],))


def _spans(texts: tb.Texts, formats, min_gain: float):
    found = _all(texts, formats, min_gain)
    doc = np.array([f[0] for f in found], np.int64)
    start = np.array([f[1] for f in found], np.int64)
    end = np.array([f[2] for f in found], np.int64)
    if found:
        base = texts.points[texts.off[doc]]
        start, end = texts.points[start] - base, texts.points[end] - base
    names = (*KINDS, "format")
    spans = pa.StructArray.from_arrays(
        [pa.array([names[f[3]] for f in found], pa.string()), pa.array(start, pa.int64()), pa.array(end, pa.int64()),
         pa.array([f[4] for f in found], pa.float64())], ["kind", "start", "end", "gain"])
    return pa.array(np.searchsorted(doc, np.arange(texts.n + 1)).astype(np.int32)), spans


def mask_secrets(docs: DataFrame, formats: dict[str, FormatAutomaton], mask: str = "[SECRET]",
                 min_gain: float = 15.0, text_col: str = "text") -> DataFrame:
    """``docs`` with every secret span of the text replaced by ``mask``
    (overlapping spans by one); all other columns and null texts stay."""
    names = docs.columns
    at = names.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]):
        blank = mask.encode()
        for batch in tb.slices(batches, text_col):
            texts = tb.Texts(batch.column(at))
            found = _all(texts, formats, min_gain)
            if found:
                values = batch.column(at).to_pylist()
                cut: dict[int, list] = {}
                for d, a, b, _, _ in found:
                    spans = cut.setdefault(d, [])
                    if spans and a < spans[-1][1]:
                        spans[-1][1] = max(spans[-1][1], b)
                    else:
                        spans.append([a, b])
                for d, spans in cut.items():
                    pieces, last = [], int(texts.off[d])
                    for a, b in spans:
                        pieces += [texts.data[last:a].tobytes(), blank]
                        last = b
                    values[d] = b"".join([*pieces, texts.data[last:texts.off[d + 1]].tobytes()]).decode()
                columns = list(batch.columns)
                columns[at] = pa.array(values, batch.schema.field(at).type)
                batch = pa.RecordBatch.from_arrays(columns, schema=batch.schema)
            yield batch

    return docs.mapInArrow(run, docs.schema)


def digest(found: DataFrame) -> DataFrame:
    """Counts and joined spans per document from ``find_secrets``."""
    def text(of):
        return F.array_join(F.transform(of, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    fixed = F.filter("secrets", lambda s: s["kind"] != "format")

    def count(kind):
        return F.size(F.filter("secrets", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    counts = [count(kind) for kind in KINDS]
    return found.select("doc_id", *counts, F.sha2(text(fixed), 256).alias("base_sha256"), text("secrets").alias("spans"))
