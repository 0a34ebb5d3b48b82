"""Personal data by base patterns and a skip-chain conditional random field.

Patterns find addresses of mail and hosts, card numbers and telephone numbers; these spans stand. Around them a
conditional random field labels tokens: neighbours in the text share a potential, and so do distant tokens that
repeat each other or resemble each other (the same digits, the name before an @), whatever lies between them.
Sum-product messages pass over this graph, which has loops, a fixed number of times; tokens under base spans
are observed, so what is certain in one place settles what is doubtful in another. Tokens that can hold
nothing personal (no digit, no @, no name of a mail address) are outside, which is where the graph parts.
"""

from __future__ import annotations

import dataclasses
import functools
import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm.common import table

KINDS = ("email", "ip", "card", "phone")
LABELS = len(KINDS) + 1  # 0: nothing personal
#: Passes of messages, the share of the former message that stays, and tokens that pass them at a time.
PASSES, DAMPING, AT_ONCE = 24, 0.3, 1 << 16
#: Characters of texts that are looked at together.
TOGETHER = 1 << 20

# The base patterns, made so that each is read in linear time.
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_AT = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
_IP = re.compile(r"([0-9]++)(?:\.([0-9]++)\.([0-9]++)\.([0-9]++))?")  # other runs of digits are passed over whole
_CARD = re.compile(r"[0-9](?:[ -]?+[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")

_HOLDS = re.compile(r"[0-9@]")
_TOKEN = re.compile(r"\S+")
_CORE = re.compile(r"[^\W_](?:.*[^\W_])?", re.DOTALL)


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def passes_luhn(digits: str) -> bool:
    back = [ord(c) - 48 for c in reversed(digits)]
    return (sum(back[::2]) + sum(2 * d - 9 * (d > 4) for d in back[1::2])) % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of all base spans, by start and kind; ends are exclusive."""
    out, behind, at = [], 0, text.find("@")
    while at >= 0:
        # the name before an @ reaches back to the last mail address or other character
        if domain := _AT.match(text, at):
            start = at
            while start > behind and text[start - 1] in _LOCAL:
                start -= 1
            if start < at:
                out.append((start, 0, domain.end()))
                behind = domain.end()
        before, at = at, text.find("@", at + 1)
        behind = max(behind, before + 1)
    if _HOLDS.search(text):
        for m in _IP.finditer(text):
            if m[2] and all(len(part.lstrip("0")) <= 3 and int(part.lstrip("0") or 0) <= 255 for part in m.groups()):
                out.append((m.start(), 1, m.end()))
        for m in _CARD.finditer(text):
            if len(m[0]) <= 37 and 14 <= len(digits := _digits(m[0])) <= 19 and passes_luhn(digits):
                out.append((m.start(), 2, m.end()))
        for m in _PHONE.finditer(text):
            if 10 <= sum("0" <= c <= "9" for c in m[0]) <= 15:
                out.append((m.start(), 3, m.end()))
    return sorted(out)


@dataclasses.dataclass
class Graph:
    """Tokens of one text that the field labels, and the edges between them."""

    spans: list[tuple[int, int]]
    observed: np.ndarray  # label of tokens under base spans, -1 elsewhere
    features: list[list[int]]
    chain: list[tuple[int, int]]  # tokens that follow each other
    skip: list[tuple[int, int, int]]  # tokens that resemble each other, and how
    label: np.ndarray | None = None  # where known, for fitting


FEATURES = 64
#: How tokens resemble each other: the same characters, the same last digits, or the name of a mail address.
SAME, DIGITS, NAME = 0, 1, 2


def _features(core: str, whole: str, before: str, after: str) -> list[int]:
    """Numbers of the features that hold: shape, marks, checks, and what stands on either side."""
    n = sum("0" <= c <= "9" for c in core)
    letters = sum(c.isalpha() for c in core)
    out = [0, 1 + min(n, 20)]
    out.append(22 + (0 if not letters else 1 if letters < n else 2))
    for k, mark in enumerate("@.-()+/:,="):
        if mark in whole:
            out.append(25 + k)
    out.append(35 + min(core.count("."), 4))
    if letters == 0 and n:
        parts = [len(p) for p in re.split(r"[^0-9]+", whole) if p]
        out.append(40 + (0 if parts == [3] else 1 if parts == [3, 4] else 2 if parts in ([3, 3, 4], [3, 7]) else 3 if len(parts) == 1 else 4))
        if whole[0] == "(" and whole[-1] == ")":
            out.append(45)
        if 14 <= n <= 19:
            out.append(46 + passes_luhn(_digits(core)))
    if re.fullmatch(r"[0-9a-fA-F]{16,}", core) and letters:
        out.append(48)
    out.append(49 + (2 if not before else 1 if _HOLDS.search(before) else 0))
    out.append(52 + (2 if not after else 1 if _HOLDS.search(after) else 0))
    if re.fullmatch(r"[0-9]{4}", core) and "1800" <= core <= "2099":
        out.append(55)
    if core[:1] == "v" or before.rstrip(":").lower() in ("version", "v", "no", "no.", "section", "page", "chapter"):
        out.append(56)
    return out


def _candidates(text: str, names: set[str]) -> Iterator[tuple[int, int, str]]:
    """(start, end, lower-case core) of the tokens that can be personal."""
    if any(not _HOLDS.search(name) for name in names):
        for m in _TOKEN.finditer(text):
            if (core := _CORE.search(m[0])) and (_HOLDS.search(m[0]) or core[0].lower() in names):
                yield *m.span(), core[0].lower()
        return
    at = 0
    while m := _HOLDS.search(text, at):
        start = m.start()
        while start > at and not text[start - 1].isspace():
            start -= 1
        at = _TOKEN.match(text, start).end()
        if core := _CORE.search(text[start:at]):
            yield start, at, core[0].lower()


def read_graph(text: str, base: list[tuple[int, int, int]]) -> Graph:
    """The graph of a text. Names of mail addresses may stand alone elsewhere, if they have a mark or a digit in them."""
    names = {text[start:end].partition("@")[0].strip("._%+-").lower() for start, kind, end in base if kind == 0}
    names = {name for name in names if len(name) >= 6 and re.search(r"[a-z][._0-9-]", name)}
    graph, observed, cores, at = Graph([], np.zeros(0), [], [], []), [], [], 0
    runs: list[list[int]] = []  # tokens with nothing but blanks between them
    for start, end, core in _candidates(text, names):
        while at < len(base) and base[at][2] <= start:
            at += 1
        under = [kind for a, kind, b in base[at : at + 8] if a < end and b > start]
        left, right = text[max(0, start - 40) : start].split(), text[end : end + 40].split()
        index = len(graph.spans)
        if index and not (between := text[graph.spans[-1][1] : start]).strip() and "\n" not in between:
            graph.chain.append((index - 1, index))
            runs[-1].append(index)
        else:
            runs.append([index])
        graph.spans.append((start, end))
        observed.append(1 + under[0] if under else -1)
        cores.append(core)
        graph.features.append(_features(core, text[start:end], left[-1] if left else "", right[0] if right else ""))
    graph.observed = np.array(observed, dtype=np.int64)
    keys: dict[tuple[int, str], list[int]] = {}
    for k, core in enumerate(cores):
        keys.setdefault((SAME, core), []).append(k)
        if len(digits := _digits(core)) >= 7:
            keys.setdefault((DIGITS, digits[-7:]), []).append(k)
        if (name := core.partition("@")[0].strip("._%+-")) in names:
            keys.setdefault((NAME, name), []).append(k)
    for run in runs:  # a number may be spread over tokens
        if 1 < len(run) <= 8 and len(digits := "".join(_digits(cores[k]) for k in run)) >= 7:
            keys.setdefault((DIGITS, digits[-7:]), []).extend(run)
    # each token meets the first observed one that it resembles, or else the last one before it
    seen = set()
    for (how, _), group in keys.items():
        group = sorted(set(group))
        anchor = next((k for k in group if observed[k] >= 0), None)
        for a, b in zip(group, group[1:]) if anchor is None else ((anchor, k) for k in group if observed[k] < 0):
            if (a, b) not in seen:
                seen.add((a, b))
                graph.skip.append((a, b, how))
    return graph


@dataclasses.dataclass
class Field:
    """Weights of the field: of features by label, of neighbours' labels, and of like tokens' labels by how they are alike."""

    node: np.ndarray
    chain: np.ndarray
    skip: np.ndarray


@dataclasses.dataclass
class Edges:
    """Edges of many graphs in both directions; the k-th of the first half is the k-th of the second, turned."""

    source: np.ndarray
    target: np.ndarray
    kind: np.ndarray  # 0 chain, 1 + how for the others


def _joined(graphs: list[Graph]) -> tuple[np.ndarray, np.ndarray, np.ndarray, Edges]:
    """Features (flat), the token of each, observed labels, and edges of all graphs."""
    first = np.cumsum([0, *(len(g.spans) for g in graphs)])
    flat = [f for g in graphs for own in g.features for f in own]
    owner = np.repeat(np.arange(first[-1]), [len(own) for g in graphs for own in g.features]) if flat else np.zeros(0, np.int64)
    edges = [(first[k] + a, first[k] + b, 0) for k, g in enumerate(graphs) for a, b in g.chain] + [(first[k] + a, first[k] + b, 1 + how) for k, g in enumerate(graphs) for a, b, how in g.skip]
    e = np.array(edges, dtype=np.int64).reshape(-1, 3)
    observed = np.concatenate([g.observed for g in graphs]).astype(np.int64) if graphs else np.zeros(0, np.int64)
    return np.array(flat, dtype=np.int64), owner, observed, Edges(np.concatenate([e[:, 0], e[:, 1]]), np.concatenate([e[:, 1], e[:, 0]]), e[:, 2])


def _normal(x: np.ndarray) -> np.ndarray:
    x = x - x.max(axis=-1, keepdims=True)
    return x - np.log(np.exp(x).sum(axis=-1, keepdims=True))


def beliefs(field: Field, features: np.ndarray, owner: np.ndarray, observed: np.ndarray, edges: Edges, passes: int = PASSES, damping: float = DAMPING) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Log marginals of tokens, log joint marginals of edges (first half), and log node potentials.

    All messages pass at once, a fixed number of times, so a token's marginal hangs on its own graph alone.
    """
    n, half = len(observed), len(edges.source) // 2
    potential = np.zeros((n, LABELS))
    for label in range(LABELS):
        potential[:, label] = np.bincount(owner, weights=field.node[features, label], minlength=n)
    fixed = observed >= 0
    potential[fixed] = -1e4
    potential[fixed, observed[fixed]] = 0
    pair = np.concatenate([field.chain[None], field.skip])[edges.kind]  # of the first half, source by target
    pair = np.concatenate([pair, pair.transpose(0, 2, 1)])
    message = np.full((2 * half, LABELS), -np.log(LABELS))
    turned = np.concatenate([np.arange(half, 2 * half), np.arange(half)])

    def total() -> np.ndarray:
        out = potential.copy()
        for label in range(LABELS):
            out[:, label] += np.bincount(edges.target, weights=message[:, label], minlength=n)
        return out

    for _ in range(passes if half else 0):
        cavity = total()[edges.source] - message[turned]
        joint = pair + cavity[:, :, None]
        top = joint.max(axis=1, keepdims=True)
        new = _normal(top[:, 0] + np.log(np.exp(joint - top).sum(axis=1)))
        message = damping * message + (1 - damping) * new
    node = total()
    cavity = node[edges.source] - message[turned]
    joint = pair[:half] + cavity[:half, :, None] + cavity[half:, None, :]
    joint = _normal(joint.reshape(half, LABELS**2)).reshape(half, LABELS, LABELS)
    return _normal(node), joint, potential


def fit(graphs: list[Graph], steps: int = 150, rate: float = 0.3, decay: float = 0.02) -> Field:
    """Weights by gradients of the penalised likelihood, expectations from the messages (Adagrad, fixed steps)."""
    field = Field(np.zeros((FEATURES, LABELS)), np.zeros((LABELS, LABELS)), np.zeros((3, LABELS, LABELS)))
    features, owner, observed, edges = _joined(graphs)
    truth = np.concatenate([g.label for g in graphs])
    half = len(edges.kind)
    a, b = truth[edges.source[:half]], truth[edges.target[:half]]
    seen = [1e-3 * np.ones_like(x) for x in (field.node, field.chain, field.skip)]
    open_ = observed < 0
    for _ in range(steps):
        node, joint, _ = beliefs(field, features, owner, observed, edges, passes=8)
        miss = np.exp(node)
        miss[np.arange(len(truth)), truth] -= 1
        miss[~open_] = 0
        g_node = np.zeros_like(field.node)
        np.add.at(g_node, features, miss[owner])
        miss = np.exp(joint)
        miss[np.arange(half), a, b] -= 1
        g_chain = miss[edges.kind == 0].sum(axis=0)
        g_skip = np.stack([miss[edges.kind == 1 + how].sum(axis=0) for how in range(3)])
        g_skip = (g_skip + g_skip.transpose(0, 2, 1)) / 2  # likeness has no direction
        for x, g, s in zip((field.node, field.chain, field.skip), (g_node, g_chain, g_skip), seen):
            g = g / len(graphs) + decay * x / 10
            s += g**2
            x -= rate * g / np.sqrt(s)
    return field


def made_texts(n: int, seed: int) -> list[tuple[str, list[tuple[int, int, int]]]]:
    """Texts of made-up words with personal data in full, repeated in part or another form, and with numbers that are
    nothing personal; with the spans (start, kind, end) that are personal."""
    rng = np.random.default_rng(seed)
    syllables = ["ka", "lo", "mi", "ren", "ta", "sol", "ve", "du", "pra", "nix", "os", "el"]
    word = lambda: "".join(rng.choice(syllables) for _ in range(rng.integers(1, 4)))
    number = lambda k: "".join(map(str, rng.integers(0, 10, k)))
    mark = lambda: rng.choice(["", "", "", "", ",", ".", "!", ";", "***", "$$$"])

    def card(good: bool) -> str:
        while passes_luhn(digits := number(16)) != good:
            pass
        return digits

    out = []
    for _ in range(n):
        parts: list[tuple[str, int]] = []
        for _ in range(rng.integers(1, 5)):
            kind = int(rng.integers(0, 12))
            if kind == 0:
                name = f"{word()}{rng.choice(['.', '_', '.'])}{word()}{number(int(rng.integers(1, 3)))}"
                parts.append((f"{name}@{word()}.example.{rng.choice(['com', 'org'])}", 0))
                if rng.random() < 0.6:
                    parts.append((name, 0))
            elif kind == 1:
                parts += [(".".join(str(x) for x in rng.integers(1, 255, 4)), 1)] * int(rng.integers(1, 3))
            elif kind == 2:
                digits = card(True)
                parts.append((digits, 2))
                if rng.random() < 0.5:
                    parts.append((rng.choice([" ", "-"]).join(digits[k : k + 4] for k in range(0, 16, 4)), 2))
                if rng.random() < 0.4:
                    parts.append((digits[-7:], 2))
            elif kind == 3:
                area, front, back = number(3), number(3), number(4)
                parts.append((f"+{rng.integers(1, 60)} ({area}) {front}-{back}", 3))
                if rng.random() < 0.6:
                    parts.append((str(rng.choice([f"({area}) {front}-{back}", f"{area} {front} {back}", f"{area}-{front}-{back}", f"{area}{front}{back}", f"{front}{back}", f"{front}-{back}"])), 3))
            elif kind == 4:
                parts += [(card(False), -1)] * int(rng.integers(1, 3))
            elif kind == 5:
                parts.append((f"{rng.integers(1, 9)}.{rng.integers(0, 30)}" + rng.choice(["", f".{rng.integers(0, 9)}", "."]), -1))
            elif kind == 6:
                parts += [(" ".join(number(int(rng.integers(1, 12))) for _ in range(rng.integers(1, 4))), -1)] * int(rng.integers(1, 4))
            elif kind == 7:
                parts.append(("".join(rng.choice(list("0123456789abcdef"), 40)), -1))
            elif kind == 8:
                parts.append((f"{rng.integers(1990, 2030)}-{rng.integers(1, 13):02}-{rng.integers(1, 29):02}", -1))
            elif kind == 9:
                parts.append((f"{rng.integers(256, 999)}.{rng.integers(1, 999)}.{rng.integers(1, 999)}.{rng.integers(1, 999)}", -1))
            elif kind == 10:
                parts.append((f"{number(3)}-{number(4)}", -1))
            else:
                parts.append((f"{rng.choice(list('$#@'))}{rng.choice([number(3), word()])}", -1))
        text, spans = word(), []
        for k in rng.permutation(len(parts)):
            value, kind = parts[k]
            text += " " + " ".join(word() for _ in range(rng.integers(1, 7))) + rng.choice([" ", " ", " ", "\n"])
            if kind >= 0:
                spans.append((len(text), kind, len(text) + len(value)))
            text += value + mark()
        out.append((text + " " + word(), sorted(spans)))
    return out


@functools.cache
def default_field(n: int = 600, seed: int = 29) -> Field:
    """A field fitted on made-up texts; the same wherever it is fitted."""
    graphs = []
    for text, spans in made_texts(n, seed):
        graph = read_graph(text, base_spans(text))
        graph.label = np.array([next((1 + kind for s, kind, e in spans if s < end and e > start), 0) for start, end in graph.spans], dtype=np.int64)
        graph.label = np.where(graph.observed >= 0, graph.observed, graph.label)
        if len(graph.spans):
            graphs.append(graph)
    return fit(graphs)


def more_spans(text: str, graph: Graph, labels: np.ndarray, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Spans of tokens that the field labels outside base spans: of neighbours with one label, without marks around them."""
    out, at = [], 0
    chained = set(graph.chain)
    while at < len(labels):
        end = at + 1
        if labels[at] and graph.observed[at] < 0:
            while end < len(labels) and labels[end] == labels[at] and graph.observed[end] < 0 and (end - 1, end) in chained:
                end += 1
            start, last = graph.spans[at][0], graph.spans[end - 1][1]
            core = _CORE.search(text[start:last])
            out.append((start + core.start(), int(labels[at]) - 1, start + core.end()))
        at = end
    return out


def find(texts: list[str | None], field: Field) -> list[tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]]:
    """Of each text its base spans, and all spans: these and those that the field adds."""
    out, graphs, which = [], [], []
    for k, text in enumerate(texts):
        base = base_spans(text) if text else []
        out.append((base, base))
        if text and (base or _HOLDS.search(text)):
            graph = read_graph(text, base)
            if (graph.observed < 0).any():
                graphs.append(graph)
                which.append(k)
    at = 0
    while at < len(graphs):
        end, size = at + 1, len(graphs[at].spans)
        while end < len(graphs) and size + len(graphs[end].spans) <= AT_ONCE:
            size += len(graphs[end].spans)
            end += 1
        labels = beliefs(field, *_joined(graphs[at:end]))[0]
        # equal marginals but for rounding are ties, and nothing personal wins them
        labels = np.argmax(np.round(labels, 9), axis=1)
        first = 0
        for graph, k in zip(graphs[at:end], which[at:end]):
            own = labels[first : first + len(graph.spans)]
            first += len(graph.spans)
            out[k] = (out[k][0], sorted(out[k][0] + more_spans(texts[k], graph, own, out[k][0])))
        at = end
    return out


def spelt(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[kind]}:{start}:{end}" for start, kind, end in spans)


SCHEMA = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string"


def find_personal(docs: DataFrame, field: Field | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of ``docs``: doc_id, numbers of base spans by kind, their sha256, and all spans as text.

    Positions are code points of the whole text; null and empty texts have no spans and the sha256 of nothing. Rows
    are independent: ids may be null or repeat, other columns may have any name, and an empty table gives an
    empty table. The field (some kB) is broadcast; nothing is shuffled.
    """
    shared = docs.sparkSession.sparkContext.broadcast(field or default_field())

    def of_partition(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            while at < batch.num_rows:
                some, size = [], 0
                while at + len(some) < batch.num_rows and (not some or size < TOGETHER):
                    some.append(batch.column(1)[at + len(some)].as_py())
                    size += len(some[-1] or "")
                found = find(some, shared.value)
                counts = [[sum(s[1] == kind for s in base) for base, _ in found] for kind in range(len(KINDS))]
                digests = [hashlib.sha256(spelt(base).encode()).hexdigest() for base, _ in found]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(some)), *(pa.array(x, pa.int64()) for x in counts), pa.array(digests), pa.array([spelt(x) for _, x in found])], names=[x.split()[0] for x in SCHEMA.split(", ")])
                at += len(some)

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(of_partition, SCHEMA)


def op11_personal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_personal(table(spark, sf_dir, "documents"))
