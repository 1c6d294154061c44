"""Secret scans: fixed patterns, and a character convolutional network over every candidate in its context.

The network is plain numpy: characters are embedded by class, convolved, max-pooled
over time, and weighed by a dense layer. It is trained on labelled findings: those of
the base patterns in the documents, keys of known shapes planted into contexts of the
documents, and runs of the documents that look alike. Its scores are calibrated on a
part of them held back, and each shape's threshold is one that has
the fewest false alarms there while it finds the wanted share of the true ones. Base findings get their scores too.
"""

from __future__ import annotations

import hashlib
import itertools
import random
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written

# The base patterns, and the least lengths of what they match.
ASSIGN = re.compile(r"""([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{32,}")
ASSIGN_LEAST, ACCESS_LEAST = 8, 16
KINDS = ("assign", "access", "hex", "model")

#: Candidates for the network: runs of the characters that keys are made of.
CANDIDATE = re.compile(r"(?<![A-Za-z0-9+/_=.-])[A-Za-z0-9+/_=.-]{16,}")
LEAST = 16
LEFT, BODY, RIGHT = 24, 48, 8
#: Longer runs are scored in windows of BODY characters, each STEP after the one before, and count with their greatest score.
STEP = BODY // 2
WIDTH = LEFT + BODY + RIGHT
RECALL = 0.98
#: Documents that findings are gathered from, findings of each kind that a fit uses, and the fewest true ones for a shape to have a threshold of its own.
FIT_DOCUMENTS, MAX_FINDINGS, LEAST_OF_SHAPE = 20_000, 2_000, 20
SHAPES = ("hex", "upper", "lower", "mixed")

# Classes of characters, in this order: fixed values.
CLASSES = ("abcdef", "ghijklmnopqrstuvwxyz", "ABCDEF", "GHIJKLMNOPQRSTUVWXYZ", "0123456789", "+", "/", "_", "=", ".", "-", ":", "@", "\"'", " \t", "\n", "(){}[]<>", ",;!?")
_CODE = np.full(256, len(CLASSES) + 1, np.int64)
for _i, _chars in enumerate(CLASSES):
    for _c in _chars:
        _CODE[ord(_c)] = _i + 1
N_CODES = len(CLASSES) + 2  # 0 is beyond the text, the last one stands for all other characters
Finding = tuple[str, int, int, int]


def base_spans(text: str) -> list[tuple[int, int, str]]:
    out = [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= ASSIGN_LEAST]
    out += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if m.end() - m.start() >= ACCESS_LEAST]
    out += [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]
    return sorted(out, key=lambda x: (x[0], KINDS.index(x[2])))


def bodies(text: str, base: list[tuple[int, int, str]]) -> list[tuple[int, int]]:
    """Where the keys of the base findings stand: of an assignment only what is assigned."""
    return [ASSIGN.match(text, a).span(2) if kind == "assign" else (a, b) for a, b, kind in base]


def shape(s: str) -> str:
    """Which kind of run this is; each has a threshold of its own."""
    if not s.strip("0123456789abcdef-"):
        return "hex"
    return "upper" if s == s.upper() else "lower" if s == s.lower() else "mixed"


def _key_like(s: str) -> bool:
    """A letter and a digit, or capitals after small letters within a word."""
    letters = any(c.isalpha() for c in s)
    return letters and (any(c.isdigit() for c in s) or _CAMEL.search(s) is not None)


_CAMEL = re.compile("[a-z][A-Z]")


def candidates(text: str, taken: list[tuple[int, int, str]]) -> list[tuple[int, int]]:
    """Runs of LEAST characters or more that are like keys, or what the base spans leave of them where that has as many."""
    out = []
    for m in CANDIDATE.finditer(text):
        at, end = m.span()
        pieces = []
        for x, y, _ in taken:
            if x < end and at < y:
                pieces.append((at, x))
                at = max(at, y)
        for a, b in (*pieces, (at, end)):
            if b - a >= LEAST and _key_like(text[a:b]):
                out.append((a, b))
    return out


def windows(a: int, b: int) -> list[tuple[int, int]]:
    """Parts of BODY characters that cover a run, the last one at its end."""
    return [(x, min(b, x + BODY)) for x in (*range(a, b - BODY, STEP), max(a, b - BODY))]


def encoded(text: str, a: int, b: int) -> np.ndarray:
    """Codes of the characters around and in text[a:b]: LEFT before, the first BODY of it (windows() has no more), RIGHT after."""

    def part(s: str, size: int, at_end: bool) -> np.ndarray:
        raw = np.frombuffer(s.encode("utf-32-le", "surrogatepass"), "<u4")
        code = np.where(raw < 256, _CODE[np.minimum(raw, 255)], N_CODES - 1)
        out = np.zeros(size, np.int64)
        if len(code):
            if at_end:
                out[-len(code) :] = code
            else:
                out[: len(code)] = code
        return out

    return np.concatenate([part(text[max(0, a - LEFT) : a], LEFT, True), part(text[a : min(b, a + BODY)], BODY, False), part(text[b : b + RIGHT], RIGHT, False)])


@dataclass
class Network:
    """Embedding, one convolution over time with ReLU, max-pooling, a dense layer; then the calibration and the thresholds."""

    embed: np.ndarray
    kernel: np.ndarray
    bias: np.ndarray
    dense: np.ndarray
    shift: float
    scale: float = 1.0
    offset: float = 0.0
    threshold: float = 0.5
    by_shape: dict[str, float] = field(default_factory=dict)

    def threshold_of(self, run: str) -> float:
        return self.by_shape.get(shape(run), self.threshold)

    def raw(self, codes: np.ndarray) -> np.ndarray:
        return self._forward(codes)[0]

    def _forward(self, codes: np.ndarray):
        e = self.embed[codes]
        k = self.kernel.shape[0]
        steps = codes.shape[1] - k + 1
        z = sum(e[:, j : j + steps] @ self.kernel[j] for j in range(k)) + self.bias
        z[z < 0] = 0
        at = z.argmax(axis=1)
        pooled = np.take_along_axis(z, at[:, None, :], axis=1)[:, 0]
        return pooled @ self.dense + self.shift, e, pooled, at

    def probability(self, codes: np.ndarray) -> np.ndarray:
        out = [self.raw(codes[i : i + 1024]) for i in range(0, len(codes), 1024)]
        return 1 / (1 + np.exp(-(self.scale * (np.concatenate(out) if out else np.zeros(0)) + self.offset)))

    def best(self, runs: list[tuple[str, int, int]]) -> np.ndarray:
        """The greatest probability among each run's windows."""
        out = np.zeros(len(runs))
        asked = ((r, t, x, y) for r, (t, a, b) in enumerate(runs) for x, y in windows(a, b))
        while part := list(itertools.islice(asked, 4096)):
            np.maximum.at(out, [r for r, *_ in part], self.probability(np.stack([encoded(t, x, y) for _, t, x, y in part])))
        return out


#: Ordinary words of names and titles, for harmless runs.
ORDINARY = "report version release value element name window button update config data file list index table page user account order total annual quarter standard certified model series test build main major minor patch number label image video final draft copy north south water power energy city school".split()


def synthetic_findings(n: int = 4000, seed: int = 7, contexts: list[tuple[str, str]] | None = None) -> list[Finding]:
    """Labelled findings (text, start, end, label) drawn from the shapes of keys and of harmless runs; all invented. contexts: texts before and after, taken from documents, into which half of them are planted."""
    r = random.Random(seed)
    low, up, dig = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
    pick = lambda chars, k: "".join(r.choice(chars) for _ in range(k))
    word = lambda: pick(low, r.randint(2, 9))
    secrets = [
        lambda: (r.choice(["ghp_", "gho_", "glpat-", "xoxb-", "sk_live_", "sk-", "pk_live_", "AIza", "ya29.", "npm_"]) + pick(r.choice([low + up + dig, "abcdefABCDEF" + dig]), r.randint(20, 40))),
        lambda: pick(low + up + dig + "+/", r.randint(38, 44)) + r.choice(["", "=", "=="]),
        lambda: "eyJ" + pick(low + up + dig + "_-", r.randint(20, 40)) + ".eyJ" + pick(low + up + dig + "_-", r.randint(20, 40)) + "." + pick(low + up + dig + "_-", r.randint(20, 43)),
        lambda: pick(up + dig, r.randint(20, 36)),
        lambda: pick(low + up + dig, r.randint(24, 40)),
        lambda: r.choice(["v1/", "keys/", "id=", word() + "/"]) + pick(low + up + dig, r.randint(24, 36)),
        lambda: r.choice(["xoxb-", "xoxp-", "xapp-"]) + pick(dig, r.randint(10, 13)) + "-" + pick(dig, r.randint(10, 13)) + "-" + pick(low + up + dig, 24),
    ]
    # What names, titles, versions and model numbers are made of: words in one case, numbers, and one separator throughout.
    case = lambda: r.choice([str.lower, str.upper, str.capitalize])
    said = lambda c: c(r.choice(ORDINARY) if r.random() < 0.7 else word())
    number = lambda: pick(dig, r.randint(1, 4))

    def listed() -> str:
        c, sep = case(), r.choice("-_-_./")
        return sep.join(number() if r.random() < 0.25 else r.choice([said(c), said(c), c(pick(low, r.randint(1, 3))) + number()]) for _ in range(r.randint(3, 6)))

    def camel() -> str:
        return r.choice(["get", "set", "is", "on", "HTML", "XML", "HTTP", ""]) + "".join(said(str.capitalize) for _ in range(r.randint(3, 5))) + r.choice(["", "", pick(dig, 1), pick(up, 2) + pick(dig, 1)])

    harmless = [
        lambda: word() + "." + pick(dig, 2) + "@" + word() + pick(dig, 1) + ".example.com",
        lambda: "-".join([pick("abcdef" + dig, 8), *(pick("abcdef" + dig, 4) for _ in range(3)), pick("abcdef" + dig, 12)]),
        lambda: "/".join(word() for _ in range(r.randint(3, 5))) + "/" + pick(dig, 2) + ".html",
        lambda: word() + "-" + word() + "-" + word() + "-" + pick(dig, r.randint(1, 4)),
        lambda: pick(dig, 4) + "-" + pick(dig, 2) + "-" + pick(dig, 2) + "T" + pick(dig, 6) + "Z" + word(),
        lambda: word() + "_" + word() + "_" + word() + pick(dig, 2) + "." + r.choice(["py", "txt", "json", "csv"]),
        lambda: "v" + pick(dig, 1) + "." + pick(dig, 2) + "." + pick(dig, 3) + "-" + word() + "." + word(),
        lambda: word().capitalize() + word() + word() + pick(dig, 2) + word(),
        lambda: pick(dig, 16) + "." + word(),
        lambda: r.choice(["", "", "HTML", "XML", "get", "is"]) + "".join(word().capitalize() for _ in range(r.randint(3, 5))),
        listed, listed, listed, camel, camel,
        lambda: pick(r.choice(["ACGT", "ACGU", "acgt", "01", "xX0"]), r.randint(16, 48)) + r.choice(["", "1", "-2"]),
        lambda: "-".join(pick(up, r.randint(1, 3)) + pick(dig, r.randint(1, 4)) + pick(up, r.randint(0, 2)) for _ in range(r.randint(3, 5))),
    ]
    lead = ["key: ", "Authorization: Bearer ", "export KEY=", "credential = '", "auth=", "AccessKey=\"", "private_key: "]
    out = []
    for i in range(n):
        label = i % 2
        s = r.choice(secrets if label else harmless)()
        if len(s) < 16:
            s += word() + pick(dig, 10)
        before = " ".join(word() for _ in range(r.randint(1, 6))) + " "
        if label and r.random() < 0.6:
            before += r.choice(lead)
        after = r.choice([" ", ". ", "\n", "' ", '" ', "### "]) + word()
        if contexts and i % 4 < 2:
            own, after = r.choice(contexts)
            before = own + (r.choice(lead) if label and r.random() < 0.5 else "")
        out.append((before + s + after, len(before), len(before) + len(s), label))
    return out


def document_findings(docs: DataFrame, documents: int = FIT_DOCUMENTS, most: int = MAX_FINDINGS) -> list[tuple[str, int, int, str]]:
    """(context, start, end, kind) from about so many documents, chosen by a hash of their id: at most so many findings of each kind.

    Kinds: base, a key that a base pattern found; run, any other candidate; plain, a place between two words. A context is
    what the network sees around it. Null and repeated ids count like others.
    """
    every = max(1, docs.count() // documents)

    def found(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            rows = []
            for t in x["text"]:
                if not isinstance(t, str) or not t:
                    continue
                base = base_spans(t)
                gap = t.find(" ", len(t) // 2) + 1
                own = [(a, b, "base") for a, b in bodies(t, base)] + [(a, b, "run") for a, b in candidates(t, base)] + ([(gap, gap, "plain")] if gap else [])
                for a, b, kind in own:
                    start, b = max(0, a - LEFT), min(b, a + 4 * BODY)
                    rows.append((t[start : b + RIGHT], a - start, b - start, kind))
            yield pd.DataFrame(rows, columns=["context", "a", "b", "kind"])

    chosen = docs.select("text").filter(F.pmod(F.xxhash64("doc_id"), F.lit(every)) == 0)
    # Written once, as three lists are taken from it.
    spans = written(chosen.mapInPandas(found, "context string, a int, b int, kind string").distinct(), "secret-findings")
    # One bounded list a kind: top-N, which tasks cut before they send.
    out = []
    for kind in ("base", "run", "plain"):
        rows = spans.filter(F.col("kind") == kind).orderBy(F.xxhash64("context"), "context", "a", "b").limit(most).collect()
        out += [(r["context"], r["a"], r["b"], kind) for r in rows]
    return out


def labelled_findings(docs: DataFrame) -> list[Finding]:
    """What a fit learns from: base findings are true; keys planted into the documents' contexts are true; runs of the documents are harmless unless a first fit takes them for keys."""
    found = document_findings(docs)
    contexts = [(t[:a], t[b:]) for t, a, b, kind in found if kind == "plain"]
    known = [(t, a, b, 1) for t, a, b, kind in found if kind == "base"] + synthetic_findings(contexts=contexts)
    runs = [(t, a, b) for t, a, b, kind in found if kind == "run"]
    if not runs:
        return known
    p = trained(known, rounds=200).best(runs)
    return known + [(*r, 0) for r, q in zip(runs, p, strict=True) if q < 0.5]


def trained(findings: list[Finding] | None = None, recall: float = RECALL, rounds: int = 600, seed: int = 11) -> Network:
    """A network fitted on three quarters of the findings; the rest calibrate it and set its thresholds, one a shape that has enough true findings.

    Without findings of both kinds the threshold is above 1: nothing is added.
    """
    findings = synthetic_findings() if findings is None else findings
    rng = np.random.default_rng(seed)
    dim, k, filters, batch = 8, 5, 24, 64
    net = Network(rng.normal(0, 0.5, (N_CODES, dim)), rng.normal(0, 0.3, (k, dim, filters)), np.zeros(filters), rng.normal(0, 0.3, filters), 0.0, threshold=2.0)
    y = np.array([f[3] for f in findings], float)
    if len(y) < 8 or y.min() == y.max():
        return net
    x = np.stack([encoded(t, *w) for t, a, b, _ in findings for w in windows(a, b)])
    # A finding's windows stand together; first is where they begin.
    first = np.cumsum([0, *(len(windows(a, b)) for _, a, b, _ in findings)])
    order = rng.permutation(len(y))
    held = order[: len(y) // 4]
    fit = np.concatenate([np.arange(first[i], first[i + 1]) for i in order[len(y) // 4 :]])
    labels = np.repeat(y, np.diff(first))
    params = ["embed", "kernel", "bias", "dense", "shift"]
    mean, var = {p: 0.0 for p in params}, {p: 0.0 for p in params}
    for step in range(1, rounds + 1):
        rows = rng.choice(fit, batch)
        codes, target = x[rows], labels[rows]
        out, e, pooled, at = net._forward(codes)
        d = (1 / (1 + np.exp(-out)) - target) / batch
        grad = {"shift": d.sum(), "dense": pooled.T @ d, "bias": None, "kernel": np.zeros_like(net.kernel), "embed": np.zeros_like(net.embed)}
        back = d[:, None] * net.dense * (pooled > 0)
        grad["bias"] = back.sum(axis=0)
        i = np.arange(batch)[:, None]
        for j in range(k):
            here = e[i, at + j]  # batch x filters x dim
            grad["kernel"][j] = np.einsum("bfd,bf->df", here, back)
            np.add.at(grad["embed"], codes[i, at + j], back[:, :, None] * net.kernel[j].T[None])
        for p in params:
            mean[p] = 0.9 * mean[p] + 0.1 * grad[p]
            var[p] = 0.99 * var[p] + 0.01 * grad[p] ** 2
            step_size = 0.02 * (mean[p] / (1 - 0.9**step)) / (np.sqrt(var[p] / (1 - 0.99**step)) + 1e-8)
            setattr(net, p, getattr(net, p) - step_size)
    raw = np.maximum.reduceat(net.raw(x), first[:-1])[held]
    scale, offset = 1.0, 0.0
    for _ in range(200):  # Platt's calibration
        p = 1 / (1 + np.exp(-(scale * raw + offset)))
        scale -= 0.1 * float(((p - y[held]) * raw).mean())
        offset -= 0.1 * float((p - y[held]).mean())
    net.scale, net.offset = scale, offset
    p = np.maximum.reduceat(net.probability(x), first[:-1])[held]
    shapes = np.array([shape(findings[i][0][findings[i][1] : findings[i][2]]) for i in held])

    def threshold(rows: np.ndarray) -> float:
        """Of the thresholds that find the wanted share of the true findings, one with the fewest false alarms: the middle, on the scale of log odds, of those that do equally well."""
        true = np.sort(p[rows & (y[held] == 1)])
        if not len(true):
            return 2.0
        most = float(true[int(np.floor((1 - recall) * len(true)))])
        below = p[rows & (y[held] == 0) & (p < most)]
        odds = lambda q: np.log(np.clip(q, 1e-9, 1 - 1e-9) / (1 - np.clip(q, 1e-9, 1 - 1e-9)))
        middle = (odds(most) + odds(below.max(initial=1e-6))) / 2
        return min(most, float(1 / (1 + np.exp(-middle))))

    true = y[held] == 1
    net.threshold = threshold(np.ones(len(held), bool))
    net.by_shape = {k: threshold(shapes == k) for k in SHAPES if (true & (shapes == k)).sum() >= LEAST_OF_SHAPE}
    return net


def scan(texts: list[str], net: Network) -> list[list[tuple[int, int, str, float]]]:
    """All spans of each whole text with their scores: the base ones, whatever their scores, and the candidates that reach their shape's threshold."""
    base = [base_spans(t) for t in texts]
    runs = [(i, a, b, None) for i, t in enumerate(texts) for a, b in candidates(t, base[i])]
    runs += [(i, a, b, k) for i, t in enumerate(texts) if base[i] for k, (a, b) in enumerate(bodies(t, base[i]))]
    scores = net.best([(texts[i], a, b) for i, a, b, _ in runs])
    spans: list[list[tuple[int, int, str, float]]] = [[] for _ in texts]
    for (i, a, b, k), q in zip(runs, scores.tolist(), strict=True):
        if k is not None:
            spans[i].append((*base[i][k], q))
        elif q >= net.threshold_of(texts[i][a:b]):
            spans[i].append((a, b, "model", q))
    return [sorted(s, key=lambda x: (x[0], KINDS.index(x[2]))) for s in spans]


def joined(spans: list[tuple[int, int, str, float]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, b, k, _ in spans)


def redacted(text: str, spans: list[tuple[int, int, str, float]], mark: str = "[SECRET]") -> str:
    out, at = [], 0
    for a, b, *_ in spans:
        if a >= at:
            out += [text[at:a], mark]
        at = max(at, b)
    return "".join(out) + text[at:]


_FIELDS = ("n_assign", "n_access", "n_hex", "n_model", "base_sha256", "spans", "scores", "redacted")


def secrets(docs: DataFrame, net: Network | None = None, redact: bool = True) -> DataFrame:
    """All columns of docs and n_assign, n_access, n_hex, n_model, base_sha256, spans, scores (of the spans, in their order) and (if asked) redacted.

    Without a network, one is trained on findings of the documents (labelled_findings).
    Columns of docs with these names are replaced. Null and empty texts have no
    spans, and redact to themselves; offsets are code points of the whole text;
    repeated rows are scanned alike. An empty table gives an empty result.
    """
    shared = docs.sparkSession.sparkContext.broadcast(trained(labelled_findings(docs)) if net is None else net)
    fields = _FIELDS if redact else _FIELDS[:-1]
    kinds = {f: "long" if f.startswith("n_") else "string" for f in fields}

    @F.pandas_udf(", ".join(f"{f} {k}" for f, k in kinds.items()))
    def found(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            rows, values = [], [t if isinstance(t, str) else None for t in texts]
            for text, spans in zip(values, scan([t or "" for t in values], shared.value), strict=True):
                base = [s for s in spans if s[2] != "model"]
                counts = [sum(s[2] == k for s in spans) for k in KINDS]
                row = [*counts, hashlib.sha256(joined(base).encode()).hexdigest(), joined(spans), ",".join(f"{q:.4f}" for *_, q in spans)]
                rows.append([*row, redacted(text, spans) if text else text] if redact else row)
            yield pd.DataFrame(rows, columns=list(fields))

    kept = [c for c in docs.columns if c.lower() not in (*_FIELDS, "_found")]
    return docs.select(*kept, found("text").alias("_found")).select(*kept, "_found.*")
