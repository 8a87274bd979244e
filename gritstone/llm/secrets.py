"""Secret scans: exact patterns plus a character convolutional network over every candidate and its context.

Candidates are the exact patterns' findings and every run of 16 or more token characters; windows cover the whole of each, with what
stands before and after it. The network is trained in numpy on labelled findings that this module makes from a fixed seed: the
exact patterns' kinds and keys of other shapes, against placeholders, numbers, paths, addresses, long words and other look-alikes.
Four separate parts of them serve training, Platt calibration, the threshold (the highest that keeps the recall asked for) and the
figures reported. Exact findings stay whatever they score.
"""

from __future__ import annotations

import random
import re
from bisect import bisect_right

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import process_cache, releasing, table, text_slices

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
HEX = re.compile(rb"[0-9a-f]+")
KEYWORDS = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")
#: Base kinds in the order of the contract; the network's kind follows.
KINDS = ("assign", "access", "hex", "neural")

LEFT, INSIDE, RIGHT = 24, 48, 12
WINDOW, WIDTH, DIM, FILTERS = LEFT + INSIDE + RIGHT, 5, 6, 24
CANDIDATE = 16


def _alphabet(chars: str) -> np.ndarray:
    held = np.zeros(256, bool)
    held[np.frombuffer(chars.encode(), np.uint8)] = True
    return held


TOKEN_CHARS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_.=-"


def findings(n: int, seed: int) -> list[tuple[bytes, int, int, int]]:
    """Labelled findings: (bytes, start, end, 1 for a secret), half of them secrets; spans are those that scan() would score."""
    r = random.Random(seed)
    lower, digits = "abcdefghijklmnopqrstuvwxyz", "0123456789"
    upper, b64 = lower.upper(), lower + lower.upper() + digits
    syllables = ["er", "in", "the", "on", "an", "es", "ti", "re", "ou", "la", "de", "ver", "men", "al", "ci", "ra", "st", "ing", "com", "pro", "sch", "keit", "ung", "eau", "que", "mente", "hea", "ble", "sh"]

    def word(most=5):
        return "".join(r.choice(syllables) for _ in range(r.randint(1, most)))

    onsets = "b bl br ch d dr f fl g gr h j k kl kn l m n p pf pfl ph pr qu r s sch schw sp st str t th tr v w wh z zw".split()
    codas = ["", "", "", *"n m r l s st ft cht ng nk rt tz ck ll mpf fts nd x sh gs".split()]

    def compound():
        """A long word of many syllables, with clusters of consonants."""
        return "".join(r.choice(onsets) + r.choice(["a", "e", "i", "o", "u", "ie", "au", "ei"]) + r.choice(codas) for _ in range(r.randint(5, 11)))

    def some(chars, a, b):
        return "".join(r.choice(chars) for _ in range(r.randint(a, b)))

    def prose():
        return " ".join(word() for _ in range(r.randint(2, 8)))

    def assigned(value):
        """An exact pattern's finding: the key word is part of the span."""
        quote = r.choice(["", "", '"', "'"])
        return "", r.choice(["password", "passwd", "secret", "token", "api_key", "apikey", "Token", "SECRET"]) + r.choice(["=", " = ", ": ", '":"']) + quote + value

    def secret():
        if r.random() < 0.35:
            kind = r.random()
            if kind < 0.5:
                return assigned(r.choice([some(digits + "abcdef", 16, 48), some(b64, 10, 40), some(b64 + "+/", 12, 40), word(3) + some(digits, 2, 5), some(lower + digits, 8, 14)]))
            return ("", "AKIA" + some(upper + digits, 16, 20)) if kind < 0.75 else ("", some(digits + "abcdef", 24, 64))
        body = r.choice([
            lambda: some(digits + "abcdef", 18, 64), lambda: some(b64, 20, 64), lambda: some(b64 + "+/", 24, 90) + "==",
            lambda: r.choice(["sk_live_", "ghp_", "xoxb-", "glpat-", "pk_", "AIza"]) + some(b64, 20, 40), lambda: some(upper + digits, 16, 32),
            lambda: "eyJ" + some(b64, 20, 60) + "." + some(b64 + "-_", 20, 60), lambda: some(b64 + "-_", 22, 80), lambda: some(upper + digits, 4, 6) + "-" + some(upper + digits, 4, 6) + "-" + some(upper + digits, 8, 12),
        ])()
        lead = r.choice(["", "", f"{word()} ", "key = ", "key: ", "Authorization: Bearer ", "auth=", "credential: '", f"export {word().upper()}_KEY=", "secret_access: ", "pwd "])
        return lead, body

    def harmless():
        if r.random() < 0.2:
            return assigned(r.choice(["changeme", "xxxxxxxx", "********", "required", "your_token_here", "password", "<none>", "example", "placeholder", word(4) + "-" + word(3)]).replace("*", "x").replace("<", "").replace(">", "").ljust(6, "x"))
        body = r.choice([
            lambda: some(digits, 16, 24), lambda: "_".join(word() for _ in range(r.randint(3, 6))) + some(digits, 0, 2), lambda: "/".join(["", *[word() for _ in range(r.randint(3, 6))], word() + some(digits, 0, 2)]),
            lambda: f"20{some(digits, 2, 2)}-0{r.randint(1, 9)}-1{r.randint(0, 9)}T{some(digits, 2, 2)}-{some(digits, 2, 2)}", lambda: "-".join(word() for _ in range(4)) + "-" + some(digits, 1, 4), lambda: "=" * r.randint(8, 30) + some(digits, 0, 2) + "=" * 8,
            lambda: word().capitalize() + "".join(word().capitalize() for _ in range(4)) + some(digits, 0, 2), lambda: r.choice("-=._/+") * r.randint(16, 60), lambda: ".".join(some(digits, 1, 3) for _ in range(8)), lambda: "0" * r.randint(14, 40) + some(digits, 1, 3),
            lambda: r.choice(syllables) * r.randint(6, 14) + some(digits, 0, 1), lambda: "+" + "-".join(some(digits, 3, 4) for _ in range(5)), lambda: "_".join([word().upper() for _ in range(4)]) + "_" + some(digits, 0, 2),
            lambda: "".join(word() for _ in range(r.randint(4, 9))), lambda: "".join(word() for _ in range(r.randint(4, 9))).capitalize() + ".", lambda: "".join(word() for _ in range(r.randint(4, 9))).upper(), lambda: word(4) + "." + word(4) + "." + word(4),
            lambda: "mail" + some(digits, 1, 2) + "." + word() + "." + r.choice(["com", "org", "net"]) + some(digits, 0, 1), lambda: "www." + word() + word() + ".com/" + word() + "/" + word() + some(digits, 0, 3), lambda: word(4) + "=" + word(4) + "=" + word(4), lambda: r.choice("abcdwxyz") * r.randint(16, 60),
            compound, compound, lambda: compound().capitalize() + r.choice(["", ".", "-" + word()]), lambda: compound().upper(), lambda: r.choice(digits[1:]) + some(digits, 15, 15), lambda: some(digits, 16, 19),
        ])()
        return r.choice(["", "", "number ", "see ", f"{word()}: ", "id=", "file ", "on ", f"{word()}.{some(digits, 2, 2)}@"]), body

    out = []
    for i in range(n):
        lead, body = (secret if i % 2 else harmless)()
        if lead or not any(k.decode() in body.lower() for k in KEYWORDS):
            body = body.ljust(CANDIDATE, r.choice("0aen"))
        head = f"{prose()} {lead}"
        tail = r.choice([" ", "\n", "'", '"', ", ", "; ", " "]) + prose()
        out.append(((head + body + tail).encode(), len(head.encode()), len((head + body).encode()), i % 2))
    return out


def window_starts(spans: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first inside byte, span number) of the windows that cover each span: one after another, the last one ending where the span ends."""
    long = np.maximum(spans[:, 1] - spans[:, 0], 1)
    many = -(-long // INSIDE)
    number = np.repeat(np.arange(len(spans)), many)
    nth = np.arange(len(number)) - np.repeat(np.cumsum(many) - many, many)
    return spans[number, 0] + np.minimum(nth * INSIDE, np.maximum(long[number] - INSIDE, 0)), number


def windows(blob: np.ndarray, spans: np.ndarray, first: np.ndarray, number: np.ndarray, bounds: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, inside marks) of the windows whose inside begins at first, with what stands before and after.

    bounds are the first byte and the end of each span's text in blob (all of it by default); what lies outside is zero.
    """
    at = first[:, None] - LEFT + np.arange(WINDOW)[None, :]
    low, high = (0, len(blob)) if bounds is None else (bounds[number, 0][:, None], bounds[number, 1][:, None])
    real = (at >= low) & (at < high)
    x = np.where(real, blob[np.clip(at, 0, max(0, len(blob) - 1))] if len(blob) else 0, 0)
    inside = real & (at >= spans[number, 0][:, None]) & (at < spans[number, 1][:, None])
    return x.astype(np.uint8), inside


def _forward(w: dict, x: np.ndarray, inside: np.ndarray):
    e = np.concatenate([w["embed"][x], inside[:, :, None].astype(np.float32)], axis=2)
    n, _, d = e.shape
    cols = np.lib.stride_tricks.sliding_window_view(e, WIDTH, axis=1).reshape(n * (WINDOW - WIDTH + 1), d * WIDTH)
    hidden = np.maximum(cols @ w["conv"] + w["conv_bias"], 0).reshape(n, WINDOW - WIDTH + 1, FILTERS)
    middle = inside[:, WIDTH // 2 : WINDOW - WIDTH // 2]
    share = middle.sum(axis=1, keepdims=True).clip(1)
    mean_in = (hidden * middle[:, :, None]).sum(axis=1) / share
    mean_out = (hidden * ~middle[:, :, None]).sum(axis=1) / (~middle).sum(axis=1, keepdims=True).clip(1)
    pooled = np.concatenate([mean_in, mean_out, hidden.max(axis=1)], axis=1)
    return cols, hidden, middle, share, pooled, pooled @ w["out"] + w["out_bias"]


def train(seed: int = 11, n: int = 12_000, epochs: int = 6, recall: float = 0.98) -> dict:
    """Fit the network on n labelled findings; returns its weights, Platt parameters, threshold and held-out figures.

    60 % train, 15 % calibrate, 15 % set the threshold and 10 % are only measured. A long finding trains by its first window.
    """
    data = findings(n, seed)
    x, inside = [], []
    for b, s, e, _ in data:
        span = np.array([[s, e]])
        part = windows(np.frombuffer(b, np.uint8), span, np.array([s]), np.array([0]))
        x.append(part[0][0])
        inside.append(part[1][0])
    x, inside, y = np.stack(x), np.stack(inside), np.array([d[3] for d in data], np.float32)
    rng = np.random.default_rng(seed)
    w = {
        "embed": rng.normal(0, 0.3, (256, DIM)), "conv": rng.normal(0, 0.2, ((DIM + 1) * WIDTH, FILTERS)), "conv_bias": np.zeros(FILTERS), "out": rng.normal(0, 0.1, 3 * FILTERS), "out_bias": np.zeros(1),
    }
    w = {k: v.astype(np.float32) for k, v in w.items()}
    m1, m2, step = {k: np.zeros_like(v) for k, v in w.items()}, {k: np.zeros_like(v) for k, v in w.items()}, 0
    cut, calibrated, chosen = n * 6 // 10, n * 75 // 100, n * 9 // 10
    for _ in range(epochs):
        for batch in np.array_split(rng.permutation(cut), max(1, cut // 64)):
            bx, bi, by = x[batch], inside[batch], y[batch]
            cols, hidden, middle, share, pooled, z = _forward(w, bx, bi)
            dz = (1 / (1 + np.exp(-z)) - by) / len(batch)
            g = {"out": pooled.T @ dz, "out_bias": dz.sum(keepdims=True)}
            dp = dz[:, None] * w["out"][None, :]
            dh = middle[:, :, None] * (dp[:, :FILTERS] / share)[:, None, :] + ~middle[:, :, None] * (dp[:, FILTERS : 2 * FILTERS] / (~middle).sum(axis=1, keepdims=True).clip(1))[:, None, :]
            top = hidden.argmax(axis=1)
            np.add.at(dh, (np.arange(len(batch))[:, None], top, np.arange(FILTERS)[None, :]), dp[:, 2 * FILTERS :])
            dh = (dh * (hidden > 0)).reshape(-1, FILTERS).astype(np.float32)
            g["conv"], g["conv_bias"] = cols.T @ dh, dh.sum(axis=0)
            dc = (dh @ w["conv"].T).reshape(len(batch), WINDOW - WIDTH + 1, DIM + 1, WIDTH)
            de = np.zeros((len(batch), WINDOW, DIM), np.float32)
            for k in range(WIDTH):
                de[:, k : k + WINDOW - WIDTH + 1] += dc[:, :, :DIM, k]
            g["embed"] = np.zeros_like(w["embed"])
            np.add.at(g["embed"], bx.ravel(), de.reshape(-1, DIM))
            step += 1
            for k in w:
                m1[k] = 0.9 * m1[k] + 0.1 * g[k]
                m2[k] = 0.999 * m2[k] + 0.001 * g[k] ** 2
                w[k] = (w[k] - 0.01 * (m1[k] / (1 - 0.9**step)) / (np.sqrt(m2[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
    z, held = _forward(w, x[cut:calibrated], inside[cut:calibrated])[-1], y[cut:calibrated]
    a, b = 1.0, 0.0
    for _ in range(300):
        p = 1 / (1 + np.exp(-(a * z + b)))
        a, b = a - 0.2 * float(((p - held) * z).mean()), b - 0.2 * float((p - held).mean())
    net = {"w": w, "a": a, "b": b}

    def scored(lo, hi):
        out = []
        for blob, s, e, _ in data[lo:hi]:
            out.append(score(net, np.frombuffer(blob, np.uint8), np.array([[s, e]]))[0])
        return np.array(out), y[lo:hi]

    p, held = scored(calibrated, chosen)
    positives = np.sort(p[held == 1])
    net["threshold"] = float(positives[int((1 - recall) * len(positives))])
    p, held = scored(chosen, n)
    hit = p >= net["threshold"]
    return net | {"held_recall": float(hit[held == 1].mean()), "held_precision": float(held[hit].mean())}


def model() -> dict:
    """The trained network, fitted once per process."""
    held = process_cache()
    if "secrets" not in held:
        held["secrets"] = train()
    return held["secrets"]


def score(net: dict, blob: np.ndarray, spans: np.ndarray, bounds: np.ndarray | None = None) -> np.ndarray:
    """Calibrated probability of each candidate span, to five places; a long candidate has the largest of its windows' scores.

    It depends on the span's own text alone: places beyond the fifth, in which sums of more or fewer windows at a time may differ, go.
    """
    out = np.zeros(len(spans))
    if len(spans):
        first, number = window_starts(spans)
        for k in range(0, len(first), 1024):
            own = number[k : k + 1024]
            z = _forward(net["w"], *windows(blob, spans, first[k : k + 1024], own, bounds))[-1]
            np.maximum.at(out, own, 1 / (1 + np.exp(-np.clip(net["a"] * z + net["b"], -40, 40))))
    return np.round(out, 5)


def scan(texts: list[str | None], net: dict) -> list[list[tuple[str, int, int, float]]]:
    """Per text, its spans (kind, start, end, score) in code points, by start and then kind.

    All candidates are scored; exact findings stay whatever they score, and a run that scores the threshold is added unless an exact
    finding holds it whole.
    """
    raws = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    blob = b"\n".join([*raws, b""])
    starts = np.cumsum([0] + [len(r) + 1 for r in raws])
    low = blob.lower()
    hit = set()
    for word in KEYWORDS:
        at = low.find(word)
        while at >= 0:
            k = int(np.searchsorted(starts, at, side="right")) - 1
            hit.add(k)
            at = low.find(word, int(starts[k + 1]))
    data = np.frombuffer(blob, np.uint8)
    points: dict[int, np.ndarray] = {}

    def prefix(k: int) -> np.ndarray:
        """Code points before each byte of text k."""
        if k not in points:
            points[k] = np.concatenate(([0], np.cumsum((data[starts[k] : starts[k + 1]] & 0xC0) != 0x80)))
        return points[k]

    # (text, kind, start, end) in code points, and the same spans in bytes of the blob
    named, placed = [], []
    for k in sorted(hit):
        for m in ASSIGN.finditer(texts[k]):
            if len(m.group(2)) >= 6:
                named.append((k, "assign", m.start(), m.end()))
                # a code point's first byte is the last place that has as many code points before it
                placed.append([int(starts[k] + np.searchsorted(prefix(k), c, side="right") - 1) for c in m.span()])
    is_token = _alphabet(TOKEN_CHARS)[data]
    turns = np.flatnonzero(np.diff(np.concatenate(([0], is_token.view(np.int8), [0]))))
    runs = turns.reshape(-1, 2)
    runs = runs[runs[:, 1] - runs[:, 0] >= CANDIDATE]
    owner = np.searchsorted(starts, runs[:, 0], side="right") - 1

    def add(k, kind, a, b):
        named.append((k, kind, int(prefix(k)[a - starts[k]]), int(prefix(k)[b - starts[k]])))
        placed.append([a, b])

    for (a, b), k in zip(runs.tolist(), owner.tolist()):
        run = blob[a:b]
        for m in ACCESS.finditer(run):
            if m.end() - m.start() >= 20:
                add(k, "access", a + m.start(), a + m.end())
        for m in HEX.finditer(run):
            if m.end() - m.start() >= 24:
                add(k, "hex", a + m.start(), a + m.end())
        add(k, "neural", a, b)
    texts_of = np.array([n[0] for n in named], np.int64)
    scores = score(net, data, np.array(placed, np.int64).reshape(-1, 2), np.stack((starts[texts_of], starts[texts_of + 1] - 1), axis=1))
    # per text, the exact findings' starts and the farthest end up to each
    base: dict[int, tuple[list[int], list[int]]] = {}
    for k, s, e in sorted((n[0], n[2], n[3]) for n in named if n[1] != "neural"):
        own = base.setdefault(k, ([], []))
        own[0].append(s)
        own[1].append(max(e, own[1][-1] if own[1] else e))

    def held(k, s, e):
        first, far = base.get(k, ((), ()))
        at = bisect_right(first, s)
        return at > 0 and far[at - 1] >= e

    found: list[list[tuple[str, int, int, float]]] = [[] for _ in texts]
    for (k, kind, s, e), value in zip(named, scores.tolist()):
        if kind != "neural" or value >= net["threshold"] and not held(k, s, e):
            found[k].append((kind, s, e, value))
    for own in found:
        own.sort(key=lambda f: (f[1], KINDS.index(f[0])))
    return found


SPANS = "array<struct<kind:string,start:long,end:long,score:double>>"


def scan_secrets(docs: DataFrame) -> DataFrame:
    """(doc_id, spans): spans of every whole text, base kinds and the network's; null and empty texts have none."""
    net = model()
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))

    def run(batches):
        for batch in batches:
            for rows, texts in text_slices(batch, 1):
                out = [[{"kind": f[0], "start": f[1], "end": f[2], "score": f[3]} for f in own] for own in scan(texts, net)]
                yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(out, kind)], ["doc_id", "spans"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(releasing(run), f"doc_id long, spans {SPANS}")


def redact(docs: DataFrame, mark: str = "[SECRET]") -> DataFrame:
    """docs with every span replaced by mark (overlapping spans by one), and n_chars, if there, counted anew.

    All other columns pass through; null texts stay null.
    """
    net, names, schema = model(), docs.columns, docs.schema
    at, count = names.index("text"), names.index("n_chars") if "n_chars" in names else None

    def run(batches):
        for batch in batches:
            for rows, texts in text_slices(batch, at):
                changed = {}
                for k, own in enumerate(scan(texts, net)):
                    if own:
                        parts, end = [], 0
                        for _, s, e, _ in own:
                            if s >= end:
                                parts += [texts[k][end:s], mark]
                            end = max(end, e)
                        changed[k] = "".join([*parts, texts[k][end:]])
                columns = rows.columns
                if changed:
                    columns[at] = pa.array([changed.get(i, t) for i, t in enumerate(texts)], rows.schema.field(at).type)
                    if count is not None:
                        counts = columns[count].to_pylist()
                        columns[count] = pa.array([len(changed[i]) if i in changed else c for i, c in enumerate(counts)], rows.schema.field(count).type)
                yield pa.RecordBatch.from_arrays(columns, schema=rows.schema)

    return docs.mapInArrow(releasing(run), schema)


def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_secrets(table(spark, sf_dir, "documents"))

    def joined(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    def number(kind):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    base = F.filter("spans", lambda s: s["kind"] != "neural")
    counts = [number(kind) for kind in KINDS[:3]]
    return found.select("doc_id", *counts, F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))
