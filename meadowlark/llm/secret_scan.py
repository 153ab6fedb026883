"""Secret scans: rule-based spans, and a character convolutional network over every other candidate in its context.

The network sees a candidate, a long one by overlapping windows, with the characters around it: embedding, one convolution, pooling over the candidate and
over its context apart, one logistic unit. It is trained in numpy on labelled findings that a seeded generator writes
(secrets and look-alikes such as digests, identifiers and numbers, in prose and in configuration). Scores are calibrated
on a held-out part, and the threshold is the highest that keeps the wanted recall there.
"""

from __future__ import annotations

import hashlib
import random
import re
import string
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The base rules, as (kind, pattern, group whose length counts, least length).
BASE = (
    ("assign", re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A), 2, 6),
    ("access", re.compile(r"AKIA[A-Z0-9]+"), 0, 20),
    ("hex", re.compile(r"[0-9a-f]+"), 0, 24),
)
KINDS = {kind: k for k, kind in enumerate([*(b[0] for b in BASE), "network"])}

#: Runs of printable characters outside quotes, brackets and commas, and what parts them: keys, users and hosts.
_RUN = re.compile(r"[!#-&*-+\--:=?-Z\\^_a-z|~]{8,}")
_PART = re.compile(r"(?:[^:@&?=]|=(?![A-Za-z0-9]))+")
_HOST = re.compile(r"[A-Za-z0-9.-]+\.[A-Za-z]{2,}")
LEAST = 8
_LEFT, _HEAD, _RIGHT = 32, 48, 16
_WIDTH = _LEFT + _HEAD + _RIGHT
#: A run that is longer than a window is seen by several, this far apart.
_STEP = 32

Span = tuple[int, int, str]


def base_spans(text: str) -> list[Span]:
    """Leftmost non-overlapping matches of each rule that are long enough, by start and then by rule."""
    longest = max(map(len, text.split()), default=0)
    out: list[Span] = []
    for kind, pattern, group, least in BASE:
        # a match of the other two rules lies within one word
        if (kind == "assign" and ("=" in text or ":" in text)) or (kind == "access" and "AKIA" in text) or (kind == "hex" and longest >= least):
            out += [(m.start(), m.end(), kind) for m in pattern.finditer(text) if m.end(group) - m.start(group) >= least]
    return sorted(out, key=lambda s: (s[0], KINDS[s[2]], s[1]))


def _mixed(part: str) -> bool:
    """Whether a part is more than a word, a name or a number: letters with digits, capitals inside, or odd characters."""
    letters = part.lower() != part.upper()
    return letters and (any(map(str.isdigit, part)) or (part[1:] != part[1:].lower() and part != part.upper()) or bool(re.search(r"[A-Za-z0-9][!#$%*^~\\|]+[A-Za-z0-9]", part)))


def candidates(text: str, taken: list[Span]) -> list[tuple[int, int]]:
    """Parts of runs that may be secrets, of LEAST characters or more (letters alone: twice that), without what base spans
    cover and without the hosts of mail addresses."""
    if not any(len(w) >= LEAST and not (w.isalpha() and (w.islower() or w.istitle())) for w in text.split()):
        return []
    out = []
    for run in _RUN.finditer(text):
        if run.group().isalpha() and (run.group().islower() or run.group().istitle()):
            continue
        for m in _PART.finditer(text, run.start(), run.end()):
            pieces = [(m.start(), m.end())]
            for a, b, _ in taken:
                if a < m.end() and m.start() < b:
                    pieces = [p for x, y in pieces for p in ((x, min(y, a)), (max(x, b), y)) if p[0] < p[1]]
            for x, y in pieces:
                while x < y and text[x] in "/.-_+":
                    x += 1
                while x < y and text[y - 1] in ".-!?#$%*~^|\\":
                    y -= 1
                is_host = text[x - 1 : x] == "@" and _HOST.fullmatch(text, x, y)
                if y - x >= (2 * LEAST if text[x:y].isalpha() else LEAST) and _mixed(text[x:y]) and not is_host:
                    out.append((x, y))
    return out


# ---- labelled findings -----------------------------------------------------------------------------------------------

_SYLLABLES = "an ber con del en for ga hin is ja ku lor men no or pre qua ri sta ter un ver wo xi yo zu ing tion er st".split()
_ALNUM = string.ascii_letters + string.digits
_HEX = "0123456789abcdef"


def _prose(r: random.Random, n: int) -> str:
    return " ".join("".join(r.choice(_SYLLABLES) for _ in range(r.randint(1, 4))) for _ in range(n))


def _chars(r: random.Random, alphabet: str, low: int, high: int) -> str:
    return "".join(r.choice(alphabet) for _ in range(r.randint(low, high)))


def _secret(r: random.Random) -> str:
    return r.choice(
        [
            lambda: _chars(r, _ALNUM, 20, 48),
            lambda: _chars(r, _ALNUM + "+/", 24, 64) + r.choice(["", "=", "=="]),
            lambda: _chars(r, _HEX, 32, 64),
            lambda: r.choice(["ghp_", "gho_", "sk_live_", "rk_live_", "glpat-", "npm_", "pk-"]) + _chars(r, _ALNUM, 20, 40),
            lambda: "eyJ" + _chars(r, _ALNUM + "_-", 20, 40) + "." + _chars(r, _ALNUM + "_-", 20, 40) + "." + _chars(r, _ALNUM + "_-", 16, 40),
            lambda: "xoxb-" + _chars(r, string.digits, 10, 12) + "-" + _chars(r, _ALNUM, 20, 28),
            lambda: "AIza" + _chars(r, _ALNUM + "_-", 35, 35),
            lambda: _chars(r, string.ascii_letters, 18, 40),
            lambda: _chars(r, _ALNUM + "!#$%*^~", 10, 18),
            lambda: _chars(r, _ALNUM, 12, 20),
            lambda: "".join(r.choice(_SYLLABLES).title() for _ in range(r.randint(2, 3))) + r.choice("!#$%*") + str(r.randint(10, 9999)),
            lambda: "".join(r.choice(_SYLLABLES) for _ in range(3)).title() + str(r.randint(10, 9999)) + r.choice("!#$%*") + _chars(r, _ALNUM, 1, 3),
            lambda: "/".join(_chars(r, _ALNUM + "+", 14, 22) for _ in range(r.randint(2, 4))),
        ]
    )()


def _look_alike(r: random.Random) -> tuple[str, str]:
    """(what stands before it, a run that is no secret)"""
    word = lambda: "".join(r.choice(_SYLLABLES) for _ in range(r.randint(2, 5)))
    return r.choice(
        [
            lambda: (r.choice(["sha256:", "md5 ", "checksum = ", "digest: ", "etag: ", "integrity ", "commit ", "rev "]), _chars(r, _HEX, 32, 64)),
            lambda: (r.choice(["id ", "uuid: ", "request ", ""]), "-".join(_chars(r, _HEX, n, n) for n in (8, 4, 4, 4, 12))),
            lambda: ("", word() + word() + word() + str(r.randint(1, 2030))),
            lambda: ("", "_".join(word() for _ in range(r.randint(2, 4))) + f"_{r.randint(0, 99)}"),
            lambda: (r.choice(["https://", "see ", "path ", "/"]), "/".join([*(word() for _ in range(r.randint(2, 5))), str(r.randint(1, 9999)) + ".html"])),
            lambda: (r.choice(["on ", "at ", "time "]), f"{r.randint(1990, 2030)}-{r.randint(1, 12):02}-{r.randint(1, 28):02}T{r.randint(10, 23)}"),
            lambda: (r.choice(["image ", "font ", "data:image/png;base64,"]), "iVBORw0KGgo" + _chars(r, _ALNUM + "+/", 20, 60)),
            lambda: (r.choice(["", "account ", "IBAN "]), r.choice(["DE", "FR", "ES", "GB"]) + _chars(r, string.digits, 16, 22)),
            lambda: (r.choice(["mail ", "contact "]), f"{word()}.{word()}{r.randint(1, 999)}-{word()}.example.com"),
            lambda: ("version ", f"{word()}-{r.randint(0, 9)}.{r.randint(0, 99)}.{r.randint(0, 99)}-{word()}-build"),
            lambda: ("", f"{word()}-{word()}-{word()}-{r.randint(1, 99)}"),
            lambda: (r.choice([f"{word()}@", f"write to {word()}.{word()}@"]), f"{r.choice(['mail', word()])}{r.choice(['', str(r.randint(1, 99))])}.{word()}.{r.choice(['com', 'org', 'de'])}"),
            lambda: (r.choice(["", "the ", "in "]), (lambda w: w[:2].upper() + w[2:] + r.choice(["", "s", "en"]))(word() + word())),
            lambda: (r.choice(["", "at ", "host "]), f"{word()}{r.randint(1, 99)}.{word()}.{r.choice(['com', 'org', 'de'])}"),
            lambda: (r.choice(["", "the ", "see "]), word() + word() + str(r.randint(1, 9999))),
            lambda: (r.choice(["", "call ", "class ", "by "]), "".join(word().title() for _ in range(r.randint(2, 4)))),
            lambda: (r.choice(["", "run ", "var "]), word() + "".join(word().title() for _ in range(r.randint(1, 3))) + r.choice(["", "()"])),
            lambda: (r.choice(["file ", "", "open "]), f"{word()}{r.randint(1, 2030)}" + r.choice([".pdf", ".txt", ".html", ".jpg", ".tar.gz"])),
            lambda: (r.choice(["", "mail ", "write to "]), f"{word()}.{word()}{r.randint(1, 999)}"),
            lambda: (r.choice(["", "phone ", "tel "]), f"+{r.randint(1, 99)}-{r.randint(100, 999)}-{r.randint(100000, 9999999)}x{r.randint(1, 99)}"),
            lambda: (r.choice(["user ", "by ", ""]), f"{word()}_{word()}{r.randint(1, 2020)}"),
            lambda: (r.choice(["", "costs ", "weighs "]), f"{r.randint(1000, 99999)}.{r.randint(0, 99):02}{r.choice(['EUR', 'USD', 'kg', 'km'])}"),
            lambda: (r.choice(["ISBN ", "no. ", "part "]), f"{r.randint(100, 999)}-{r.randint(1000, 99999)}-{r.choice('ABX')}{r.randint(1, 99)}"),
            lambda: (r.choice(["", "at "]), f"{word()}!{word()}".upper().title() + "s" * r.randint(0, 1)),
        ]
    )()


def labelled_findings(n: int, seed: int = 7) -> list[tuple[str, int, int, int]]:
    """``n`` rows (text, start, end, label), about half of them secrets."""
    r = random.Random(seed)
    rows = []
    keys = ["client_secret", "auth", "bearer", "credential", "private_key", "access_key", "pwd", "pass", "key", "signing_key", "webhook", "session"]
    for _ in range(n):
        before = _prose(r, r.randint(0, 6))
        if r.random() < 0.5:
            run, label = _secret(r), 1
            quote = r.choice(["", '"', "'"])
            lead = r.choice([f"postgres://{_prose(r, 1)}:", f"{_prose(r, 1)} ", f"{_prose(r, 1)} is {quote}", f"{r.choice(keys)}{r.choice([' = ', '=', ': ', ' '])}{quote}", f"Authorization: Bearer {quote}", f"{r.choice(keys).upper()}={quote}", quote])
        else:
            lead, run = _look_alike(r)
            label, quote = 0, ""
        head = f"{before} {lead}".lstrip()
        rows.append((f"{head}{run}{quote} {_prose(r, r.randint(0, 5))}", len(head), len(head) + len(run), label))
    return rows


# ---- the network -----------------------------------------------------------------------------------------------------

_PAD, _OTHER = 0, 96


def encode(texts: list[str], spans: list[tuple[int, int]]) -> np.ndarray:
    """Character ids, one row per window: context, the window's characters, context; 0 where there is none."""

    def ids(part: str) -> list[int]:
        return [ord(c) - 31 if 32 <= ord(c) < 127 else _OTHER for c in part]

    out = np.full((len(spans), _WIDTH), _PAD, np.int64)
    for row, text, (start, end) in zip(out, texts, spans):
        left, inside, right = ids(text[max(0, start - _LEFT) : start]), ids(text[start : min(end, start + _HEAD)]), ids(text[end : end + _RIGHT])
        row[_LEFT - len(left) : _LEFT] = left
        row[_LEFT : _LEFT + len(inside)] = inside
        row[_WIDTH - _RIGHT : _WIDTH - _RIGHT + len(right)] = right
    return out


def windows(start: int, end: int) -> list[tuple[int, int]]:
    """The parts of a candidate that the network sees one by one: itself, or overlapping windows that cover all of it."""
    starts = range(start, max(start + 1, end - _HEAD + _STEP), _STEP) if end - start > _HEAD else (start,)
    return [(a, min(end, a + _HEAD)) for a in starts]


_INSIDE = np.zeros(_WIDTH, bool)
_INSIDE[_LEFT : _LEFT + _HEAD] = True


class Network(NamedTuple):
    embedding: np.ndarray
    kernel: np.ndarray
    bias: np.ndarray
    out: np.ndarray
    out_bias: np.ndarray
    slope: float = 1.0
    shift: float = 0.0
    threshold: float = 0.5

    def _forward(self, ids: np.ndarray) -> tuple:
        x = self.embedding[ids]
        x = np.concatenate([x, np.broadcast_to(_INSIDE[None, :, None], (*ids.shape, 1)).astype(np.float32)], 2)
        n, width, depth = x.shape
        size = self.kernel.shape[0] // depth
        windows = np.lib.stride_tricks.sliding_window_view(x, size, axis=1).transpose(0, 1, 3, 2).reshape(n, width - size + 1, -1)
        act = np.maximum(windows @ self.kernel + self.bias, 0)
        inside = _INSIDE[size // 2 : size // 2 + act.shape[1]]
        parts = [act[:, inside].argmax(1), act[:, ~inside].argmax(1)]
        pooled = np.concatenate([act[:, inside].max(1), act[:, ~inside].max(1), act[:, inside].mean(1)], 1)
        return windows, act, inside, parts, pooled, pooled @ self.out + self.out_bias

    def logits(self, ids: np.ndarray) -> np.ndarray:
        return np.concatenate([np.empty(0, np.float32), *[self._forward(ids[k : k + 256])[-1] for k in range(0, len(ids), 256)]])

    def scores(self, ids: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-(self.slope * self.logits(ids) + self.shift)))


def train(rows: list[tuple[str, int, int, int]], recall: float = 0.98, filters: int = 24, depth: int = 6, size: int = 5, epochs: int = 6, seed: int = 3) -> Network:
    """Fits the network on three quarters of ``rows`` (Adam on the logistic loss), calibrates it on the rest."""
    rng = np.random.default_rng(seed)
    ids = encode([r[0] for r in rows], [(r[1], r[2]) for r in rows])
    label = np.array([r[3] for r in rows], np.float32)
    held = rng.permutation(len(rows)) % 4 == 0
    f32 = lambda *shape: (rng.standard_normal(shape) / np.sqrt(shape[0])).astype(np.float32)
    weights = [f32(_OTHER + 1, depth) * 3, f32(size * (depth + 1), filters), np.zeros(filters, np.float32), f32(3 * filters), np.zeros(1, np.float32)]
    first, second = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights]
    fit = np.flatnonzero(~held)
    step = 0
    for _ in range(epochs):
        rng.shuffle(fit)
        for k in range(0, len(fit), 64):
            batch = fit[k : k + 64]
            windows, act, inside, (top_in, top_out), pooled, logit = Network(*weights)._forward(ids[batch])
            n = len(batch)
            d_logit = (1 / (1 + np.exp(-logit)) - label[batch]) / n
            d_pool = d_logit[:, None] * weights[3]
            d_act = np.zeros_like(act)
            row, col = np.arange(n)[:, None], np.arange(filters)[None, :]
            where_in, where_out = np.flatnonzero(inside), np.flatnonzero(~inside)
            d_act[row, where_in[top_in], col] += d_pool[:, :filters]
            d_act[row, where_out[top_out], col] += d_pool[:, filters : 2 * filters]
            d_act[:, inside] += d_pool[:, None, 2 * filters :] / inside.sum()
            d_act *= act > 0
            flat = d_act.reshape(-1, filters)
            d_windows = (flat @ weights[1].T).reshape(n, act.shape[1], size, depth + 1)
            d_embedding = np.zeros_like(weights[0])
            for i in range(size):
                at = ids[batch][:, i : i + act.shape[1]].ravel()
                for j in range(depth):
                    d_embedding[:, j] += np.bincount(at, d_windows[:, :, i, j].ravel(), _OTHER + 1)
            grads = [d_embedding, windows.reshape(-1, windows.shape[2]).T @ flat, flat.sum(0), pooled.T @ d_logit, d_logit.sum(keepdims=True)]
            step += 1
            for w, g, m, v in zip(weights, grads, first, second):
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                w -= 0.01 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    net = Network(*weights)
    raw, truth = net.logits(ids[held]).astype(float), label[held]
    slope, shift = 1.0, 0.0
    for _ in range(200):  # Platt scaling
        p = 1 / (1 + np.exp(-(slope * raw + shift)))
        slope -= 0.05 * np.mean((p - truth) * raw)
        shift -= 0.05 * np.mean(p - truth)
    net = net._replace(slope=slope, shift=shift)
    # the recall is that of the whole scan: a held-out secret that no candidate touches counts as missed
    secrets = [rows[k] for k in np.flatnonzero(held) if rows[k][3] and not any(s[0] < rows[k][2] and rows[k][1] < s[1] for s in base_spans(rows[k][0]))]
    best = np.zeros(len(secrets))
    for k, (text, start, end, _) in enumerate(secrets):
        touching = [c for c in candidates(text, base_spans(text)) if c[0] < end and start < c[1]]
        if touching:
            best[k] = max(span_scores([text] * len(touching), touching, net))
    threshold = float(np.sort(best)[int((1 - recall) * len(best))]) if len(best) else 0.5
    # a threshold under the one that the recall asks for only adds recall; from even odds on, a finding counts
    return net._replace(threshold=min(max(threshold, 0.01), 0.5))


def span_scores(texts: list[str], spans: list[tuple[int, int]], network: Network) -> np.ndarray:
    """Each candidate's score: the greatest of its windows'."""
    parts = [windows(*span) for span in spans]
    owner = np.repeat(np.arange(len(spans)), [len(p) for p in parts])
    scores = network.scores(encode([texts[k] for k in owner], [w for p in parts for w in p]))
    out = np.zeros(len(spans))
    np.maximum.at(out, owner, scores)
    return out


FINDINGS, RECALL = 9000, 0.98


@lru_cache(maxsize=1)
def default_network() -> Network:
    return train(labelled_findings(FINDINGS), RECALL)


# ---- scanning --------------------------------------------------------------------------------------------------------


def scan_texts(texts: list[str], network: Network) -> list[tuple[list[Span], list[Span]]]:
    """For each text, its base spans and the spans that the network adds; whole texts, candidates in one batch."""
    base = [base_spans(t) for t in texts]
    which, spans = [], []
    for k, text in enumerate(texts):
        for span in candidates(text, base[k]):
            which.append(k)
            spans.append(span)
    added: list[list[Span]] = [[] for _ in texts]
    if spans:
        for k, (a, b), score in zip(which, spans, span_scores([texts[k] for k in which], spans, network)):
            if score >= network.threshold:
                added[k].append((a, b, "network"))
    return list(zip(base, added))


def _listed(spans: list[Span]) -> str:
    return ",".join(f"{kind}:{a}:{b}" for a, b, kind in sorted(spans, key=lambda s: (s[0], KINDS[s[2]], s[1])))


def find_secrets(docs: DataFrame, network: Network | None = None) -> DataFrame:
    """Per row: doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_network.

    Spans are whole matches in code points, end exclusive. A null text counts as empty; texts are scanned whole,
    repeated rows each.
    """
    net = network or default_network()
    names = ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_network"]
    types = [pa.int64(), *[pa.int64()] * 3, pa.string(), pa.string(), pa.int64()]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 500):
                part = batch.slice(k, 500)
                found = scan_texts([t or "" for t in part.column(1).to_pylist()], net)
                count = lambda kind: [sum(s[2] == kind for s in b) for b, _ in found]
                columns = [
                    part.column(0).to_pylist(),
                    *[count(b[0]) for b in BASE],
                    [hashlib.sha256(_listed(b).encode()).hexdigest() for b, _ in found],
                    [_listed(b + a) for b, a in found],
                    [len(a) for _, a in found],
                ]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names)

    schema = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_network long"
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(scan, schema)


MASK = "[secret]"


def redacted(text: Column, network: Network | None = None) -> Column:
    """``text`` with each found span replaced by MASK; overlapping spans are one. Null stays null."""
    net = network or default_network()

    @F.pandas_udf("string")
    def mask(texts: pd.Series) -> pd.Series:
        out = texts.tolist()
        for k, (base, added) in enumerate(scan_texts([t or "" for t in out], net)):
            end, parts = 0, []
            for a, b, _ in sorted(base + added):
                if a >= end:
                    parts += [out[k][end:a], MASK]
                end = max(end, b)
            if parts:
                out[k] = "".join([*parts, out[k][end:]])
        return pd.Series(out, dtype=object)

    return mask(text)


def without_secrets(docs: DataFrame, network: Network | None = None) -> DataFrame:
    """``docs`` with secrets masked in their texts, and n_chars, if there is such a column, set anew for changed texts."""
    masked = docs.withColumn("__masked", redacted(F.col("text").cast("string"), network))
    columns = []
    for c in docs.columns:
        if c == "text":
            columns.append(F.col("__masked").alias("text"))
        elif c == "n_chars":
            changed = F.col("__masked") != F.col("text").cast("string")
            size = F.length("__masked").cast(docs.schema["n_chars"].dataType)
            columns.append(F.when(changed, size).otherwise(F.col("n_chars")).alias("n_chars"))
        else:
            columns.append(F.col(f"`{c}`"))
    return masked.select(*columns)
