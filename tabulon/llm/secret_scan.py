"""Secret scan: a small character convolutional network in numpy over every candidate and its context.

Candidates are found in the bytes of whole texts, each row by itself: runs of 16 or more of [A-Za-z0-9+/_.-] that hold
a digit, or of 20 or more that go from small to capital letters CASES times at least; values assigned to names such as
password, token or key, quoted ones up to the closing quote; passwords in URLs; and private key blocks. Each candidate
with CONTEXT bytes on either side goes through the network: embedding, convolution, pooling over candidate and left
context apart, a hidden layer. Candidates go in groups of bounded size, and a very long one in overlapping windows
whose maxima and sums are carried on, so that memory is bounded and nothing is cut off. The network is trained on labelled
findings (generated from seeds, in many formats, with look-alikes such as checksums, commits, card numbers and file
names as negatives). On held-out findings the scores are calibrated by a logistic fit and the threshold set as high as
a recall of RECALL allows.

Defined results: NULL and empty texts, and empty tables, have no findings; very long texts are scanned whole;
overlapping candidates are one, the one that begins first and of those the assigned value before a run; repeated rows
have the same findings each; rows with a NULL doc_id are scanned and redacted too; what a row holds doesn't depend on
its neighbours.
"""

from __future__ import annotations

import base64
import hashlib
import re
import string
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .base import documents, id_text, map_batches, ready
from .kernel import buffers, slices

CONTEXT, RECALL, FINDINGS, MASK = 24, 0.995, 7000, "[SECRET]"
NAME = re.compile(rb"""(?:pass(?:word|wd|phrase)?|pwd|secret|token|key|auth|bearer|credentials?)["']?\s{0,2}$""", re.I)
VALUE = re.compile(rb"""[=:]{1,2}>?\s{0,2}(?:"([^"\n\xff]{6,})"|'([^'\n\xff]{6,})'|["']?([^\s"'<>,;\xff]{6,}))""")
URL = re.compile(rb"""://[^\s/:@"'<>\xff]{1,64}:([^\s/@"'<>\xff]{6,})@[A-Za-z0-9]""")
BLOCK = re.compile(rb"-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----(?:[A-Za-z0-9+/=\s:,-]*?-----END [A-Z ]{0,20}PRIVATE KEY-----)?")
#: Ends each row in the buffer that is scanned; no text has it, and no pattern takes it.
ROW_END, CASES, CELLS, WINDOW = 0xFF, 3, 1 << 17, 4096
_RUN = np.zeros(256, bool)
_RUN[[ord(c) for c in string.ascii_letters + string.digits + "+/_.-"]] = True
_DIGIT = np.zeros(256, np.int32)
_DIGIT[48:58] = 1


def candidates(data: np.ndarray, at: np.ndarray) -> list[tuple[int, int, int, str]]:
    """(row, start, end, kind) in rows at[0]..at[-1] of the buffer, in order and without overlaps."""
    base = int(at[0])
    part = np.insert(data[base : int(at[-1])], at[1:] - base, ROW_END)
    edges, n = at - base + np.arange(len(at)), len(part)
    raw = part.tobytes()
    found: list[tuple[int, int, int, str]] = []
    if b"-----BEGIN" in raw:
        found += [(m.start(), m.end(), 0, "private_key") for m in BLOCK.finditer(raw)]
    for p in np.flatnonzero((part == 61) | (part == 58)).tolist():
        if raw[p + 1 : p + 3] == b"//" and (m := URL.match(raw, p)):
            found.append((m.start(1), m.end(1), 1, "assigned"))
        if NAME.search(raw, max(0, p - 20), p) and (m := VALUE.match(raw, p)):
            start, end = m.span(m.lastindex)
            while m.lastindex == 3 and end > start + 6 and raw[end - 1] in b".)]}":
                end -= 1
            found.append((start, end, 1, "assigned"))
    inside = np.zeros(n + 2, bool)
    inside[1:-1] = _RUN[part]
    start, end = np.flatnonzero(inside[1:] & ~inside[:-1]), np.flatnonzero(inside[:-1] & ~inside[1:])
    long = end - start >= 16
    start, end = start[long], end[long]
    digits = np.concatenate([[0], np.cumsum(_DIGIT[part], dtype=np.int64)])
    upper, lower = (part >= 65) & (part <= 90), (part >= 97) & (part <= 122)
    turns = np.concatenate([[0, 0], np.cumsum(lower[:-1] & upper[1:])])
    some = (digits[end] > digits[start]) | ((end - start >= 20) & (turns[end] - turns[np.minimum(start + 1, n)] >= CASES))
    for s, e in zip(start[some].tolist(), end[some].tolist()):
        while e > s and raw[e - 1] in b".-/":
            e -= 1
        while e < n and raw[e] == 61:
            e += 1
        if e - s >= 16:
            found.append((s, e, 2, "token"))
    out, last = [], 0
    for s, e, _, kind in sorted(found, key=lambda x: (x[0], x[2], -x[1])):
        if s >= last and e > s:
            row = int(np.searchsorted(edges, s, "right")) - 1
            out.append((row, s - row + base, e - row + base, kind))
            last = e
    return out


def windows(raw: bytes, spans: list[tuple[int, int, int, int]]) -> tuple[np.ndarray, np.ndarray]:
    """Byte classes and parts (1 left, 2 candidate, 3 right, 0 padding) of spans (from, start, end, to), padded to the longest."""
    ids = np.zeros((len(spans), max(t - f for f, _, _, t in spans)), np.int64)
    part = np.zeros(ids.shape, np.int8)
    for i, (f, s, e, t) in enumerate(spans):
        ids[i, : t - f] = np.frombuffer(raw[f:t], np.uint8)
        part[i, : s - f], part[i, s - f : e - f], part[i, e - f : t - f] = 1, 2, 3
    return np.where(ids >= 128, 128, ids), part


class Network:
    E, W, C, H = 8, 5, 24, 20  # embedding, width, channels, hidden

    def __init__(self, seed: int = 7):
        r = np.random.default_rng(seed)
        self.p = {"emb": r.normal(0, 0.3, (129, self.E)), "part": r.normal(0, 0.3, (4, self.E)), "conv": r.normal(0, (2 / (self.W * self.E)) ** 0.5, (self.W * self.E, self.C)), "cb": np.zeros(self.C), "h": r.normal(0, (2 / (3 * self.C)) ** 0.5, (3 * self.C, self.H)), "hb": np.zeros(self.H), "o": r.normal(0, 0.3, self.H), "ob": np.zeros(1)}
        self.p = {k: v.astype(np.float32) for k, v in self.p.items()}
        self.scale, self.shift, self.threshold = 1.0, 0.0, 0.5

    def forward(self, ids: np.ndarray, part: np.ndarray) -> tuple[np.ndarray, tuple]:
        p, half = self.p, self.W // 2
        x = p["emb"][ids] + p["part"][part]
        x[part == 0] = 0
        pad = np.pad(x, ((0, 0), (half, half), (0, 0)))
        cols = np.concatenate([pad[:, k : k + x.shape[1]] for k in range(self.W)], axis=2)
        y = np.maximum(cols @ p["conv"] + p["cb"], 0)
        inside, left = (part == 2)[:, :, None].astype(np.float32), (part == 1)[:, :, None].astype(np.float32)
        size = np.maximum(inside.sum(axis=1), 1).astype(np.float32)
        a, b = y * inside, y * left
        ia, ib = a.argmax(axis=1), b.argmax(axis=1)
        z = np.concatenate([np.take_along_axis(a, ia[:, None], 1)[:, 0], np.take_along_axis(b, ib[:, None], 1)[:, 0], a.sum(axis=1) / size], axis=1)
        hid = np.maximum(z @ p["h"] + p["hb"], 0)
        return hid @ p["o"] + p["ob"][0], (ids, part, cols, y, inside, left, size, ia, ib, z, hid)

    def pooled(self, raw: bytes, span: tuple[int, int, int, int]) -> float:
        """forward of one span of any length, in windows that overlap by the convolution's reach."""
        p, half, (f, s, e, t) = self.p, self.W // 2, span
        most, left, total = np.zeros(self.C, np.float32), np.zeros(self.C, np.float32), np.zeros(self.C, np.float64)
        for k in range(f, t, WINDOW):
            low, high = max(f, k - half), min(t, k + WINDOW + half)
            ids = np.frombuffer(raw[low:high], np.uint8).astype(np.int64)
            place = np.arange(low, high)
            part = np.where(place < s, 1, np.where(place < e, 2, 3))
            x = np.pad(p["emb"][np.where(ids >= 128, 128, ids)] + p["part"][part], ((half, half), (0, 0)))
            y = np.maximum(np.concatenate([x[i : i + high - low] for i in range(self.W)], axis=1) @ p["conv"] + p["cb"], 0)
            own = (place >= k) & (place < k + WINDOW)
            a, b = y[own & (part == 2)], y[own & (part == 1)]
            most, left, total = np.maximum(most, a.max(axis=0, initial=0)), np.maximum(left, b.max(axis=0, initial=0)), total + a.sum(axis=0)
        z = np.concatenate([most, left, (total / max(1, e - s)).astype(np.float32)])
        return float(np.maximum(z @ p["h"] + p["hb"], 0) @ p["o"] + p["ob"][0])

    def gradients(self, g: np.ndarray, kept: tuple) -> dict[str, np.ndarray]:
        p, half = self.p, self.W // 2
        ids, part, cols, y, inside, left, size, ia, ib, z, hid = kept
        d = {"o": hid.T @ g, "ob": np.array([g.sum()])}
        gh = np.outer(g, p["o"]) * (hid > 0)
        d["h"], d["hb"] = z.T @ gh, gh.sum(axis=0)
        gz = gh @ p["h"].T
        gy = (gz[:, 2 * self.C :] / size)[:, None, :] * inside
        rows, chans = np.arange(len(g))[:, None], np.arange(self.C)[None]
        gy[rows, ia, chans] += gz[:, : self.C] * inside[rows, ia, 0]
        gy[rows, ib, chans] += gz[:, self.C : 2 * self.C] * left[rows, ib, 0]
        gy *= y > 0
        d["conv"], d["cb"] = cols.reshape(-1, cols.shape[2]).T @ gy.reshape(-1, self.C), gy.sum(axis=(0, 1))
        gc = gy @ p["conv"].T
        gp = np.zeros((len(g), ids.shape[1] + 2 * half, self.E), np.float32)
        for k in range(self.W):
            gp[:, k : k + ids.shape[1]] += gc[:, :, k * self.E : (k + 1) * self.E]
        gx = gp[:, half : half + ids.shape[1]] * (part > 0)[:, :, None]
        for name, index in (("emb", ids.ravel()), ("part", part.ravel())):
            d[name] = np.stack([np.bincount(index, gx[:, :, k].ravel(), len(p[name])) for k in range(self.E)], axis=1)
        return d

    def probability(self, ids: np.ndarray, part: np.ndarray) -> np.ndarray:
        return self.calibrated(self.forward(ids, part)[0])

    def calibrated(self, logit: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.scale * logit + self.shift, -30, 30)))

    def scores(self, raw: bytes, spans: list[tuple[int, int, int, int]]) -> np.ndarray:
        """Calibrated scores of spans, in groups of CELLS bytes at most; longer spans by themselves."""
        width, out, k = np.array([t - f for f, _, _, t in spans], np.int64), np.zeros(len(spans)), 0
        order = np.argsort(width, kind="stable")
        while k < len(order):
            if width[order[k]] > WINDOW:
                out[order[k]] = self.calibrated(np.array(self.pooled(raw, spans[order[k]])))
                k += 1
                continue
            last = k + 1
            while last < len(order) and width[order[last]] <= WINDOW and (last + 1 - k) * width[order[last]] <= CELLS:
                last += 1
            own = order[k:last]
            out[own] = self.probability(*windows(raw, [spans[x] for x in own]))
            k = last
        return out


def labelled_findings(n: int = FINDINGS, seed: int = 13) -> list[tuple[bytes, int, int, int]]:
    """(text, start, end, label): secrets in many formats and look-alikes, in made-up prose."""
    r = np.random.default_rng(seed)
    pick = lambda s, k: "".join(r.choice(list(s), k))
    one = lambda *x: str(r.choice(list(x)))
    alnum, hexa, lower = string.ascii_letters + string.digits, "0123456789abcdef", string.ascii_lowercase
    size = lambda a, b: int(r.integers(a, b))
    b64 = lambda k: base64.b64encode(r.bytes(k)).decode()

    def word() -> str:
        w = "".join(one("th", "er", "in", "an", "la", "ou", "sch", "ung", "ció", "des", "ment", "ö", "é", "re", "ti", "ble") for _ in range(size(1, 5)))
        return w.capitalize() if r.random() < 0.1 else w.upper() + "!!" if r.random() < 0.05 else w + one("", "", "", "", ",", ".", "***", " |")

    prose = lambda a, b: " ".join(word() for _ in range(size(a, b)))
    opened = lambda: one('="', " = \"", ": '", ": ", "=", " = ", ":")

    def secret() -> tuple[str, str]:
        k = size(0, 12)
        if k == 10:
            return one("https://", "http://", "postgres://", "ftp://") + pick(lower, size(3, 9)) + ":", pick(alnum + "!$%&*", size(8, 20))
        if k == 11:
            return one("password", "passphrase", "secret", "PASSWORD", "db_password") + one('="', ' = "', ': "'), " ".join(pick(lower, size(3, 8)) for _ in range(size(2, 5)))
        if k < 4:
            name = one("password", "passwd", "pwd", "token", "secret", "api_key", "apikey", "API_KEY", "access_key", "auth", "SECRET_KEY", "client_secret", "PASSWORD", "Token", "bearer", "db_password", "private_key")
            value = one(pick(hexa, size(16, 65)), pick(hexa, size(16, 25)), pick(alnum, size(10, 44)), b64(size(12, 40)), pick(lower, size(3, 7)) + pick(string.digits, size(2, 5)) + pick("!@#$%&*", 1) + pick(alnum, size(1, 5)))
            return name + opened(), value
        if k < 6:
            return "", one("AKIA", "AKIA", "ASIA") + pick(string.ascii_uppercase + string.digits, 16)
        if k < 8:
            return "", one("ghp_", "gho_", "github_pat_", "xoxb-", "xoxp-", "sk-", "sk_live_", "rk_live_", "AIza", "glpat-", "npm_", "SG.") + pick(alnum, size(20, 40))
        if k < 9:
            return one("", "Bearer ", "token "), "eyJ" + b64(size(12, 20)).rstrip("=").replace("+", "-").replace("/", "_") + ".eyJ" + b64(size(15, 40)).rstrip("=").replace("/", "_") + "." + b64(32).rstrip("=").replace("/", "_")
        return "", "-----BEGIN " + one("RSA ", "EC ", "OPENSSH ", "") + "PRIVATE KEY-----" + one("", "\n" + b64(48) + "\n" + b64(48))

    def harmless() -> tuple[str, str]:
        k = size(0, 14)
        if k == 0:
            return one("commit ", "rev ", "git checkout ", "blob "), pick(hexa, 40)
        if k == 1:
            return one("md5 ", "sha1 ", "sha256:", "checksum ", "digest ", "etag ", "md5sum "), pick(hexa, size(32, 65))
        if k == 2:
            return one("", "card ", "order "), pick(string.digits, size(16, 20))
        if k == 3:
            return "", "-".join(pick(hexa, x) for x in (8, 4, 4, 4, 12))
        if k == 4:
            return one("http://", "https://"), word().strip(",.*| !") + ".example.com/" + pick(lower, size(3, 9)) + "/" + pick(string.digits, size(2, 9))
        if k == 5:
            return "", pick(lower, size(4, 12)) + one("_", "-", ".") + pick(string.digits, 4) + one("_final", "-v2", "_draft", "-summary") + one(".pdf", ".docx", ".csv", ".html")
        if k == 6:
            return "", f"20{size(10, 30)}-{size(1, 13):02d}-{size(1, 29):02d}T{size(0, 24):02d}" + one("", ".000000")
        if k == 7:
            return one("token", "secret", "key", "password", "auth", "Key", "Password") + one(": ", " : "), one("required", "optional", "forgotten", "patience", pick(lower, size(6, 14)), "undefined", "example", "unknown")
        if k == 8:
            return one("version ", "v", "release "), ".".join(pick(string.digits, size(1, 4)) for _ in range(6)) + "-" + one("beta", "rc1", "snapshot")
        if k == 9:
            return "", "+".join(pick(lower, size(3, 8)) for _ in range(3)) + pick(string.digits, 2)
        if k == 10:
            return "", "/".join(pick(lower, size(3, 8)) for _ in range(3)) + "/" + pick(string.digits, size(1, 5))
        if k == 11:
            return "data:image/png;base64,", b64(size(30, 60))
        if k == 12:
            return "", "".join(one("th", "er", "in", "an", "la", "ou", "re", "ti", "ble") for _ in range(size(7, 12))) + pick(string.digits, size(1, 4))
        return one("+", "00"), "-".join(pick(string.digits, size(3, 5)) for _ in range(4)) + one("", "-00")

    out = []
    for _ in range(n):
        label = int(r.random() < 0.5)
        before, value = secret() if label else harmless()
        left = prose(0, 8)
        head = (left + (" " if left else "") + before).encode()
        body = value.encode()
        if label and before.endswith(":") and "://" in before:
            tail = "@" + pick(lower, size(3, 9)) + one(".example.com", ".test", ":5432/x") + " "
        elif " " in value and before[-1:] in ("'", '"'):
            tail = before[-1] + " " + prose(0, 6)
        else:
            tail = (one('"', "'", "", "", ".", ",", "\n") if before[-1:] in "\"'" and before else one("", "", "", ".", ",", "\n", "***", "###", "$$$", "%%%", "&&&", "!!")) + " " + prose(0, 6)
        out.append((head + body + tail.encode(), len(head), len(head) + len(body), label))
    return out


def _around(start: int, end: int, low: int, high: int) -> tuple[int, int, int, int]:
    return max(low, start - CONTEXT), start, end, min(high, end + CONTEXT)


@lru_cache(maxsize=1)
def trained() -> Network:
    """The network, fitted on three quarters of the labelled findings and calibrated on the rest."""
    found = labelled_findings()
    net, r = Network(), np.random.default_rng(3)
    m, v, step = {k: np.zeros_like(x) for k, x in net.p.items()}, {k: np.zeros_like(x) for k, x in net.p.items()}, 0
    cut = len(found) * 3 // 4
    y = np.array([f[3] for f in found], float)

    def batch(index: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        raw, spans, at = b"", [], 0
        for i in index:
            t, s, e, _ = found[i]
            spans.append(_around(at + s, at + e, at, at + len(t)))
            raw += t
            at += len(t)
        return windows(raw, spans)

    for epoch in range(6):
        order = r.permutation(cut)
        for k in range(0, cut, 64):
            index = order[k : k + 64]
            logit, kept = net.forward(*batch(index))
            g = net.gradients(((1 / (1 + np.exp(-np.clip(logit, -30, 30))) - y[index]) / len(index)).astype(np.float32), kept)
            step += 1
            for name, d in g.items():
                m[name] = 0.9 * m[name] + 0.1 * d
                v[name] = 0.999 * v[name] + 0.001 * d * d
                net.p[name] -= ((0.004 if epoch < 4 else 0.001) * (m[name] / (1 - 0.9**step)) / (np.sqrt(v[name] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
    held = np.arange(cut, len(found))
    logit = np.concatenate([net.forward(*batch(held[i : i + 256]))[0] for i in range(0, len(held), 256)])
    a, b = 1.0, 0.0
    for _ in range(400):  # Platt's scaling
        q = 1 / (1 + np.exp(-np.clip(a * logit + b, -30, 30))) - y[held]
        a, b = a - 0.1 * float((q * logit).mean()) / max(1.0, float((logit**2).mean())), b - 0.1 * float(q.mean())
    net.scale, net.shift = a, b
    good = np.sort((1 / (1 + np.exp(-np.clip(a * logit + b, -30, 30))))[y[held] == 1])
    net.threshold = min(0.5, float(good[int((1 - RECALL) * len(good))]))
    return net


def findings(net: Network, data: np.ndarray, at: np.ndarray) -> list[tuple[int, int, int, str, float]]:
    """(row, start, end, kind, score) of all that reaches the threshold."""
    out = []
    for i, j in slices(at):
        own = candidates(data, at[i : j + 1])
        if not own:
            continue
        base = int(at[i])
        raw = data[base : int(at[j])].tobytes()
        spans = [_around(s - base, e - base, int(at[i + row]) - base, int(at[i + row + 1]) - base) for row, s, e, _ in own]
        score = net.scores(raw, spans)
        out += [(i + row, s, e, kind, float(p)) for (row, s, e, kind), p in zip(own, score) if p >= net.threshold]
    return out


def scan(docs: DataFrame) -> DataFrame:
    """(doc_id, start, end, kind, score, secret_sha256) of each finding; start and end count characters. The secret itself isn't carried on."""
    told = ready(docs.sparkSession).sparkContext.broadcast(trained())

    def f(b: pa.RecordBatch) -> pa.RecordBatch:
        data, at = buffers(b.column("text"))
        rows, start, end, kind, score, sha = [], [], [], [], [], []
        for row, s, e, k, p in findings(told.value, data, at):
            head = len(data[at[row] : s].tobytes().decode("utf-8", "replace"))
            own = data[s:e].tobytes()
            rows.append(row)
            start.append(head)
            end.append(head + len(own.decode("utf-8", "replace")))
            kind.append(k)
            score.append(round(p, 6))
            sha.append(hashlib.sha256(own).hexdigest())
        return pa.record_batch([b.column("doc_id").take(pa.array(rows, pa.int64())), pa.array(start, pa.int32()), pa.array(end, pa.int32()), pa.array(kind, pa.string()), pa.array(score, pa.float64()), pa.array(sha, pa.string())], ["doc_id", "start", "end", "kind", "score", "secret_sha256"])

    return map_batches(id_text(docs), f, "doc_id bigint, start int, end int, kind string, score double, secret_sha256 string")


def redact(docs: DataFrame) -> DataFrame:
    """All rows of docs, each finding replaced by MASK; n_chars, where there is such a column, is counted anew."""
    told, text = ready(docs.sparkSession).sparkContext.broadcast(trained()), docs.columns.index("text")

    def f(b: pa.RecordBatch) -> pa.RecordBatch:
        column = b.column(text)
        data, at = buffers(column)
        by: dict[int, list[tuple[int, int]]] = {}
        for row, s, e, _, _ in findings(told.value, data, at):
            by.setdefault(row, []).append((s, e))
        if not by:
            return b
        values = column.to_pylist()
        for row, spans in by.items():
            pieces, last = [], int(at[row])
            for s, e in spans:
                pieces += [data[last:s].tobytes(), MASK.encode()]
                last = e
            values[row] = b"".join([*pieces, data[last : int(at[row + 1])].tobytes()]).decode("utf-8", "replace")
        return b.set_column(text, b.schema.field(text), pa.array(values, column.type))

    out = map_batches(docs, f, docs.schema)
    return out.withColumn("n_chars", F.length("text").cast(out.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(documents(spark, sf_dir))
