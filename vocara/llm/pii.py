"""Personal data in whole texts: base patterns, and a character tagger that adds spans.

Base spans (email, ip, card, phone) follow fixed patterns, leftmost and non-overlapping per
kind; matches that fail their check are dropped without a retry. They always stay.

The tagger is a character-level bidirectional LSTM with a CRF over begin/inside tags, written
and trained in numpy. Its labelled spans come from windows of the corpus: the base spans found
there, and numbers and addresses of known kind set into other windows, next to look-alikes
(versions, hexadecimal keys, amounts) that carry no label. At most ``TRAIN_WINDOWS`` windows are
drawn, by hash.

Inference covers every place that can hold a span: the surroundings of every digit and every @.
Such regions are cut into overlapping windows; the scores of all windows over a character are
averaged, weighted to their middle, and one Viterbi pass over the whole region decides, so no
span is cut at a window's edge. A tagged span is added when it overlaps no base span and has the
digits (or the @) of its kind.

Cases: a null or empty text has no spans; positions count code points; rows without a doc_id
are left out of the spans and passed on unchanged by ``redact``; repeated rows give a row each;
other columns are ignored by ``find_spans`` and kept by ``redact``; an empty table gives an empty
result, and a corpus without a digit or an @ needs no tagger.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone")
# Fixed patterns. Possessive runs and the look-behind change no match; they keep long runs linear.
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DIGIT = re.compile(r"[0-9]")
_TRIGGER = re.compile(r"[0-9@]")

TRAIN_WINDOWS = 1536
WINDOW = 80
STEP = 40
REACH = 20
EMBED, HIDDEN = 10, 20
TAGS = 1 + 2 * len(KINDS)
ROUNDS = 260
BATCH = 48


def luhn(digits: str) -> bool:
    total = sum(int(d) for d in digits[-1::-2]) + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) by the fixed patterns, sorted by start, then kind."""
    found: list[tuple[str, int, int]] = []
    last, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > last and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            found.append(("email", start, m.end()))
            last = m.end()
        at = text.find("@", max(at + 1, last))
    if _DIGIT.search(text):
        for m in _IP.finditer(text):
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
                found.append(("ip", m.start(), m.end()))
        for m in _CARD.finditer(text):
            digits = m[0].replace(" ", "").replace("-", "")
            if 12 <= len(digits) <= 19 and luhn(digits):
                found.append(("card", m.start(), m.end()))
        for m in _PHONE.finditer(text):
            if 9 <= sum(c in "0123456789" for c in m[0]) <= 15:
                found.append(("phone", m.start(), m.end()))
    return _sorted(found)


def _sorted(spans: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    return sorted(spans, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def regions(text: str) -> list[tuple[int, int]]:
    """Stretches around digits and @, merged."""
    out: list[list[int]] = []
    for m in _TRIGGER.finditer(text):
        low, high = max(0, m.start() - REACH), min(len(text), m.start() + REACH + 1)
        if out and low <= out[-1][1]:
            out[-1][1] = high
        else:
            out.append([low, high])
    return [(a, b) for a, b in out]


def encode(text: str) -> np.ndarray:
    """Symbols: printable ASCII by itself, then white space, other letters, the rest; 0 pads."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    out = np.where((points >= 33) & (points < 127), points - 32, 97).astype(np.int64)
    out[(points == 32) | ((points >= 9) & (points <= 13))] = 95
    out[points >= 192] = 96
    return out


SYMBOLS = 98


# --- the model -------------------------------------------------------------------------------


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


class Tagger:
    """Embedding -> forward and backward LSTM -> tag scores; CRF transitions on top."""

    def __init__(self, seed: int = 11):
        rng = np.random.default_rng(seed)
        draw = lambda *shape: (rng.standard_normal(shape) / np.sqrt(shape[0])).astype(np.float32)
        self.p = {"embed": rng.standard_normal((SYMBOLS, EMBED)).astype(np.float32) * 0.5}
        for side in "fb":
            self.p[f"w{side}"] = draw(EMBED + HIDDEN, 4 * HIDDEN)
            self.p[f"c{side}"] = np.zeros(4 * HIDDEN, dtype=np.float32)
            self.p[f"c{side}"][HIDDEN : 2 * HIDDEN] = 1
        self.p["out"], self.p["bias"] = draw(2 * HIDDEN, TAGS), np.zeros(TAGS, dtype=np.float32)
        self.p["move"], self.p["start"] = np.zeros((TAGS, TAGS), dtype=np.float32), np.zeros(TAGS, dtype=np.float32)

    def _run(self, x: np.ndarray, side: str, keep: bool) -> tuple[np.ndarray, list]:
        """States of one direction over time-major inputs."""
        steps, n, _ = x.shape
        h, c = np.zeros((n, HIDDEN), dtype=np.float32), np.zeros((n, HIDDEN), dtype=np.float32)
        w, b = self.p[f"w{side}"], self.p[f"c{side}"]
        given = x @ w[:EMBED] + b
        out, trace = np.empty((steps, n, HIDDEN), dtype=np.float32), []
        for t in range(steps) if side == "f" else range(steps - 1, -1, -1):
            z = given[t] + h @ w[EMBED:]
            gate = _sigmoid(z[:, : 3 * HIDDEN])
            i, f, o = gate[:, :HIDDEN], gate[:, HIDDEN : 2 * HIDDEN], gate[:, 2 * HIDDEN :]
            g = np.tanh(z[:, 3 * HIDDEN :])
            before = c
            c = f * c + i * g
            s = np.tanh(c)
            if keep:
                trace.append((t, i, f, o, g, before, s, h))
            h = o * s
            out[t] = h
        return out, trace

    def scores(self, symbols: np.ndarray) -> np.ndarray:
        """(windows, length) -> tag scores (windows, length, tags)."""
        x = self.p["embed"][symbols.T]
        both = np.concatenate((self._run(x, "f", False)[0], self._run(x, "b", False)[0]), axis=2)
        return (both @ self.p["out"] + self.p["bias"]).transpose(1, 0, 2)

    def gradients(self, symbols: np.ndarray, tags: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean negative log-likelihood of the CRF and its gradients."""
        n, steps = symbols.shape
        x = self.p["embed"][symbols.T]
        (hf, tf), (hb, tb) = self._run(x, "f", True), self._run(x, "b", True)
        both = np.concatenate((hf, hb), axis=2)
        score = both @ self.p["out"] + self.p["bias"]
        move, rows = self.p["move"], np.arange(n)
        alpha = np.empty_like(score)
        alpha[0] = score[0] + self.p["start"]
        for t in range(1, steps):
            a = alpha[t - 1][:, :, None] + move
            top = a.max(axis=1)
            alpha[t] = score[t] + top + np.log(np.exp(a - top[:, None, :]).sum(axis=1))
        beta = np.zeros_like(score)
        for t in range(steps - 2, -1, -1):
            a = move + (score[t + 1] + beta[t + 1])[:, None, :]
            top = a.max(axis=2)
            beta[t] = top + np.log(np.exp(a - top[:, :, None]).sum(axis=2))
        top = alpha[-1].max(axis=1)
        whole = top + np.log(np.exp(alpha[-1] - top[:, None]).sum(axis=1))
        gold = tags.T
        right = self.p["start"][gold[0]] + sum(score[t, rows, gold[t]] for t in range(steps)) + sum(move[gold[t - 1], gold[t]] for t in range(1, steps))
        d = np.exp(alpha + beta - whole[:, None])
        grad = {"start": d[0].sum(axis=0), "move": np.zeros_like(move)}
        for t in range(1, steps):
            pair = alpha[t - 1][:, :, None] + move + (score[t] + beta[t])[:, None, :] - whole[:, None, None]
            grad["move"] += np.exp(pair).sum(axis=0)
            np.add.at(grad["move"], (gold[t - 1], gold[t]), -1)
        np.add.at(grad["start"], gold[0], -1)
        for t in range(steps):
            d[t, rows, gold[t]] -= 1
        grad["out"], grad["bias"] = np.einsum("tnh,tnk->hk", both, d), d.sum(axis=(0, 1))
        dh = d @ self.p["out"].T
        dx = np.zeros_like(x)
        for side, trace, part in (("f", tf, dh[:, :, :HIDDEN]), ("b", tb, dh[:, :, HIDDEN:])):
            w = self.p[f"w{side}"]
            gw, gc = np.zeros_like(w), np.zeros_like(self.p[f"c{side}"])
            back_h, back_c = np.zeros((n, HIDDEN), dtype=np.float32), np.zeros((n, HIDDEN), dtype=np.float32)
            for t, i, f, o, g, before, s, h in reversed(trace):
                total = part[t] + back_h
                back_c = back_c + total * o * (1 - s * s)
                dz = np.concatenate((back_c * g * i * (1 - i), back_c * before * f * (1 - f), total * s * o * (1 - o), back_c * i * (1 - g * g)), axis=1)
                gw[:EMBED] += x[t].T @ dz
                gw[EMBED:] += h.T @ dz
                gc += dz.sum(axis=0)
                dx[t] += dz @ w[:EMBED].T
                back_h, back_c = dz @ w[EMBED:].T, back_c * f
            grad[f"w{side}"], grad[f"c{side}"] = gw, gc
        grad["embed"] = np.zeros_like(self.p["embed"])
        np.add.at(grad["embed"], symbols.T, dx)
        return float((whole - right).mean()), {k: v / n for k, v in grad.items()}

    def fit(self, symbols: np.ndarray, tags: np.ndarray, rounds: int = ROUNDS, seed: int = 5) -> float:
        """Adam over random batches; returns the last mean loss."""
        rng = np.random.default_rng(seed)
        first = {k: np.zeros_like(v) for k, v in self.p.items()}
        second = {k: np.zeros_like(v) for k, v in self.p.items()}
        loss = 0.0
        for step in range(1, rounds + 1):
            rows = rng.integers(0, len(symbols), BATCH)
            loss, grad = self.gradients(symbols[rows], tags[rows])
            rate = 0.02 * min(1.0, 2 * (1 - step / (rounds + 1)))
            for k, g in grad.items():
                g = np.clip(g, -1, 1)
                first[k] += 0.1 * (g - first[k])
                second[k] += 0.01 * (g * g - second[k])
                self.p[k] = (self.p[k] - rate * first[k] / (1 - 0.9**step) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-6)).astype(np.float32)
        return loss

    def viterbi(self, score: np.ndarray) -> np.ndarray:
        """Best tags of one stretch of any length."""
        best = score[0] + self.p["start"]
        back = np.zeros((len(score), TAGS), dtype=np.int8)
        for t in range(1, len(score)):
            a = best[:, None] + self.p["move"]
            back[t] = a.argmax(axis=0)
            best = a[back[t], np.arange(TAGS)] + score[t]
        tags = np.empty(len(score), dtype=np.int64)
        tags[-1] = best.argmax()
        for t in range(len(score) - 1, 0, -1):
            tags[t - 1] = back[t, tags[t]]
        return tags


def cuts(low: int, high: int) -> list[int]:
    """Starts of the windows over a region: overlapping by half, the last one flush."""
    return [*range(low, max(high - WINDOW, low), STEP), max(high - WINDOW, low)]


_MIDDLE = (np.minimum(np.arange(WINDOW), np.arange(WINDOW)[::-1]) + 1.0).astype(np.float32)[:, None]


def tagged_spans(tagger: Tagger, texts: list[str]) -> list[list[tuple[str, int, int]]]:
    """Spans the tagger sees in each text; windows of all texts go through the network together."""
    jobs = [(n, low, high) for n, text in enumerate(texts) for low, high in regions(text)]
    windows = [(j, at) for j, (_, low, high) in enumerate(jobs) for at in cuts(low, high)]
    summed = {}
    out: list[list[tuple[str, int, int]]] = [[] for _ in texts]
    for chunk in range(0, len(windows), 1024):
        part = windows[chunk : chunk + 1024]
        symbols = np.zeros((len(part), WINDOW), dtype=np.int64)
        for row, (j, at) in enumerate(part):
            n, _, high = jobs[j]
            piece = encode(texts[n][at : min(at + WINDOW, high)])
            symbols[row, : len(piece)] = piece
        for (j, at), score in zip(part, tagger.scores(symbols), strict=True):
            n, low, high = jobs[j]
            if j not in summed:
                summed[j] = [np.zeros((high - low, TAGS), dtype=np.float32), np.zeros((high - low, 1), dtype=np.float32)]
            size = min(WINDOW, high - at)
            summed[j][0][at - low : at - low + size] += (score * _MIDDLE)[:size]
            summed[j][1][at - low : at - low + size] += _MIDDLE[:size]
        done = [j for j in summed if j < part[-1][0] or chunk + 1024 >= len(windows)]
        for j in done:
            total, weight = summed.pop(j)
            n, low, _ = jobs[j]
            out[n].extend(_spans(tagger.viterbi(total / weight), low))
    return out


def _spans(tags: np.ndarray, shift: int) -> list[tuple[str, int, int]]:
    out, start, kind = [], None, None
    for at, tag in enumerate([*tags.tolist(), 0]):
        if start is not None and tag != 2 * kind + 2:
            out.append((KINDS[kind], start + shift, at + shift))
            start = None
        if tag % 2:
            start, kind = at, (tag - 1) // 2
    return out


def plausible(kind: str, part: str) -> bool:
    """Bounds on what the tagger may add."""
    digits = sum(c in "0123456789" for c in part)
    if kind == "email":
        return "@" in part[1:-1] and "." in part
    if kind == "ip":
        return bool(_IP.fullmatch(part))
    return 12 <= digits <= 19 if kind == "card" else 9 <= digits <= 15 and len(part) <= 30


# --- labelled windows ------------------------------------------------------------------------


def _made(kind: str, rng: np.random.Generator) -> str:
    digits = lambda n: "".join(map(str, rng.integers(0, 10, n)))
    word = lambda: "".join(rng.choice(list("abcdefghijklmnoprstuvw"), rng.integers(2, 9)))
    if kind == "email":
        local = word() + rng.choice(["", ".", "_", "-"]) + rng.choice([word(), digits(2)])
        return f"{local}@{word()}{rng.choice(['', digits(1)])}.{rng.choice(['com', 'org', 'net', 'de', 'example.com', 'co.uk'])}"
    if kind == "ip":
        return ".".join(str(x) for x in rng.integers(0, 256, 4))
    if kind == "card":
        d = digits(16)
        return d if rng.random() < 0.6 else rng.choice([" ", "-"]).join(d[i : i + 4] for i in range(0, 16, 4))
    d = digits(10)
    return f"+{rng.integers(1, 99)}" + rng.choice([f" ({d[:3]}) {d[3:6]}-{d[6:]}", f" {d[:3]} {d[3:6]} {d[6:]}", f"-{d[:3]}-{d[3:6]}-{d[6:]}", f"{d}"])


def _decoy(rng: np.random.Generator) -> str:
    digits = lambda n: "".join(map(str, rng.integers(0, 10, n)))
    return rng.choice(
        [
            f'"{"".join(rng.choice(list("0123456789abcdef"), 40))}"',
            f"{digits(1)}.{digits(1)}.",
            digits(int(rng.integers(1, 9))),
            f"{digits(4)}-{digits(2)}-{digits(2)}",
            f"{digits(1)}.{digits(1)}.{digits(2)}",
            f"@{digits(2)}",
            f"{digits(3)},{digits(3)}",
        ]
    )


def labelled(windows: list[str], seed: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """Symbols and tags of training windows: each as it is, and again with made spans set in."""
    rng = np.random.default_rng(seed)
    symbols, tags = [], []

    def add(text: str, spans: list[tuple[str, int, int]]) -> None:
        row, tag = np.zeros(WINDOW, dtype=np.int64), np.zeros(WINDOW, dtype=np.int64)
        piece = encode(text[:WINDOW])
        row[: len(piece)] = piece
        for kind, a, b in spans:
            if a < WINDOW:
                tag[a : min(b, WINDOW)] = 2 * KINDS.index(kind) + 2
                tag[a] -= 1
        symbols.append(row)
        tags.append(tag)

    for window in windows:
        plain = _TRIGGER.sub("x", window).replace("+", "x")
        for source in (window, plain):
            text, spans = "", []
            words = source.split(" ")
            if source is window:
                text, spans = window, [s for s in base_spans(window)]
                lone = [(m.start(), m.end()) for m in re.finditer(r"(?<![\w.@+-])[0-9]{16}(?![\w@-])", window)]
                spans += [("card", a, b) for a, b in lone if not any(x < b and a < y for _, x, y in spans)]
            else:
                for word in words:
                    roll = rng.random()
                    put = KINDS[rng.integers(0, 4)] if roll < 0.18 else None
                    while put:  # spans may follow each other
                        made = _made(put, rng)
                        spans.append((put, len(text), len(text) + len(made)))
                        text += made + rng.choice(["", "", "", ".", ",", "!!", "###", "$$$"]) + " "
                        put = put if rng.random() < 0.4 else None
                    if 0.18 <= roll < 0.3:
                        text += _decoy(rng) + " "
                    text += word + " "
            add(text, spans)
    return np.array(symbols), np.array(tags)


def _windows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        out = []
        for text in batch["text"]:
            for low, high in regions(text or ""):
                middle = max(0, (low + high - WINDOW) // 2)
                out.append(text[middle : middle + WINDOW])
        yield pd.DataFrame({"window": pd.Series(out, dtype=object)})


def train(documents: DataFrame) -> Tagger | None:
    """A tagger for this corpus, or None where no text holds a digit or an @."""
    windows = documents.where(F.col("text").rlike("[0-9@]")).select("text").mapInPandas(_windows, "window string")
    # equal windows share a hash: a large group of copies would crowd the rest out
    rows = windows.distinct().orderBy(F.xxhash64("window"), "window").limit(TRAIN_WINDOWS).toPandas()["window"].tolist()
    if not rows:
        return None
    tagger = Tagger()
    while len(rows) < 64:
        rows = rows + rows
    tagger.fit(*labelled(rows))
    return tagger


def all_spans(tagger: Tagger | None, texts: list[str]) -> list[tuple[list, list]]:
    """(base spans, all spans) of each text."""
    tagged = tagged_spans(tagger, texts) if tagger else [[] for _ in texts]
    out = []
    for text, extra in zip(texts, tagged, strict=True):
        base = base_spans(text)
        more = [(k, a, b) for k, a, b in extra if plausible(k, text[a:b]) and not any(x < b and a < y for _, x, y in base)]
        out.append((base, _sorted(base + more)))
    return out


def _said(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def _found(tagger: Tagger | None):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, len(batch), 1000):
                part = batch.iloc[at : at + 1000]
                out = []
                for doc_id, (base, spans) in zip(part["doc_id"], all_spans(tagger, [t or "" for t in part["text"]]), strict=True):
                    counts = [sum(k == kind for k, _, _ in base) for kind in KINDS]
                    out.append((doc_id, *counts, hashlib.sha256(_said(base).encode()).hexdigest(), _said(spans), len(spans)))
                yield pd.DataFrame(out, columns=["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_spans"])

    return run


def find_spans(documents: DataFrame) -> DataFrame:
    """``doc_id``, base spans per kind, ``base_sha256``, ``spans`` (base and added) and ``n_spans``."""
    rows = documents.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInPandas(
        _found(train(rows)), "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_spans long"
    )


def blanked(text: str, spans: list[tuple[str, int, int]]) -> str:
    """The text with every span replaced by its kind; overlapping spans become one, the first's."""
    out, last = [], 0
    for kind, a, b in spans:
        if a >= last:
            out += [text[last:a], f"[{kind}]"]
        last = max(last, b)
    return "".join([*out, text[last:]])


def redact(documents: DataFrame) -> DataFrame:
    """The same rows and columns with spans replaced in ``text``; ``n_chars`` follows where present."""
    tagger = train(documents)
    counted = "n_chars" in documents.columns

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts = [None if t is None else t for t in batch["text"]]
            found = all_spans(tagger, [t or "" for t in texts])
            clean = [None if t is None else blanked(t, spans) for t, (_, spans) in zip(texts, found, strict=True)]
            out = batch.copy()
            out["text"] = pd.Series(clean, index=out.index, dtype=object)
            yield out

    done = documents.mapInPandas(run, documents.schema)
    return done.withColumn("n_chars", F.when(F.col("n_chars").isNotNull(), F.char_length("text")).cast(documents.schema["n_chars"].dataType)) if counted else done
