"""Personal data in texts: fixed patterns, and a character BiLSTM-CRF for what they miss.

The patterns (email, ip, card, phone) find base spans. The model is trained in numpy on labelled spans: those that the
patterns find in a bounded sample of the corpus and variants of them, set into text of the sample, beside numbers that
are no personal data. It tags the text around every place without which there is no span (a digit, an at sign or a
written-out one) in overlapping windows; each is decoded by the CRF, and the spans of all windows of a document are
reconciled at once: of those that overlap, the set of the largest total score stays. A span that the model adds has to
keep the rule of its kind (Luhn's sum, four numbers up to 255, 9 to 15 digits) and never touches a base span.
"""

from __future__ import annotations

import bisect
import hashlib
import random
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import row_key, slices

KINDS = ("email", "ip", "card", "phone")
#: Snippets of the corpus from which the model learns at most (those drawn by a digest), and their length.
SAMPLE, SNIPPET = 1_500, 160
#: Hidden units of either direction, characters of a window, between their starts, and around a place that may hold data.
HIDDEN, WINDOW, STRIDE, MARGIN = 20, 128, 64, 64
#: Windows made for training, and the schedule.
EXAMPLES, EPOCHS, BATCH, RATE = 4_000, 5, 32, 0.03
#: Windows that are tagged at once.
AT_ONCE = 512
#: ASCII characters have an input each, all others share one, and padding has one.
INPUTS = 130
#: O, and for each kind the first and any further character.
TAGS = 1 + 2 * len(KINDS)

Span = tuple[str, int, int]

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
#: A match can only begin where a run of digits does: the same matches, in time in proportion to the text.
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGITS = re.compile("[0-9]+")
#: Places without which there is no personal data of these kinds.
_PLACES = re.compile(r"[0-9@]+|[(\[] ?at ?[)\]]", re.IGNORECASE)


def luhn(digits: str) -> bool:
    """Whether Luhn's sum of the digits ends in 0."""
    total = sum(int(d) for d in digits[-1::-2])
    total += sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])
    return total % 10 == 0


def _fits(kind: str, text: str) -> bool:
    """Whether a text keeps the rule of its kind."""
    numbers = _DIGITS.findall(text)
    n = sum(map(len, numbers))
    if kind == "ip":
        return len(numbers) == 4 and all(len(x.lstrip("0")) <= 3 and int(x[-4:]) <= 255 for x in numbers)
    if kind == "card":
        return 12 <= n <= 19 and luhn("".join(numbers))
    return kind == "email" or 9 <= n <= 15


def _emails(text: str) -> list[Span]:
    out, end = [], 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (domain := _DOMAIN.match(text, at + 1)):
            end = domain.end()
            out.append(("email", start, end))
        at = text.find("@", max(at + 1, end))
    return out


def base_spans(text: str) -> list[Span]:
    """(kind, start, end) of all matches of the patterns that keep their rule, by start, then kind."""
    out = _emails(text)
    for kind, pattern in (("ip", _IP), ("card", _CARD), ("phone", _PHONE)):
        out += [(kind, *m.span()) for m in pattern.finditer(text) if _fits(kind, m[0])]
    return in_order(out)


def in_order(spans: list[Span]) -> list[Span]:
    return sorted(spans, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def joined(spans: list[Span]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for kind, start, end in spans)


# The model


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


def _allowed() -> np.ndarray:
    """Scores of (tag before, tag): only a kind's first or further character is followed by its further one."""
    out = np.zeros((TAGS, TAGS), np.float32)
    for k in range(len(KINDS)):
        out[:, 2 + 2 * k] = -1e4
        out[[1 + 2 * k, 2 + 2 * k], 2 + 2 * k] = 0
    return out


_ALLOWED = _allowed()
_FIRST = np.array([0.0] + [0.0, -1e4] * len(KINDS), np.float32)


def _sum_exp(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis, keepdims=True)
    return np.squeeze(top, axis) + np.log(np.exp(x - top).sum(axis))


def inputs(text: str) -> np.ndarray:
    """The model's input of each character."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return np.minimum(codes, INPUTS - 2).astype(np.int64)


@dataclass
class Model:
    """Bidirectional LSTM whose hidden states give each tag a score, and a CRF over the tags."""

    weights: dict[str, np.ndarray]

    @classmethod
    def random(cls, seed: int = 1) -> Model:
        rng = np.random.default_rng(seed)
        w = {}
        for side in "fb":
            w[f"in_{side}"] = rng.normal(0, 0.3, (INPUTS, 4 * HIDDEN))
            w[f"in_{side}"][:, HIDDEN : 2 * HIDDEN] += 1  # cells remember at first
            w[f"hidden_{side}"] = rng.normal(0, 1 / np.sqrt(HIDDEN), (HIDDEN, 4 * HIDDEN))
        w["out"], w["bias"] = rng.normal(0, 0.3, (2 * HIDDEN, TAGS)), np.zeros(TAGS)
        w["moves"] = np.zeros((TAGS, TAGS))
        return cls({k: v.astype(np.float32) for k, v in w.items()})

    def _run(self, side: str, x: np.ndarray, keep: bool) -> tuple[np.ndarray, list]:
        """Hidden states of inputs (steps, windows), and what the way back needs."""
        table, hidden = self.weights[f"in_{side}"], self.weights[f"hidden_{side}"]
        h = c = np.zeros((x.shape[1], HIDDEN), np.float32)
        out, held = np.empty((*x.shape, HIDDEN), np.float32), []
        for t in range(len(x)):
            z = table[x[t]] + h @ hidden
            gates, new = _sigmoid(z[:, : 3 * HIDDEN]), np.tanh(z[:, 3 * HIDDEN :])
            i, f, o = np.split(gates, 3, 1)
            before, c = c, f * c + i * new
            squashed = np.tanh(c)
            if keep:
                held.append((h, before, i, f, o, new, squashed))
            h = o * squashed
            out[t] = h
        return out, held

    def scores(self, x: np.ndarray, turn: np.ndarray, keep: bool = False):
        """Tag scores (steps, windows, tags). turn: for each step and window, its step in the reversed window."""
        ahead, held_f = self._run("f", x, keep)
        back, held_b = self._run("b", np.take_along_axis(x, turn, 0), keep)
        both = np.concatenate([ahead, np.take_along_axis(back, turn[:, :, None], 0)], 2)
        return both @ self.weights["out"] + self.weights["bias"], (both, held_f, held_b)

    def decode(self, x: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The best tags (steps, windows) and the scores of all tags."""
        turn = turned(lengths, len(x))
        scores, _ = self.scores(x, turn)
        moves = self.weights["moves"] + _ALLOWED
        best, came = scores[0] + _FIRST, np.zeros((*x.shape, TAGS), np.int8)
        for t in range(1, len(x)):
            options = best[:, :, None] + moves
            came[t] = options.argmax(1)
            best = np.where((t < lengths)[:, None], options.max(1) + scores[t], best)
        tags = np.zeros(x.shape, np.int8)
        tag, every = best.argmax(1), np.arange(x.shape[1])
        for t in range(len(x) - 1, -1, -1):
            inside = t < lengths
            tags[t] = np.where(inside, tag, 0)
            tag = np.where(inside, came[t][every, tag], tag)
        return tags, scores

    def gradients(self, x: np.ndarray, lengths: np.ndarray, tags: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Loss a character and its gradients: forward-backward over the CRF, then back through time."""
        steps, n = x.shape
        turn, w = turned(lengths, steps), self.weights
        scores, (both, held_f, held_b) = self.scores(x, turn, keep=True)
        moves, inside = w["moves"] + _ALLOWED, np.arange(steps)[:, None] < lengths
        ahead = np.empty_like(scores)
        ahead[0] = scores[0] + _FIRST
        for t in range(1, steps):
            step = _sum_exp(ahead[t - 1][:, :, None] + moves, 1) + scores[t]
            ahead[t] = np.where(inside[t][:, None], step, ahead[t - 1])
        total = _sum_exp(ahead[-1], 1)
        after = np.zeros_like(scores)
        d_moves = np.zeros((TAGS, TAGS), np.float32)
        every = np.arange(n)
        gold = _FIRST[tags[0]] + scores[0][every, tags[0]]
        for t in range(steps - 1, 0, -1):
            reach = (scores[t] + after[t])[:, None, :] + moves
            after[t - 1] = np.where(inside[t][:, None], _sum_exp(reach, 2), 0)
            pair = np.exp(ahead[t - 1][:, :, None] + reach - total[:, None, None]) * inside[t][:, None, None]
            d_moves += pair.sum(0)
            np.add.at(d_moves, (tags[t - 1][inside[t]], tags[t][inside[t]]), -1)
            gold = gold + np.where(inside[t], moves[tags[t - 1], tags[t]] + scores[t][every, tags[t]], 0)
        d_scores = np.exp(ahead + after - total[:, None]) * inside[:, :, None]
        d_scores[np.arange(steps)[:, None], every, tags] -= inside
        size = float(inside.sum())
        d_scores /= size
        grads = {"moves": d_moves / size, "bias": d_scores.sum((0, 1)), "out": np.einsum("tnh,tnk->hk", both, d_scores)}
        d_both = d_scores @ w["out"].T
        for side, held, seen, d_hidden in (
            ("f", held_f, x, d_both[:, :, :HIDDEN]),
            ("b", held_b, np.take_along_axis(x, turn, 0), np.take_along_axis(d_both[:, :, HIDDEN:], turn[:, :, None], 0)),
        ):
            d_in, d_rec, by_step = np.zeros_like(w[f"in_{side}"]), np.zeros_like(w[f"hidden_{side}"]), [None] * steps
            dh = dc = np.zeros((n, HIDDEN), np.float32)
            for t in range(steps - 1, -1, -1):
                h, before, i, f, o, new, squashed = held[t]
                dh = dh + d_hidden[t]
                dc = dc + dh * o * (1 - squashed**2)
                dz = np.concatenate(
                    [dc * new * i * (1 - i), dc * before * f * (1 - f), dh * squashed * o * (1 - o), dc * i * (1 - new**2)], 1
                )
                by_step[t] = dz
                d_rec += h.T @ dz
                dh, dc = dz @ w[f"hidden_{side}"].T, dc * f
            order = np.argsort(seen.ravel(), kind="stable")
            value, at = np.unique(seen.ravel()[order], return_index=True)
            d_in[value] = np.add.reduceat(np.concatenate(by_step)[order], at)
            grads[f"in_{side}"], grads[f"hidden_{side}"] = d_in, d_rec
        return float((total - gold).sum()) / size, grads


def turned(lengths: np.ndarray, steps: int) -> np.ndarray:
    """For each step and window, the step that takes its place when each window is read from its end; padding stays."""
    at = np.arange(steps)[:, None]
    return np.where(at < lengths, lengths - 1 - at, at)


def padded(texts: list[str], steps: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    lengths = np.array([len(t) for t in texts])
    x = np.full((steps or int(lengths.max()), len(texts)), INPUTS - 1, np.int64)
    for k, t in enumerate(texts):
        x[: len(t), k] = inputs(t)
    return x, lengths


def tags_of(spans: list[Span], steps: int) -> np.ndarray:
    out = np.zeros(steps, np.int64)
    for kind, start, end in spans:
        k = KINDS.index(kind)
        out[start], out[start + 1 : end] = 1 + 2 * k, 2 + 2 * k
    return out


def fit(examples: list[tuple[str, list[Span]]], seed: int = 1, epochs: int = EPOCHS) -> Model:
    """The model of the least loss over labelled windows, by Adam with a falling rate."""
    model, rng = Model.random(seed), np.random.default_rng(seed)
    first = {k: np.zeros_like(v) for k, v in model.weights.items()}
    second = {k: np.zeros_like(v) for k, v in model.weights.items()}
    examples = sorted(examples, key=lambda e: len(e[0]))
    batches = [examples[i : i + BATCH] for i in range(0, len(examples), BATCH)]
    step, steps = 0, epochs * len(batches)
    for _ in range(epochs):
        for b in rng.permutation(len(batches)):
            x, lengths = padded([t for t, _ in batches[b]])
            tags = np.stack([tags_of(s, len(x)) for _, s in batches[b]], 1)
            _, grads = model.gradients(x, lengths, tags)
            step += 1
            rate = RATE * (1 - step / (steps + 1))
            norm = np.sqrt(sum(float((g**2).sum()) for g in grads.values()))
            for k, g in grads.items():
                g = g * min(1.0, 1.0 / max(norm, 1e-9))
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.99 * second[k] + 0.01 * g**2
                change = rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-7)
                model.weights[k] = (model.weights[k] - change).astype(np.float32)
    return model


# Labelled spans


def _invented(kind: str, rng: random.Random) -> str:
    digits = lambda n: "".join(rng.choices("0123456789", k=n))
    word = lambda: "".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=rng.randint(2, 9)))
    if kind == "email":
        name = rng.choice([word(), f"{word()}.{word()}", f"{word()}.{digits(2)}", f"{word()}_{word()}", word().title()])
        return f"{name}@{rng.choice([word(), word() + digits(1), f'{word()}-{word()}'])}.{rng.choice(['com', 'org', 'net', 'example.com'])}"
    if kind == "ip":
        return ".".join(str(rng.randint(0, 255)) for _ in range(4))
    if kind == "card":
        n = rng.choice([13, 15, 16, 16, 16, 16, 19]) - 1
        head = rng.choice("23456") + digits(n - 1)
        number = head + next(d for d in "0123456789" if luhn(head + d))
        gap = rng.choice(["", "", " ", "-"])
        return gap.join(number[i : i + 4] for i in range(0, len(number), 4))
    country, a, b, c = rng.choice(["1", "44", "49", "33"]), digits(3), digits(3), digits(4)
    return f"+{country} " + rng.choice([f"({a}) {b}-{c}", f"{a} {b} {c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}"])


def _variant(kind: str, text: str, rng: random.Random) -> str:
    """Another way to write the same."""
    if kind == "email":
        text = text.replace("@", rng.choice([" (at) ", "(at)", " [at] ", "[at]", " @ "]), 1)
        return text.replace(".", rng.choice([".", ".", " (dot) ", "[dot]"]))
    if kind == "ip":
        return text.replace(".", rng.choice(["[.]", " . ", "(.)"]))
    if kind == "card":
        number = "".join(_DIGITS.findall(text))
        return rng.choice([".", "/", "  ", "_"]).join(number[i : i + 4] for i in range(0, len(number), 4))
    return re.sub(r"^\+[0-9]+ ?", rng.choice(["", "00", "001 ", "tel:"][:1] + ["001-"]), text)


def _other(rng: random.Random) -> str:
    """Numbers and signs that are no personal data."""
    digits = lambda n: "".join(rng.choices("0123456789", k=n))
    hexes = "".join(rng.choices("0123456789abcdef", k=rng.choice([8, 32, 40])))
    year, month, day = rng.randint(1900, 2030), rng.randint(1, 12), rng.randint(1, 28)
    return rng.choice([
        f'"{hexes}"', hexes, f"{year}-{month:02}-{day:02}", f"{day}/{month}/{year}", f"{rng.randint(0, 9)}.{rng.randint(0, 9)}.", digits(rng.randint(1, 8)),
        f"{digits(2)}:{digits(2)}:{digits(2)}", f"${digits(3)}.{digits(2)}", f"{digits(1)},{digits(3)},{digits(3)}", f"v{digits(1)}.{digits(1)}.{digits(2)}",
        f"{digits(2)} - {digits(2)}", f"@{digits(2)}", "@home", f"{digits(3)}-{digits(2)}", f"({year})", f"No. {digits(rng.randint(9, 11))}", f"{digits(3)} {digits(3)} {digits(3)} {digits(3)}",
    ])


def examples_of(snippets: list[tuple[str, list[Span]]], count: int = EXAMPLES, seed: int = 1) -> list[tuple[str, list[Span]]]:
    """Labelled windows: spans of the snippets, invented ones and variants, alone or side by side, in the snippets' text."""
    rng = random.Random(seed)
    known = {k: [t[a:b] for t, spans in snippets for kind, a, b in spans if kind == k and b - a <= 48] for k in KINDS}
    plain = [t for t, spans in snippets if not spans and len(t) > 20] or ["the quick brown fox jumps over the lazy dog, and so on"]
    out = []
    for _ in range(count):
        context = lambda most: (lambda t, n: t[(s := rng.randrange(max(1, len(t) - n))) : s + n])(rng.choice(plain), rng.randint(0, most))
        text, spans = context(40), []
        for k in range(rng.choice([0, 1, 1, 1, 2, 2, 3])):
            gap = rng.choice([" ", " ", " ", ", ", ": ", "\n", "; ", " ("]) if k or text else ""
            if rng.random() < 0.3:
                piece, kind = _other(rng), None
            else:
                kind = rng.choice(KINDS)
                piece = rng.choice(known[kind]) if known[kind] and rng.random() < 0.5 else _invented(kind, rng)
                if rng.random() < 0.35:
                    piece = _variant(kind, piece, rng)
            start = len(text) + len(gap)
            if start + len(piece) > WINDOW:
                break
            text += gap + piece
            if kind:
                spans.append((kind, start, start + len(piece)))
        tail = rng.choice([" ", ". ", ", ", ") ", "***", "\n"]) + context(40)
        text = (text + tail)[:WINDOW]
        out.append((text, spans))
    return out


def snippets_of(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", most: int = SAMPLE) -> list[tuple[str, list[Span]]]:
    """Snippets of the corpus, around the first place that may hold data, with their base spans: ``most`` at most, half of
    them from texts with a digit or an at sign.

    A row is drawn by its digest where that lies below a share of all that its half's count sets, so no more than a few
    of them leave a task, however many tasks there are; equal rows count as one.
    """
    rows = docs.filter(F.length(text_col) > 0).select(row_key(id_col, text_col).alias("key"), F.col(text_col).alias("text"))
    rows = rows.withColumn("held", F.col("text").rlike("[0-9@]"))
    counts = dict(rows.groupBy("held").count().collect())
    draw = F.conv(F.substring(F.hex("key"), 1, 8), 16, 10).cast("double") / float(1 << 32)
    share = F.when(F.col("held"), most / max(1, counts.get(True, 0))).otherwise(most / max(1, counts.get(False, 0)))
    drawn = rows.filter(draw < share).groupBy("key").agg(F.first("text").alias("text"), F.first("held").alias("held"))

    def cut(batches):
        for batch in slices(batches):
            texts = []
            for text in batch.column(1).to_pylist():
                m = _PLACES.search(text)
                low = max(0, m.start() - SNIPPET // 2) if m else 0
                texts.append(text[low : low + SNIPPET])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string()), batch.column(2)], ["key", "text", "held"])

    # about ``most`` rows of either half; the limit is never met but by an unlikely draw
    found = drawn.mapInArrow(cut, "key binary, text string, held boolean").limit(4 * most).collect()
    found.sort(key=lambda r: bytes(r.key))
    return [(r.text, base_spans(r.text)) for side in (True, False) for r in [x for x in found if x.held == side][: most // 2]]


# Finding


def _stretches(text: str) -> list[tuple[int, int]]:
    """The parts of a text that the model reads: all around places that may hold personal data."""
    out: list[list[int]] = []
    for m in _PLACES.finditer(text):
        low, high = max(0, m.start() - MARGIN), min(len(text), m.end() + MARGIN)
        if out and low <= out[-1][1]:
            out[-1][1] = high
        else:
            out.append([low, high])
    return [(a, b) for a, b in out]


def _windows(text: str):
    """(start, end) of overlapping windows over the stretches."""
    for low, high in _stretches(text):
        for start in range(low, max(low + 1, high - (WINDOW - STRIDE)), STRIDE):
            yield start, min(start + WINDOW, high)


def _spans(tags: np.ndarray, scores: np.ndarray, start: int) -> list[tuple[float, Span]]:
    """The spans of a decoded window, each with how far its tags' scores are above those of no span."""
    out, t, n = [], 0, len(tags)
    while t < n:
        if (tag := int(tags[t])) % 2 == 0:
            t += 1
            continue
        end = t + 1
        while end < n and tags[end] == tag + 1:
            end += 1
        own = tags[t:end].astype(int)
        gain = float((scores[np.arange(t, end), own] - scores[t:end, 0]).sum())
        out.append((gain, (KINDS[tag // 2], start + t, start + end)))
        t = end
    return out


def _whole(text: str, span: Span) -> Span:
    """The span without white space at its ends and with the whole of numbers and addresses that it cuts."""
    kind, start, end = span
    word = _LOCAL if kind == "email" else frozenset("0123456789")
    while start < end and (text[start].isspace() or kind != "email" and text[start] not in "0123456789+("):
        start += 1
    while end > start and (text[end - 1].isspace() or kind != "email" and text[end - 1] not in "0123456789"):
        end -= 1
    while 0 < start < end and text[start] in word and text[start - 1] in word and end - start <= WINDOW:
        start -= 1
    while start < end < len(text) and text[end - 1] in word and text[end] in word and text[end] not in "._%+-" and end - start <= WINDOW:
        end += 1
    return kind, start, end


def _is_email(text: str) -> bool:
    """Two parts around one at sign, written out or not, and a dot in the second."""
    parts = re.split(r"@|[(\[] ?at ?[)\]]", text, flags=re.IGNORECASE)
    return len(parts) == 2 and all(re.search("[A-Za-z0-9]", p) for p in parts) and bool(re.search(r"\w(\.| ?[(\[]? ?dot ?[)\]]? ?)\w", parts[1]))


def reconciled(text: str, base: list[Span], found: list[tuple[float, Span]]) -> list[Span]:
    """The base spans, and of the model's those that keep their kind's rule, touch no base span and together score most."""
    taken = sorted((a, b) for _, a, b in base)
    best: dict[Span, float] = {}
    for gain, span in found:
        kind, start, end = span = _whole(text, span)
        if gain <= 0 or end <= start or not _fits(kind, text[start:end]) or kind == "email" and not _is_email(text[start:end]):
            continue
        at = bisect.bisect_left(taken, (end,))  # base spans that begin before its end
        if any(b > start for _, b in taken[max(0, at - 64) : at]):
            continue
        best[span] = max(gain, best.get(span, 0.0))
    spans = sorted(best, key=lambda s: (s[2], s[1], s[0]))
    ends, total, choice = [s[2] for s in spans], [0.0], []
    for k, s in enumerate(spans):
        before = bisect.bisect_right(ends, s[1], 0, k)
        choice.append(total[before] + best[s] > total[k])
        total.append(max(total[k], total[before] + best[s]))
    added, k = [], len(spans)
    while k:
        if choice[k - 1]:
            added.append(spans[k - 1])
            k = bisect.bisect_right(ends, spans[k - 1][1], 0, k - 1)
        else:
            k -= 1
    return in_order(base + added)


def find(model: Model, texts: list[str]) -> list[tuple[list[Span], list[Span]]]:
    """For each text its base spans and all spans."""
    base = [base_spans(t) if _PLACES.search(t) else [] for t in texts]
    found: list[list[tuple[float, Span]]] = [[] for _ in texts]
    waiting: list[tuple[int, int, int]] = []

    def tag() -> None:
        waiting.sort(key=lambda w: w[2] - w[1])  # windows of like length together
        for i in range(0, len(waiting), AT_ONCE // 4):
            some = waiting[i : i + AT_ONCE // 4]
            x, lengths = padded([texts[k][a:b] for k, a, b in some])
            tags, scores = model.decode(x, lengths)
            for w, (k, a, b) in enumerate(some):
                if tags[: b - a, w].any():
                    for gain, span in _spans(tags[: b - a, w], scores[: b - a, w], a):
                        # a span that a window cuts is whole in the next one
                        if (span[1] > a or a == 0) and (span[2] < b or b == len(texts[k])):
                            found[k].append((gain, span))
        waiting.clear()

    for k, text in enumerate(texts):
        for a, b in _windows(text):
            waiting.append((k, a, b))
            if len(waiting) == AT_ONCE:
                tag()
    if waiting:
        tag()
    return [(b, reconciled(t, b, f) if f else b) for t, b, f in zip(texts, base, found, strict=True)]


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Model:
    """A model from labelled spans of a bounded sample of ``docs``."""
    return fit(examples_of(snippets_of(docs, id_col, text_col)))


def personal_data(docs: DataFrame, model: Model | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, spans (array of kind, start, end, base: whether a pattern found it) of each row, in code points.

    By start, then kind. Null and empty texts have none. Repeated rows each give a row, null ids are passed on, empty
    tables give no rows, other columns are ignored. Whole texts are searched; a span that the model adds has at most
    WINDOW - STRIDE characters, base spans have any length.
    """
    model = model or train(docs, id_col, text_col)
    kind = docs.schema[id_col].dataType.simpleString()
    span = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("base", pa.bool_())])

    def search(batches):
        for batch in slices(batches, 200):
            rows = []
            for base, every in find(model, [t or "" for t in batch.column(1).to_pylist()]):
                own = set(base)
                rows.append([{"kind": s[0], "start": s[1], "end": s[2], "base": s in own} for s in every])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.list_(span))], ["doc_id", "spans"])

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(search, f"doc_id {kind}, spans array<struct<kind:string,start:bigint,end:bigint,base:boolean>>")


def redacted(docs: DataFrame, model: Model | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with [EMAIL] and the like in place of every span of ``text_col``; null texts stay null."""
    model = model or train(docs, id_col, text_col)

    @F.pandas_udf("string")
    def hide(texts):
        out = []
        for text, (_, spans) in zip(texts, find(model, [t or "" for t in texts]), strict=True):
            at, parts = 0, []
            for kind, start, end in spans:
                if start >= at:
                    parts += [text[at:start], f"[{kind.upper()}]"]
                at = max(at, end)
            out.append(None if text is None else "".join([*parts, text[at:]]))
        return texts.__class__(out, index=texts.index, dtype=object)

    return docs.withColumn(text_col, hide(F.col(text_col)))


def summary(found: DataFrame) -> DataFrame:
    """doc_id, the base spans' numbers by kind and digest, and all spans as text."""
    text = lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))
    base = F.filter("spans", lambda s: s["base"])
    of = lambda kind: F.filter("spans", lambda s: s["base"] & (s["kind"] == kind))
    counts = [F.size(of(kind)).cast("long").alias(f"n_{kind}") for kind in KINDS]
    return found.select(
        "doc_id",
        *counts,
        F.sha2(F.array_join(F.transform(base, text), ","), 256).alias("base_sha256"),
        F.array_join(F.transform("spans", text), ",").alias("spans"),
    )


def sha_of(spans: list[Span]) -> str:
    return hashlib.sha256(joined(spans).encode()).hexdigest()
