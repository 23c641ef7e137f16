"""Personal data: base patterns, and a character-level bidirectional LSTM with CRF that adds other spellings.

1. Base spans are what the patterns match and their checks accept. They stay whatever the model says.
2. The model is trained on labelled spans: the base spans of at most ``SAMPLE_DOCS`` documents (those of least hash),
   as written and rewritten into other spellings, within texts of the same documents, beside numbers
   that are no personal data. It labels each character as outside, or as a kind's begin or inside.
3. A text is read in windows of ``WINDOW`` signs, one at each multiple of half of that. A span holds at least one
   sign of ``TRIGGER`` by definition, so windows farther than a window from any such sign have none and
   aren't decoded. Each window gives label probabilities by the CRF; where windows overlap, they are averaged, the
   middle of a window weighing most, and one Viterbi path over each chain of windows settles the text's spans; signs
   whose probability of being outside is ``OUTSIDE`` or more are.
4. A span of the path is added if its probability reaches ``SURE``, its content passes its kind's check, and it
   overlaps no base span.

Null texts count as empty; texts without trigger signs have no spans. Texts of any length are read whole.
Equal texts have equal spans; repeated rows each give a row. An empty table gives no rows. Without
labelled spans in the table, stand-ins are drawn. Extra columns are ignored. Offsets are code points, ends exclusive.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlane.llm.bilstm import Tagger
from ledgerlane.llm.common import ship

KINDS = ("email", "ip", "card", "phone")
#: Documents whose base spans are learnt from; training windows; steps; signs of a window; least probability.
SAMPLE_DOCS, EXAMPLES, STEPS, WINDOW, SURE = 400, 4000, 300, 96, 0.9
OUTSIDE = 0.999  # from this probability on, a sign is outside of all spans
TRIGGER = re.compile(r"[0-9@]|[\[({<] ?(?:at|dot) ?[\])}>]", re.I)
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]+\Z")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)*")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
#: Other spellings of at-sign and full stop.
_AT, _DOT = re.compile(r"\s*[\[({<]\s*at\s*[\])}>]\s*", re.I), re.compile(r"\s*[\[({<]\s*dot\s*[\])}>]\s*", re.I)
_LOCAL_SIGNS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
Span = tuple[str, int, int]


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        x = int(d) * (1 + k % 2)
        total += x - 9 * (x > 9)
    return total % 10 == 0


def _small(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) < 3 or len(part) == 3 and part <= "255"


def base_spans(text: str) -> list[Span]:
    """The base spans by kind as listed, then start. Each pattern is read in one pass over the text."""
    out: list[Span] = []
    end, at = 0, text.find("@")
    while at >= 0:  # the local part is the whole run ahead of the sign, so starts within it need no trial
        start = at
        while start > end and text[start - 1] in _LOCAL_SIGNS:
            start -= 1
        found = _DOMAIN.match(text, at + 1) if start < at else None
        if found:
            out.append(("email", start, found.end()))
            end = found.end()
        at = text.find("@", max(at + 1, end))
    for found in _DOTTED.finditer(text):
        if found[0].count(".") < 3:
            continue
        parts, start = found[0].split("."), found.start()
        for k in range(0, len(parts) - 3, 4):
            four = parts[k:k + 4]
            size = sum(map(len, four)) + 3
            if all(map(_small, four)):
                out.append(("ip", start, start + size))
            start += size + 1
    for found in _CARD.finditer(text):
        digits = found[0].replace(" ", "").replace("-", "")
        if 16 <= len(digits) <= 19 and luhn(digits):
            out.append(("card", *found.span()))
    for found in _PHONE.finditer(text):
        if 8 <= sum(c.isdigit() for c in found[0]) <= 15:
            out.append(("phone", *found.span()))
    return out


def accepted(kind: str, text: str) -> bool:
    """Whether a span's content can be of its kind, in any of the spellings."""
    if kind == "email":
        plain = _DOT.sub(".", _AT.sub("@", text))
        return base_spans(plain) == [("email", 0, len(plain))]
    if kind == "ip":
        parts = _DOT.sub(".", text.replace("[.]", ".")).split(".")
        return len(parts) == 4 and all(re.fullmatch("[0-9]+", p) and _small(p) for p in parts)
    digits = re.sub("[^0-9]", "", text)
    if not re.fullmatch(r"[+(]*[0-9][0-9 ()./\xa0-]*[0-9]", text):
        return False
    return 13 <= len(digits) <= 19 and luhn(digits) if kind == "card" else 8 <= len(digits) <= 15


# ---------------------------------------------------------------- signs and labels

SIGNS = 102


def signs(text: str) -> np.ndarray:
    """A number for each sign: ASCII one by one, others by what they are; 0 is beyond the text."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
    out = np.where((codes >= 32) & (codes < 127), codes - 31, 96)
    for k in np.flatnonzero(codes >= 127):
        c = chr(codes[k])
        out[k] = 97 if c.islower() else 98 if c.isupper() else 99 if c.isalpha() else 100 if c.isspace() else 101
    return out


def label_rules() -> tuple[np.ndarray, np.ndarray]:
    """Labels: 0 outside, 1 + 2 k begin and 2 + 2 k inside of kind k. An inside follows its own kind only."""
    n = 1 + 2 * len(KINDS)
    allowed, first = np.ones((n, n), bool), np.ones(n, bool)
    for k in range(len(KINDS)):
        inside = 2 + 2 * k
        allowed[:, inside], first[inside] = False, False
        allowed[[inside - 1, inside], inside] = True
    return allowed, first


def labels(spans: list[Span], start: int, size: int) -> np.ndarray:
    out = np.zeros(size, np.int64)
    for kind, a, b in reversed(spans):
        a, b, k = max(a - start, 0), min(b - start, size), 1 + 2 * KINDS.index(kind)
        if a < b:
            out[a:b] = k + 1
            out[a] = k  # a span cut by the window's edge begins there
    return out


# ---------------------------------------------------------------- training

def _digits(rng: np.random.Generator, n: int) -> str:
    return "".join(map(str, rng.integers(0, 10, n)))


def stand_in(rng: np.random.Generator, kind: str) -> str:
    """A value of the kind in its base spelling."""
    word = lambda: "".join(rng.choice(list("abcdefghijklmnoprstuvw"), rng.integers(2, 9)))
    if kind == "email":
        return f"{word()}{rng.choice(['.', '_', '-', ''])}{word()}{rng.choice(['', _digits(rng, 2)])}@{word()}.{rng.choice(['com', 'org', 'example.net', 'de'])}"
    if kind == "ip":
        return ".".join(str(x) for x in rng.integers(0, 256, 4))
    if kind == "card":
        body = _digits(rng, 15)
        return next(body + d for d in "0123456789" if luhn(body + d))
    return f"+{rng.integers(1, 99)} ({_digits(rng, 3)}) {_digits(rng, 3)}-{_digits(rng, 4)}"


def respelled(rng: np.random.Generator, kind: str, value: str) -> str:
    """The value in another spelling, which the base patterns mostly miss."""
    pick = lambda *xs: xs[rng.integers(len(xs))]
    if kind == "email":
        a, b = pick("[]", "()", "{}", "<>")
        at, dot = pick(f" {a}at{b} ", f"{a}at{b}", f" {a} at {b} ", f"{a}AT{b}"), pick(f" {a}dot{b} ", f"{a}dot{b}", ".", f"{a}DOT{b}")
        local, _, domain = value.partition("@")
        return local + at + domain.replace(".", dot)
    if kind == "ip":
        return value.replace(".", pick("[.]", "[.]", " [dot] ", "(dot)"))
    digits = re.sub("[^0-9]", "", value)
    if kind == "card":
        sign = pick(".", "/", " - ", "\xa0", " / ", "  ")
        return sign.join(digits[i:i + 4] for i in range(0, len(digits), 4))
    area, rest = digits[-10:-7], digits[-7:]
    if len(area) < 3:
        return value
    return pick(f"({area}) {rest[:3]}-{rest[3:]}", f"{area}-{rest[:3]}-{rest[3:]}", f"{area}.{rest[:3]}.{rest[3:]}",
                f"00{digits[:-10] or 1} {area} {rest[:3]} {rest[3:]}", f"({area}){rest[:3]}-{rest[3:]}",
                f"1-{area}-{rest[:3]}-{rest[3:]}", f"{area}/{rest[:3]}-{rest[3:]}")


def decoy(rng: np.random.Generator) -> str:
    """Digits, brackets and at-signs that are no personal data."""
    n = lambda a, b: _digits(rng, rng.integers(a, b))
    kind = rng.integers(16)
    if kind < 3:
        return n(1, 13) if kind else n(16, 30)
    if kind == 3:
        body = _digits(rng, 15)
        return body + next(d for d in "0123456789" if not luhn(body + d))
    return [
        lambda: f"{rng.integers(1900, 2100)}-{rng.integers(1, 13):02d}-{rng.integers(1, 29):02d}",
        lambda: f"{rng.integers(1, 29):02d}.{rng.integers(1, 13):02d}.{rng.integers(1900, 2100)}",
        lambda: f"{rng.integers(1, 20)}.{rng.integers(0, 20)}" + rng.choice(["", ".", f".{rng.integers(0, 9)}"]),
        lambda: f"{n(1, 4)},{n(3, 4)},{n(3, 4)}.{n(2, 3)}",
        lambda: f"{rng.integers(0, 24):02d}:{rng.integers(0, 60):02d}:{rng.integers(0, 60):02d}",
        lambda: "token = \"" + "".join(rng.choice(list("0123456789abcdef"), 40)) + "\"",
        lambda: f"@{rng.choice(['home', 'user', 'media', 'import'])}" + n(0, 3) + " ",
        lambda: f"[{n(1, 3)}] (at) {rng.choice(['once', 'last', 'home', 'all'])}",
        lambda: f"{n(1, 3)}-{n(1, 3)}, {n(1, 3)}-{n(1, 4)}",
        lambda: f"${n(1, 5)}.{n(2, 3)} / {n(1, 4)} %",
        lambda: f"{rng.integers(256, 999)}.{n(1, 4)}.{rng.integers(256, 999)}.{n(1, 4)}",
        lambda: f"{n(1, 2)} {rng.choice(['x', '+', '=', '/'])} {n(1, 3)} {rng.choice(['x', '=', '/'])} {n(1, 4)}",
    ][kind - 4]()


def training_set(sample: list[str], n: int, seed: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """(signs, labels) of ``n`` windows from the texts of the sample: labelled spans as they stand, the same
    respelled, and decoys, each somewhere in a window of other text."""
    rng = np.random.default_rng(seed)
    values: dict[str, list[str]] = {k: [] for k in KINDS}
    found = [(text, spans) for text in sorted(sample) if (spans := base_spans(text))]
    for text, spans in found:
        for kind, a, b in spans:
            values[kind].append(text[a:b])
    calm = [t for t in (TRIGGER.sub(" ", text) for text in sorted(sample)) if t.strip()] or [
        "and the of in to with by for that this was on as at\nfrom it is are or be an not"]
    xs, ys = np.zeros((n, WINDOW), np.int64), np.zeros((n, WINDOW), np.int64)
    for row in range(n):
        if found and row % 5 == 0:  # as it stands, at a random place of the window
            text, spans = found[rng.integers(len(found))]
            _, a, b = spans[rng.integers(len(spans))]
            start = max(0, (a + b) // 2 - int(rng.integers(8, WINDOW - 8)))
        else:
            text, spans = "", []
            while len(text) < WINDOW:
                whole = calm[rng.integers(len(calm))]
                at = int(rng.integers(max(1, len(whole) - 40)))
                text += whole[at:at + int(rng.integers(3, 50))]
                if rng.random() < 0.6:
                    text += rng.choice([" ", "\n", " (", ": ", ""]) if text[-1:].isalpha() else ""
                    text += "" if text[-1:] in " \n(" else " "
                    if rng.random() < 0.5:
                        text += decoy(rng)
                    else:
                        kind = KINDS[rng.integers(len(KINDS))]
                        pool = values[kind]
                        value = pool[rng.integers(len(pool))] if pool and rng.random() < 0.5 else stand_in(rng, kind)
                        if rng.random() < 0.75:
                            value = respelled(rng, kind, value)
                        if accepted(kind, value):
                            spans.append((kind, len(text), len(text) + len(value)))
                        text += value
                    text += rng.choice([" ", ".\n", ", ", ") ", "!! ", "\n"])
            start = int(rng.integers(0, max(1, len(text) - WINDOW // 2)))
        x = signs(text[start:start + WINDOW])
        xs[row, :len(x)], ys[row] = x, labels(spans, start, WINDOW)
    return xs, ys


def sample_texts(docs: DataFrame, n: int = SAMPLE_DOCS) -> list[str]:
    """At most ``n`` distinct texts with digits or at-signs, of least hash; of very long ones, what
    surrounds their first hundred base spans."""
    rows = docs.filter(F.col("text").rlike("[0-9@]")).select("text", F.xxhash64("text").alias("h"))
    least = [r.h for r in rows.select("h").distinct().orderBy("h").limit(n).collect()]
    surroundings = F.udf(_surroundings, "string")
    some = rows.filter(F.col("h").isin(least)).groupBy("h").agg(F.min("text").alias("text"))
    return [r.text for r in some.select(surroundings("text").alias("text")).collect()]


def _surroundings(text: str) -> str:
    if len(text) <= 20_000:
        return text
    return "\n".join(text[max(0, a - WINDOW):b + WINDOW] for _, a, b in base_spans(text)[:100])[:40_000]


def fit(docs: DataFrame, sample_docs: int = SAMPLE_DOCS, examples: int = EXAMPLES, steps: int = STEPS) -> Tagger:
    """The model, from the labelled spans of rows (doc_id, text)."""
    tagger = Tagger(SIGNS, *label_rules())
    tagger.train(*training_set(sample_texts(docs, sample_docs), examples), steps)
    return tagger


# ---------------------------------------------------------------- decoding

def chains(text: str) -> list[list[int]]:
    """Starts of the windows to decode, as runs in which each overlaps the next."""
    step, wanted = WINDOW // 2, set()
    last = max(0, (len(text) - 1) // step)
    for found in TRIGGER.finditer(text):
        at = found.start() // step
        wanted.update(range(max(0, at - 2), min(last, at + 1) + 1))
    runs: list[list[int]] = []
    for k in sorted(wanted):
        if runs and runs[-1][-1] == (k - 1) * step:
            runs[-1].append(k * step)
        else:
            runs.append([k * step])
    return runs


def _viterbi(unary: np.ndarray, allowed: np.ndarray, first: np.ndarray) -> np.ndarray:
    barred, back = np.where(allowed, 0.0, -1e9), []
    score = np.where(first, unary[0], -1e9)
    for u in unary[1:]:
        steps = score[:, None] + barred
        back.append(steps.argmax(0))
        score = steps.max(0) + u
    path = [int(score.argmax())]
    for b in reversed(back):
        path.append(int(b[path[-1]]))
    return np.array(path[::-1])


def reconciled(starts: list[int], parts: np.ndarray, size: int, allowed: np.ndarray, first: np.ndarray) -> list[tuple[int, int, int, float]]:
    """(kind, start, end, probability) on the best path over a chain of windows: ``parts`` are the windows' label
    probabilities, ``size`` the text's length."""
    step = WINDOW // 2
    rise = np.minimum(np.arange(1, WINDOW + 1), np.arange(WINDOW, 0, -1)).astype(float)
    begin, total = starts[0], min(size, starts[-1] + WINDOW) - starts[0]
    p, weight = np.zeros((len(starts) * step + step, parts.shape[2])), np.zeros(len(starts) * step + step)
    for start, part in zip(starts, parts):
        p[start - begin:start - begin + WINDOW] += rise[:, None] * part
        weight[start - begin:start - begin + WINDOW] += rise
    p = (p / weight[:, None])[:total]
    path = np.zeros(total, np.int64)
    # signs that are surely outside part the chain; the path is sought between them
    open_ = np.flatnonzero(p[:, 0] < OUTSIDE)
    for part in np.split(open_, np.flatnonzero(np.diff(open_) > 1) + 1) if len(open_) else []:
        path[part] = _viterbi(np.log(np.maximum(p[part], 1e-12)), allowed, first)
    out, t = [], 0
    while t < total:
        if path[t] % 2 == 0:
            t += 1
            continue
        kind, end = (path[t] - 1) // 2, t + 1
        while end < total and path[end] == 2 + 2 * kind:
            end += 1
        mine = p[t:end, 1 + 2 * kind] + p[t:end, 2 + 2 * kind]
        out.append((int(kind), begin + t, begin + end, float(np.exp(np.log(np.maximum(mine, 1e-12)).mean()))))
        t = end
    return out


def added_spans(tagger: Tagger, texts: list[str], base: list[list[Span]], sure: float = SURE, held: int = 512) -> list[list[Span]]:
    """For each text the spans that the model adds to its base spans."""
    out: list[list[Span]] = [[] for _ in texts]
    waiting: list[tuple[int, list[int]]] = []

    def decode() -> None:
        x = np.zeros((sum(len(starts) for _, starts in waiting), WINDOW), np.int64)
        k = 0
        for i, starts in waiting:
            for start in starts:
                s = signs(texts[i][start:start + WINDOW])
                x[k, :len(s)] = s
                k += 1
        p, k = tagger.marginals(x), 0
        for i, starts in waiting:
            for kind, a, b, chance in reconciled(starts, p[k:k + len(starts)], len(texts[i]), tagger.allowed, tagger.first):
                name, span = KINDS[kind], texts[i][a:b]
                if (chance >= sure and TRIGGER.search(span) and accepted(name, span)
                        and not any(a < e and s < b for _, s, e in base[i])):
                    out[i].append((name, a, b))
            k += len(starts)
        waiting.clear()

    n = 0
    for i, text in enumerate(texts):
        for chain in chains(text):
            for k in range(0, len(chain), held - 1):  # very long chains meet in one window
                part = chain[k:k + held]
                waiting.append((i, part))
                n += len(part)
                if n >= held:
                    decode()
                    n = 0
    decode() if waiting else None
    return [sorted(set(x)) for x in out]


def written(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in sorted(spans, key=lambda s: (KINDS.index(s[0]), s[1], s[2])))


def find(docs: DataFrame, tagger: Tagger | None = None, id_col: str = "doc_id", text_col: str = "text",
         sure: float = SURE) -> DataFrame:
    """Per row: doc_id, the numbers of base spans by kind, base_sha256, spans (base and added), n_added."""
    ship(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    model = tagger or fit(rows)
    names = ["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans", "n_added"]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).to_pylist()
            base = [base_spans(t) if TRIGGER.search(t) else [] for t in texts]
            more = added_spans(model, texts, base, sure)
            counts = [[sum(s[0] == k for s in spans) for spans in base] for k in KINDS]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(c, pa.int64()) for c in counts),
                 pa.array([hashlib.sha256(written(b).encode()).hexdigest() for b in base]),
                 pa.array([written(b + m) for b, m in zip(base, more)]), pa.array([len(m) for m in more], pa.int64())], names)

    return rows.mapInArrow(scan, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, "
                                 "base_sha256 string, spans string, n_added long")
