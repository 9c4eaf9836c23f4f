"""Personal data: patterns, and a linear-chain conditional random field that adds what they miss.

The field runs over space-separated words with word-shape features.  It is
trained on the driver from a small labelled table and decoded by Viterbi in
numpy batches.  Words without a digit or an "@", and not of an address with
"at" or "dot" written out, are outside by definition, so a chain breaks at them and only the runs in
between are decoded: the same result as over the whole text.
"""

from __future__ import annotations

import hashlib
import random
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagemill.llm._common import arrow_batches, releasing

KINDS = ("email", "ip", "card", "phone")
LABELS = ("O", *(f"{p}-{k}" for k in KINDS for p in "BI"))
LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
TRIGGER = re.compile("[0-9@]")
AT_WORD = re.compile(r"(?<!\S)[\[({<]?(?:at|AT)[\])}>]?(?!\S)")
DOT_WORD = re.compile(r"[\[({<]?(?:dot|DOT)[\])}>]?(?!\S)")
BRACKETS = "[({<"
WORD = re.compile(r"\S+")
DIGIT = re.compile("[0-9]")
PART = re.compile(r"[0-9]+|[^\W\d_]+|.")
BATCH = 4096

Span = tuple[str, int, int]


def luhn(digits: str) -> bool:
    odd = sum(map(int, digits[-1::-2]))
    return (odd + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])) % 10 == 0


def octet(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) <= 3 and int(part or "0") <= 255


def digits_of(text: str) -> str:
    return "".join(DIGIT.findall(text))


def _emails(text: str) -> Iterator[Span]:
    """As the pattern finds them from the left; read from each @, so that a long word costs no more than its length."""
    free = 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in LOCAL_CHARS:
            start -= 1
        m = DOMAIN.match(text, at + 1) if start < at else None
        if m:
            yield "email", start, m.end()
            free = m.end()
            at = text.find("@", free)
        else:
            free = at + 1
            at = text.find("@", free)


def base_spans(text: str | None) -> list[Span]:
    """By kind as in KINDS, then by start; ends are exclusive, in code points."""
    if not text or not ("@" in text or DIGIT.search(text)):
        return []
    out = list(_emails(text))
    out += [("ip", *m.span()) for m in IP.finditer(text) if all(map(octet, m.group().split(".")))]
    out += [("card", *m.span()) for m in CARD.finditer(text) if 16 <= len(d := digits_of(m.group())) <= 19 and luhn(d)]
    if "+" in text:
        out += [("phone", *m.span()) for m in PHONE.finditer(text) if 8 <= len(digits_of(m.group())) <= 15]
    return out


# Words and features.


def _written_out(text: str) -> Iterator[tuple[int, int]]:
    """Words of addresses with a written "at" and "dot": the one before "at", the one after, and a "dot" and a word as often as they follow.

    A bare "at" counts where a "dot" follows, one in brackets always.
    """
    for m in AT_WORD.finditer(text):
        end = m.start()
        while end > 0 and text[end - 1] in " \t":
            end -= 1
        start = end
        while start > 0 and not text[start - 1].isspace():
            start -= 1
        after = WORD.match(text, _gap(text, m.end()))
        if start == end or after is None:
            continue
        words, dots = [(start, end), m.span(), after.span()], 0
        while (dot := DOT_WORD.match(text, at := _gap(text, words[-1][1]))) and at > words[-1][1] and (last := WORD.match(text, _gap(text, dot.end()))):
            words += [dot.span(), last.span()]
            dots += 1
        if dots or m.group()[0] in BRACKETS:
            yield from words


def _gap(text: str, at: int) -> int:
    while at < len(text) and text[at] in " \t":
        at += 1
    return at


def words_with_triggers(text: str) -> list[tuple[int, int]]:
    """Words with a digit or an @, and those of written-out addresses, in order."""
    out = []
    m = TRIGGER.search(text)
    while m:
        start, end = m.start(), m.end()
        while start > 0 and not text[start - 1].isspace():
            start -= 1
        while end < len(text) and not text[end].isspace():
            end += 1
        out.append((start, end))
        m = TRIGGER.search(text, end)
    more = set(_written_out(text))
    return sorted(more.union(out)) if more else out


def runs_of(text: str) -> Iterator[list[tuple[int, int]]]:
    """Maximal runs of neighbouring words with triggers, as (start, end) of each word."""
    run: list[tuple[int, int]] = []
    for start, end in words_with_triggers(text):
        if run and not text[run[-1][1] : start].isspace():
            yield run
            run = []
        run.append((start, end))
    if run:
        yield run


EDGE = ".,;:!?\"'<>|#*$%&"


def trimmed(text: str, start: int, end: int) -> tuple[int, int]:
    while end > start and text[end - 1] in EDGE:
        end -= 1
    while start < end and text[start] in EDGE:
        start += 1
    return start, end


def shape(word: str) -> str:
    """Runs of digits as their length, of lower or upper letters as one a or A, other marks as they are; each of a row of like things once, but digits."""
    out: list[str] = []
    for run in PART.findall(word):
        mark = str(min(len(run), 20)) if DIGIT.match(run) else "A" if run[0].isupper() else "a" if run[0].isalpha() else run
        if mark.isdigit() or out[-1:] != [mark]:
            out.append(mark)
    return " ".join(out)


ENDINGS = frozenset("com org net edu gov io de fr es uk info".split())
HINTS = frozenset("phone tel telephone call fax mobile cell email mail e-mail contact ip host address server card visa mastercard credit number no order invoice version ref id token page".split())


def features(words: list[str], before: str, after: str) -> list[list[str]]:
    """Of each word of a run; before and after are the plain words beside it."""
    joined = digits_of(" ".join(words))
    whole = f"run {min(len(joined), 20)} {len(joined) >= 13 and luhn(joined)}"
    shapes = [shape(w) for w in words]
    out = []
    for k, w in enumerate(words):
        d = digits_of(w)
        prev, nxt = (words[k - 1] if k else before).lower().strip(EDGE), (words[k + 1] if k + 1 < len(words) else after).lower().strip(EDGE)
        f = ["bias", "s=" + shapes[k], f"n={min(len(d), 20)}", whole, f"at {'@' in w}", f"dots {min(w.count('.'), 4)}", f"sep {w.count('-') + w.count('.') > 0}", f"head {w[:1] if not w[:1].isalnum() else 'd' if w[:1].isdigit() else 'a'}", f"luhn {len(d) >= 13 and luhn(d)}"]
        f.append("p=" + (shapes[k - 1] if k else "-"))
        f.append("q=" + (shapes[k + 1] if k + 1 < len(words) else "-"))
        f.append(f"alpha {any(c.isalpha() for c in w)}")
        parts = w.split(".")
        f.append(f"quad {len(parts) == 4 and all(p.isdigit() and octet(p) for p in parts)}")
        if prev in HINTS:
            f.append("h=" + prev)
        own = w.lower().strip("[](){}<>")
        f += [f"{side} {x}" for side, x in (("is", own), ("next", nxt.strip("[](){}<>")), ("prev", prev.strip("[](){}<>"))) if x in ("at", "dot")]
        if w[:1] in BRACKETS and own in ("at", "dot"):
            f.append("bracketed")
        if own in ENDINGS:
            f.append("ending")
        out.append(f)
    return out


# The field.


@lru_cache(maxsize=1)
def labelled_table(seed: int = 7, syllables: tuple[str, ...] = ("th", "er", "on", "an", "in", "ed", "ly", "ou", "re"), each: int = 12) -> tuple[tuple[tuple[str, ...], tuple[str, ...]], ...]:
    """(words, labels) of runs, first and last word being the plain neighbours: made by rule from a seed."""
    rng = random.Random(seed)
    num = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    word = lambda: "".join(rng.choice(syllables) for _ in range(rng.randint(1, 4)))

    def card() -> str:
        d = rng.choice("3456") + num(14)
        return next(d + c for c in "0123456789" if luhn(d + c))

    def bad() -> str:
        d = card()
        return d[:-1] + str((int(d[-1]) + rng.randint(1, 9)) % 10)

    def groups(d: str, sep: str) -> list[str]:
        return sep.join(d[k : k + 4] for k in range(0, 16, 4)).split(" ")

    host = lambda: f"{word()}{num(1)}.{rng.choice(['example', word()])}.{rng.choice(['com', 'org', 'net'])}"
    quad = lambda: ".".join(str(rng.randint(0, 255)) for _ in range(4))
    makers = [
        lambda: ("email", [f"{word()}.{num(2)}@{host()}"]),
        lambda: ("email", [f"{word()}@{host()}"]),
        lambda: ("email", [f"{word()}.{num(2)}", rng.choice(["[at]", "(at)"]), host()]),
        lambda: ("email", [word(), rng.choice(["at", "AT", "[at]", "(at)", "<at>"]), word(), rng.choice(["dot", "DOT", "[dot]", "(dot)"]), rng.choice(["com", "org", "net", "de"])]),
        lambda: ("email", [f"{word()}.{word()}", "at", word(), "dot", word(), "dot", rng.choice(["com", "org", "io"])]),
        lambda: ("", [word(), "at", rng.choice(["the", "a", word()]), "dot", rng.choice(["on", "and", word()])]),
        lambda: ("ip", [quad()]),
        lambda: ("ip", [f"{quad()}:{num(4)}"]),
        lambda: ("card", [card()]),
        lambda: ("card", groups(card(), " ")),
        lambda: ("card", groups(card(), "-")),
        lambda: ("card", groups(card(), ".")),
        lambda: ("phone", ["+1", f"({num(3)})", f"{num(3)}-{num(4)}"]),
        lambda: ("phone", [f"({num(3)})", f"{num(3)}-{num(4)}"]),
        lambda: ("phone", [f"{num(3)}-{num(3)}-{num(4)}"]),
        lambda: ("phone", [f"{num(3)}.{num(3)}.{num(4)}"]),
        lambda: ("phone", [f"+{num(2)}", num(3), num(3), num(4)]),
        lambda: ("phone", [f"+{num(11)}"]),
        lambda: ("", [bad()]),
        lambda: ("", [bad()]),
        lambda: ("", groups(bad(), " ")),
        lambda: ("", groups(bad(), "-")),
        lambda: ("", [num(rng.randint(1, 12))]),
        lambda: ("", [num(4), num(rng.randint(1, 4))]),
        lambda: ("", [f"{num(4)}-{num(2)}-{num(2)}"]),
        lambda: ("", [f"{num(2)}.{num(2)}.{num(4)}"]),
        lambda: ("", [f"{num(1)}.{num(1)}.{num(2)}"]),
        lambda: ("", [f"{num(2)}:{num(2)}"]),
        lambda: ("", [f"{num(3)},{num(3)}.{num(2)}"]),
        lambda: ("", [f"{rng.randint(256, 999)}.{num(3)}.{num(3)}.{num(3)}"]),
        lambda: ("", [f'"{"".join(rng.choice("0123456789abcdef") for _ in range(40))}"']),
        lambda: ("", [f"{word()}{num(2)}"]),
        lambda: ("", [f"@{word()}"]),
        lambda: ("", [f"{num(4)}-{num(4)}"]),
        lambda: ("", [f"{num(1)}.{num(1)}"]),
        lambda: ("", [f"{num(3)}-{num(5)}-{num(1)}"]),
    ]
    hint = {"email": ["email", "mail", "contact"], "ip": ["ip", "host", "server"], "card": ["card", "visa"], "phone": ["phone", "call", "tel"], "": ["order", "version", "page", "ref", "token"]}
    out = []
    for _ in range(each):
        for make in makers:
            kind, words = make()
            before = rng.choice(hint[kind]) if rng.random() < 0.3 else word()
            labels = ["O"] * len(words) if not kind else [f"{'I' if k else 'B'}-{kind}" for k in range(len(words))]
            out.append((tuple([before, *words, word()]), tuple(labels)))
    return tuple(out)


class Field:
    """Weights of features by label and of label pairs; a run starts after, and ends before, an outside word."""

    def __init__(self, index: dict[str, int], emit: np.ndarray, step: np.ndarray) -> None:
        self.index, self.emit, self.step = index, emit, step

    def scores(self, rows: list[list[str]]) -> np.ndarray:
        get = self.index.get
        return np.array([self.emit[[i for f in fs if (i := get(f, -1)) >= 0]].sum(axis=0) for fs in rows]).reshape(-1, len(LABELS))

    def decode(self, chains: list[np.ndarray]) -> list[list[int]]:
        """Viterbi over chains of one length at a time, all of them at once."""
        out: list = [None] * len(chains)
        by_length: dict[int, list[int]] = {}
        for k, c in enumerate(chains):
            by_length.setdefault(len(c), []).append(k)
        for n, ks in by_length.items():
            x = np.stack([chains[k] for k in ks])
            best, back = x[:, 0] + self.step[0], []
            for t in range(1, n):
                via = best[:, :, None] + self.step[None]
                back.append(via.argmax(axis=1))
                best = via.max(axis=1) + x[:, t]
            last = (best + self.step[:, 0]).argmax(axis=1)
            path = [last]
            for b in reversed(back):
                path.append(b[np.arange(len(ks)), path[-1]])
            for k, labels in zip(ks, np.stack(path[::-1], axis=1).tolist(), strict=True):
                out[k] = labels
        return out


def _log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return (top + np.log(np.exp(x - top).sum(axis=axis, keepdims=True))).squeeze(axis)


@lru_cache(maxsize=1)
def train(rounds: int = 120, rate: float = 0.4, decay: float = 1e-3) -> Field:
    """Maximum likelihood by forward-backward and Adagrad over the labelled table, with a small penalty on large weights."""
    table = labelled_table()
    rows = [features(list(w[1:-1]), w[0], w[-1]) for w, _ in table]
    index = {f: k for k, f in enumerate(dict.fromkeys(f for r in rows for fs in r for f in fs))}
    size = len(LABELS)
    emit, step = np.zeros((len(index), size)), np.zeros((size, size))
    for k, a in enumerate(LABELS):  # I- follows B- or I- of its kind only
        for j, b in enumerate(LABELS):
            if b[0] == "I" and a[2:] != b[2:]:
                step[k, j] = -30.0
    fixed = step < 0
    by_length: dict[int, list[int]] = {}
    for k, r in enumerate(rows):
        by_length.setdefault(len(r), []).append(k)
    packs = []
    for n, ks in by_length.items():
        ids = [[[index[f] for f in fs] for fs in rows[k]] for k in ks]
        gold = np.array([[LABELS.index(x) for x in table[k][1]] for k in ks])
        flat = np.array([(s * n + t, i) for s, r in enumerate(ids) for t, fs in enumerate(r) for i in fs])
        packs.append((n, len(ks), gold, flat[:, 0], flat[:, 1]))
    seen_e, seen_s = np.full_like(emit, 1e-6), np.full_like(step, 1e-6)
    for _ in range(rounds):
        ge, gs = -decay * emit, np.where(fixed, 0, -decay * step)
        for n, m, gold, at, fid in packs:
            x = np.zeros((m * n, size))
            np.add.at(x, at, emit[fid])
            x = x.reshape(m, n, size)
            a = [x[:, 0] + step[0]]
            for t in range(1, n):
                a.append(_log_sum(a[-1][:, :, None] + step[None], 1) + x[:, t])
            b = [np.broadcast_to(step[:, 0], (m, size))]
            for t in range(n - 2, -1, -1):
                b.append(_log_sum(step[None] + (x[:, t + 1] + b[-1])[:, None, :], 2))
            b.reverse()
            z = _log_sum(a[-1] + step[:, 0], 1)
            post = np.stack([np.exp(a[t] + b[t] - z[:, None]) for t in range(n)], axis=1)
            diff = -post
            np.put_along_axis(diff, gold[:, :, None], np.take_along_axis(diff, gold[:, :, None], 2) + 1, 2)
            np.add.at(ge, fid, diff.reshape(m * n, size)[at])
            for t in range(1, n):
                pair = np.exp(a[t - 1][:, :, None] + step[None] + (x[:, t] + b[t])[:, None, :] - z[:, None, None])
                gs -= pair.sum(axis=0)
                np.add.at(gs, (gold[:, t - 1], gold[:, t]), 1)
            gs[0] += np.bincount(gold[:, 0], minlength=size) - post[:, 0].sum(axis=0)
            gs[:, 0] += np.bincount(gold[:, -1], minlength=size) - post[:, -1].sum(axis=0)
        gs[fixed] = 0
        seen_e += ge**2
        seen_s += gs**2
        emit += rate * ge / np.sqrt(seen_e)
        step += rate * gs / np.sqrt(seen_s)
    return Field(index, emit, step)


def _valid(kind: str, text: str) -> bool:
    d = digits_of(text)
    if kind == "card":
        return 13 <= len(d) <= 19 and luhn(d)
    if kind == "phone":
        return 8 <= len(d) <= 15 and not any(c.isalpha() for c in text)
    if kind == "ip":
        m = re.match(r"[0-9]{1,3}(?:\.[0-9]{1,3}){3}", text)
        return bool(m) and all(map(octet, m.group().split(".")))
    words = text.split()
    return any(c.isalpha() for c in text) and ("." in text or any(map(DOT_WORD.fullmatch, words))) and ("@" in text or any(map(AT_WORD.fullmatch, words)))


def _neighbours(text: str, start: int, end: int) -> tuple[str, str]:
    """The words before and after text[start:end], or "" at the text's ends."""
    z = start
    while z > 0 and text[z - 1].isspace():
        z -= 1
    a = z
    while a > 0 and not text[a - 1].isspace():
        a -= 1
    after = WORD.search(text, end)
    return text[a:z], after.group() if after else ""


def all_spans(texts: list[str | None], field: Field) -> list[tuple[list[Span], list[Span]]]:
    """(base, base and added) of each text.  A found span is added where it overlaps no base span and could be what it is said to be."""
    base = [base_spans(t) for t in texts]
    work, chains = [], []
    for k, t in enumerate(texts):
        for run in runs_of(t) if t else ():
            cuts = [trimmed(t, a, b) for a, b in run]
            words = [t[a:b] for a, b in cuts]
            work.append((k, cuts))
            chains.append(field.scores(features(words, *_neighbours(t, run[0][0], run[-1][1]))))
    added: list[list[Span]] = [[] for _ in texts]
    for at in range(0, len(chains), BATCH):
        for (k, cuts), labels in zip(work[at : at + BATCH], field.decode(chains[at : at + BATCH]), strict=True):
            i = 0
            while i < len(labels):
                if LABELS[labels[i]][0] != "B":
                    i += 1
                    continue
                j, kind = i + 1, LABELS[labels[i]][2:]
                while j < len(labels) and LABELS[labels[j]] == f"I-{kind}":
                    j += 1
                start, end = cuts[i][0], cuts[j - 1][1]
                if start < end and _valid(kind, texts[k][start:end]) and not any(a < end and start < b for _, a, b in base[k]):
                    added[k].append((kind, start, end))
                i = j
    order = {kind: n for n, kind in enumerate(KINDS)}
    return [(b, sorted(b + a, key=lambda s: (order[s[0]], s[1]))) for b, a in zip(base, added, strict=True)]


def joined(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def find_personal_data(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, n_email, n_ip, n_card, n_phone (of the patterns), base_sha256, spans, n_added.

    Null and empty texts have no spans; texts and words of any length are read
    whole.  Of equal best label paths the one of the first labels is taken.
    Repeated rows stay rows.  Only the two named columns are read.  An empty
    table gives an empty result.
    """
    spark = docs.sparkSession
    arrow_batches(spark)
    weights = train()
    sent = spark.sparkContext.broadcast((weights.index, weights.emit, weights.step))  # a few thousand weights, plain: workers need not have this package

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        field = Field(*sent.value)
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                got = all_spans(part.column(1).to_pylist(), field)
                counts = [pa.array([sum(s[0] == kind for s in base) for base, _ in got], pa.int64()) for kind in KINDS]
                yield pa.RecordBatch.from_arrays([part.column(0), *counts, pa.array([hashlib.sha256(joined(base).encode()).hexdigest() for base, _ in got]), pa.array([joined(every) for _, every in got], pa.string()), pa.array([len(every) - len(base) for base, every in got], pa.int64())], names=["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans", "n_added"])

    own = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return own.mapInArrow(releasing(run), "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long")
