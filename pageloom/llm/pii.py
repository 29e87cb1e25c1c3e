"""Operator 7: personal data by a linear-chain conditional random field.

Tokens are the white-space separated words of a line; their features are word
shapes (runs of upper case, lower case, digits and each other sign, with and
without run lengths), lengths, first and last sign, a few cue words, and the
same of the neighbours, hashed into one table. The field is trained on the small
labelled table of ``training_table`` by gradient steps on its log-likelihood, on
the driver; lines are decoded by Viterbi in numpy batches over all lines of a
chunk at once. One scan, a model of fixed size, no shuffle.

Defined results: null, empty and blank texts give no row; a span never crosses a
line; rows of equal doc_id give their spans each; offsets count characters of
the text, and trimming takes surrounding punctuation off a span.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from . import _kernels as K
from ._spark import table

KINDS = ("email", "ip", "phone", "card", "secret", "ssn", "iban")
#: O, then B and I of each kind.
LABELS = ("O", *(f"{p}-{k}" for k in KINDS for p in "BI"))
BITS = 15
#: Characters decoded at once.
CHUNK = 1_200_000
_CUES = ("password", "passwd", "pwd", "token", "secret", "key", "api_key", "apikey", "=", "phone", "tel", "call", "mail", "email", "card", "visa", "ssn", "iban", "ip", "address", "version", "year", "section", "page", "chapter", "$", "no", "id", "number", "account")
#: Beginnings that well-known kinds of keys have.
_PREFIXES = ("akia", "asia", "ghp_", "gho_", "xoxb", "xoxp", "aiza", "sk-l")


def _shape_codes(codes: np.ndarray) -> np.ndarray:
    """Class of every code point: letters, digits, and each sign as itself."""
    out = codes.astype(np.uint32).copy()
    alpha, digit = K.is_kind(codes, "alpha"), K.is_kind(codes, "digit")
    out[alpha] = 0x110001
    out[K.is_kind(codes, "upper")] = 0x110002
    out[digit] = 0x110003
    return out


def token_features(codes: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashed features of each token by itself, one column per feature."""
    shape = _shape_codes(codes)
    edge = np.ones(len(shape), bool)
    edge[1:] = shape[1:] != shape[:-1]
    edge[start] = True
    begin = np.flatnonzero(edge)
    # A run ends with its token, whatever comes after.
    run_of = np.searchsorted(begin, np.stack([start, end]))
    size = np.diff(np.append(begin, len(shape)))
    last = run_of[1] - 1
    size[last] = end - begin[last]
    step = np.searchsorted(np.array([1, 2, 3, 4, 5, 8, 9, 12, 13, 15, 16, 17, 20, 30, 39]), size, "right").astype(np.uint32)
    kind = shape[begin]
    plain, sized = K.SpanHash(kind), K.SpanHash(kind * np.uint32(32) + step)
    long, short = plain(*run_of), sized(*run_of)
    digits, letters = np.concatenate(([0], np.cumsum(shape == 0x110003))), np.concatenate(([0], np.cumsum(shape == 0x110001)))
    length = end - start
    low = K.lower(codes)
    # Cue words, without punctuation at their ends.
    tail = np.where((length > 1) & ((codes[end - 1] == 58) | (codes[end - 1] == 44)), end - 1, end)
    word = K.SpanHash(low)(start, tail)
    cut = np.flatnonzero(codes == 61)
    eq = np.minimum(np.searchsorted(cut, start), max(len(cut) - 1, 0))
    has = (cut[eq] < end) & (cut[eq] > start) if len(cut) and len(start) else np.zeros(len(start), bool)
    if has.any():
        word[has] = K.SpanHash(low)(start[has], cut[eq][has])
    cues, at = K.codepoints(list(_CUES))
    cue = np.sort(K.SpanHash(cues)(at[:-1], at[1:]))
    word = np.where(np.isin(word, cue), word, np.uint64(7))
    mixed = (digits[end] - digits[start]).clip(0, 20).astype(np.uint64) * np.uint64(64) + np.searchsorted(np.array([0, 1, 2, 3, 5, 8, 12, 16, 20, 30, 40]), letters[end] - letters[start], "right").astype(np.uint64)
    runs_in = (run_of[1] - run_of[0]).clip(0, 30).astype(np.uint64) * np.uint64(64) + (digits[end] > digits[start])
    ends = shape[start].astype(np.uint64) * np.uint64(1 << 24) + shape[end - 1]
    sizes = np.searchsorted(np.array([1, 2, 3, 4, 6, 8, 12, 15, 16, 17, 19, 20, 21, 24, 32, 40, 41]), length, "right").astype(np.uint64)
    upper = np.concatenate(([0], np.cumsum(shape == 0x110002)))
    flags = ((digits[end] > digits[start]) * 1 + (upper[end] > upper[start]) * 2 + (letters[end] > letters[start]) * 4 + (upper[end] - upper[start] + letters[end] - letters[start] + digits[end] - digits[start] < length) * 8).astype(np.uint64)
    prefixes, at = K.codepoints(list(_PREFIXES))
    head = K.SpanHash(low)(start, np.minimum(start + 4, end))
    head = np.where(np.isin(head, np.sort(K.SpanHash(prefixes)(at[:-1], at[1:]))) & (length > 8), head, np.uint64(7))
    made = [flags * np.uint64(64) + sizes, head, long, short, word, mixed, runs_in, ends, sizes * np.uint64(64) + (digits[end] > digits[start]) * np.uint64(2) + has]
    return np.stack([(K.mix(f ^ np.uint64(0x1000003 * (i + 1))) >> np.uint64(64 - BITS)).astype(np.int32) for i, f in enumerate(made)], axis=1)


#: Which of the token's own features its neighbours see, by distance.
_NEAR = {-2: (4,), -1: (2, 3, 4), 1: (2, 3, 4), 2: (4,)}


class Field:
    """A linear-chain CRF: own and neighbour feature tables, transitions, and start scores."""

    def __init__(self) -> None:
        s = len(LABELS)
        self.own = np.zeros((1 << BITS, s), np.float32)
        self.near = {d: np.zeros((1 << BITS, s), np.float32) for d in _NEAR}
        self.move = np.zeros((s, s), np.float32)
        self.begin = np.zeros(s, np.float32)
        for j, y in enumerate(LABELS):
            if y[0] == "I":
                for i, x in enumerate(LABELS):
                    if x not in (f"B-{y[2:]}", y):
                        self.move[i, j] = -1e4
                self.begin[j] = -1e4

    def tables(self, kinds: np.ndarray) -> tuple[np.ndarray, dict[int, np.ndarray]]:
        """Label scores that a token of each kind gives itself, and its neighbours by distance."""
        own = sum(self.own[kinds[:, f]] for f in range(kinds.shape[1]))
        return own, {d: sum(self.near[d][kinds[:, f]] for f in some) for d, some in _NEAR.items()}

    def emissions(self, kinds: np.ndarray, kind: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        """Label scores of every token; first and last are its line's token range."""
        own, near = self.tables(kinds)
        out, at = own[kind], np.arange(len(kind))
        for d, table_ in near.items():
            idx = np.flatnonzero((at + d >= first) & (at + d < last))
            out[idx] += table_[kind[idx + d]]
        return out

    def plain_lines(self, kinds: np.ndarray, kind: np.ndarray, first: np.ndarray, last: np.ndarray, lines: np.ndarray) -> np.ndarray:
        """Lines whose best path is proved to be O throughout.

        A path that differs from all-O loses, at every token it labels otherwise,
        at least the token's margin, and wins at most two transitions there. Where
        a lower bound of every margin exceeds that, decoding can't find anything.
        """
        own, near = self.tables(kinds)
        margin = lambda x: x[:, 0] - x[:, 1:].max(axis=1)
        bound, at = margin(own)[kind], np.arange(len(kind))
        for d, table_ in near.items():
            idx = np.flatnonzero((at + d >= first) & (at + d < last))
            bound[idx] += margin(table_)[kind[idx + d]]
        move, begin = max(0.0, float(self.move.max() - self.move[0, 0])), max(0.0, float(self.begin.max() - self.begin[0]))
        return np.minimum.reduceat(bound, lines[:-1]) > move + max(move, begin) + 1e-3

    def decode(self, scores: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Viterbi labels of all tokens, all lines in step; longest lines first."""
        count = np.diff(offsets)
        order = np.argsort(-count, kind="stable")
        count, base = count[order], offsets[:-1][order]
        labels = np.zeros(len(scores), np.int8)
        if not len(count) or not count[0]:
            return labels
        back = np.zeros((len(scores), len(LABELS)), np.int8)
        live = int(np.searchsorted(-count, 0, "left"))
        best = scores[base[:live]] + self.begin
        final = np.zeros(len(count), np.int8)
        for t in range(1, int(count[0]) + 1):
            now = int(np.searchsorted(-count, -t, "left"))
            if now < live:
                final[now:live] = best[now:].argmax(axis=1)
                best = best[:now]
            live = now
            if not live:
                break
            row = base[:live] + t
            step = best[:, :, None] + self.move[None]
            ptr = step.argmax(axis=1)
            back[row] = ptr
            best = np.take_along_axis(step, ptr[:, None], 1)[:, 0] + scores[row]
        here = final.copy()
        for t in range(int(count[0]) - 1, -1, -1):
            live = int(np.searchsorted(-count, -t, "left"))
            row = base[:live] + t
            labels[row] = here[:live]
            here[:live] = back[row, here[:live]]
        return labels


def training_table(seed: int = 11, rows: int = 3000) -> list[tuple[list[str], list[str]]]:
    """The small labelled table: made-up lines as ``(tokens, labels)``, with hard negatives."""
    rng = np.random.default_rng(seed)
    pick = lambda x: x[int(rng.integers(len(x)))]
    some = lambda alphabet, n: "".join(pick(alphabet) for _ in range(n))
    low, up, dig, hexa = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", "0123456789abcdef"
    vocab = ["".join(pick(("an", "er", "th", "on", "é", "è", "ü", "ch", "ing", "de", "la", "ß", "ñ", "ó", "tion", "heit", "ment", "ou", "ble", "ê", "ç")) for _ in range(rng.integers(1, 9))) for _ in range(800)]
    n = lambda a, b: int(rng.integers(a, b))
    d = lambda k: some(dig, k)

    def email() -> list[str]:
        user = pick((some(low, n(2, 11)), f"{some(low, n(2, 9))}.{d(2)}", f"{some(low, n(3, 8))}.{some(low, n(3, 8))}", f"{some(low, n(2, 8))}_{d(n(1, 4))}", f"{pick(up)}{some(low, n(2, 7))}.{some(low, n(3, 7))}"))
        return [f"{user}@{pick((some(low, n(3, 9)), some(low, 4) + d(1), f'{some(low, 4)}{d(n(1, 3))}.{some(low, n(4, 8))}', f'{some(low, 5)}-{some(low, 4)}'))}.{pick(('com', 'org', 'net', 'de', 'fr', 'es', 'io', 'co.uk'))}"]

    def ip() -> list[str]:
        return [".".join(str(n(1, 256)) for _ in range(4))]

    def phone() -> list[str]:
        return pick(([f"+{n(1, 99)}", f"({d(3)})", f"{d(3)}-{d(4)}"], [f"({d(3)})", f"{d(3)}-{d(4)}"], [f"{d(3)}-{d(3)}-{d(4)}"], [f"+{n(1, 99)}-{d(3)}-{d(3)}-{d(4)}"], [f"{d(3)}.{d(3)}.{d(4)}"], [f"+{n(1, 99)}", d(3), d(3), d(4)], [f"+{n(10, 99)}{d(10)}"], [f"+{n(1, 9)}", f"{d(3)}-{d(3)}-{d(4)}"]))

    def card() -> list[str]:
        return pick(([d(16)], [d(16)], [d(4), d(4), d(4), d(4)], ["-".join(d(4) for _ in range(4))], [d(15)]))

    def secret() -> list[str]:
        return pick(
            (
                ["AKIA" + some(up + dig, 16)], ["AKIA" + some(up + dig, 16)], [f"password={some(hexa, n(8, 24))}"], [f"password={some(low + dig + up, n(8, 20))}"], ["token", "=", f'"{some(hexa, n(20, 41))}"'], ["token", "=", f'"{some(hexa, 40)}"'],
                ["api_key", "=", f'"{some(hexa, n(20, 41))}"'], [f"api_key={some(hexa, 32)}"], [f"secret={some(hexa, n(12, 32))}"], ["password:", some(low + dig, 12)], ["ghp_" + some(low + up + dig, 36)], ["sk-" + some(low + up + dig, 32)], [f"token={some(hexa, n(16, 40))}"],
            )
        )

    def ssn() -> list[str]:
        return [f"{d(3)}-{d(2)}-{d(4)}"]

    def iban() -> list[str]:
        return [pick(("DE", "FR", "ES", "GB")) + d(2) + pick((d(18), some(up, 4) + d(14)))]

    def harmless() -> list[str]:
        return pick(
            (
                [str(n(0, 100))], [str(n(1900, 2100))], [f"{n(0, 10)}.{n(0, 10)}"], [f"{n(0, 10)}.{n(0, 10)}."], [f"{n(0, 10)}.{n(0, 20)}.{n(0, 20)}"], [d(3)], [d(4)], [d(5)], [d(6)], [f"{n(1, 12)}/{n(1, 30)}/{n(1990, 2030)}"], [f"{n(1990, 2030)}-{n(10, 12)}-{n(10, 28)}"], ["Version", "2.0."], ["version", "3."], ["CC", "BY-NC", "4.0."],
                [f"${n(1, 900)}"], [f"{n(1, 100)}%"], ["page", str(n(1, 300))], ["section", f"{n(1, 9)}.{n(1, 9)}"], [f"{n(1, 24)}:{d(2)}"], [f"{pick(vocab)}$$$"], [f"{pick(vocab)}###"], [f"{pick(vocab)}***"], [f"{pick(vocab)}&&&"], [f"{pick(vocab)}%%%"], [pick(vocab).upper() + "!!"], ["|"], ["="], ["password"], ["token"], ["@"], ["a@b"], [pick(vocab) + "=" + pick(vocab)],
                [some(up, n(3, 12))], [some(up, n(2, 9)) + d(n(1, 3))], [f"{pick(vocab)}-{pick(vocab)}"], [f'"{pick(vocab)}"'], [f"({pick(vocab)})"], [f"({d(4)})"], [f"{n(1, 100)},{d(3)}"], [f"{n(100, 999)}-{n(100, 999)}"], [f"{pick(vocab)}_{d(2)}"], ["https://" + some(low, 8) + ".com/" + some(low, 5)], [some(low, 6) + ".com"], ["key", "=", pick(vocab)], [f"{pick(vocab)}={n(0, 99)}"], [f"fig{n(1, 9)}"], [f"#{n(1, 99)}"],
            )
        )

    makers = dict(zip(KINDS, (email, ip, phone, card, secret, ssn, iban)))
    out = []
    for _ in range(rows):
        tokens, labels = [], []
        for _ in range(n(1, 5)):
            for _ in range(n(0, 5)):
                w = pick(vocab)
                tokens.append(pick((w, w, w, w.capitalize(), w.capitalize(), w + ",", w + ".", w.capitalize() + ".", w.capitalize() + ",")))
                labels.append("O")
            if rng.random() < 0.55:
                kind = pick(KINDS)
                made = makers[kind]()
                if rng.random() < 0.2:
                    made[-1] += pick((".", ",", ";", ")"))
                tokens += made
                labels += [f"{'I' if i else 'B'}-{kind}" for i in range(len(made))]
            elif rng.random() < 0.8:
                made = harmless()
                tokens += made
                labels += ["O"] * len(made)
        for _ in range(n(0, 4)):
            tokens.append(pick(vocab))
            labels.append("O")
        if tokens:
            out.append((tokens, labels))
    return out


def _prepare(texts: list[str]) -> tuple[np.ndarray, ...]:
    """Code points, text offsets, token bounds, and token offsets per line."""
    codes, offsets = K.codepoints(texts)
    start, end, _ = K.split_words(codes, offsets)
    breaks = np.union1d(offsets, np.flatnonzero(codes == 10))
    return codes, offsets, start, end, np.unique(np.concatenate(([0], np.searchsorted(start, breaks), [len(start)])))


def _bounds(lines: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    count = np.diff(lines)
    return np.repeat(lines[:-1], count), np.repeat(lines[1:], count)


def distinct(feats: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct feature rows, and which of them each token has."""
    key = np.zeros(len(feats), np.uint64)
    for f in range(feats.shape[1]):
        key = K.mix(key * np.uint64(0x9E3779B97F4A7C15) + feats[:, f].astype(np.uint64) + np.uint64(1))
    _, at, kind = np.unique(key, return_index=True, return_inverse=True)
    return feats[at], kind


def fit(rows: list[tuple[list[str], list[str]]], epochs: int = 80, rate: float = 0.3, ridge: float = 1e-5) -> Field:
    """Full-batch AdaGrad on the conditional log-likelihood; gradients by forward-backward over padded lines."""
    field = Field()
    codes, _, start, end, lines = _prepare([" ".join(t) for t, _ in rows])
    feats = token_features(codes, start, end)
    gold = np.array([LABELS.index(y) for _, ys in rows for y in ys])
    kinds, kind = distinct(feats)
    first, last = _bounds(lines)
    n, s, m = len(gold), len(LABELS), len(rows)
    count = np.diff(lines)
    width = int(count.max())
    at = np.zeros((m, width), np.int64)
    mask = np.arange(width)[None] < count[:, None]
    at[mask] = np.arange(n)
    state = {"move": np.full((s, s), 1e-4), "begin": np.full(s, 1e-4), "own": np.full(field.own.shape, 1e-4, np.float32), **{d: np.full(field.own.shape, 1e-4, np.float32) for d in _NEAR}}
    true = np.zeros((n, s))
    true[np.arange(n), gold] = 1
    inner = np.flatnonzero(np.arange(n) > first)
    seen_moves = np.zeros((s, s))
    np.add.at(seen_moves, (gold[inner - 1], gold[inner]), 1)
    allowed = field.move > -1e3
    for _ in range(epochs):
        e = field.emissions(kinds, kind, first, last).astype(np.float64)
        psi = np.exp(e - e.max(axis=1, keepdims=True))[at]
        move_, begin_ = np.exp(field.move.astype(np.float64)), np.exp(field.begin.astype(np.float64))
        alpha, beta, scale = np.zeros((width, m, s)), np.ones((width, m, s)), np.ones((width, m, 1))
        for t in range(width):  # scaled forward pass; a line that has ended keeps its values
            new = (begin_ if not t else alpha[t - 1] @ move_) * psi[:, t]
            scale[t] = np.where(mask[:, t, None], new.sum(axis=1, keepdims=True), 1)
            alpha[t] = np.where(mask[:, t, None], new / scale[t], alpha[t - 1])
        expect = np.zeros((s, s))
        for t in range(width - 1, 0, -1):
            weighted = np.where(mask[:, t, None], psi[:, t] * beta[t] / scale[t], 0)
            beta[t - 1] = np.where(mask[:, t, None], weighted @ move_.T, beta[t])
            expect += (alpha[t - 1].T @ weighted) * move_
        prob = (alpha * beta).transpose(1, 0, 2)[mask]
        g = (prob - true).astype(np.float32)

        def step(name, table, grad):
            grad = grad + ridge * table
            state[name] += grad * grad
            table -= (rate * grad / np.sqrt(state[name])).astype(np.float32)

        move = np.where(allowed, expect - seen_moves, 0)
        keep = field.move.copy()
        step("move", field.move, move)
        field.move[~allowed] = keep[~allowed]
        start_grad = g[np.flatnonzero(np.arange(n) == first)].sum(axis=0)
        start_grad[field.begin < -1e3] = 0
        keep = field.begin.copy()
        step("begin", field.begin, start_grad)
        field.begin[keep < -1e3] = keep[keep < -1e3]
        per = np.zeros((len(kinds), s), np.float32)
        np.add.at(per, kind, g)
        grad = np.zeros_like(field.own)
        for f in range(kinds.shape[1]):
            np.add.at(grad, kinds[:, f], per)
        step("own", field.own, grad)
        for d, some in _NEAR.items():
            idx = np.flatnonzero((np.arange(n) + d >= first) & (np.arange(n) + d < last))
            per = np.zeros((len(kinds), s), np.float32)
            np.add.at(per, kind[idx + d], g[idx])
            grad = np.zeros_like(field.own)
            for f in some:
                np.add.at(grad, kinds[:, f], per)
            step(d, field.near[d], grad)
    return field


def find(field: Field, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, list[str]]:
    """Text index, kind, start and end of every span, and its words."""
    codes, offsets, start, end, lines = _prepare(texts)
    none = np.zeros(0, np.int64)
    if not len(start):
        return none, none, none, none, []
    kinds, kind = distinct(token_features(codes, start, end))
    first, last = _bounds(lines)
    labels = np.zeros(len(start), np.int8)
    open_lines = np.flatnonzero(~field.plain_lines(kinds, kind, first, last, lines))
    at, some = K.ragged(lines[open_lines], np.diff(lines)[open_lines])
    if len(at):
        labels[at] = field.decode(field.emissions(kinds, kind[at], *_bounds(some)), some)
    begin = np.flatnonzero(labels % 2 == 1)
    inside = np.concatenate((labels, [0]))
    stop = begin + 1
    while len(more := np.flatnonzero((inside[stop] == labels[begin] + 1) & (stop < last[begin]))):
        stop[more] += 1
    s, e = start[begin], end[stop - 1]
    solid = np.flatnonzero(K.is_kind(codes, "alpha") | K.is_kind(codes, "digit"))
    text = np.searchsorted(offsets, s, "right") - 1
    if len(solid):
        close = solid[np.maximum(np.searchsorted(solid, e) - 1, 0)] + 1
        e = np.where(close > s, close, e)
        opens = np.isin(codes[s], [ord(c) for c in "\"'([{<,;:"])
        s = np.where(opens & (codes[s] != 40) & (s + 1 < e), s + 1, s)
    words = [codes[a:b].tobytes().decode("utf-32-le", "surrogatepass") for a, b in zip(s, e)]
    return text, labels[begin].astype(np.int64) // 2, s - offsets[text], e - offsets[text], words


def spans(docs: DataFrame, field: Field) -> DataFrame:
    """``(doc_id, kind, start, end, words)`` for every span of personal data."""
    sent = docs.sparkSession.sparkContext.broadcast(field)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = np.array(KINDS)
        for batch in batches:
            for part, texts in K.chunks(batch, limit=CHUNK):
                text, kind, start, end, words = find(sent.value, texts)
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(text)), pa.array(names[kind].tolist(), pa.string()), pa.array(start.astype(np.int32)), pa.array(end.astype(np.int32)), pa.array(words, pa.string())], ["doc_id", "kind", "start", "end", "words"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, kind string, start int, end int, words string")


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every span of personal data or secrets in the documents."""
    return spans(table(spark, sf_dir, "documents"), fit(training_table()))
