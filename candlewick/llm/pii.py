"""Personal data: patterns with checks, and a linear-chain conditional random field over word shapes."""

from __future__ import annotations

import random
import re
import string
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ["email", "ip", "card", "phone"]
#: Kinds that only the field finds.
FIELD = ["crf_email", "crf_phone", "crf_card"]
LABELS = ["O", "crf_email", "crf_phone", "crf_card"]
HASHES = 1 << 12
#: Words of a piece whose best paths are found side by side with other pieces, and words labelled at once.
PIECE, AT_ONCE = 64, 50_000
#: Words and pairs whose scores a task remembers.
REMEMBERED = 100_000

_LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# A digit before the start would have been part of the match, so it costs nothing to rule it out.
_IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_WORD = re.compile(r"[^ \t-\r]+")
_MARK = re.compile(r"[(\[{<] ?(at|dot) ?[)\]}>]", re.IGNORECASE)
_LONG_RUN = re.compile(r"(.)\1{4,}", re.DOTALL)
_SHAPES = str.maketrans({c: "d" if c.isdigit() else "X" if c.isupper() else "x" for c in string.ascii_letters + string.digits})
_CUES = frozenset(["at", "dot", "phone", "call", "tel", "card", "account", "email", "mail", "contact"])


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost addresses without overlap; each @ is looked at once, so long runs stay linear."""
    free, at = 0, text.find("@")
    while at >= 0:
        before = text[free:at]
        start = free + len(before.rstrip(_LOCAL))
        found = _DOMAIN.match(text, at + 1) if start < at else None
        if found:
            yield start, found.end()
        free = found.end() if found else at + 1
        at = text.find("@", free)


def luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2])) + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """``start, place of the kind, end`` of the patterns' matches that pass their checks, in order."""
    spans = [(a, 0, b) for a, b in _emails(text)]
    if "." in text:
        for m in _IP.finditer(text):
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in m[0].split(".")):
                spans.append((m.start(), 1, m.end()))
    for m in _CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 14 <= len(digits) <= 19 and luhn(digits):
            spans.append((m.start(), 2, m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 10 <= sum(c.isdigit() for c in m[0]) <= 15:
                spans.append((m.start(), 3, m.end()))
    return sorted(spans)


def shape(word: str) -> str:
    """Letters and digits as X, x and d, each run with its length up to 4; other characters stay."""
    if len(word) > 40:
        word = word[:30] + word[-10:]
    out, last, run = [], "", 0
    for c in word:
        kind = "d" if c.isdigit() else ("X" if c.isupper() else "x") if c.isalpha() else c
        run = run + 1 if kind == last else 1
        if run <= 4:
            out.append(kind)
        last = kind
    return "".join(out)


def _marks(text: str) -> str:
    """Which of "at" and "dot" stand in brackets in ``text``."""
    if "(" not in text and "[" not in text and "{" not in text and "<" not in text:
        return ""
    return ",".join(sorted({m.lower() for m in _MARK.findall(text)}))


def _quick_shape(word: str) -> str:
    """``shape``, faster for ASCII words."""
    if len(word) > 40 or not word.isascii():
        return shape(word)
    return _LONG_RUN.sub(r"\1\1\1\1", word.translate(_SHAPES))


def _own_names(word: str, own: str) -> list[str]:
    """Features of a word of shape ``own`` by itself."""
    digits = sum(c.isdigit() for c in word)
    low = word.lower().strip(".,;:()[]<>")
    return ["b", f"s={own}", f"m={_marks(word)}", f"d={min(digits, 20)}", f"@={'@' in word}", f"t={digits > 0}{'.' in word}{'-' in word}{'(' in word}{'[' in word}",
            f"w={low if low in _CUES else ''}"]


def _lead_name(word: str) -> str:
    """The feature that ``word`` gives to a word with digits behind it."""
    return f"pw={word.lower().strip('.,;:()[]<>') if word[:1].isalpha() and len(word) < 9 else ''}"


def _ids(names: list[str]) -> list[int]:
    return [zlib.crc32(n.encode("utf-8", "replace")) % HASHES for n in names]


def _observations(words: list[str]) -> list[list[int]]:
    """Hashed features of each word: its shape, size, signs and neighbours."""
    shapes = [shape(w) for w in words]
    found = []
    for i, (word, own) in enumerate(zip(words, shapes)):
        before = shapes[i - 1] if i else "^"
        after = shapes[i + 1] if i + 1 < len(words) else "$"
        digits = any(c.isdigit() for c in word)
        found.append(_ids(_own_names(word, own) + [
            f"p={before[:4]}", f"n={after[:4]}", f"ps={before[-3:]}|{own[:3]}", f"ns={own[-3:]}|{after[:3]}",
            _lead_name(words[i - 1]) if i and digits else "pw="]))
    return found


class WordScores:
    """The scores of ``_observations`` for many words at once.

    What a word has by itself and adds to its neighbours is summed once per class of
    words with the same features, what two neighbours add together once per pair of shape ends.
    """

    def __init__(self, emit: np.ndarray) -> None:
        self.emit = emit
        self.clear()

    def clear(self) -> None:
        self.words: dict[str, int] = {}
        self.classes: dict[tuple, int] = {}
        self.ends: dict[str, int] = {}
        self.pairs: dict[int, np.ndarray] = {}
        self.leads: dict[str, np.ndarray] = {}
        #: By class: sums as the word itself, the word before, the word behind; digits, first and last of the shape.
        self.sums: list[list[np.ndarray]] = []
        self.kinds: list[tuple[bool, int, int]] = []
        for outside in "^$":  # before the first and behind the last word
            self.learn(outside)

    def sum(self, *names: str) -> np.ndarray:
        return self.emit[_ids(list(names))].sum(axis=0)

    def learn(self, word: str) -> int:
        own, low = _quick_shape(word), word.lower().strip(".,;:()[]<>")
        digits = 0 if word.isalpha() else sum(map(str.isdigit, word))
        key = (own, digits, low if low in _CUES else "", _marks(word), len(word) > 40 and tuple(c in word for c in "@.-(["))
        place = self.classes.setdefault(key, len(self.sums))
        if place == len(self.sums):
            self.sums.append([self.sum(*_own_names(word, own)), self.sum(f"p={own[:4]}"), self.sum(f"n={own[:4]}")])
            self.kinds.append((digits > 0, *(self.ends.setdefault(e, len(self.ends)) for e in (own[:3], own[-3:]))))
        return place

    def lead(self, word: str) -> np.ndarray:
        if word not in self.leads:
            self.leads[word] = self.sum(_lead_name(word))
        return self.leads[word]

    def scores(self, words: list[str], first: np.ndarray) -> np.ndarray:
        if len(self.words) + len(self.leads) + len(self.pairs) > REMEMBERED:
            self.clear()
        for word in set(words).difference(self.words):
            self.words[word] = self.learn(word)
        own = np.fromiter(map(self.words.__getitem__, words), np.int64, len(words))
        before = np.where(first, 0, np.roll(own, 1))
        after = np.where(np.roll(first, -1), 1, np.roll(own, -1))
        sums, (digits, head, tail) = np.array(self.sums), np.array(self.kinds, np.int64).T
        pair, at = np.unique(np.concatenate([tail[before] << 32 | head[own], tail[own] << 32 | head[after]]), return_inverse=True)
        names = list(self.ends)
        for key in pair.tolist():
            if key not in self.pairs:
                both = f"{names[key >> 32]}|{names[key & 0xFFFFFFFF]}"
                self.pairs[key] = np.array([self.sum(f"ps={both}"), self.sum(f"ns={both}")])
        joint = np.array([self.pairs[key] for key in pair.tolist()])
        out = (sums[own, 0] + sums[before, 1] + sums[after, 2] + joint[at[: len(own)], 0] + joint[at[len(own) :], 1]
               + self.lead(""))
        for i in np.flatnonzero((digits[own] > 0) & ~first).tolist():
            out[i] += self.lead(words[i - 1]) - self.lead("")
        return out


def labelled_table(rows: int = 240, seed: int = 5) -> list[tuple[list[str], list[str]]]:
    """The small labelled table: words and labels of sentences made from a few patterns."""
    rng = random.Random(seed)

    def number(n: int) -> str:
        return "".join(rng.choice("0123456789") for _ in range(n))

    def name() -> str:
        return "".join(rng.choice("abcdefghijklmnoprstuvwz") for _ in range(rng.randint(2, 9)))

    def email() -> list[str]:
        user, host = name() + rng.choice(["", "." + name(), number(2)]), name()
        return rng.choice([[f"{user}[at]{host}[dot]com"], [user + "@" + host], [user, "(at)", host, "(dot)", "org"],
                           [user, "[at]", host, "[dot]", "net"], [f"{user}(at){host}.com"]])

    def phone() -> list[str]:
        a, b, c = number(3), number(3), number(4)
        return rng.choice([[f"({a})", f"{b}-{c}"], [f"{a}-{b}-{c}"], [f"{a}.{b}.{c}"], [f"({a}){b}-{c}"], [f"00{number(2)}", a, b + c]])

    def card() -> list[str]:
        return rng.choice([[f"{number(4)}-{number(4)}-{number(4)}-{number(4)}"], [number(16)],
                           [number(4), number(4), number(4), number(4)]])

    def plain() -> list[str]:
        return rng.choice([[name()], [name()], [name().capitalize()], [name() + ","], [number(rng.randint(1, 4))],
                           [number(4) + "."], [f"{number(2)}.{number(1)}"], [f"{number(2)}-{number(2)}"], [name() + number(1)],
                           [f"v{number(1)}.{number(1)}.{number(1)}"], [f"{number(2)}:{number(2)}"], [f"{number(4)}-{number(2)}-{number(2)}"],
                           ["at"], ["dot"], [name() + "###"], [number(rng.randint(20, 30))], [f"{number(1)},{number(3)},{number(3)}"]])

    table = []
    for i in range(rows):
        words, labels = [], []
        for _ in range(rng.randint(2, 6)):
            words += plain()
        labels += ["O"] * len(words)
        if i % 4:
            kind = ("crf_email", "crf_phone", "crf_card")[i % 3]
            found = {"crf_email": email, "crf_phone": phone, "crf_card": card}[kind]()
            tail = rng.choice(["", "", ".", ",", "###", "!!"])
            words += found[:-1] + [found[-1] + tail]
            labels += [kind] * len(found)
            more = plain() + plain()
            words += more
            labels += ["O"] * len(more)
        table.append((words, labels))
    return table


class ChainField:
    """Weights of features per label and of label pairs."""

    def __init__(self, emit: np.ndarray, move: np.ndarray) -> None:
        self.emit, self.move = emit, move

    def scores(self, observed: list[list[list[int]]]) -> tuple[np.ndarray, np.ndarray]:
        """Scores (sequence, place, label), padded, and the lengths."""
        length = np.array([len(o) for o in observed])
        ids = np.zeros((len(observed), length.max(), len(observed[0][0])), np.int64)
        for i, own in enumerate(observed):
            ids[i, : len(own)] = own
        return self.emit[ids].sum(axis=2), length

    def decode(self, observed: list[list[list[int]]]) -> list[list[int]]:
        """The best label sequences (Viterbi), for all sequences at once."""
        score, length = self.scores(observed)
        best, back = score[:, 0], []
        for t in range(1, score.shape[1]):
            step = best[:, :, None] + self.move[None]
            back.append(step.argmax(axis=1))
            best = np.where((t < length)[:, None], step.max(axis=1) + score[:, t], best)
        out = []
        for i, n in enumerate(length):
            path = [int(best[i].argmax())]
            for t in range(n - 2, -1, -1):
                path.append(int(back[t][i, path[-1]]))
            out.append(path[::-1])
        return out

    def chain(self, score: np.ndarray, first: np.ndarray) -> np.ndarray:
        """The best labels (Viterbi) of sequences that follow each other, from scores (word, label).

        ``first`` marks where sequences begin. All pieces of 64 words are gone through at
        once, for each label before them; then their best sums are joined from piece to
        piece, so the labels are those of the whole sequences, whatever their length.
        """
        words, count = score.shape
        pieces = -(-words // PIECE)
        score = np.pad(score, ((0, pieces * PIECE - words), (0, 0))).reshape(pieces, PIECE, count).transpose(1, 2, 0).copy()
        inside = ~np.pad(first, (0, pieces * PIECE - words), constant_values=True).reshape(pieces, PIECE).T
        # By label before the piece, label of the word, piece.
        best = np.repeat(np.where(np.eye(count, dtype=bool), 0.0, -np.inf)[:, :, None], pieces, axis=2)
        back = np.zeros((PIECE, count, count, pieces), np.int8)
        for t in range(PIECE):
            top = best[:, 0, None] + self.move[0][:, None] * inside[t]
            for a in range(1, count):
                other = best[:, a, None] + self.move[a][:, None] * inside[t]
                back[t][other > top] = a
                top = np.maximum(top, other)
            best = top + score[t]
        total, enter = np.zeros(count), np.zeros((pieces, count), np.int8)
        for i in range(pieces):
            step = total[:, None] + best[:, :, i]
            enter[i], total = step.argmax(axis=0), step.max(axis=0)
        last, before = np.zeros(pieces, np.int8), np.zeros(pieces, np.int8)
        own = int(total.argmax())
        for i in range(pieces - 1, -1, -1):
            last[i], own = own, enter[i, own]
            before[i] = own
        out, every = np.zeros((pieces, PIECE), np.int8), np.arange(pieces)
        for t in range(PIECE - 1, -1, -1):
            out[:, t] = last
            last = back[t, before, last, every]
        return out.reshape(-1)[:words]


def train_field(table: list[tuple[list[str], list[str]]], rounds: int = 120, penalty: float = 0.02) -> ChainField:
    """Conditional likelihood by gradient ascent (Adam); expectations by forward and backward sums."""
    count = len(LABELS)
    field = ChainField(np.zeros((HASHES, count)), np.zeros((count, count)))
    observed = [_observations(words) for words, _ in table]
    truth = [[LABELS.index(x) for x in labels] for _, labels in table]
    _, length = field.scores(observed)
    rows, top = len(table), int(length.max())
    gold = np.zeros((rows, top), np.int64)
    ids = np.zeros((rows, top, len(observed[0][0])), np.int64)
    for i, own in enumerate(truth):
        gold[i, : len(own)], ids[i, : len(own)] = own, observed[i]
    live = np.arange(top)[None, :] < length[:, None]
    moments = [np.zeros_like(p) for p in (field.emit, field.emit, field.move, field.move)]

    def norm(x: np.ndarray, axis: int) -> np.ndarray:
        m = x.max(axis=axis, keepdims=True)
        return np.squeeze(m, axis) + np.log(np.exp(x - m).sum(axis=axis))

    for turn in range(1, rounds + 1):
        score = field.emit[ids].sum(axis=2)
        ahead, behind = [score[:, 0]], [np.zeros((rows, count))]
        for t in range(1, top):
            ahead.append(np.where(live[:, t, None], norm(ahead[-1][:, :, None] + field.move, 1) + score[:, t], ahead[-1]))
        for t in range(top - 2, -1, -1):
            nxt = norm(field.move[None] + (score[:, t + 1] + behind[0])[:, None, :], 2)
            behind.insert(0, np.where(live[:, t + 1, None], nxt, 0))
        total = norm(ahead[-1], 1)
        d_emit, d_move = -penalty * field.emit, -penalty * field.move
        for t in range(top):
            p = np.exp(ahead[t] + behind[t] - total[:, None])
            err = (np.eye(count)[gold[:, t]] - p) * live[:, t, None]
            np.add.at(d_emit, ids[:, t], err[:, None, :])
            if t + 1 < top:
                both = np.exp(ahead[t][:, :, None] + field.move + (score[:, t + 1] + behind[t + 1])[:, None, :]
                              - total[:, None, None]) * live[:, t + 1, None, None]
                d_move -= both.sum(axis=0)
                np.add.at(d_move, (gold[live[:, t + 1], t], gold[live[:, t + 1], t + 1]), 1)
        for p, g, m, v in ((field.emit, d_emit, moments[0], moments[1]), (field.move, d_move, moments[2], moments[3])):
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            p += 0.1 * (m / (1 - 0.9**turn)) / (np.sqrt(v / (1 - 0.99**turn)) + 1e-8)
    return field


def _valid(kind: str, found: str) -> bool:
    digits = sum(c.isdigit() for c in found)
    if kind == "crf_email":
        # Prose is full of "at"; without a digit only one in brackets is a mark.
        return "@" in found or "at" in _marks(found) or (digits > 0 and "at" in found.lower())
    if any(c.isalpha() for c in found):
        return False
    return 7 <= digits <= 15 if kind == "crf_phone" else 13 <= digits <= 19


def field_spans(texts: list[str], field: ChainField, known: WordScores | None = None) -> list[list[tuple[int, int, int]]]:
    """Per text ``start, place of the kind, end`` of what the field labels; all words of many texts are labelled at once."""
    known = known or WordScores(field.emit)
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    low = 0
    while low < len(texts):
        words, begins = [], [0]
        start = low
        while low < len(texts) and len(words) < AT_ONCE:
            words += _WORD.findall(texts[low])
            begins.append(len(words))
            low += 1
        if not words:
            continue
        first = np.zeros(len(words) + 1, bool)
        first[begins] = True
        labels = field.chain(known.scores(words, first[:-1]), first[:-1])
        hits = np.concatenate([[0], np.cumsum(labels > 0)])
        for i, begin, end in zip(range(start, low), begins, begins[1:]):
            if hits[end] == hits[begin]:
                continue
            run, path = [m.span() for m in _WORD.finditer(texts[i])], labels[begin:end].tolist()
            at = 0
            while at < len(path):
                stop = at + 1
                while stop < len(path) and path[stop] == path[at]:
                    stop += 1
                if path[at]:
                    start, end = run[at][0], run[stop - 1][1]
                    found = texts[i][start:end]
                    start += len(found) - len(found.lstrip("#*$%&|.,;:!?\"'<>"))
                    end -= len(found) - len(found.rstrip("#*$%&|.,;:!?\"'<>"))
                    if start < end and _valid(LABELS[path[at]], texts[i][start:end]):
                        out[i].append((start, len(KINDS) + FIELD.index(LABELS[path[at]]), end))
                at = stop
    return out


def pii(docs: DataFrame) -> DataFrame:
    """``doc_id, kinds, starts, ends`` for each row of ``docs``: all spans in order, in code points.

    Base kinds come from patterns with checks, leftmost and without overlap
    per kind. The field, trained on a small labelled table, adds spans of its
    own kinds where they overlap no base span: addresses and numbers in
    forms that the patterns do not know. It labels all words of each text as one sequence.

    A null or empty text has no spans; null ids and repeated rows are
    searched like others; an empty table gives an empty table; other columns are ignored.
    """
    field = docs.sparkSession.sparkContext.broadcast(train_field(labelled_table()))
    names = KINDS + FIELD

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = WordScores(field.value.emit)
        for batch in batches:
            for low in range(0, len(batch), 1000):
                part = batch.iloc[low : low + 1000]
                texts = [t or "" for t in part["text"]]
                rows = []
                for text, more in zip(texts, field_spans(texts, field.value, known)):
                    base = base_spans(text)
                    ends = [0, *np.maximum.accumulate([e for _, _, e in base]).tolist()] if base else [0]
                    starts = np.array([s for s, _, _ in base])
                    # No base span may start before its end and end after its start.
                    own = [s for s in more if ends[int(np.searchsorted(starts, s[2]))] <= s[0]] if base else more
                    rows.append(sorted(base + own))
                yield pd.DataFrame({
                    "doc_id": part["doc_id"].to_numpy(),
                    "kinds": [[names[k] for _, k, _ in own] for own in rows],
                    "starts": [[a for a, _, _ in own] for own in rows],
                    "ends": [[b for _, _, b in own] for own in rows]})

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInPandas(
        run, "doc_id long, kinds array<string>, starts array<long>, ends array<long>")
