"""Toxicity scores from a learned lexicon, matched by a Levenshtein automaton over the lexicon's trie.

Terms and stems are words and word beginnings that labelled toxic texts have and other
labelled texts lack, by a significance test. The trie of them is intersected with
Levenshtein automata (insertions, deletions, substitutions, swaps of neighbours) and made
deterministic as words need it: each worker walks all words of a batch through it, one
character at a time, and works out a move when a word first takes it. What it keeps of moves is
bounded, whatever the lexicon; the broadcast is the trie. Inexact matches are dropped when the word is known from texts that aren't toxic.
A window of words around each match decides whether it is quoted or reported, which counts
less than abuse in the text's own voice. A logistic model turns the counts into a score.

Null and empty texts have no matches and get the score of a text without any. Rows are
scored one by one, so repeated rows or null ids make no difference; an empty table gives no
rows; very long texts are read whole. A column of the output's name is replaced; all others
are kept. Of terms that tie in what they tell all are kept. Without labels of both kinds
every score is 0.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import SLICE_BYTES, slices, text_bytes
from .quality_classifier import labelled_sample

_WORD = re.compile(r"[^\W_](?:\S*[^\W_])?")
#: From here on scripts write a word in one or two signs.
WIDE = 0x2E80
#: Punctuation of those scripts.
_WIDE_SIGNS = ((0x3000, 0x3004), (0x3008, 0x3020), (0x3030, 0x3030), (0x303D, 0x303F), (0xFF01, 0xFF0F), (0xFF1A, 0xFF20), (0xFF3B, 0xFF40), (0xFF5B, 0xFF65))
_OPEN, _CLOSE, _EVEN = set("“«„‹"), set("”»‟›"), set("\"")
REPORT = frozenset("said says say called calls quote quoted quotes word words term wrote writes dit appelle sagte nannte dijo llamó".split())
TERM, STEM, NEAR = 1, 2, 3


def learn_lexicon(toxic: list[str], clean: list[str]) -> tuple[list[str], list[str]]:
    """Terms and stems whose presence tells toxic texts from clean ones beyond chance.

    A word (or beginning of 4 letters or more) counts if hardly any clean text has it
    and so many toxic ones do that chance would hardly bring that about for one of all words.
    Words under a stem are terms too, as a stem leaves less room for misspelling.
    """
    in_toxic, in_clean = Counter(), Counter()
    forms = defaultdict(set)
    for texts, found in ((toxic, in_toxic), (clean, in_clean)):
        for text in texts:
            keys = set()
            for w in {w.lower() for w in _WORD.findall(text)}:
                keys.add(w)
                for k in range(4, min(len(w), 12)):
                    keys.add(w[:k] + "*")
                    if found is in_toxic:
                        forms[w[:k] + "*"].add(w)
            found.update(keys)
    n, m = max(1, len(toxic)), max(1, len(clean))
    p = n / (n + m)
    least = max(4, math.ceil(math.log(100 * max(1, len(in_toxic))) / -math.log(p)))
    good = {w: c for w, c in in_toxic.items() if c >= least and in_clean[w] / m <= 0.02 * c / n}
    around = defaultdict(set)  # copies of one text don't count as many: a term needs as many different neighbourhoods
    for text in toxic:
        ws = [w.lower() for w in _WORD.findall(text)]
        for i, w in enumerate(ws):
            place = hash((ws[i - 1] if i else "", ws[i + 1] if i + 1 < len(ws) else ""))
            for key in [w, *(w[:k] + "*" for k in range(4, min(len(w), 12)))]:
                if key in good:
                    around[key].add(place)
    good = {w: c for w, c in good.items() if len(around[w]) >= max(least, 0.7 * c)}
    short, stems, terms = [], [], []
    for w in sorted((w for w in good if w[-1] == "*" and len(forms[w]) >= 4), key=len):
        if not any(w.startswith(s[:-1]) for s in short):
            short.append(w)
            # the longest beginning that nearly as many texts have
            longer = [x for x in good if x[-1] == "*" and len(forms[x]) >= 4 and x.startswith(w[:-1]) and good[x] >= 0.95 * good[w]]
            stems.append(max(longer, key=lambda x: (len(x), x)))
    for w in sorted((w for w in good if w[-1] != "*"), key=lambda w: (-good[w], w)):
        if len(w) >= 3 or ord(max(w)) >= WIDE:
            terms.append(w)
    return terms, [s[:-1] for s in stems]


def edits(word: str) -> int:
    """Edits allowed in a term of this length."""
    return (len(word) >= 5) + (len(word) >= 10)


def stem_edits(stem: str) -> int:
    """Edits allowed in a stem of this length; fewer, as any ending may follow."""
    return int(len(stem) >= 6)


#: Entries of the table of moves that a worker keeps.
MOVES = 1 << 24
_NONE: frozenset = frozenset()


class Automaton:
    """The intersection of the lexicon's trie with Levenshtein automata, made deterministic move by move.

    A state is a set of (node of the trie, edits so far, letter that must follow after half a swap);
    node -1 is a stem that was met. free: the first letter may be edited, and so may stems.
    """

    def __init__(self, terms: list[str], stems: list[str], free: bool = False, moves: int = MOVES) -> None:
        child: list[dict[str, int]] = [{}]
        end: list[list[tuple[int, int]]] = [[]]  # kind, edits allowed
        for kind, group in ((TERM, terms), (STEM, stems)):
            for w in group:
                at = 0
                for c in w:
                    if c not in child[at]:
                        child[at][c] = len(child)
                        child.append({})
                        end.append([])
                    at = child[at][c]
                end[at].append((kind, edits(w) if kind == TERM else free * stem_edits(w)))
        room = [0] * len(child)
        for at in range(len(child) - 1, -1, -1):
            room[at] = max([e for _, e in end[at]] + [room[k] for k in child[at].values()], default=0)
        self.child, self.end, self.room, self.free, self.moves = child, end, room, free, moves
        self.symbols = sorted({c for x in child for c in x})
        self.symbol = np.zeros(max((ord(v) for c in self.symbols for v in (c, c.upper()) if len(v) == 1), default=0) + 2, np.int32)  # the last is of all beyond
        for k, c in enumerate(self.symbols, 1):
            for v in {c, c.upper()}:
                if len(v) == 1:
                    self.symbol[ord(v)] = k
        self.forget()

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k not in ("number", "states", "table", "accept", "settled", "told")}

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state)
        self.forget()

    def forget(self) -> None:
        """Only the dead state, 0, and the start, 1, are known."""
        width = len(self.symbols) + 1
        self.number: dict[frozenset, int] = {}
        self.states: list[frozenset] = []
        self.told: dict[int, set[str]] = {}
        self.table = np.full((256, width), -1, np.int32)
        self.accept, self.settled = np.zeros(256, np.int8), np.zeros(256, bool)
        self.name(_NONE)
        self.table[0] = 0
        self.name(self.close({(0, 0, "")}))

    def name(self, states: frozenset) -> int:
        """The state's number, a new one if it is new."""
        k = self.number.get(states)
        if k is None:
            k = self.number[states] = len(self.states)
            self.states.append(states)
            if k == len(self.table):
                self.table = np.concatenate([self.table, np.full_like(self.table, -1)])
                self.accept, self.settled = (np.concatenate([x, np.zeros_like(x)]) for x in (self.accept, self.settled))
            kinds = set()
            for at, e, wait in states:
                if at < 0:
                    kinds.add(STEM if e == 0 else NEAR)
                elif not wait:
                    kinds |= {TERM if e == 0 else NEAR for kind, most in self.end[at] if kind == TERM and e <= most}
            self.accept[k] = min(kinds, default=0)
            self.settled[k] = all(at < 0 for at, _, _ in states)  # no letter changes it any more
        return k

    def close(self, states: set) -> frozenset:
        """With the states reached by leaving characters of the trie out, and stems done."""
        todo, found = list(states), set(states)
        while todo:
            s = todo.pop()
            if s[0] < 0 or s[2]:
                continue
            at, e, _ = s
            more = [(-1, e, "") for kind, most in self.end[at] if kind == STEM and e <= most]
            if at or self.free:
                more += [(k, e + 1, "") for k in self.child[at].values() if e + 1 <= self.room[k]]
            for x in more:
                if x not in found:
                    found.add(x)
                    todo.append(x)
        least: dict = {}
        for at, e, wait in found:
            least[at, wait] = min(e, least.get((at, wait), 9))
        return frozenset((at, e, wait) for (at, wait), e in least.items())

    def move(self, states: frozenset, c: str) -> frozenset:
        child, room, out = self.child, self.room, set()
        for at, e, wait in states:
            if at < 0:
                out.add((at, e, ""))
                continue
            if wait:
                if c == wait:
                    out.add((at, e, ""))
                continue
            for x, k in child[at].items():
                if x == c:
                    out.add((k, e, ""))
                elif (at or self.free) and e + 1 <= room[k]:
                    out.add((k, e + 1, ""))
                if c in child[k] and e + 1 <= room[child[k][c]] and x != c:
                    out.add((child[k][c], e + 1, x))  # a swap: x must follow
            if (at or self.free) and e + 1 <= room[at]:
                out.add((at, e + 1, ""))
        return self.close(out)

    def learn(self, state: int, symbol: int) -> None:
        """Works out a move. Letters that no next edge has all lead where the unknown one does."""
        states = self.states[state]
        if state not in self.told:
            self.told[state] = {x for at, _, wait in states if at >= 0 for x in (wait, *self.child[at], *(y for k in self.child[at].values() for y in self.child[k]))}
        if symbol and self.symbols[symbol - 1] in self.told[state]:
            to = self.name(self.move(states, self.symbols[symbol - 1]))
        else:
            if self.table[state, 0] < 0:
                to = self.name(self.move(states, "\0"))
                self.table[state, 0] = to
            to = self.table[state, 0]
        self.table[state, symbol] = to

    def step(self, live: np.ndarray, symbols: np.ndarray) -> np.ndarray:
        """The states after one more symbol of each word."""
        if len(self.states) * self.table.shape[1] > self.moves:  # of all that is known keep where the words are
            kept, back = np.unique(live, return_inverse=True)
            sets = [self.states[k] for k in kept]
            self.forget()
            live = np.array([self.name(x) for x in sets], np.int32)[back]
        to = self.table[live, symbols]
        new = to < 0
        if new.any():
            width = self.table.shape[1]
            for pair in np.unique(live[new].astype(np.int64) * width + symbols[new]):
                self.learn(int(pair // width), int(pair % width))
            to = self.table[live, symbols]
        return to

    def walk(self, chars: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """What is accepted of each word, all walked at once, a character each step."""
        sym = self.symbol[np.minimum(chars, len(self.symbol) - 1)]
        order = np.argsort(starts - ends, kind="stable")  # longest first
        s, length = starts[order], (ends - starts)[order]
        found = np.zeros(len(starts), np.int8)
        live, n, k = np.ones(len(starts), np.int32), len(starts), 0
        while n:
            more = int(np.searchsorted(-length[:n], -k, "left"))  # words of more than k characters
            found[order[more:n]] = self.accept[live[more:n]]
            live, n = live[:more], more
            if not n or k > 3 and self.settled[live].all():
                break
            live = self.step(live, sym[s[:n] + k])
            k += 1
        found[order[:n]] = self.accept[live[:n]]
        return found


def text_words(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Code points of the texts; starts, ends and texts of their words: runs without white space, stripped of other signs at both ends."""
    lead = (raw & 0xC0) != 0x80
    at = np.concatenate([[0], np.cumsum(lead)])[off]
    chars = np.frombuffer(raw.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32) if len(raw) else np.zeros(0, np.uint32)
    c = np.minimum(chars, 128)
    low = np.arange(129)
    alnum = ((low >= 48) & (low <= 57) | (low >= 65) & (low <= 90) | (low >= 97) & (low <= 122) | (low == 128))[c]
    alnum &= ~((chars >= 0x2010) & (chars <= 0x206F) | (chars == 0xAB) | (chars == 0xBB) | (chars == 0xA0))
    for first, last in _WIDE_SIGNS:
        alnum &= ~((chars >= first) & (chars <= last))
    space = np.isin(low, [9, 10, 11, 12, 13, 32])[c] | (chars == 0xA0) | (chars == 0x3000)
    if not len(chars):
        z = np.zeros(0, np.int64)
        return chars, z, z, z
    gap = np.zeros(len(chars) + 1, np.int64)
    gap[at[1:-1]] = 1  # a new text
    run = np.cumsum(space.astype(np.int64) + gap[:-1])  # constant inside a run
    where = np.flatnonzero(alnum)
    if not len(where):
        z = np.zeros(0, np.int64)
        return chars, z, z, z
    new = np.flatnonzero(np.concatenate([[True], run[where[1:]] != run[where[:-1]]]))
    starts = where[new]
    ends = where[np.concatenate([new[1:] - 1, [len(where) - 1]])] + 1
    return chars, starts, ends, np.searchsorted(at, starts, "right") - 1


def quoted(before: str, after: str) -> bool:
    """Whether a match stands between quotation marks or after a word of reporting, by its window."""
    if sum(before.count(c) for c in _EVEN) % 2 and any(c in after for c in _EVEN):
        return True
    opened = max((before.rfind(c) for c in _OPEN), default=-1)
    if opened > max((before.rfind(c) for c in _CLOSE), default=-1) and any(c in after for c in _CLOSE):
        return True
    return bool(REPORT & set(_WORD.findall(before.lower())[-3:]))


#: Characters of the window on either side of a match.
WINDOW = 80


def counts(raw: np.ndarray, off: np.ndarray, automaton: Automaton, known: frozenset) -> np.ndarray:
    """For each text: own-voice terms, own-voice stems, inexact matches, quoted matches."""
    chars, starts, ends, doc = text_words(raw, off)
    out = np.zeros((len(off) - 1, 4))
    if not len(starts):
        return out
    kind = automaton.walk(chars, starts, ends)
    lead = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])[off]
    for k in np.flatnonzero(kind):
        s, e, d = int(starts[k]), int(ends[k]), int(doc[k])
        word = chars[s:e].tobytes().decode("utf-32-le").lower()
        if kind[k] == NEAR and (word in known or e - s < 4):
            continue
        before = chars[max(int(lead[d]), s - WINDOW) : s].tobytes().decode("utf-32-le")
        after = chars[e : min(int(lead[d + 1]), e + WINDOW)].tobytes().decode("utf-32-le")
        out[d, 3 if quoted(before, after) else kind[k] - 1] += 1
    return out


def _design(x: np.ndarray) -> np.ndarray:
    return np.concatenate([np.ones((len(x), 1)), np.log1p(x)], 1)


#: Where the labels say nothing of a feature its weight stays here: bias, terms, stems, inexact matches, quoted matches.
PRIOR = np.array([-3.0, 5.0, 5.0, 9.0, 0.5])


def fit(documents: DataFrame, labels: DataFrame, per_class: int = 2500) -> tuple[Automaton, frozenset, np.ndarray] | None:
    """Learn lexicon, known words and weights from at most per_class labelled texts of each class.

    A half of the clean texts gives the known words; the weights come from the other half.
    """
    sample = labelled_sample(documents, labels, "toxic", per_class)
    toxic, clean = [t for t, y in sample if y], [t for t, y in sample if not y]
    if not toxic or not clean:
        return None
    terms, stems = learn_lexicon(toxic, clean)
    automaton = Automaton(terms, stems, free=True)
    half = len(clean) // 2
    near: set[str] = set()
    for k in range(0, half, 256):
        raw, off = text_bytes(pa.array(clean[k : min(k + 256, half)], pa.string()))
        chars, starts, ends, _ = text_words(raw, off)
        if len(starts):
            near |= {chars[s:e].tobytes().decode("utf-32-le").lower() for s, e, a in zip(starts, ends, automaton.walk(chars, starts, ends), strict=True) if a == NEAR}
    known = frozenset(near)
    texts = toxic + clean[half:]
    y = np.array([1.0] * len(toxic) + [0.0] * (len(clean) - half))
    x = []
    for k in range(0, len(texts), 256):
        raw, off = text_bytes(pa.array(texts[k : k + 256], pa.string()))
        x.append(counts(raw, off, automaton, known))
    x = _design(np.concatenate(x))
    w = PRIOR.copy()
    for _ in range(400):  # ridge towards the prior
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        hess = (x * (p * (1 - p))[:, None]).T @ x + 0.5 * np.eye(len(w))
        step = np.linalg.solve(hess, x.T @ (y - p) - 0.5 * (w - PRIOR))
        w = w + np.clip(step, -1, 1)
        if np.abs(step).max() < 1e-6:
            break
    return automaton, known, w


def score_toxicity(documents: DataFrame, model: tuple | None, text: str = "text", out: str = "score") -> DataFrame:
    """documents with a column `out`. Narrow: no shuffle; the broadcast model is bounded by fit()'s sample and the lexicon's size."""
    shared = documents.sparkSession.sparkContext.broadcast(model)
    others = [c for c in documents.columns if c != out]
    schema = T.StructType([documents.schema[c] for c in others] + [T.StructField(out, T.DoubleType())])

    def run(batches):
        found = shared.value
        for batch in batches:
            raw, off = text_bytes(batch.column(others.index(text)))
            got = [np.zeros(0)]
            for i, j in slices(off, SLICE_BYTES):
                if found is None:
                    got.append(np.zeros(j - i))
                    continue
                x = counts(raw[off[i] : off[j]], off[i : j + 1] - off[i], found[0], found[1])
                got.append(1 / (1 + np.exp(-np.clip(_design(x) @ found[2], -30, 30))))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.concatenate(got))], names=[*others, out])

    return documents.select(*others).mapInArrow(run, schema)
