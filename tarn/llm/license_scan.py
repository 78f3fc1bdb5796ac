"""Licence scans with a generalised suffix automaton of licence words.

The automaton holds every substring of every template. A document's words are
streamed through it and give matching statistics: at each word the longest
suffix that some template contains, and on its path of suffix links the longest
that each place of each template has. Matches with a template that can't be made
longer in it are chained, template by template, in text order and template order, into covered spans of each template;
a template that is covered far enough gives its label and the span of the text's
words that covers it best. Base phrases are templates whose every place counts.

Only stretches whose word triples occur in a template are streamed; shorter
matches can't hold a phrase or be part of a chain, so nothing is lost.

A very long text is streamed through word by word; kept of it are its word
numbers and what matched. Null and empty texts have no words, no places, no labels and a score of 0.
Repeated rows and rows without a doc_id are scanned each; an empty table gives no rows;
extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame

from tarn.llm.license_texts import TEXTS
from tarn.llm.shared import map_units, pick
from tarn.llm.words import Vocabulary, runs, words_of

KIND = "alnum_lower"

#: Base phrases and their labels (fixed values).
BASE = {
    "under the mit license": "mit",
    "apache license version 2": "apache-2",
    "cc by nc": "cc-by-nc",
}

#: A template (``license_texts`` has the usual ones) of fewer than LONG words must be covered whole, a longer one by COVERED.
LONG, COVERED = 10, 0.9
#: Matches of a chain have this many words at least, and so many others between them at most.
LEAST, GAP = 3, 12


class SuffixAutomaton:
    """Every substring of every sequence; each state knows where its strings end in which sequence."""

    def __init__(self, sequences: list[list[int]]):
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        self.ends: list[set[tuple[int, int]]] = [set()]
        for k, seq in enumerate(sequences):
            last = 0
            for i, c in enumerate(seq):
                last = self._extend(last, c)
                self.ends[last].add((k, i + 1))
        for v in sorted(range(1, len(self.next)), key=self.length.__getitem__, reverse=True):
            self.ends[self.link[v]] |= self.ends[v]

    def _state(self, length: int, moves: dict[int, int], link: int) -> int:
        self.next.append(moves)
        self.length.append(length)
        self.link.append(link)
        self.ends.append(set())
        return len(self.next) - 1

    def _split(self, p: int, q: int, c: int) -> int:
        """The state of the strings of q that are p's with c, apart from q's longer ones."""
        if self.length[p] + 1 == self.length[q]:
            return q
        twin = self._state(self.length[p] + 1, dict(self.next[q]), self.link[q])
        self.link[q] = twin
        while p >= 0 and self.next[p].get(c) == q:
            self.next[p][c] = twin
            p = self.link[p]
        return twin

    def _extend(self, last: int, c: int) -> int:
        if c in self.next[last]:
            return self._split(last, self.next[last][c], c)
        new, p = self._state(self.length[last] + 1, {}, 0), last
        while p >= 0 and c not in self.next[p]:
            self.next[p][c] = new
            p = self.link[p]
        if p >= 0:
            self.link[new] = self._split(p, self.next[p][c], c)
        return new

    def stream(self, words: list[int]) -> list[tuple[int, int]]:
        """(state, length of the longest match that ends here) at each word."""
        state = length = 0
        out = []
        for c in words:
            while state and c not in self.next[state]:
                state = self.link[state]
                length = self.length[state]
            if c in self.next[state]:
                state, length = self.next[state][c], length + 1
            out.append((state, length))
        return out


class Scanner:
    """Base phrases and templates, ready to scan units of texts."""

    def __init__(self, base: dict[str, str], templates: list[tuple[str, str]]):
        texts = [*base, *(t for _, t in templates)]
        self.labels = [*base.values(), *(x for x, _ in templates)]
        w = words_of([t.encode() for t in texts], KIND)
        self.vocabulary = Vocabulary(w.hash)
        ids = self.vocabulary.ids(w.hash)
        seqs = [ids[a:b].tolist() for a, b in zip(w.bounds[:-1], w.bounds[1:])]
        self.sizes = [len(s) for s in seqs]
        if min(self.sizes) < LEAST:
            raise ValueError(f"a phrase or template has {LEAST} words at least")
        self.automaton = SuffixAutomaton(seqs)
        self.seqs = seqs
        self.places = self._places()
        self.triples = np.unique(np.concatenate([self._triples(np.array(s)) for s in seqs]))
        # base phrases that end where a state's strings end: those whose own state is on its path of suffix links
        own: dict[int, list[int]] = {}
        for k in range(len(base)):
            own.setdefault(self.automaton.stream(seqs[k])[-1][0], []).append(k)
        self.phrases: list[list[int]] = [[]] * len(self.automaton.next)
        for v in sorted(range(1, len(self.phrases)), key=self.automaton.length.__getitem__):
            self.phrases[v] = own.get(v, []) + self.phrases[self.automaton.link[v]]

    def _places(self) -> list[list[tuple[int, int, int]]]:
        """For each state the places (template, end) of its longest strings' suffixes of LEAST words or more, and at most how long a suffix is there."""
        auto = self.automaton
        out: list[list[tuple[int, int, int]]] = [[] for _ in auto.next]
        for v in sorted(range(1, len(out)), key=auto.length.__getitem__):
            up = auto.link[v]
            shorter = {(k, at): min(n, auto.length[up]) for k, at, n in out[up]} if auto.length[up] >= LEAST else {}
            out[v] = sorted((k, at, auto.length[v] if (k, at) in auto.ends[v] else n) for (k, at), n in (shorter | dict.fromkeys(auto.ends[v], 0)).items())
        return out

    def _triples(self, ids: np.ndarray) -> np.ndarray:
        n = len(self.vocabulary) + 1
        x = ids.astype(np.int64)
        return (x[:-2] * n + x[1:-1]) * n + x[2:]

    def scan(self, texts: list[bytes]) -> dict:
        w = words_of(texts, KIND)
        ids = self.vocabulary.ids(w.hash)
        n = len(texts)
        places: list[list[tuple[int, int]]] = [[] for _ in range(n)]
        matches: list[list[tuple[int, int, int, int]]] = [[] for _ in range(n)]
        first, end = runs(ids, w.bounds, LEAST)
        for a, b in self._stretches(ids, first, end):
            d = int(np.searchsorted(w.bounds, a, "right")) - 1
            at = int(a - w.bounds[d])
            own = ids[a:b].tolist()
            stats, after = self.automaton.stream(own), [*own[1:], 0]
            for i, (state, length) in enumerate(stats):
                for k in self.phrases[state]:
                    if self.sizes[k] <= length:
                        places[d].append((at + i + 1 - self.sizes[k], k))
                if length >= LEAST:
                    for k, place, most in self.places[state]:
                        if place == self.sizes[k] or self.seqs[k][place] != after[i]:
                            matches[d].append((at + i + 1, min(most, length), k, place))
        covered = [self._chain(m) for m in matches]
        base = [sorted({self.labels[k] for _, k in p}) for p in places]
        return {
            "n_words": w.counts(), "n_base": [len(p) for p in places],
            "first_word": [min(p)[0] if p else None for p in places], "last_word": [max(p)[0] if p else None for p in places],
            "base_labels": [",".join(b) for b in base],
            "labels": [",".join(sorted({*b, *(self.labels[k] for k, (c, *_) in cov.items() if self._enough(k, c))})) for b, cov in zip(base, covered)],
            "score": [max([float(bool(b)), *(c / self.sizes[k] for k, (c, *_) in cov.items())]) for b, cov in zip(base, covered)],
            "spans": [sorted({f"{x}:{y}:{self.labels[k]}" for k, (c, x, y) in cov.items() if self._enough(k, c)}) for cov in covered],
        }

    def _stretches(self, ids: np.ndarray, first: np.ndarray, end: np.ndarray):
        """Parts of the runs in which every three words stand so in a template."""
        if not len(first):
            return
        known = np.isin(self._triples(ids), self.triples)
        on = np.flatnonzero(known)
        if not len(on):
            return
        run = np.searchsorted(first, on, "right") - 1
        ok = (run >= 0) & (on + LEAST <= end[run])
        on, run = on[ok], run[ok]
        new = np.flatnonzero(np.concatenate(([True], (on[1:] != on[:-1] + 1) | (run[1:] != run[:-1])))) if len(on) else on
        for a, b in zip(new, [*new[1:], len(on)]):
            yield int(on[a]), int(on[b - 1]) + LEAST

    def _enough(self, k: int, covered: int) -> bool:
        return covered == self.sizes[k] if self.sizes[k] < LONG else covered >= COVERED * self.sizes[k]

    def _chain(self, matches: list[tuple[int, int, int, int]]) -> dict[int, tuple[int, int, int]]:
        """Template -> most of its words that a chain of matches covers, the chain's first word and end, the first such. Only matches that end within GAP words before can be followed."""
        best: dict[int, tuple[int, int, int]] = {}
        recent: dict[int, list[tuple[int, int, int, int]]] = {}  # template -> (text end, template end, covered, text start)
        for end, length, k, at in matches:
            recent[k] = [x for x in recent.get(k, []) if x[0] + GAP + self.sizes[k] >= end]  # no match is longer than its template
            got, start = length, end - length
            for text_end, template_end, had, began in recent[k]:
                overlap = max(0, text_end - (end - length), template_end - (at - length))
                near = text_end + GAP >= end - length
                if near and text_end < end and template_end < at and overlap < length and had + length - overlap > got:
                    got, start = had + length - overlap, began
            recent[k].append((end, at, got, start))
            if got > best.get(k, (0,))[0]:
                best[k] = (got, start, end)
        return best


_SCANNERS: dict = {}


def _scanner(base: tuple, templates: tuple) -> Scanner:
    if (base, templates) not in _SCANNERS:
        _SCANNERS[base, templates] = Scanner(dict(base), list(templates))
    return _SCANNERS[base, templates]


def license_scan(docs: DataFrame, base: dict[str, str] | None = None, templates: list[tuple[str, str]] | None = None) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score and spans ("first:end:label" of the words that cover a template) of every document."""
    known = tuple((BASE if base is None else base).items()), tuple(TEXTS if templates is None else templates)

    def work(rest, texts):
        return {"doc_id": rest["doc_id"]} | _scanner(*known).scan(texts)

    return map_units(pick(docs, "doc_id", "text"), "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans array<string>", work)
