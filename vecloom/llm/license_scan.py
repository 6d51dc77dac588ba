"""License scan: base phrases, and license templates with markup compiled into token automata.

A template is its wording with two kinds of markup, in the manner of SPDX templates: ``<<beginOptional>> ... <<endOptional>>`` holds words
that may be left out (nesting is allowed), ``<<var;name="x";match=".{a,b}">>`` stands for a replaceable run of words. A run's bounds
are given in characters; it may have as many words as fit, (b + 1) // 2, and must have one if a is not 0. It compiles into an automaton over words; a
text is accepted from a word on if a path reads exactly the mandatory wording, with any choice for the marked regions.
The longest mandatory word run of a template is looked for first: automata run only on texts that have it, and start only at a template's first
words, or, where it starts with a replaceable run, within reach of the mandatory run.
"""

from __future__ import annotations

import re
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import LOWER_WORDS, batches_by_bytes, table
from .license_templates import TEMPLATES

BASE_PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}

ANY = None
MARK = re.compile(r"<<(?:(beginOptional)|(endOptional)|var;(?:[^<>]*;)?match=\"\.\{(\d+),(\d+)\}\"[^<>]*)>>")
BATCH_BYTES = 16 << 20


def words_of(text: str) -> list[bytes]:
    return text.encode().translate(LOWER_WORDS).split()


class Automaton:
    """States are numbers; step[s] is (word or ANY, next state), skip[s] the states reached without a word."""

    def __init__(self, template: str):
        self.step: list[tuple[bytes | None, int] | None] = []
        self.skip: list[list[int]] = []
        runs: list[list[bytes]] = [[]]
        before: list[int] = [0]  # words that can come before each run, at most
        here, open_at, at, most = self._state(), [], 0, 0
        for m in [*MARK.finditer(template), None]:
            plain = template[at : m.start() if m else len(template)]
            if "<<" in plain or ">>" in plain:
                raise ValueError(f"markup that isn't known: {plain}")
            for w in words_of(plain):
                here = self._word(here, w)
                if not open_at:
                    runs[-1].append(w)
                most += 1
            if m is None:
                break
            at = m.end()
            if m[1]:
                nxt = self._state()
                self.skip[here].append(nxt)
                open_at.append(here)
                here = nxt
            elif m[2]:
                if not open_at:
                    raise ValueError("an optional region ends that hasn't begun")
                nxt = self._state()
                self.skip[here].append(nxt)
                self.skip[open_at.pop()].append(nxt)
                here = nxt
            else:
                least, words = int(m[3]) > 0, (int(m[4]) + 1) // 2
                ends = [] if least else [here]
                for _ in range(words):
                    here = self._word(here, ANY)
                    ends.append(here)
                most += words
                here = self._state()
                for s in ends:
                    self.skip[s].append(here)
            runs.append([])
            before.append(most)
        if open_at:
            raise ValueError("an optional region isn't closed")
        self.final = here
        best = max(range(len(runs)), key=lambda i: sum(map(len, runs[i])))
        self.anchor, self.reach = runs[best], before[best]
        if not self.anchor:
            raise ValueError("a template needs mandatory words")
        self.phrase = b" " + b" ".join(self.anchor) + b" "
        self.trigger = max(self.anchor, key=len)
        self.first = {self.step[s][0] for s in self._closed({0}) if self.step[s]}

    def _word(self, here: int, word: bytes | None) -> int:
        nxt = self._state()
        self.step[here] = (word, nxt)
        return nxt

    def _state(self) -> int:
        self.step.append(None)
        self.skip.append([])
        return len(self.step) - 1

    def _closed(self, states: set[int]) -> set[int]:
        todo, seen = list(states), set(states)
        while todo:
            for t in self.skip[todo.pop()]:
                if t not in seen:
                    seen.add(t)
                    todo.append(t)
        return seen

    def match(self, words: list[bytes], at: int) -> int | None:
        """The end of the longest accepted text that starts at a word, or None."""
        now, end = self._closed({0}), None
        while True:
            if self.final in now:
                end = at
            if at >= len(words):
                return end
            w = words[at]
            now = self._closed({self.step[s][1] for s in now if self.step[s] and (self.step[s][0] is ANY or self.step[s][0] == w)})
            if not now:
                return end
            at += 1

    def find(self, words: list[bytes], anchors: list[int] | None = None) -> list[tuple[int, int]]:
        """Accepted spans [start, end) from left to right, none inside another: of those that start at a word the longest.

        anchors: the word numbers of the mandatory run. An accepted text holds it, at most `reach` words after its start.
        """
        if anchors is None:
            anchors = [i for i in range(len(words)) if words[i : i + len(self.anchor)] == self.anchor]
        found, at, k = [], 0, 0
        while True:
            while k < len(anchors) and anchors[k] < at:
                k += 1
            if k == len(anchors):
                return found
            at = max(at, anchors[k] - self.reach)
            end = self.match(words, at) if (ANY in self.first or words[at] in self.first) else None
            if end is not None and end > at:
                found.append((at, end))
                at = end
            else:
                at += 1


@lru_cache(maxsize=8)
def compiled(templates: tuple[tuple[str, str], ...]) -> list[tuple[str, Automaton]]:
    return [(name, Automaton(t)) for name, t in templates]


def places(joined: bytes, phrase: bytes) -> list[int]:
    """Word numbers at which a phrase stands in b' w0 w1 ... '."""
    out, p, n, counted = [], joined.find(phrase), -1, 0
    while p >= 0:
        n += joined.count(b" ", counted, p + 1)
        out.append(n)
        counted = p + 1
        p = joined.find(phrase, p + 1)
    return out


def scan(words: list[bytes], text: bytes, phrases, automata):
    """base: [(word, label)], spans: [(start, end, label)]."""
    base, spans = [], []
    if any(t in text for t, _, _ in phrases) or any(a.trigger in text for _, a in automata):
        joined = b" " + b" ".join(words) + b" "
        for _, phrase, label in phrases:
            base += [(k, label) for k in places(joined, phrase)]
        for label, a in automata:
            if a.trigger in text and (anchors := places(joined, a.phrase)):
                spans += [(s, e, label) for s, e in a.find(words, anchors)]
    return base, spans


def license_scan(docs: DataFrame, phrases: dict[str, str] | None = None, templates: dict[str, str] | None = None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, spans.

    spans: the accepted template texts as (label, start, end) in words. score: 1 with an accepted template, 0.5 with base
    phrases only, else 0. Null and empty texts have no words and no labels; repeated rows give repeated results; texts are read whole,
    in time that grows with their length. Columns other than the id and the text are not read.
    """
    phrases = BASE_PHRASES if phrases is None else phrases
    templates = TEMPLATES if templates is None else templates
    kind = docs.schema[doc_id].dataType.simpleString()
    fixed = tuple(sorted(templates.items()))
    plain = [(max(p.encode().split(), key=len), b" " + b" ".join(words_of(p)) + b" ", label) for p, label in phrases.items()]

    def run(batches):
        automata = compiled(fixed)
        for batch in batches_by_bytes(batches, 1, BATCH_BYTES):
            rows = {c: [] for c in ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans")}
            for text in batch.column(1).to_pylist():
                data = (text or "").encode().translate(LOWER_WORDS)
                words = data.split()
                base, spans = scan(words, data, plain, automata)
                labels = {x for _, x in base}
                rows["n_words"].append(len(words))
                rows["n_base"].append(len(base))
                rows["first_word"].append(min(k for k, _ in base) if base else None)
                rows["last_word"].append(max(k for k, _ in base) if base else None)
                rows["base_labels"].append(",".join(sorted(labels)))
                rows["labels"].append(",".join(sorted(labels | {x for _, _, x in spans})))
                rows["score"].append(1.0 if spans else 0.5 if base else 0.0)
                rows["spans"].append([{"label": x, "start": s, "end": e} for s, e, x in spans])
            n, s = pa.int64(), pa.string()
            span = pa.list_(pa.struct([("label", s), ("start", n), ("end", n)]))
            kinds = [n, n, n, n, s, s, pa.float64(), span]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(v, k) for v, k in zip(rows.values(), kinds))], ["doc_id", *rows])

    out = f"doc_id {kind}, n_words bigint, n_base bigint, first_word bigint, last_word bigint, base_labels string, labels string, score double, spans array<struct<label:string,start:bigint,end:bigint>>"
    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(run, out)


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(table(spark, sf_dir, "documents")).drop("spans")
