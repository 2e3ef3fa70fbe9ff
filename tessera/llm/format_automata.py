"""Secret scans: fixed patterns, and probabilistic automata that are inferred from labelled credentials.

Of the credentials that the fixed patterns find, a bounded sample is the labelled strings. Each kind's strings, as
sequences of character classes, are put into a prefix tree with counts; states whose outgoing frequencies (and their
successors', recursively) are compatible under the Hoeffding bound are merged into a deterministic probabilistic
automaton (ALERGIA). Every other candidate of every text, a run of ``CANDIDATE`` or more credential characters that meets
no fixed span, whatever its letters, is scored by its log likelihood per character under the best automaton, with the
letters of a class spread as they were in the labelled strings, against how ordinary runs of the corpus spell; runs above
the threshold are spans of kind ``format``.

Scale: one pass over the texts to scan and one to train. At most ``LABELLED`` strings of each kind, none longer than
``LONGEST`` characters, reach the driver, so the automata are learnt from under 5 MB; strings of all lengths are scored.
The character pairs of all texts' ordinary runs arrive as sums, under 5,000 rows from a task.
"""

from __future__ import annotations

import hashlib
import math
import pickle
import re
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import materialise, only, smallest, table

#: The fixed patterns.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
HEX = re.compile(r"[0-9a-f]{16,}")
KINDS = ("assign", "access", "hex", "format")
#: Candidates for the automata: as long as the fixed patterns' shortest value.
CANDIDATE = 12
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
RUN = re.compile(rf"[A-Za-z0-9+/_=-]{{{CANDIDATE},}}")
#: What the background counts, outside the fixed spans.
ORDINARY = re.compile(r"[A-Za-z0-9+/_=-]{6,}")
#: At most so many labelled strings of each kind, those with the smallest hashes, of at most so many characters.
LABELLED, LONGEST = 3_000, 512
#: Confidence of the Hoeffding test; natural log odds per character above which a candidate is a secret. With 200 labelled
#: strings of one of six formats, 300 others of it were found with a recall of 1.00 (0.94 for 20 lower-case letters), and
#: at most 5 of the 27,141 other runs of the documents of sf0.1 were taken for secrets.
ALPHA, THRESHOLD = 0.05, 0.6
#: The background's letter pairs count as so many at most, so that the same run scores alike in a corpus of any size.
PAIRS = 24_000
#: Weight of a character's overall share against its share after the one before: unlabelled credentials are counted as
#: ordinary too and must not make their own rare pairs look ordinary.
DRAWN = 100
FOLDED = "abcdefghijklmnopqrstuvwxyz0123456789+/_=-"
MASK = "[secret]"

Span = tuple[int, int, str]


def base_spans(text: str) -> list[Span]:
    """(start, end, kind) of the fixed patterns, by start, then kind; each is the whole match, in code points."""
    found: list[Span] = []
    if ":" in text or "=" in text:
        found += [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 12]
    found += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text)]
    found += [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]
    return sorted(found, key=lambda s: (s[0], KINDS.index(s[2])))


def symbol(c: str) -> str:
    """Character class: digit, hexadecimal letter, other lower-case letter, capital, or the character itself."""
    if c.isdigit():
        return "9"
    return "f" if "a" <= c <= "f" else "z" if "a" <= c <= "z" else "A" if "A" <= c <= "Z" else c


class Automaton:
    """A deterministic probabilistic automaton: for each state the counts of symbols, of endings, and its successors."""

    def __init__(self, strings: Sequence[str], alpha: float = ALPHA):
        self.next: list[dict[str, int]] = [{}]
        self.count: list[dict[str, int]] = [{}]
        self.end: list[int] = [0]
        for s in strings:
            self._insert([symbol(c) for c in s])
        self._merge(alpha)
        letters: dict[str, Counter[str]] = defaultdict(Counter)
        for s in strings:
            for c in s:
                letters[symbol(c)][c] += 1
        size = {"9": 10, "f": 6, "z": 20, "A": 26}
        self.letter = {k: {c: math.log((n + 1) / (sum(v.values()) + size.get(k, 1))) for c, n in v.items()} for k, v in letters.items()}
        self.size = size
        # a symbol that a state has not seen falls back to how common it is overall
        overall = Counter(symbol(c) for s in strings for c in s)
        self.overall = {k: (n + 1) / (sum(overall.values()) + 50) for k, n in overall.items()}

    def _insert(self, symbols: list[str]) -> None:
        at = 0
        for a in symbols:
            self.count[at][a] = self.count[at].get(a, 0) + 1
            if a not in self.next[at]:
                self.next.append({})
                self.count.append({})
                self.end.append(0)
                self.next[at][a] = len(self.next) - 1
            at = self.next[at][a]
        self.end[at] += 1

    def _total(self, q: int) -> int:
        return self.end[q] + sum(self.count[q].values())

    def _compatible(self, p: int, q: int, alpha: float) -> bool:
        """Whether the states, and all pairs of their successors by the same symbols, differ by no more than chance; q is a tree's root."""
        width = math.sqrt(0.5 * math.log(2 / alpha))
        todo = [(p, q)]
        while todo:
            p, q = todo.pop()
            n, m = self._total(p), self._total(q)
            if not n or not m:
                continue
            bound = width * (1 / math.sqrt(n) + 1 / math.sqrt(m))
            if abs(self.end[p] / n - self.end[q] / m) > bound:
                return False
            for a in self.count[p].keys() | self.count[q].keys():
                if abs(self.count[p].get(a, 0) / n - self.count[q].get(a, 0) / m) > bound:
                    return False
            todo += [(x, y) for a, x in self.next[p].items() if (y := self.next[q].get(a)) is not None and x != y]
        return True

    def _fold(self, p: int, q: int) -> None:
        """Add the tree below q to state p."""
        todo = [(p, q)]
        while todo:
            p, q = todo.pop()
            self.end[p] += self.end[q]
            for a, n in self.count[q].items():
                self.count[p][a] = self.count[p].get(a, 0) + n
            for a, y in self.next[q].items():
                if a in self.next[p]:
                    todo.append((self.next[p][a], y))
                else:
                    self.next[p][a] = y

    def _merge(self, alpha: float) -> None:
        red, blue = [0], sorted(self.next[0].items())
        queue = [(0, a) for a, _ in blue]
        while queue:
            # the most visited state first; ties by place
            queue.sort(key=lambda e: (-self._total(self.next[e[0]][e[1]]), e))
            p, a = queue.pop(0)
            q = self.next[p][a]
            if q in red:
                continue
            twin = next((r for r in red if self._compatible(r, q, alpha)), None)
            if twin is None:
                red.append(q)
                queue += [(q, b) for b in sorted(self.next[q])]
            else:
                self.next[p][a] = twin
                self._fold(twin, q)
                queue = [(r, b) for r in red for b in sorted(self.next[r]) if self.next[r][b] not in red]
        self.states = red

    def score(self, s: str) -> float:
        """Log likelihood of the characters of s, and of ending after them."""
        at, total = 0, 0.0
        for c in s:
            a = symbol(c)
            n = self._total(at) if at is not None else 0
            seen = self.count[at].get(a, 0) if at is not None else 0
            total += math.log((seen + self.overall.get(a, 1e-4)) / (n + 1))
            total += self.letter.get(a, {}).get(c, -math.log(self.size.get(a, 1) + 1))
            at = self.next[at].get(a) if at is not None and seen else None
        n = self._total(at) if at is not None else 0
        return total + math.log(((self.end[at] if at is not None else 0) + 0.05) / (n + 1))


def _case(c: str) -> bool | None:
    """Whether a letter is a capital; None for other signs and the start."""
    return c.isupper() if c.isalpha() else None


def letter_pairs(runs: Iterable[str] | Counter[str]) -> Counter[str]:
    """How often each letter follows each other one, or the start (^), in the runs."""
    pairs: Counter[str] = Counter()
    for s, n in Counter(runs).items():
        for x, y in zip("^" + s, s, strict=False):
            pairs[x + y] += n
    return pairs


class Detector:
    """Automata by kind, and a background of letter pairs from ordinary runs, given as runs or as counts of pairs."""

    def __init__(self, labelled: dict[str, list[str]], ordinary: Sequence[str] | dict[str, int], threshold: float = THRESHOLD):
        self.automata = {k: Automaton(v) for k, v in labelled.items() if v}
        self.threshold = threshold
        pairs = ordinary if isinstance(ordinary, dict) else letter_pairs(ordinary)
        scale = min(1.0, PAIRS / max(sum(pairs.values()), 1))
        self.pairs = {pair: n * scale for pair, n in pairs.items()}
        letters, firsts, single, cases, case_firsts = (Counter() for _ in range(5))
        for (x, y), n in sorted(self.pairs.items()):
            letters[x.lower(), y.lower()] += n
            firsts[x.lower()] += n
            single[y.lower()] += n
            if y.isalpha():
                cases[_case(x), y.isupper()] += n
                case_firsts[_case(x)] += n
        share = {y: (single[y] + 1) / (sum(single.values()) + len(FOLDED)) for y in FOLDED}
        fold = {(x, y): math.log((letters[x, y] + DRAWN * share[y]) / (firsts[x] + DRAWN)) for x in "^" + FOLDED for y in FOLDED}
        case = {(x, y): math.log((cases[x, y] + 1) / (case_firsts[x] + 2)) for x in (None, False, True) for y in (False, True)}
        self.ordinary = {
            (x, y): fold[x.lower(), y.lower()] + (case[_case(x), y.isupper()] if y.isalpha() else 0.0) for x in "^" + ALPHABET for y in ALPHABET
        }
        self.known: dict[str, bool] = {}

    def background(self, s: str) -> float:
        """Log probability of the characters in ordinary runs: each, whatever its case, after the one before, and its case after that one's."""
        ordinary = self.ordinary
        return sum(ordinary[p] for p in zip("^" + s, s, strict=False))

    def odds(self, s: str) -> float:
        """Log odds per character of the best automaton against ordinary spelling."""
        if not self.automata:
            return -math.inf
        return (max(a.score(s) for a in self.automata.values()) - self.background(s)) / max(len(s), 1)

    def is_secret(self, s: str) -> bool:
        out = self.known.get(s)
        if out is None:
            if len(self.known) > 200_000:
                self.known.clear()
            out = self.known[s] = self.odds(s) > self.threshold
        return out

    def spans(self, text: str) -> tuple[list[Span], list[Span]]:
        """(base spans, all spans), each by start, then kind."""
        base = base_spans(text)
        more = []
        for m in RUN.finditer(text):
            a, b = m.span()
            if not any(x < b and a < y for x, y, _ in base) and self.is_secret(m[0]):
                more.append((a, b, "format"))
        return base, sorted(base + more, key=lambda s: (s[0], KINDS.index(s[2]))) if more else base


def joined(spans: Sequence[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, b, k in spans)


def redact(text: str, spans: Sequence[Span], mask: str = MASK) -> str:
    """The text with each stretch of overlapping spans replaced by a mark."""
    if not spans:
        return text
    out, at = [], 0
    for a, b, _ in spans:
        if a >= at:
            out += [text[at:a], mask]
        at = max(at, b)
    return "".join([*out, text[at:]])


def _labelled(chunks: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(kind, value, n) of credentials, and of the character pairs of ordinary runs outside them, once for each text."""

    def batch(rows: list[tuple[str, str, int]]) -> pa.RecordBatch:
        kinds, values, counts = zip(*rows, strict=True) if rows else ((), (), ())
        return pa.record_batch([pa.array(kinds, pa.string()), pa.array(values, pa.string()), pa.array(counts, pa.int64())], names=["kind", "value", "n"])

    pairs: Counter[str] = Counter()
    for whole in chunks:
        for first in range(0, whole.num_rows, 500):
            found: set[tuple[str, str]] = set()
            runs: Counter[str] = Counter()
            for t in whole.column(0).slice(first, 500):
                text = t.as_py() or ""
                spans = base_spans(text)
                for a, b, kind in spans:
                    m = ASSIGN.match(text, a) if kind == "assign" else None
                    value = m[2] if m else text[a:b]
                    if len(value) <= LONGEST:
                        found.add((kind, value))
                runs.update(set(ORDINARY.findall(redact(text, spans, " "))))
            pairs.update(letter_pairs(runs))
            yield batch([(k, v, 1) for k, v in sorted(found)])
    yield batch([("ordinary", p, n) for p, n in sorted(pairs.items())])


def train(docs: DataFrame, *, text_col: str = "text", bound: int = LABELLED) -> Detector:
    """Infer the automata from at most ``bound`` distinct labelled strings of each kind, the ones with the smallest hashes;
    the background counts the ordinary runs of every text."""
    found = only(docs, text=text_col).mapInArrow(_labelled, "kind string, value string, n long")
    found = materialise(found.groupBy("kind", "value").agg(F.sum("n").alias("n")), "labelled")
    by: dict[str, list[str]] = {}
    for kind in ("assign", "access", "hex"):
        rows = found.where(F.col("kind") == kind)
        by[kind] = sorted(r[0] for r in smallest(rows.select("value"), "value", bound).collect())
    return Detector(by, {r.value: r.n for r in found.where("kind = 'ordinary'").collect()})


def _scan(model):
    def run(chunks: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        detector: Detector = pickle.loads(model.value)
        for whole in chunks:
            for first in range(0, whole.num_rows, 500):
                batch = whole.slice(first, 500)
                rows = []
                for t in batch.column(1):
                    base, all_ = detector.spans(t.as_py() or "")
                    n = Counter(k for _, _, k in base)
                    rows.append((n["assign"], n["access"], n["hex"], hashlib.sha256(joined(base).encode()).hexdigest(), joined(all_)))
                columns = list(zip(*rows, strict=True))
                kinds = [pa.int64()] * 3 + [pa.string()] * 2
                yield pa.record_batch([batch.column(0)] + [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])

    return run


def scan(docs: DataFrame, detector: Detector, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans) of every whole text.

    Null and empty texts have no spans (the digest is that of the empty string). Repeated rows and null ids each give a
    row; an empty table gives an empty result; other columns are ignored. Without labelled strings only the fixed
    patterns find anything.
    """
    rows = only(docs, id=id_col, text=text_col)
    model = docs.sparkSession.sparkContext.broadcast(pickle.dumps(detector))
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(_scan(model), f"id {kind}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string").withColumnRenamed("id", id_col)


def redacted(docs: DataFrame, detector: Detector, *, text_col: str = "text") -> DataFrame:
    """All rows and columns, with the secrets of the text replaced by a mark; a null text stays null."""
    model = docs.sparkSession.sparkContext.broadcast(pickle.dumps(detector))
    place = docs.columns.index(text_col)

    def run(chunks: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: Detector = pickle.loads(model.value)
        for batch in chunks:
            texts = [None if t is None else redact(t, own.spans(t)[1]) for t in (x.as_py() for x in batch.column(place))]
            columns = [pa.array(texts, pa.string()) if k == place else batch.column(k) for k in range(batch.num_columns)]
            yield pa.record_batch(columns, names=batch.schema.names)

    return docs.mapInArrow(run, docs.schema)


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return scan(docs, train(docs))
