"""Language-model scores by a probabilistic suffix tree over words, whose unseen words are spelled by one over bytes.

A text is its words and one end. A state of the tree is a context of up to ``DEPTH`` symbols before the next one (the
start of a text counts as one), and every word of the corpus is a state. The test for keeping a context is its divergence
from the context without its first symbol: two of its next symbols, drawn at random, have to agree oftener than two of the
shorter context's do, by more than ``DEVIATIONS`` standard deviations of such a count (a test of the Renyi divergence of
order two). It needs no more of a context than how often it occurs and how many pairs of its next symbols agree, so that
contexts that occur twice are tested like those that occur a million times; no threshold grows with the corpus.

The next symbol is drawn in the longest kept state that is a suffix of what came before. Its distribution is its counts
and ``weight`` pseudo-counts of the next shorter kept state's. The empty state draws known words by their shares and leaves
the Good-Turing estimate of unseen mass, the share that occurs once, to other words, as a tree over bytes spells them. All
distributions sum to one.

The tree over bytes has contexts of up to ``SPELLING`` bytes within the word (its start counts as one), learnt from the
distinct words, as unseen words resemble rare ones. A context is kept if its distribution diverges from that of the
context without its first byte by more than the extra parameters are worth (likelihood ratio against a BIC penalty), or if
a longer kept one ends in it; distributions are interpolated with the shorter context's (Witten-Bell).

Scale: texts are cut into chunks of tokens, kept as numbers in the scratch folder. A chunk sends its distinct words and
pairs of symbols with their counts, as sorted arrays by ranges of their hash, and gets the corpus's counts back; then the
same with the agreeing pairs of one-symbol contexts and with the runs that follow two-symbol contexts, of those that occur
twice. A word, run or context that a third of the corpus holds is so one number from a chunk, and the runs of a context
that occurs more than ``HOT`` times are dealt to several tasks. Texts are never exchanged; every word, run and context
counts, however large the corpus. The shuffle files of a round go when its sums are written, so that the disk holds those of one
round at a time. Only the byte tree is broadcast; pairs below a share of all bytes are not in it,
so it has at most (SPELLING + 1) / PAIR_SHARE entries.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import discard, materialise, only, remainder5, table

#: Symbols of the longest context; standard deviations by which a kept context differs.
DEPTH, DEVIATIONS = 2, 2.0
#: Bytes of the longest context of the spelling; pairs and contexts below these shares of all bytes are not in its tree.
SPELLING, PAIR_SHARE, CONTEXT_SHARE = 5, 5e-6, 5e-5
#: Tokens of a chunk, unless one text has more; hashes that one task counts; occurrences of a context that one task counts.
CHUNK, RANGE, HOT = 5 << 17, 1_000_000, 1 << 20
#: Bits of the hash of the symbol after a two-symbol context.
NEXT = 18
#: Hashes of the start and the end of a text, which no word has but by chance.
START, END = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def words_of(text: str | None) -> list[bytes]:
    """The words, A-Z lower-cased."""
    return (text or "").encode().lower().split()


def weight(n):
    """Pseudo-counts of the shorter context in one that occurs n times."""
    return 4.0 * n**0.75


def kept(n, agreeing, share):
    """Whether contexts that occur n times, with so many agreeing pairs, diverge from those whose pairs agree by ``share``."""
    n = np.asarray(n, dtype=np.float64)
    expected = n * (n - 1) / 2 * share
    return (n >= 2) & (agreeing > expected + DEVIATIONS * np.sqrt(expected))


def _pairs_of(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Codes of (context, next symbol) in distinct words, with their counts. A code's bytes: depth, context (right-aligned), next."""
    lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 2
    buffer = np.frombuffer(b"".join([b"\n" + w + b" " for w in words]), dtype=np.uint8).astype(np.uint64)
    ends = np.cumsum(lengths)
    place = np.arange(len(buffer)) - np.repeat(ends - lengths, lengths)
    found = []
    for depth in range(SPELLING + 1):
        code = buffer.copy()
        for back in range(1, depth + 1):
            code[back:] |= buffer[:-back] << np.uint64(8 * back)
        keep = place >= max(1, depth)
        found.append(code[keep] | np.uint64(depth << 56))
    return np.unique(np.concatenate(found), return_counts=True)


class SuffixTree:
    """States by context; each has the log10 probabilities of its own symbols and the log10 weight left to the rest."""

    def __init__(self, pairs: dict[bytes, dict[int, float]], total: float, *, context_share: float = CONTEXT_SHARE):
        flat = 1 / 256
        probs: dict[bytes, tuple[dict[int, float], float]] = {}

        def prob(context: bytes, symbol: int) -> float:
            weight = 1.0
            while True:
                own, left = probs[context]
                if symbol in own:
                    return weight * own[symbol]
                weight *= left
                if not context:
                    return weight * flat
                context = context[1:]

        gain: dict[bytes, bool] = {}
        penalty = 0.5 * np.log(max(total, 2))
        pairs = pairs if b"" in pairs else {b"": {}} | pairs
        for context in sorted(pairs, key=len):
            nexts = pairs[context]
            count, kinds = sum(nexts.values()), len(nexts)
            if context and (count < context_share * total or context[1:] not in probs):
                continue
            below = {a: prob(context[1:], a) if context else flat for a in nexts}
            own = {a: (n + kinds * below[a]) / (count + kinds) for a, n in nexts.items()}
            probs[context] = (own, kinds / (count + kinds) if count else 1.0)
            gain[context] = sum(n * np.log(own[a] / below[a]) for a, n in nexts.items()) > penalty * kinds
        keep = {b""}
        for context in sorted(probs, key=len, reverse=True):
            if gain[context] or context in keep:
                keep |= {context, context[1:]}
        # a symbol that a state has not seen: the left-over weight times its probability in the next shorter state
        self.states = {
            c: ({a: float(np.log10(p)) for a, p in probs[c][0].items()}, float(np.log10(probs[c][1]))) for c in keep
        }
        self.flat = float(np.log10(flat))
        self.seen: dict[bytes, float] = {}

    def symbol(self, context: bytes, symbol: int) -> float:
        """log10 probability of a symbol in the longest state that is a suffix of the context."""
        states, weight = self.states, 0.0
        while True:
            state = states.get(context)
            if state is not None:
                p = state[0].get(symbol)
                if p is not None:
                    return weight + p
                weight += state[1]
                if not context:
                    return weight + self.flat
            context = context[1:]

    def word(self, word: bytes) -> float:
        """log10 probability of the spelling, the mark at its end included."""
        marked, seen = b"\n" + word + b" ", self.seen
        keys = [marked[k] for k in _windows(len(marked))]
        found = list(map(seen.get, keys))
        if None in found:
            if len(seen) > 200_000:
                seen.clear()
            for i, (k, p) in enumerate(zip(keys, found, strict=True)):
                if p is None:
                    found[i] = seen[k] = self.symbol(k[:-1], k[-1])
        return sum(found)


@lru_cache(4096)
def _windows(size: int) -> tuple[slice, ...]:
    """Each symbol of a marked word after the first, with the context before it."""
    return tuple(slice(max(0, i - SPELLING), i + 1) for i in range(1, size))


def grow(pairs: DataFrame, total: float) -> SuffixTree:
    """The tree of the byte pairs (code, n) of distinct words; ``total`` is the number of bytes in them."""
    common = pairs.select("code", "n").where(F.col("n") >= F.lit(PAIR_SHARE * total)).toPandas()  # at most (SPELLING + 1) / PAIR_SHARE rows
    by: dict[bytes, dict[int, float]] = {}
    for code, n in zip(common["code"].astype("int64").to_numpy().view(np.uint64).tolist(), common["n"].tolist(), strict=True):
        raw = code.to_bytes(8, "big")
        by.setdefault(raw[7 - raw[0] : 7], {})[raw[7]] = float(n)
    return SuffixTree(by, total)


def _mix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hashes of runs, from the hashes of all symbols but the last and of the last."""
    x = (a ^ (a >> np.uint64(31))) * np.uint64(0x9FB21C651E98DF25) + b
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


_ZSTD, _DENSE = pa.Codec("zstd", compression_level=1), pa.Codec("zstd", compression_level=6)


def squeeze(raw: bytes, codec: pa.Codec = _ZSTD) -> bytes:
    return len(raw).to_bytes(4, "little") + codec.compress(raw, asbytes=True)


def expand(raw: bytes | None) -> bytes:
    return _ZSTD.decompress(raw[4:], int.from_bytes(raw[:4], "little"), asbytes=True) if raw else b""


def _planes(values: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(values.view(np.uint8).reshape(len(values), -1).T)


def _from_planes(raw: bytes, kind: str) -> np.ndarray:
    if not raw:
        return np.zeros(0, dtype=kind)
    return np.ascontiguousarray(np.frombuffer(raw, dtype=np.uint8).reshape(np.dtype(kind).itemsize, -1).T).view(kind).reshape(-1)


def pack(values: np.ndarray) -> bytes:
    """An array as compressed planes of its bytes."""
    return squeeze(_planes(values).tobytes()) if len(values) else b""


def unpack(raw: bytes | None, kind: str) -> np.ndarray:
    return _from_planes(expand(raw), kind)


def pack_ranks(ranks: np.ndarray) -> bytes:
    """Numbers by frequency in one to three bytes, each byte a stream of its own."""
    if len(ranks) and ranks.max() >= 16_544 + (1 << 21):
        return b"\x00" + pack(ranks)
    small, mid = ranks < 160, (ranks >= 160) & (ranks < 16_544)
    large = ~(small | mid)
    q, r = ranks - np.uint32(160), ranks - np.uint32(16_544)
    first = np.where(small, ranks, np.where(mid, 160 + (q >> 8), 224 + (r >> 16))).astype(np.uint8)
    second = np.where(mid, q, r >> 8)[~small].astype(np.uint8)
    streams = [squeeze(x.tobytes()) for x in (first, second, r[large].astype(np.uint8))]
    return b"\x01" + b"".join(len(x).to_bytes(4, "little") + x for x in streams)


def unpack_ranks(raw: bytes) -> np.ndarray:
    if raw[0] == 0:
        return unpack(raw[1:], "u4")
    streams, at = [], 1
    for _ in range(3):
        end = at + 4 + int.from_bytes(raw[at : at + 4], "little")
        streams.append(np.frombuffer(expand(raw[at + 4 : end]), dtype=np.uint8).astype(np.uint32))
        at = end
    first, second, third = streams
    out = first.copy()
    out[first >= 160] = ((first[first >= 160] - 160) << 8) + second + 160
    large = first >= 224
    out[large] = ((first[large] - 224) << 16) + (second[first[first >= 160] >= 224] << 8) + third + 16_544
    return out


def pack_sorted(keys: np.ndarray) -> bytes:
    """Sorted hashes as differences: the two low planes, which are noise, as they are, the others compressed."""
    planes = _planes(np.diff(keys, prepend=np.uint64(0)))
    return planes[:2].tobytes() + squeeze(planes[2:].tobytes())


def unpack_sorted(raw: bytes, n: int) -> np.ndarray:
    return np.cumsum(_from_planes(raw[: 2 * n] + expand(raw[2 * n :]), "u8"), dtype=np.uint64)


def distinct(keys: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(sorted distinct keys of so many bits, the place of each key among them)."""
    n = len(keys)
    bits = max(n - 1, 1).bit_length()
    if width + bits > 64:
        return np.unique(keys, return_inverse=True)
    both = np.sort((keys << np.uint64(bits)) | np.arange(n, dtype=np.uint64))  # sorting is much faster than finding an order
    place = (both & np.uint64((1 << bits) - 1)).astype(np.int64)
    both >>= np.uint64(bits)
    new = np.ones(n, dtype=bool)
    new[1:] = both[1:] != both[:-1]
    inverse = np.empty(n, dtype=np.int64)
    inverse[place] = np.cumsum(new) - 1
    return both[new], inverse


#: A chunk, or what it asks, or what it is told. part 0: a chunk; 1: words; 2: pairs; 3: one-symbol contexts; 4: part of the
#: vocabulary; 5: ends; 6: runs of three.
_FIELDS = (("chunk", pa.int64()), ("part", pa.int32()), ("range", pa.int32()), ("keys", pa.binary()), ("values", pa.binary()), ("words", pa.binary()), ("n", pa.int64()))
_SCHEMA = "chunk long, part int, range int, keys binary, values binary, words binary, n long"


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.record_batch([pa.array(c, t) for c, (_, t) in zip(zip(*rows, strict=True), _FIELDS, strict=True)], names=[f for f, _ in _FIELDS])


def _by_rank(often: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words' numbers, the commonest first, and the place of each number in that order."""
    order = np.argsort(-often.astype(np.int64), kind="stable")
    rank = np.empty(len(order), dtype=np.uint32)
    rank[order] = np.arange(len(order), dtype=np.uint32)
    return order, rank


def _chunks(chunks: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (id, held_out, text) as chunks: words has the chunk's distinct words in order (the first, empty, is the end), values
    the tokens as numbers of these, keys the texts' lengths, negative ones of held-out texts; ids come along."""
    from pyspark import TaskContext

    place = TaskContext.get().partitionId() << 33
    index: dict[bytes, int] = defaultdict()
    index.default_factory = index.__len__
    tokens: list[np.ndarray] = []
    sizes: list[int] = []
    ids: list = []
    count = 0

    def out(kind: pa.DataType) -> pa.RecordBatch:
        nonlocal place, count
        words = sorted(index)
        rank = np.empty(len(words), dtype=np.uint32)
        rank[np.fromiter(map(index.__getitem__, words), dtype=np.int64, count=len(words))] = np.arange(len(words), dtype=np.uint32)
        numbers = rank[np.concatenate(tokens)]
        often = np.bincount(numbers).astype(np.uint32)
        lengths = pack(np.concatenate([np.array([len(sizes), *sizes], dtype=np.int64), often]))  # how often each word occurs says its rank
        row = (place, 0, 0, lengths, pack_ranks(_by_rank(often)[1][numbers]), squeeze(b"\n".join(words), _DENSE), count)
        batch = _batch([row]).append_column("ids", pa.array([list(ids)], pa.list_(kind)))
        for held in (index, tokens, sizes, ids):
            held.clear()
        place, count = place + 1, 0
        return batch

    kind = None
    for batch in chunks:
        kind = batch.schema.field(0).type
        for id_, held_out, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
            words = words_of(text.as_py())
            words.append(b"")
            tokens.append(np.fromiter(map(index.__getitem__, words), dtype=np.uint32, count=len(words)))
            ids.append(id_)
            sizes.append(-len(words) if held_out else len(words))
            count += len(words)
            if count >= CHUNK:
                yield out(kind)
    if sizes:
        yield out(kind)


@dataclass(frozen=True)
class _Deal:
    """Bits of the hash of a pair and of a two-symbol context; ranges of words, pairs, one-symbol contexts and runs; HOT."""

    width: int
    context: int
    words: int
    pairs: int
    contexts: int
    runs: int
    hot: int

    @classmethod
    def of(cls, tokens: int) -> _Deal:
        """So wide that a pair meets another one's hash with a probability of 1 / 1024, or less in small corpora."""
        power = lambda x: 1 << max(0, math.ceil(math.log2(max(x, 1) / RANGE)))
        bits = math.ceil(math.log2(tokens + 1)) + 10
        return cls(min(64, max(40, bits)), min(64 - NEXT, max(38, bits)), power(tokens / 4), power(tokens), power(tokens / 4), power(tokens), HOT)


class _Chunk:
    """The symbols of one chunk, the contexts before each position, and the pairs that end with it."""

    def __init__(self, row: dict, deal: _Deal):
        self.number, self.deal = row["chunk"], deal
        figures = unpack(row["keys"], "i8")
        signed, often = figures[1 : figures[0] + 1], figures[figures[0] + 1 :]
        self.held, self.sizes = signed < 0, np.abs(signed)
        self.tokens = _by_rank(often)[0].astype(np.uint32)[unpack_ranks(row["values"])]
        self.words = expand(row["words"]).split(b"\n")
        self.learnt = np.repeat(~self.held, self.sizes)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.hashes = np.fromiter(map(xxhash.xxh64_intdigest, self.words), dtype=np.uint64, count=len(self.words))
        self.hashes[0] = END
        symbols = self.hashes[self.tokens]
        before = np.concatenate([[START], symbols[:-1]])
        before[self.starts] = START
        pair = _mix(before, symbols)
        self.context1 = before >> np.uint64(64 - deal.width)
        self.context2 = np.concatenate([[START], pair[:-1]])  # of a text's first symbol: none
        self.next = (symbols * np.uint64(0x9FB21C651E98DF25)) >> np.uint64(64 - NEXT)
        del symbols, before
        self.pairs, at = distinct(pair >> np.uint64(64 - deal.width), deal.width)
        self.at = at.astype(np.uint32)

    def _word_ranges(self) -> Iterator[tuple[int, np.ndarray]]:
        """(range, numbers of the words) by the hash of the words."""
        bits = self.deal.words.bit_length() - 1
        at = (self.hashes >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(self.hashes), dtype=np.int64)
        yield from _runs_of(at)

    def ask(self) -> Iterator[tuple]:
        learnt = np.bincount(self.tokens[self.learnt], minlength=len(self.words)).astype(np.uint32)
        for k, part in self._word_ranges():
            yield self.number, 1, k, None, pack(learnt[part]), squeeze(b"\n".join([self.words[i] for i in part.tolist()]), _DENSE), len(part)
        counts = np.bincount(self.at[self.learnt], minlength=len(self.pairs)).astype(np.uint32)
        for k, a, b in _ranges(self.pairs, self.deal.width, self.deal.pairs):
            yield self.number, 2, k, pack_sorted(self.pairs[a:b]), pack(counts[a:b]), None, b - a

    def told(self, rows: list[dict]) -> None:
        """Counts in the corpus: of the chunk's words, of each position's pair, and of the contexts before it."""
        rows = sorted(rows, key=lambda r: r["range"])
        self.word_counts = np.zeros(len(self.words), dtype=np.int64)
        self.word_counts[np.concatenate([p for _, p in self._word_ranges()])] = _joined(rows, 1)
        self.count2 = _joined(rows, 2)[self.at]
        self.total1 = np.concatenate([[0], self.word_counts[self.tokens[:-1]]])  # how often the symbol before occurs
        self.total1[self.starts] = -1  # the start: as often as there are texts
        self.total2 = np.concatenate([[0], self.count2[:-1]])
        self.total2[self.starts] = 0
        use = (self.total1 > 1) | (self.total1 < 0)
        self.keys1, inverse = distinct(self.context1[use], self.deal.width)
        self.at1 = np.full(len(self.tokens), len(self.keys1), dtype=np.uint32)
        self.at1[use] = inverse
        del self.at, self.context1, use, inverse
        # runs of three, where they are not known: in a learnt text, what follows a context that occurs twice is no run that
        # occurs twice if even its last two symbols occur once
        self.open = (self.total2 > 1) & ~(self.learnt & (self.total2 == 2) & (self.count2 == 1))
        self._runs()

    def _runs(self) -> None:
        """The distinct runs of three that are asked for, with what is added of hot contexts, by range and key."""
        deal, short = self.deal, np.uint64(NEXT)
        keys = ((self.context2[self.open] >> np.uint64(64 - deal.context)) << short) | self.next[self.open]
        del self.context2, self.next
        found, first, self.at3 = np.unique(keys, return_index=True, return_inverse=True)
        often = self.total2[self.open][first]
        hot = np.nonzero(often > deal.hot)[0]
        if len(hot):  # a run for each part of a hot context, which tells the part's agreeing pairs
            parts = -(-often[hot] // deal.hot)
            which, at = np.unique(found[hot] >> short, return_index=True)
            marks = np.concatenate([(c << short) | np.arange(n, dtype=np.uint64) for c, n in zip(which, parts[at].tolist(), strict=True)])
            often = np.concatenate([often, np.repeat(often[hot][at], parts[at])])
            found, place, again = np.unique(np.concatenate([found, marks]), return_index=True, return_inverse=True)
            self.at3, often = again[self.at3], often[place]
        context, parts = found >> short, np.maximum(-(-often // deal.hot), 1).astype(np.uint64)
        dealt = np.where(parts > 1, _mix(context, (found & ((np.uint64(1) << short) - np.uint64(1))) % parts) >> np.uint64(64 - deal.context), context)
        bits = deal.runs.bit_length() - 1
        self.runs, self.run_ranges = found, list(_runs_of((dealt >> np.uint64(deal.context - bits)).astype(np.int64)))

    def ask_more(self) -> Iterator[tuple]:
        pairs = np.zeros(len(self.keys1) + 1)
        use = self.learnt & (self.count2 > 1)
        pairs += np.bincount(self.at1[use], weights=self.count2[use] - 1, minlength=len(pairs))
        agreeing = pairs[:-1].astype(np.int64)  # over all occurrences of a pair n - 1 for each: n (n - 1), both ways round
        for k, a, b in _ranges(self.keys1, self.deal.width, self.deal.contexts):
            yield self.number, 3, k, pack_sorted(self.keys1[a:b]), pack(agreeing[a:b]), None, b - a
        counts = np.bincount(self.at3[self.learnt[self.open]], minlength=len(self.runs)).astype(np.uint32)
        for k, part in self.run_ranges:
            yield self.number, 6, k, pack_sorted(self.runs[part]), pack(counts[part]), None, len(part)

    def told_more(self, rows: list[dict]) -> None:
        """Of each position: count of the run of three, agreeing pairs of the one-symbol and of the two-symbol context."""
        rows = sorted(rows, key=lambda r: r["range"])
        self.agreeing1 = np.append(_joined(rows, 3), 0)[self.at1]
        self.count3, self.agreeing2 = self.learnt.astype(np.int64), np.zeros(len(self.tokens), dtype=np.int64)
        if len(self.runs):
            order = np.concatenate([p for _, p in self.run_ranges])
            counts = np.empty(len(self.runs), dtype=np.int64)
            counts[order] = _joined(rows, 6)
            contexts, inverse = np.unique(self.runs >> np.uint64(NEXT), return_inverse=True)
            agreeing = np.zeros(len(contexts), dtype=np.int64)
            for (_, part), row in zip(self.run_ranges, [r for r in rows if r["part"] == 6], strict=True):
                at = inverse[part]
                np.add.at(agreeing, at[np.append(True, at[1:] != at[:-1])], unpack(row["keys"], "i8"))
            self.count3[self.open] = counts[self.at3]
            self.agreeing2[self.open] = agreeing[inverse[self.at3]]


def _joined(rows: list[dict], part: int) -> np.ndarray:
    return np.concatenate([np.zeros(0, np.int64)] + [unpack(r["values"], "i8") for r in rows if r["part"] == part])


def _runs_of(at: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(value, places) of each value, in order of value and place."""
    if len(at):
        order = np.argsort(at, kind="stable")
        for part in np.split(order, np.nonzero(np.diff(at[order]))[0] + 1):
            yield int(at[part[0]]), part


def _ranges(keys: np.ndarray, width: int, ranges: int) -> Iterator[tuple[int, int, int]]:
    """(range, first, end) of sorted keys for each of so many equal ranges of the hash that holds any; a power of two."""
    bits = ranges.bit_length() - 1
    edges = [0, *np.searchsorted(keys, np.arange(1, ranges, dtype=np.uint64) << np.uint64(width - bits)).tolist(), len(keys)]
    for k, (a, b) in enumerate(zip(edges, edges[1:], strict=False)):
        if a < b:
            yield k, a, b


def _grouped(chunks: Iterator[pa.RecordBatch], *names: str) -> Iterator[list[dict]]:
    """The rows of each value of the named columns; rows are sorted by them."""
    last, rows = None, []
    for batch in chunks:
        for row in batch.to_pylist():
            key = tuple(row[n] for n in names)
            if key != last and rows:
                yield rows
                rows = []
            last = key
            rows.append(row)
    if rows:
        yield rows


def _ask(deal: _Deal):
    def run(chunks: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (row,) in _grouped(chunks, "chunk"):
            yield _batch(list(_Chunk(row, deal).ask()))

    return run


def _sum(deal: _Deal):
    """The corpus's sums, told to each chunk that asks; of words also the vocabulary, of runs also their contexts' agreeing pairs."""

    def run(chunks: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _grouped(chunks, "part", "range"):
            place, part = rows[0]["range"], rows[0]["part"]
            if part == 1:
                index: dict[bytes, int] = defaultdict()
                index.default_factory = index.__len__
                at = [np.fromiter(map(index.__getitem__, expand(r["words"]).split(b"\n")), dtype=np.int64, count=r["n"]) for r in rows]
                inverse, n = np.concatenate(at), len(index)
            else:
                keys, inverse = distinct(np.concatenate([unpack_sorted(r["keys"], r["n"]) for r in rows]), 64 if part == 6 else deal.width)
                n = len(keys)
            kind = "i8" if part == 3 else "u4"
            sums = np.bincount(inverse, weights=np.concatenate([unpack(r["values"], kind) for r in rows]), minlength=n).astype(np.int64)
            if part == 6:
                contexts, of = np.unique(keys >> np.uint64(NEXT), return_inverse=True)
                agreeing = np.bincount(of, weights=sums.astype(float) * (sums - 1), minlength=len(contexts)).astype(np.int64)
            out, end = [], 0
            for r in rows:
                at, end = inverse[end : end + r["n"]], end + r["n"]
                more = None
                if part == 6:
                    said = of[at]
                    more = pack(agreeing[said[np.append(True, said[1:] != said[:-1])]])
                out.append((r["chunk"], part, place, more, pack(sums[at]), None, r["n"]))
            if part == 1:
                words = list(index)
                known = [i for i in np.nonzero(sums)[0].tolist() if words[i]]
                out.append((-1, 4, place, None, pack(sums[known]), squeeze(b"\n".join([words[i] for i in known])), len(known)))
                if b"" in index:
                    out.append((-1, 5, place, None, None, None, int(sums[index[b""]])))
            for k in range(0, len(out), 64):
                yield _batch(out[k : k + 64])

    return run


def _vocabulary(chunks: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(words, types, once, pairs, symbols) of parts of the vocabulary, and the byte pairs (code, n) of their words."""
    for batch in chunks:
        for row in batch.to_pylist():
            counts, words = unpack(row["values"], "i8"), expand(row["words"]).split(b"\n") if row["n"] else []
            figures = [float(counts.sum()), len(counts), int((counts == 1).sum()), float((counts.astype(float) * (counts - 1)).sum()), sum(map(len, words)) + len(words)]
            codes, n = _pairs_of(words) if words else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
            yield pa.record_batch(
                [pa.array([None] * 5 + codes.view(np.int64).tolist(), pa.int64()), pa.array(list(range(5)) + [None] * len(codes), pa.int32()), pa.array(figures + n.tolist(), pa.float64())],
                names=["code", "figure", "n"],
            )


def _spelled(model):
    def run(chunks: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks:
            mass = [sum(10 ** model.value.word(w) for w in expand(row["words"]).split(b"\n")) if row["n"] else 0.0 for row in batch.to_pylist()]
            yield pa.record_batch([pa.array(mass, pa.float64())], names=["mass"])

    return run


def _ask_more(deal: _Deal):
    def run(chunks: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _grouped(chunks, "chunk"):
            chunk = _Chunk(rows[0], deal)
            chunk.told(rows[1:])
            if out := list(chunk.ask_more()):
                yield _batch(out)

    return run


def _score(model, figures: dict[str, float], deal: _Deal, kind: pa.DataType):
    def run(chunks: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree: SuffixTree = model.value
        ends, words, types, once, all_pairs, mass = (figures[k] for k in ("ends", "words", "types", "once", "pairs", "mass"))
        n, v = ends + words, types + (ends > 0)
        unseen = (once + 0.5) / (words + 1)
        share0 = all_pairs / max(n * (n - 1), 1)
        for rows in _grouped(chunks, "chunk"):
            chunk = _Chunk(rows[0], deal)
            chunk.told([r for r in rows[1:] if r["part"] < 3])
            chunk.told_more([r for r in rows[1:] if r["part"] >= 3])
            counts = chunk.word_counts
            base = np.log10((counts + 0.5) / (n + 0.5 * (v + 1)))
            # the empty state, by the chunk's numbers
            empty = (1 - unseen) * counts / max(words, 1)
            for i in np.nonzero(counts[1:] == 0)[0].tolist():
                empty[i + 1] = unseen * 10.0 ** max(tree.word(chunk.words[i + 1]), -300.0) / max(1 - mass, 1e-3)
            empty *= (words + 0.5) / (n + 1)
            empty[0] = (ends + 0.5) / (n + 1)
            p = empty[chunk.tokens]
            chunk.total1[chunk.total1 < 0] = int(ends)
            share = share0
            for total, count, pairs in ((chunk.total1, chunk.count2, chunk.agreeing1), (chunk.total2, chunk.count3, chunk.agreeing2)):
                use = kept(total, pairs / 2, share)
                m = weight(total[use].astype(float))
                p[use] = (count[use] + m * p[use]) / (total[use] + m)
                of = total.astype(float)
                share = np.where(total >= 2, np.maximum(share0, pairs / np.maximum(of * (of - 1), 1)), share0)
            sums = lambda x: np.add.reduceat(x, chunk.starts)
            yield pa.record_batch(
                [
                    pa.array(rows[0]["ids"], kind), pa.array(chunk.held), pa.array(chunk.sizes), pa.array(sums((counts > 0).astype(np.int64)[chunk.tokens])),
                    pa.array(np.full(len(chunk.sizes), int(n))), pa.array(sums(base[chunk.tokens])), pa.array(sums(np.log10(p))),
                ],
                names=["id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
            )

    return run


def _together(*tables: DataFrame) -> DataFrame:
    """The chunks' rows and what they were told, by chunk."""
    rows = tables[0]
    for t in tables[1:]:
        rows = rows.unionByName(t.where("chunk >= 0"), allowMissingColumns=True)
    return rows.repartition("chunk").sortWithinPartitions("chunk", "part", "range")


def score_texts(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Scores of all whole texts by a model that is learnt from those whose crc32(id) mod 5 is not 1.

    Returns (doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score), one row for each row of ``docs``,
    repeated ones too. A null text counts as empty (its one token is the end), a null id as the empty text in crc32. With
    nothing to learn from, N = V = 0: the base is then log10(1) = 0 for each token, and the model spells with uniform
    bytes. An empty table gives an empty result; other columns are ignored. The model's probability of an unseen word is
    that of its spelling; the base gives each the same, and so does not sum to one.
    """
    spark = docs.sparkSession
    rows = only(docs, id=id_col, text=text_col).select("id", (remainder5("id") == 1).alias("held_out"), "text")
    simple = rows.schema["id"].dataType.simpleString()
    chunks = materialise(rows.mapInArrow(_chunks, f"{_SCHEMA}, ids array<{simple}>"), "chunks")
    plain = chunks.drop("ids")
    deal = _Deal.of(chunks.agg(F.sum("n")).first()[0] or 0)

    def summed(asked: DataFrame, parts: int) -> DataFrame:
        by_range = asked.repartition(parts, "part", "range").sortWithinPartitions("part", "range", "chunk")
        return materialise(by_range.mapInArrow(_sum(deal), _SCHEMA), "sums", clean=True)

    counts = summed(plain.mapInArrow(_ask(deal), _SCHEMA), deal.pairs + deal.words)
    vocabulary = counts.where("part = 4")
    found = materialise(vocabulary.select("values", "words", "n").mapInArrow(_vocabulary, "code long, figure int, n double").groupBy("code", "figure").agg(F.sum("n").alias("n")), "bytes", clean=True)
    figures = {name: 0.0 for name in ("words", "types", "once", "pairs", "symbols")}
    for row in found.where("code IS NULL").collect():
        figures[list(figures)[row.figure]] = row.n
    figures["ends"] = float(counts.where("part = 5").agg(F.sum("n")).first()[0] or 0)
    figures["pairs"] += figures["ends"] * (figures["ends"] - 1)  # the end is a symbol like others
    tree = grow(found.where("code IS NOT NULL"), figures["symbols"])
    model = spark.sparkContext.broadcast(tree)
    figures["mass"] = vocabulary.select("words", "n").mapInArrow(_spelled(model), "mass double").agg(F.sum("mass")).first()[0] or 0.0
    agreeing = summed(_together(plain, counts).mapInArrow(_ask_more(deal), _SCHEMA), deal.contexts + deal.runs)
    discard(found)
    kind = pa.list_(pa.int64()).value_type if simple == "bigint" else pa.int32() if simple == "int" else pa.string()
    fields = f"id {simple}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return _together(chunks, counts, agreeing).mapInArrow(_score(model, figures, deal, kind), fields).withColumnRenamed("id", id_col)


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_texts(table(spark, sf_dir, "documents"))
