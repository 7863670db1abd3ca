"""Language-model scores by online logistic mixing of hashed-context bit predictors.

A text is its tokens in lower case, joined by blanks and closed by a line feed, coded byte by byte. The 63
commonest bytes of the corpus have codes of bits, from one binary tree for each pair of preceding codes;
any other byte is an escape and costs what its counts after the byte before it say. Every bit is predicted from four contexts: the two and
the three codes before it, and hashes of the text since the start of its word and of the previous word.
Each context's slot holds how often zeros and ones followed in the training documents, as a log-odds. A
mixer sums the log-odds with weights chosen by a gate (place in the code, confidence of the word
contexts), and the weights follow the gradient of the coding cost, block after block, afresh in
every document. What they start from is learnt from all training documents: each of them is coded from the same
constants by the tables of the half of them that it is not in, and the weights it ends with are averaged, every gate's by
the bits it chose. The sum of all costs is the text's log probability.

Tasks count the contexts of all training documents into tables of fixed size and send the pages in use;
the sums are made per page of slots, streaming. What follows within a word is counted from the counts of
tokens, each distinct token once. Texts are coded and scored several together. The model has ``2 ** slots_log2`` slots per hashed
table whatever the corpus, which bounds memory and broadcast; what is gathered grows with the input.

The base score needs exact token counts. Tokens above a share of all occurrences are looked up in the task; the
share is the least of ``SHARES`` that at most HEAD tokens have. The others are joined by token, and none of them is hot.
"""

from __future__ import annotations

import heapq
import math
import zlib
from collections import Counter
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkcurate.llm.common import documents, fold, small_batches, stored

#: Most tokens that are counted as common, and the shares of all occurrences that they may have at least.
HEAD, SHARES = 1 << 18, [1 << k for k in (18, 19, 20, 21, 22)]
#: Codes, bytes coded at a time, bytes after which the weights move, scale of a stored log-odds.
CODES, CHUNK, BLOCK, SCALE = 64, 8192, 1024, 12.0
#: Texts scored together.
TOGETHER = 8
#: Gates of the mixer, parts of one that sums of weights are counted in; sign of a bit.
GATES, PART = 64, 1 << 20
SIGN = np.array([-1, 1], dtype=np.float32)
#: Slots per block of the gathered tables.
PAGE = 1 << 16
#: Odd multipliers of the context hashes.
TEXT_MULT, WORD_MULT = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93


def tokens_of(text: str | None) -> list[bytes]:
    """Words with A-Z in lower case."""
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def coded(words: list[bytes]) -> bytes:
    """What is scored: the words joined by blanks, and the end."""
    return b" ".join(words) + b"\n"


def tree_paths(weights: list[int]) -> list[list[tuple[int, int]]]:
    """Huffman paths of the symbols: (inner node, bit) from the root; nodes are numbered from 0."""
    heap: list[tuple] = [(w, i) for i, w in enumerate(weights)]
    heapq.heapify(heap)
    made, children = len(weights), []
    while len(heap) > 1:
        a, b = heapq.heappop(heap), heapq.heappop(heap)
        children.append((a[1], b[1]))
        heapq.heappush(heap, (a[0] + b[0], made))
        made += 1
    paths: list[list[tuple[int, int]]] = [[] for _ in weights]
    todo: list[tuple[int, list]] = [(made - 1, [])]
    while todo:
        number, path = todo.pop()
        if number < len(weights):
            paths[number] = path
        else:
            inner = number - len(weights)
            for bit, child in enumerate(children[inner]):
                todo.append((child, [*path, (inner, bit)]))
    return paths


def numbered(ends: np.ndarray) -> np.ndarray:
    """For each place the number of its run; runs that are not empty end before ``ends``. Faster than ``repeat`` for short runs."""
    of = np.zeros(int(ends[-1]) if len(ends) else 0, dtype=np.int64)
    of[ends[:-1]] = 1
    return np.cumsum(of, out=of)


def symbols_of(counts: np.ndarray) -> np.ndarray:
    """The code number of every byte: the commonest bytes first, the rest share the last one."""
    common = sorted(range(256), key=lambda b: (-int(counts[b]), b))[: CODES - 1]
    symbol = np.full(256, CODES - 1, dtype=np.uint8)
    symbol[common] = np.arange(CODES - 1)
    return symbol


class Sent:
    """Goes to the tasks with its tables packed."""

    def __getstate__(self) -> dict:
        return {k: (zlib.compress(v.tobytes(), 1), v.dtype.str, v.shape) if isinstance(v, np.ndarray) and v.nbytes > PAGE else v
                for k, v in self.__dict__.items()}

    def __setstate__(self, state: dict) -> None:
        for k, v in state.items():
            self.__dict__[k] = np.frombuffer(zlib.decompress(v[0]), dtype=v[1]).reshape(v[2]) if isinstance(v, tuple) else v


class Code(Sent):
    """Bits of the codes after each pair of codes. ``pairs``: counts of codes after two codes."""

    def __init__(self, symbol: np.ndarray, pairs: np.ndarray):
        self.symbol, self.blank = symbol, int(symbol[32])
        overall = pairs.sum(axis=0).astype(np.float64)
        rest = 1 + np.floor(4000 * overall / max(overall.sum(), 1)).astype(np.int64)
        weights = pairs.astype(np.int64) * 4096 + rest
        common = tree_paths(rest.tolist())
        flat: list[int] = []
        self.length = np.zeros(CODES**3, dtype=np.int64)
        self.start = np.zeros(CODES**3, dtype=np.int64)
        for pair in range(CODES**2):
            paths = tree_paths(weights[pair].tolist()) if pairs[pair].any() else common
            for code, path in enumerate(paths):
                self.length[pair * CODES + code] = len(path)
                self.start[pair * CODES + code] = len(flat)
                flat.extend(n | b << 6 | min(i, 3) << 7 for i, (n, b) in enumerate(path))
        #: Start and length of a path in one number.
        self.place = self.start << 8 | self.length
        #: Node, bit and place (at most 3) of every step of every path, packed.
        self.steps = np.array(flat, dtype=np.uint16)
        self.odds = self.step_odds(pairs)

    def step_odds(self, pairs: np.ndarray) -> np.ndarray:
        """Log-odds of every step of every path for counts of codes after two codes."""
        return self.node_odds(np.arange(CODES**2), pairs)[np.repeat(np.arange(CODES**3) // CODES, self.length), self.steps & 63]

    def by(self, pairs: np.ndarray) -> Code:
        """The same bits with the log-odds of other counts."""
        out = Code.__new__(Code)
        out.__dict__ |= self.__dict__
        out.odds = self.step_odds(pairs)
        return out

    def node_odds(self, pair: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Log-odds of the nodes (row by row) for counts of codes, each row after a pair of codes."""
        row, code = np.nonzero(counts)
        key = pair[row] * CODES + code
        lengths = self.length[key]
        at = np.arange(lengths.sum()) + np.repeat(self.start[key] - (np.cumsum(lengths) - lengths), lengths)
        slot = np.repeat(row, lengths) * CODES + (self.steps[at] & 63)
        ones = (self.steps[at] >> 6 & 1).astype(np.float64)
        n = np.repeat(counts[row, code], lengths).astype(np.float64)
        size = len(counts) * CODES
        return log_odds(np.bincount(slot, n * (1 - ones), size), np.bincount(slot, n * ones, size)).reshape(-1, CODES)

    def bits(self, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each bit of codes (``key``: pair and code): which of them it is of, and its step."""
        found = self.place.take(key, mode="clip")
        lengths = found & 0xFF
        ends = np.cumsum(lengths)
        of = numbered(ends)
        at = ((found >> 8) - (ends - lengths)).take(of, mode="clip")
        at += np.arange(len(of))
        return of, at


class _Powers:
    """Powers of the text multiplier, modulo 2**64, grown on demand."""

    def __init__(self):
        self.up = np.ones(0, dtype=np.uint64)

    def upto(self, n: int) -> np.ndarray:
        if len(self.up) < n:
            with np.errstate(over="ignore"):
                self.up = np.cumprod(np.full(max(n, 1 << 12), TEXT_MULT, dtype=np.uint64))
        return self.up


POWERS = _Powers()


def joined(texts: Iterable[bytes]) -> Iterator[np.ndarray]:
    """Coded texts, one after the other, some ``CHUNK`` bytes at a time."""
    some, size = [], 0
    for text in texts:
        some.append(text)
        size += len(text)
        if size >= CHUNK:
            yield np.frombuffer(b"".join(some), dtype=np.uint8)
            some, size = [], 0
    if some:
        yield np.frombuffer(b"".join(some), dtype=np.uint8)


def last_codes(symbols: np.ndarray, before: int = 0, starts: np.ndarray | None = None) -> np.ndarray:
    """The three codes before each byte (18 bits); ``before`` stands before texts, which begin at ``starts``."""
    last = symbols.astype(np.int64)
    three = np.zeros(len(symbols), dtype=np.int64)
    three[1:] |= last[:-1]
    three[2:] |= last[:-2] << 6
    three[3:] |= last[:-3] << 12
    starts = np.zeros(1, dtype=np.int64) if starts is None else starts
    ends = np.append(starts[1:], len(symbols))
    for k in range(3):
        at = starts[starts + k < ends] + k
        three[at] = three[at] & (1 << 6 * k) - 1 | (before * 0o10101 >> 6 * k) << 6 * k
    return three


def text_starts(data: np.ndarray) -> np.ndarray:
    """Where the coded texts of ``data`` begin."""
    return np.concatenate([[0], np.flatnonzero(data[:-1] == 10) + 1])


def word_hashes(data: np.ndarray) -> list[np.ndarray]:
    """Before each byte: hashes of the text since the start of its word, and of the previous word."""
    ends = np.flatnonzero((data == 32) | (data == 10)) + 1
    if not len(ends) or ends[-1] != len(data):
        ends = np.append(ends, len(data))
    starts, word = np.concatenate([[0], ends[:-1]]), numbered(ends)
    with np.errstate(over="ignore"):
        place = np.arange(len(data)) - starts.take(word, mode="clip")
        sums = np.zeros(len(data) + 1, dtype=np.uint64)
        np.cumsum((data + np.uint64(1)) * POWERS.upto(int((ends - starts).max())).take(place, mode="clip"), out=sums[1:])
        first = sums[starts]
        since = sums[:-1] - first.take(word, mode="clip")
        previous = np.zeros(len(starts), dtype=np.uint64)
        previous[1:] = np.where(data[starts[1:] - 1] == 10, np.uint64(0), np.diff(first))
        previous = (previous ^ previous >> np.uint64(29)) * np.uint64(TEXT_MULT) + np.uint64(1)
        return [(h * np.uint64(WORD_MULT) >> np.uint64(32)).astype(np.uint32) for h in (since, since + previous.take(word, mode="clip"))]


def word_rows(hashes: np.ndarray, slots_log2: int) -> np.ndarray:
    """For each context the slot of node 0; that of another node has the node's number flipped into it.

    All bits of a byte then lie in one line of the cache, and contexts that share a row of 64 slots still
    rarely share slots.
    """
    return (hashes >> np.uint32(32 - slots_log2)).astype(np.int64) ^ (hashes & np.uint32(63)).astype(np.int64)


def word_slots(rows: np.ndarray, nodes: np.ndarray) -> np.ndarray:
    """Slots of the hashed table for contexts and nodes."""
    return rows ^ nodes


def count_slots(rows: np.ndarray, steps: np.ndarray) -> np.ndarray:
    """Slots of the counts: a row has 64 for zeros, then 64 for ones."""
    return (rows + (rows & ~63)) ^ (steps & 127)


def log_odds(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """Stored log-odds of counts; 0 where nothing was seen."""
    value = np.log((ones + 0.4) / (zeros + 0.4)) * SCALE
    return np.clip(np.rint(value), -127, 127).astype(np.int8)


def packed_counts(page: np.ndarray) -> bytes:
    """The counts of a page: a byte each, then those of 255 and more in full; a byte a slot packs better than slot and count."""
    return zlib.compress(np.minimum(page, 255).astype(np.uint8).tobytes() + page[page >= 255].astype("<u4").tobytes(), 1)


def unpacked_counts(packed: bytes) -> np.ndarray:
    """The inverse of :func:`packed_counts`."""
    raw = zlib.decompress(packed)
    page = np.frombuffer(raw, dtype=np.uint8, count=PAGE).astype(np.int64)
    page[page == 255] = np.frombuffer(raw, dtype="<u4", offset=PAGE)
    return page


class Tally:
    """Counts of one task in tables of fixed size."""

    def __init__(self, *sizes: int):
        self.tables = [np.zeros(n, dtype=np.uint32) for n in sizes]

    def add(self, *slots: np.ndarray, times: np.ndarray | None = None) -> None:
        for table, some in zip(self.tables, slots, strict=True):
            # An array of the table's type: a single number takes a path nine times slower.
            np.add.at(table, some, np.ones(len(some), dtype=np.uint32) if times is None else times)

    def half(self, number: int) -> Tally:
        """The first or the second half of the tables; they stay the same tables."""
        out, many = Tally(), len(self.tables) // 2
        out.tables = self.tables[number * many : (number + 1) * many]
        return out

    def pages(self) -> Iterator[tuple[int, bytes]]:
        """Pages with a used slot: page number, and packed counts."""
        for number, page in enumerate(p for table in self.tables for p in table.reshape(-1, PAGE)):
            if page.any():
                yield number, packed_counts(page)


def escaped(data: np.ndarray, symbols: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the bytes without a code, and each with the byte before it; a blank stands before texts."""
    at = np.flatnonzero(symbols == CODES - 1)
    before = data[at - 1].astype(np.int64)
    before[np.isin(at, starts)] = 32
    return at, before << 8 | data[at]


def escape_bits(symbol: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Bits of a byte without a code after each byte; ``counts`` of such bytes after each byte.

    Bytes that were seen after the byte before are told by that, others by how often they were seen at all, and what was never
    seen has a share too. Over all bytes without a code the probabilities add up to one.
    """
    counts = counts.reshape(256, 256).astype(np.float64)
    free = (symbol == CODES - 1).astype(np.float64)
    overall = (counts.sum(axis=0) + free) / (counts.sum() + free.sum())
    with np.errstate(divide="ignore"):
        return -np.log2((counts + overall) / (counts.sum(axis=1, keepdims=True) + 1)).reshape(-1)


def count_codes(tally: Tally, batch: pd.DataFrame, symbol: np.ndarray) -> None:
    """Count the codes of texts after three codes, and the bytes without a code after the byte before."""
    for data in joined(coded(tokens_of(text)) for text in batch["text"]):
        symbols, starts = symbol[data], text_starts(data)
        tally.add(last_codes(symbols, int(symbol[32]), starts) << 6 | symbols, escaped(data, symbols, starts)[1])


def count_bits(tally: Tally, batch: pd.DataFrame, code: Code, slots_log2: int) -> None:
    """Count the bits of texts after the text since the start of the previous word."""
    for data in joined(coded(tokens_of(text)) for text in batch["text"]):
        symbols, rows = code.symbol[data], word_rows(word_hashes(data)[1], slots_log2)
        keys = (last_codes(symbols, code.blank, text_starts(data)) & 0xFFF) << 6 | symbols
        for begin in range(0, len(data), 2 * CHUNK):
            of, at = code.bits(keys[begin : begin + 2 * CHUNK])
            tally.add(count_slots(rows[begin : begin + 2 * CHUNK].take(of, mode="clip"), code.steps.take(at, mode="clip").astype(np.int64)))


def count_word_bits(tally: Tally, batch: pd.DataFrame, code: Code, slots_log2: int, pairs: np.ndarray) -> None:
    """Count the bits of tokens (token, n, ends) after the text since the start of the word.

    A token stands ``n`` times, ``ends`` times of them before the end and else before a blank. The bits of first bytes
    are those of the codes after a blank in ``pairs``; they come with the one row of the end.
    """
    def add(keys: np.ndarray, rows: np.ndarray, n: np.ndarray) -> None:
        for begin in range(0, len(keys), 2 * CHUNK):
            part = slice(begin, begin + 2 * CHUNK)
            of, at = code.bits(keys[part])
            tally.add(count_slots(rows[part].take(of, mode="clip"), code.steps.take(at, mode="clip").astype(np.int64)), times=n[part].take(of))

    words = batch[batch["token"].map(len) > 0]
    if len(words) < len(batch):
        first = np.arange(CODES) * CODES + code.blank
        at, symbols = np.nonzero(pairs[first])
        add(first[at] << 6 | symbols, np.zeros(len(at), dtype=np.int64), pairs[first][at, symbols].astype(np.uint32))
    if len(words):
        data = np.frombuffer(b" ".join(words["token"]) + b" ", dtype=np.uint8)
        blank = np.flatnonzero(data == 32)
        n, ends = words["n"].to_numpy(), words["ends"].to_numpy()
        times = np.repeat(n, np.diff(np.concatenate([[-1], blank])))
        times[blank] -= ends
        times[np.concatenate([[0], blank[:-1] + 1])] = 0
        symbols, rows = code.symbol[data], word_rows(word_hashes(data)[0], slots_log2)
        before = (last_codes(symbols, code.blank) & 0xFFF) << 6
        add(before | symbols, rows, times.astype(np.uint32))
        last = blank[ends > 0]
        add(before[last] | int(code.symbol[10]), rows[last], ends[ends > 0].astype(np.uint32))


def half_of(doc_id: Column) -> Column:
    """0 or 1: the half of the training documents that an id is in."""
    return F.pmod(F.xxhash64(doc_id), F.lit(2)).cast("int")


def halves(count: Callable[..., None], *given: object) -> Callable[[Tally, pd.DataFrame], None]:
    """Count the texts of each half into tables of its own."""
    def counted(tally: Tally, batch: pd.DataFrame) -> None:
        for number in (0, 1):
            part = batch[batch["half"] == number]
            if len(part):
                count(tally.half(number), part, *given)

    return counted


class Pages:
    """Counts by page, packed; those of several tables are added up."""

    def __init__(self, *tables: dict[int, bytes]):
        self.tables = tables

    def items(self) -> Iterator[tuple[int, np.ndarray]]:
        for page in sorted(set().union(*self.tables)):
            yield page, sum(np.frombuffer(zlib.decompress(t[page]), dtype=np.int64) for t in self.tables if page in t)


def gathered(rows: DataFrame, count: Callable[[Tally, pd.DataFrame], None], *sizes: int, odds: bool = False) -> list:
    """Summed counts of all rows by page, or the log-odds of pairs of counts: of the first half, of the second, and of both.

    ``count`` has the tables of the first half, then those of the second.
    """
    many = sum(sizes) // PAGE

    def tallied(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tally = Tally(*sizes, *sizes)
        for batch in batches:
            count(tally, batch)
        for number, packed in tally.pages():
            yield pd.DataFrame({"page": [number], "packed": [packed]})

    def summed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for number, packed in zip(batch["page"].tolist(), batch["packed"], strict=True):
                page = sums.setdefault(number, np.zeros(PAGE, dtype=np.int64))
                page += unpacked_counts(packed)
        for number in sorted({page % many for page in sums}):
            parts = [sums[n] for n in (number, number + many) if n in sums]
            found = [(half, sums[n]) for half, n in enumerate((number, number + many)) if n in sums]
            for half, page in [*found, (2, sum(parts))] if odds else found:
                pairs = page.reshape(-1, 2, 64)
                out = log_odds(pairs[:, 0].ravel(), pairs[:, 1].ravel()) if odds else page
                yield pd.DataFrame({"half": [half], "page": [number], "found": [zlib.compress(out.tobytes(), 1)]})

    # Page numbers are bounded by the size of the tables, and so is what a task or the driver holds.
    pages = rows.mapInPandas(tallied, "page int, packed binary").repartition(F.pmod("page", F.lit(many)))
    out: list[dict[int, bytes]] = [{}, {}, {}]
    for r in pages.mapInPandas(summed, "half int, page int, found binary").collect():
        out[r.half][r.page] = bytes(r.found)
    if not odds:
        return [Pages(out[0]), Pages(out[1]), Pages(out[0], out[1])]
    return [{page: np.frombuffer(zlib.decompress(found), dtype=np.int8) for page, found in some.items()} for some in out]


class Model(Sent):
    """Code, tables of log-odds, and the mixer's first weights."""

    def __init__(self, code: Code, triples: dict[int, np.ndarray] | Pages, words: dict[int, np.ndarray],
                 slots_log2: int, escapes: np.ndarray | None = None):
        self.escapes = escape_bits(code.symbol, np.zeros(1 << 16) if escapes is None else escapes)
        self.code, self.slots_log2 = code, slots_log2
        self.three = np.zeros((CODES**3, CODES), dtype=np.int8)
        rows = PAGE // CODES
        for page, counts in triples.items():
            if page >= CODES**4 // PAGE:
                continue
            first = page * rows
            pair = np.arange(first, first + rows) % CODES**2
            self.three[first : first + rows] = code.node_odds(pair, counts.reshape(rows, CODES))
        self.three = self.three.reshape(-1)
        self.words = np.zeros((2, 1 << slots_log2), dtype=np.int8)
        flat = self.words.reshape(-1, PAGE // 2)
        for page, odds in words.items():
            flat[page] = odds
        #: Gate of a stored log-odds by its byte: unseen, doubtful, clear, sure.
        size = np.abs(np.arange(256, dtype=np.uint8).view(np.int8).astype(np.int64))
        self.level = [(np.digitize(size, [1, 18, 42]) * m).astype(np.uint8).tobytes() for m in (4, 16)]
        self.weights = np.tile(np.array([[0.1], [0.4], [0.4], [0.2]], dtype=np.float32) / SCALE, (1, GATES))

    def cost(self, words: list[bytes], weights: np.ndarray | None = None, rate: float = 0.06) -> float:
        """Bits of a text. ``weights`` are moved in place if given, else a copy of the first ones is."""
        return float(self._together([coded(words)], self.weights.copy() if weights is None else weights, rate)[0])

    def costs(self, texts: list[list[bytes]], ends: np.ndarray | None = None) -> list[float]:
        """Bits of each text. Texts of like lengths are scored together, each with weights of its own.

        ``ends`` (whole numbers; a row an input, then one of the bits) gains for each gate its bits in each text, and
        the weights at the text's end that often: sums that do not depend on the order of texts.
        """
        data = [coded(words) for words in texts]
        order = sorted(range(len(data)), key=lambda i: len(data[i]))
        found, some, size = [0.0] * len(data), [], 0
        for i in order:
            some.append(i)
            size += len(data[i])
            if len(some) == TOGETHER or size >= 8 * CHUNK or i == order[-1]:
                own = np.tile(self.weights, (1, len(some)))
                seen = None if ends is None else np.zeros(own.shape[1], dtype=np.int64)
                bits = self._together([data[j] for j in some], own, 0.06, seen).tolist()
                if ends is not None:
                    ends[:-1] += np.rint(own.astype(np.float64) * (SCALE * PART) * seen).astype(np.int64).reshape(len(own), -1, GATES).sum(axis=1)
                    ends[-1] += seen.reshape(-1, GATES).sum(axis=0)
                for j, cost in zip(some, bits, strict=True):
                    found[j] = cost
                some, size = [], 0
        return found

    def _together(self, texts: list[bytes], own: np.ndarray, rate: float, seen: np.ndarray | None = None) -> np.ndarray:
        """Bits of coded texts; ``own`` has ``GATES`` weights of each input for each text and is moved in place.

        ``seen`` gains the bits of each gate of each text.

        Weights hold for log-odds as stored. Every bit of a text's block takes part in their step. The blocks that
        are the first of their texts go together, then those that are the second.
        """
        data, code = np.frombuffer(b"".join(texts), dtype=np.uint8), self.code
        sizes, lanes, inputs = np.array([len(t) for t in texts]), len(texts), len(own)
        starts = np.cumsum(sizes) - sizes
        symbols = code.symbol[data]
        three = last_codes(symbols, code.blank, starts)
        rows = [word_rows(h, self.slots_log2) for h in word_hashes(data)]
        plain, found = escaped(data, symbols, starts)
        escapes = np.bincount(np.searchsorted(starts, plain, "right") - 1, self.escapes[found], lanes)
        # Bytes of each text in each turn.
        turns = np.arange(-(-int(sizes.max()) // BLOCK))[:, None] * BLOCK
        shares = np.clip(sizes - turns, 0, BLOCK)
        edges = np.concatenate([[0], np.cumsum(shares.sum(axis=1))])
        lane = np.arange(lanes).repeat(sizes)
        if lanes > 1 and len(shares) > 1:
            turn = ((np.arange(len(data)) - starts.repeat(sizes)) // BLOCK).astype(np.uint16)
            order = np.argsort(turn, kind="stable")
            symbols, three, lane = symbols[order], three[order], lane[order]
            rows = [r[order] for r in rows]
        keys, three = (three & 0xFFF) << 6 | symbols, three << 6
        total = np.zeros(lanes)
        begin = 0
        while begin < len(shares):
            end = max(begin + 1, int(np.searchsorted(edges, edges[begin] + CHUNK, "right")) - 1)
            part = slice(edges[begin], edges[end])
            of, at = code.bits(keys[part])
            step = code.steps.take(at, mode="clip")
            node = (step & np.uint16(63)).astype(np.int64)
            sign = SIGN.take(step >> np.uint16(6) & np.uint16(1), mode="clip")
            x = np.empty((inputs, len(of)), dtype=np.float32)
            x[0] = code.odds.take(at, mode="clip")
            x[1] = self.three.take(three[part].take(of, mode="clip") + node, mode="clip")
            level = (step >> np.uint16(7)).astype(np.uint8)
            for k, (table, levels) in enumerate(zip(self.words, self.level, strict=True)):
                odds = table.take(word_slots(rows[k][part].take(of, mode="clip"), node), mode="clip")
                x[2 + k] = odds
                level += np.frombuffer(odds.tobytes().translate(levels), dtype=np.uint8)
            gate = level.astype(np.int64)
            if lanes > 1:
                gate += (lane[part] * GATES).take(of, mode="clip")
            for t in range(begin, end):
                active = np.flatnonzero(shares[t])
                heads = edges[t] - edges[begin] + np.cumsum(shares[t][active]) - shares[t][active]
                heads = np.searchsorted(of, heads)
                a, b = int(heads[0]), int(np.searchsorted(of, edges[t + 1] - edges[begin]))
                g, s, xs = gate[a:b], sign[a:b], x[:, a:b]
                # Places are in range by construction: "clip" spares the test of each, here and above.
                parts = own.take(g, axis=1, mode="clip")
                parts *= xs
                mixed = parts[0]
                for more in parts[1:]:
                    mixed += more
                mixed *= s
                np.clip(mixed, -14, 14, out=mixed)
                odds = np.exp(-mixed)
                logs = odds.astype(np.float64)
                logs += 1
                total[active] += np.add.reduceat(np.log(logs, out=logs), heads - a)
                # The share of the wrong value, signed by the right one.
                error = odds / (1 + odds)
                error *= s
                chosen = np.bincount(g, minlength=own.shape[1])
                if seen is not None:
                    seen += chosen
                move = rate / SCALE / np.sqrt(1 + chosen) / SCALE
                xs *= error
                for k in range(inputs):
                    own[k] += (np.bincount(g, xs[k], own.shape[1]) * move).astype(np.float32)
                # A gate that sees few bits must not run away.
                np.clip(own, -0.5 / SCALE, 1.5 / SCALE, out=own)
            begin = end
        return total / math.log(2) + escapes


def token_counts(docs: DataFrame) -> DataFrame:
    """Occurrences of every token, the end (an empty token) included: token, n, and before how many ends: ends.

    ``n1`` and ``ends1`` are those in the second half of the documents (id, text).
    """
    def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: list[dict[bytes, int]] = [{}, {}]
        last: list[Counter] = [Counter(), Counter()]

        def flushed() -> pd.DataFrame:
            tokens = list(seen[0].keys() | seen[1].keys())
            n, n1, ends, ends1 = (np.array([some.get(t, 0) for t in tokens], dtype="int64") for some in (*seen, *last))
            for some in (*seen, *last):
                some.clear()
            return pd.DataFrame({"token": tokens, "n": n + n1, "ends": ends + ends1, "n1": n1, "ends1": ends1})

        for batch in batches:
            for half, rows in batch.groupby("half"):
                known = seen[half]
                # Arrow splits and counts a batch; only its distinct tokens meet those of other batches in Python.
                data = [(text or "").encode("utf-8", "surrogatepass") for text in rows["text"]]
                last[half].update(w.lower() for d in data for w in d.rsplit(None, 1)[-1:])
                texts = pa.array(data, pa.binary()).view(pa.string())
                found = pc.ascii_split_whitespace(pc.ascii_lower(texts)).flatten().cast(pa.binary()).value_counts()
                for token, n in zip(found.field(0).to_pylist(), found.field(1).to_pylist(), strict=True):
                    if token:  # Arrow finds empty ones beside white space at either end of a text
                        known[token] = known.get(token, 0) + n
                known[b""] = known.get(b"", 0) + len(data)
            if len(seen[0]) + len(seen[1]) > 400_000:
                yield flushed()
        if seen[0] or seen[1]:
            yield flushed()

    kinds = "token binary, n bigint, ends bigint, n1 bigint, ends1 bigint"
    return docs.select("text", half_of(F.col("id")).alias("half")).mapInPandas(counted, kinds).groupBy("token").agg(
        *[F.sum(c).alias(c) for c in ("n", "ends", "n1", "ends1")])


def byte_counts(counts: DataFrame) -> np.ndarray:
    """How often each byte is coded in the counted texts."""
    def bytewise(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums = np.zeros(256, dtype=np.int64)
        for batch in batches:
            tokens, n = [t or b"\n" for t in batch["token"]], batch["n"].to_numpy()
            data = np.frombuffer(b"".join(tokens), dtype=np.uint8)
            sums += np.bincount(data, np.repeat(n, [len(t) for t in tokens]), 256).astype(np.int64)
            sums[32] += n.sum()
        yield pd.DataFrame({"byte": np.arange(256), "n": sums})

    rows = counts.select("token", "n").mapInPandas(bytewise, "byte int, n bigint").groupBy("byte").agg(F.sum("n").alias("n"))
    out = np.zeros(256, dtype=np.int64)
    for r in rows.collect():
        out[r.byte] = r.n
    return out


def end_weights(texts: DataFrame, model: Model) -> np.ndarray:
    """For all ``texts`` the sums that ``Model.costs`` makes of the weights they end with."""
    def ended(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ends = np.zeros((len(model.weights) + 1, GATES), dtype=np.int64)
        for batch in batches:
            model.costs([tokens_of(text) for text in batch["text"]], ends)
        yield pd.DataFrame({"slot": np.arange(ends.size, dtype=np.int32), "n": ends.reshape(-1)})

    sums = np.zeros((len(model.weights) + 1, GATES), dtype=np.int64)
    for r in texts.mapInPandas(ended, "slot int, n bigint").groupBy("slot").agg(F.sum("n").alias("n")).collect():
        sums.reshape(-1)[r.slot] = r.n
    return sums


def train(docs: DataFrame, counts: DataFrame, slots_log2: int = 22) -> Model:
    """Fit code, tables and the mixer's first weights on all ``docs`` (id, text); every document moves its own from those.

    A document that is in the tables is foretold too well to learn weights from: those of each half of the documents are
    learnt with the tables of the other.
    """
    symbol = symbols_of(byte_counts(counts))
    texts = docs.select("text", half_of(F.col("id")).alias("half"))
    triples = gathered(texts, halves(count_codes, symbol), CODES**4, 1 << 16)
    pairs = np.zeros((3, CODES**2, CODES), dtype=np.int64)
    escapes = np.zeros(1 << 16, dtype=np.int64)
    for half in (0, 1):
        for page, found in triples[half].items():
            if page == CODES**4 // PAGE:
                escapes += found
            else:
                part = page % (CODES**3 // PAGE)
                pairs[half].reshape(-1)[part * PAGE : (part + 1) * PAGE] += found
    pairs[2] = pairs[0] + pairs[1]
    code = Code(symbol, pairs[2])
    size = 2 << slots_log2

    def count_tokens(tally: Tally, batch: pd.DataFrame) -> None:
        for half, n, ends in ((0, batch["n"] - batch["n1"], batch["ends"] - batch["ends1"]), (1, batch["n1"], batch["ends1"])):
            some = pd.DataFrame({"token": batch["token"], "n": n, "ends": ends})[n > 0]
            if len(some):
                count_word_bits(tally.half(half), some, code, slots_log2, pairs[half])

    words = gathered(counts, count_tokens, size, odds=True)
    for own, pages in zip(words, gathered(texts, halves(count_bits, code, slots_log2), size, odds=True), strict=True):
        own.update((size // PAGE + page, odds) for page, odds in pages.items())
    ends = 0
    for half in (0, 1):
        other = Model(code.by(pairs[1 - half]), triples[1 - half], words[1 - half], slots_log2, escapes)
        ends = ends + end_weights(texts.where(F.col("half") == half), other)
    model, bits = Model(code, triples[2], words[2], slots_log2, escapes), ends[-1]
    model.weights = np.where(bits > 0, ends[:-1] / np.maximum(bits, 1) / (SCALE * PART), model.weights).astype(np.float32)
    return model


def score_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                slots_log2: int = 22) -> DataFrame:
    """Score every row with a model of the documents whose id has a crc32 other than 1 modulo 5.

    Returns the id, held_out, n_tokens (end included), n_known, train_tokens, base_score and score
    (log10 probabilities; the base score is that of smoothed token counts), n_bytes and bits_per_byte.
    One row per input row, repeated ones included. A null text counts as empty: it is the end alone. Rows
    with a null id are never learnt from and count as held out. Without training documents the counts
    are zero and the model is uniform. Extra columns are ignored; an empty table gives an empty result.
    """
    docs = small_batches(docs).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    remainder = fold(F.col("id"))
    learnt = docs.where(remainder != 1)
    counts = stored(token_counts(learnt))
    size = counts.agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("v")).first()
    n, v = size.n or 0, size.v
    model = train(learnt, counts, slots_log2=slots_log2)
    # Of the first share there are never more than HEAD.
    above = counts.agg(*[F.count_if(F.col("n") > n / share) for share in SHARES]).first()
    share = max(share for share, many in zip(SHARES, above, strict=True) if many <= HEAD)
    head = {bytes(r.token): r.n for r in counts.where(F.col("n") > n / share).select("token", "n").collect()}
    scale = math.log10(n + 0.5 * (v + 1))
    logs = {t: math.log10(c + 0.5) - scale for t, c in head.items()}

    def scored(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            texts = [tokens_of(text) for text in batch["text"]]
            for words, cost in zip(texts, model.costs(texts), strict=True):
                found, rare = list(map(logs.get, words)), []
                if None in found:
                    rare = [w for w, x in zip(words, found, strict=True) if x is None]
                    found = [x for x in found if x is not None]
                if b"" in logs:
                    found.append(logs[b""])
                else:
                    rare.append(b"")
                out.append((len(words) + 1, len(found), math.fsum(found), rare,
                            sum(map(len, words)) + max(len(words), 1), -cost * math.log10(2)))
            frame = pd.DataFrame(out, columns=["n_tokens", "head", "head_score", "rare", "n_bytes", "score"])
            frame.insert(0, "id", batch["id"].values)
            yield frame

    kind = docs.schema["id"].dataType.simpleString()
    rows = stored(docs.mapInPandas(scored, (
        f"id {kind}, n_tokens bigint, head bigint, head_score double, rare array<binary>, "
        "n_bytes bigint, score double")).withColumn("row", F.monotonically_increasing_id()))
    rare = rows.select("row", F.explode("rare").alias("token"))
    # Every token is one row of the counts, so that no part of their hash table can be large.
    known = rare.join(counts.select("token", "n").hint("shuffle_hash"), "token", "left").groupBy("row").agg(
        F.count_if(F.col("n") > 0).alias("tail"),
        F.sum(F.log10(F.coalesce(F.col("n"), F.lit(0)) + F.lit(0.5)) - F.lit(scale)).alias("tail_score"))
    zero = F.lit(0)
    return rows.join(known, "row", "left").select(
        F.col("id").alias(id_col), F.coalesce(fold(F.col("id")) == 1, F.lit(True)).alias("held_out"),
        "n_tokens", (F.col("head") + F.coalesce("tail", zero)).alias("n_known"),
        F.lit(n).cast("long").alias("train_tokens"),
        (F.col("head_score") + F.coalesce("tail_score", F.lit(0.0))).alias("base_score"), "score",
        "n_bytes", (-F.col("score") / math.log10(2) / F.col("n_bytes")).alias("bits_per_byte"),
    )


def op2_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base and model score of every document."""
    return score_texts(documents(spark, sf_dir, "doc_id", "text"))


QUERIES = {"op2_lm_scoring": op2_lm_scoring}
ORACLES: dict[str, str] = {}
