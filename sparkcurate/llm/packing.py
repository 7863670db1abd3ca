"""Best-fit packing of tokenised documents, certified by lower bounds and repaired by exchange.

Every document becomes token ids and an end token and is cut only where it exceeds a sequence. Pieces are
dealt over partitions of alike lengths and packed there by best-fit decreasing. Dual feasible functions of a
partition's lengths give a number of sequences that no packing can beat; a partition that
needs just as many is certified. Then pieces are exchanged: partitions with a gap give all sequences with
room, certified ones only their emptiest; these pieces are dealt over fewer partitions and packed again, until
the whole packing meets the bound over all lengths or a round saves no sequence.

Scale: a task packs some ``PIECES`` pieces whatever the corpus. Each round moves only what still has room. The
driver holds counts per length, at most as many as a sequence has tokens, and per round three numbers.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkcurate.llm.common import documents, small_batches, stored

#: Pieces that a task packs at a time, on average.
PIECES = 8192
#: Parts that get alike lengths: see ``_dealt``.
DEALT = 64
#: Entries of each generation of a tokenizer's two caches, and bytes of the longest entry.
CACHED, CACHED_BYTES = 1 << 18, 64
#: Rounds of exchange at most; each but the last saves a sequence.
ROUNDS = 60

#: Fixed value: how the tokenizer's file splits words, said for lower-case words of the characters in ``PLAIN``.
PARTS = re.compile("\n|'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ž]+|[0-9]|[^a-z0-9ß-öø-ž\n]+")
#: Special tokens, and other characters than ASCII and composed Latin letters.
ODD = re.compile("[^\n\x21-\x7eÀ-ÖØ-öø-įı-ž]|<[|]")
#: Fixed value: the mark of a token that ends a word.
WORD_END = "</w>"
#: Fixed value: the letter that stands for each byte of a part; a blank stays between parts.
BYTE_LETTERS = np.arange(256, dtype="<u2")
BYTE_LETTERS[[*range(33), *range(127, 161), 173]] = np.arange(256, 324)
BYTE_LETTERS[32] = 32
#: No id has these bytes: between words.
BREAK = b"\xff\xff\xff\xff"

_ENCODERS: dict[str, Encoder] = {}


class Cache:
    """A mapping of bounded size in two generations: entries in use move on, others go with theirs."""

    def __init__(self) -> None:
        self.young: dict = {}
        self.old: dict = {}

    def have(self, wanted: set, make: Callable[[list], list[bytes]]) -> dict:
        """A mapping with an entry for all of ``wanted``; what is missing is made."""
        if len(self.young) > CACHED:
            self.old, self.young = self.young, {}
        young, old = self.young, self.old
        missing = wanted.difference(young)
        if not missing:
            return young
        kept = missing.intersection(old)
        fresh = list(missing.difference(kept))
        made = dict(zip(fresh, make(fresh), strict=True)) if fresh else {}
        made.update((x, old[x]) for x in kept)
        long = [x for x in fresh if len(x) > CACHED_BYTES]
        if long or len(made) > CACHED:  # more than is to be kept: a mapping for this call
            return {x: young[x] for x in wanted.difference(missing)} | made
        young.update(made)
        return young


class Encoder:
    """Token ids as little-endian bytes, word by word through a cache.

    For tokenizers in lower case that drop white space and split words into letters, digits and the rest
    (``PARTS``): a text's ids are then those of its words, and a plain word's those of its parts. Words of
    other characters, or that may hold a special token, are encoded whole.
    """

    def __init__(self, path: str) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark already uses every core
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import WhitespaceSplit

        self.tokenizer = Tokenizer.from_file(path)
        #: The model alone, for parts that are in lower case and split already: they stand between blanks.
        self.bare = Tokenizer(self.tokenizer.model)
        self.bare.pre_tokenizer = WhitespaceSplit()
        names = self.tokenizer.get_vocab()
        self.closes = np.zeros(max(names.values()) + 1, dtype=bool)
        self.closes[[i for name, i in names.items() if name.endswith(WORD_END)]] = True
        self.words, self.parts = Cache(), Cache()

    def _one_by_one(self, texts: list[str]) -> list[bytes]:
        made = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(e.ids, dtype="<u4").tobytes() for e in made]

    def _of_parts(self, parts: list[str]) -> list[bytes]:
        """Ids of each part, all in one go: the marks of word ends tell them apart."""
        text = BYTE_LETTERS[np.frombuffer(" ".join(parts).encode(), dtype=np.uint8)].tobytes().decode("utf-16-le")
        ids = np.array(self.bare.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")
        ends = np.flatnonzero(self.closes[ids]) + 1
        if len(ends) != len(parts):
            return self._one_by_one(parts)
        data, ends = ids.tobytes(), (4 * ends).tolist()
        return [data[i:j] for i, j in zip([0, *ends], ends, strict=False)]

    def _of_words(self, words: list[bytes]) -> list[bytes]:
        text = b"\n".join(words).decode()
        # One pass over the characters: a search for whole lines would try each of them twice.
        ends = ((text.rfind("\n", 0, m.start()) + 1, text.find("\n", m.start())) for m in ODD.finditer(text))
        odd = [text[i : j if j >= 0 else len(text)].encode() for i, j in dict.fromkeys(ends)]
        if odd:
            made = dict(zip(odd, self._one_by_one([w.decode() for w in odd]), strict=True))
            plain = [w for w in words if w not in made]
            made.update(zip(plain, self._of_words(plain) if plain else [], strict=True))
            return [made[w] for w in words]
        flat = PARTS.findall(text.lower())
        parts = set(flat)
        parts.discard("\n")
        ids = self.parts.have(parts, self._of_parts)
        ids["\n"] = BREAK
        return b"".join(map(ids.__getitem__, flat)).split(BREAK)

    def encode(self, texts: Sequence[str | None]) -> list[bytes]:
        """The ids of each text; none for null."""
        split = [(text or "").encode().split() for text in texts]
        find = self.words.have(set().union(*split), self._of_words).__getitem__
        return [b"".join(map(find, words)) for words in split]


def _encoder(path: str) -> Encoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def pieces_of(docs: DataFrame, text: Column, tokenizer: str, size: int = 2048, end_id: int = 0,
              with_ids: bool = False) -> DataFrame:
    """``docs`` without further columns than given, one row per piece: piece, start, length, ids_crc32, and ids.

    The ids of a document are those of its text and ``end_id``; each full ``size`` of them is a piece, the rest
    the last one. A null or empty text is its end token alone.
    """
    kind = "array<struct<piece:int,start:bigint,length:bigint,ids_crc32:bigint,ids:binary>>"
    end = np.array([end_id], dtype="<u4").tobytes()

    @F.pandas_udf(kind)
    def cut(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encoder = _encoder(tokenizer)
        for texts in batches:
            out = []
            for ids in encoder.encode(texts.tolist()):
                ids += end
                step = 4 * size
                parts = [ids[i : i + step] for i in range(0, len(ids), step)]
                out.append([(i, i * size, len(p) // 4, zlib.crc32(p), p if with_ids else None)
                            for i, p in enumerate(parts)])
            yield pd.Series(out, index=texts.index)

    made = small_batches(docs).withColumn("__piece", F.explode(cut(text)))
    names = ("piece", "start", "length", "ids_crc32") + (("ids",) if with_ids else ())
    return made.withColumns({n: F.col(f"__piece.{n}") for n in names}).drop("__piece")


def lower_bound(counts: np.ndarray) -> int:
    """Sequences that ``counts[l]`` pieces of each length l need at least; the size is ``len(counts) - 1``.

    The greatest of two families of dual feasible functions. The first counts pieces longer than size - t as
    full and drops those shorter than t, for every t up to half. The second rounds lengths down to
    multiples of size / (k + 1) and counts k of them as full; exact multiples keep their share.
    """
    size = len(counts) - 1
    counts = counts.astype(object) if counts.sum() * size >= 1 << 62 else counts.astype(np.int64)
    lengths = np.arange(size + 1)
    many, tokens = np.cumsum(counts), np.cumsum(counts * lengths)
    best = -(-int(tokens[-1]) // size)
    for t in range(1, size // 2 + 1):
        large = int(many[-1] - many[size - t])
        middle = int(tokens[size - t] - tokens[t - 1])
        best = max(best, large + -(-middle // size))
    for k in range(1, 32):
        scaled = (k + 1) * lengths
        value = np.where(scaled % size == 0, lengths * k, scaled // size * size)
        best = max(best, -(-int((counts * value).sum()) // (k * size)))
    return best


def best_fit(lengths: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Sequence number and offset of each piece: longest first, into the sequence it leaves least room in."""
    sequence, offset = np.zeros(len(lengths), dtype=np.int64), np.zeros(len(lengths), dtype=np.int64)
    rooms: list[list[int]] = [[] for _ in range(size + 1)]  # sequences by the room they have left
    present, used = 0, 0  # bit r: some sequence has room r
    for i in np.argsort(-lengths, kind="stable").tolist():
        length = int(lengths[i])
        fitting = present >> length
        if fitting:
            room = length + (fitting & -fitting).bit_length() - 1
            number = rooms[room].pop()
            if not rooms[room]:
                present ^= 1 << room
        else:
            room, number = size, used
            used += 1
        sequence[i], offset[i] = number, size - room
        left = room - length
        if left:
            rooms[left].append(number)
            present |= 1 << left
    return sequence, offset


def _dealt(pieces: DataFrame, parts: int) -> DataFrame:
    """``pieces`` with ``part``: each part gets about the same lengths.

    Pieces that lie together are sorted by length, and each ``DEALT`` of them in order go to the parts of a
    block, one to each; blocks are drawn. So parts differ far less than by hashing pieces.
    """
    width = min(parts, DEALT)
    place = F.monotonically_increasing_id()
    first, at = F.shiftright(place, 33), place.bitwiseAND(F.lit((1 << 33) - 1))
    block = F.pmod(F.xxhash64(first, F.floor(at / width)), F.lit(-(-parts // width)))
    return pieces.sortWithinPartitions("length", "row", "piece").withColumn(
        "part", block * width + F.pmod(at + F.xxhash64(first) % DEALT, F.lit(width)))


def _packed(pieces: DataFrame, turn: int, parts: int, size: int) -> DataFrame:
    """``pieces`` with sequence_id, offset and ``open``: whether the piece is to be exchanged."""
    bare = pieces.drop("part", "sequence_id", "offset", "open")
    kind = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in bare.schema.fields)

    def pack(rows: pd.DataFrame) -> pd.DataFrame:
        lengths = rows["length"].to_numpy()
        sequence, offset = best_fit(lengths, size)
        filled = np.bincount(sequence, weights=lengths).astype(np.int64)
        open_ = filled < size
        if len(filled) == lower_bound(np.bincount(lengths, minlength=size + 1)):
            emptiest = int(filled.argmin())
            open_ &= np.arange(len(filled)) == emptiest
        part = int(rows["part"].iloc[0])
        rows = rows.drop(columns=["part"])
        rows["sequence_id"] = (turn << 56) + (part << 24) + sequence
        rows["offset"], rows["open"] = offset, open_[sequence]
        return rows

    return stored(_dealt(bare, parts).groupBy("part").applyInPandas(pack, f"{kind}, sequence_id long, offset long, open boolean"))


def pack_pieces(pieces: DataFrame, size: int = 2048) -> tuple[DataFrame, int, int]:
    """Pack ``pieces`` (row, piece, length, more): them with sequence_id and offset, the sequences, the bound.

    ``row`` and ``piece`` together are distinct. Ties of equal lengths are broken by the order of arrival: the
    packing differs between runs, the number of sequences only where best fit itself depends on it.
    """
    lengths = np.zeros(size + 1, dtype=np.int64)
    for length, n in pieces.groupBy("length").count().collect():  # at most ``size`` rows
        lengths[length] = n
    bound = lower_bound(lengths)
    settled, exchanged, used, spent = None, pieces, 0, 0
    for turn in range(ROUNDS):
        n = int(lengths.sum()) if turn == 0 else exchanged.count()
        table = _packed(exchanged, turn, max(1, -(-n // PIECES)), size)
        sequences, loose = table.where("offset = 0").agg(
            F.count(F.lit(1)), F.count(F.when(F.col("open"), 1))).first()
        if turn and sequences >= spent:
            break  # nothing saved: the sequences of the round before stay
        used += sequences - spent
        closed = table.where(~F.col("open"))
        settled = closed if settled is None else settled.unionByName(closed)
        exchanged, spent = table.where("open"), loose
        if used == bound or loose < 2:
            break
    return settled.unionByName(exchanged).drop("open"), used, bound


def pack_documents(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", size: int = 2048,
                   with_ids: bool = False) -> tuple[DataFrame, int, int]:
    """Pieces of all documents in sequences of at most ``size`` tokens, the number of sequences, its lower bound.

    Rows: the id, piece, start, length, ids_crc32, sequence_id, offset and, if asked for, ids (little-endian
    unsigned 32-bit numbers). A null or empty text is one token, its end. Repeated rows and null ids are packed
    like others, one piece or more for each row. An empty table gives no rows. Extra columns are ignored.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"),
                       F.monotonically_increasing_id().alias("row"))
    pieces = stored(pieces_of(rows, F.col("text"), tokenizer, size, with_ids=with_ids).drop("text"))
    packed, used, bound = pack_pieces(pieces, size)
    return packed.withColumnRenamed("id", id_col).drop("row"), used, bound


def sequences_of(packed: DataFrame) -> DataFrame:
    """(sequence_id, ids): the tokens of every sequence in order, from pieces packed with their ids."""
    parts = packed.groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "ids"))).alias("parts"))
    joined = F.aggregate("parts", F.lit(b""), lambda ids, p: F.concat(ids, p["ids"]))
    return parts.select("sequence_id", joined.alias("ids"))


def op11_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The place of every piece of every document."""
    import public_tokenizers

    packed, _, _ = pack_documents(documents(spark, sf_dir, "doc_id", "text"),
                                  public_tokenizers.path("word_bpe_49k.json"))
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


QUERIES = {"op11_packing": op11_packing}
ORACLES: dict[str, str] = {}
