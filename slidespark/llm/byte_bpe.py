"""Byte-level BPE: encoding by replaying the merges over the words of the whole corpus, and decoding.

The words (matches of the vocabulary's pattern) of all documents are counted (but for stretches of text that a task sees once),
so a word is encoded once, however often it occurs.  Replay: the distinct words of a task lie in one array of tokens; an inverted index leads from each mergeable
pair, known by the rank of what it becomes, to the places where it stands.  The pair of the least rank is merged at its places
from left to right; only the two neighbours of a place get new pairs.  A new pair of a lesser rank comes before the rest, so
the order of merges within each word is that of the definition, and a word of m bytes takes O(m log m) steps.

Codes of the most frequent words (at most `book_words` of them, with at most `book_bytes` bytes) are sent to the tasks; a task
replays the merges once for all other words that a batch brings.  Which words those are changes no result.  Texts do not move.

The pattern is matched once for each distinct stretch between single spaces: wherever one space stands between two characters
that are not blank, a match begins at it and none reaches over it (`at_spaces=False` for a pattern of which that is not true).

Defined results: null text is as empty text, which has no tokens; repeated rows give equal rows; null ids are kept; an empty
table gives no rows; other columns are not looked at; no text is a special token.  Bytes that are not UTF-8 are kept: each is
a character that is neither letter, digit nor blank.  An id that the vocabulary does not have is a ValueError in decode().
"""

from __future__ import annotations

import base64
import re
from array import array
from collections import Counter
from collections.abc import Iterator
from functools import cached_property
from heapq import heapify, heappop, heappush
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_map, id_text, most_frequent, pieces, release, staged

#: Most words and bytes of words whose codes are sent to every task, and most stretches that a worker remembers.
BOOK_WORDS, BOOK_BYTES, LEARNT = 1 << 17, 16 << 20, 1 << 18
#: Bytes, or number, of words that are replayed together.
REPLAY_BYTES, REPLAY_WORDS = 1 << 20, 1 << 17
#: A pair stands at many places if they are so many; after so many pairs in a row that do not, places are taken one by one.
MANY, SELDOM = 40, 20


#: Bits of an id within the number of a pair, and the rank of what is no pair.
SHIFT, NO_PAIR = 24, 1 << 24


class Vocabulary:
    """Tokens by id and ids by token.  The file has a token in base64 and its rank on each line."""

    def __init__(self, lines: bytes) -> None:
        self.ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines.splitlines() if line)}
        size = max(self.ranks.values()) + 1
        if size > NO_PAIR:
            raise ValueError("a vocabulary has fewer than 2^24 tokens")
        self.tokens: list[bytes | None] = [None] * size
        for token, rank in self.ranks.items():
            self.tokens[rank] = token
        self.bytes = np.array([self.ranks[bytes([b])] for b in range(256)], np.int64)

    @cached_property
    def arrow(self) -> pa.Array:
        return pa.array(self.tokens, pa.binary())

    @cached_property
    def pairs(self) -> dict[int, int]:
        """The rank of what each pair of tokens becomes, by the pair's number."""
        ranks = self.ranks
        return {ranks[t[:k]] << SHIFT | ranks[t[k:]]: rank for t, rank in ranks.items() for k in range(1, len(t)) if t[:k] in ranks and t[k:] in ranks}

    @cached_property
    def _sides(self) -> tuple[np.ndarray, ...]:
        """Pairs sorted by their left token and then the right, and the other way round: numbers and ranks of each."""
        number = np.fromiter(self.pairs, np.int64, len(self.pairs))
        rank = np.fromiter(self.pairs.values(), np.int64, len(self.pairs))
        other = (number & (1 << SHIFT) - 1) << SHIFT | number >> SHIFT
        a, b = np.argsort(number), np.argsort(other)
        return number[a], rank[a], other[b], rank[b]

    def _ranks(self, number: np.ndarray, rank: np.ndarray, one: int, others: np.ndarray) -> np.ndarray:
        first, last = np.searchsorted(number, (one << SHIFT, one + 1 << SHIFT))
        if first == last:
            return np.full(len(others), NO_PAIR, np.int64)
        own, wanted = number[first:last], others + (one << SHIFT)
        at = np.minimum(np.searchsorted(own, wanted), len(own) - 1)
        return np.where((own[at] == wanted) & (others >= 0), rank[first:last][at], NO_PAIR)

    def ranks_after(self, token: int, others: np.ndarray) -> np.ndarray:
        """Ranks of the pairs of a token with others behind it (negative ids are no tokens)."""
        return self._ranks(*self._sides[:2], token, others)

    def ranks_before(self, others: np.ndarray, token: int) -> np.ndarray:
        return self._ranks(*self._sides[2:], token, others)

    @cached_property
    def _two(self) -> np.ndarray:
        """Ranks of all pairs of bytes."""
        out = np.full((256, 256), NO_PAIR, np.int64)
        for token, rank in self.ranks.items():
            if len(token) == 2:
                out[token[0], token[1]] = rank
        return out

    def byte_pairs(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Ranks of pairs of the ids of bytes."""
        return self._two[self._byte_of[a], self._byte_of[b]]

    @cached_property
    def _byte_of(self) -> np.ndarray:
        out = np.zeros(len(self.tokens), np.int64)
        out[self.bytes] = np.arange(256)
        return out

    @classmethod
    def read(cls, spark: SparkSession, path: str) -> Vocabulary:
        """From a path on the driver, or one that Spark can open."""
        try:
            with open(path, "rb") as f:
                return cls(f.read())
        except FileNotFoundError:
            return cls(bytes(spark.read.format("binaryFile").load(path).first()["content"]))


def _enter(where: dict[int, list[np.ndarray]], order: list[int], ranks: np.ndarray, places: np.ndarray) -> None:
    """Enter the places of pairs into the index."""
    held = np.flatnonzero(ranks < NO_PAIR)
    if not len(held):
        return
    held = held[np.argsort(ranks[held], kind="stable")]
    ranks, places = ranks[held], places[held]
    cuts = np.flatnonzero(ranks[1:] != ranks[:-1]) + 1
    for r, part in zip(ranks[np.concatenate([[0], cuts])].tolist(), np.split(places, cuts), strict=True):
        if r in where:
            where[r].append(part)
        else:
            where[r] = [part]
            heappush(order, r)


def _merge_many(vocabulary: Vocabulary, state: tuple, word: np.ndarray, where: dict[int, list[np.ndarray]], order: list[int]) -> None:
    """Merge pair after pair, all places of one at once, for as long as pairs stand at many places.

    Of places that overlap, every other one is merged, from the left.  If a merge makes a pair of a lesser rank, the places
    behind it in its word wait for that one.
    """
    ids, ranks, left, right = state
    seldom = 0
    while order and seldom < SELDOM:
        r = heappop(order)
        p = np.unique(np.concatenate(where.pop(r)))
        p = p[ranks[p] == r]
        if not len(p):
            continue
        seldom = seldom + 1 if len(p) < MANY else 0
        gone = right[p]
        touch = np.concatenate([[False], p[1:] == gone[:-1]])
        if touch.any():
            run = np.maximum.accumulate(np.where(touch, 0, np.arange(len(p))))
            p = p[(np.arange(len(p)) - run) % 2 == 0]
            gone = right[p]
        after, before = right[gone], left[p]
        # as one merge after the other sees them: what is ahead is merged already, what is behind is not
        ahead = np.where(np.concatenate([[False], after[:-1] == p[1:]]), r, ids[before])
        early = (vocabulary.ranks_after(r, ids[after]) < r) | (vocabulary.ranks_before(ahead, r) < r)
        if early.any():
            at = np.flatnonzero(early)
            own, first = np.unique(word[p[at]], return_index=True)
            k = np.minimum(np.searchsorted(own, word[p]), len(own) - 1)
            wait = (own[k] == word[p]) & (np.arange(len(p)) > at[first][k])
            if wait.any():
                where[r] = [p[wait]]
                heappush(order, r)
                p, gone, after, before = (v[~wait] for v in (p, gone, after, before))
        ids[p], ids[gone], ranks[gone] = r, -2, NO_PAIR
        right[p], left[after] = after, p
        # only the pairs with the two neighbours are new
        ranks[p] = vocabulary.ranks_after(r, ids[after])
        behind = before[ids[before] >= 0]
        ranks[behind] = vocabulary.ranks_before(ids[behind], r)
        fresh = np.concatenate([p, behind])
        _enter(where, order, ranks[fresh], fresh)


def _merge_few(pairs: dict[int, int], ids: list[int], ranks: list[int], left: list[int], right: list[int], where: dict[int, list[int]], order: list[int]) -> np.ndarray:
    """The same, place by place."""
    get = pairs.get
    while order:
        r = heappop(order)
        places = where.pop(r)
        places.sort()
        for i, p in enumerate(places):
            if ranks[p] != r:  # a neighbour was merged since
                continue
            gone = right[p]
            after, before = right[gone], left[p]
            ids[p], ids[gone], ranks[gone] = r, -2, NO_PAIR
            right[p], left[after] = after, p
            least = r
            b = ids[after]
            k = ranks[p] = get(r << SHIFT | b, NO_PAIR) if b >= 0 else NO_PAIR
            if k < NO_PAIR:
                if k in where:
                    where[k].append(p)
                else:
                    where[k] = [p]
                    heappush(order, k)
                if k < least:
                    least = k
            a = ids[before]
            if a >= 0:
                k = ranks[before] = get(a << SHIFT | r, NO_PAIR)
                if k < NO_PAIR:
                    if k in where:
                        where[k].append(before)
                    else:
                        where[k] = [before]
                        heappush(order, k)
                    if k < least:
                        least = k
            if least < r:  # a pair that comes before the rest of this one
                if i + 1 < len(places):
                    where[r] = places[i + 1 :]
                    heappush(order, r)
                break
    return np.array(ids, np.int64)


def _replay(words: list[bytes], vocabulary: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """How many token ids each word has, and all of them one after the other.

    All words lie in one array of ids, a stop (-1) before each and one at the end; left and right lead to the neighbours that
    are still there, ranks has the rank of the pair that begins at each place.
    """
    whole = [vocabulary.ranks.get(w, -1) for w in words]
    rest = [w for w, r in zip(words, whole, strict=True) if r < 0]
    lengths = np.fromiter(map(len, rest), np.int64, len(rest))
    stops = np.append(np.cumsum(lengths + 1) - lengths - 1, lengths.sum() + len(rest))
    first = np.full(int(stops[-1]) + 1, -1, np.int64)
    inside = np.ones(len(first), bool)
    inside[stops] = False
    first[inside] = vocabulary.bytes[np.frombuffer(b"".join(rest), np.uint8)]
    begin = np.full(len(first), NO_PAIR, np.int64)
    both = np.flatnonzero(inside[:-1] & inside[1:])
    begin[both] = vocabulary.byte_pairs(first[both], first[both + 1])
    places = np.arange(len(first))
    state = first, begin, places - 1, places + 1
    where: dict[int, list[np.ndarray]] = {}
    order: list[int] = []
    _enter(where, order, begin[both], both)
    _merge_many(vocabulary, state, np.cumsum(~inside), where, order)
    # what is left lies closer together from here on
    left = np.flatnonzero(first >= -1)
    place = np.zeros(len(first) + 1, np.int64)
    place[left], place[-1] = np.arange(len(left)), len(left)
    index = {r: place[np.concatenate(v)].tolist() for r, v in where.items()}
    done = _merge_few(vocabulary.pairs, first[left].tolist(), begin[left].tolist(), list(range(-1, len(left) - 1)), list(range(1, len(left) + 1)), index, order)
    stops = place[stops]
    kept = np.concatenate([[0], np.cumsum(done >= 0)])
    sizes = kept[stops[1:]] - kept[stops[:-1]]
    # words that are tokens as they are take their places between the others
    whole = np.array(whole, np.int64)
    known = whole >= 0
    every = np.ones(len(words), np.int64)
    every[~known] = sizes
    flat = np.empty(int(every.sum()), np.int32)
    own = np.repeat(known, every)
    flat[own] = whole[known]
    flat[~own] = done[done >= 0]
    return every, flat


def replay(words: list[bytes], vocabulary: Vocabulary) -> list[list[int]]:
    """Token ids of each word."""
    sizes, flat = _replay(words, vocabulary)
    return [part.tolist() for part in np.split(flat, np.cumsum(sizes)[:-1])] if words else []


def _chars(text: bytes) -> str:
    return text.decode("utf-8", "surrogateescape")


def _bytes(word: str) -> bytes:
    return word.encode("utf-8", "surrogateescape")


#: A single space between two characters that are not blank, and the blanks other than spaces.
_CUT = re.compile(r"(?<=\S) (?=\S)")
_OTHER_BLANKS = [chr(k) for k in range(0x3001) if chr(k).isspace() and k != 32]


def stretches(text: str, at_spaces: bool = True) -> list:
    """The text cut before single spaces: its first stretch in a tuple, the others without their space."""
    if not at_spaces:
        return [(text,)]
    apart = "  " not in text and text[:1] != " " and text[-1:] != " " and not any(c in text and (c + " " in text or " " + c in text) for c in _OTHER_BLANKS)
    parts = text.split(" ") if apart else _CUT.split(text)
    parts[0] = (parts[0],)
    return parts


def _words(find, found: list) -> tuple[list[str], np.ndarray]:
    """The words of many stretches one after the other, and how many each has."""
    plain = [s for s in found if isinstance(s, str) and " " not in s]
    # put together again they are a text of which each word with a space ahead begins a stretch
    out = find(" " + " ".join(plain)) if plain else []
    begins = np.fromiter((w[0] == " " for w in out), bool, len(out))
    sizes = iter(np.diff(np.append(np.flatnonzero(begins), len(out))).tolist())
    if len(plain) == len(found):
        return out, np.fromiter(sizes, np.int64, len(plain))
    words, count, at = [], [], 0
    for s in found:
        if isinstance(s, str) and " " not in s:
            n = next(sizes)
            words += out[at : at + n]
            at += n
        else:
            own = find(" " + s if isinstance(s, str) else s[0])
            n = len(own)
            words += own
        count.append(n)
    return words, np.array(count, np.int64)


def _count(pattern: str, at_spaces: bool, held: int, least: int = 1):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find, seen = regex.compile(pattern).findall, Counter()

        def flush() -> pa.RecordBatch:
            found: Counter = Counter()
            often = {s: n for s, n in seen.items() if n >= least}
            every, sizes = _words(find, list(often))
            for word, n in zip(every, np.repeat(np.fromiter(often.values(), np.int64, len(often)), sizes).tolist(), strict=True):
                found[word] += n
            seen.clear()
            return pa.RecordBatch.from_arrays([pa.array(map(_bytes, found), pa.binary()), pa.array(found.values(), pa.int64())], ["word", "n"])

        for b in pieces(batches):
            for text in b.column(0).to_pylist():
                seen.update(stretches(_chars(text), at_spaces))
            if len(seen) > held:
                yield flush()
        if seen:
            yield flush()

    return run


def words(docs: DataFrame, pattern: str, at_spaces: bool = True, held: int = 1 << 18, least: int = 1) -> DataFrame:
    """word, n: the distinct words of all texts and how often each occurs.  A task sums up as many as `held` stretches; of these,
    stretches that it has seen fewer than `least` times are left out."""
    return arrow_map(id_text(docs).select("text"), _count(pattern, at_spaces, held, least), "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def _replay_words(vocabulary):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, REPLAY_BYTES, "word"):
            sizes, flat = _replay(b.column(0).to_pylist(), vocabulary.value)
            codes = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), pa.array(flat))
            yield pa.RecordBatch.from_arrays([*b.columns, codes], ["word", "n", "ids"])

    return run


def codebook(counted: DataFrame, vocabulary) -> DataFrame:
    """word, n, ids for every row of words(); vocabulary is a broadcast one."""
    return arrow_map(counted.select("word", "n"), _replay_words(vocabulary), "word binary, n long, ids array<int>")


class _Numbers(dict):
    """Numbers of stretches; one that is not there gets the next number and is noted as new."""

    def __init__(self) -> None:
        super().__init__()
        self.new: list = []

    def __missing__(self, stretch) -> int:
        self[stretch] = number = len(self)
        self.new.append(stretch)
        return number


class _Codes:
    """Codes of stretches as rows of one flat array; made from the codes of words, which are the book's or replayed."""

    def __init__(self, vocabulary: Vocabulary, pattern: str, words: list[bytes], size: np.ndarray, flat: np.ndarray) -> None:
        self.vocabulary, self.find = vocabulary, regex.compile(pattern).findall
        self.book = dict(zip(map(_chars, words), range(len(words)), strict=True))
        self.book_size, self.book_start, self.book_flat = size, np.cumsum(size) - size, flat
        self._clear()

    def _clear(self) -> None:
        self.number = _Numbers()
        self.size, self.start, self.flat = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32)

    def _learn(self) -> None:
        every, counts = _words(self.find, self.number.new)
        self.number.new.clear()
        other = list(dict.fromkeys(w for w in every if w not in self.book))
        size, flat = [self.book_size], [self.book_flat]
        for k in range(0, len(other), REPLAY_WORDS):
            own = _replay(list(map(_bytes, other[k : k + REPLAY_WORDS])), self.vocabulary)
            size.append(own[0])
            flat.append(own[1])
        number = dict(zip(other, range(len(self.book), len(self.book) + len(other)), strict=True))
        size, flat = np.concatenate(size), np.concatenate(flat)
        rows = np.fromiter((self.book[w] if w in self.book else number[w] for w in every), np.int64, len(every))
        ends, at = _gather(np.cumsum(size) - size, size, rows)
        cuts = ends[np.concatenate([[0], np.cumsum(counts)])]
        self.start = np.concatenate([self.start, len(self.flat) + cuts[:-1]])
        self.size = np.concatenate([self.size, np.diff(cuts)])
        self.flat = np.concatenate([self.flat, flat[at]])

    def ids(self, texts: list[list]) -> pa.Array:
        """Token ids of each list of stretches."""
        if len(self.number) > LEARNT or len(self.flat) > BOOK_BYTES:
            self._clear()
        counts = np.fromiter(map(len, texts), np.int64, len(texts))
        rows = np.fromiter(map(self.number.__getitem__, chain.from_iterable(texts)), np.int64, int(counts.sum()))
        if self.number.new:
            self._learn()
        ends, at = _gather(self.start, self.size, rows)
        return pa.ListArray.from_arrays(pa.array(ends[np.concatenate([[0], np.cumsum(counts)])], pa.int32()), pa.array(self.flat[at], pa.int32()))


def _gather(start: np.ndarray, size: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each of the rows ends when they follow each other (with a 0 ahead), and where their parts lie."""
    ends = np.concatenate([[0], np.cumsum(size[rows])])
    return ends, np.repeat(start[rows] - ends[:-1], size[rows]) + np.arange(ends[-1])


#: The book that this worker has used last, and its codes.
_held: list = [None, None]


def _encode(pattern: str, at_spaces: bool, vocabulary, book, decoded: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if _held[0] is not book.value:
            _held[:] = book.value, _Codes(vocabulary.value, pattern, *book.value)
        codes = _held[1]
        for b in pieces(batches):
            ids = codes.ids([stretches(_chars(t), at_spaces) for t in b.column(1).to_pylist()])
            more = [_bytes_of(ids, vocabulary.value)] if decoded else []
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()), ids, *more], ["doc_id", "ids", *["decoded"] * decoded])

    return run


def _book(rows: Iterator) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """Words, how many ids each has, and all of them."""
    words, size, flat = [], array("q"), array("i")
    for word, ids in rows:
        words.append(bytes(word))
        size.append(len(ids))
        flat.extend(ids)
    return words, np.array(size, np.int64), np.array(flat, np.int32)


def encode(docs: DataFrame, path: str, pattern: str, decoded: bool = False, at_spaces: bool = True, book_words: int = BOOK_WORDS, book_bytes: int = BOOK_BYTES) -> DataFrame:
    """doc_id, ids for every row of docs (module docstring).  path: the vocabulary's ranks; pattern: what cuts texts into words;
    decoded: also what the ids are decoded to, by the same tasks."""
    spark = docs.sparkSession
    vocabulary = spark.sparkContext.broadcast(Vocabulary.read(spark, path))
    # a stretch that a task sees once is replayed there, if its words are not in the book anyway
    counted = staged(words(docs, pattern, at_spaces, least=2), "words")
    n, size = counted.agg(F.count(F.lit(1)), F.sum(F.length("word"))).first()
    head = counted
    if n > book_words or (size or 0) > book_bytes:
        # words of up to 64 bytes, so that book_bytes holds whatever the words are
        head = most_frequent(counted.where(F.length("word") <= 64), "n", min(book_words, book_bytes // 64))
    coded = staged(codebook(head.repartition("word"), vocabulary), "codebook")
    book = spark.sparkContext.broadcast(_book(coded.select("word", "ids").toLocalIterator()))
    release(counted, coded)
    return arrow_map(id_text(docs), _encode(pattern, at_spaces, vocabulary, book, decoded), "doc_id long, ids array<int>" + ", decoded binary" * decoded)


def _bytes_of(ids: pa.Array, vocabulary: Vocabulary) -> pa.Array:
    """What lists of ids stand for."""
    flat, known = ids.flatten(), vocabulary.arrow
    seen = np.asarray(flat)
    if len(seen) and (seen.min() < 0 or seen.max() >= len(known)):
        raise ValueError("an id that the vocabulary does not have")
    found = known.take(flat)
    if found.null_count:
        raise ValueError("an id that the vocabulary does not have")
    # the bytes of the tokens follow each other already; only the ends of rows are needed
    ends = np.frombuffer(found.buffers()[1], np.int32)[found.offset : found.offset + len(found) + 1]
    sizes = np.asarray(pc.fill_null(pc.list_value_length(ids), 0), np.int64)
    cuts = ends[np.concatenate([[0], np.cumsum(sizes)])] if len(found) else np.zeros(len(ids) + 1, np.int32)
    return pa.Array.from_buffers(pa.binary(), len(ids), [None, pa.py_buffer(np.ascontiguousarray(cuts, np.int32)), found.buffers()[2]])


def _decode(vocabulary):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, _bytes_of(b.column(b.schema.get_field_index("ids")), vocabulary.value)], [*b.schema.names, "decoded"])

    return run


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """The rows of encode(), or any with a column ids, and what the ids stand for as `decoded` (null ids: empty)."""
    vocabulary = encoded.sparkSession.sparkContext.broadcast(Vocabulary.read(encoded.sparkSession, path))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in encoded.schema)
    return arrow_map(encoded, _decode(vocabulary), f"{fields}, decoded binary")
