"""Lexical retrieval packing.

Documents are tokenised and packed into windows of WINDOW tokens so that a window holds lexically close
documents. They are first brought together from all input partitions in order of a sketch, the three
smallest hashes of their words, and then read in shards of about SHARD_CHARS characters; each shard has its
own BM25 inverted index. A seed document opens a window; the index returns its best unused neighbours by all
of its terms, which fill the window in order of score. A document that overflows is cut there, and its rest
is the next window's seed. A shard's last window is cut into powers of two, which need no padding. The order
is dealt by ranges that end in the row's number, so no key or source can outgrow a task. It finds only part
of the neighbours that one index of all documents would (README).
"""

from __future__ import annotations

import gc
import unicodedata
import zlib
from collections import defaultdict
from collections.abc import Callable, Iterator
from itertools import chain, count, islice

import numpy as np
import pandas as pd
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WINDOW = 2048
END_ID = 1
SHARD_CHARS = 4_000_000
#: Rows a partition that the bounds of ranges are taken from.
SAMPLE = 100
NEIGHBOURS = 8
#: Terms past which a seed counts as long in the tests; retrieval uses all terms.
QUERY_TERMS = 12
K1, B = 1.2, 0.75
#: Words whose ids a worker keeps; past that it forgets them all and starts over. Parts of words likewise.
CACHE = 700_000
SCHEMA = "doc_id long, start long, length long, ids array<int>, doc_tokens long, sequence_id long, offset long"


class CachedTokenizer:
    """A `tokenizers` file's ids for whole texts, by way of its ids for their distinct words.

    For vocabularies whose words end in "</w>" and whose text is split at white space: a text's ids are the
    ids of its words in order. Words of common scripts are cut by the file's own pattern, lower-cased, and
    their parts encoded many at a time; all others are encoded as they stand.
    """

    _parts = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+|\n")  # the tokenizer file's pattern, a fixed value
    # the public byte-level alphabet: bytes that print stand for themselves, the others for 256 onwards in order
    _bytes = dict(zip((c for c in range(256) if not (33 <= c <= 126 or 161 <= c <= 172 or c >= 174)), count(256)))
    _plain = regex.compile("[\n\x21-\x7e\xa1-\xac\xae-įı-ž]+")

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.lib = Tokenizer.from_file(path)
        self.forget_pieces()
        self.forget()

    def forget(self) -> None:
        self.number: defaultdict[str, int] = defaultdict(count().__next__)  # of each word, in order of first sight
        self.start, self.length, self.ids = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, "<u4")

    def forget_pieces(self) -> None:
        # of each part of a word; a line feed is the first one and has no ids
        self.pieces: dict[str, int] = {"\n": 0}
        self.piece_start, self.piece_length, self.piece_ids = np.zeros(1, np.int64), np.zeros(1, np.int64), np.zeros(0, "<u4")

    def whole(self, text: str) -> bytes:
        return np.array(self.lib.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def learn(self, pieces: list[str]) -> None:
        """Number new parts of words and keep their ids, by the file's merges alone: they need no more cutting."""
        tokenize = self.lib.model.tokenize
        ids: list[int] = []
        ends = []
        for p in pieces:
            ids += [t.id for t in tokenize(p if p.isascii() else p.encode().decode("latin-1").translate(self._bytes))]
            ends.append(len(ids))
        upto = np.array(ends, np.int64)
        self.pieces.update(zip(pieces, range(len(self.pieces), len(self.pieces) + len(pieces))))
        self.piece_start = np.concatenate([self.piece_start, len(self.piece_ids) + np.r_[0, upto[:-1]]])
        self.piece_length = np.concatenate([self.piece_length, np.diff(upto, prepend=0)])
        self.piece_ids = np.concatenate([self.piece_ids, np.array(ids, "<u4")])

    def encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start and length of each word's ids in an array of ids, and that array."""
        start, length = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64)
        joined = "\n".join(words)
        odd: list[int] = []
        if words and ("<|" in joined or not self._plain.fullmatch(joined) or joined.count("\n") >= len(words)):
            odd = [k for k, w in enumerate(words) if "\n" in w or "<|" in w or not self._plain.fullmatch(w)]
        even = np.setdiff1d(np.arange(len(words)), odd) if odd else np.arange(len(words))
        if odd:
            joined = "\n".join([words[k] for k in even.tolist()])
        ids = np.zeros(0, "<u4")
        if len(even):
            # one pass of the pattern over all words; a line feed is a part of its own, has no ids and ends a word
            parts = self._parts.findall((joined if joined.isascii() else unicodedata.normalize("NFC", joined)).lower() + "\n")
            new = [p for p in set(parts) if p not in self.pieces]
            if new:
                self.learn(new)
            numbers = np.fromiter(map(self.pieces.__getitem__, parts), np.int64, len(parts))
            ends = np.cumsum(self.piece_length[numbers])[numbers == 0]
            start[even], length[even] = np.r_[0, ends[:-1]], np.diff(ends, prepend=0)
            ids = gather(numbers, self.piece_start, self.piece_length, self.piece_ids)[:-1]
            if len(self.pieces) > CACHE:
                self.forget_pieces()
        if odd:
            raw = [self.whole(words[k]) for k in odd]
            sizes = np.array([len(r) // 4 for r in raw])
            start[odd], length[odd] = len(ids) + np.cumsum(sizes) - sizes, sizes
            ids = np.concatenate([ids, np.frombuffer(b"".join(raw), "<u4")])
        return start, length, ids

    def shard(self, texts: list[str]) -> tuple[list[np.ndarray], np.ndarray, np.ndarray, np.ndarray]:
        """Word numbers of each text; start and length of each word's ids, and all ids."""
        if len(self.number) > CACHE:
            self.forget()
        split = [[t] if any(c in t for c in "\x1c\x1d\x1e\x1f") else t.split() for t in texts]
        before = len(self.number)
        numbers = np.fromiter(map(self.number.__getitem__, chain.from_iterable(split)), np.int32)
        start, length, ids = self.encode_words(list(islice(reversed(self.number), len(self.number) - before))[::-1])
        self.start = np.concatenate([self.start, len(self.ids) + start])
        self.length = np.concatenate([self.length, length])
        self.ids = np.concatenate([self.ids, ids])
        return np.split(numbers, np.cumsum([len(s) for s in split])[:-1]), self.start, self.length, self.ids


def gather(words: np.ndarray, start: np.ndarray, length: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """The ids of a text, with the end id after them."""
    n = length[words]
    total = int(n.sum())
    out = np.empty(total + 1, "<u4")
    ends = np.cumsum(n)
    out[:total] = ids[np.repeat(start[words] - (ends - n), n) + np.arange(total)]
    out[total] = END_ID
    return out


class Bm25:
    """Inverted index of one shard: postings by term with their BM25 weights."""

    def __init__(self, docs: list[np.ndarray]):
        self.n = len(docs)
        sizes = np.array([len(d) for d in docs], np.int64)
        key = np.concatenate(docs).astype(np.int64) * self.n + np.repeat(np.arange(self.n), sizes) if self.n else np.zeros(0, np.int64)
        key, tf = np.unique(key, return_counts=True)
        term, doc = np.divmod(key, max(self.n, 1))
        term = np.cumsum(np.r_[False, np.diff(term) != 0][: len(term)])  # numbered within the shard
        n_terms = int(term[-1]) + 1 if len(term) else 0
        self.df = np.bincount(term, minlength=n_terms)
        self.idf = np.log1p((self.n - self.df + 0.5) / (self.df + 0.5))
        shared = self.df[term] > 1  # a term of one document leads to no other
        term, doc, tf = term[shared], doc[shared].astype(np.int32), tf[shared]
        norm = K1 * (1 - B + B * sizes / max(sizes.mean() if self.n else 1, 1))
        self.weight = self.idf[term] * tf * (K1 + 1) / (tf + norm[doc])
        self.doc = doc
        self.at = np.searchsorted(term, np.arange(n_terms + 1))
        order = np.argsort(doc, kind="stable")
        self.by_doc = term[order]
        self.doc_at = np.searchsorted(doc[order], np.arange(self.n + 1))

    def neighbours(self, seed: int, used: np.ndarray, k: int = NEIGHBOURS) -> list[int]:
        """The best unused documents for all of the seed's terms, best first; ties by position."""
        terms = self.by_doc[self.doc_at[seed] : self.doc_at[seed + 1]]
        if not len(terms):
            return []
        first, n = self.at[terms], self.df[terms]
        ends = np.cumsum(n)
        at = np.repeat(first - (ends - n), n) + np.arange(ends[-1])
        score = np.bincount(self.doc[at], self.weight[at], self.n)
        score[used] = 0
        found = np.flatnonzero(score > 0)
        if len(found) > k:
            least = np.partition(score[found], -k)[-k]
            found = found[score[found] >= least]
        return found[np.lexsort((found, -score[found]))][:k].tolist()


def order_and_cut(sizes: np.ndarray, index: Bm25, window: int = WINDOW) -> list[tuple[int, int, int, int, int]]:
    """Pieces (document, start, length, sequence, offset) that hold every token of the shard once."""
    used = np.zeros(len(sizes), bool)
    pieces: list[tuple[int, int, int, int, int]] = []
    seq, room, unused = 0, window, 0
    queue: list[int] = []
    seed = -1
    while True:
        doc = next((q for q in queue if not used[q]), -1)
        if doc < 0:
            queue = index.neighbours(seed, used) if seed >= 0 else []
            doc = queue[0] if queue else -1
        if doc < 0:
            while unused < len(sizes) and used[unused]:
                unused += 1
            if unused == len(sizes):
                break
            doc = unused
        used[doc] = True
        if room == window:
            seed, queue = doc, []
        at = 0
        while at < sizes[doc]:
            take = min(room, int(sizes[doc]) - at)
            pieces.append((doc, at, take, seq, window - room))
            at, room = at + take, room - take
            if not room:
                seq, room = seq + 1, window
                seed, queue = doc, []  # its rest, if any, opens the next window; else the next seed is its best neighbour
    # the last, open window: one sequence for each power of two in its length
    filled = window - room
    if filled and room:
        parts = [1 << b for b in range(filled.bit_length() - 1, -1, -1) if filled >> b & 1]
        tail = [p for p in pieces if p[3] == seq]
        pieces = [p for p in pieces if p[3] != seq]
        left = parts.pop(0)
        size = left
        for doc, at, length, _, _ in tail:
            while length:
                take = min(length, left)
                pieces.append((doc, at, take, seq, size - left))
                at, length, left = at + take, length - take, left - take
                if not left and parts:
                    left = size = parts.pop(0)
                    seq += 1
    return pieces


def by_sketch(docs: DataFrame) -> DataFrame:
    """docs (i, t) in ranges of the smallest hashes of their texts' words, whichever partitions they come from.

    A row's key is the smallest hash's upper half, 16 bits of the next two, and 16 bits of its row number, so
    that texts with equal hashes can still be dealt to several partitions. The ranges' bounds are quantiles of
    a sample of rows (SAMPLE a partition); all rows are dealt.
    """
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    hashes = F.transform(F.split(F.lower("t"), "[ \n\r\t]"), lambda w: F.xxhash64(w))
    rows = docs.select("i", "t", F.monotonically_increasing_id().alias("n"))

    def keyed(some: DataFrame) -> DataFrame:
        some = some.withColumn("h", hashes).withColumn("k0", F.array_min("h"))
        some = some.withColumn("k1", F.array_min(F.array_remove("h", F.col("k0"))))
        some = some.withColumn("k2", F.array_min(F.array_remove(F.array_remove("h", F.col("k0")), F.col("k1"))))
        key = F.col("k0").bitwiseAND(F.lit(~0xFFFFFFFF)).bitwiseOR(F.shiftleft(F.xxhash64("k1", "k2").bitwiseAND(F.lit(0xFFFF)), 16)).bitwiseOR(F.xxhash64("n").bitwiseAND(F.lit(0xFFFF)))
        return some.select("i", "t", F.coalesce(key, F.xxhash64("n")).alias("key"))

    total = rows.count()
    share = min(1.0, SAMPLE * n / max(total, 1))
    cuts = keyed(rows.sample(share, 3)).agg(F.percentile_approx("key", F.array(*[F.lit(k / n) for k in range(1, n)]), 20 * n)).first()[0] if n > 1 and total else None
    steps = F.array(*[F.lit(1 << k) for k in range(n.bit_length(), -1, -1)])
    have = F.split(F.lit(",".join(map(str, cuts or []))), ",").cast("array<long>")
    step = lambda p, s: F.when((p + s < n) & (F.get(have, p + s - 1) < F.col("key")), p + s).otherwise(p)
    place = F.aggregate(steps, F.lit(0), step) if cuts else F.lit(0)
    return keyed(rows).withColumn("place", place).repartitionById(n, "place").sortWithinPartitions("key").select("i", "t")


_loaded: dict[str, CachedTokenizer] = {}


def pack(docs: DataFrame, tokenizer: str, *, text: str = "text", id_col: str = "doc_id", window: int = WINDOW, shard_chars: int = SHARD_CHARS, emit: Callable[[pd.DataFrame], pd.DataFrame] | None = None, schema: str = SCHEMA) -> DataFrame:
    """Pieces (SCHEMA) of all documents: each document's ids and END_ID, each id in exactly one piece.

    tokenizer: path of a `tokenizers` file, present on every executor. A null text is empty and has the
    end id alone. Rows that repeat, or repeat an id, are packed each. An empty table gives no rows; other
    columns are ignored. A text longer than a shard is a shard of its own. emit, with the schema of what it
    returns, turns frames of pieces into others before they leave the worker.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tok = _loaded.get(tokenizer) or _loaded.setdefault(tokenizer, CachedTokenizer(tokenizer))
        sequences = (TaskContext.get().partitionId() if TaskContext.get() else 0) << 32

        def shard(ids: list[int], texts: list[str]) -> Iterator[pd.DataFrame]:
            nonlocal sequences
            gc.disable()  # a shard's many lists and tokens hold no cycles; looking for some costs a quarter of its time
            try:
                words, start, length, pool = tok.shard(texts)
                sizes = np.array([int(length[w].sum()) + 1 for w in words], np.int64)
                pieces = order_and_cut(sizes, Bm25(words), window)
            finally:
                gc.enable()
            whole: dict[int, np.ndarray] = {}
            for k in range(0, len(pieces), 4096):
                some = pieces[k : k + 4096]
                out = []
                for doc, at, n, seq, offset in some:
                    tokens = whole.get(doc)
                    if tokens is None:
                        tokens = whole[doc] = gather(words[doc], start, length, pool)
                    if at + n == sizes[doc]:
                        del whole[doc]
                    out.append((ids[doc], at, n, tokens[at : at + n].view(np.int32), sizes[doc], sequences + seq, offset))
                yield emit(pd.DataFrame(out, columns=_names)) if emit else pd.DataFrame(out, columns=_names)
            sequences += pieces[-1][3] + 1

        held_ids: list[int] = []
        held: list[str] = []
        chars = 0
        for pdf in batches:
            for i, t in zip(pdf["i"], pdf["t"]):
                held_ids.append(i)
                held.append(t or "")
                chars += len(held[-1])
                if chars >= shard_chars:
                    yield from shard(held_ids, held)
                    held_ids, held, chars = [], [], 0
        if held:
            yield from shard(held_ids, held)

    return by_sketch(docs.select(F.col(id_col).alias("i"), F.col(text).alias("t"))).mapInPandas(run, schema)


_names = [c.split()[0] for c in SCHEMA.split(", ")]


DIGEST = "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, ids_crc32 long"


def crc32_ids(pieces: pd.DataFrame) -> pd.DataFrame:
    """For emit: ids_crc32, the unsigned crc32 of a piece's ids as little-endian 32-bit numbers, in place of ids."""
    return pieces.drop(columns="ids").assign(ids_crc32=[zlib.crc32(x.astype("<i4").tobytes()) for x in pieces["ids"]])
