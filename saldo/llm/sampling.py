"""SentencePiece encoding and decoding, with Gumbel top-k sampling of segmentations without replacement.

A text's lattice has a node between any two characters and an arc for every vocabulary piece. Arcs weigh
alpha times their piece's log-probability, which is taken from the piece's rank by Zipf's law (the model
file's scores are merge ranks). As no piece crosses from a character to a blank, the lattice falls apart
into words; backward sums over a word's lattice give every arc its probability given its node.

Sampling is A-star search on perturbed log-probabilities: the root gets one Gumbel variable; a node hands
its value to one child and lower, conditioned values to the others, so a node's value is the largest of
all segmentations below it. The best open node is followed to a leaf, which is the next sample, while its
siblings on the way stay open. Popping k leaves gives k distinct segmentations in order of their perturbed
values: a sample without replacement. Only the best k open nodes of a text can still be popped, so no
others are kept. The best value still open after k leaves is the threshold kappa, and a sample's inclusion
score is P(Gumbel(log p) > kappa), given as its logarithm. Noise is a hash of the row's key, the sample and
the place in the lattice, so results depend on neither batches nor partitions.

All steps are numpy over the words of a batch of texts at once: every word advances by one arc per step.
"""

from __future__ import annotations

import re
import zlib
from collections import defaultdict
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import chain, count, islice

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SAMPLES = 2
ALPHA = 1.0
#: Zipf-Mandelbrot offset of the ranks.
ZIPF = 2.7
SPACE = "▁"
ABSENT, PREFIX = -1, -2
BATCH_CHARS = 200_000
#: Arcs of word lattices that a worker keeps; past that it forgets all words and starts over.
CACHE_ARCS = 13_000_000
SCHEMA = "doc_id long, sample int, ids array<int>, log_prob double, perturbed double, log_inclusion double"

_word = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")
#: Siblings are looked for among nodes whose prefix has a probability above e^-DEEP, given the place the path
#: starts from. One further on is among the best only with a probability of that order, far below what the
#: noise's 53 bits can tell; deep=None looks at all.
DEEP = 60.0
_STEP = np.uint64(0x2545F4914F6CDD1D)
_DEPTH = 0xD1342543DE82EF95
_MIX = np.uint64(0x9E3779B97F4A7C15)


def _hash(x: np.ndarray) -> np.ndarray:
    """A 64-bit mixing function (splitmix64), in place."""
    x *= _MIX
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _gumbel(x: np.ndarray) -> np.ndarray:
    u = (_hash(x) >> np.uint64(11)).astype(np.float64)
    u += 0.5
    u *= 2.0**-53
    np.log(u, out=u)
    np.negative(u, out=u)
    np.log(u, out=u)
    return np.negative(u, out=u)


def _words(text: str) -> list[str]:
    """The words of a text, each without its first blank."""
    if SPACE not in text and "  " not in text and text[0] != " " != text[-1]:
        return text.split(" ")
    return [w[1:] for w in _word.findall((SPACE + text).replace(" ", SPACE))]


_ramps = [np.zeros(0, np.int64), np.zeros(0, np.uint64)]


def _ramp(n: int) -> tuple[np.ndarray, np.ndarray]:
    """0 to n - 1, and the same times _STEP; views of arrays that are kept."""
    if len(_ramps[0]) < n:
        _ramps[0] = np.arange(2 * n)
        _ramps[1] = _ramps[0].astype(np.uint64) * _STEP
    return _ramps[0][:n], _ramps[1][:n]


class Vocabulary:
    """Pieces of a SentencePiece file by a hash of their code points, and the log-probability of each id."""

    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        self.sp = sp
        self.bytes = [b""] * n
        byte_id = np.zeros(256, np.int32)
        normal: list[tuple[str, int]] = []
        for i in range(n):
            piece = sp.id_to_piece(i)
            if sp.is_byte(i):
                byte_id[int(piece[1:-1], 16)] = i
                self.bytes[i] = bytes([int(piece[1:-1], 16)])
            elif not (sp.is_control(i) or sp.is_unknown(i)):
                normal.append((piece, i))
                self.bytes[i] = piece.replace(SPACE, " ").encode()
        if any(SPACE in p.lstrip(SPACE) for p, _ in normal):
            raise ValueError("a piece goes on from a character to a blank; words can't be cut there")
        self.byte_id = byte_id
        self.log_prob = np.full(n, -np.log(n + ZIPF))
        for rank, (_, i) in enumerate(normal):
            self.log_prob[i] = -np.log(rank + 1 + ZIPF)
        self.log_prob -= np.log(np.exp(self.log_prob).sum())
        self.longest = max(len(p) for p, _ in normal)
        entry = dict.fromkeys((p[:k] for p, _ in normal for k in range(1, len(p))), PREFIX) | dict(normal)
        size = 1 << (4 * len(entry)).bit_length()
        self.mask = np.uint64(size - 1)
        self.slot_hash, self.slot_id = np.zeros(size, np.uint64), np.full(size, ABSENT, np.int32)
        hashes = {p: self.piece_hash(p) for p in entry}
        if len(set(hashes.values())) < len(hashes):
            raise ValueError("two pieces share a hash")
        self.most_probes = 1
        for p, i in entry.items():
            at, k = hashes[p] & (size - 1), 1
            while self.slot_id[at] != ABSENT:
                at, k = (at + 1) & (size - 1), k + 1
            self.slot_hash[at], self.slot_id[at] = hashes[p], i
            self.most_probes = max(self.most_probes, k)

    @staticmethod
    def piece_hash(piece: str) -> int:
        h = 0
        for c in piece:
            h = ((h ^ ord(c)) * 0x9E3779B97F4A7C15) & (2**64 - 1)
            h ^= h >> 29
        return h

    def find(self, h: np.ndarray) -> np.ndarray:
        """Id of each hash, PREFIX where only longer pieces begin so, else ABSENT."""
        at = h & self.mask
        out = self.slot_id[at]
        odd = np.flatnonzero((out != ABSENT) & (self.slot_hash[at] != h))
        at = at[odd]
        for _ in range(self.most_probes):
            if not len(odd):
                break
            at = (at + np.uint64(1)) & self.mask
            out[odd] = self.slot_id[at]
            more = (out[odd] != ABSENT) & (self.slot_hash[at] != h[odd])
            odd, at = odd[more], at[more]
        return out

    def decode(self, ids) -> str:
        """Text of ids; broken bytes become U+FFFD."""
        return self.decode_bytes(ids).decode("utf-8", "replace")

    def decode_bytes(self, ids) -> bytes:
        """Pieces and bytes of ids joined, the blank in front taken off."""
        raw = b"".join(map(self.bytes.__getitem__, ids))
        return raw[1:] if raw.startswith(b" ") else raw


@dataclass
class Lattice:
    """Arcs of words' lattices by node. A piece below zero stands for the bytes of that code point."""

    first: np.ndarray  # of each node: its first arc; one more entry closes the last
    to: np.ndarray
    share: np.ndarray  # log-probability of the arc given its node
    piece: np.ndarray


def build(words: list[str], vocab: Vocabulary, alpha: float, base: int = 0) -> tuple[np.ndarray, Lattice]:
    """First node of each word (numbered from base) and the lattice of all; a word has a node more than characters."""
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    codes = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    total = len(codes)
    starts = np.cumsum(lengths) - lengths
    left = np.repeat(starts + lengths, lengths) - np.arange(total)  # characters up to the word's end
    node = np.arange(total) + np.repeat(np.arange(len(words)), lengths)
    pos = np.arange(total)
    h = np.zeros(total, np.uint64)
    froms, tos, ids = [], [], []
    for n in range(1, vocab.longest + 1):
        if n > 1:  # on with the places whose text so far begins some longer piece
            keep = (found != ABSENT) & (left[pos] >= n)
            pos, h = pos[keep], h[keep]
            if not len(pos):
                break
        h = (h ^ codes[pos + (n - 1)]) * _MIX
        h ^= h >> np.uint64(29)
        found = vocab.find(h)
        hit = np.flatnonzero(found >= 0) if n > 1 else pos
        froms.append(pos[hit])
        tos.append(np.full(len(hit), n, np.int64))
        ids.append(found[hit].astype(np.int64) if n > 1 else np.where(found < 0, -codes.astype(np.int64), found))
    frm, span, piece = np.concatenate(froms), np.concatenate(tos), np.concatenate(ids)
    order = np.argsort(frm, kind="stable")
    frm, span, piece = frm[order], span[order], piece[order]
    width = np.where(piece >= 0, 1, 1 + (-piece > 0x7F) + (-piece > 0x7FF) + (-piece > 0xFFFF))
    score = alpha * np.where(piece >= 0, vocab.log_prob[np.maximum(piece, 0)], width * vocab.log_prob[vocab.byte_id[0]])
    # backward sums, by characters left to the word's end
    begin = node[frm]
    mass = np.zeros(total + len(words))
    todo = np.argsort(left[frm], kind="stable")
    cuts = np.flatnonzero(np.diff(left[frm][todo])) + 1
    for arcs in np.split(todo, cuts) if len(todo) else []:
        value = score[arcs] + mass[begin[arcs] + span[arcs]]
        at = np.flatnonzero(np.r_[True, np.diff(begin[arcs]) != 0])
        top = np.maximum.reduceat(value, at)
        sums = np.add.reduceat(np.exp(value - np.repeat(top, np.diff(np.r_[at, len(arcs)]))), at)
        mass[begin[arcs][at]] = top + np.log(sums)
    share = score + mass[begin + span] - mass[begin]
    first = np.searchsorted(begin, np.arange(total + len(words) + 1))
    return base + starts + np.arange(len(words)), Lattice(first, base + begin + span, share, piece)


class Sampler:
    """Sampler of one vocabulary with a bounded store of word lattices."""

    def __init__(self, path: str, alpha: float = ALPHA):
        self.vocab, self.alpha = Vocabulary(path), alpha
        self.forget()

    def forget(self) -> None:
        self.number: defaultdict[str, int] = defaultdict(count().__next__)  # of each word, in order of first sight
        self.root = np.zeros(1 << 16, np.int64)  # first node of each word
        self.nodes = self.arcs = 0
        n = CACHE_ARCS + 1_000_000  # zeros: memory is taken as it is written
        self.store = Lattice(np.zeros(n, np.int64), np.zeros(n, np.int32), np.zeros(n), np.zeros(n, np.int32))

    def lattice(self, words: list[list[str]]) -> tuple[np.ndarray, Lattice]:
        """First node of every word of a batch, in order, and a lattice with all of them."""
        if self.arcs > CACHE_ARCS:
            self.forget()
        before = len(self.number)
        numbers = np.fromiter(map(self.number.__getitem__, chain.from_iterable(words)), np.int64)
        new = list(islice(reversed(self.number), len(self.number) - before))[::-1]
        if new:
            roots, more = build([SPACE + w for w in new], self.vocab, self.alpha, self.nodes)
            for name, used, part in (("first", self.nodes, more.first + self.arcs), ("to", self.arcs, more.to), ("share", self.arcs, more.share), ("piece", self.arcs, more.piece)):
                have = getattr(self.store, name)
                if len(have) < used + len(part):
                    setattr(self.store, name, have := np.concatenate([have[:used], np.zeros(2 * (used + len(part)) - used, have.dtype)]))
                have[used : used + len(part)] = part
            if len(self.root) < before + len(new):
                self.root = np.concatenate([self.root, np.zeros(before + len(new), np.int64)])
            self.root[before : before + len(new)] = roots
            self.nodes, self.arcs = self.nodes + len(more.first) - 1, self.arcs + len(more.to)
        return self.root[numbers], self.store

    def sample(self, keys: list[int], texts: list[str | None], k: int = SAMPLES, deep: float | None = DEEP) -> Iterator[tuple[int, int, np.ndarray, float, float, float]]:
        """(text, sample, ids, log p, perturbed log p, log inclusion) of k segmentations of each text, or of all where there are fewer."""
        # a word is known by what follows its first blank, which every word has
        split = [_words(t) if t else [] for t in texts]
        root, lat = self.lattice(split)
        counts = np.array([len(s) for s in split])
        word_at = np.cumsum(counts) - counts
        n = len(texts)
        key = _hash(np.array(keys, np.int64).astype(np.uint64) + np.uint64(77))
        value = _gumbel(key.copy())  # the root's perturbed value: log p of the whole is 0
        # state of each text's next sample: parent sample, arcs of it kept, first arc after them, place to go on from
        start_word, start_node, start_phi, prefix = np.zeros(n, np.int64), np.full(n, -1, np.int64), np.zeros(n), [np.zeros(0, np.int64)] * n
        front: list[list[tuple]] = [[] for _ in range(n)]  # open nodes of each text, best first
        live = np.arange(n)
        done: list[list[tuple]] = [[] for _ in range(n)]
        for r in range(k):
            path, arcs_at, before, siblings = self._follow(lat, root, word_at, counts, live, start_word, start_node, key, r, k - r, np.inf if deep is None else deep)
            opened = siblings(value[live], start_phi[live])
            for q, i in enumerate(live.tolist()):
                a, b = arcs_at[q], arcs_at[q + 1]
                arcs = np.concatenate([prefix[i], path[a:b]])
                phi = start_phi[i] + (before[b - 1] + lat.share[path[b - 1]] if b > a else 0.0)
                done[i].append((arcs, phi, value[i]))
                front[i] += [(g, arcs, len(prefix[i]) + at, arc, lp, word) for g, at, arc, lp, word in opened.get(q, ())]
                front[i].sort(key=lambda o: -o[0])
                del front[i][k - r :]
            nxt = [i for i in live.tolist() if front[i]]
            if r + 1 == k:
                break
            for i in nxt:
                g, arcs, at, arc, phi, word = front[i].pop(0)
                value[i], start_phi[i] = g, phi
                prefix[i] = np.concatenate([arcs[:at], [arc]])
                start_word[i], start_node[i] = word, lat.to[arc]
            live = np.array(nxt, np.int64)
        for i in range(n):
            kappa = front[i][0][0] if front[i] else -np.inf
            for s, (arcs, phi, g) in enumerate(done[i]):
                x = phi - kappa
                inclusion = 0.0 if np.isinf(kappa) else float(np.log(-np.expm1(-np.exp(min(x, 30.0)))) if x > -30 else x)
                yield i, s, self._ids(lat.piece[arcs]), float(phi), float(g), inclusion

    def _follow(self, lat, root, word_at, counts, live, start_word, start_node, key, r, m, deep):
        """Most likely perturbed arcs from each live text's place to its end, all words in step, and the m best siblings.

        Returns the arcs of all texts, where each text's begin, the running log-probability before each arc
        (counted from the text's place), and a function that gives the siblings once values are known.
        """
        words = counts[live] - start_word[live]
        total = int(words.sum())
        text = np.repeat(np.arange(len(live)), words)
        nth = np.arange(total) - np.repeat(np.cumsum(words) - words, words)  # word of the text, from its place on
        word = start_word[live][text] + nth
        node = root[word_at[live][text] + word]
        begun = (nth == 0) & (start_node[live][text] >= 0)
        node[begun] = start_node[live][text[begun]]
        noise = key[live][text] + _hash((word.astype(np.uint64) << np.uint64(20)) + np.uint64(r + 1))

        def perturbed(node, base, size, salt):
            """Arcs of nodes, their perturbed shares, each node's largest, and the node each arc leaves."""
            ends = np.cumsum(size)
            begin = ends - size
            ramp, steps_ = _ramp(int(ends[-1]))
            owner = np.repeat(ramp[: len(node)], size)
            arc = ramp + (base - begin)[owner]
            u = _gumbel(steps_ + (salt - steps_[begin])[owner])
            u += lat.share[arc]
            return arc, u, np.maximum.reduceat(u, begin), owner

        at = np.arange(total)
        steps: list[tuple] = []
        depth = 0
        while True:
            base = lat.first[node]
            size = lat.first[node + 1] - base
            going = np.flatnonzero(size)
            if not len(going):
                break
            if len(going) < len(at):
                at, node, base, size = at[going], node[going], base[going], size[going]
            arc, u, top, owner = perturbed(node, base, size, noise[at] + np.uint64(depth * _DEPTH & 0xFFFFFFFFFFFFFFFF))
            best = np.flatnonzero(u == top[owner])
            if len(best) > len(at):  # equal values: the first arc
                best = best[np.r_[True, np.diff(owner[best]) > 0]]
            chosen = arc[best]
            steps.append((at, chosen, node))
            node = lat.to[chosen].astype(np.int64)
            depth += 1
        length = np.zeros(total, np.int64)
        for s in steps:
            length[s[0]] += 1
        place = np.cumsum(length) - length
        path, passed = np.empty(int(length.sum()), np.int64), np.empty(int(length.sum()), np.int64)
        for d, s in enumerate(steps):
            spot = place[s[0]] + d
            path[spot], passed[spot] = s[1], s[2]
        arcs_at = np.r_[0, np.cumsum(np.bincount(text, length, len(live)).astype(np.int64))]
        upto = np.r_[0.0, np.cumsum(lat.share[path])]
        before = upto[:-1] - np.repeat(upto[arcs_at[:-1]], np.diff(arcs_at))

        def siblings(value: np.ndarray, phi: np.ndarray) -> dict[int, list[tuple]]:
            """By text: (value, arc number, arc, log p, word) of its best open siblings, given the path's value and the place's log p."""
            seen = np.flatnonzero(before >= -deep)
            if not len(seen):
                return {}
            whose = np.repeat(np.arange(total), length)[seen]
            base = lat.first[passed[seen]]
            level = (seen - place[whose]).astype(np.uint64) * np.uint64(_DEPTH)
            arc, u, top, owner = perturbed(passed[seen], base, lat.first[passed[seen] + 1] - base, noise[whose] + level)
            rest = np.flatnonzero(arc != path[seen][owner])
            arc, u, owner = arc[rest], u[rest], owner[rest]
            mine = text[whose][owner]
            own = phi[mine] + before[seen][owner]
            # conditioned on the largest below the node being the path's value
            with np.errstate(divide="ignore"):
                v = value[mine] - (own + u) + np.log1p(-np.exp(u - top[owner]))
            g = value[mine] - np.maximum(v, 0) - np.log1p(np.exp(-np.abs(v)))
            out: dict[int, list[tuple]] = {}
            for _ in range(m):
                best = np.full(len(value), -np.inf)
                np.maximum.at(best, mine, g)
                hit = np.flatnonzero((g == best[mine]) & (g > -np.inf))
                _, first = np.unique(mine[hit], return_index=True)
                for p in hit[first].tolist():
                    q, o = int(mine[p]), owner[p]
                    out.setdefault(q, []).append((float(g[p]), int(seen[o] - arcs_at[q]), int(arc[p]), float(own[p] + lat.share[arc[p]]), int(word[whose[o]])))
                g[hit[first]] = -np.inf
            return out

        return path, arcs_at, before, siblings

    def _ids(self, pieces: np.ndarray) -> np.ndarray:
        spelled = np.flatnonzero(pieces < 0)
        if not len(spelled):
            return pieces.astype(np.int32)
        out: list[np.ndarray] = []
        a = 0
        for b in spelled.tolist():
            out += [pieces[a:b], self.vocab.byte_id[list(chr(-int(pieces[b])).encode("utf-8", "surrogatepass"))]]
            a = b + 1
        return np.concatenate([*out, pieces[a:]]).astype(np.int32)


_samplers: dict[tuple[str, float], Sampler] = {}


def _sampler(path: str, alpha: float) -> Sampler:
    return _samplers.get((path, alpha)) or _samplers.setdefault((path, alpha), Sampler(path, alpha))


def sample_encode(docs: DataFrame, model: str, *, k: int = SAMPLES, alpha: float = ALPHA, text: str = "text", id_col: str = "doc_id", deep: float | None = DEEP, emit: Callable[[pd.DataFrame, str], pd.DataFrame] | None = None, schema: str = SCHEMA) -> DataFrame:
    """Up to k distinct sampled segmentations (SCHEMA) of every whole text, the largest perturbed value first.

    model: path of a SentencePiece file, present on every executor. A null or empty text has one, empty
    segmentation of log-probability and log-inclusion 0. Rows of equal id and text get equal samples, each
    row its own. An empty table gives no rows; other columns are ignored. emit, with the schema of what it
    returns, turns frames of samples into others before they leave the worker.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sampler = _sampler(model, alpha)
        for pdf in batches:
            ids, texts = list(pdf["i"]), list(pdf["t"])
            size = np.cumsum([len(t or "") for t in texts])
            for part in np.split(np.arange(len(texts)), np.flatnonzero(np.diff(size // BATCH_CHARS)) + 1):
                if len(part):
                    got = sampler.sample([ids[p] if ids[p] is not None and ids[p] == ids[p] else -1 for p in part], [texts[p] for p in part], k, deep)
                    out = pd.DataFrame([(ids[part[0] + i], s, pieces, lp, g, inc) for i, s, pieces, lp, g, inc in got], columns=_names)
                    yield emit(out, model) if emit else out

    return docs.select(F.col(id_col).alias("i"), F.col(text).alias("t")).mapInPandas(run, schema)


_names = [c.split()[0] for c in SCHEMA.split(", ")]


def encode(docs: DataFrame, model: str, *, text: str = "text", out: str = "ids") -> DataFrame:
    """docs with the file's own (best) encoding of the text as array<int>; null is empty."""

    @F.pandas_udf("array<int>")
    def run(t: pd.Series) -> pd.Series:
        return pd.Series(_sampler(model, ALPHA).vocab.sp.encode([x or "" for x in t], num_threads=1))

    return docs.withColumn(out, run(text))


def decode(docs: DataFrame, model: str, *, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """docs with the text of an array of ids; null stays null."""

    @F.pandas_udf("string")
    def run(x: pd.Series) -> pd.Series:
        vocab = _sampler(model, ALPHA).vocab
        return pd.Series([None if i is None else vocab.decode(i) for i in x], dtype=object)

    return docs.withColumn(out, run(ids))


DIGEST = "doc_id long, sample int, log_prob double, perturbed double, log_inclusion double, n_ids long, ids_crc32 long, text_crc32 long"


def digest(samples: pd.DataFrame, model: str) -> pd.DataFrame:
    """For emit: n_ids, ids_crc32 (little-endian 32-bit) and text_crc32 (of the decoded text) in place of ids."""
    vocab = _sampler(model, ALPHA).vocab
    new = {
        "n_ids": [len(x) for x in samples["ids"]], "ids_crc32": [zlib.crc32(x.astype("<i4").tobytes()) for x in samples["ids"]],
        "text_crc32": [zlib.crc32(vocab.decode_bytes(x.tolist())) for x in samples["ids"]],
    }
    return samples.drop(columns="ids").assign(**new)
