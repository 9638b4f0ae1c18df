"""Sampled segmentations over a piece lattice, and lossless decoding.

The pieces of a vocabulary file that match at each place of a text form a
lattice. Piece scores, times ``theta``, are taken as log weights; a forward pass
sums the weights of all ways to each place, and a backward pass draws the pieces
from the end, each in proportion to the ways through it (forward filtering,
backward sampling). Characters without a piece are spelt in byte pieces.

No piece has a space mark after another character, a line break, or both letters
and other characters (a file that has is refused), so every path passes the
borders there and the stretches between them are independent: lattices are built
once for each distinct stretch of a portion of rows, and the draws of all
occurrences are made together. A long stretch (scripts without spaces, encoded data)
is one lattice too: its forward pass goes chunk by chunk and carries the sums of the
last places over each border; the backward pass makes the chunks again from there,
so that memory does not grow with the number of its edges. The random numbers of a
row are hashes of its key and the place of the draw: the same key, text, seed and
theta give the same pieces, however rows are dealt to tasks.
"""

from __future__ import annotations

import math
import re
import zlib
from bisect import bisect_right
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import sentencepiece
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytehash import mix

SPACE = "▁"
#: Stands for a space mark that the text has itself; no valid text has this character.
OWN_MARK = "\udfff"
#: Scores of the public file are merge ranks; this makes the whole range of ranks a few natural log units.
THETA = 2e-4
#: Stretches of more characters go through their lattice chunk by chunk; the way does not change the draws.
LONGEST, CHUNK = 64, 1024
#: Signs: ASCII but letters and line breaks, Latin-1 signs and general punctuation. Everything else counts as letters.
SIGNS = r"\x00-\x09\x0b-@\[-`{-\xa9\xab-\xb4\xb6-\xb9\xbb-\xbf\xd7\xf7\u2000-\u206f"
#: Signs or letters, after any number of space marks; space marks alone; a line break.
STRETCH = re.compile(rf"{SPACE}*+(?:[{SIGNS}]++|[^{SIGNS}\n{SPACE}]++)|{SPACE}++|\n")
CHARACTERS_AT_ONCE = 1 << 22
STEP = 0x9E3779B97F4A7C15
SIEVE_BITS = 18


def extend(hashes: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """Hashes of strings with one more character on their left; the high bits are good ones."""
    return (hashes + codes + np.uint64(1)) * np.uint64(STEP)


class Vocabulary:
    """Pieces of a model file. Numbers from ``size`` on stand for characters spelt in bytes."""

    def __init__(self, path: str, theta: float = THETA) -> None:
        p = sentencepiece.SentencePieceProcessor(model_file=path)
        self.size = p.vocab_size()
        texts = [p.id_to_piece(i) for i in range(self.size)]
        special = {i for i in range(self.size) if p.is_control(i) or p.is_unknown(i) or p.is_unused(i)}
        self.byte_ids = {int(texts[i][3:5], 16): i for i in range(self.size) if p.is_byte(i)}
        plain = [i for i in range(self.size) if i not in special and not p.is_byte(i)]
        if any(len(STRETCH.findall(texts[i])) != 1 for i in plain):
            raise ValueError("a piece reaches over the border of a stretch")
        self.floor = math.exp(-theta * self.size)
        # Some pieces have a score below all ranks; the number of pieces bounds it.
        weight = {i: math.exp(theta * max(p.get_score(i), -float(self.size))) for i in plain}
        self.longest = max(len(texts[i]) for i in plain)
        #: For each length: sorted hashes, piece numbers, weights, and a sieve by the hashes' high bits.
        self.tables = []
        for n in range(1, self.longest + 1):
            mine = np.array([i for i in plain if len(texts[i]) == n], np.int64)
            keys = np.zeros(len(mine), np.uint64)
            for k in range(n):
                keys = extend(keys, np.array([ord(texts[i][n - 1 - k]) for i in mine], np.uint64))
            order = np.argsort(keys)
            sieve = np.zeros(1 << SIEVE_BITS, bool)
            sieve[keys >> np.uint64(64 - SIEVE_BITS)] = True
            self.tables.append((keys[order], mine[order], np.array([weight[i] for i in mine[order]]), sieve))
        self.spelt: dict[str, int] = {}
        self.spelling: list[np.ndarray] = []
        self.written = [t.replace(SPACE, " ").encode() for t in texts]
        for b, i in self.byte_ids.items():
            self.written[i] = bytes([b])

    def spell(self, char: str) -> int:
        if char not in self.spelt:
            self.spelt[char] = len(self.spelling)
            raw = (SPACE if char == OWN_MARK else char).encode()
            self.spelling.append(np.array([self.byte_ids[b] for b in raw], np.int64))
        return self.size + self.spelt[char]

    def ids(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Piece ids with spelt characters as their bytes, and the place of each number among them."""
        width = np.ones(len(numbers), np.int64)
        odd = np.flatnonzero(numbers >= self.size)
        if len(odd):
            sizes = np.array([len(s) for s in self.spelling])
            width[odd] = sizes[numbers[odd] - self.size]
        place = np.cumsum(width) - width
        out = np.zeros(int(width.sum()), np.int64)
        whole = numbers < self.size
        out[place[whole]] = numbers[whole]
        for x in np.unique(numbers[odd]).tolist():
            at = place[odd[numbers[odd] == x]]
            for k, b in enumerate(self.spelling[x - self.size].tolist()):
                out[at + k] = b
        return out, place

    def decode(self, ids: np.ndarray) -> bytes:
        """UTF-8 of the text that ids stand for, without the space that encoding puts first."""
        return b"".join(map(self.written.__getitem__, ids.tolist()))[1:]


def matches(v: Vocabulary, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(rows, size + 1, longest): weights and numbers of the pieces that end at each place, by length; characters without one are spelt."""
    rows, size = codes.shape
    most = min(size, v.longest)
    share = np.zeros((rows, size + 1, most))
    piece = np.zeros((rows, size + 1, most), np.int32)
    seen = np.zeros((rows, size), np.uint64)
    for n in range(1, most + 1):
        seen[:, n - 1 :] = extend(seen[:, n - 1 :], codes[:, : size - n + 1])
        keys, numbers, weights, sieve = v.tables[n - 1]
        wanted = seen[:, n - 1 :]
        row, end = np.nonzero(sieve[wanted >> np.uint64(64 - SIEVE_BITS)])
        if len(row):
            sought = wanted[row, end]
            place = np.minimum(np.searchsorted(keys, sought), len(keys) - 1)
            hit = keys[place] == sought
            row, end, place = row[hit], end[hit] + n, place[hit]
            share[row, end, n - 1] = weights[place]
            piece[row, end, n - 1] = numbers[place]
        if n == 1 and not share[:, 1:, 0].all():
            missing = share[:, 1:, 0] == 0
            share[:, 1:, 0][missing] = v.floor
            for code in np.unique(codes[missing]).tolist():
                piece[:, 1:, 0][missing & (codes == code)] = v.spell(chr(code))
    return share, piece


class LongLattice:
    """The lattice of one long stretch. ``sums`` has, for each chunk, those of the last places before it, to any common scale."""

    def __init__(self, vocabulary: Vocabulary, stretch: str, chunk: int = CHUNK) -> None:
        self.vocabulary, self.chunk = vocabulary, chunk
        self.codes = np.frombuffer(stretch.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
        carried = np.zeros(vocabulary.longest)
        carried[-1] = 1
        self.sums = [carried]
        for k in range(-(-len(self.codes) // chunk)):
            self.sums.append(self._chunk(k)[2])

    def _chunk(self, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of the places of a chunk: summed shares of the edges by length, and their pieces; and the sums to carry on."""
        longest, start = self.vocabulary.longest, k * self.chunk
        stop = min(start + self.chunk, len(self.codes))
        back = min(start, longest - 1)
        share, piece = matches(self.vocabulary, self.codes[None, start - back : stop])
        share, piece = share[0, back + 1 :], piece[0, back + 1 :]
        most = share.shape[1]
        sums = np.concatenate([self.sums[k], np.zeros(stop - start)])
        for i in range(stop - start):
            at = longest + i
            share[i] *= sums[at - most : at][::-1]
            total = share[i].sum()
            share[i] /= total
            sums[at] = total
            if not 1e-100 < total < 1e100:
                sums[at - longest + 1 : at + 1] /= total
        return np.cumsum(share, axis=1), piece, sums[-longest:]

    def draw(self, seeds: np.ndarray) -> list[np.ndarray]:
        """Pieces of an occurrence for each seed."""
        place = np.full(len(seeds), len(self.codes))
        drawn: list[list[int]] = [[] for _ in seeds]
        for k in range(len(self.sums) - 2, -1, -1):
            upto, piece, _ = self._chunk(k)
            last = upto.shape[1] - 1 - np.argmax(np.diff(upto, axis=1, prepend=0)[:, ::-1] > 0, axis=1)  # longest edge there is
            start = k * self.chunk
            for who, out in enumerate(drawn):
                at, seed = int(place[who]), seeds[who]
                # As many numbers as this chunk can take at most, from the next step on.
                steps = (np.arange(len(out) + 1, len(out) + 1 + max(0, at - start), dtype=np.uint64)) * np.uint64(STEP)
                numbers = ((mix(seed + steps) >> np.uint64(11)).astype(np.float64) / (1 << 53)).tolist()
                for u in numbers:
                    if at <= start:
                        break
                    row = at - start - 1
                    edge = min(int(np.searchsorted(upto[row], u, side="right")), int(last[row]))
                    out.append(int(piece[row, edge]))
                    at -= edge + 1
                place[who] = at
        return [np.array(x[::-1], np.int64) for x in drawn]


class Lattices:
    """Lattices of distinct stretches, as flat arrays.

    State s has edges first[s] to first[s + 1]; ``key`` is s plus the summed shares
    of its edges so far. The first state of a stretch has none.
    """

    def __init__(self, vocabulary: Vocabulary, stretches: list[str]) -> None:
        sizes = np.fromiter(map(len, stretches), np.int64, len(stretches))
        self.final = np.zeros(len(stretches), np.int64)
        parts, states = [], 0
        for size in np.unique(sizes).tolist():
            mine = np.flatnonzero(sizes == size)
            step = max(1, (1 << 21) // (size * min(size, vocabulary.longest)))
            for at in range(0, len(mine), step):
                rows = mine[at : at + step]
                self.final[rows] = states + np.arange(len(rows)) * (size + 1) + size
                parts.append(self._built(vocabulary, [stretches[i] for i in rows.tolist()], size, states))
                states += len(rows) * (size + 1)
        edges, piece, target, key = (np.concatenate(x) for x in zip(*parts)) if parts else [np.zeros(0, np.int64)] * 4
        self.first = np.concatenate([[0], np.cumsum(edges)])
        self.piece, self.target, self.key = piece, target, key

    @staticmethod
    def _built(v: Vocabulary, rows: list[str], size: int, base: int) -> tuple[np.ndarray, ...]:
        """Edges per state, and piece, target and key of each edge, of stretches of one size."""
        codes = np.frombuffer("".join(rows).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64).reshape(-1, size)
        share, piece = matches(v, codes)
        most = share.shape[2]
        ways = np.zeros((len(rows), size + 1))
        ways[:, 0] = 1
        for end in range(1, size + 1):
            for n in range(1, min(end, most) + 1):
                share[:, end, n - 1] *= ways[:, end - n]
            ways[:, end] = share[:, end].sum(axis=1)
        there = share > 0
        state = base + np.arange(len(rows) * (size + 1)).reshape(len(rows), size + 1)
        upto = np.cumsum(share, axis=2) / np.where(ways > 0, ways, 1)[:, :, None]
        key = (state[:, :, None] + np.minimum(upto, 1.0))[there]
        target = (state[:, :, None] - np.arange(1, most + 1))[there]
        return there.sum(axis=2).ravel(), piece[there], target, key

    def draw(self, stretch: np.ndarray, seeds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pieces of all occurrences of stretches in a row, and how many each has. ``seeds``: 64 bits for each occurrence."""
        first, piece, target, key, final = self.first, self.piece, self.target, self.key, self.final
        state = final[stretch]
        order = np.argsort(state, kind="stable")  # neighbours look at the same part of the tables
        state, seeds, alive = state[order], seeds[order], order
        counts, drawn, step = np.zeros(len(stretch), np.int64), [], 0
        while len(alive):
            step += 1
            u = (mix(seeds + np.uint64(STEP * step % (1 << 64))) >> np.uint64(11)).astype(np.float64) / (1 << 53)
            edge = np.minimum(np.searchsorted(key, state + u, side="right"), first[state + 1] - 1)
            drawn.append((alive, piece[edge]))
            counts[alive] += 1
            state = target[edge]
            going = first[state + 1] > first[state]
            alive, state, seeds = alive[going], state[going], seeds[going]
        after = np.cumsum(counts)
        out = np.zeros(int(after[-1]) if len(after) else 0, np.int64)
        for k, (who, what) in enumerate(drawn):
            out[after[who] - 1 - k] = what
        return out, counts


class Sampler:
    def __init__(self, path: str, theta: float = THETA) -> None:
        self.vocabulary = Vocabulary(path, theta)

    def encode(self, texts: list[str], keys: list, seed: int = 0) -> list[np.ndarray]:
        """Ids of each text; ``keys`` and ``seed`` decide the draws."""
        stretches: list[str] = []
        counts = []
        for text in texts:
            if not text:
                counts.append(0)
                continue
            found = STRETCH.findall(SPACE + text.replace(SPACE, OWN_MARK).replace(" ", SPACE))
            stretches += found
            counts.append(len(found))
        known = {s: i for i, s in enumerate(sorted(dict.fromkeys(stretches), key=len))}
        numbers = np.fromiter(map(known.__getitem__, stretches), np.int64, len(stretches))
        per = np.array(counts, np.int64)
        row = np.array([xxhash.xxh64_intdigest(str(k).encode(), seed & (1 << 64) - 1) for k in keys], np.uint64)
        within = np.arange(len(numbers)) - np.repeat(np.cumsum(per) - per, per)
        seeds = mix(np.repeat(row, per) + within.astype(np.uint64) * np.uint64(STEP))
        pieces, sizes = self._drawn(list(known), numbers, seeds)
        ids, place = self.vocabulary.ids(pieces)
        stretch_end = np.concatenate([[0], np.cumsum(sizes)])
        text_end = stretch_end[np.concatenate([[0], np.cumsum(per)])]
        cuts = np.concatenate([place, [len(ids)]])[text_end]
        return [ids[a:b] for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist())]

    def _drawn(self, stretches: list[str], numbers: np.ndarray, seeds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pieces of all occurrences in a row, and how many each has; ``stretches`` come in order of their length."""
        short = bisect_right(stretches, LONGEST, key=len)
        pieces, sizes = Lattices(self.vocabulary, stretches[:short]).draw(numbers[numbers < short], seeds[numbers < short])
        if short == len(stretches):
            return pieces, sizes
        counts = np.zeros(len(numbers), np.int64)
        counts[numbers < short] = sizes
        parts: dict[int, np.ndarray] = {}
        where = np.flatnonzero(numbers >= short)
        where = where[np.argsort(numbers[where], kind="stable")]
        for mine in np.split(where, np.flatnonzero(np.diff(numbers[where])) + 1):
            lattice = LongLattice(self.vocabulary, stretches[int(numbers[mine[0]])])
            parts |= dict(zip(mine.tolist(), lattice.draw(seeds[mine])))
        for i, part in parts.items():
            counts[i] = len(part)
        ends = np.cumsum(counts)
        out = np.zeros(int(ends[-1]), np.int64)
        out[np.repeat(numbers < short, counts)] = pieces
        for i, part in parts.items():
            out[ends[i] - len(part) : ends[i]] = part
        return out, counts


_samplers: dict[tuple[str, float], Sampler] = {}


def sampler(path: str, theta: float = THETA) -> Sampler:
    """One for each worker process, file and theta."""
    if (path, theta) not in _samplers:
        _samplers[path, theta] = Sampler(path, theta)
    return _samplers[path, theta]


def portions(texts: list[str], most: int = CHARACTERS_AT_ONCE) -> Iterator[tuple[int, int]]:
    """(start, end) of stretches of rows with about ``most`` characters."""
    start, size = 0, 0
    for i, t in enumerate(texts):
        size += len(t)
        if size >= most:
            yield start, i + 1
            start, size = i + 1, 0
    if start < len(texts):
        yield start, len(texts)


def _plain(names: list[str]) -> list[str]:
    """Names that mapInArrow can take, which those with dots are not."""
    return [f"_c{i}" for i in range(len(names))]


def _mapped(df: DataFrame, keep: list[str], run: Callable, name: str, kind: str) -> DataFrame:
    """Columns ``keep`` of ``df`` and one that ``run`` makes."""
    plain = _plain(keep)
    schema = ", ".join(f"{p} {df.schema[c].dataType.simpleString()}" for p, c in zip(plain, keep))
    rows = df.select(*[F.col(f"`{c}`").alias(p) for p, c in zip(plain, keep)])
    return rows.mapInArrow(run, f"{schema}, made {kind}").toDF(*keep, name)


def encode(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text", seed: int = 0, theta: float = THETA) -> DataFrame:
    """``docs`` with ``ids``, a sampled segmentation of each text.

    Null and empty texts have no ids. Rows with equal keys draw the same random
    numbers; a null key is the word None. A column ``ids`` of ``docs`` is replaced.
    """
    keep = [c for c in docs.columns if c != "ids"]
    id_at, text_at = keep.index(id_col), keep.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = sampler(model, theta)
        for batch in batches:
            texts = ["" if t is None else t for t in batch.column(text_at).to_pylist()]
            keys = batch.column(id_at).to_pylist()
            for a, b in portions(texts):
                found = coder.encode(texts[a:b], keys[a:b], seed)
                ids = pa.array([x.astype(np.int32) for x in found], pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([*batch.slice(a, b - a).columns, ids], [*_plain(keep), "made"])

    return _mapped(docs, keep, run, "ids", "array<int>")


def decode(rows: DataFrame, model: str, ids_col: str = "ids", out_col: str = "text") -> DataFrame:
    """``rows`` with the text of their ids; null ids give an empty text."""
    keep = [c for c in rows.columns if c != out_col]
    at = keep.index(ids_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = sampler(model).vocabulary
        for batch in batches:
            texts = [vocabulary.decode(np.array(x or [], np.int64)).decode("utf-8", "replace") for x in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], [*_plain(keep), "made"])

    return _mapped(rows, keep, run, out_col, "string")


def digests(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text", seed: int = 0, theta: float = THETA) -> DataFrame:
    """Each text encoded and decoded again: numbers and checksums of ids and bytes, and whether the text came back.

    Null and empty texts have no ids and come back as empty ones. Rows that repeat an id
    and a text draw the same; a null id is the word None. Other columns are not looked at.
    """
    out = "doc_id bigint, n_bytes bigint, n_ids bigint, ids_crc32 bigint, decoded_crc32 bigint, lossless boolean"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = sampler(model, theta)
        for batch in batches:
            texts = ["" if t is None else t for t in batch.column(1).to_pylist()]
            keys = batch.column(0).to_pylist()
            rows = []
            for a, b in portions(texts):
                for key, text, ids in zip(keys[a:b], texts[a:b], coder.encode(texts[a:b], keys[a:b], seed)):
                    raw, back = text.encode(), coder.vocabulary.decode(ids)
                    rows.append((key, len(raw), len(ids), zlib.crc32(ids.astype("<u4").tobytes()), zlib.crc32(back), back == raw))
            kinds = [pa.int64()] * 5 + [pa.bool_()]
            cols = [pa.array(c, k) for c, k in zip(zip(*rows), kinds)] if rows else [pa.array([], k) for k in kinds]
            yield pa.RecordBatch.from_arrays(cols, [x.split()[0] for x in out.split(", ")])

    return docs.select(F.col(id_col).cast("bigint"), F.col(text_col)).mapInArrow(run, out)
