"""Removal of repeated passages by bucket-pointer refinement of suffixes.

A string of ``length`` symbols (bytes, or words) that covers a place and stands
elsewhere too takes the place out. Suffixes first enter buckets by a q-gram. A bucket is
then refined by the identifiers that the buckets of its suffixes' later offsets have:
strings of two or three q are equal if the q-grams at offsets 0, q, .. are. Refined
identifiers take the place of the old ones, and the next round refines by them, until
buckets are ``length`` symbols deep. What one round settles the next does not look at.

Two things differ from the method on one machine, where every suffix is sorted and a
bucket's identifier is its rank:

* identifiers are hashes of the bucket's place in the refinement, so that tasks agree
  on them without a global sort; a bucket and a run are told apart by 128 bits;
* the suffix array is sparse. Of the q-grams in a window of ``length`` symbols the
  least one (by identifier, then place) is its anchor; equal windows have equal
  anchors at equal places, so only anchors' suffixes enter buckets.

An anchor owns a run of windows. In each round

1. buckets of one suffix end;
2. a run whose identifiers at all later offsets are, in its bucket, there twice is a
   repeat as a whole;
3. one of each other run fetches its symbols and goes to the next round, where the
   deeper identifiers give more anchors with shorter runs.

In the last round a run is a single window. Only runs at the borders of repeats get
there. Several kinds of repeats (say, of 400 bytes and of 50 words) go through the
same rounds together, each with depths of its own.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytehash import BASE, Rolling, mix
from .common import forget, parts, release, scratch, table

LENGTH = 400
#: Symbols of a bucket's string in each round; in the last round it is the whole length.
DEPTHS = (64, 336)
#: Words of a passage; words are what ASCII white space parts.
WORDS = 50
WORD_DEPTHS = (8, 42)
#: Of a ranked q-gram's 64 bits: its place, below its identifier. And symbols that are looked at together.
PLACE_BITS = 24
PORTION = 1 << 20
ODD = np.uint64(BASE)
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True


@dataclass(frozen=True)
class Repeats:
    """Strings of ``length`` bytes, or ``words``, that stand twice; with ``across`` in two rows that differ in id or text."""

    length: int = LENGTH
    depths: tuple[int, ...] = DEPTHS
    words: bool = False
    across: bool = False

    def chain(self, level: int) -> tuple[int, ...]:
        """Depths up to a round."""
        return (*self.depths, self.length)[: level + 1]


PASSAGES = Repeats(WORDS, WORD_DEPTHS, words=True, across=True)


def deeper(ids: np.ndarray, depth: int, q: int) -> np.ndarray:
    """Identifiers of ``q`` symbols by start, from those of ``depth`` symbols at their later offsets."""
    n = max(0, len(ids) - (q - depth))
    out = ids[:n]
    for at in [*range(depth, q - depth, depth), q - depth]:
        out = mix(out * ODD + ids[at : at + n])
    return out


def identifiers(values: np.ndarray, depths: tuple[int, ...]) -> np.ndarray:
    """Identifiers of the deepest buckets, by start; each round uses those of the round before."""
    ids = Rolling(values).grams(depths[0])
    for depth, q in zip(depths[:-1], depths[1:]):
        ids = deeper(ids, depth, q)
    return ids


def _portions(offsets: np.ndarray, length: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """(start, stop, owners, places of their first symbol, borders) of stretches of some texts, or of a part of a long one."""
    i, n = 0, len(offsets) - 1
    while i < n:
        size = int(offsets[i + 1] - offsets[i])
        if size > PORTION:
            for at in range(0, size - length + 1, PORTION - length + 1):
                stop = min(at + PORTION, size)
                yield int(offsets[i]) + at, int(offsets[i]) + stop, np.array([i]), np.array([at]), np.array([0, stop - at])
            i += 1
            continue
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + PORTION, side="right")) - 1)
        yield int(offsets[i]), int(offsets[j]), np.arange(i, j), np.zeros(j - i, np.int64), offsets[i : j + 1] - offsets[i]
        i = j


def anchors(values: np.ndarray, offsets: np.ndarray, length: int, depths: tuple[int, ...]) -> tuple[np.ndarray, ...]:
    """(owner, bucket, run, lo, hi) of each anchor of texts that lie end to end.

    ``run`` has the identifiers at all later offsets of the string that the anchor's
    windows cover; ``lo`` and ``hi`` are the first and last of their starts.
    """
    parts = []
    low = np.uint64((1 << PLACE_BITS) - 1)
    q = depths[-1]
    width = length - q + 1
    for start, stop, owners, shifts, borders in _portions(offsets, length):
        windows = np.diff(borders) - length + 1
        there = np.flatnonzero(windows > 0)
        if not len(there):
            continue
        ids = identifiers(values[start:stop], depths)
        ranked = (ids & ~low) | np.arange(len(ids), dtype=np.uint64)
        blocks = np.concatenate([ranked, np.full(-len(ranked) % width, np.iinfo(np.uint64).max)]).reshape(-1, width)
        after = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
        before = np.minimum.accumulate(blocks, axis=1).ravel()
        n = windows[there]
        first = np.cumsum(n) - n
        at = np.arange(int(n.sum())) + np.repeat(borders[there] - first, n)  # starts of all windows that lie in one text
        place = (np.minimum(after[at], before[at + width - 1]) & low).astype(np.int64)
        new = np.ones(len(at), bool)
        new[1:] = (place[1:] != place[:-1]) | (at[1:] != at[:-1] + 1)
        heads = np.flatnonzero(new)
        lo, hi = at[heads], at[np.concatenate([heads[1:], [len(at)]]) - 1]
        size = hi - lo + length
        run = size.astype(np.uint64)
        for step in range(0, int(size.max()), q):
            later = ids[np.minimum(lo + step, hi + length - q)]
            run = np.where(step < size, mix(run * ODD + later), run)
        text = np.searchsorted(borders, lo, side="right") - 1
        shift = shifts[text] - borders[text]
        parts.append((owners[text], ids[place[heads]].view(np.int64), run.view(np.int64), lo + shift, hi + shift))
    if not parts:
        return tuple(np.zeros(0, np.int64) for _ in range(5))
    return tuple(np.concatenate(x) for x in zip(*parts))


def laid_out(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string or binary column end to end, and where each value starts."""
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    _, starts, data = column.buffers()
    offsets = np.frombuffer(starts, np.int64)[column.offset : column.offset + len(column) + 1]
    every = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return every[offsets[0] : offsets[-1]], offsets - offsets[0]


def word_bounds(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First byte and end of each word, and where each text's words start."""
    solid = ~SPACE[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    starts = np.flatnonzero(solid & (edge[:-1] | np.concatenate([[True], ~solid[:-1]])))
    ends = np.flatnonzero(solid & (edge[1:] | np.concatenate([~solid[1:], [True]]))) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def word_values(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    out = np.zeros(len(starts), np.uint64)
    i = 0
    while i < len(starts):
        j = max(i + 1, int(np.searchsorted(starts, starts[i] + PORTION)))
        out[i:j] = Rolling(data[starts[i] : ends[j - 1]]).of(starts[i:j] - starts[i], ends[i:j] - starts[i])
        i = j
    return out


def _anchor_rows(texts: DataFrame, kinds: list[Repeats], level: int) -> DataFrame:
    """Anchors of (kind, doc, print, base, data) rows; places count from the start of the document. A null kind stands for all.

    ``k`` anchors of one row that are alike (a line said over and over) have one row;
    ``more`` holds the places of all but the first.
    """

    def alike(found: tuple[np.ndarray, ...], kind: int, batch: pa.RecordBatch) -> pa.RecordBatch:
        owner, gram, run, lo, hi = found
        base = batch.column(3).to_numpy()[owner]
        places = np.stack([base + lo, base + hi], axis=1).astype("<i4")
        order = np.lexsort((gram, run, owner))
        same = np.zeros(len(order), bool)
        same[1:] = (np.diff(owner[order]) == 0) & (np.diff(run[order]) == 0) & (np.diff(gram[order]) == 0)
        start = np.flatnonzero(~same)
        sizes = np.diff(np.concatenate([start, [len(order)]]))
        one = order[start]
        more: list[bytes | None] = [None] * len(one)
        for k in np.flatnonzero(sizes > 1).tolist():
            more[k] = places[order[start[k] + 1 : start[k] + sizes[k]]].tobytes()
        at = pa.array(owner[one])
        cols = [pa.array(np.full(len(one), kind, np.int32)), pa.array(gram[one]), pa.array(run[one]), batch.column(1).take(at), batch.column(2).take(at)]
        cols += [pa.array(x) for x in (base[one].astype(np.int32), places[one, 0], places[one, 1], sizes.astype(np.int32))]
        return pa.RecordBatch.from_arrays([*cols, pa.array(more, pa.binary())], ["kind", "gram", "run", "doc", "print", "base", "lo", "hi", "k", "more"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in parts(batches, 2048):
            for kind, wanted in enumerate(kinds):
                tags = whole.column(0).fill_null(kind).to_numpy()
                batch = whole if (tags == kind).all() else whole.filter(pa.array(tags == kind))
                if not batch.num_rows:
                    continue
                values, offsets = laid_out(batch.column(4))
                if wanted.words:
                    starts, ends, own = word_bounds(values, offsets)
                    values, offsets = word_values(values, starts, ends), own
                found = anchors(values, offsets, wanted.length, wanted.chain(level))
                if len(found[0]):
                    yield alike(found, kind, batch)

    shape = "kind int, gram bigint, run bigint, doc bigint, print bigint, base int, lo int, hi int, k int, more binary"
    return texts.select("kind", "doc", "print", "base", "data").mapInArrow(run, shape)


def _level(texts: DataFrame, kinds: list[Repeats], level: int) -> tuple[DataFrame, DataFrame]:
    """A round: (runs of windows found to repeat, one of each run that is left).

    A bucket of one suffix is dropped. A run whose whole string is in its bucket
    twice repeats as a whole. Both follow from counts and minima with map-side
    combine, so a bucket of any size is never gathered.
    """
    across = [i for i, x in enumerate(kinds) if x.across]
    # Written first, so that each join has plain exchanges on both sides and hot buckets are split.
    rows = table(_anchor_rows(texts, kinds, level))
    counts = [F.min("kind").alias("_kind"), F.sum("k").alias("n"), F.min("print").alias("p"), F.max("print").alias("q")]
    twice = F.when(F.col("_kind").isin(across), F.col("p") < F.col("q")).otherwise(F.col("n") > 1) if across else F.col("n") > 1
    grams = rows.groupBy("gram").agg(*counts, F.min("run").alias("a"), F.max("run").alias("b"))
    shared = table(grams.where(twice).select(F.col("gram").alias("_gram"), (F.col("a") != F.col("b")).alias("many")))
    met = table(rows.join(shared, rows["gram"] == shared["_gram"]).drop("_gram"))
    forget(rows)
    forget(shared)
    release(texts.sparkSession.sparkContext)
    several = met.where("many")
    # Places of one row that are alike stay together: they are no repeat across rows, but others can repeat a part of them.
    places = ["doc", "print", "base", "lo", "hi", "more"]
    runs = table(several.groupBy("gram", "run").agg(*counts, F.min(F.struct("kind", *places)).alias("one")))
    copied = runs.where(twice).select(F.col("gram").alias("_gram"), F.col("run").alias("_run"))
    copies = several.join(copied, (several["gram"] == copied["_gram"]) & (several["run"] == copied["_run"]))
    out = ["kind", "doc", "print", "lo", "hi", "more"]
    whole = met.where("not many").select(*out).unionByName(copies.select(*out))
    unfinished = [i for i, x in enumerate(kinds) if level < len(x.depths)]
    return whole, runs.select("one.*").where(F.col("kind").isin(unfinished))


def _fetch(texts: DataFrame, left: DataFrame, kinds: list[Repeats], whole: bool) -> DataFrame:
    """The symbols that the windows of each run cover, as rows for the next round; ``whole``: of whole texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["kind", "doc", "print", "base", "data"]
        types = [pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.binary()]
        for batch in batches:
            rows, size = [], 0
            for doc, mark, base, data, spans in zip(*batch.columns):
                raw, start, bounds = data.as_py(), base.as_py(), None
                for s in spans.as_py():
                    kind = kinds[s["kind"]]
                    places = [(s["lo"], s["hi"])]
                    if kind.across and s["more"]:
                        places += np.frombuffer(s["more"], "<i4").reshape(-1, 2).tolist()
                    for lo, hi in places:
                        a, b = lo - start, hi - start + kind.length
                        if kind.words:
                            if bounds is None:
                                bounds = word_bounds(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))
                            a, b = int(bounds[0][a]), int(bounds[1][b - 1])
                        rows.append((s["kind"], doc.as_py(), mark.as_py(), lo, raw[a:b]))
                        size += b - a
                        if size >= PORTION:
                            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), types)], names)
                            rows, size = [], 0
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), types)], names)

    # Of whole texts a row serves all kinds; later rows have one each.
    keys = ["doc", "print", "base"] if whole else ["kind", "doc", "print", "base"]
    spans = left.groupBy(*[F.col(c).alias(f"_{c}") for c in keys]).agg(F.collect_list(F.struct("kind", "lo", "hi", "more")).alias("spans"))
    joined = texts.join(spans.hint("merge"), [texts[c].eqNullSafe(spans[f"_{c}"]) if c == "doc" else texts[c] == spans[f"_{c}"] for c in keys])
    joined = joined.select("doc", "print", "base", "data", "spans")
    return table(joined.mapInArrow(run, "kind int, doc bigint, print bigint, base int, data binary"))


def repeated_windows(docs: DataFrame, kinds: list[Repeats]) -> DataFrame:
    """(doc, print, windows): for (doc, print, text) rows, the runs of window starts that repeat, of all kinds.

    ``print`` is a digest of id and text: rows that share an id but not a text are
    kept apart; rows equal in both have equal results.
    """
    data = F.col("text").cast("binary").alias("data")
    texts = docs.select(F.lit(None).cast("int").alias("kind"), "doc", "print", F.lit(0).alias("base"), data)
    found, left = _level(texts, kinds, 0)
    for level in range(1, max(len(x.depths) for x in kinds) + 1):
        before, texts = texts, _fetch(texts, left, kinds, whole=level == 1)
        if level > 1:
            forget(before)
        more, left = _level(texts, kinds, level)
        found = found.unionByName(more)
    return found.groupBy("doc", "print").agg(F.collect_list(F.struct("kind", "lo", "hi", "more")).alias("windows"))


def removed_spans(n: int, windows: list[dict] | None, length: int = LENGTH) -> list[tuple[int, int]]:
    """Maximal runs of the n symbols that the windows cover."""
    if not windows:
        return []
    places = [np.array([(w["lo"], w["hi"]) for w in windows], np.int64)]
    places += [np.frombuffer(w["more"], "<i4").reshape(-1, 2).astype(np.int64) for w in windows if w.get("more")]
    lo, hi = np.concatenate(places).T
    edges = np.bincount(lo, minlength=n + 1) - np.bincount(hi + length, minlength=n + 1)
    gone = np.concatenate([[0], (np.cumsum(edges)[:-1] > 0).astype(np.int8), [0]])
    turns = np.flatnonzero(np.diff(gone))
    return list(zip(turns[::2].tolist(), turns[1::2].tolist()))


def _spans(raw: bytes, windows: list[dict] | None, kind: int, wanted: Repeats) -> tuple[list[tuple[int, int]], int]:
    """Byte spans that go, and how many symbols they have; a passage of words goes with the space after it."""
    mine = [w for w in windows or () if w["kind"] == kind]
    if not mine:
        return [], 0
    if not wanted.words:
        found = removed_spans(len(raw), mine, wanted.length)
        return found, sum(b - a for a, b in found)
    starts, ends, _ = word_bounds(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))
    found = removed_spans(len(starts), mine, wanted.length)
    return [(int(starts[a]), int(starts[b] if b < len(starts) else ends[-1])) for a, b in found], sum(b - a for a, b in found)


def _kept(raw: bytes, spans: list[tuple[int, int]]) -> bytes:
    out, at = [], 0
    for a, b in spans:
        out.append(raw[at:a])
        at = b
    return b"".join([*out, raw[at:]])


def whole_characters(raw: bytes, spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The spans without characters of UTF-8 that they cut."""
    out = []
    for a, b in spans:
        while a < b and raw[a] & 0xC0 == 0x80:
            a += 1
        while b > a and b < len(raw) and raw[b] & 0xC0 == 0x80:
            b -= 1
        if a < b:
            out.append((a, b))
    return out


def _met(docs: DataFrame, id_col: str, text_col: str, kinds: list[Repeats], others: bool) -> DataFrame:
    """Each row with its windows; with ``others`` all columns of ``docs`` too, as _c0, _c1, .."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    doc = F.col(id_col).cast("bigint")
    known = [doc.alias("doc"), F.xxhash64(doc, text).alias("print"), text.alias("text")]
    with scratch() as keep:
        windows = repeated_windows(docs.select(*known), kinds)
        windows = keep(table(windows.select(F.col("doc").alias("_doc"), F.col("print").alias("_print"), "windows")))
    rows = docs.select(*known, *[F.col(f"`{c}`").alias(f"_c{i}") for i, c in enumerate(docs.columns)]) if others else docs.select(*known)
    return rows.join(windows.hint("merge"), rows["doc"].eqNullSafe(windows["_doc"]) & (rows["print"] == windows["_print"]), "left")


def repeat_digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, depths: tuple[int, ...] = DEPTHS, passages: Repeats = PASSAGES) -> DataFrame:
    """What ``remove_repeats`` takes out of each row, and which passages stand in other rows too.

    (doc_id, n_bytes, n_removed, n_spans, kept_sha256, n_passages, n_passage_words): bytes
    of the text, bytes and maximal runs that strings of ``length`` bytes take out, digest of
    what is left; then maximal runs of ``passages`` and their words. Null, empty and short
    texts have zeros; rows that repeat an id each have a row.
    """
    kinds = [Repeats(length, depths), passages]
    shape = "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, n_passages bigint, n_passage_words bigint"
    types = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64()]

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches):
            rows = []
            for text, found in zip(batch.column(1).cast(pa.binary()), batch.column(2)):
                raw, windows = text.as_py(), found.as_py()
                spans, removed = _spans(raw, windows, 0, kinds[0])
                others, words = _spans(raw, windows, 1, kinds[1])
                rows.append((len(raw), removed, len(spans), hashlib.sha256(_kept(raw, spans)).hexdigest(), len(others), words))
            cols = [pa.array(c, k) for c, k in zip(zip(*rows), types)] if rows else [pa.array([], k) for k in types]
            yield pa.RecordBatch.from_arrays([batch.column(0), *cols], [x.split()[0] for x in shape.split(", ")])

    return _met(docs, id_col, text_col, kinds, False).select("doc", "text", "windows").mapInArrow(digest, shape)


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", repeats: Repeats = Repeats()) -> DataFrame:
    """``docs`` without repeated passages.

    Repeats are judged on the input as it is: passages at all their places go, the
    first included. Null and empty texts, and texts shorter than a passage, lose
    nothing; rows without an id are treated like others, and rows that repeat are
    repeats of each other unless ``repeats.across`` asks for another id or text. A
    character that a cut of bytes would part stays. Other columns stay as they are,
    whatever their names.
    """
    names, text_at = list(docs.columns), docs.columns.index(text_col)

    def cut_text(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches):
            out = []
            for text, found in zip(batch.column(text_at), batch.column(len(names))):
                windows = found.as_py()
                if text.is_valid and windows:
                    raw = text.as_py().encode("utf-8", "surrogatepass")
                    spans = whole_characters(raw, _spans(raw, windows, 0, repeats)[0])
                    out.append(_kept(raw, spans).decode("utf-8", "surrogatepass"))
                else:
                    out.append(text.as_py())
            cols = [pa.array(out, pa.string()) if i == text_at else batch.column(i) for i in range(len(names))]
            yield pa.RecordBatch.from_arrays(cols, names)

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    joined = _met(docs, id_col, text_col, [repeats], True)
    return joined.select(*[f"_c{i}" for i in range(len(names))], "windows").mapInArrow(cut_text, schema)
