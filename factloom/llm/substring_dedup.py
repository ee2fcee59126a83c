"""Passages that repeat across documents, by compact windows.

A token is a run of ``SHINGLE`` words, hashed.  For each of ``HASHES`` hash functions the min-hash of every run of at least
``LEAST`` tokens is one of few tokens of a document; a Cartesian tree over those minima gives, for each, the compact
window (l, c, r): all runs inside [l, r] that hold position c share its token as their signature.  A document of n tokens has about
2n / LEAST such windows for each function.

1. Signatures that two or more documents show are found by an aggregation of minima; the document of the smallest
   fingerprint becomes the signature's pivot, so a passage of thousands of documents makes a star, not all pairs.
2. Of common phrases any window meets some pivot, in large tables, so one signature says little; two at one place do.
   The windows of a document that meet one pivot are joined as intervals: where windows of at least ``ENOUGH`` functions
   overlap there may be a passage.  Windows of two functions that overlap but met different pivots are a pair of
   signatures; a pair that two documents show has a pivot of its own, found as in step 1.  Documents that have a run of
   ``WORDS`` words in common share all signatures there, so one way or the other both have a stretch there.  A document and
   the pivots of a stretch of such windows are candidates.
3. Candidates are verified on the tokens themselves (32 bits of each, around the windows): the positions of one document whose token the other one has, gaps
   of up to ``GAP`` closed, make a passage if it has at least ``WORDS`` words and ``SHARE`` of its tokens are common.
4. Two members can share what their pivot lacks.  So every run of ``WORDS`` words of the candidates' stretches is hashed, and
   what another document has word for word is a passage whatever the pivots confirmed.

Documents of equal words are one point; what repeats in copies is the whole text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textkernel as K
from .common import Scratch, lean, map_groups, maybe_broadcast, spread

SHINGLE = 5
HASHES = 4
LEAST = 40
ENOUGH = 2
WORDS = 50
GAP = 10
SHARE = 0.8
BLOCK = 512
WINDOWS = 20_000  # so many windows of documents (of one of more) are paired at once
REMEMBERED = 20_000  # documents that a task remembers in order not to scan a copy again
_BASE, _INVERSE = np.uint64(0x9E3779B97F4A7C15), np.uint64(pow(0x9E3779B97F4A7C15, -1, 2**64))
_SEEDS = K.mix(np.arange(101, 101 + HASHES, dtype=np.uint64))


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """The least of each run of ``width`` values, by doubling."""
    if len(x) < width:
        return x[:0]
    have, span = x, 1
    while span * 2 <= width:
        have = np.minimum(have[:-span], have[span:])
        span *= 2
    return np.minimum(have[: len(x) - width + 1], have[width - span : width - span + len(x) - width + 1])


def compact_windows(documents: list[np.ndarray], least: int, seed: np.uint64) -> tuple[np.ndarray, ...]:
    """(document, signature, l, c, r, from, to) of the compact windows of ``documents`` that are at least ``least`` wide.

    ``r`` is inclusive; from and to (inclusive) bound the runs of ``least`` tokens that have the signature, which is more
    than those around c where the token repeats.

    All documents (none shorter than ``least``) are scanned as one array.  A token is the minimum of some run of ``least`` tokens
    exactly if its compact window is that wide, so the sliding minima name the tokens and the Cartesian tree over
    them gives the windows' ends.  Of equal values far apart the left one counts as smaller.
    """
    tokens = np.concatenate(documents)
    ends = np.cumsum([len(d) for d in documents])
    begins = ends - [len(d) for d in documents]
    with np.errstate(over="ignore"):
        h = K.mix(tokens ^ seed)
    low = sliding_min(h, least)
    owner = np.repeat(np.arange(len(documents)), ends - begins)[: len(low)]
    inside = np.arange(len(low)) + least <= ends[owner]  # runs that end in the document in which they begin
    new = inside.copy()
    new[1:] &= ~(inside[:-1] & (low[1:] == low[:-1]))
    first = np.flatnonzero(new)
    over = inside.copy()
    over[:-1] &= ~(inside[1:] & (low[1:] == low[:-1]))
    last = np.flatnonzero(over)
    value, owner = low[first], owner[first]
    # the first and the last place of the minimum in its runs; equal ones between them are one node
    early, late = np.full(len(first), -1), np.full(len(first), -1)
    for place, start, order in ((early, first, range(least)), (late, last, range(least - 1, -1, -1))):
        todo = np.arange(len(first))
        for d in order:
            hit = h[start[todo] + d] == value[todo]
            place[todo[hit]] = start[todo[hit]] + d
            todo = todo[~hit]
            if not len(todo):
                break
    # the Cartesian tree over the minima: nearest smaller one on either side
    left, right = begins[owner].tolist(), (ends[owner] - 1).tolist()
    stack: list[int] = []
    values, firsts, lasts, homes = value.tolist(), early.tolist(), late.tolist(), owner.tolist()
    for i, v in enumerate(values):
        if stack and homes[stack[-1]] != homes[i]:
            stack.clear()
        while stack and values[stack[-1]] > v:
            right[stack.pop()] = firsts[i] - 1
        if stack:
            left[i] = lasts[stack[-1]] + 1
        stack.append(i)
    # a smaller token nearer than any minimum ends a window that ``least`` did not cut off
    left, right = np.array(left, np.int64), np.array(right, np.int64)
    left = np.where(early - first < least - 1, np.maximum(left, first), left)
    right = np.where(last < late, np.minimum(right, last + least - 1), right)
    base = begins[owner]
    return owner, value, left - base, early - base, right - base, first - base, last + least - 1 - base


def _tokens(data: np.ndarray, off: np.ndarray, shingle: int) -> Iterator[np.ndarray]:
    starts, ends, first = K.word_bounds(data, off)
    words = K.word_hashes(data, starts, ends, fold=True)
    grams = K.shingle_hashes(words, shingle)
    for a, b in zip(first[:-1], first[1:]):
        yield grams[a : max(a, b - shingle + 1)]


def _signatures(documents: list[np.ndarray], names: np.ndarray, least: int) -> pa.RecordBatch:
    """(key, fp): the distinct signatures of each document."""
    ends = np.cumsum([len(d) for d in documents])
    tokens, owner = np.concatenate(documents), np.repeat(np.arange(len(documents)), [len(d) for d in documents])
    keys, owners = [], []
    for seed in _SEEDS:
        with np.errstate(over="ignore"):
            low = sliding_min(K.mix(tokens ^ seed), least)
            keep = np.arange(len(low)) + least <= ends[owner[: len(low)]]
            keep[1:] &= ~(keep[:-1] & (low[1:] == low[:-1]))
            keys.append(K.mix(low[keep] + seed))
        owners.append(owner[: len(low)][keep])
    key, own = np.concatenate(keys), np.concatenate(owners)
    order = np.lexsort((own, key))
    key, own = key[order], own[order]
    new = np.ones(len(key), bool)
    new[1:] = (key[1:] != key[:-1]) | (own[1:] != own[:-1])
    return pa.record_batch({"key": key[new].view(np.int64), "fp": names[own[new]]})


def name_tokens(tokens: np.ndarray) -> int:
    """A 64-bit name of a token sequence."""
    with np.errstate(over="ignore"):
        order = K.mix(np.arange(len(tokens), dtype=np.uint64))
        return int(K.mix(np.array([(K.mix(tokens ^ order)).sum(dtype=np.uint64) + np.uint64(len(tokens))], np.uint64)).view(np.int64)[0])


def common_passages(tokens: np.ndarray, other: np.ndarray, shingle: int, words: int, gap: int, share: float) -> tuple[np.ndarray, np.ndarray]:
    """[start, end) in words of the passages of ``tokens`` whose tokens ``other`` (sorted) has."""
    place = np.minimum(np.searchsorted(other, tokens), max(len(other) - 1, 0))
    has = other[place] == tokens if len(other) else np.zeros(len(tokens), bool)
    at = np.flatnonzero(has)
    if not len(at):
        return at, at
    total = np.concatenate([[0], np.cumsum(has)])
    begins, ends = [], []
    for most in (1, gap // 2 + 1, gap + 1):  # a run that is whole counts also where closing gaps would water it down
        cut = np.flatnonzero(np.diff(at) > most)
        begin, end = at[np.concatenate([[0], cut + 1])], at[np.concatenate([cut, [len(at) - 1]])] + 1
        ok = (end - begin + shingle - 1 >= words) & (total[end] - total[begin] >= share * (end - begin))
        begins.append(begin[ok])
        ends.append(end[ok] + shingle - 1)
    return np.concatenate(begins), np.concatenate(ends)


def interval_join(left: np.ndarray, right: np.ndarray, which: np.ndarray, pivot: np.ndarray, enough: int) -> dict[int, list[list[int]]]:
    """For each pivot of windows that overlap windows of ``enough`` hash functions in all, the stretches of such windows.

    A sweep over the windows' left ends; ``which`` is a window's hash function.  Functions count whatever their pivots
    are: a passage's signatures can have different ones, where other documents hold parts of it.
    """
    order = np.lexsort((right, left))
    left, right, which, pivot = (x[order].tolist() for x in (left, right, which, pivot))
    good: set[int] = set()
    open_: list[int] = []
    for i in range(len(left)):
        open_ = [j for j in open_ if right[j] >= left[i]]
        open_.append(i)
        if len({which[j] for j in open_}) >= enough:
            good.update(open_)
    found: dict[int, list[list[int]]] = {}
    stretch: list[int] = []
    pivots: set[int] = set()
    for i in [*sorted(good), -1]:
        if stretch and (i < 0 or left[i] > stretch[1] + WORDS):
            for p in pivots:  # a pivot may hold more of a stretch than the windows that met it
                found.setdefault(p, []).append(stretch)
            stretch, pivots = [], set()
        if i >= 0:
            stretch = [stretch[0], max(stretch[1], right[i])] if stretch else [left[i], right[i]]
            pivots.add(pivot[i])
    return found


def window_pairs(owner: np.ndarray, key: np.ndarray, left: np.ndarray, right: np.ndarray, which: np.ndarray, pivot: np.ndarray) -> tuple[np.ndarray, ...]:
    """(document, name, l, r) of the pairs of overlapping windows of two functions that met different pivots.

    Both windows lie in [l, r].  A pair's name depends on the two signatures only.
    """
    order = np.lexsort((right, left, owner))
    owner, key, left, right, which, pivot = (x[order] for x in (owner, key, left, right, which, pivot))
    found = []
    first = np.arange(len(owner))
    for ahead in range(1, len(owner)):
        first = first[: np.searchsorted(first, len(owner) - ahead)]
        first = first[(owner[first + ahead] == owner[first]) & (left[first + ahead] <= right[first])]
        if not len(first):
            break
        second = first + ahead
        ok = (which[first] != which[second]) & (pivot[first] != pivot[second])
        a, b = first[ok], second[ok]
        swap = which[a] > which[b]
        with np.errstate(over="ignore"):
            name = K.mix(K.mix(key[np.where(swap, b, a)].view(np.uint64)) + key[np.where(swap, a, b)].view(np.uint64)).view(np.int64)
        found.append((owner[a], name, left[a], np.maximum(right[a], right[b])))
    if not found:
        return owner[:0], key[:0], left[:0], right[:0]
    return tuple(np.concatenate(x) for x in zip(*found))


def chain(owner: np.ndarray, left: np.ndarray, right: np.ndarray, pivot: np.ndarray) -> tuple[np.ndarray, ...]:
    """(document, pivot, l, r), by document and pivot: the stretches of windows up to ``WORDS`` apart, for each pivot in them."""
    order = np.lexsort((left, owner))
    owner, left, right, pivot = (x[order].astype(np.int64) for x in (owner, left, right, pivot))
    if not len(owner):
        return owner, pivot, left, right
    apart = owner * (right.max() + WORDS + 2)  # documents one after another, further apart than windows of one stretch
    reach = np.maximum.accumulate(right + apart)
    new = np.ones(len(owner), bool)
    new[1:] = left[1:] + apart[1:] > reach[:-1] + WORDS
    begin, stretch = np.flatnonzero(new), np.cumsum(new) - 1
    end = np.append(begin[1:], len(owner)) - 1
    order = np.lexsort((stretch, pivot, owner))
    owner, pivot, stretch = owner[order], pivot[order], stretch[order]
    new[1:] = (stretch[1:] != stretch[:-1]) | (pivot[1:] != pivot[:-1])
    new[0] = True
    owner, pivot, stretch = owner[new], pivot[new], stretch[new]
    return owner, pivot, left[begin][stretch], (reach - apart)[end][stretch]


def run_hashes(tokens: np.ndarray, length: int) -> np.ndarray:
    """A 64-bit hash of each run of ``length`` tokens: a polynomial in an odd number, shifted to the run's begin."""
    if len(tokens) < length:
        return np.zeros(0, np.uint64)
    n = len(tokens) - length + 1
    with np.errstate(over="ignore"):
        power = np.cumprod(np.full(len(tokens), _BASE))
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(K.mix(tokens.astype(np.uint64)) * power)])
        # the last token of a run has the same power in all of them
        return K.mix((total[length:] - total[:n]) * np.cumprod(np.full(n, _INVERSE)))


def _union(begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The union of the intervals [begin, end), as disjoint ones in order."""
    order = np.argsort(begin, kind="stable")
    begin, end = begin[order], np.maximum.accumulate(end[order]) if len(end) else end
    new = np.ones(len(begin), bool)
    new[1:] = begin[1:] > end[:-1]
    return begin[new], end[np.append(np.flatnonzero(new)[1:], len(begin)) - 1] if len(begin) else end


def shared_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(fp, at) of the rows (h, fp, at), sorted by h, whose h several fp have; rows of a negative ``at`` only witness."""
    held = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32)]
    for batch in batches:
        if not batch.num_rows:
            continue
        h, fp, at = (np.concatenate([x, batch.column(i).to_numpy()]) for i, x in enumerate(held))
        begin = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
        least, most = np.minimum.reduceat(fp, begin), np.maximum.reduceat(fp, begin)
        hit = np.repeat(least != most, np.diff(np.append(begin, len(h)))) & (at >= 0)
        if hit.any():
            yield pa.record_batch({"fp": fp[hit], "at": at[hit]})
        # the last run may go on: one document's rows wait, of several two witnesses are enough
        last = begin[-1]
        held = [h[last:], fp[last:], at[last:]] if least[-1] == most[-1] else [np.repeat(h[last], 2), np.array([least[-1], most[-1]]), np.full(2, -1, np.int32)]


def _verify(table: pa.Table, shingle: int, words: int, gap: int, share: float) -> Iterator[pa.RecordBatch]:
    """The passages of the members of one star (a block of it), and the pivot's own, each passage once."""
    star = table.column("star")[0].as_py()
    fp, base = table.column("fp").to_pylist(), table.column("base").to_pylist()
    grams = table.column("tokens").combine_chunks()
    at, flat = grams.offsets.to_numpy(), grams.values.to_numpy()
    pieces = [(f, b, flat[at[i] : at[i + 1]]) for i, (f, b) in enumerate(zip(fp, base))]
    pivot = next((t for f, _, t in pieces if f == star), None)
    if pivot is None:
        raise ValueError(f"star {star} without its pivot's tokens")
    ordered = np.unique(pivot)
    out: set[tuple[int, int, int]] = set()
    for f, b, tokens in pieces:
        if f != star:
            mine = [(f, int(x) + b, int(y) + b) for x, y in zip(*common_passages(tokens, ordered, shingle, words, gap, share))]
            if mine:
                out.update(mine)
                out.update((star, int(x), int(y)) for x, y in zip(*common_passages(pivot, np.unique(tokens), shingle, words, gap, share)))
    found = sorted(out)
    if found:
        yield pa.record_batch({"fp": pa.array([x[0] for x in found], pa.int64()), "start": pa.array([x[1] for x in found], pa.int32()), "end": pa.array([x[2] for x in found], pa.int32())})


def repeated_passages(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, shingle: int = SHINGLE, least: int = LEAST, enough: int = ENOUGH, words: int = WORDS, gap: int = GAP, share: float = SHARE, block: int = BLOCK) -> DataFrame:
    """One row per passage: id, start_word, end_word (exclusive), n_words, whole (the passage is the whole document).

    A passage has at least ``words`` words (runs outside white space, A-Z lower-cased) and another document has it too.
    Overlapping findings of a document are one passage.  Documents of equal words repeat as a whole.  A document that
    repeats nothing, a null or empty text, and one of fewer words have no row.  Rows that repeat an id are documents
    of their own, so a row and its copy are passages of each other; a null id is carried through.  Other columns are not read.
    """
    scratch = Scratch(spark, "passages")
    shortest = max(least, words - shingle + 1)  # a shorter document has no passage and must not become a pivot
    named = spread(docs).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))

    def points(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, fp = np.zeros(batch.num_rows, np.int32), np.zeros(batch.num_rows, np.int64)
            for row, _, data, off in K.slices(batch.column(1)):
                for i, tokens in enumerate(_tokens(data, off, shingle), row):
                    if len(tokens):
                        n[i], fp[i] = len(tokens) + shingle - 1, name_tokens(tokens)
            yield pa.record_batch({"id": batch.column(0), "n": n, "fp": fp})

    def signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            if len(seen) > REMEMBERED:
                seen.clear()
            for _, _, data, off in K.slices(batch.column(0)):
                kept, names = [], []
                for tokens in _tokens(data, off, shingle):
                    if len(tokens) >= shortest and (fp := name_tokens(tokens)) not in seen:
                        seen.add(fp)
                        kept.append(tokens)
                        names.append(fp)
                if kept:
                    yield _signatures(kept, np.array(names, np.int64), least)

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            if len(seen) > REMEMBERED:
                seen.clear()
            for _, _, data, off in K.slices(batch.column(0)):
                kept, names = [], []
                for tokens in _tokens(data, off, shingle):
                    if len(tokens) >= shortest and (fp := name_tokens(tokens)) not in seen:
                        seen.add(fp)
                        kept.append(tokens)
                        names.append(fp)
                for j, seed in enumerate(_SEEDS if kept else ()):
                    owner, value, _, _, _, left, right = compact_windows(kept, least, seed)
                    with np.errstate(over="ignore"):
                        key = K.mix(value + seed).view(np.int64)
                    yield pa.record_batch({"key": key, "fp": np.array(names, np.int64)[owner], "j": np.full(len(key), j, np.int8), "l": left.astype(np.int32), "r": right.astype(np.int32)})

    rows = scratch.save(named.mapInArrow(lean(points), f"id {named.dtypes[0][1]}, n int, fp long"))
    sizes = scratch.save(rows.where(F.col("n") >= words).groupBy("fp").agg(F.count("*").alias("weight"), F.max("n").alias("n"), F.min("id").alias("least")))
    keys = named.select("text").mapInArrow(lean(signatures), "key long, fp long").groupBy("key").agg(F.min("fp").alias("pivot"), F.max("fp").alias("other"))
    keys = scratch.save(keys.where("pivot <> other").select("key", "pivot"))
    met = scratch.save(named.select("text").mapInArrow(lean(windows), "key long, fp long, j byte, l int, r int").join(keys, "key"))
    # all windows of a document that met a pivot: boundedly many, by its text
    mine = met.groupBy("fp").agg(F.collect_list(F.struct("key", "l", "r", "j", "pivot")).alias("w"))

    def meetings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # (fp, pair, pivot, l, r): windows that one pivot met, without a pair; pairs of windows, without a pivot
        for batch in batches:
            at = np.concatenate([[0], np.cumsum(batch.column(1).value_lengths().to_numpy())])
            key, left, right, which, pivot = (x.to_numpy() for x in batch.column(1).flatten().flatten())
            names = batch.column(0).to_numpy()
            row = 0
            while row < len(names):  # some documents at a time, so that working arrays stay small
                end = max(row + 1, int(np.searchsorted(at, at[row] + WINDOWS, "right")) - 1)
                one = slice(at[row], at[end])
                owner = np.repeat(np.arange(row, end), np.diff(at[row : end + 1]))
                k, l, r, j, p = key[one], left[one], right[one], which[one], pivot[one]
                order = np.lexsort((j, p, owner))
                new = np.ones(len(order), bool)
                new[1:] = (np.diff(owner[order]) != 0) | (np.diff(p[order]) != 0)
                begin = np.flatnonzero(new)
                kinds = np.add.reduceat(new | np.append(True, np.diff(j[order]) != 0), begin) if len(begin) else begin
                out: list[tuple[int, int, int, int]] = []
                for x, y in zip(begin[kinds >= enough].tolist(), np.append(begin[1:], len(order))[kinds >= enough].tolist()):
                    i = order[x:y]
                    for q, spans in interval_join(l[i], r[i], j[i], p[i], enough).items():
                        out += [(int(owner[i[0]]), q, *span) for span in spans]
                if out:
                    o, q, a, b = (np.array(x) for x in zip(*out))
                    yield pa.record_batch({"fp": names[o], "pair": pa.nulls(len(o), pa.int64()), "pivot": q, "l": a.astype(np.int32), "r": b.astype(np.int32)})
                o, name, a, b = window_pairs(owner, k, l, r, j, p)
                if len(o):
                    yield pa.record_batch({"fp": names[o], "pair": name, "pivot": pa.nulls(len(o), pa.int64()), "l": a, "r": b})
                row = end

    meets = scratch.save(mine.mapInArrow(lean(meetings), "fp long, pair long, pivot long, l int, r int"))
    apart = meets.where("pair is not null").drop("pivot")
    both = apart.groupBy("pair").agg(F.min("fp").alias("pivot"), F.max("fp").alias("other"))
    both = scratch.save(both.where("pivot <> other").select("pair", "pivot"))
    good = meets.where("pair is null").select("fp", "pivot", "l", "r").unionByName(apart.join(both, "pair").select("fp", "pivot", "l", "r"))

    def candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths = batch.column(1).value_lengths().to_numpy()
            left, right, pivot = (x.to_numpy() for x in batch.column(1).flatten().flatten())
            owner, pivot, left, right = chain(np.repeat(np.arange(len(lengths)), lengths), left, right, pivot)
            # a pivot may hold more of a stretch than the windows that met it
            begin = np.flatnonzero(np.append(True, (np.diff(owner) != 0) | (np.diff(pivot) != 0))[: len(owner)])
            at = pa.array(np.append(begin, len(owner)).astype(np.int32))
            lo, hi = (pa.ListArray.from_arrays(at, pa.array(x.astype(np.int32))) for x in (np.maximum(left - words, 0), right + words + 1))
            yield pa.record_batch({"fp": batch.column(0).take(pa.array(owner[begin])), "pivot": pivot[begin], "lo": lo, "hi": hi})

    joined = good.groupBy("fp").agg(F.collect_list(F.struct("l", "r", "pivot")).alias("w"))
    pairs = scratch.save(joined.mapInArrow(lean(candidates), "fp long, pivot long, lo array<int>, hi array<int>"))
    stars = pairs.where("fp <> pivot").groupBy("pivot").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"))
    stars = scratch.save(stars)
    members = pairs.where("fp <> pivot").join(maybe_broadcast(stars, 40), "pivot").select("fp", F.col("pivot").alias("star"), F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int").alias("part"), "lo", "hi")
    whole = F.array(F.lit(0)).alias("lo"), F.array(F.lit(2**31 - 1)).alias("hi")
    centres = stars.select(F.col("pivot").alias("fp"), F.col("pivot").alias("star"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("part"), *whole)
    seats = scratch.save(members.unionByName(centres).withColumn("task", F.xxhash64("star", "part")))
    # a pivot's own stretches are candidates too: another document can share one that its star does not confirm
    wanted = sizes.join(seats.select("fp").unionByName(pairs.select("fp")).distinct(), "fp", "left_semi")
    wanted = scratch.save(wanted.select(F.col("least").alias("id"), "fp"))

    def tokens_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, data, off in K.slices(batch.column(0)):
                found = [t for t in _tokens(data, off, shingle) if len(t)]
                if found:
                    at = np.concatenate([[0], np.cumsum([len(t) for t in found])]).astype(np.int32)
                    yield pa.record_batch({"fp": pa.array([name_tokens(t) for t in found], pa.int64()), "tokens": pa.ListArray.from_arrays(pa.array(at), pa.array((np.concatenate(found) >> np.uint64(32)).astype(np.uint32).view(np.int32)))})

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # only the parts of a text around its candidates travel to the star
        for batch in batches:
            los, his, tokens = (batch.column(i).to_pylist() if i < 5 else batch.column(i) for i in (3, 4, 5))
            at, flat = tokens.offsets.to_numpy(), tokens.values.to_numpy()
            row = np.repeat(np.arange(batch.num_rows), [len(x) for x in los])
            base = np.array([x for lo in los for x in lo], np.int64)
            end = np.minimum([x for hi in his for x in hi], np.diff(at)[row])
            pieces = [flat[at[r] + a : at[r] + b] for r, a, b in zip(row.tolist(), base.tolist(), end.tolist())]
            offsets = np.concatenate([[0], np.cumsum([len(x) for x in pieces])]).astype(np.int32)
            yield pa.record_batch({"task": batch.column(1).take(pa.array(row)), "star": batch.column(2).take(pa.array(row)), "fp": batch.column(0).take(pa.array(row)), "base": pa.array(base, pa.int32()), "tokens": pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([*pieces, np.zeros(0, np.int32)])))})

    texts = named.join(maybe_broadcast(wanted.select("id").distinct(), 24), "id", "left_semi").unionByName(named.where("id is null"))
    tokens = scratch.save(texts.select("text").mapInArrow(lean(tokens_of), "fp long, tokens array<int>").dropDuplicates(["fp"]))

    def verify(table: pa.Table) -> Iterator[pa.RecordBatch]:
        return _verify(table, shingle, words, gap, share)

    parts = seats.join(tokens, "fp").select("fp", "task", "star", "lo", "hi", "tokens").mapInArrow(lean(cut), "task long, star long, fp long, base int, tokens array<int>")
    found = scratch.save(map_groups(parts, "task", verify, "fp long, start int, end int").distinct())

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        length = words - shingle + 1
        for batch in batches:
            grams, spans, done = batch.column(1), batch.column(2), batch.column(3)
            for i, fp in enumerate(batch.column(0).to_pylist()):
                h = run_hashes(grams[i].values.to_numpy().view(np.uint32), length).view(np.int64)
                inside, known = np.zeros(len(h) + 1, np.int32), np.zeros(len(h), bool)
                for lo, hi in zip(*_union(*(spans[i].values.field(k).to_numpy().astype(np.int64) for k in range(2)))):
                    inside[min(lo, len(h))] += 1
                    inside[min(max(hi - length + 1, lo), len(h))] -= 1
                if done[i].is_valid:
                    for lo, hi in zip(*_union(*(done[i].values.field(k).to_numpy().astype(np.int64) for k in range(2)))):
                        known[lo : max(lo, hi - words + 1)] = True
                at = np.flatnonzero(np.cumsum(inside[:-1]) > 0)
                if len(at):
                    yield pa.record_batch({"h": h[at], "fp": np.full(len(at), fp), "at": np.where(known[at], -1, at).astype(np.int32)})

    def join_runs(table: pa.Table) -> Iterator[pa.RecordBatch]:
        at = table.column("at").to_numpy().astype(np.int64)
        begin, end = _union(at, at + words)
        yield pa.record_batch({"fp": np.full(len(begin), table.column("fp")[0].as_py()), "start": begin.astype(np.int32), "end": end.astype(np.int32)})

    stretches = pairs.select("fp", F.arrays_zip("lo", "hi").alias("w")).groupBy("fp").agg(F.array_distinct(F.flatten(F.collect_set("w"))).alias("w"))
    confirmed = found.groupBy("fp").agg(F.collect_list(F.struct("start", "end")).alias("done"))
    hashed = tokens.join(stretches, "fp").join(confirmed, "fp", "left").select("fp", "tokens", "w", "done").mapInArrow(lean(runs), "h long, fp long, at int")
    beyond = scratch.save(hashed.repartition("h").sortWithinPartitions("h").mapInArrow(lean(shared_runs), "fp long, at int"))
    found = found.unionByName(map_groups(beyond, "fp", join_runs, "fp long, start int, end int"))
    copies = sizes.where("weight > 1").select("fp", F.lit(0).alias("start"), F.col("n").alias("end"))
    spans = found.unionByName(copies).groupBy("fp").agg(F.array_sort(F.collect_set(F.struct("start", "end"))).alias("s"))
    # overlapping passages of a text become one
    merge = """aggregate(s, cast(array() as array<struct<start:int,end:int>>), (acc, x) ->
        case when size(acc) > 0 and element_at(acc, -1).end >= x.start
             then concat(slice(acc, 1, size(acc) - 1), array(named_struct('start', element_at(acc, -1).start, 'end', greatest(element_at(acc, -1).end, x.end))))
             else concat(acc, array(x)) end)"""
    spans = scratch.save(spans.select("fp", F.explode(F.expr(merge)).alias("s")))
    out = rows.where("n > 0").join(spans, "fp")
    return out.select(F.col("id").alias(id_col), F.col("s.start").alias("start_word"), F.col("s.end").alias("end_word"), (F.col("s.end") - F.col("s.start")).alias("n_words"), ((F.col("s.start") == 0) & (F.col("s.end") == F.col("n"))).alias("whole"))
