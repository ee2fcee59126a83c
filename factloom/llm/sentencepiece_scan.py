"""SentencePiece encoding and decoding, giant documents by a max-plus parallel scan.

The model file is a BPE model with byte fallback; its segmentation is the unique sequence of pieces in which every
two neighbours would not be merged otherwise (encoding their concatenation gives the two of them back).  So encoding is a
best-path problem over states (position, last piece): a step has the piece's score, or -inf if the neighbours do not fit,
and a text's encoding is the one path of finite weight.  That makes it a product of matrices over (max, +):

* A document of more than ``GIANT`` characters is cut into chunks of equal length, wherever the cuts fall.  The states of a
  cut are the pieces that can cover it or end at it, several for nearly every cut.
* Each chunk gives its transfer matrix from the states of its left boundary to those of its right one.  Paths meet again where a
  word ends and a space begins, which no piece spans: in a chunk with such places the matrix is the max-plus product of a
  column (each left state's way to the first place) and a row (from the last place to each right state), and what lies
  between, the same for all, is left out.  A chunk without one has its matrix by the paths of each state.
* The matrices are combined associatively, by a tree of max-plus products whose nodes are tasks of ``FAN`` matrices, and the best states
  at all boundaries read off on the way down.
* Each chunk, given its two states, is traced back by itself; between the places where paths meet the library encodes it.

Documents that are no giants are encoded by the library.  Decoding joins the pieces' bytes.

The library takes U+2581, its own mark for a space, for a space; to keep the round trip exact such a character is
encoded by its three byte pieces here, in giants (where a lone surrogate stands for it) as in other texts.  Everything else
equals the library's result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textkernel as K
from .common import Scratch, lean, spread

GIANT = 65_536
CHUNK = 16_384
FAN = 64  # matrices that one node of the tree combines
MARK = "▁"
TAKEN = "\udc81"  # stands for a U+2581 of the text itself; no text can hold it
KNOWN = 100_000  # answers about pieces that a worker remembers, some 300 bytes each
_NONE = -np.inf


class Pieces:
    """A model file's pieces and its encoder; one per worker and file."""

    def __init__(self, path: str):
        self.sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = self.sp.get_piece_size()
        names = [self.sp.id_to_piece(i) for i in range(n)]
        self.byte = {int(names[i][3:5], 16): i for i in range(n) if self.sp.is_byte(i)}
        self.id = {names[i]: i for i in range(n) if not (self.sp.is_byte(i) or self.sp.is_control(i) or self.sp.is_unknown(i) or self.sp.is_unused(i))}
        self.score = {p: self.sp.get_score(i) for p, i in self.id.items()}
        self.longest = max(map(len, self.id))
        self.spans_words = any(MARK in p.lstrip(MARK) for p in self.id)
        self.bytes = [bytes([int(names[i][3:5], 16)]) if self.sp.is_byte(i) else b"" if self.sp.is_control(i) else names[i].replace(MARK, " ").encode() for i in range(n)]
        self._fits: dict[tuple[str, str], bool] = {}
        # no piece holds this character, so nothing merges across it: text behind it is encoded as inside a document
        self.fence = next(c for c in "\n\t\r\x01\x02" if not any(c in p for p in self.id))
        self.fence_ids = len(self.sp.encode(self.fence))

    def inner(self, text: str) -> list[int]:
        """The ids of text that does not begin a document."""
        return self.sp.encode(self.fence + text, num_threads=1)[self.fence_ids :]

    def encode(self, texts: list[str]) -> list[list[int]]:
        out = self.sp.encode(texts, num_threads=1)
        for i, text in enumerate(texts):
            if MARK in text:
                out[i] = self.encode_part(text, True)
        return out

    def encode_part(self, text: str, first: bool) -> list[int]:
        """The ids of a text, or of a part that begins and ends at one-state boundaries."""
        parts = text.split(MARK)
        ids = (self.sp.encode(parts[0], num_threads=1) if first else self.inner(parts[0])) if parts[0] else []
        for part in parts[1:]:
            ids += [self.byte[b] for b in MARK.encode()]
            if part:
                ids += self.inner(part)
        return ids

    def decode(self, ids: list[int]) -> bytes:
        text = b"".join(map(self.bytes.__getitem__, ids))
        return text[1:] if ids and text[:1] == b" " and not self.sp.is_byte(ids[0]) else text

    def merge(self, symbols: list[str]) -> list[str]:
        """BPE by the model's scores: the best adjacent pair first, the leftmost of equal ones."""
        while len(symbols) > 1:
            best, at = _NONE, -1
            for i in range(len(symbols) - 1):
                score = self.score.get(symbols[i] + symbols[i + 1], _NONE)
                if score > best:
                    best, at = score, i
            if at < 0:
                break
            symbols[at : at + 2] = [symbols[at] + symbols[at + 1]]
        return symbols

    def fits(self, a: str, b: str) -> bool:
        known = self._fits.get((a, b))
        if known is None:
            known = self._fits[a, b] = self.merge(list(a + b)) == [a, b]
            if len(self._fits) > KNOWN:
                self._fits.clear()
        return known

    def piece_ids(self, piece: str) -> list[int]:
        found = self.id.get(piece)
        return [found] if found is not None else [self.byte[b] for b in (MARK if piece == TAKEN else piece).encode()]

    def ending(self, text: str, end: int, low: int = 0) -> Iterator[str]:
        """Pieces (or lone unknown characters) that end at ``end`` and begin at ``low`` or later."""
        for n in range(1, min(self.longest, end - low) + 1):
            piece = text[end - n : end]
            if n == 1 or (piece in self.id and self.fits_alone(piece)):
                yield piece

    def fits_alone(self, piece: str) -> bool:
        known = self._fits.get((piece, ""))
        if known is None:
            known = self._fits[piece, ""] = self.merge(list(piece)) == [piece]
        return known

    def states(self, text: str, at: int) -> list[tuple[int, str]]:
        """The states of a boundary: (end, piece) of each piece that covers or ends at position ``at``."""
        return [(e, p) for e in range(at, min(len(text), at + self.longest - 1) + 1) for p in self.ending(text, e) if e - len(p) < at]

    def paths(self, text: str, start: tuple[int, str] | None, low: int, end: int) -> dict[int, str]:
        """The last piece of the one fitting path from ``start`` (None: the beginning, at ``low``) to each position up to ``end``."""
        last: dict[int, str] = {}
        begin = low if start is None else start[0]
        for i in range(begin + 1, end + 1):
            for piece in self.ending(text, i, begin):
                j = i - len(piece)
                if j == begin:
                    ok = start is None or self.fits(start[1], piece)
                else:
                    ok = j in last and self.fits(last[j], piece)
                if ok:
                    last[i] = piece
                    break
        return last

    def trace(self, last: dict[int, str], begin: int, end: int) -> list[str] | None:
        out = []
        while end > begin:
            if end not in last:
                return None
            out.append(last[end])
            end -= len(last[end])
        return out[::-1] if end == begin else None


@lru_cache(maxsize=2)
def pieces_of(path: str) -> Pieces:
    return Pieces(path)


def mark(text: str) -> str:
    """The text with its spaces marked, one before it (but before a mark of its own), and its own marks out of the way."""
    return ("" if text.startswith(MARK) else MARK) + text.replace(MARK, TAKEN).replace(" ", MARK)


def unmark(text: str) -> str:
    return text.removeprefix(MARK).replace(MARK, " ").replace(TAKEN, MARK)


def cut_points(text: str, chunk: int) -> list[int]:
    """The cuts inside ``text`` (marked)."""
    return list(range(chunk, len(text), chunk))


def meeting(pieces: Pieces, text: str, begin: int, end: int) -> tuple[int, int] | None:
    """The first and the last place in (begin, end) where a word ends and a space begins, which no piece spans."""
    if pieces.spans_words:
        return None
    first = begin
    while True:
        first = text.find(MARK, first + 1, end)
        if first < 0:
            return None
        if text[first - 1] != MARK:
            break
    last = end
    while True:
        last = text.rfind(MARK, first, last)
        if text[last - 1] != MARK:
            return first, last


def ways_in(pieces: Pieces, text: str, start: tuple[int, str] | None, low: int, end: int) -> list[str] | None:
    """The pieces from a state to ``end``, or None if there is no fitting path."""
    begin = low if start is None else start[0]
    return pieces.trace(pieces.paths(text, start, begin, end), begin, end)


def weigh(pieces: Pieces, path: list[str] | None) -> float:
    return _NONE if path is None else sum(pieces.score.get(p, 0.0) for p in path)


Bound = tuple[int, bool]  # a position, and whether it is a cut of several states or an end of the text


def bound_states(pieces: Pieces, text: str, at: Bound) -> list:
    return pieces.states(text, at[0]) if at[1] else [None]


def ways_out(pieces: Pieces, text: str, start: tuple[int, str] | None, low: int, ends: list) -> list[list[str] | None]:
    """For each state of ``ends`` the pieces from ``start`` to it, its own piece included."""
    begin = low if start is None else start[0]
    last = pieces.paths(text, start, begin, max(e for e, _ in ends))
    out: list[list[str] | None] = []
    for end, piece in ends:
        if start is not None and (end, piece) == start:  # one piece covers the whole chunk
            out.append([])
        else:
            out.append(pieces.trace(last, begin, end) if end >= begin and (piece is None or last.get(end) == piece) else None)
    return out


def transfer(pieces: Pieces, text: str, left: Bound, right: Bound) -> np.ndarray:
    """The chunk's matrix over (max, +): rows are the states of the left boundary, columns those of the right one."""
    starts = bound_states(pieces, text, left)
    ends = pieces.states(text, right[0]) if right[1] else [(right[0], None)]
    meet = meeting(pieces, text, left[0], right[0])
    if meet is not None:
        column = np.array([weigh(pieces, ways_in(pieces, text, s, left[0], meet[0])) for s in starts])
        row = np.array([weigh(pieces, x) for x in ways_out(pieces, text, None, meet[1], ends)])
        return column[:, None] + row[None, :]
    return np.array([[weigh(pieces, x) for x in ways_out(pieces, text, s, left[0], ends)] for s in starts])


def compose(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The max-plus product: associative, so prefixes of chunks can be combined in any grouping."""
    return (a[:, :, None] + b[None, :, :]).max(1)


def best_states(matrices: list[np.ndarray], enter: int = 0, leave: int = 0) -> list[int]:
    """The state at each boundary (len + 1) of the best path from ``enter`` to ``leave`` through all chunks, from prefix and suffix
    products."""
    ahead, behind = [matrices[0][enter : enter + 1]], [matrices[-1][:, leave : leave + 1]]
    for m in matrices[1:-1]:
        ahead.append(compose(ahead[-1], m))
    for m in matrices[-2:0:-1]:
        behind.append(compose(m, behind[-1]))
    behind.reverse()
    inner = [int((ahead[k][0] + behind[k][:, 0]).argmax()) for k in range(len(matrices) - 1)]
    return [enter, *inner, leave]


def product(matrices: list[np.ndarray]) -> np.ndarray:
    out = matrices[0]
    for m in matrices[1:]:
        out = compose(out, m)
    return out


def encode_free(pieces: Pieces, text: str) -> list[int]:
    """The ids of a marked text between two places where paths meet, by the library."""
    if not text:
        return []
    out: list[int] = []
    for k, part in enumerate(text.split(TAKEN)):
        out += [pieces.byte[b] for b in MARK.encode()] if k else []
        out += pieces.inner(part.replace(MARK, " ")) if part else []
    return out


def trace_chunk(pieces: Pieces, text: str, left: Bound, right: Bound, enter: int, leave: int) -> list[int]:
    """The ids of the pieces between the two chosen states, from this chunk's text alone."""
    start = bound_states(pieces, text, left)[enter]
    end = pieces.states(text, right[0])[leave] if right[1] else (right[0], None)
    meet = meeting(pieces, text, left[0], right[0])
    if meet is None:
        found = ways_out(pieces, text, start, left[0], [end])[0]
        if found is None:
            raise ValueError("the chunk has no fitting path between its states")
        return [x for p in found for x in pieces.piece_ids(p)]
    head, tail = ways_in(pieces, text, start, left[0], meet[0]), ways_out(pieces, text, None, meet[1], [end])[0]
    if head is None or tail is None:
        raise ValueError("the chunk has no fitting path between its states")
    ids = [x for p in head for x in pieces.piece_ids(p)] + encode_free(pieces, text[meet[0] : meet[1]])
    return ids + [x for p in tail for x in pieces.piece_ids(p)]


def steps_of(text: str, chunk: int) -> list[tuple[Bound, Bound]]:
    bounds = [(0, False), *[(x, True) for x in cut_points(text, chunk)], (len(text), False)]
    return list(zip(bounds[:-1], bounds[1:]))


def encode_giant(pieces: Pieces, text: str, chunk: int = CHUNK) -> list[int]:
    """All steps for one document in one place: what the tests compare with the library, and the plan of the tasks."""
    marked = mark(text)
    steps = steps_of(marked, chunk)
    states = best_states([transfer(pieces, marked, a, b) for a, b in steps])
    return [x for k, (a, b) in enumerate(steps) for x in trace_chunk(pieces, marked, a, b, states[k], states[k + 1])]


_MATRIX = "row long, k int, width int, matrix array<double>"


def choose_states(scratch: Scratch, matrices: DataFrame, fan: int = FAN) -> DataFrame:
    """(row, k, enter, leave): the states of each chunk's boundaries, from the transfer matrices (row, k, width, matrix).

    Up the tree, ``fan`` neighbouring matrices at a time become their product, until a document has one; down the tree each
    node, told its two outer states, finds those between its children.  No task holds more than ``fan`` matrices of a document.
    """

    def read(table: pa.Table) -> tuple[list[dict], list[np.ndarray]]:
        found = sorted(table.to_pylist(), key=lambda r: r["k"])
        return found, [np.array(r["matrix"]).reshape(-1, r["width"]) for r in found]

    def up(table: pa.Table) -> pa.Table:
        found, parts = read(table)
        m = product(parts)
        return pa.Table.from_pylist([{"row": found[0]["row"], "k": found[0]["k"] // fan, "width": m.shape[1], "matrix": m.reshape(-1).tolist()}], schema=pa.schema([("row", pa.int64()), ("k", pa.int32()), ("width", pa.int32()), ("matrix", pa.list_(pa.float64()))]))

    def down(table: pa.Table) -> pa.Table:
        found, parts = read(table)
        states = best_states(parts, found[0]["enter"], found[0]["leave"])
        return pa.table({"row": pa.array([r["row"] for r in found], pa.int64()), "k": pa.array([r["k"] for r in found], pa.int32()), "enter": pa.array(states[:-1], pa.int32()), "leave": pa.array(states[1:], pa.int32())})

    levels, longest = [matrices], matrices.agg(F.max("k")).first()[0]
    while longest:
        node = F.expr(f"k div {fan}").cast("int")
        levels.append(scratch.save(levels[-1].groupBy("row", node.alias("node")).applyInArrow(up, _MATRIX)))
        longest //= fan
    told = levels[-1].select("row", "k", F.lit(0).alias("enter"), F.lit(0).alias("leave"))
    for level in levels[-2::-1]:
        node = F.expr(f"k div {fan}").cast("int")
        given = level.withColumn("node", node).join(told.withColumnRenamed("k", "node"), ["row", "node"])
        told = scratch.save(given.groupBy("row", "node").applyInArrow(down, "row long, k int, enter int, leave int"))
    return told


def encode_documents(spark: SparkSession, docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text", *, giant: int = GIANT, chunk: int = CHUNK, keep_ids: bool = True, fan: int = FAN) -> DataFrame:
    """One row per row of ``docs``: id, n_tokens, ids_sha256 (of the ids as 32-bit little-endian), round_trip, scan_states (the
    number of states at the cuts of a giant document, 0 for others) and, if ``keep_ids``, token_ids.

    ``round_trip`` says that decoding gave the text's bytes back.  Null and empty texts have no tokens.  Repeated rows are
    encoded alike; other columns are not read.  A document of more than ``giant`` characters is spread over tasks.  An empty
    table gives no rows.
    """
    scratch = Scratch(spark, "pieces")
    named = spread(docs).select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    kind = named.dtypes[0][1]
    fields = f"id {kind}, n_tokens int, ids_sha256 string, round_trip boolean, scan_states int" + (", token_ids array<int>" if keep_ids else "")

    def rows(ids: pa.Array, tokens: list, texts: list[bytes], states: int = 0) -> pa.RecordBatch:
        pieces = pieces_of(model)
        arrays = [np.array(t, "<i4") for t in tokens]
        out = {
            "id": ids,
            "n_tokens": np.array([len(a) for a in arrays], np.int32),
            "ids_sha256": pa.array([hashlib.sha256(a.tobytes()).hexdigest() for a in arrays], pa.string()),
            "round_trip": pa.array([pieces.decode(t) == x for t, x in zip(tokens, texts)], pa.bool_()),
            "scan_states": pa.array([states] * len(arrays), pa.int32()),
        }
        if keep_ids:
            at = np.concatenate([[0], np.cumsum([len(a) for a in arrays])]).astype(np.int32)
            out["token_ids"] = pa.ListArray.from_arrays(pa.array(at), pa.array(np.concatenate([*arrays, np.zeros(0, "<i4")])))
        return pa.record_batch(out)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = pieces_of(model)
        for batch in batches:
            for lo, hi, data, off in K.slices(batch.column(1), 100_000):
                raw = data.tobytes()
                texts = [raw[a:b] for a, b in zip(off[:-1].tolist(), off[1:].tolist())]
                yield rows(batch.column(0).slice(lo, hi - lo), pieces.encode([t.decode() for t in texts]), texts)

    long = F.length("text") > giant
    usual = named.where(~long).mapInArrow(lean(encode), fields)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces, row = pieces_of(model), TaskContext.get().partitionId() << 40
        margin = 2 * pieces.longest
        kinds = [("row", pa.int64()), ("id", None), ("k", pa.int32()), ("part", pa.binary()), ("a", pa.int32()), ("b", pa.int32()), ("hard_a", pa.bool_()), ("hard_b", pa.bool_())]
        for batch in batches:
            schema = pa.schema([(n, t or batch.schema.field(0).type) for n, t in kinds])
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                marked, out = mark(text), []
                for k, (a, b) in enumerate(steps_of(marked, chunk)):
                    low, high = max(0, a[0] - margin), min(len(marked), b[0] + margin)
                    out.append({"row": row, "id": doc, "k": k, "part": marked[low:high].encode("utf-8", "surrogatepass"), "a": a[0] - low, "b": b[0] - low, "hard_a": a[1], "hard_b": b[1]})
                    if len(out) == 100:
                        yield pa.RecordBatch.from_pylist(out, schema=schema)
                        out = []
                yield pa.RecordBatch.from_pylist(out, schema=schema)
                row += 1

    chunks = scratch.save(named.where(long).mapInArrow(lean(cut), f"row long, id {kind}, k int, part binary, a int, b int, hard_a boolean, hard_b boolean"))
    dealt = chunks.repartition("row", "k")

    def matrices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = pieces_of(model)
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                m = transfer(pieces, r["part"].decode("utf-8", "surrogatepass"), (r["a"], r["hard_a"]), (r["b"], r["hard_b"]))
                out.append({"row": r["row"], "k": r["k"], "width": m.shape[1], "matrix": m.reshape(-1).tolist()})
            yield pa.RecordBatch.from_pylist(out, schema=pa.schema([("row", pa.int64()), ("k", pa.int32()), ("width", pa.int32()), ("matrix", pa.list_(pa.float64()))]))

    found = scratch.save(dealt.select("row", "k", "part", "a", "b", "hard_a", "hard_b").mapInArrow(lean(matrices), _MATRIX))
    chosen = choose_states(scratch, found, fan)
    chosen = chosen.join(found.select("row", "k", "width"), ["row", "k"])

    def back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = pieces_of(model)
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                text = r["part"].decode("utf-8", "surrogatepass")
                ids = trace_chunk(pieces, text, (r["a"], r["hard_a"]), (r["b"], r["hard_b"]), r["enter"], r["leave"])
                out.append({"row": r["row"], "id": r["id"], "k": r["k"], "ids": ids, "text": text[r["a"] : r["b"]].encode("utf-8", "surrogatepass"), "states": r["width"] if r["hard_b"] else 0})
            yield pa.RecordBatch.from_pylist(out, schema=pa.schema([("row", pa.int64()), ("id", batch.schema.field("id").type), ("k", pa.int32()), ("ids", pa.list_(pa.int32())), ("text", pa.binary()), ("states", pa.int32())]))

    traced = chunks.join(chosen, ["row", "k"]).mapInArrow(lean(back), f"row long, id {kind}, k int, ids array<int>, text binary, states int")

    def whole(table: pa.Table) -> pa.Table:
        found = sorted(table.to_pylist(), key=lambda r: r["k"])
        tokens = [x for r in found for x in r["ids"]]
        text = unmark("".join(r["text"].decode("utf-8", "surrogatepass") for r in found))
        return pa.Table.from_batches([rows(table.column("id").slice(0, 1).combine_chunks(), [tokens], [text.encode()], sum(r["states"] for r in found))])

    # a giant document's chunks meet in one row at the end, as any row does
    giants = scratch.save(traced).groupBy("row").applyInArrow(whole, fields)
    return usual.unionByName(giants).withColumnRenamed("id", id_col)
