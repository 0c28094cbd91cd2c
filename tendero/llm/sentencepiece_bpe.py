"""SentencePiece encoding (BPE models) by backtracking, and decoding.

A sequence of pieces is what merging would give if and only if each two neighbours are:
their texts, merged again together, must come out as the same two pieces. So a text is
walked from the left: the longest piece that starts here (all pieces of a stretch come
from one Aho-Corasick pass) is tried first, then shorter ones; a piece is taken if it is
compatible with the piece before; a position from which nothing leads on is marked in a
bitfield and never tried again.

Two facts of a model let a text be cut first: no piece holds a space behind another
character, and some characters stand alone in all pieces. The stretches between, met once
a process, are kept in a bounded memo. Pieces of equal score (runs of spaces) have no
order of their own; stretches with such runs are merged directly, leftmost first.

Rows: null counts as empty (begin and end ids only); repeated rows and null ids are
encoded one by one; long texts whole. Characters that the model lacks become bytes.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tendero.llm import words as W

GAP = "▁"
SLICE = 900_000  # bytes of text that are encoded at a time


class Model:
    """The pieces of a model file and exact encoding with them."""

    def __init__(self, path: str):
        processor = sentencepiece.SentencePieceProcessor(model_file=path)
        size = processor.vocab_size()
        self.begin, self.end, self.unknown = processor.bos_id(), processor.eos_id(), processor.unk_id()
        kinds = [processor.is_control(i) or processor.is_unknown(i) or processor.is_byte(i) or processor.is_unused(i) for i in range(size)]
        self.names = [processor.id_to_piece(i) for i in range(size)]
        self.id_of = {self.names[i]: i for i in range(size) if not kinds[i]}
        self.score = {p: processor.get_score(i) for p, i in self.id_of.items()}
        self.byte_id = {int(self.names[i][3:5], 16): i for i in range(size) if processor.is_byte(i)}
        if any(GAP in p.lstrip(GAP) for p in self.id_of):
            raise ValueError("a piece holds a space inside: texts of this model can't be cut at spaces")
        inside = set("".join(p for p in self.id_of if len(p) > 1))
        self.merging = {c for c in self.id_of if len(c) == 1 and c in inside} | {GAP}
        self.alone = np.array([chr(b) not in self.merging and b != 32 for b in range(128)] + [False] * 128)
        self.cut = re.compile("([^" + re.escape("".join(sorted(self.merging))) + "])")
        tied = {}
        for p, s in self.score.items():
            tied.setdefault(s, []).append(p)
        self.tied = {p for group in tied.values() if len(group) > 1 for p in group if len(p) > 1}
        self.tied_pairs = GAP * 2 if all(set(p) == {GAP} for p in self.tied) else None
        self.search = ahocorasick.Automaton()
        for p in self.id_of:
            self.search.add_word(p, p)
        self.search.make_automaton()
        self.fits: dict[tuple[str, str], bool] = {}
        self.spines: dict[str, tuple] = {}
        # bytes of each id for decoding; control ids give nothing, the unknown id its fixed text
        table = [b""] * size
        for p, i in self.id_of.items():
            table[i] = p.replace(GAP, " ").encode()
        for b, i in self.byte_id.items():
            table[i] = bytes([b])
        table[self.unknown] = " ⁇ ".encode()
        self.is_byte = np.zeros(size, bool)
        self.is_byte[list(self.byte_id.values())] = True
        self.gap_first = np.array([t.startswith(b" ") for t in table]) & ~self.is_byte
        self.lengths = np.array([len(t) for t in table])
        self.at = np.concatenate(([0], np.cumsum(self.lengths)))[:-1]
        self.bytes = np.frombuffer(b"".join(table), np.uint8)

    def merged(self, text: str, last: bool = False) -> list[str]:
        """Pieces by merging the best pair again and again, the leftmost of equal ones first.

        ``last``: the two parts of the very last merge instead, where it gives the whole text.
        """
        parts, after, before = list(text), list(range(1, len(text) + 1)), list(range(-1, len(text) - 1))
        heap: list = []

        def offer(i: int) -> None:
            j = after[i]
            if j < len(parts) and (s := self.score.get(parts[i] + parts[j])) is not None:
                heapq.heappush(heap, (-s, i, parts[i], parts[j]))

        for i in range(len(parts) - 1):
            offer(i)
        while heap:
            _, i, left, right = heapq.heappop(heap)
            j = after[i] if parts[i] == left else len(parts)
            if j >= len(parts) or parts[j] != right:
                continue
            if last and len(left) + len(right) == len(text):
                return [left, right]
            parts[i], parts[j], after[i] = left + right, "", after[j]
            if after[i] < len(parts):
                before[after[i]] = i
            if before[i] >= 0:
                offer(before[i])
            offer(i)
        return [p for p in parts if p]

    def fit(self, left: str, right: str) -> bool:
        """Whether two pieces come out again when their texts are merged together."""
        key = (left, right)
        if (ok := self.fits.get(key)) is None:
            if len(self.fits) > 300_000:
                self.fits.clear()
            ok = self.fits[key] = self._remerge(left, right) if left else self.merged(right) == [right]
        return ok

    def spine(self, piece: str) -> tuple:
        """How a piece grows at its two ends: (left end, right end), each smallest first as (text, score).

        None for a piece that merging doesn't give, or that grows out of parts of lower score.
        """
        if piece not in self.spines:
            parts = self.merged(piece, last=True)
            if len(piece) == 1:
                self.spines[piece] = ([(piece, 0.0)], [(piece, 0.0)])
            elif len(parts) != 2 or parts[0] + parts[1] != piece:
                self.spines[piece] = None
            else:
                own = self.score[piece]
                one, two = self.spine(parts[0]), self.spine(parts[1])
                low = any(len(p) > 1 and self.score[p] <= own for p in parts)
                self.spines[piece] = None if one is None or two is None or low else (
                    one[0] + [(piece, own)], two[1] + [(piece, own)])
        return self.spines[piece]

    def _remerge(self, left: str, right: str) -> bool:
        """Merges both texts side by side: no merge across the middle may come before the next one of a side."""
        one, two = self.spine(left), self.spine(right)
        if one is None or two is None:
            return self.merged(left + right) == [left, right]
        ends, heads, i, j = one[1], two[0], 0, 0
        while True:
            grow_left = ends[i + 1][1] if i + 1 < len(ends) else -np.inf
            grow_right = heads[j + 1][1] if j + 1 < len(heads) else -np.inf
            across = self.score.get(ends[i][0] + heads[j][0])
            if across is not None and across > grow_left and across >= grow_right:
                return False
            if grow_left == grow_right == -np.inf:
                return True
            if grow_left >= grow_right:
                i += 1
            else:
                j += 1

    def stretch(self, text: str) -> list[str]:
        """Pieces of a text of merging characters, by backtracking."""
        if self.tied_pairs is None or self.tied_pairs in text:
            return self.merged(text)
        if text in self.id_of and self.fit("", text):
            return [text]
        starts: list[list[str]] = [[] for _ in text]
        for end, piece in self.search.iter(text):
            starts[end + 1 - len(piece)].append(piece)  # shorter ones end, and so come, first
        fits, failed, taken, last, at, choice = self.fits, 0, [], "", 0, len(starts[0])
        while at < len(text):
            pieces, piece = starts[at], None
            while choice:
                choice -= 1
                piece = pieces[choice]
                if not failed >> (at + len(piece)) & 1:
                    ok = fits.get((last, piece))
                    if self.fit(last, piece) if ok is None else ok:
                        break
                piece = None
            if piece is not None:
                taken.append((last, choice))
                at += len(piece)
                last, choice = piece, len(starts[at]) if at < len(text) else 0
            else:
                failed |= 1 << at
                at -= len(last)
                last, choice = taken.pop()
        return [p for p, _ in taken[1:]] + [last]

    def unit(self, text: bytes) -> list[int]:
        """Ids of a stretch between cuts; spaces are its gaps."""
        out: list[int] = []
        for part in self.cut.split(text.decode("utf-8", "replace").replace(" ", GAP)):
            if not part:
                continue
            if len(part) == 1 and part not in self.merging:
                known = self.id_of.get(part)
                out += [known] if known is not None else [self.byte_id.get(b, self.unknown) for b in part.encode()]
            else:
                for piece in self.stretch(part):
                    known = self.id_of.get(piece)
                    out += [known] if known is not None else [self.byte_id.get(b, self.unknown) for b in piece.encode()]
        return out

    def units(self, spans: list[bytes]) -> list[list[int]]:
        return [self.unit(s) for s in spans]

    def encode(self, column: pa.Array, memo: W.WordMemo):
        """(first row, ids, edges) of slices of a text column, with begin and end ids."""
        column = pc.replace_substring(pc.fill_null(column, ""), GAP, " ")
        for first, end, data, offsets in W.slices(column, SLICE):
            n = end - first
            sizes = np.diff(offsets)
            # every text that isn't empty begins with a gap of its own
            data = np.insert(data, offsets[:-1][sizes > 0], 32)
            offsets = np.concatenate(([0], np.cumsum(sizes + (sizes > 0))))
            space, alone = data == 32, self.alone[data]
            start = alone.copy()
            start[1:] |= (space[1:] & ~space[:-1]) | alone[:-1]
            start[offsets[:-1][sizes > 0]] = True
            starts = np.flatnonzero(start)
            ends = np.append(starts[1:], len(data)) if len(starts) else starts
            flat, counts = memo.ids(data, starts, ends) if len(starts) else (np.zeros(0, np.int32), np.zeros(0, np.int64))
            upto = np.concatenate(([0], np.cumsum(counts)))[np.searchsorted(starts, offsets)]
            edges = upto + 2 * np.arange(n + 1)
            ids = np.empty(edges[-1], np.int32)
            ids[edges[:-1]], ids[edges[1:] - 1] = self.begin, self.end
            inner = np.ones(len(ids), bool)
            inner[edges[:-1]] = inner[edges[1:] - 1] = False
            ids[inner] = flat
            yield first, ids, edges

    def decode(self, ids: np.ndarray, edges: np.ndarray) -> list[bytes]:
        """UTF-8 texts of id sequences that lie end to end."""
        lengths = self.lengths[ids]
        data = self.bytes[W.ranges(self.at[ids], lengths)]
        upto = np.concatenate(([0], np.cumsum(lengths)))
        out = []
        for a, b in zip(edges[:-1].tolist(), edges[1:].tolist()):
            lo, hi = int(upto[a]), int(upto[b])
            k = a
            while k < b and not lengths[k]:
                k += 1
            if k < b and self.gap_first[ids[k]] and ids[k] != self.unknown:
                lo += 1  # the gap that encoding put in front
            text = data[lo:hi].tobytes()
            try:
                text.decode()
            except UnicodeDecodeError:
                text = self._mended(ids[k:b], lo - int(upto[k]))
            out.append(text)
        return out

    def _mended(self, ids: np.ndarray, skip: int) -> bytes:
        """Text whose byte pieces don't all make characters: each byte that doesn't is U+FFFD."""
        out, at = b"", 0
        while at < len(ids):
            end = at
            while end < len(ids) and self.is_byte[ids[end]]:
                end += 1
            if end == at:
                i = ids[at]
                out += self.bytes[self.at[i]:self.at[i] + self.lengths[i]].tobytes()
                at += 1
                continue
            run = b"".join(self.bytes[self.at[i]:self.at[i] + 1].tobytes() for i in ids[at:end])
            while run:
                for n in (1, 2, 3, 4):
                    try:
                        run[:n].decode()
                    except UnicodeDecodeError:
                        continue
                    out, run = out + run[:n], run[n:]
                    break
                else:
                    out, run = out + "�".encode(), run[1:]
            at = end
        return out[skip:]


@lru_cache(maxsize=2)
def _loaded(path: str) -> tuple[Model, W.WordMemo]:
    model = Model(path)
    return model, W.WordMemo(model.units)


def encode(docs: DataFrame, path: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids array<int>) of every row, with begin and end ids."""
    def run(batches):
        model, memo = _loaded(path)
        for batch in batches:
            for first, ids, edges in model.encode(batch.column(1), memo):
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(first, len(edges) - 1), pa.ListArray.from_arrays(pa.array(edges, pa.int32()), pa.array(ids))],
                    ["doc_id", "ids"])
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(W.trimmed(run), "doc_id long, ids array<int>")


def decode(coded: DataFrame, path: str) -> DataFrame:
    """(doc_id, text) of rows of (doc_id, ids); a null list is an empty text."""
    def run(batches):
        model, _ = _loaded(path)
        for batch in batches:
            lists = batch.column(1)
            ids = [np.array(x or [], np.int32) for x in lists.to_pylist()]
            edges = np.concatenate(([0], np.cumsum([len(x) for x in ids]))).astype(np.int64)
            texts = model.decode(np.concatenate(ids) if ids else np.zeros(0, np.int32), edges)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.binary()).cast(pa.string())], ["doc_id", "text"])
    return coded.select("doc_id", "ids").mapInArrow(W.trimmed(run), "doc_id long, text string")


def round_trip(docs: DataFrame, path: str, *, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256), and ``ids`` if wanted: both ways in one pass."""
    def run(batches):
        model, memo = _loaded(path)
        for batch in batches:
            for first, ids, edges in model.encode(batch.column(1), memo):
                raw = ids.astype("<u4").tobytes()
                own = [hashlib.sha256(raw[4 * a:4 * b]).hexdigest() for a, b in zip(edges[:-1].tolist(), edges[1:].tolist())]
                back = [hashlib.sha256(t).hexdigest() for t in model.decode(ids, edges)]
                more = [pa.ListArray.from_arrays(pa.array(edges, pa.int32()), pa.array(ids))] if with_ids else []
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(first, len(edges) - 1), pa.array(np.diff(edges)), pa.array(own), pa.array(back), *more],
                    ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", *["ids"] * with_ids])
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(
        W.trimmed(run), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids)
