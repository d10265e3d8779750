"""Operator 1: SentencePiece encoding and decoding of merge-type (BPE) vocabularies.

Encoding keeps an agenda of adjacent symbol pairs that form a piece, best score first and, among
equals, leftmost first.  The best pair is merged and its two new neighbours enter the agenda.
Characters that are no piece become byte pieces.  Long units have a heap for an agenda, from which
pairs whose symbols have changed meanwhile are passed over; short ones are merged many at a time,
each with a row of an array for its agenda.

A text is cut, before that, where no piece can reach across: before a white-space mark that follows
another character, and at line ends, if the vocabulary has no piece that crosses (this is looked up
when the vocabulary is loaded; if it has, whole texts are units).  Units repeat, so their ids are
kept in a bounded memo.  Every unit that enters the memo is checked, batch by batch, against the
sentencepiece library, and so are whole texts, encoded and decoded, one in ``check_every``.

Nulls and empty texts give the begin and end ids only and decode to the empty text.
"""

from __future__ import annotations

import hashlib
import heapq
import re
import struct
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import Memo, column_name, gaps, groups_of, keeps, map_batches, serve, text_column, texts, tokenizer_path

MARK = "▁"

#: Units in the memo.  Longer units are not kept.
MEMO_UNITS = 800_000
MEMO_UNIT_CHARS = 48

#: Ranks of pairs that form no piece, and the first id of characters that are none.
NO_PAIR = np.iinfo(np.int32).max
NO_PIECE = 1 << 21


#: The number by which model files mark a piece that is matched before all merges; a fixed value of the format.
USER_DEFINED = 4


def _varint(raw: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        value |= (raw[at] & 127) << shift
        shift += 7
        at += 1
        if raw[at - 1] < 128:
            return value, at


def _fields(raw: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Numbers and values of the fields of a protocol buffer."""
    at = 0
    while at < len(raw):
        key, at = _varint(raw, at)
        if key & 7 == 0:
            value, at = _varint(raw, at)
        else:
            size, at = _varint(raw, at) if key & 7 == 2 else ({1: 8, 5: 4}[key & 7], at)
            value, at = raw[at : at + size], at + size
        yield key >> 3, value


def piece_kinds(path: str) -> set[int]:
    """Kinds of the pieces of a model file: field 3 of each field 1; 1, a plain piece, if it is left out."""
    with open(path, "rb") as f:
        return {dict(_fields(piece)).get(3, 1) for number, piece in _fields(f.read()) if number == 1}


class SentencePieceBpe:
    """A merge-type vocabulary with its encoder and decoder."""

    def __init__(self, path: str):
        import sentencepiece

        self.library = sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        names = [sp.id_to_piece(i) for i in range(n)]
        plain = [i for i in range(n) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i))]
        if any(sp.is_unused(i) for i in plain):
            raise ValueError("vocabularies with unused pieces are not supported")
        if USER_DEFINED in piece_kinds(path):
            raise ValueError("vocabularies with user-defined symbols are not supported")
        if sp.encode("  a béﬁ ", out_type=str) and sp.decode(sp.encode(" a  ﬁ ")) != " a  ﬁ ":
            raise ValueError("vocabularies that normalise their text are not supported")
        self.merges = {names[i]: (-sp.get_score(i), i) for i in plain}
        self.bytes_id = {int(names[i][1:-1], 16): i for i in range(n) if sp.is_byte(i)}
        self.bos, self.eos, self.unk = sp.bos_id(), sp.eos_id(), sp.unk_id()
        self.raw = [names[i].replace(MARK, " ").encode() for i in range(n)]
        for i in range(n):
            if sp.is_control(i):
                self.raw[i] = b""
            elif sp.is_byte(i):
                self.raw[i] = bytes([int(names[i][1:-1], 16)])
            elif sp.is_unknown(i):
                self.raw[i] = " ⁇ ".encode()
        # all ways to make a piece of two symbols, as sorted keys, with the piece's rank and id
        symbols = {p: m[1] for p, m in self.merges.items()}
        rank = {x: i for i, x in enumerate(sorted({m[0] for m in self.merges.values()}))}
        made = []
        for p, (minus_score, i) in self.merges.items():
            for k in range(1, len(p)):
                a, b = p[:k], p[k:]
                x = symbols.get(a, NO_PIECE + ord(a) if len(a) == 1 else None)
                y = symbols.get(b, NO_PIECE + ord(b) if len(b) == 1 else None)
                if x is not None and y is not None:
                    made.append((x << 32 | y, rank[minus_score], i))
        made.sort()
        self.pair_keys = np.array([m[0] for m in made] + [np.iinfo(np.int64).max], np.int64)
        self.pair_ranks = np.array([m[1] for m in made] + [NO_PAIR], np.int32)
        self.pair_ids = np.array([m[2] for m in made] + [0], np.int32)
        self.char_ids = np.arange(NO_PIECE, NO_PIECE + 0x110000, dtype=np.int32)
        for p, i in symbols.items():
            if len(p) == 1:
                self.char_ids[ord(p)] = i
        crossing = any(re.search(f"[^{MARK}]{MARK}", names[i]) for i in plain)
        breaks = not any("\n" in names[i] and len(names[i]) > 1 for i in plain)
        stop = "\n" if breaks else ""
        self.units = re.compile("(?s).+" if crossing else f"{MARK}*[^{MARK}{stop}]+|{MARK}+|\n")
        self.memo = Memo(MEMO_UNITS)
        self.fresh: list[tuple[str, list[int]]] = []

    def merge(self, unit: str) -> list[int]:
        """Ids of one unit by the agenda of adjacent pairs."""
        merges = self.merges
        symbols: list = list(unit)
        n = len(symbols)
        left, right = list(range(-1, n - 1)), list(range(1, n + 1))
        agenda = [(m[0], i, i + 1, p) for i, p in enumerate(map(str.__add__, symbols, symbols[1:])) if (m := merges.get(p))]
        heapq.heapify(agenda)
        pop, push = heapq.heappop, heapq.heappush
        while agenda:
            _, i, j, piece = pop(agenda)
            if symbols[i] is None or symbols[j] is None or right[i] != j or symbols[i] + symbols[j] != piece:
                continue
            symbols[i], symbols[j] = piece, None
            k = right[i] = right[j]
            if k < n:
                left[k] = i
                if m := merges.get(p := piece + symbols[k]):
                    push(agenda, (m[0], i, k, p))
            if (h := left[i]) >= 0 and (m := merges.get(p := symbols[h] + piece)):
                push(agenda, (m[0], h, i, p))
        ids: list[int] = []
        for s in symbols:
            if s is None:
                continue
            if m := merges.get(s):
                ids.append(m[1])
            elif self.bytes_id:
                ids.extend(self.bytes_id[b] for b in s.encode())
            else:
                ids.append(self.unk)
        return ids

    def _pairs(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ranks and ids of what pairs of symbols form; NO_PAIR for none.  A symbol below 0 is none."""
        keys = left.astype(np.int64) << 32 | right.astype(np.int64)
        at = np.searchsorted(self.pair_keys, keys)
        ok = (self.pair_keys[np.minimum(at, len(self.pair_keys) - 1)] == keys) & (left >= 0) & (right >= 0)
        at = np.where(ok, at, len(self.pair_keys) - 1)
        return self.pair_ranks[at], self.pair_ids[at]

    def merge_many(self, units: list[str]) -> list[list[int]]:
        """Ids of units of alike lengths, by agendas that are rows of one array."""
        lengths = np.fromiter(map(len, units), np.int64, len(units))
        most = int(lengths.max())
        points = np.frombuffer("".join(units).encode("utf-32-le"), np.uint32)
        sym = np.full((len(units), most), -1, np.int32)
        sym[np.arange(most) < lengths[:, None]] = self.char_ids[points]
        done = np.empty_like(sym)
        rows = np.arange(len(units))
        rank, piece = self._pairs(sym[:, :-1], sym[:, 1:]) if most > 1 else (np.full((len(units), 1), NO_PAIR, np.int32), np.zeros((len(units), 1), np.int32))
        columns = np.arange(most)
        while len(rows):
            best = rank.argmin(1)
            at = np.arange(len(rows))
            go = rank[at, best] != NO_PAIR
            if not go.all():
                done[rows[~go], : sym.shape[1]] = sym[~go]
                done[rows[~go], sym.shape[1] :] = -1
                rows, sym, rank, piece, best = rows[go], sym[go], rank[go], piece[go], best[go]
                at = np.arange(len(rows))
                if not len(rows):
                    break
            sym[at, best] = piece[at, best]
            # what stands right of the merged pair moves up by one place
            n = sym.shape[1]
            from_ = columns[: n - 1] + (columns[: n - 1] > best[:, None])
            sym = np.take_along_axis(sym, from_, 1)
            rank = np.take_along_axis(rank, from_[:, : n - 2], 1)
            piece = np.take_along_axis(piece, from_[:, : n - 2], 1)
            if n == 2:
                rank, piece = np.full((len(rows), 1), NO_PAIR, np.int32), np.zeros((len(rows), 1), np.int32)
                continue
            for l in (best - 1, best):
                ok = np.flatnonzero((l >= 0) & (l < n - 2))
                rank[ok, l[ok]], piece[ok, l[ok]] = self._pairs(sym[ok, l[ok]], sym[ok, l[ok] + 1])
        have = done >= 0
        flat = done[have]
        ends = np.cumsum(have.sum(1)).tolist()
        ids = flat.tolist()
        out = [ids[lo:hi] for lo, hi in zip([0, *ends], ends)]
        for i in np.unique(np.nonzero(done >= NO_PIECE)[0]).tolist():
            out[i] = [y for x in out[i] for y in ([x] if x < NO_PIECE else [self.bytes_id[b] for b in chr(x - NO_PIECE).encode()] if self.bytes_id else [self.unk])]
        return out

    def _learn(self, units: set[str]) -> dict[str, bytes]:
        """Packed ids of units that the memo's young generation lacks."""
        out: dict[str, bytes] = {}
        by_length: dict[int, list[str]] = {}
        for u in units:
            if (packed := self.memo.recall(u)) is not None:
                out[u] = packed
            else:
                by_length.setdefault(-(-len(u) // 4) if len(u) <= MEMO_UNIT_CHARS else 0, []).append(u)
        for size, alike in by_length.items():
            for u, ids in zip(alike, self.merge_many(alike) if size else map(self.merge, alike)):
                out[u] = packed = struct.pack(f"<{len(ids)}I", *ids)
                self.fresh.append((u, ids))
                if size:
                    self.memo.put(u, packed)
        return out

    def encode_batch(self, texts: list[str]) -> list[bytes]:
        """Ids of each text without begin and end, as little-endian unsigned 32-bit integers."""
        units = [self.units.findall(MARK + t.replace(" ", MARK)) if t else [] for t in texts]
        made = [list(map(self.memo.young.get, us)) for us in units]
        open_ = [gaps(vs) for vs in made]
        missing = {us[i] for us, at in zip(units, open_) for i in at}
        fresh = self._learn(missing) if missing else {}
        for us, vs, at in zip(units, made, open_):
            for i in at:
                vs[i] = fresh[us[i]]
        return [b"".join(vs) for vs in made]

    def encode(self, text: str, bos: bool = False, eos: bool = False) -> list[int]:
        ids = np.frombuffer(self.encode_batch([text])[0], "<u4").tolist()
        return [self.bos] * bos + ids + [self.eos] * eos

    def decode(self, ids: list[int]) -> str:
        """The text of ids; the mark before the first piece is no part of it."""
        raw = b"".join(map(self.raw.__getitem__, ids))
        try:
            text = raw.decode()
        except UnicodeDecodeError:  # byte pieces that form no character
            return self.library.decode(list(ids))
        return text[1:] if text[:1] == " " else text

    def check_fresh(self) -> int:
        """Compare the units encoded since the last call with the library; return how many there were."""
        made, self.fresh = self.fresh, []
        units = [u for u, _ in made]
        # the library puts a mark in front of what it is asked; a mark by itself is asked with a line end
        asked = ["\n" if u == MARK else u[1:] if u[0] == MARK else "\n" + u for u in units]
        for (u, ours), theirs in zip(made, self.library.encode(asked, num_threads=1) if asked else []):
            theirs = theirs[:1] if u == MARK else theirs if u[0] == MARK else theirs[2:]
            if ours != theirs:
                raise ValueError(f"unit {u[:80]!r}: {ours[:20]} here, {theirs[:20]} by the library")
        return len(units)

    def check_text(self, text: str, ids: list[int], decoded: str) -> None:
        """Compare a whole text's ids, with begin and end, and their decoding with the library."""
        if self.library.encode(text, add_bos=True, add_eos=True) != ids:
            raise ValueError(f"the library encodes {text[:80]!r} otherwise")
        if self.library.decode(ids) != decoded:
            raise ValueError(f"the library decodes {text[:80]!r} otherwise")


@lru_cache(maxsize=2)
def codec(path: str) -> SentencePieceBpe:
    """One codec, with its memo, for each Python worker."""
    return SentencePieceBpe(path)


keeps("sentencepiece", codec.cache_clear)


def encode_decode(
    df: DataFrame,
    model: str = "piece_bpe_32k.model",
    text: str = "text",
    keep: list[str] | None = None,
    with_ids: bool = True,
    check_every: int = 16,
) -> DataFrame:
    """Columns `keep` of df, and each text's ids with begin and end (array<int>), count, hash and decoding.

    model is a file's path or the name of a public tokenizer.  With with_ids=False the arrays and
    decoded texts stay out and only their sizes and sha256 hashes come.  New columns whose names
    clash with kept ones get underscores in front.  Rows keep their number; an empty table gives none.
    """
    keep = [text_column(df, c) for c in (keep if keep is not None else [c for c in df.columns if c != text])]
    part = df.select(*[f"`{c}`" for c in keep])
    source = column_name(part, "text_")
    out = T.StructType([df.schema[c] for c in keep])
    new = [("n_tokens", T.LongType(), pa.int64()), ("ids_sha256", T.StringType(), pa.string()), ("decoded_sha256", T.StringType(), pa.string())]
    if with_ids:
        new += [("ids", T.ArrayType(T.IntegerType()), pa.list_(pa.int32())), ("decoded", T.StringType(), pa.string())]
    for name, kind, _ in new:
        out = out.add(column_name(part, name), kind)
    names = out.fieldNames()

    def work(b: pa.RecordBatch) -> pa.RecordBatch:
        serve("sentencepiece")
        c = codec(tokenizer_path(model))
        bos, eos = (np.array([x], "<u4").tobytes() for x in (c.bos, c.eos))
        rows: list[tuple] = []
        given = texts(b, source)
        coded = (p for lo, hi in groups_of(given, most=2_000_000) for p in c.encode_batch(given[lo:hi]))
        for k, (t, p) in enumerate(zip(given, coded)):
            packed = bos + p + eos
            ids = np.frombuffer(packed, "<u4").tolist()
            decoded = c.decode(ids)
            if k % check_every == 0:
                c.check_text(t, ids, decoded)
            rows.append((len(ids), hashlib.sha256(packed).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest(), *((ids, decoded) if with_ids else ())))
        c.check_fresh()
        made = [pa.array(v, t) for v, (_, _, t) in zip(zip(*rows), new)]
        return pa.RecordBatch.from_arrays([*(b.column(i) for i in range(len(keep))), *made], names=names)

    return map_batches(df.select(*[f"`{c}`" for c in keep], df[f"`{text_column(df, text)}`"].alias(source)), work, out)
