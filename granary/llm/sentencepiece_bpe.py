"""Encoding and decoding with merge-type (BPE) SentencePiece vocabularies.

The text is cut where no merge can cross: before a run of spaces, and around line
feeds. Each distinct segment is encoded by an agenda of adjacent symbol pairs in order
of score (then position), and kept while it is used, within a task; characters without
a piece fall back to their bytes. The agendas of a part's new segments move on together,
a merge of each at a time. An Arrow batch is coded and given on in parts of
CHARS_AT_ONCE, so that a task holds the results of one part, not of a batch of long texts.
Every part checks the ids and the decoded text of each segment that is new in it, and of
its longest text as a whole, against the sentencepiece library; a difference raises an
error instead of giving other results.

Defined results: null or empty text has no ids and decodes to the empty string;
repeated rows stay; extra columns are ignored; a text of any length, also without a
single space, is encoded whole (the agenda is O(n log n)).
"""

from __future__ import annotations

import functools
import hashlib
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from heapq import heapify, heappop, heappush
from itertools import groupby
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.llm.common import table

SPACE = "▁"
LONGEST_KEPT = 48
MOST_KEPT = 120_000
CHARS_AT_ONCE = 1 << 21
CHECKED_AT_ONCE = 256  # segments, as lines of one text
SLOT_BITS = 20
_KINDS = pa.int64(), pa.string(), pa.string()
_NONE = float("inf")
_SEGMENT = re.compile(f"{SPACE}+[^{SPACE}\n]*|[^{SPACE}\n]+|\n")


def _slot(pair: np.ndarray) -> np.ndarray:
    return (pair.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - SLOT_BITS)).astype(np.int64)


class Agenda:
    """A merge-type vocabulary, read through the library and applied without it."""

    def __init__(self, model_file: str):
        import sentencepiece

        self.library = library = sentencepiece.SentencePieceProcessor(model_file=model_file)
        self.texts = [library.id_to_piece(i) for i in range(len(library))]
        self.byte_ids, self.bytes_of, self.pieces, self.special = {}, {}, {}, set()
        for i, piece in enumerate(self.texts):
            if library.is_byte(i):
                self.byte_ids[int(piece[1:-1], 16)] = i
                self.bytes_of[i] = bytes([int(piece[1:-1], 16)])
            elif library.is_unknown(i) or library.is_control(i):
                self.special.add(i)
            else:
                self.pieces[piece] = (-library.get_score(i), i)
        self.scores = {piece: score for piece, (score, _) in self.pieces.items()}
        self._pair_up()
        if any(SPACE in p.lstrip(SPACE) or "\n" in p for p in self.pieces) or len(self.byte_ids) != 256:
            raise ValueError("this vocabulary has pieces across words or lines, or no byte fallback")
        if library.encode(" a  b ", out_type=str) and library.decode(library.encode(" a  b ")) != " a  b ":
            raise ValueError("this vocabulary's normaliser changes white space")

    def _pair_up(self) -> None:
        """Symbols as numbers (a piece's id; other characters of pieces come behind) and the sorted pairs of these that make a piece, with its place in order of score."""
        number = {piece: i for piece, (_, i) in self.pieces.items()}
        for c in sorted(set("".join(self.pieces))):
            number.setdefault(c, len(self.texts) + len(number))
        self.symbol_of = np.full(0x110000, -1, np.int32)  # by code point
        for c, i in number.items():
            if len(c) == 1:
                self.symbol_of[ord(c)] = i
        place_of = {score: place for place, score in enumerate(sorted(set(self.scores.values())))}
        self.symbol_at = np.full(len(place_of), -1, np.int32)  # a symbol without pairs where several pieces tie
        pairs, several = {}, Counter(self.scores.values())
        for piece, score in self.scores.items():
            place = place_of[score]
            if several[score] == 1:
                self.symbol_at[place] = number[piece]
            for k in range(1, len(piece)):
                a, b = number.get(piece[:k]), number.get(piece[k:])
                if a is not None and b is not None:
                    pairs[a << 32 | b] = place
        self.pair = np.array(sorted(pairs), np.int64)
        slot = _slot(self.pair)
        self.slots = np.zeros(1 << SLOT_BITS, np.int32)  # a pair's number by hash; -1 where pairs share a slot
        self.slots[slot] = np.arange(len(slot))
        self.slots[np.bincount(slot, minlength=1 << SLOT_BITS) > 1] = -1
        self.place = np.array([*map(pairs.__getitem__, self.pair.tolist()), len(place_of)], np.int32)

    def _places(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Of pairs of symbols, the place of the piece that each makes; behind all places if it makes none."""
        pair = a.astype(np.int64) << 32 | b
        at = self.slots[_slot(pair)]
        shared = np.flatnonzero(at < 0)
        at.flat[shared] = np.minimum(np.searchsorted(self.pair, pair.flat[shared]), len(self.pair) - 1)
        return np.where(self.pair[at] == pair, self.place[at], self.place[-1])

    def encode_segments(self, segments: Iterable[str]) -> Iterator[tuple[list[str], np.ndarray | None]]:
        """The short ones of the segments in blocks, in any order: each with the ids of its segments, one row each, or with None if they are to be encoded one by one."""
        for size, group in groupby(sorted(segments, key=len), len):
            if size > LONGEST_KEPT:
                return
            some = list(group)
            codes = np.frombuffer("".join(some).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(-1, size)
            symbols = self.symbol_of[codes]
            known = (symbols >= 0).all(1)
            alone, places = np.flatnonzero(~known).tolist(), np.flatnonzero(known)
            for rows, found in self._merged_together(symbols[known]):
                plain = ((found >= 0) & (found < len(self.texts))).all(1)
                alone += places[rows[~plain]].tolist()
                if plain.any():
                    yield [some[i] for i in places[rows[plain]].tolist()], found[plain]
            if alone:
                yield [some[i] for i in alone], None

    def _merged_together(self, symbols: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Row numbers and symbols of the rows that have no pair left, after each round of one merge a row."""
        rows, none = np.arange(len(symbols)), self.place[-1]
        places = self._places(symbols[:, :-1], symbols[:, 1:])
        while len(rows):
            if not places.shape[1]:
                yield rows, symbols
                return
            best = places.argmin(1)
            piece = places[np.arange(len(rows)), best]
            on = piece < none
            if not on.all():
                yield rows[~on], symbols[~on]
                rows, symbols, places, best, piece = rows[on], symbols[on], places[on], best[on], piece[on]
            n = np.arange(len(rows))
            behind = np.arange(symbols.shape[1] - 1) > best[:, None]
            symbols = np.where(behind, symbols[:, 1:], symbols[:, :-1])
            symbols[n, best] = self.symbol_at[piece]
            places = np.where(behind[:, :-1], places[:, 1:], places[:, :-1])
            for some, left in ((best > 0, best - 1), (best < places.shape[1], best)):
                r, k = n[some], left[some]
                places[r, k] = self._places(symbols[r, k], symbols[r, k + 1])

    def merged_short(self, segment: str) -> list[str]:
        """The symbols of a short segment; the agenda is the list of its pairs' scores, in order of position."""
        symbols, score = list(segment), self.scores.get
        agenda = [score(a + b, _NONE) for a, b in zip(symbols, symbols[1:], strict=False)]
        while agenda and (best := min(agenda)) < _NONE:
            i = agenda.index(best)
            symbols[i] += symbols.pop(i + 1)
            del agenda[i]
            if i < len(agenda):
                agenda[i] = score(symbols[i] + symbols[i + 1], _NONE)
            if i:
                agenda[i - 1] = score(symbols[i - 1] + symbols[i], _NONE)
        return symbols

    def encode_segment(self, segment: str) -> list[int]:
        symbols = self.merged_short(segment) if len(segment) <= LONGEST_KEPT else self.merged(segment)
        ids: list[int] = []
        for symbol in symbols:
            found = self.pieces.get(symbol)
            if found:
                ids.append(found[1])
            else:
                ids += [self.byte_ids[b] for b in symbol.encode("utf-8", "surrogatepass")]
        return ids

    def merged(self, segment: str) -> list[str]:
        """The symbols of a segment of any length; the agenda is a heap of pairs by score and position."""
        pieces, symbols = self.pieces, list(segment)
        n = len(symbols)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        agenda = []
        for i in range(n - 1):
            if found := pieces.get(pair := symbols[i] + symbols[i + 1]):
                agenda.append((found[0], i, i + 1, pair))
        heapify(agenda)
        while agenda:
            _, i, j, pair = heappop(agenda)
            # a pair is stale once either symbol was merged away or has grown
            if symbols[i] is None or symbols[j] is None or len(symbols[i]) + len(symbols[j]) != len(pair) or after[i] != j:
                continue
            symbols[i], symbols[j] = pair, None
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if found := pieces.get(x := pair + symbols[k]):
                    heappush(agenda, (found[0], i, k, x))
            if (h := before[i]) >= 0 and (found := pieces.get(x := symbols[h] + pair)):
                heappush(agenda, (found[0], h, i, x))
        return [x for x in symbols if x is not None]

    def decode_segment(self, ids: list[int]) -> str:
        parts, run = [], b""
        for i in ids:
            if i in self.bytes_of:
                run += self.bytes_of[i]
                continue
            if run:
                parts.append(run.decode("utf-8", "replace"))
                run = b""
            parts.append(self.texts[i].replace(SPACE, " "))
        return "".join(parts) + run.decode("utf-8", "replace")


def segments(text: str) -> list[str]:
    return _SEGMENT.findall(SPACE + text.replace(" ", SPACE)) if text else []


class Known(dict):
    """(ids joined by commas, decoded text) by segment; long segments are not kept.

    Once MOST_KEPT are held, they become the older half: what is used again moves on, the rest goes with the next turn.
    """

    def __init__(self, agenda: Agenda):
        super().__init__()
        self.agenda, self.older = agenda, {}
        self.new: list[tuple[str, list[int], str]] = []
        self.blocks: list[tuple[list[str], np.ndarray, list[str]]] = []

    def __missing__(self, segment: str) -> tuple[str, str]:
        found = self.older.pop(segment, None)
        if found is None:
            ids = self.agenda.encode_segment(segment)
            decoded = self.agenda.decode_segment(ids)
            found = ",".join(map(str, ids)), decoded
            self.new.append((segment, ids, decoded))
        if len(segment) <= LONGEST_KEPT:
            self[segment] = found
        return found

    def learn(self, segments: set[str]) -> None:
        """Encodes together what is short and not known."""
        new = segments.difference(self)
        back = new.intersection(self.older)
        self.update(zip(back, map(self.older.pop, back), strict=True))
        new -= back
        for some, found in self.agenda.encode_segments(new):
            if found is None:
                for segment in some:
                    self[segment]
                continue
            # pieces without bytes: the texts of a segment's pieces are the segment
            n, size = found.shape
            ids = (("%d," * (size - 1) + "%d\n") * n % tuple(found.ravel().tolist())).split("\n")
            decoded = [x.replace(SPACE, " ") for x in some]
            self.update(zip(some, zip(ids, decoded, strict=False), strict=False))
            self.blocks.append((some, found, decoded))

    def check(self, text: str, ids: str, decoded: str) -> None:
        """Compares what is new, and one whole text, with the library."""
        library = self.agenda.library
        # no merge crosses a line feed: segments are checked as lines, the first one behind the library's own space mark
        start, feed = library.encode("\n"), self.agenda.encode_segment("\n")
        for segment, own, back in self.new:
            self._check_lines([segment], start + own, [back])
        for some, found, back in self.blocks:
            lines = np.concatenate([np.tile(np.array(feed, np.int32), (len(found), 1)), found], axis=1)
            for k in range(0, len(some), CHECKED_AT_ONCE):
                own = start[: -len(feed)] + lines[k : k + CHECKED_AT_ONCE].ravel().tolist()
                self._check_lines(some[k : k + CHECKED_AT_ONCE], own, back[k : k + CHECKED_AT_ONCE])
        self.new, self.blocks = [], []
        found = library.encode(text)
        if ",".join(map(str, found)) != ids or library.decode(found) != decoded:
            raise ValueError("ids or text differ from the library's for a whole text")
        if len(self) > MOST_KEPT:
            self.older = dict(self)
            self.clear()

    def _check_lines(self, lines: list[str], own: list[int], back: list[str]) -> None:
        library = self.agenda.library
        theirs = library.encode("\n" + "\n".join(lines).replace(SPACE, " "))
        if own != theirs or library.decode(theirs) != "\n" + "\n".join(back):
            raise ValueError(f"ids or text differ from the library's for one of {lines!r}")


@functools.lru_cache(maxsize=2)
def _agenda(model_file: str) -> Agenda:
    return Agenda(model_file)


def encode_text(known: Known, text: str) -> tuple[str, str]:
    """(ids joined by commas, text decoded from them)"""
    return joined(known, segments(text))


def joined(known: Known, cut: list[str]) -> tuple[str, str]:
    if len(cut) < 2:
        found = [known[x] for x in cut]
    else:
        found = itemgetter(*cut)(known)
    return ",".join([x[0] for x in found]), "".join([x[1] for x in found])[1:]


def parts(batch: pa.Array) -> Iterator[list[str]]:
    """The texts of an Arrow batch in order, cut behind the text that fills CHARS_AT_ONCE."""
    part, n = [], 0
    for text in batch:
        part.append(text.as_py())
        n += len(part[-1])
        if n >= CHARS_AT_ONCE:
            yield part
            part, n = [], 0
    if part:
        yield part


def coded_parts(batches: Iterator[pa.Array], known: Known, digest: bool) -> Iterator[pa.Array]:
    """n_tokens, ids and decoded of the batches' texts in order, a part at a time."""
    hexed = (lambda x: hashlib.sha256(x.encode("utf-8", "surrogatepass")).hexdigest()) if digest else (lambda x: x)
    for batch in batches:
        for part in parts(batch):
            rows, longest = [], ("", "", "")
            cut = list(map(segments, part))
            known.learn(set().union(*cut))
            for text, own in zip(part, cut, strict=True):
                ids, decoded = joined(known, own)
                if len(longest[0]) <= len(text):
                    longest = text, ids, decoded
                rows.append((ids.count(",") + 1 if ids else 0, hexed(ids), hexed(decoded)))
            known.check(*longest)
            columns = [pa.array(x, kind) for x, kind in zip(zip(*rows, strict=True), _KINDS, strict=True)]
            yield pa.StructArray.from_arrays(columns, ["n_tokens", "ids", "decoded"])


def coded(text: Column, model_file: str, digest: bool = False) -> Column:
    """struct of n_tokens, ids and decoded of a text; with digest, both as lower-case hex SHA-256."""

    @F.arrow_udf("n_tokens long, ids string, decoded string")
    def code(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        return coded_parts(batches, Known(_agenda(model_file)), digest)  # what is known ends with its task

    return code(F.coalesce(text, F.lit("")))


def model_path(name: str = "piece_bpe_32k.model") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op9_sentencepiece_bpe(spark: SparkSession, sf_dir: str, model_file: str | None = None) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = documents.select("doc_id", coded(F.col("text"), model_file or model_path(), digest=True).alias("c"))
    return found.select("doc_id", "c.n_tokens", F.col("c.ids").alias("ids_sha256"), F.col("c.decoded").alias("decoded_sha256"))
