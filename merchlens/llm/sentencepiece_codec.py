"""SentencePiece encoding and decoding on the pieces and scores of a public model file.

An Aho-Corasick automaton over the pieces reads a text once; at each position
the output links give every piece that ends there (longest first), and each relaxes
the best score of that position (Viterbi).  A character that is no piece takes the
unknown score and becomes its UTF-8 byte pieces.  Ties keep the longer last piece.

For a unigram model every link is open and the largest sum of scores wins.  A pair-merging
(BPE) model's scores are the order of its merges, so a link is open only where that
order keeps its two pieces apart: the merges of the two pieces' text alone must end in
these two pieces.  Merges never cross a boundary of the final pieces, so exactly one link
into each position is open, and the open path is the library's encoding.  A pair is tested
once per worker, by a walk up the merges that touch its boundary.

Pieces hold the blank mark only at their start, so the best path of a text is the
concatenation of the best paths of its words, each with the blanks before it; these are
cached per worker (see :mod:`merchlens.llm.tokens`).  Texts that hold the blank mark itself
or one of the marker characters used here go through whole.

Nulls: a null text is empty and has no ids; decoding null gives null.  Every text
without the blank mark U+2581 itself comes back unchanged from decoding.  A row's ids follow
from its text alone: repeated rows repeat, an empty table gives an empty one, very long texts
are read in one pass, and other columns are not touched.
"""

from __future__ import annotations

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

from merchlens.llm.tokens import _FIRST, _LINE, _MORE, _PUNCT, CACHE_WORDS, TextEncoder, _le, encoder, lists_to_bytes

BLANK = "▁"
_UNKNOWN_PENALTY = 10.0


class PieceCodec(TextEncoder):
    """Encoder and decoder for one SentencePiece model file."""

    def __init__(self, path: str, cache_words: int = CACHE_WORDS):
        from sentencepiece import SentencePieceProcessor, sentencepiece_model_pb2

        m = SentencePieceProcessor(model_file=path)
        self.limit, self.cache, self.drops_blanks = cache_words, {}, False
        self.odd = f"[{_LINE}{_FIRST}{_MORE}]|{BLANK}"
        model = sentencepiece_model_pb2.ModelProto()
        model.ParseFromString(m.serialized_model_proto())
        self.merges = model.trainer_spec.model_type == model.trainer_spec.BPE
        self.pieces: list[str] = []
        self.rank: dict[str, float] = {}
        # per piece (the last: the start of a text) the pieces tested after it
        self.apart: list[dict[int, bool]] = [{} for _ in range(m.get_piece_size() + 1)]
        self.tested = 0
        self.runs: dict[str, bytes] = {}
        self.edges: dict[int, tuple[list, list, bool] | None] = {}
        self.automaton = ahocorasick.Automaton()
        self.byte_ids = [0] * 256
        self.out: list[bytes] = []
        low = 0.0
        for i in range(m.get_piece_size()):
            piece = m.id_to_piece(i)
            self.pieces.append(piece)
            if m.is_byte(i):
                b = int(piece[3:5], 16)
                self.byte_ids[b] = i
                self.out.append(bytes([b]))
            elif m.is_control(i) or m.is_unknown(i):
                self.out.append(" ⁇ ".encode() if m.is_unknown(i) else b"")
            else:
                if BLANK in piece.lstrip(BLANK) or "\n" in piece:
                    raise ValueError(f"a piece joins words: {piece!r}")
                self.automaton.add_word(piece, (i, len(piece), m.get_score(i)))
                self.rank[piece] = m.get_score(i)
                low = min(low, m.get_score(i))
                self.out.append(piece.replace(BLANK, " ").encode())
        self.automaton.make_automaton()
        # no piece joins a letter and another character: letters and what follows them part
        self.letters_part = not any(a.isalpha() != b.isalpha() for p in self.rank for a, b in zip(p.lstrip(BLANK), p.lstrip(BLANK)[1:]))
        self.unknown = low - _UNKNOWN_PENALTY
        sizes = np.array([len(x) for x in self.out], np.int64)
        self.out_sizes, self.out_starts = sizes, np.cumsum(sizes) - sizes
        self.out_flat = np.frombuffer(b"".join(self.out), np.uint8)

    def _merge(self, text: str) -> tuple[list[str], list[tuple[float, int, str]]]:
        """(symbols left, merges as score, place and result) of a short text, best pair first."""
        parts, rank, steps = list(text), self.rank, []
        while len(parts) > 1:
            best, at = -np.inf, -1
            for i in range(len(parts) - 1):
                r = rank.get(parts[i] + parts[i + 1])
                if r is not None and r > best:
                    best, at = r, i
            if at < 0:
                break
            parts[at:at + 2] = [parts[at] + parts[at + 1]]
            steps.append((best, at - len(parts), parts[at]))
        return parts, steps

    def _edges(self, piece: int) -> tuple[list, list, bool] | None:
        """First and last symbols of a piece as its merges go on, each with the score that ends
        it, and whether the scores only fall; None if the merges do not end in the piece."""
        if piece not in self.edges:
            text = self.pieces[piece]
            parts, steps = self._merge(text)
            known = None
            if len(parts) == 1:
                first, last, n = [(text[0], -np.inf)], [(text[-1], -np.inf)], len(text)
                for score, back, made in steps:
                    n -= 1
                    if back == -n:
                        first[-1] = (first[-1][0], score)
                        first.append((made, -np.inf))
                    if back == -1:
                        last[-1] = (last[-1][0], score)
                        last.append((made, -np.inf))
                known = first, last, all(x[0] >= y[0] for x, y in zip(steps, steps[1:]))
            self.edges[piece] = known
        return self.edges[piece]

    def _apart(self, left: int, right: int) -> bool:
        """Whether the merges end in piece ``left`` followed by ``right`` (-1: nothing to merge with)."""
        b = self._edges(right)
        if left < 0 or b is None:
            return b is not None
        a = self._edges(left)
        if a is None:
            return False
        if not (a[2] and b[2]):  # a later merge may come first: do them all
            return self._merge(self.pieces[left] + self.pieces[right])[0] == [self.pieces[left], self.pieces[right]]
        get, ends, starts, i, j = self.rank.get, a[1], b[0], 0, 0
        while True:
            (x, until), (y, until_y) = ends[i], starts[j]
            across = get(x + y)
            # of equal scores the merge further left comes first
            if across is not None and across > until and across >= until_y:
                return False
            if until >= until_y:
                if until == -np.inf:
                    return True
                i += 1
            else:
                j += 1

    def _test(self, left: int, right: int) -> bool:
        if self.tested >= self.limit:
            self.tested = 0
            for row in self.apart:
                row.clear()
        self.tested += 1
        is_open = self.apart[left][right] = self._apart(left, right)
        return is_open

    def viterbi(self, text: str) -> list[int]:
        """Ids of the best path over a text whose blanks are marks already."""
        last, width = self._open_path(text) if self.merges else self._best_path(text)
        ids: list[int] = []
        at = len(text) - 1
        while at >= 0:
            piece = last[at]
            if piece < 0:
                ids += [self.byte_ids[b] for b in reversed(text[at].encode())]
            else:
                ids.append(piece)
            at -= width[at]
        ids.reverse()
        return ids

    def _best_path(self, text: str) -> tuple[list[int], list[int]]:
        """Per character the piece that ends there on the best path (-1: none) and its width."""
        n, unknown = len(text), self.unknown
        best = [-np.inf] * n + [0.0]  # place -1 is the start
        last, width, alone = [-1] * n, [1] * n, [False] * n
        done = 0  # characters before this one have their final score
        for end, (piece, size, score) in self.automaton.iter(text):
            while done < end:
                if not alone[done] and best[done - 1] + unknown > best[done]:
                    best[done], last[done], width[done] = best[done - 1] + unknown, -1, 1
                done += 1
            if size == 1:
                alone[end] = True
            s = best[end - size] + score
            if s > best[end]:
                best[end], last[end], width[end] = s, piece, size
        for at in range(done, n):
            if not alone[at] and best[at - 1] + unknown > best[at]:
                best[at], last[at], width[at] = best[at - 1] + unknown, -1, 1
        return last, width

    def _open_path(self, text: str) -> tuple[list[int], list[int]]:
        """The same where one link into each place is open: its score is the best, and the links
        after it need no test.  A character that no open link reaches has no piece."""
        n, rows = len(text), self.apart
        best = [0.0] * (n + 1)  # place -1 is the start
        last, width = [-1] * (n + 1), [1] * n
        after = [rows[-1]] * (n + 1)
        settled = -1
        for end, (piece, size, score) in self.automaton.iter(text):
            if end == settled:
                continue
            while settled < end - 1:  # passed without an open link
                settled += 1
                best[settled] = best[settled - 1] + self.unknown
            at = end - size
            is_open = after[at].get(piece)
            if is_open is None:
                is_open = self._test(last[at], piece)
            if is_open:
                best[end], last[end], width[end], after[end], settled = best[at] + score, piece, size, rows[piece], end
        return last, width

    def forget(self) -> None:
        self.tested = 0
        for row in self.apart:
            row.clear()
        super().forget()

    def _ids(self, text: str) -> bytes:
        return _le(self.viterbi(text))

    def _whole(self, texts: list[str]) -> list[bytes]:
        return [self._ids(BLANK + t.replace(" ", BLANK)) if t else b"" for t in texts]

    def _mark(self, texts: pa.Array) -> pa.Array:
        # the blank put before a text, and in a run of blanks all but the first marked
        spaced = pc.if_else(pc.equal(texts, ""), "", pc.binary_join_element_wise(" ", texts, ""))
        runs = pc.replace_substring(pc.replace_substring(spaced, "  ", " " + _MORE), _MORE + " ", _MORE + _MORE)
        return pc.binary_join_element_wise(_FIRST, pc.replace_substring(runs, "\n", " " + _LINE), "")

    def _run(self, marks: str) -> bytes:
        ids = self.runs.get(marks)
        if ids is None:
            if len(self.runs) > 10_000:
                self.runs.clear()
            ids = self.runs[marks] = self._ids(marks)
        return ids

    def _words(self, words: list[str]) -> list[bytes]:
        out, cache = [], self.cache
        for w in words:
            stem = w.rstrip(_PUNCT) if self.letters_part else w
            if len(stem) < len(w) and stem.isalpha():  # letters, then punctuation
                ids = cache.get(stem)
                if ids is None:
                    ids = cache[stem] = self._ids(BLANK + stem)
                out.append(ids + self._run(w[len(stem):]))
                continue
            if w == _FIRST:  # what stands before the first blank
                out.append(b"")
            elif w[:1] == _LINE:
                out.append(self._ids("\n" + w[1:]))
            else:
                out.append(self._ids(BLANK + w.replace(_MORE, BLANK)))
        return out

    def decode(self, ids: np.ndarray, offsets: np.ndarray) -> list[str]:
        """Texts of the id runs between neighbouring offsets."""
        sizes = self.out_sizes[ids]
        ends = np.cumsum(sizes)
        total = int(ends[-1]) if len(ends) else 0
        flat = self.out_flat[np.repeat(self.out_starts[ids] - (ends - sizes), sizes) + np.arange(total)].tobytes()
        cuts = np.concatenate([[0], ends])[offsets].tolist()
        texts = [flat[a:b].decode("utf-8", "replace") for a, b in zip(cuts, cuts[1:])]
        return [t[1:] if t[:1] == " " else t for t in texts]


def _encode(path: str):
    @F.arrow_udf("binary")
    def piece_ids(texts: pa.Array) -> pa.Array:
        codec, parts = encoder(path, PieceCodec), []
        for at in range(0, max(len(texts), 1), 1000):
            parts.append(lists_to_bytes(*codec.encode(texts.slice(at, 1000))))
        return pa.concat_arrays(parts)

    return piece_ids


def _decode(path: str):
    @F.arrow_udf("string")
    def piece_text(rows: pa.Array) -> pa.Array:
        codec, texts = encoder(path, PieceCodec), []
        for at in range(0, len(rows), 1000):
            raw = rows.slice(at, 1000).to_pylist()
            offsets = np.cumsum([0, *(len(r or b"") // 4 for r in raw)])
            found = codec.decode(np.frombuffer(b"".join(r or b"" for r in raw), "<u4"), offsets)
            texts += [None if r is None else t for r, t in zip(raw, found)]
        return pa.array(texts, pa.string())

    return piece_text


def encode_column(text: Column, path: str) -> Column:
    """Little-endian uint32 piece ids of a text column."""
    return _encode(path)(text)


def decode_column(ids: Column, path: str) -> Column:
    """Text of a column of little-endian uint32 piece ids."""
    return _decode(path)(ids)
